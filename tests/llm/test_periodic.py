"""Runs equal those of a quadratic search, on whole words of numbers and through the stretches; odd tables are as stated."""

import hashlib
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemill.llm import periodic


def plain(w, shortest=12):
    """start, length, period by trying all periods."""
    n, found = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i - s + q >= max(shortest, 2 * q):
                found.setdefault((s, i - s + q), q)
            i += 1
    return sorted((s, n, q) for (s, n), q in found.items())


def by_place(found):
    return sorted(tuple(x) for x in found.tolist())


def bent(w, a, p):
    return [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]


@given(st.lists(st.integers(0, 3), max_size=60), st.data(), st.sampled_from([2, 3, 5, 12]))
@settings(max_examples=300, deadline=None)
def test_runs(w, data, shortest):
    if w and data.draw(st.booleans()):
        a = data.draw(st.integers(0, len(w) - 1))
        w = bent(w, a, data.draw(st.integers(1, len(w) - a)))
    assert by_place(periodic.runs_in(np.array(w, np.int64), shortest)) == plain(w, shortest)
    assert by_place(periodic.runs([b"%d" % x for x in w], shortest)) == plain(w, shortest)


def test_common_prefixes():
    random.seed(3)
    for size, kinds in ((200, 2), (300, 1), (150, 40)):
        w = [random.randrange(kinds) for _ in range(size)]
        tree = periodic.SuffixTree([x + 1 for x in w])
        a, b = (np.array([random.randrange(size + 1) for _ in range(2000)]) for _ in range(2))
        a, b = a[a != b], b[a != b]
        want = [next((k for k in range(size) if max(i, j) + k >= size or w[i + k] != w[j + k]), 0) for i, j in zip(a.tolist(), b.tolist())]
        assert tree.common(a, b).tolist() == want
        order = sorted(range(size + 1), key=lambda i: w[i:])
        assert np.argsort(tree.rank).tolist() == order


def test_stretches_leave_out_what_repeats_far_away():
    far = [*range(50), 100, *range(50, 100), 101, *range(50)]
    assert periodic.stretches(np.array(far), 12) == []
    near = [*range(30), *range(40, 52), *range(40, 52), *range(60, 90)]
    assert [(a <= 30, z >= 54) for a, z in periodic.stretches(np.array(near), 12)] == [(True, True)]


def digest(i, text, shortest=12):
    words = (text or "").encode().split()
    h = 0 if i is None else zlib.crc32(str(i).encode())
    if i is not None and h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        words = bent(words, a, 1 + (n - a) // (3 + g % 8))
    found = sorted(plain(words, shortest), key=lambda r: (r[0], r[2]))
    lost = {k for s, n, q in found for k in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    runs = "".join(f"{s},{n},{q}\n" for s, n, q in found).encode()
    return (i, len(found), *(best + (1000 * best[1] // best[2],) if best else (None,) * 4), sha(runs), sha(b" ".join(w for k, w in enumerate(words) if k not in lost)))


NAMES = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
TEXTS = [None, "", " \n\t", "a", "ha " * 50, "one two three four " * 6 + "end", "été x " * 13, "x\x0by " * 8 + "p q " * 8, "a b a b a b a c " * 5]


def test_report(spark):
    random.seed(5)
    docs = [(i, TEXTS[i % len(TEXTS)]) for i in range(-5, 40)] + [(i, " ".join(random.choice("abcdefgh") for _ in range(200))) for i in range(40, 100)]
    docs += [(None, TEXTS[5]), docs[3], docs[3]]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, `a.b` string").repartition(3)
    got = [tuple(r) for r in periodic.report(periodic.planted(df)).select(*NAMES).collect()]
    assert sorted(got, key=repr) == sorted((digest(*d) for d in docs), key=repr)
    assert periodic.report(df.limit(0)).collect() == [] and periodic.find(df.limit(0)).collect() == []


def test_find_and_collapse(spark):
    docs = [(1, "x y z " * 5 + "end", 1, "r"), (2, "no  runs\nhere", 2, "r"), (3, None, 3, None), (None, "b " * 12, 4, "s")]
    df = spark.createDataFrame(docs, "doc_id long, text string, row int, `a.b` string")
    assert sorted(map(tuple, periodic.find(df).collect()), key=repr) == [(1, 0, 15, 3), (None, 0, 12, 1)]
    got = periodic.collapse(df)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect()), key=repr) == [(1, "x y z end", 1, "r"), (2, "no  runs\nhere", 2, "r"), (3, None, 3, None), (None, "b", 4, "s")]


def test_long_text(spark):
    text = " ".join(f"w{i}" for i in range(5000)) + " tick" * 60_000 + " " + "tick tock " * 3000
    found = periodic.runs(periodic.words_of(text))
    assert by_place(found) == [(5000, 60_001, 1), (65_000, 6000, 2)]
