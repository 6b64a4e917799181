import hashlib
import random

import numpy as np
import pytest

from tidemill.llm import suffix


def brute(rows, least=50):
    """Of each row: bytes, removed, spans, hash of the rest."""
    big = 1 << 62
    first = {}
    texts = [(big if d is None else d, (t or "").encode()) for d, t in rows]
    for d, t in texts:
        for i in range(len(t) - least + 1):
            s = t[i : i + least]
            first[s] = min(first.get(s, big), d)
    out = []
    for d, t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - least + 1):
            if first[t[i : i + least]] < d:
                gone[i : i + least] = [True] * least
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((None if d == big else d, len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return out


def corpus(seed):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(1, 7))) for _ in range(60)]
    say = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    passages = [say(rnd.randrange(8, 40)) for _ in range(12)]
    rows = []
    for d in range(60):
        parts = [say(rnd.randrange(0, 40)) for _ in range(3)]
        for _ in range(rnd.randrange(3)):
            p = rnd.choice(passages)
            i = rnd.randrange(len(p))
            parts.insert(rnd.randrange(4), p[i : i + rnd.randrange(20, 200)] if rnd.random() < 0.5 else p)
        rows.append((d, " ".join(parts)))
    long = say(3000)
    rows += [(60, None), (61, ""), (62, "z" * 400), (63, "z" * 49), (64, "z" * 50), (65, "ab" * 300), (66, "ba" * 40 + "z" * 60)]
    rows += [(67, long), (70, long[500:9000]), (68, long), (None, long[:700]), (None, long[:700]), rows[7], (80, rows[7][1]), (5, rows[9][1]), (90, "\0\1" * 40 + "ÿ" * 60), (91, "\1" + "\0\1" * 30)]
    rnd.shuffle(rows)
    return rows


def test_expansion_finds_the_equal_windows():
    rnd = random.Random(4)
    strings = [bytes(rnd.choice(b"ab\0") for _ in range(rnd.randrange(20, 40))) for _ in range(60)]
    text = b"".join(strings)
    at, group = suffix.classes(np.frombuffer(text, np.uint8), np.array([len(s) for s in strings]), 10)
    start, want = 0, {}
    for s in strings:
        for i in range(len(s) - 9):
            want.setdefault(s[i : i + 10], []).append(start + i)
        start += len(s)
    got = {}
    for a, g in zip(at.tolist(), group.tolist()):
        got.setdefault(g, []).append(a)
    assert sorted(sorted(v) for v in got.values()) == sorted(want.values())
    assert group.tolist() == sorted(group.tolist())


@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh", "\0a"])
def test_common_prefixes_against_brute_force(alphabet):
    rnd = random.Random(len(alphabet))
    strings = [[ord(rnd.choice(alphabet)) + 1 for _ in range(rnd.randrange(1, 30))] for _ in range(40)] + [[98] * 25] * 3
    sym = np.array([x for s in strings for x in [*s, 0]])
    rest = np.array([len(s) - i for s in strings for i in range(len(s) + 1)])
    sa = suffix.suffix_array(sym, rest, 12)
    ends = [sym[i : i + r].tolist() for i, r in enumerate(rest)]
    heads = [tuple(ends[i][:12]) for i in sa]
    assert heads == sorted(heads)
    common = lambda x, y: next((k for k, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))
    want = [0] + [min(12, common(ends[a], ends[b])) for a, b in zip(sa, sa[1:])]
    assert suffix.common_prefixes(sym, sa, 12).tolist() == want


def test_segments_cover_all_windows_in_blocks(monkeypatch):
    monkeypatch.setattr(suffix, "CHUNK", 100)
    texts = [(t or "").encode() for _, t in corpus(1)]
    buf, off = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts])
    first, last, h, ends, doc = suffix.segments(buf, off, 50)
    windows = [w for a, z in zip(first, last) for w in range(a, z + 1)]
    assert windows == [w for a, z in zip(off, off[1:]) for w in range(a, z - 49)]
    anchors = {}
    for a, z, x, d in zip(first, last, h, doc):
        for w in range(a, z + 1):
            assert off[d] <= w and w + 50 <= off[d + 1]
            assert anchors.setdefault(buf[w : w + 50].tobytes(), x) == x


@pytest.mark.parametrize(("seed", "hot"), [(0, 20_000), (1, 20_000), (2, 3), (3, 1)])
def test_report_against_brute_force(spark, seed, hot, monkeypatch):
    monkeypatch.setattr(suffix, "HOT", hot)
    monkeypatch.setattr(suffix, "PIECE", 3000)
    monkeypatch.setattr(suffix, "SHARE", 9000)
    monkeypatch.setattr(suffix, "CHUNK", 1000)
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_bytes string")
    got = [tuple(r) for r in suffix.report(df).collect()]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


@pytest.mark.parametrize("name", ["data", "null", "piece", "hits", "a.b", "c0", "rest"])
def test_dedup_keeps_columns_of_any_name(spark, name):
    p = "a passage that is repeated and has more than fifty bytes"
    df = spark.createDataFrame([("x", 1, "one " + p), (None, 2, p + " two"), ("z", 3, None)], f"`{name}` string, doc_id long, text string")
    out = suffix.dedup(df)
    assert out.columns == [name, "doc_id", "text"]
    assert sorted((tuple(r) for r in out.collect()), key=lambda r: r[1]) == [("x", 1, "one " + p), (None, 2, " two"), ("z", 3, None)]


def test_dedup_keeps_columns_and_characters(spark):
    p = "éü" * 40
    rows = [(1, "one " + p, "k", 1), (2, p + " two", None, 1), (3, p, "gone", 1), (4, "", "e", 0), (5, None, "n", None)]
    df = spark.createDataFrame(rows, "doc_id int, text string, data string, n_chars long")
    got = {r.doc_id: (r.text, r.data, r.n_chars) for r in suffix.dedup(df).collect()}
    assert got == {1: ("one " + p, "k", 84), 2: (" two", None, 4), 4: ("", "e", 0), 5: (None, "n", None)}
    assert suffix.report(df.limit(0)).count() == 0
    assert suffix.dedup(df.limit(0)).count() == 0


@pytest.mark.parametrize("least", [18, 33, 124])
def test_other_lengths(spark, least):
    rows = corpus(9)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted([tuple(r) for r in suffix.report(df, least).collect()], key=key) == sorted(brute(rows, least), key=key)
