"""Joins equal those of all pairs: sets that are random, alike, of all sizes and in groups of copies; odd tables are as stated."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemill.llm import jaccard
from tidemill.llm.common import Scratch


def classes_of(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def alike(a, b, similarity):
    a, b = set(a), set(b)
    return bool(a and b) and similarity[1] * len(a & b) >= similarity[0] * len(a | b)


@st.composite
def likely(draw):
    """Sets that are changed copies of a few."""
    rng = random.Random(draw(st.integers(0, 10**6)))
    base = [rng.sample(range(4000), rng.randrange(1, 60)) for _ in range(3)]
    sets = []
    for _ in range(draw(st.integers(2, 90))):
        x = set(rng.choice(base))
        for _ in range(rng.randrange(4)):
            x.discard(rng.choice([*x, 0]))
            x.add(rng.randrange(4000))
        sets.append(np.array(sorted(x), "<u8"))
    return sets


@given(likely(), st.sampled_from([(17, 20), (4, 5), (1, 2), (1, 1)]), st.booleans())
@settings(max_examples=150, deadline=None)
def test_join(sets, similarity, within):
    n = len(sets)
    left = np.arange(n) if within else np.arange(n // 2)
    right = left if within else np.arange(n // 2, n)
    if not len(left) or not len(right):
        return
    found = jaccard.join(sets, left, right, similarity)
    want = [(i, j) for i in left.tolist() for j in right.tolist() if i != j and alike(sets[i], sets[j], similarity)]
    assert classes_of(n, found) == classes_of(n, want)
    assert len(found) < n


@given(st.lists(st.integers(0, 60), min_size=1, max_size=40, unique=True), st.lists(st.integers(0, 60), min_size=1, max_size=40, unique=True), st.sampled_from([(17, 20), (4, 5), (1, 2), (1, 1)]))
@settings(max_examples=300, deadline=None)
def test_alike_sets_share_leading_shingles(a, b, similarity):
    lead = [jaccard.leading(np.array(sorted(x), np.uint64), np.array([3, 7, 8, 20], np.uint64), similarity).tolist() for x in (a, b)]
    if alike(a, b, similarity):
        assert len({*lead[0]} & {*lead[1]}) >= min(jaccard.AGREE, -(similarity[0] * min(len(a), len(b)) // -similarity[1]))


def words(rng, n):
    return [f"w{rng.randrange(400)}" for _ in range(n)]


def shingle_set(text, size):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())


def plain(docs, size, similarity):
    sets = [shingle_set(t, size) for _, t in docs]
    label = classes_of(len(docs), [(i, j) for i in range(len(docs)) for j in range(i) if alike(sets[i], sets[j], similarity)])
    least = {}
    for (i, _), c in zip(docs, label):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    return sorted(((i, len(s), least.get(c)) for (i, _), s, c in zip(docs, sets, label)), key=repr)


def corpus():
    rng = random.Random(8)
    docs, k = [], 100
    for _ in range(12):
        base = words(rng, rng.choice([3, 9, 40, 200, 900]))
        for _ in range(rng.choice([1, 2, 9, 30])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                w[rng.randrange(len(w))] = f"n{rng.randrange(9)}"
            docs.append((k, " ".join(w)))
            k += 1
    rng.shuffle(docs)
    long = words(rng, 30_000)
    docs += [(7, " ".join(long)), (9, " ".join([*long, "end"])), (3, "A b C d e"), (2, "a B c D e "), (1, None), (4, ""), (5, " \n"), (6, "a"), (8, "A"), (None, "x y z 1 2 3 4 5 6 7 8 9"), (None, "x y z 1 2 3 4 5 6 7 8 9"), (None, None)]
    return docs + docs[:3]


@pytest.mark.parametrize("listed,block", [(16, 512), (2, 5)])
def test_equals_all_pairs(spark, monkeypatch, listed, block):
    """Also with lots that are cut in blocks, and where no pairs are listed but of two."""
    monkeypatch.setattr(jaccard, "LISTED", listed)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    docs = corpus()
    df = spark.createDataFrame([(*d, "c") for d in docs], "doc_id long, text string, `n.set` string").repartition(5)
    got = sorted((tuple(r) for r in jaccard.near_duplicates(df, 4, (17, 20)).select("doc_id", "n_shingles", "component_id").collect()), key=repr)
    assert got == plain(docs, 4, (17, 20))


def test_a_group_that_only_its_middle_holds_together(spark, monkeypatch):
    """Each copy is like one text, but hardly like any other copy; blocks of 16 texts."""
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    rng = random.Random(4)
    base = [f"b{i}" for i in range(203)]
    docs = [(500, " ".join(base))]
    for k in range(120):
        w = list(base)
        for at in rng.sample(range(0, 200, 8), 4):
            w[at] = f"c{k}-{at}"
        docs.append((k, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = sorted((tuple(r) for r in jaccard.near_duplicates(df, 4, (17, 20)).collect()), key=repr)
    assert got == plain(docs, 4, (17, 20)) and {r[2] for r in got} == {0}


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.near_duplicates(none).collect() == []
    assert jaccard.classes(none, Scratch(spark)).collect() == []
