import math
import random

import numpy as np
import pytest

from tidemill.llm import topk


def brute(rows, k=5):
    kept = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            kept.setdefault(i, []).append([math.floor(256 * x) for x in v])
    out = set()
    for q in kept:
        if q % 50 == 0:
            asked = min(kept[q])
            score = sorted((-sum(a * b for a, b in zip(asked, v)), i) for i, vs in kept.items() if i != q for v in vs)[:k]
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(score)}
    return out


@pytest.mark.parametrize("parts", [1, 3])
@pytest.mark.parametrize("n", [0, 1, 4, 700])
def test_against_brute_force(spark, n, parts, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 16)
    rnd = random.Random(n)
    centres = [[rnd.gauss(0, 1) for _ in range(8)] for _ in range(5)]
    rows = [(i, [c + rnd.gauss(0, 0.1) for c in rnd.choice(centres)]) for i in range(n)]
    if n > 100:
        rows[3] = (3, None)
        rows[50] = (50, [float("nan")] * 8)
        rows[51] = (51, [None] * 8)
        rows[52] = (52, [float("inf")] * 8)
        rows[53] = (53, [])
        rows[54] = (None, [1.0] * 8)
        rows[100] = (100, [0.0] * 8)  # all scores tie
        rows += [rows[10], (0, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in topk.top_k(df, df.where("vec_id % 50 = 0"), 5, parts).collect()]
    want = brute([tuple(r) for r in df.collect()])
    assert sorted(got) == sorted(want)
    if parts > 1:  # without bounds of parts
        monkeypatch.setattr(topk, "ROUTED", 0)
        got = [tuple(r) for r in topk.top_k(df, df.where("vec_id % 50 = 0"), 5, parts).collect()]
        assert sorted(got) == sorted(want)


def test_queries_go_where_they_may_find_something(spark):
    bounds = np.array([0, 3, 4]), np.array([[9.0, 9], [1, 1], [5, -2]]), np.array([[7.0, 7], [-1, -1], [4, -3]])
    asked = spark.createDataFrame([(1, [1, 1], 8), (2, [-1, 0], 0), (3, [1, 1], None), (4, [0, -2], 6), (5, [1], 9)], "query_id long, v array<long>, floor long")
    rows = lambda first: {(r.query_id, r.part) for r in topk.route(asked, bounds, 2, first).collect()}
    assert rows(False) == {(1, 0), (2, 3), (3, 0), (3, 3), (3, 4), (4, 4), (5, 0)}
    assert {(1, 0), (1, 4), (3, 0), (4, 4), (4, 3)} <= rows(True) and len(rows(True)) == 10


def test_part_bounds(spark):
    rows = [(0, [1, 5]), (0, [-2]), (2, [3, 3]), (0, [7, -1])]
    parts, high, low = topk.part_bounds(spark.createDataFrame(rows, "part int, v array<int>"), 2)
    assert parts.tolist() == [0, 2] and high.tolist() == [[7, 5], [3, 3]] and low.tolist() == [[-2, -1], [3, 3]]


def test_most_blocks_of_grouped_vectors_are_ruled_out():
    """Of 40 groups of vectors a query's bounds reach its fifth score in few blocks, and its search visits no others."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((40, 32))
    x = np.floor(256 * (centres[rng.integers(0, 40, 12_000)] + 0.05 * rng.standard_normal((12_000, 32))))
    random_ = np.random.default_rng(7)
    key = topk.order_key(x, random_.standard_normal((47, 32)), random_.standard_normal((16, 32)))
    blocks = topk.Blocks(np.arange(12_000), x, key)
    q = x[::50]
    score = q @ blocks.x.T
    fifth = np.sort(score, axis=1)[:, -6]
    assert (blocks.bounds(q) >= fifth[:, None]).mean() < 0.5
    row, found, best = blocks.search(np.arange(0, 12_000, 50), q, np.full(len(q), -np.inf), 5)
    assert len(row) == 5 * len(q) and (np.sort(best.reshape(-1, 5), axis=1)[:, 0] >= fifth - 1e-9).all()


def test_other_columns_are_ignored(spark):
    rows = [(i, [float(i % 7), 1.0, -float(i % 3)]) for i in range(120)]
    plain = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    names = ["v", "key", "part", "id", "floor", "side", "salt", "query_id", "score", "a.b"]
    df = spark.createDataFrame([(*r, *names) for r in rows], "vec_id long, embedding array<float>, " + ", ".join(f"`{n}` string" for n in names))
    got = topk.top_k(df, df.where("vec_id % 50 = 0"), 5)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows)) == sorted(map(tuple, topk.top_k(plain, plain.where("vec_id % 50 = 0"), 5).collect()))
