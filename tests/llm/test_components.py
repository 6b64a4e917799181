"""Components equal those of a plain search, and a task's stars keep them."""

import random

import pyarrow as pa
import pytest

from tidemill.llm import components
from tidemill.llm.common import Scratch


def plain(edges):
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in root}


def graph(kind, rng):
    chain = [(i, i + 1) for i in range(500)]
    return {
        "none": [], "loops": [(3, 3), (4, 4), (4, 5)], "sparse": [(rng.randrange(900), rng.randrange(900)) for _ in range(400)],
        "dense": [(rng.randrange(200), rng.randrange(200)) for _ in range(2000)], "chain": rng.sample(chain, 500), "star": [(0, i) for i in range(1, 800)] + [(i, 10**12 + i) for i in range(1, 800, 2)],
    }[kind]


@pytest.mark.parametrize("kind", ["none", "loops", "sparse", "dense", "chain", "star"])
def test_components(spark, monkeypatch, kind):
    edges = graph(kind, random.Random(2))
    want = {i: c for i, c in plain([e for e in edges if e[0] != e[1]]).items()}
    found = components.components(spark.createDataFrame(edges, "u long, v long").repartition(5), Scratch(spark)).collect()
    assert len(found) == len(want) and {r.node: r.component for r in found} == want
    # of what a task holds, some edges at a time
    monkeypatch.setattr(components, "AT_ONCE", 64)
    batches = [pa.RecordBatch.from_pydict({"u": [a for a, _ in edges[i : i + 40]], "v": [b for _, b in edges[i : i + 40]]}, schema=pa.schema([("u", pa.int64()), ("v", pa.int64())])) for i in range(0, len(edges), 40)]
    stars = [(r["u"], r["v"]) for b in components.contract(iter(batches)) for r in b.to_pylist()]
    assert plain(stars) == want and all(u > v for u, v in stars) and len(stars) <= max(1, len(edges))
