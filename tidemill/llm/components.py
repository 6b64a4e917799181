"""Connected components of an edge table, by large-star and small-star steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import Scratch
from tidemill.llm.shingles import Forest

#: Edges that a task brings together at a time.
AT_ONCE = 1 << 20


def _least(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with the least neighbour of u. The minimum is aggregated before its shuffle and joined back; where
    it can't be broadcast, adaptive execution splits the partition of a hub with very many edges, as it may in a join."""
    return edges.join(edges.groupBy("u").agg(F.min("v").alias("m")), "u")


def large_star(edges: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to the least of its neighbours and itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    out = _least(both).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
    return out.where("u <> v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Each node hands itself and its smaller neighbours to the least of these."""
    near = _least(edges)  # here v < u
    out = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def contract(batches):
    """Of so many edges that a task holds at a time, the same components as stars: each node with the least that these
    edges lead to. What is left between the tasks' stars is for the steps above, which need fewer rounds then."""

    def stars(held):
        u, v = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("u", "v"))
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        forest = Forest(len(nodes))
        forest.link(at[: len(u)], at[len(u) :])
        own = np.flatnonzero(forest.label != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[forest.label[own]])], names=["u", "v"])

    held, size = [], 0
    for b in batches:
        held.append(b)
        size += len(b)
        if size >= AT_ONCE:
            yield stars(held)
            held, size = [], 0
    if size:
        yield stars(held)


def _state(edges: DataFrame) -> tuple:
    """Counts and sums over the whole table, of fixed size: equal for equal tables."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_distinct("v")).first())


def components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """edges: u, v long, in any order, repeats and loops allowed. Returns node, component (the least node reachable)
    for every node with an edge, written in the shared folder as "components"."""
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    now = scratch.write("stars-0", now.mapInArrow(contract, "u long, v long"))
    seen = _state(now)
    for k in range(1, rounds + 1):
        now = scratch.write(f"stars-{k}", small_star(large_star(now)))
        scratch.drop(f"stars-{k - 1}")
        before, seen = seen, _state(now)
        if seen == before:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    out = scratch.write("components", now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots))
    scratch.drop(f"stars-{k}")
    return out
