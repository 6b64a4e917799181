"""Exact top-k search by inner product, with block-at-a-time pruning.

A vector's terms are its components. Candidates are put into blocks, ranges of an order that brings like vectors
together; each block has its terms' maxima and minima and a forward index, the integer components of its vectors. A
query's bound for a block is the sum over terms of its weight times the block's maximum, or the minimum where the
weight is negative. Blocks next to each other in the order form a part, which a task holds and which has bounds of the
same kind. A first round sends each query to the few parts with its best bounds, where some blocks give it a kth score to
start from; the second sends it only to parts whose bound reaches that. There it visits blocks by falling bound and stops
when the bound is below its kth best score so far.

Components: floor(256 * x), x as double. Vectors that are null or empty, or hold null or non-finite components, take no part, nor do
rows without id. Vectors of different lengths are padded with zeros. Ties go to the smaller id; a query never finds
its own id. Fewer than k candidates: all. Repeated rows are candidates of their own; of several rows with a query's id
the one whose vector sorts first is asked. Components too large for exact sums in doubles raise an error. Columns other
than vec_id and embedding are ignored, whatever their names. An empty table gives nothing.

Where vectors come in groups, bounds rule most blocks out. Where they are spread evenly over many dimensions, no box around
some of them is small, and nearly all blocks are scored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import Scratch

BLOCK = 256
#: Queries that a task scores at a time.
QUERIES = 512
#: Parts that a query goes to in the first round, and blocks that it visits there.
FIRST, VISITS = 2, 8
#: Bytes of the parts' bounds up to which they are given to the tasks; beyond, each part gets all queries.
ROUTED = 64 << 20
#: Rows of queries and parts that a task makes at a time.
ROUTES = 16_384
FOUND = "query_id long, vec_id long, score long"


def quantized(vectors: DataFrame) -> DataFrame:
    """vec_id, v array<long> of the vectors that take part."""
    x = F.col("v").cast("array<double>")
    ok = F.col("vec_id").isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & (F.abs(c) < F.lit(float("inf"))))
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    return v.where(ok).select("vec_id", F.transform(x, lambda c: F.floor(c * 256)).alias("v"))


def matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    """Rows of integer arrays, zeros after the shorter ones."""
    flat, stop = column.flatten().to_numpy(), np.asarray(column.offsets)
    size = np.diff(stop)
    out = np.zeros((len(column), width), kind)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(stop[:-1] - stop[0], size)] = flat
    return out


def order_key(x: np.ndarray, rays: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Like vectors get like keys: the nearest ray, then the side of each plane."""
    return (np.argmax(x @ rays.T, axis=1) << len(planes)) + (x @ planes.T > 0) @ (1 << np.arange(len(planes)))


class Blocks:
    """Blocks of a task: ids and forward index in the order of the blocks, and their bounds."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, key: np.ndarray):
        order = np.lexsort((ids, key))
        self.ids, self.x = ids[order], x[order]
        self.start = np.arange(0, len(ids), BLOCK)
        self.high = np.maximum.reduceat(self.x, self.start, axis=0)
        self.low = np.minimum.reduceat(self.x, self.start, axis=0)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        return np.maximum(q, 0) @ self.high.T + np.minimum(q, 0) @ self.low.T

    def search(self, qid: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int, visits: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each query's k best, as query place, id and score. floor: scores that its kth is known to reach. visits:
        at most so many blocks."""
        bound = self.bounds(q)
        order = np.argsort(-bound, axis=1, kind="stable")
        n = len(q)
        best = np.full((n, k), -np.inf)
        best_id = np.full((n, k), np.iinfo(np.int64).max)
        for step in range(min(len(self.start), visits or len(self.start))):
            block = order[:, step]
            open_ = bound[np.arange(n), block] >= np.maximum(best[:, -1], floor)
            if not open_.any():
                break
            for b in np.unique(block[open_]):
                own = np.flatnonzero(open_ & (block == b))
                part = slice(self.start[b], self.start[b] + BLOCK)
                ids, score = self.ids[part], q[own] @ self.x[part].T
                score[qid[own][:, None] == ids] = -np.inf
                score[score < floor[own][:, None]] = -np.inf
                both = np.concatenate([best[own], score], axis=1)
                named = np.concatenate([best_id[own], np.broadcast_to(ids, score.shape)], axis=1)
                top = np.lexsort((named, -both), axis=1)[:, :k]
                best[own], best_id[own] = np.take_along_axis(both, top, 1), np.take_along_axis(named, top, 1)
        row, col = np.nonzero(np.isfinite(best))
        return row, best_id[row, col], best[row, col].astype(np.int64)


def part_bounds(keyed: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the parts, and the maxima and minima of their terms. To the driver come a few rows for each part."""

    def run(batches):
        high, low = {}, {}
        for b in batches:
            part, x = b.column("part").to_numpy(), matrix(b.column("v"), width, np.int64)
            for p in np.unique(part).tolist():
                own = x[part == p]
                high[p] = np.maximum(high[p], own.max(0)) if p in high else own.max(0)
                low[p] = np.minimum(low[p], own.min(0)) if p in low else own.min(0)
        yield pa.RecordBatch.from_arrays([pa.array([*high], pa.int32()), pa.array([*high.values()], pa.list_(pa.int64())), pa.array([*low.values()], pa.list_(pa.int64()))], names=["part", "high", "low"])

    rows = keyed.select("part", "v").mapInArrow(run, "part int, high array<long>, low array<long>").collect()
    parts = np.array(sorted({r.part for r in rows}), np.int64)
    high = np.full((len(parts), width), -np.inf)
    low = np.full((len(parts), width), np.inf)
    for r in rows:
        i = np.searchsorted(parts, r.part)
        high[i], low[i] = np.maximum(high[i], r.high), np.minimum(low[i], r.low)
    return parts, high, low


def route(asked: DataFrame, bounds: tuple[np.ndarray, np.ndarray, np.ndarray], width: int, first: bool) -> DataFrame:
    """asked (query_id, v, floor), once for each part that it goes to: in the first round the few with the best bounds,
    later all whose bound reaches the floor (null: all)."""
    parts, high, low = bounds

    def run(batches):
        for whole in batches:
            for i in range(0, len(whole), n := max(1, ROUTES // max(1, len(parts)))):
                b = whole.slice(i, n)
                q = matrix(b.column("v"), width, np.float64)
                bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
                if first:
                    floor = np.sort(bound, axis=1)[:, -min(FIRST, len(parts)) :][:, :1]
                else:
                    floor = np.array([-np.inf if f is None else f for f in b.column("floor").to_pylist()], np.float64)[:, None]
                row, col = np.nonzero(bound >= floor)
                kept = pa.Table.from_batches([b]).take(pa.array(row)).append_column("part", pa.array(parts[col], pa.int32()))
                yield from kept.combine_chunks().to_batches()

    return asked.select("query_id", "v", "floor").mapInArrow(run, "query_id long, v array<long>, floor long, part int")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, parts: int | None = None, group: int = 400_000, seed: int = 7) -> DataFrame:
    """queries: rows of vectors' form. Returns query_id, rank (from 1), vec_id, score.

    The candidates are cut into parts of about `group` vectors, which lie in a task's memory, by their order; within
    vectors of one key by a hash of the id. Each part gets those queries, in a stream, whose bound for it is high enough."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    every = scratch.write("vectors", quantized(vectors))
    asked = scratch.write("queries", quantized(queries).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v")))
    n, width, largest = every.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v"))))).first()
    width = max(width or 1, asked.agg(F.max(F.size("v"))).first()[0] or 1)
    if (reach := (largest or 0) ** 2 * width) >= 1 << 53:
        raise ValueError("scores would not be exact in doubles")
    kind = np.float32 if reach < 1 << 24 else np.float64
    # parts that fill a task; for fewer vectors, one for each core as long as they are worth a task
    parts = parts or max(1, -(-n // group), min(spark.sparkContext.defaultParallelism, n // 8192))
    random = np.random.default_rng(seed)
    rays, planes = random.standard_normal((min(256, 1 + n // BLOCK), width)), random.standard_normal((16, width))

    def key(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(order_key(matrix(b.column("v"), width, np.float64), rays, planes))], names=["vec_id", "v", "key"])

    keyed = scratch.write("keyed", every.mapInArrow(key, "vec_id long, v array<long>, key long").select(F.col("vec_id").alias("id"), F.col("v").cast("array<int>").alias("v") if (largest or 0) < 1 << 31 else "v", "key", F.xxhash64("vec_id").alias("salt")).repartitionByRange(parts, "key", "salt").select("id", "v", "key", F.spark_partition_id().alias("part")))
    bounds = part_bounds(keyed, width) if 1 < parts <= ROUTED // (16 * width) else None
    candidates = keyed.select("part", "id", "v", "key", F.lit(None).cast("long").alias("floor"), F.lit(0).alias("side"))

    def scan(visits):
        def run(batches):
            held: dict[int, list] = {}
            blocks: dict[int, Blocks | None] = {}
            for b in batches:  # by part, its candidates before the queries
                part, side = b.column("part").to_numpy(), b.column("side").to_numpy()
                cut = np.flatnonzero(np.r_[True, (np.diff(part) != 0) | (np.diff(side) != 0), True])
                for a, z in zip(cut, cut[1:]):
                    piece = b.slice(a, z - a)
                    p = int(part[a])
                    ids, x = piece.column("id").to_numpy(), matrix(piece.column("v"), width, kind)
                    if side[a] == 0:
                        held.setdefault(p, []).append((ids, x, piece.column("key").to_numpy()))
                        continue
                    if p not in blocks:
                        blocks.clear()
                        mine = held.pop(p, None)
                        held.clear()
                        blocks[p] = Blocks(*map(np.concatenate, zip(*mine))) if mine else None
                    if blocks[p] is None:
                        continue
                    floor = np.array([-np.inf if f is None else f for f in piece.column("floor").to_pylist()], np.float64)
                    for i in range(0, len(ids), QUERIES):
                        own = slice(i, i + QUERIES)
                        row, found, score = blocks[p].search(ids[own], x[own], floor[own], k, visits)
                        yield pa.RecordBatch.from_arrays([pa.array(ids[own][row]), pa.array(found), pa.array(score)], names=["query_id", "vec_id", "score"])

        return run

    def round_(asked: DataFrame, visits: int | None) -> DataFrame:
        if bounds:
            each = route(asked, bounds, width, visits is not None)
        else:
            each = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))  # the stated queries against all rows, by part
        rows = candidates.unionByName(each.select("part", F.col("query_id").alias("id"), F.col("v").cast(keyed.schema["v"].dataType).alias("v"), F.lit(None).cast("long").alias("key"), "floor", F.lit(1).alias("side")))
        return rows.repartition(parts, "part").sortWithinPartitions("part", "side", "id").mapInArrow(scan(visits), FOUND)

    def best(found: DataFrame) -> DataFrame:
        """The k best of each query, from the k best of each part."""
        top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k)
        return found.groupBy("query_id").agg(top.alias("top"))

    if parts > 1:
        first = best(round_(asked.withColumn("floor", F.lit(None).cast("long")), VISITS))
        floor = first.where(F.size("top") == k).select("query_id", (-F.element_at("top", -1)["s"]).alias("floor"))
        asked = scratch.write("asked", asked.join(floor.dropDuplicates(["query_id"]), "query_id", "left"))
    else:
        asked = asked.withColumn("floor", F.lit(None).cast("long"))
    out = best(round_(asked, None)).select("query_id", F.posexplode("top").alias("at", "hit"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.s")).alias("score"))
