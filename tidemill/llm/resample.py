"""Importance resampling towards a target, with weights by bit-sliced aggregation.

Features of a text are all runs of 1 to `grams` consecutive words, joined by one space, repeats counted; words are runs of
digits, letters a-z (A-Z lower-cased) and anything beyond ASCII. A feature's bucket is its CRC-32 modulo the number of
buckets. A bucket's gain says how much likelier it is in the target than in the documents, in thousandths of a nat.

Weights: the counts of a text's buckets are written as planes of one bit for each bucket: plane j holds bit j of every
count. The gains are planes too, in two's complement, so the last one counts negatively. The sum of count times gain over
all buckets is then the sum, over all pairs of planes, of a power of two times the number of bits that both have: AND,
popcount and shifts, all exact.

Draw: to the weight comes noise that the seed and doc_id fix (Gumbel, so the highest scores are a sample without
replacement in proportion to the weights). Ranks are places in one range-partitioned sort of narrow rows; no task and no
driver sees them all.

Null texts have no features; a null doc_id takes the noise of the empty id and comes before other ids among equal scores. Repeated
rows have equal scores and each a rank of its own. Very long texts are taken whole. An empty table gives nothing; with an
empty target all its counts are zero. Columns other than doc_id and text are ignored by report() and kept by sample(),
whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import Scratch, trim
from tidemill.llm.lines import text_key

#: Bytes as they stand in words; all others become blanks.
WORD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Features of the texts whose planes are made at a time, and their number at most.
AT_ONCE, TEXTS = 1 << 20, 256


def features(text: str | None, grams: int, buckets: int) -> np.ndarray:
    """The bucket of each feature."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(WORD).split()
    found = np.fromiter(map(crc32, words), np.int64, len(words))
    for size in range(2, grams + 1):
        flat = b" ".join(words)
        stop = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        start = np.r_[0, stop[:-1] + 1][: max(0, len(words) - size + 1)].tolist()
        longer = [crc32(flat[a:b]) for a, b in zip(start, stop[size - 1 :].tolist())]
        found = np.concatenate([found, np.array(longer, np.int64)])
    return found % buckets


def bucket_counts(texts: DataFrame, grams: int, buckets: int) -> np.ndarray:
    """How many features of all texts each bucket has. Tasks send one row for each bucket; `buckets` rows come back."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for t in b.column("text"):
                total += np.bincount(features(t.as_py(), grams, buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    rows = texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(buckets, np.int64)
    total[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return total


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(p / q)) of each bucket, with one added to each count, in doubles."""
    n = len(own)
    s, t = float(own.sum() + n), float(target.sum() + n)
    return np.array([math.floor(1000 * math.log((b + 1.0) * s / ((a + 1.0) * t))) for a, b in zip(own.tolist(), target.tolist())], np.int64)


def gain_planes(gain: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Bit planes of the gains in two's complement, 64 buckets to a number, and what a bit of each is worth."""
    bits = max(int(np.abs(gain).max(initial=0)).bit_length(), 1) + 1
    packed = []
    for k in range(bits):
        row = np.zeros(-(-len(gain) // 64) * 64, np.uint8)
        row[: len(gain)] = (gain >> k) & 1
        packed.append(np.packbits(row, bitorder="little").view("<u8"))
    return np.array(packed), [*(1 << k for k in range(bits - 1)), -(1 << (bits - 1))]


def count_planes(found: list[np.ndarray], width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For bit j of the counts: j, the texts that have such bits, and their planes (rows of `width` numbers)."""
    owner = np.repeat(np.arange(len(found)), [len(x) for x in found])
    cell, times = np.unique(owner * (width * 64) + np.concatenate(found), return_counts=True)
    j = 0
    while len(cell):
        bit = cell[times & 1 == 1]
        if len(bit):
            place = bit >> 6
            first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
            texts, row = np.unique(place[first] // width, return_inverse=True)
            plane = np.zeros((len(texts), width), np.uint64)
            plane[row, place[first] % width] = np.bitwise_or.reduceat(np.uint64(1) << (bit & 63).astype(np.uint64), first)
            yield j, texts, plane
        times = times >> 1
        cell, times, j = cell[times > 0], times[times > 0], j + 1


def weigh(found: list[np.ndarray], planes: np.ndarray, worth: list[int]) -> np.ndarray:
    """The sum of the gains of each text's features."""
    out = np.zeros(len(found), np.int64)
    for j, texts, plane in count_planes(found, planes.shape[1]):
        for gain, w in zip(planes, worth):
            out[texts] += (w << j) * np.bitwise_count(plane & gain).sum(1, dtype=np.int64)
    return out


def noise(doc_id: int | None, seed: int) -> int:
    """Of the Gumbel distribution, in thousandths, rounded down."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(texts: DataFrame, gain: np.ndarray, grams: int, seed: int) -> DataFrame:
    """doc_id, key, n_features, weight, score of texts: doc_id, text, key."""
    buckets = len(gain)
    planes, worth = gain_planes(gain)
    def lots(column: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
        """Texts in a row, so many features or texts at a time: their first place and their features."""
        at, lot, size = 0, [], 0
        for i, t in enumerate(column):
            lot.append(features(t.as_py(), grams, buckets))
            size += len(lot[-1])
            if size >= AT_ONCE or len(lot) == TEXTS:
                yield at, lot
                at, lot, size = i + 1, [], 0
        if lot:
            yield at, lot

    def run(batches):
        for b in batches:
            for at, lot in lots(b.column("text")):
                part = b.slice(at, len(lot))
                n = np.fromiter(map(len, lot), np.int64, len(lot))
                weight = weigh(lot, planes, worth)
                score = weight + np.fromiter((noise(i, seed) for i in part.column("doc_id").to_pylist()), np.int64, len(lot))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), pa.array(n), pa.array(weight), pa.array(score)], names=["doc_id", "key", "n_features", "weight", "score"])
        trim()

    return texts.select("doc_id", "text", "key").mapInArrow(run, "doc_id long, key binary, n_features long, weight long, score long")


def ranked(docs: DataFrame, target: DataFrame, scratch: Scratch, percent: int, grams: int, buckets: int, seed: int, least: int) -> DataFrame:
    """doc_id, key (of the text), n_features, weight, score and rank of every row."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key(F.col("text")).alias("key"))
    gain = gains(bucket_counts(texts, grams, buckets), bucket_counts(target, grams, buckets))
    every = scratch.write("scored", scored(texts, gain, grams, seed))
    order = [F.desc("score"), F.asc_nulls_first("doc_id")]
    place = every.where(F.col("n_features") >= least).repartitionByRange(*order).sortWithinPartitions(*order)
    # the upper bits of the id are the partition, the lower 33 the place in it
    place = scratch.write("placed", place.withColumn("at", F.monotonically_increasing_id()))
    part, inner = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    before, total = [], 0
    for r in place.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():  # a row for each partition
        before.append((r.part, total))
        total += r.n
    starts = F.broadcast(docs.sparkSession.createDataFrame(before, "part long, before long"))
    rank = F.col("before") + inner + 1
    place = place.withColumn("part", part).join(starts, "part").withColumn("rank", F.when(rank <= percent * total // 100, rank))
    return place.drop("part", "before", "at").unionByName(every.where(F.col("n_features") < least).withColumn("rank", F.lit(None).cast("long")))


def report(docs: DataFrame, target: DataFrame, percent: int = 10, grams: int = 1, buckets: int = 10_000, seed: int = 2024, least: int = 20) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of docs: rank is 1, 2, ... for the highest scores among the
    rows of at least `least` words, `percent` of them (rounded down), ties to the smaller doc_id; else null. target: text."""
    return ranked(docs, target, Scratch(docs.sparkSession), percent, grams, buckets, seed, least).select("doc_id", "n_features", "weight", "score", "rank")


def sample(docs: DataFrame, target: DataFrame, percent: int = 10, grams: int = 1, buckets: int = 10_000, seed: int = 2024, least: int = 20) -> DataFrame:
    """The rows of docs that are drawn, with all their columns. Of repeated rows all stay if one is drawn."""
    drawn = ranked(docs, target, Scratch(docs.sparkSession), percent, grams, buckets, seed, least).where("rank is not null")
    # the row's own columns stay in a struct, so that no name of theirs meets one of ours
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("row_id"), text_key(F.col("text")).alias("row_key"))
    rows = rows.join(drawn.select("doc_id", "key"), (F.col("row_key") == F.col("key")) & F.col("row_id").eqNullSafe(F.col("doc_id")), "left_semi")
    return rows.select(*[F.col("row")[c].alias(c) for c in docs.columns])
