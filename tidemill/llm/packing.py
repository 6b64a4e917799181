"""Packing token sequences by power-of-two decomposition.

Each document is cut into pieces whose lengths are powers of two, the largest of them the context length; each piece
is a sequence of its own, and sequences of equal length share a bucket. So no sequence crosses documents, and none is
padded. Sequences are numbered by bucket, longest first, and in a bucket by task and place. Each task counts its own
pieces of each length; the numbers follow from a sum over these counts, so pieces need no shuffle.

A null or empty text gives one piece that holds only the closing id. Rows with equal doc_id and text give equal pieces
with different sequence ids. Extra columns are ignored. A very long text is encoded whole and needs memory for its ids.
An empty table gives no piece.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.llm import bpe
from tidemill.llm.common import Scratch, trim

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, place long"
#: Texts that are encoded at a time.
AT_ONCE = 500
#: Counts, one for each task and length, up to which they are sent to all executors; beyond, they are shuffled.
SENT = 1_000_000


def lengths(n: int, longest: int) -> list[int]:
    """n as a sum of powers of two, descending, of which only longest repeats."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in reversed(range(longest.bit_length() - 1)) if rest >> b & 1]


def pieces(df: DataFrame, path: str, longest: int = 2048, end_id: int = 1, with_ids: bool = False, cache_entries: int = 400_000) -> DataFrame:
    """The pieces of every document's ids with end_id after them; ids array<int> too if with_ids. place: how many
    pieces of its length the task (part) has before."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    end = end_id.to_bytes(4, "little")

    def run(batches):
        tok = bpe.load(path, cache_entries)
        part, before = TaskContext.get().partitionId(), {}
        for b in batches:
            for i in range(0, len(b), AT_ONCE):
                texts = b.slice(i, AT_ONCE)
                rows = []
                for doc, x in zip(texts.column("doc_id").to_pylist(), tok.encode([t or "" for t in texts.column("text").to_pylist()])):
                    x += end
                    n, at = len(x) // 4, 0
                    for k in lengths(n, longest):
                        own = x[4 * at : 4 * (at + k)]
                        place = before.get(k, 0)
                        before[k] = place + 1
                        rows.append((doc, at, k, zlib.crc32(own), n, part, place, own))
                        at += k
                columns = [*zip(*rows)] or [[]] * 8
                arrays = [pa.array(c, pa.int32() if k == 5 else pa.int64()) for k, c in enumerate(columns[:7])]
                names = [x.split(" ")[0] for x in PIECE.split(", ")]
                if with_ids:
                    flat = pa.Array.from_buffers(pa.int32(), sum(columns[2]), [None, pa.py_buffer(b"".join(columns[7]))])
                    stops = [0]
                    for k in columns[2]:
                        stops.append(stops[-1] + k)
                    arrays.append(pa.ListArray.from_arrays(pa.array(stops, pa.int32()), flat))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)
        trim()

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECE + ", ids array<int>" * with_ids)


def number(cut: DataFrame) -> DataFrame:
    """Adds sequence_id (dense from 0) and offset, always 0. cut: written pieces."""
    counts = cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))  # a row for each task and length
    so_far = F.sum("n").over(Window.orderBy(F.desc("length"), "part").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    first = counts.select("part", "length", (so_far - F.col("n")).alias("first"))
    first = F.broadcast(first) if counts.count() <= SENT else first
    return cut.join(first, ["part", "length"]).withColumn("sequence_id", F.col("first") + F.col("place")).withColumn("offset", F.lit(0).cast("long")).drop("part", "place", "first")


def pack(spark: SparkSession, df: DataFrame, path: str, longest: int = 2048, end_id: int = 1, with_ids: bool = False, cache_entries: int = 400_000) -> DataFrame:
    """cache_entries: words that a Python worker remembers; fewer take less memory and more time."""
    cut = Scratch(spark).write("pieces", pieces(df, path, longest, end_id, with_ids, cache_entries))
    out = number(cut)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids, "sequence_id", "offset"]
    return out.select(*names)
