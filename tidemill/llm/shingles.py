"""Word shingles, which of them are common, and arrays of linked members: what the near-copy operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: One of so many documents is looked at for shingles that are common, and in how many of those one must stand.
SAMPLED, COMMON = 32, 4
#: Common shingles that are known to all tasks, 8 bytes each.
KNOWN = 200_000


class Forest:
    """Linked members; find is by arrays, label[i] the least member that i is linked to."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.partner = np.full(n, n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Hooks larger roots below smaller ones until every pair has one root."""
        parent = self.label
        np.minimum.at(self.partner, a, b)
        np.minimum.at(self.partner, b, a)
        while len(a):
            x, y = parent[a], parent[b]
            open_ = x != y
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
            while len(x):
                up = parent[parent]
                if (up == parent).all():
                    break
                parent[:] = up


def expand(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of count[i] from first[i] on: i and place of each element."""
    owner = np.repeat(np.arange(len(first)), count)
    return owner, first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Hashes of the distinct word shingles, ascending; of a shorter text the one of all its words."""
    words = words_of(text)
    flat = b" ".join(words)
    stop = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(flat)], "<u8")
    start = np.r_[0, stop[:-1] + 1][: len(words) - size + 1].tolist()
    return np.unique(np.array([xxhash.xxh64_intdigest(flat[a:b]) for a, b in zip(start, stop[size - 1 :].tolist())], "<u8"))


def common_shingles(docs: DataFrame, size: int) -> np.ndarray:
    """Shingles of many documents, ascending. They only set the order in which leading shingles are taken, so a sample is enough."""

    def run(batches):
        for b in batches:
            for t in b.column("text"):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t.as_py(), size).view(np.int64))], names=["h"])

    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLED)) == 0).select("text").mapInArrow(run, "h long")
    found = some.groupBy("h").count().where(F.col("count") >= COMMON).orderBy(F.desc("count"), "h").limit(KNOWN).select("h")
    return np.sort(found.toArrow().column("h").to_numpy().view(np.uint64))
