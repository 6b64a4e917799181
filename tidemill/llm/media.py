"""Media columns: payloads stored as lossless WebP pictures, read back as pixel arrays, with features.

A payload's bytes are the red, green, blue and alpha samples of 16 pixels a line. Payloads of up to 256 lines are one
picture, longer ones an animation whose frames are strips of 256 lines of one picture, so that a long one is decoded
in parts side by side. Each strip gets the transform, colour cache and back-references that suit it. See webp.py for
the format.

A null text is an empty payload, which is stored as one line of zeros. Equal texts give equal files and values, so
repeated rows give repeated results. Null doc_ids are kept. A very long text is one file, written and read back in strips
by one task, with memory in proportion to its size. An empty table gives nothing. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm import webp
from tidemill.llm.common import sha

WIDTH, STRIP, LINE = 16, 256, 64
#: Bytes of payload that are read at a time, and that are written at a time.
AT_ONCE, WRITTEN = 16 << 20, 2 << 20


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % LINE if data else LINE)


def store(payloads: list[bytes]) -> list[bytes]:
    """A WebP file of each payload, whose length is a positive multiple of 64."""
    rows, counts = [], []
    for p in payloads:
        n = len(p) // LINE
        counts.append(-(-n // STRIP))
        rows += [STRIP] * (n // STRIP) + [n % STRIP] * (n % STRIP > 0)
    samples, coded = np.frombuffer(b"".join(payloads), np.uint8), []
    stop = np.cumsum(np.r_[0, rows]) * LINE
    cut = [0, *np.flatnonzero(np.diff(stop[:-1] // WRITTEN)) + 1, len(rows)] if rows else [0]
    for a, b in zip(cut, cut[1:]):
        coded += webp.encode_strips(samples[stop[a] : stop[b]], rows[a:b], WIDTH)
    lines, coded = iter(rows), iter(coded)
    return [webp.file_of([(next(lines), next(coded)) for _ in range(n)], WIDTH) for n in counts]


def load(files: list[bytes]) -> list[np.ndarray]:
    """The samples of each file, of shape (lines, pixels, 4): red, green, blue, alpha."""
    return [np.ascontiguousarray(p).view(np.uint8).reshape(*p.shape, 4)[:, :, [2, 1, 0, 3]] for p in webp.pictures(files)]


def features(samples: np.ndarray) -> str:
    """Mean and deviation in thousandths, number of distinct sample values, and a hash of 64 bits: which 64th parts of
    the picture are brighter than the whole."""
    flat = samples.ravel()
    counts = np.bincount(flat, minlength=256)
    level = np.arange(256)
    n, total, squares = len(flat), int(counts @ level), int(counts @ (level * level))
    spread = int(np.sqrt(max(0, n * squares - total * total)) * 1000) // n
    parts = flat.reshape(64, -1).sum(1, dtype=np.int64) * 64 > total
    return f"mean={total * 1000 // n} deviation={spread} values={np.count_nonzero(counts)} hash={np.packbits(parts).tobytes().hex()}"


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def groups(texts: list[str | None]):
    """Runs of padded payloads of about AT_ONCE bytes, with their unpadded sizes."""
    held, sizes, total = [], [], 0
    for t in texts:
        data = (t or "").encode("utf-8", "surrogatepass")
        held.append(padded(data))
        sizes.append(len(data))
        total += len(held[-1])
        if total >= AT_ONCE:
            yield held, sizes
            held, sizes, total = [], [], 0
    if held:
        yield held, sizes


def write(df: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each text as a lossless WebP file."""

    def run(batches):
        for b in batches:
            ids, at = b.column("doc_id"), 0
            for held, sizes in groups(b.column("text").to_pylist()):
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(held)), pa.array(sizes, pa.int64()), pa.array(store(held), pa.binary())], names=["doc_id", "n_bytes", "media"])
                at += len(held)

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read(df: DataFrame) -> DataFrame:
    """doc_id, height, width, samples binary (lines of red, green, blue, alpha) of each row's media; null media: null."""

    def run(batches):
        for b in batches:
            files = b.column("media").to_pylist()
            found = iter(load([f for f in files if f is not None]))
            rows = [(*s.shape[:2], s.tobytes()) if f is not None and (s := next(found)) is not None else (None, None, None) for f in files]
            h, w, s = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(h, pa.int32()), pa.array(w, pa.int32()), pa.array(s, pa.binary())], names=["doc_id", "height", "width", "samples"])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "media").mapInArrow(run, "doc_id long, height int, width int, samples binary")


def digests(df: DataFrame) -> DataFrame:
    """One row for each document, of what is read back from its stored form."""
    names = [x.split(" ")[0] for x in SCHEMA.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches):
        for b in batches:
            ids, at = b.column("doc_id").to_pylist(), 0
            for held, sizes in groups(b.column("text").to_pylist()):
                files = store(held)
                rows = []
                for i, n, f, s in zip(ids[at : at + len(held)], sizes, files, load(files)):
                    data = s.tobytes()
                    rows.append((i, n, len(data), sha(data), zlib.crc32(data[-LINE:]), len(f), sha(f), features(s)))
                at += len(held)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
