"""The corpus pipeline: toxic documents go, repeated lines go, one of each group of near copies stays, repeated
passages go, and the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents. Nulls in any column are kept as they are: a null text
is scored, hashed and packed as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import lines, packing, simhash, suffix, toxicity
from tidemill.llm.common import Scratch, quoted, sweep, table
from tidemill.llm.queries import WORD_BPE


#: Words that a worker of the packing stage remembers: it lives on beside those of other stages, and so does its memory.
CACHED = 100_000
#: Bytes of text whose anchors a task of the passage stage gets, fewer than by default for the same reason.
SHARE = 8 << 20


def counted(docs: DataFrame) -> DataFrame:
    """n_chars as the texts are now."""
    if "n_chars" not in docs.columns:
        return docs
    n = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return docs.select(*[F.coalesce(n, F.col("n_chars")).alias(c) if c == "n_chars" else F.col(quoted(c)) for c in docs.columns])


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.accepted(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return counted(lines.dedup(docs))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.dedup(docs)


def dedup_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix.dedup(docs, share=SHARE)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(spark, docs, WORD_BPE, with_ids=True, cache_entries=CACHED)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", dedup_near),
    ("suffix_array_dedup", dedup_passages),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. The tables that a stage leaves behind go once its result is written."""
    before, docs = {*Scratch.alive}, table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        scratch = Scratch(spark)
        docs = scratch.write(name, stage(spark, docs, sf_dir))
        sweep(before | {*scratch.paths.values()})
    return docs


#: The classifier can't be put in SQL: the stages are held against brute force in the tests.
ORACLE_SQL = None
