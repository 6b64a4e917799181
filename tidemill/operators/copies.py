"""Exact copies of texts: which are there, and one of each.

Texts are compared by their SHA-256. Counts and smallest ids are taken before the shuffle, so of a text that a third of all
rows hold each task sends one row. The rows to keep are then named by hash and id together, which spreads even those over
all tasks; texts are not shuffled where the rows to drop are few enough to be sent to all executors.

Null texts are copies of each other, and not of empty ones. Null ids come after all others. Of rows with equal id and text one is
kept: the one whose columns sort first as JSON. Very long texts are hashed whole. An empty table gives nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.operators.joins import small
from tidemill.sources.tables import stored

#: Rows up to which those to drop are sent to all executors; 50 bytes each.
SENT = 500_000


def text_hash(text: Column) -> Column:
    """32 bytes; of a null text none."""
    return F.coalesce(F.unhex(F.sha2(text.cast("binary"), 256)), F.lit(b""))


def _own(last: str = "doc_id") -> Column:
    return F.struct(F.col(last).isNull().alias("last"), F.col(last).alias("doc_id"))


def copies(docs: DataFrame) -> DataFrame:
    """doc_id, n_copies: for each distinct text its smallest id and the number of its rows."""
    found = docs.groupBy(text_hash(F.col("text")).alias("hash")).agg(F.min(_own()).alias("first"), F.count(F.lit(1)).alias("n_copies"))
    return found.select("first.doc_id", "n_copies")


def first_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each distinct text: that of the smallest id. All columns are kept, whatever their names."""
    # the row's own columns stay in a struct, so that no name of theirs meets one of ours
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), text_hash(F.col("text")).alias("hash"))
    keys = stored(rows.groupBy("hash", "id").agg(F.count(F.lit(1)).alias("n")))
    first = keys.groupBy("hash").agg(F.min(_own("id")).alias("first"), F.count(F.lit(1)).alias("ids"))
    drop = stored(keys.join(small(first.where("ids > 1").drop("ids"), SENT), "hash").where(~F.col("id").eqNullSafe(F.col("first.doc_id"))).select("hash", "id"))
    again = stored(keys.where("n > 1").select("hash", "id"))

    def named(table: DataFrame) -> DataFrame:
        return small(table, SENT).toDF("_hash", "_id")

    same = (F.col("hash") == F.col("_hash")) & F.col("id").eqNullSafe(F.col("_id"))
    out = rows.join(named(drop), same, "left_anti")
    if again.limit(1).count():
        several = out.join(named(again), same, "left_semi").groupBy("hash", "id").agg(F.min_by("row", F.to_json("row")).alias("row"))
        out = out.join(named(again), same, "left_anti").select("row").unionByName(several.select("row"))
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns])
