"""Joins that Spark SQL has no operator for, and a check before broadcasting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def small(df: DataFrame, rows: int) -> DataFrame:
    """df marked for broadcast if it has at most so many rows; else as it is, for Spark to shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def as_of(left: DataFrame, right: DataFrame, by: list[str], on: str, values: list[str], strict: bool = False) -> DataFrame:
    """Each row of left with values (named right_<value>) of the last row of right that has equal `by` and an `on` that
    is not later (earlier, if strict); nulls if there is none. Of rows of right with equal `by` and `on` the one with
    the largest values counts.

    One shuffle by `by` and one sort: both sides stand in one column of events, and the last row of right is carried
    on. A key's rows pass through one task in a stream, never as a group in memory."""
    names = left.columns
    packed = F.struct(*[F.col(v).alias(v) for v in values])
    ours = left.select(*by, F.col(on).alias("_on"), F.struct(*names).alias("_left"), F.lit(None).cast(right.select(packed.alias("p")).schema["p"].dataType).alias("_right"))
    theirs = right.select(*by, F.col(on).alias("_on"), F.lit(None).cast(ours.schema["_left"].dataType).alias("_left"), packed.alias("_right"))
    side = F.col("_left").isNotNull()
    order = [F.col("_on"), side.desc() if strict else side.asc(), F.col("_right")]
    last = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = ours.unionByName(theirs).withColumn("_found", F.last("_right", ignorenulls=True).over(last))
    return both.where(side).select("_left.*", *[F.col(f"_found.{v}").alias(f"right_{v}") for v in values])


def within(left: DataFrame, right: DataFrame, by: list[str], on: str, seconds: int, condition: Column | None = None) -> DataFrame:
    """Pairs with equal `by` whose `on` of right is at most so many seconds after that of left (columns of left as l,
    of right as r). Time is cut into spans of that length, and a row of right looks into its own and the one before,
    so that the join is on equality and a busy key is spread over its spans."""
    span = F.floor(F.unix_timestamp(F.col(on).cast("timestamp")) / seconds)
    a = left.select(F.struct(*left.columns).alias("l"), *by, span.alias("_span"))
    b = right.select(F.struct(*right.columns).alias("r"), *by, F.explode(F.array(span, span - 1)).alias("_span"))
    gap = F.col(f"r.{on}") - F.col(f"l.{on}")
    ok = (gap >= F.expr("interval 0 seconds")) & (gap <= F.expr(f"interval {seconds} seconds"))
    return a.join(b, [*by, "_span"]).where(ok if condition is None else ok & condition).select("l", "r")


def top_per_group(df: DataFrame, by: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group. Spark keeps k rows for each group before the shuffle (WindowGroupLimit)."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)
