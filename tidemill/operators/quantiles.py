"""Exact percentiles by place in a range-partitioned sort, so that no group's values meet in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.operators.joins import small
from tidemill.sources.tables import stored


def exact_percentile(df: DataFrame, by: list[str], value: str, share: float, name: str) -> DataFrame:
    """by, name: of each group the value at place share * (n - 1) of its sorted values, between two values in proportion.
    Null values don't count; a group without others has null. A group is one with null keys, too.

    Equal values are counted before the shuffle. The counts are sorted by group and value over all partitions; each
    partition's sums say which one or two of them hold a group's places, and only these are looked through again."""
    counts = df.groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    placed = stored(counts.where("_v is not null").repartitionByRange(*by, "_v").withColumn("_part", F.spark_partition_id()))
    sums = placed.groupBy(*by, "_part").agg(F.sum("_n").alias("_n"))  # a row for each group and partition that has it
    group = Window.partitionBy(*by)
    reach = sums.withColumn("_total", F.sum("_n").over(group)).withColumn("_before", F.sum("_n").over(group.orderBy("_part")) - F.col("_n"))
    reach = reach.withColumn("_at", F.lit(share) * (F.col("_total") - 1)).withColumn("_low", F.floor("_at")).withColumn("_high", F.ceil("_at"))
    reach = reach.where("(_before <= _low and _low < _before + _n) or (_before <= _high and _high < _before + _n)").drop("_n", "_total")
    keys = [F.col(c).eqNullSafe(F.col(f"_key{i}")) for i, c in enumerate(by)]
    reach = reach.select(*[F.col(c).alias(f"_key{i}") for i, c in enumerate(by)], F.col("_part").alias("_own"), "_before", "_at", "_low", "_high")
    near = placed.join(small(reach, 100_000), [*keys, F.col("_part") == F.col("_own")])
    last = F.col("_before") + F.sum("_n").over(Window.partitionBy(*by, "_part").orderBy("_v"))
    near = near.withColumn("_last", last).withColumn("_first", F.col("_last") - F.col("_n"))
    at = lambda place: F.max(F.when((F.col("_first") <= F.col(place)) & (F.col(place) < F.col("_last")), F.col("_v")))
    found = near.groupBy(*by).agg(at("_low").alias("_a"), at("_high").alias("_b"), F.max("_at").alias("_at"))
    part = F.col("_at") - F.floor("_at")
    found = found.select(*[F.col(c).alias(f"_key{i}") for i, c in enumerate(by)], ((F.lit(1) - part) * F.col("_a") + part * F.col("_b")).alias(name))
    return df.select(*by).distinct().join(small(found, 100_000), keys, "left").select(*by, name)
