"""Structured Streaming over event tables: all that is there is read once, in micro-batches, into a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.sources.tables import delete, shared_folder


STORE = "spark.sql.streaming.stateStore.providerClass"


def drain(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """Runs a stream over what is available now; the rows that it appended. Its state goes at once, its rows with
    sources.tables.clear() or the end of the process."""
    folder, before = shared_folder(spark), spark.conf.get(STORE, None)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)
    delete(spark, f"{folder}/state")
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def timed(events: DataFrame, delay: str) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def tumbling_counts(events: DataFrame, size: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Events by window and type. Windows that the watermark hasn't passed at the end are not emitted."""
    return timed(events, delay).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


def first_seen(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """One row for each event_id, whichever comes first within the watermark."""
    return timed(events, delay).dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "user_id", "event_type")


def click_to_purchase(clicks: DataFrame, purchases: DataFrame, within: str = "1 hour") -> DataFrame:
    """Each purchase with the user's clicks at most so long before."""
    a = timed(clicks.where("event_type = 'click'"), "2 hours").select(F.col("user_id"), F.col("event_id").alias("click_id"), F.col("ts").alias("clicked"))
    b = timed(purchases.where("event_type = 'purchase'"), "2 hours").select(F.col("user_id").alias("buyer"), F.col("event_id").alias("purchase_id"), F.col("ts").alias("bought"))
    return a.join(b, F.expr(f"user_id = buyer and bought >= clicked and bought <= clicked + interval {within}")).select("user_id", "click_id", "purchase_id")
