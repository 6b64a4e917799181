"""Queries over the supplied tables, each with its SQL for another engine.

The reference shows no operators, so these (prefix fx_) are scope of our own: no claim to match anything.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.functions.dates import fraction, hour_of, money
from tidemill.operators.joins import as_of, small, top_per_group, within
from tidemill.operators.quantiles import exact_percentile
from tidemill.sources.tables import read, read_stream
from tidemill.streaming import events as streams
from tidemill.streaming.sessions import sessions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def rows() -> Column:
    return F.count(F.lit(1))


@query("""SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS sum_price,
    CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS sum_qty, count(*) AS n
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY ALL""")
def fx_pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp_ntz '1998-09-02 00:00:00'")
    return lines.groupBy("l_returnflag", "l_linestatus").agg(F.sum(money("l_extendedprice")).alias("sum_price"), F.sum(money("l_quantity")).alias("sum_qty"), rows().alias("n"))


@query("""SELECT l_orderkey, l_partkey, l_quantity FROM lineitem
    WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24 AND l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01'""")
def fx_filter_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").where("l_discount between 0.05D and 0.07D and l_quantity < 24 and l_shipdate >= timestamp_ntz '1996-01-01' and l_shipdate < timestamp_ntz '1997-01-01'").select("l_orderkey", "l_partkey", "l_quantity")


@query("SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) * 2 + grouping(l_linestatus) AS BIGINT) AS level, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def fx_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.grouping_id().alias("level"), rows().alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderstatus) * 2 + grouping(o_orderpriority) AS BIGINT) AS level, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def fx_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.grouping_id().alias("level"), rows().alias("n"))


@query("SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT date_trunc('day', ts)) AS days FROM events GROUP BY event_type")
def fx_distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.count_distinct(F.date_trunc("day", "ts")).alias("days"))


@query()
def fx_approx_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("users"))


@query("""SELECT l_returnflag, round(quantile_cont(l_quantity, 0.5), 6) AS median, round(quantile_cont(l_extendedprice, 0.9), 6) AS p90 FROM lineitem GROUP BY ALL""")
def fx_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem")
    median = exact_percentile(lines, ["l_returnflag"], "l_quantity", 0.5, "median")
    high = exact_percentile(lines, ["l_returnflag"], "l_extendedprice", 0.9, "p90")
    return median.join(small(high, 10_000), "l_returnflag").select("l_returnflag", F.round("median", 6).alias("median"), F.round("p90", 6).alias("p90"))


@query("""SELECT n_name, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS revenue
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_nationkey = s_nationkey AND r_regionkey < 3 GROUP BY n_name""")
def fx_star_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: read(spark, sf_dir, name)
    nations = small(t("nation").join(t("region").where("r_regionkey < 3"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name"), 10_000)
    suppliers = t("supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_nationkey", "n_name")
    bought = t("orders").join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    sold = t("lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice").join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    return sold.join(bought, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("c_nationkey") == F.col("s_nationkey"))).groupBy("n_name").agg(F.sum(money("l_extendedprice")).alias("revenue"))


@query("SELECT o_orderkey, count(l_orderkey) AS n_lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def fx_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the lines are counted before the shuffle, then joined
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(rows().alias("n_lines"))
    return read(spark, sf_dir, "orders").select("o_orderkey").join(lines, "o_orderkey", "left").select("o_orderkey", F.coalesce("n_lines", F.lit(0).cast("long")).alias("n_lines"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49)")
def fx_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = read(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(large, "o_orderkey", "left_semi")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def fx_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@query("""SELECT c.event_id AS click_id, p.event_id AS purchase_id FROM events c JOIN events p ON c.user_id = p.user_id
    WHERE c.event_type = 'click' AND p.event_type = 'purchase' AND p.ts >= c.ts AND p.ts <= c.ts + INTERVAL 1 HOUR""")
def fx_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    pairs = within(e.where("event_type = 'click'").drop("event_type"), e.where("event_type = 'purchase'").drop("event_type"), ["user_id"], "ts", 3600)
    return pairs.select(F.col("l.event_id").alias("click_id"), F.col("r.event_id").alias("purchase_id"))


@query("""SELECT a.event_id, b.event_id AS right_event_id FROM events a ASOF LEFT JOIN events b ON a.user_id = b.user_id AND a.ts > b.ts""")
def fx_asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return as_of(e, e, ["user_id"], "ts", ["event_id"], strict=True).select("event_id", "right_event_id")


@query("""SELECT * FROM (SELECT o_custkey, o_orderkey, o_totalprice, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders) WHERE rank <= 3""")
def fx_top_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_per_group(read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def fx_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query("""SELECT o_orderkey, CAST(rank() OVER w AS INTEGER) AS place, lag(o_orderkey) OVER w AS before, CAST(ntile(4) OVER w AS INTEGER) AS quarter
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def fx_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return read(spark, sf_dir, "orders").select("o_orderkey", F.rank().over(w).alias("place"), F.lag("o_orderkey").over(w).alias("before"), F.ntile(4).over(w).alias("quarter"))


@query("""SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS last_day FROM events""")
def fx_range_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").selectExpr("event_id", "count(*) over (partition by user_id order by ts range between interval 1 day preceding and current row) as last_day")


@query("SELECT o_orderkey AS orderkey FROM orders INTERSECT ALL SELECT l_orderkey FROM lineitem")
def fx_intersect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("orderkey")).intersectAll(read(spark, sf_dir, "lineitem").select("l_orderkey"))


@query("SELECT l_orderkey AS orderkey FROM lineitem EXCEPT ALL SELECT o_orderkey FROM orders")
def fx_except_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("orderkey")).exceptAll(read(spark, sf_dir, "orders").select("o_orderkey"))


@query("SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier")
def fx_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nationkey")).union(read(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


@query("SELECT event_id, props->>'k' AS k FROM events")
def fx_json_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


TYPES = ["click", "error", "purchase", "signup", "view"]


@query("SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{t}') AS {t}" for t in TYPES) + " FROM events GROUP BY user_id")
def fx_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = read(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", TYPES).agg(rows())
    return wide.select("user_id", *[F.coalesce(t, F.lit(0).cast("long")).alias(t) for t in TYPES])


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total FROM events GROUP BY ALL")
def fx_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy(hour_of("ts").alias("hour"), "event_type").agg(rows().alias("n"), F.sum(money("value")).alias("total"))


@query("""SELECT w AS window_start, count(*) AS n FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS w FROM events) GROUP BY w""")
def fx_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy(F.window("ts", "2 hours", "1 hour")).agg(rows().alias("n")).select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "n")


@query("""SELECT user_id, min(ts) AS session_start, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM
    (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, session""")
def fx_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "6 hours")).agg(rows().alias("n")).select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("session_start"), "n")


@query("SELECT event_type, round(count(*) FILTER (value > 100) / CAST(count(*) AS DOUBLE), 6) AS share FROM events GROUP BY event_type")
def fx_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy("event_type").agg(fraction(F.count_if(F.col("value") > 100), rows().cast("double")).alias("share"))


@query("""SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events
    WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) FROM events) - INTERVAL 10 MINUTE GROUP BY ALL""")
def fx_stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.drain(spark, streams.tumbling_counts(read_stream(spark, sf_dir, "events")))


@query("SELECT event_id, user_id, event_type FROM events")
def fx_stream_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.drain(spark, streams.first_seen(read_stream(spark, sf_dir, "events")))


@query("""SELECT c.user_id, c.event_id AS click_id, p.event_id AS purchase_id FROM events c JOIN events p ON c.user_id = p.user_id
    WHERE c.event_type = 'click' AND p.event_type = 'purchase' AND p.ts >= c.ts AND p.ts <= c.ts + INTERVAL 1 HOUR""")
def fx_stream_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.drain(spark, streams.click_to_purchase(read_stream(spark, sf_dir, "events"), read_stream(spark, sf_dir, "events")))


@query("""WITH s AS (
    SELECT user_id, min(ts) AS session_start, max(ts) AS session_last, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM
    (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, session)
    SELECT * FROM s WHERE epoch_us(session_last + INTERVAL 6 HOUR) <= (SELECT epoch_ms(max(ts)) * 1000 - 86400000000 FROM events)""")
def fx_stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.drain(spark, sessions(read_stream(spark, sf_dir, "events")))
