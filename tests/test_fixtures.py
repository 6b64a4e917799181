"""Every fixture query that has SQL gives that SQL's rows; joins and streams hold in cases the tables don't have."""

import datetime
import os
import time

import duckdb
import pytest

from tidemill.operators.joins import as_of, small, within
from tidemill.plans import corpora, fixtures  # noqa: F401 (corpora adds its queries to those of fixtures)
from tidemill.sources.tables import shared_folder
from tidemill.streaming import events

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def values(rows):
    return sorted(repr(tuple(float(x) if hasattr(x, "as_tuple") else x for x in r)) for r in rows)


@pytest.mark.parametrize("name", fixtures.QUERIES)
def test_query(spark, duck, name):
    df = fixtures.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = df.select(*names).collect()
    if name in fixtures.ORACLE:
        want = duck.sql(f"SELECT {', '.join(names)} FROM ({fixtures.ORACLE[name]})").fetchall()
        assert values(map(tuple, got)) == values(want)
    else:
        assert got


def at(minute):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)


def test_as_of(spark):
    left = spark.createDataFrame([("a", at(1), 1), ("a", at(5), 2), ("b", at(5), 3), (None, at(5), 4)], "k string, t timestamp, right_v int")
    right = spark.createDataFrame([("a", at(1), 10), ("a", at(1), 11), ("a", at(5), 12), ("c", at(0), 13)], "k string, t timestamp, v int")
    left = left.withColumnRenamed("right_v", "n")
    got = lambda strict: {r.n: r.right_v for r in as_of(left, right, ["k"], "t", ["v"], strict).collect()}
    assert got(False) == {1: 11, 2: 12, 3: None, 4: None}
    assert got(True) == {1: None, 2: 11, 3: None, 4: None}


def test_within(spark):
    df = spark.createDataFrame([("a", at(0), 0), ("a", at(59), 1), ("a", at(60), 2), ("a", at(121), 3), ("b", at(1), 4)], "k string, t timestamp, n int")
    got = {(r.l.n, r.r.n) for r in within(df, df, ["k"], "t", 3600).collect()}
    assert got == {(i, i) for i in range(5)} | {(0, 1), (0, 2), (1, 2)}


def test_small(spark):
    plan = lambda df: df._jdf.queryExecution().analyzed().toString().lower()
    assert "resolvedhint" in plan(small(spark.range(5), 5)) and "resolvedhint" not in plan(small(spark.range(6), 5))


def test_approx_distinct_is_near(spark):
    """Within three times the relative error that was asked for."""
    exact = {r.event_type: r.users for r in fixtures.QUERIES["fx_distinct_counts"](spark, SF).collect()}
    got = {r.event_type: r.users for r in fixtures.QUERIES["fx_approx_distinct"](spark, SF).collect()}
    assert got.keys() == exact.keys() and all(abs(got[t] - n) <= 0.06 * n for t, n in exact.items())


def test_late_events_are_dropped_by_the_watermark(spark):
    folder = shared_folder(spark)
    schema = "event_id long, ts timestamp, user_id long, event_type string"
    for i, minutes in enumerate([[0, 10, 200], [300], [5, 400], [600]]):  # 5 comes when the watermark has passed its window
        spark.createDataFrame([(100 * i + m, at(m), 1, "view") for m in minutes], schema).coalesce(1).write.parquet(f"{folder}/{i}")
        time.sleep(1.1)  # a stream takes files by the second of their writing
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    got = {r.window_start: r.n for r in events.drain(spark, events.tumbling_counts(stream)).collect()}
    assert got == {at(0): 2, at(180): 1, at(300): 1, at(360): 1}
