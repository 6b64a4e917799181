"""Sessions of a stream equal those of the batch, in whatever order events come; nothing is lost on many files; percentiles."""

import datetime
import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from tidemill.operators.quantiles import exact_percentile
from tidemill.sources import tables
from tidemill.streaming import events
from tidemill.streaming.sessions import Sessions, merged, sessions

START = datetime.datetime(2024, 1, 1)


def test_merged():
    rng = random.Random(1)
    for _ in range(200):
        times = [rng.randrange(200) for _ in range(rng.randrange(1, 20))]
        want = []
        for t in sorted(times):
            if want and t < want[-1][1] + 7:
                want[-1] = [want[-1][0], t, want[-1][2] + 1]
            else:
                want.append([t, t, 1])
        rng.shuffle(times)
        half = merged([[t, t, 1] for t in times[: len(times) // 2]], 7)
        assert merged(half + [[t, t, 1] for t in times[len(times) // 2 :]], 7) == want


def test_sessions_of_a_shuffled_late_stream(spark):
    """Events come up to an hour late, in files that are read one by one; the last ones move the watermark on."""
    rng = random.Random(5)
    said = [(u, START + datetime.timedelta(seconds=rng.randrange(6 * 3600), microseconds=rng.randrange(10**6))) for u in range(4) for _ in range(60)] + [(9, START)] * 3
    came = sorted(said, key=lambda r: r[1] + datetime.timedelta(seconds=rng.randrange(3600)))
    folder = tables.shared_folder(spark)
    lots = [came[i : i + 62] for i in range(0, len(came), 62)] + [[(8, START + datetime.timedelta(days=2)), (None, START), (8, None)]]
    for i, lot in enumerate(lots):
        spark.createDataFrame(lot, "user_id long, ts timestamp_ntz").coalesce(1).write.parquet(f"{folder}/{i}")
        time.sleep(1.1)  # a stream takes files by the second of their writing
    stream = spark.readStream.schema("user_id long, ts timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    got = sorted(map(tuple, events.drain(spark, sessions(stream, 600, "1 hour")).collect()))
    batch = spark.createDataFrame(said, "user_id long, ts timestamp_ntz").groupBy("user_id", F.session_window("ts", "600 seconds"))
    want = batch.agg(F.min("ts").alias("a"), F.max("ts").alias("z"), F.count(F.lit(1)).alias("n")).select("user_id", "a", "z", "n").collect()
    assert got == sorted(map(tuple, want)) and len(got) > 40
    tables.clear()


def test_session_that_ends_at_the_watermark(spark):
    """As in the query's SQL: it ends when the watermark has reached it; one of a microsecond later stays."""
    folder = tables.shared_folder(spark)
    rows = [(1, START), (2, START + datetime.timedelta(microseconds=1)), (3, START + datetime.timedelta(seconds=4200))]
    spark.createDataFrame(rows, "user_id long, ts timestamp_ntz").write.parquet(folder)
    stream = spark.readStream.schema("user_id long, ts timestamp_ntz").parquet(folder)
    assert [tuple(r) for r in events.drain(spark, sessions(stream, 600, "1 hour")).collect()] == [(1, START, START, 1)]
    tables.clear()


def test_calls_to_the_state_do_not_grow_with_sessions():
    """Each call to the state goes to the JVM and back; it was some four for each session."""

    class Handle:
        calls, value, timers = 0, None, ()

        def __getattr__(self, name):
            def call(*given):
                self.calls += 1
                if name == "get":
                    return self.value
                if name in ("update", "clear"):
                    self.value = given[0] if given else None
                if name in ("registerTimer", "deleteTimer"):
                    self.timers = {*self.timers} ^ {*given}
                return iter(()) if name == "iterator" else self

            return call

    handle, made = Handle(), Sessions(10)
    made.init(handle)
    us = 1_700_000_000_000_000 + np.arange(40_000) % 2000 * 20_000_000
    user = np.arange(40_000) // 2000
    for i in np.array_split(np.random.default_rng(1).permutation(40_000), 3):
        parts = (pd.DataFrame({"user_id": user[x], "us": us[x]}) for x in np.array_split(i, 4))
        assert list(made.handleInputRows((0,), parts, TimerValues())) == []
    (first,) = handle.timers
    assert first == 1_700_000_010_000
    out = []
    for at in (us[1000] // 1000, us[-1] // 1000 + 10_000):
        handle.timers = ()  # Spark deletes the timer that fired
        out += list(made.handleExpiredTimer((0,), TimerValues(-1, int(at)), ExpiredTimerInfo(first)))
    assert [len(x) for x in out] == [20 * 1000, 20 * 1000] and handle.calls < 25 and not handle.timers and handle.value is None
    out = pd.concat(out)
    assert (out.n == 1).all() and sorted(zip(out.user_id, out.session_last.astype("int64"))) == sorted(zip(user, us))


def test_no_row_is_late_by_default(spark, tmp_path):
    """Files in no order of time, a month apart: all rows come, each once."""
    rows = [(k, START + datetime.timedelta(days=(7 * k) % 40), k % 3, "click" if k % 2 else "purchase") for k in range(40)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string")
    df.repartition(20).write.parquet(f"{tmp_path}/events.parquet")
    got = events.drain(spark, events.first_seen(tables.read_stream(spark, str(tmp_path), "events"))).collect()
    assert sorted(r.event_id for r in got) == list(range(40))
    few = events.drain(spark, events.first_seen(tables.read_stream(spark, str(tmp_path), "events", files_at_once=1))).count()
    assert few < 40
    tables.clear()


def test_streams_leave_nothing_behind(spark, tmp_path):
    spark.createDataFrame([(1, START, 1, "view")], "event_id long, ts timestamp_ntz, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    before = {*tables._made}
    assert events.drain(spark, events.first_seen(tables.read_stream(spark, str(tmp_path), "events"))).count() == 1
    made = [p for p in tables._made if p not in before]
    assert len(made) == 1
    there = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(p))
    assert there(f"{made[0]}/out") and not there(f"{made[0]}/state")
    tables.clear()
    assert not there(made[0]) and not tables._made


def test_shared_folder_needs_a_setting_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default: default)

    with pytest.raises(ValueError):
        tables.shared_folder(Session())


@pytest.mark.parametrize("share", [0.0, 0.25, 0.5, 0.9, 1.0])
def test_percentile(spark, share):
    rng = random.Random(3)
    rows = [(g, rng.choice([rng.randrange(9), rng.random() * 100, None])) for g in ["a", "b", None] for _ in range(400)] + [("one", 4.0), ("none", None), *[("hot", 7.0)] * 3000, ("hot", 1.0)]
    rows = [(g, None if v is None else float(v)) for g, v in rows]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    got = {r.g: r.p for r in exact_percentile(df, ["g"], "v", share, "p").collect()}
    want = {r.g: r.p for r in df.groupBy("g").agg(F.percentile("v", share).alias("p")).collect()}
    assert got.keys() == want.keys()
    assert all(got[g] is None and want[g] is None or abs(got[g] - want[g]) < 1e-9 for g in want)
    assert exact_percentile(df.limit(0), ["g"], "v", share, "p").collect() == []
    tables.clear()
