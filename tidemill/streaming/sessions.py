"""Sessions of a stream of events, with state and timers of our own.

A session holds a user's events with less than `gap` seconds from one to the next. Its state is its first and last
time and its number of events. Events may come in any order and as late as the watermark allows: an event opens a
session, widens one, or joins two. A session is given out once the watermark has reached its last time + gap, and
forgotten; so the state holds open sessions only, whatever the length of the stream.

Each call to the state goes to the JVM and back, as do the rows of each key, so neither is done for each session or user:
users are dealt to `LOTS` lots by hash. A lot's open sessions are one value of the state, and its one timer is for the
earliest of them. A micro-batch reads and writes the open sessions of the lots that it has events or ends of.

Events older than the watermark are dropped by Spark; a session that was given out can't take another event, as such an event would be
older than the watermark. Sessions that the watermark hasn't passed at the end aren't given out. Rows with null ts or user never arrive:
they are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "user_id long, session_start timestamp_ntz, session_last timestamp_ntz, n long"
#: Lots of users. A stream that goes on from a checkpoint must keep their number.
LOTS = 1024
#: Of so many events of a lot, at least, sessions are made at a time.
AT_ONCE = 1 << 14


def merged(sessions: list[list[int]], gap: int) -> list[list[int]]:
    """Sessions [first, last, n] by time, those less than gap apart as one."""
    out: list[list[int]] = []
    for first, last, n in sorted(sessions):
        if out and first < out[-1][1] + gap:
            out[-1][1] = max(out[-1][1], last)
            out[-1][2] += n
        else:
            out.append([first, last, n])
    return out


class Sessions(StatefulProcessor):
    """Times are microseconds since 1970; timers are in milliseconds. A lot's sessions are rows of user, first, last, n."""

    def __init__(self, gap: int):
        self.gap = gap * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "sessions binary")

    def _ends(self, held: np.ndarray) -> np.ndarray:
        return self.gap // 1000 - (-held[:, 2] // 1000)

    def _held(self) -> np.ndarray:
        found = self.open.get()
        return np.frombuffer(found[0] if found else b"", "<i8").reshape(-1, 4)

    def _hold(self, before: int | None, held: np.ndarray) -> None:
        """before: what the timer is set for, if there is one."""
        ends = int(self._ends(held).min()) if len(held) else None
        if ends != before:
            if before is not None:
                self.handle.deleteTimer(before)
            if ends is not None:
                self.handle.registerTimer(ends)
        if len(held):
            self.open.update((held.astype("<i8").tobytes(),))
        else:
            self.open.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self._held()
        before = int(self._ends(held).min()) if len(held) else None
        by: dict[int, list[list[int]]] = {}
        for user, *session in held.tolist():
            by.setdefault(user, []).append(session)
        kept, fresh = len(held), 0
        for part in rows:
            for user, t in zip(part["user_id"].tolist(), part["us"].tolist()):
                by.setdefault(user, []).append([t, t, 1])
            fresh += len(part)
            if fresh >= max(AT_ONCE, kept):
                by = {user: merged(s, self.gap) for user, s in by.items()}
                kept, fresh = sum(map(len, by.values())), 0
        after = [[user, *s] for user, found in by.items() for s in merged(found, self.gap)]
        self._hold(before, np.array(after, np.int64).reshape(-1, 4))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._held()
        due = self._ends(held) <= timerValues.getCurrentWatermarkInMs()
        self._hold(None, held[~due])  # Spark deletes the timer that fired
        if due.any():
            user, first, last, n = held[due].T.copy()
            yield pd.DataFrame({"user_id": user, "session_start": first.view("M8[us]"), "session_last": last.view("M8[us]"), "n": n})

    def close(self) -> None:
        pass


def sessions(events: DataFrame, gap: int = 6 * 3600, delay: str = "1 day") -> DataFrame:
    """user_id, session_start, session_last, n of the sessions that the watermark has passed. events: user_id, ts (with
    or without a time zone, taken as UTC), maybe others. The stream's state store must be RocksDB (see streaming.events.drain)."""
    timed = events.where("ts is not null and user_id is not null").select(F.col("user_id").cast("long").alias("user_id"), F.col("ts").cast("timestamp").alias("ts"))
    timed = timed.withColumn("us", F.unix_micros("ts")).withWatermark("ts", delay).withColumn("lot", F.pmod(F.xxhash64("user_id"), F.lit(LOTS)))
    return timed.groupBy("lot").transformWithStateInPandas(Sessions(gap), outputStructType=OUT, outputMode="Append", timeMode="EventTime")
