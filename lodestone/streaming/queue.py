"""Streaming counterparts of the task queue: additions of this library, for live event tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class Leases(StatefulProcessor):
    """Of a task's events (kind: claim or result, attempt, at in ms), emits accepted results, stale ones and expired leases. State is one lease a
    task; an event-time timer expires it."""

    def __init__(self, timeout_ms: int):
        self.timeout = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.lease = handle, handle.getValueState("lease", "attempt string, deadline long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for frame in rows:
            for r in frame.sort_values("at").itertuples():
                held = self.lease.get() if self.lease.exists() else None
                if r.kind == "claim":
                    self.lease.update((r.attempt, int(r.at) + self.timeout))
                    self.handle.registerTimer(int(r.at) + self.timeout)
                elif held and held[0] == r.attempt and r.at <= held[1]:
                    self.lease.clear()
                    out.append((key[0], r.attempt, "accepted"))
                else:
                    out.append((key[0], r.attempt, "stale"))
        yield pd.DataFrame(out, columns=["task_id", "attempt", "outcome"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.lease.exists() and self.lease.get()[1] <= expiredTimerInfo.getExpiryTimeInMs():
            out.append((key[0], self.lease.get()[0], "expired"))
            self.lease.clear()
        yield pd.DataFrame(out, columns=["task_id", "attempt", "outcome"])

    def close(self) -> None:
        pass


def leases(events: DataFrame, timeout_ms: int) -> DataFrame:
    """events: task_id, kind, attempt, at (ms), time (timestamp, with a watermark)."""
    return events.groupBy("task_id").transformWithStateInPandas(Leases(timeout_ms), outputStructType="task_id string, attempt string, outcome string", outputMode="append", timeMode="eventtime")


def windowed_counts(events: DataFrame, time: str, width: str, late: str, *by: str) -> DataFrame:
    """Counts by event-time window; rows later than the watermark are dropped by Spark."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count(F.lit(1)).alias("count")).select(F.col("window.start").alias("window_start"), *by, "count")


def first_seen(events: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """Each key once, inside the watermark: resuming from a checkpoint does not repeat it."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def active_time(events: DataFrame, key: str, time: str, gap: str) -> DataFrame:
    """A key's sessions: windows without a gap longer than this, and their events."""
    return events.groupBy(key, F.session_window(time, gap)).agg(F.count(F.lit(1)).alias("events")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")


def failing(kind: Column, value: str = "error") -> Column:
    return kind == value
