"""Rate limits and investigation windows: keyed state over a stream, and the same as folds over a bounded table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Seconds between two alerts of a channel and container.
INTERVALS = {"webhook": 5.0, "email": 60.0, "sms": 300.0, "push": 30.0}
# Seconds in which events join an investigation, and for which its end silences late ones.
WINDOW, SILENCE = 10.0, 300.0

LIMITED = "channel string, container string, event_id long, at double, allowed boolean"
GROUPED = "key string, event_id long, at double, opened double, role string"
#: How late events may come; a key's state goes when no event in time can need it any more.
LATE = "10 minutes"
#: Added to times for the watermark, which begins at zero and would take an event at zero for a late one.
SHIFT = 86_400.0


class RateLimit(StatefulProcessor):
    """An event passes if the last that passed is at least the channel's interval ago. State: that time, one number for each key."""

    def __init__(self, intervals: dict[str, float]):
        self.intervals = intervals

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        wait = self.intervals.get(key[0], 0.0)
        for pdf in rows:
            pdf = pdf.sort_values(["at", "event_id"])
            allowed = []
            for at in pdf["at"]:
                allowed.append(last is None or at - last >= wait)
                last = at if allowed[-1] else last
            yield pdf.assign(allowed=allowed)[["channel", "container", "event_id", "at", "allowed"]]
        if last is not None:
            self.last.update((last,))
            self.handle.registerTimer(int((last + wait + SHIFT) * 1000) + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # a timer of an alert before the last that passed says nothing
        if self.last.exists() and expiredTimerInfo.getExpiryTimeInMs() > (self.last.get()[0] + self.intervals.get(key[0], 0.0) + SHIFT) * 1000:
            self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


class Investigation(StatefulProcessor):
    """The first event of a key opens an investigation; those within WINDOW of it join, without extending it; those within SILENCE of its end are late; the next opens another. State: the time of the opening."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.opened = handle.getValueState("opened", "at double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        opened = self.opened.get()[0] if self.opened.exists() else None
        for pdf in rows:
            pdf = pdf.sort_values(["at", "event_id"])
            starts, roles = [], []
            for at in pdf["at"]:
                if opened is None or at - opened >= WINDOW + SILENCE:
                    opened, role = at, "opens"
                else:
                    role = "joins" if at - opened < WINDOW else "late"
                starts.append(opened)
                roles.append(role)
            yield pdf.assign(opened=starts, role=roles)[["key", "event_id", "at", "opened", "role"]]
        if opened is not None:
            self.opened.update((opened,))
            self.handle.registerTimer(int((opened + WINDOW + SILENCE + SHIFT) * 1000) + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.opened.exists() and expiredTimerInfo.getExpiryTimeInMs() > (self.opened.get()[0] + WINDOW + SILENCE + SHIFT) * 1000:
            self.opened.clear()
        return iter(())

    def close(self) -> None:
        pass


def _timed(events: DataFrame, late: str) -> DataFrame:
    return events.withColumn("_ts", F.timestamp_seconds(F.col("at") + SHIFT)).withWatermark("_ts", late)


def rate_limited(alerts: DataFrame, intervals: dict[str, float] | None = None, late: str = LATE) -> DataFrame:
    """A stream of alerts (channel, container, event_id, at seconds) with ``allowed``; events arrive in the order of time within a key."""
    by = _timed(alerts, late).groupBy("channel", "container")
    return by.transformWithStateInPandas(RateLimit(intervals or INTERVALS), LIMITED, outputMode="Append", timeMode="EventTime")


def investigations(events: DataFrame, late: str = LATE) -> DataFrame:
    """A stream of events (key, event_id, at seconds) with ``opened`` and ``role``: opens, joins or late."""
    return _timed(events, late).groupBy("key").transformWithStateInPandas(Investigation(), GROUPED, outputMode="Append", timeMode="EventTime")


def anchors(events: DataFrame, keys: list[str], gap: Column) -> DataFrame:
    """``events`` (keys, at seconds, ...) with ``opened``: the time of the last anchor up to each. The first event of a key is one, then each first that is at least ``gap`` (of the key) after the anchor before.

    Which event is an anchor depends on the anchor before it, so a key's events are read in order: dealt by key,
    sorted by time, and folded as they stream by, with one time and one key as the state of a task, however
    long a key's history is.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, opened = None, 0.0
        for pdf in batches:
            if not len(pdf):
                continue
            at, wait = pdf["at"].to_numpy(float), pdf["_gap"].to_numpy(float)
            change = (pdf[keys].ne(pdf[keys].shift()) & ~(pdf[keys].isna() & pdf[keys].shift().isna())).any(axis=1).to_numpy()
            change[0] = True
            starts = np.append(np.flatnonzero(change), len(pdf))
            out = np.empty(len(pdf))
            for a, z in zip(starts[:-1], starts[1:], strict=True):
                key = tuple(None if pd.isna(v) else v for v in pdf[keys].iloc[a])
                if key != last:
                    last, opened = key, at[a]
                i = a
                while i < z:
                    end = a + int(np.searchsorted(at[a:z], opened + wait[a]))
                    out[i : max(i, end)] = opened
                    i = max(i, end)
                    if i < z:
                        opened = at[i]
                        if wait[a] <= 0:
                            out[i:z], opened = at[i:z], at[z - 1]
                            break
            yield pdf.drop(columns="_gap").assign(opened=out)

    rows = events.withColumn("_gap", gap.cast("double")).repartition(*keys).sortWithinPartitions(*keys, "at")
    return rows.mapInPandas(fold, f"{schema}, opened double")
