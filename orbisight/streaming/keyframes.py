"""Incremental tracking as a stateful stream: keyframes by interval, and windowed counts with a watermark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_OUT = "session long, event_id long, at double, state string"


def track(frames: DataFrame, least_interval: float, most_interval: float, change: float) -> DataFrame:
    """A row for each frame of a session: keyframe, tracking, or late (not after the last one seen).

    A frame becomes a keyframe if the least interval has passed and the longest one has too or the value has changed.
    Works on streams and carries (last time, keyframe time, keyframe value) only.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, at, value = state.get if state.exists else (None, None, None)
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
        out = []
        for r in rows.itertuples():
            if last is not None and r.at <= last:
                kind = "late"
            elif at is None or (r.at - at >= least_interval and (r.at - at >= most_interval or abs(r.value - value) >= change)):
                kind, at, value, last = "keyframe", r.at, r.value, r.at
            else:
                kind, last = "tracking", r.at
            out.append((key[0], r.event_id, r.at, kind))
        if last is not None:
            state.update((last, at, value))
        yield pd.DataFrame(out, columns=["session", "event_id", "at", "state"])

    return frames.groupBy("session").applyInPandasWithState(step, _OUT, "last double, at double, value double", "append", GroupStateTimeout.NoTimeout)


def counted(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by window and type; rows later than the watermark are left out in a stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap_seconds: int) -> DataFrame:
    """Sessions of a user: a new one where the pause exceeds the gap (batch form of a session window)."""
    w = Window.partitionBy("user_id").orderBy("at", "event_id")
    starts = events.withColumn("new", F.when(F.col("at") - F.lag("at").over(w) <= gap_seconds, 0).otherwise(1))
    return starts.withColumn("session", F.sum("new").over(w)).groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"), F.max("at").alias("last"))
