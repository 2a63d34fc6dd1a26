"""Streaming forms over detections: expiry of tracks by session windows, counts in windows, and running means with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import DEFAULT, Config


def timed(stream: DataFrame, late: str) -> DataFrame:
    """stream with ts as a time stamp of the session's zone and a watermark on it."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def track_sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Stretches of a track without a gap: user_id, start, end, rows. The gap plays the part of a tracker's buffer."""
    w = F.session_window("ts", gap)
    return timed(stream, late).groupBy(w, "user_id").agg(F.count("*").alias("rows")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "rows")


def window_counts(stream: DataFrame, size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Detections and mean value by clip in tumbling windows."""
    clip = (F.col("user_id") % 25).alias("clip_idx")
    return timed(stream, late).groupBy(F.window("ts", size), clip).agg(F.count("*").alias("rows"), F.avg("value").alias("mean_value")).select(F.col("window.start").alias("start"), "clip_idx", "rows", "mean_value")


def running_ema(stream: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """user_id, n, ema after each batch: the exponential mean of a track's values, kept as state of two numbers."""
    alpha = 2 / (config.smoothing_window + 1)

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last = state.get if state.exists else (0, 0.0)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        for x in rows["value"]:
            last = x if n == 0 else alpha * x + (1 - alpha) * last
            n += 1
        state.update((n, float(last)))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "ema": [float(last)]})

    return stream.select("user_id", "ts", "event_id", "value").groupBy("user_id").applyInPandasWithState(update, "user_id long, n long, ema double", "n long, ema double", "update", GroupStateTimeout.NoTimeout)
