"""Reading windows: by range of time, by start, and all but some."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def range_scan(windows: DataFrame, t0: int, t1: int) -> DataFrame:
    """Summary windows that overlap [t0, t1]; both conditions reach the Parquet scan."""
    return windows.where((F.col("time_end") >= t0) & (F.col("time_start") <= t1))


def landmark_scan(landmarks: DataFrame, t0: int, t1: int) -> DataFrame:
    """Landmark windows that overlap [t0, t1] and, of each stream, the first that starts after it."""
    after = F.min(F.when(F.col("time_start") >= t1, F.col("time_start"))).over(Window.partitionBy("stream_id"))
    kept = landmarks.where(F.col("time_end") >= t0).withColumn("_after", after)
    return kept.where(F.col("time_start") <= F.greatest(F.coalesce("_after", F.lit(t1)), F.lit(t1))).drop("_after")


def index_scan(windows: DataFrame, t0: int, t1: int) -> DataFrame:
    """Window starts from the floor of t0 to the ceiling of t1: a superset of the overlap by one at each end."""
    w = Window.partitionBy("stream_id")
    lo = F.max(F.when(F.col("time_start") <= t0, F.col("time_start"))).over(w)
    hi = F.min(F.when(F.col("time_start") >= t1, F.col("time_start"))).over(w)
    kept = windows.withColumns({"_lo": lo, "_hi": hi})
    inside = (F.col("_lo").isNull() | (F.col("time_start") >= F.col("_lo"))) & (F.col("_hi").isNull() | (F.col("time_start") <= F.col("_hi")))
    return kept.where(inside).drop("_lo", "_hi")


def point_get(windows: DataFrame, starts: DataFrame) -> DataFrame:
    """The windows that starts (stream_id, time_start) names, each once."""
    return windows.join(starts.select("stream_id", "time_start").distinct(), ["stream_id", "time_start"], "left_semi")


def delete_starts(windows: DataFrame, starts: DataFrame) -> DataFrame:
    """Without the windows that starts (stream_id, time_start) names."""
    return windows.join(starts.select("stream_id", "time_start").distinct(), ["stream_id", "time_start"], "left_anti")


def delete_range(windows: DataFrame, t0: int, t1: int) -> DataFrame:
    return windows.where((F.col("time_end") < t0) | (F.col("time_start") > t1))


def window_count(windows: DataFrame) -> DataFrame:
    return windows.groupBy("stream_id").agg(F.count("*").alias("n_windows"))
