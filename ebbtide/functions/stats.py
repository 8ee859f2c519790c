"""Moments of values and of the intervals between arrivals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def moments(x: str | Column, prefix: str = "") -> list[Column]:
    """count, mean, var, sample_var, sd and cv of a column; 0 where there are too few values."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    sd = F.when(F.count(x) > 1, F.stddev_samp(x))
    return [
        F.count(x).alias(f"{prefix}count"), zero(F.avg(x)).alias(f"{prefix}mean"), zero(F.when(F.count(x) > 1, F.var_pop(x))).alias(f"{prefix}var"),
        zero(F.when(F.count(x) > 1, F.var_samp(x))).alias(f"{prefix}sample_var"), zero(sd).alias(f"{prefix}sd"),
        zero(F.try_divide(sd, F.avg(x))).alias(f"{prefix}cv"),
    ]


def stream_statistics(elements: DataFrame) -> DataFrame:
    """Per stream: first and last arrival, size, moments of values and of intervals; order: ts, then ties."""
    ties = sorted(x for x in elements.columns if x.startswith("seq"))
    gap = F.col("ts") - F.lag("ts").over(Window.partitionBy("stream_id").orderBy("ts", *ties))
    return elements.withColumn("gap", gap.cast("double")).groupBy("stream_id").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"), *moments("value", "value_"), *moments("gap", "interval_")
    )
