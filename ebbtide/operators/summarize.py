"""Elements to decayed summary windows, and windows to coarser windows."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from collections.abc import Sequence as Seq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.plans.layout import with_window
from ebbtide.plans.sequences import Exponential, Sequence


@dataclass(frozen=True)
class Op:
    """An associative summary: what it makes of a column of values, and of a column of summaries."""

    name: str
    apply: Callable[[Column], Column]
    merge: Callable[[Column], Column]
    identity: float
    kind: str  # "sum": pro-rated at the edges; "extreme": taken whole


OPS: Mapping[str, Op] = {
    "count": Op("count", lambda v: F.count(v).cast("double"), F.sum, 0.0, "sum"),
    "sum": Op("sum", F.sum, F.sum, 0.0, "sum"),
    "max": Op("max", F.max, F.max, -1.7976931348623157e308, "extreme"),
    "min": Op("min", F.min, F.min, 1.7976931348623157e308, "extreme"),
}
DEFAULT = ("count", "sum", "max")


def chosen(ops: Seq[str | Op]) -> list[Op]:
    """The operators of those names; user-made ones may be given as they are."""
    for x in ops:
        if isinstance(x, str) and x not in OPS:
            raise ValueError(f"unknown operator {x!r}; known: {', '.join(OPS)}")
    return [OPS[x] if isinstance(x, str) else x for x in ops]


def summarize(numbered: DataFrame, seq: Sequence = Exponential(2.0), ops: Seq[str | Op] = DEFAULT, buffer: int = 0) -> DataFrame:
    """Windows of elements with count markers: (stream_id, time_start, time_end, count_start, count_end, ops...).

    A null value counts in the spans and in no operator.  With a buffer, the layout is that of elements which come in
    buffers of at most that size, each cut into windows largest first: fewer windows, no other sums.
    """
    keyed, key = with_window(numbered, seq, buffer=buffer)
    return keyed.groupBy("stream_id", *key).agg(
        F.min("ts").alias("time_start"), F.max("ts").alias("time_end"), F.min("c").alias("count_start"), F.max("c").alias("count_end"),
        *[F.coalesce(op.apply(F.col("value")), F.lit(op.identity)).alias(op.name) for op in chosen(ops)],
    ).drop(*key)


def merge_windows(windows: DataFrame, by: Seq[str | Column], ops: Seq[str | Op] = DEFAULT) -> DataFrame:
    """One window per group of neighbouring windows."""
    return windows.groupBy(*by).agg(
        F.min("time_start").alias("time_start"), F.max("time_end").alias("time_end"), F.min("count_start").alias("count_start"), F.max("count_end").alias("count_end"),
        *[op.merge(F.col(op.name)).alias(op.name) for op in chosen(ops)],
    )


def coarsen(windows: DataFrame, seq: Sequence = Exponential(2.0), ops: Seq[str | Op] = DEFAULT) -> DataFrame:
    """Brings windows to the layout of the stream's present size.

    Windows of an earlier layout are only ever merged, never split, so old windows and new ones of one element
    each together give the layout that all elements would have given at once.
    """
    w = Window.partitionBy("stream_id")
    sized = windows.withColumn("n", F.max("count_end").over(w) + 1)
    keyed, key = with_window(sized, seq, c="count_start", gaps=True)
    return merge_windows(keyed, ["stream_id", *key], ops).drop(*key)


def singles(numbered: DataFrame, ops: Seq[str | Op] = DEFAULT) -> DataFrame:
    """Every element as a window of its own."""
    one = {"count": F.col("value").isNotNull().cast("double"), "sum": F.coalesce("value", F.lit(0.0))}
    return numbered.select(
        "stream_id", F.col("ts").alias("time_start"), F.col("ts").alias("time_end"), F.col("c").alias("count_start"), F.col("c").alias("count_end"),
        *[one.get(op.name, F.coalesce(F.col("value"), F.lit(op.identity))).alias(op.name) for op in chosen(ops)],
    )


def window_sizes(windows: DataFrame) -> DataFrame:
    """(stream_id, n_windows, sizes): sizes oldest first, as text."""
    rows = F.sort_array(F.collect_list(F.struct("count_start", (F.col("count_end") - F.col("count_start") + 1).alias("size"))))
    sizes = F.array_join(F.transform(rows, lambda x: x["size"].cast("string")), " ")
    return windows.groupBy("stream_id").agg(F.count("*").alias("n_windows"), sizes.alias("sizes"))
