"""Range aggregates over summary windows, with bounds and confidence intervals, for many requests at once.

A request (req_id, stream_id, t0, t1) meets the windows of its stream that overlap [t0, t1].  Windows wholly
inside count in full; the first and the last are pro-rated by the part of them that overlaps, less what landmark
windows cover, whose raw values count exactly.  One equi-join on the stream with the overlap as a
residual, and one grouped aggregation, whatever the number of requests.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbtide.functions.normal import inv_cdf
from ebbtide.operators.summarize import Op, chosen

LANDMARKS = T.StructType([
    T.StructField("stream_id", T.LongType()), T.StructField("time_start", T.LongType()), T.StructField("time_end", T.LongType()),
    T.StructField("landmarks", T.ArrayType(T.StructType([T.StructField("timestamp", T.LongType()), T.StructField("value", T.DoubleType())]))),
])


def requests(spark: SparkSession, rows: Iterable[tuple[Any, int, int, int]]) -> DataFrame:
    """(req_id, stream_id, t0, t1) from rows of those."""
    return spark.createDataFrame([(str(r), s, a, b) for r, s, a, b in rows], "req_id string, stream_id long, t0 long, t1 long")


def overlap(l1: Column, r1: Column, l2: Column, r2: Column) -> Column:
    """Length of what two inclusive spans share."""
    return F.greatest(F.least(r1, r2) - F.greatest(l1, l2) + 1, F.lit(0).cast("long"))


#: Grouping by the stream first keeps the partitioning that windows have by stream.
BY = ("stream_id", "req_id", "t0", "t1")


def _met(windows: DataFrame, reqs: DataFrame):
    """Requests with the windows they meet, grouped by request; one that meets none has a row of nulls."""
    w = windows.withColumnRenamed("stream_id", "w_stream")
    on = (F.col("stream_id") == F.col("w_stream")) & (F.col("time_end") >= F.col("t0")) & (F.col("time_start") <= F.col("t1"))
    return reqs.select(*BY).join(w, on, "left").groupBy(*BY)


def _seen(base: DataFrame, reqs: DataFrame, landmarks: DataFrame) -> DataFrame:
    """base (requests with more columns) with the landmark windows each sees: those that overlap, and the first that starts after t1."""
    marks = landmarks.select(F.col("stream_id").alias("m_stream"), F.col("time_start").alias("m_start"), F.col("time_end").alias("m_end"), "landmarks")
    own = F.col("stream_id") == F.col("m_stream")
    after = reqs.select(*BY).join(marks.select("m_stream", "m_start"), own & (F.col("m_start") >= F.col("t1"))).groupBy(*BY).agg(F.min("m_start").alias("after"))
    on = own & (F.col("m_end") >= F.col("t0")) & (F.col("m_start") <= F.coalesce("after", "t1"))
    return base.join(after, list(BY), "left").join(marks, on, "left").drop("m_stream", "after")


def _inside(t0: Column, t1: Column) -> Column:
    return F.filter("landmarks", lambda m: m["timestamp"].between(t0, t1))


def estimate(
    windows: DataFrame, reqs: DataFrame, op: str | Op, landmarks: DataFrame | None = None, confidence: float = 0.95, sd_multiplier: float = 1.0
) -> DataFrame:
    """One row per request, whose req_id is its own: (req_id, stream_id, value, error, lower, upper, mean, var, ci_lower, ci_upper, is_upper_bound).

    For counts and sums value is the estimate and error the width of its interval; with confidence 1 the
    interval is the hard bounds.  Extremes take windows whole, so value bounds the true one
    (is_upper_bound); error is 1, and 0 once a landmark is in range.  A request that meets nothing gets the
    operator's identity.
    """
    op = chosen([op])[0]
    return (_extreme if op.kind == "extreme" else _additive)(windows, reqs, op, landmarks, confidence, sd_multiplier)


def _additive(windows: DataFrame, reqs: DataFrame, op: Op, landmarks: DataFrame | None, confidence: float, sd: float) -> DataFrame:
    edge = F.struct(F.col("time_start").alias("start"), F.col("time_end").alias("end"), F.col(op.name).alias("sum"))
    base = _met(windows, reqs).agg(
        F.count("time_start").alias("n"), F.sum(op.name).alias("total"), F.min_by(edge, F.struct("time_start", "count_start")).alias("first"), F.max_by(edge, F.struct("time_start", "count_start")).alias("last")
    )
    col = F.col
    none = F.lit(0).cast("long")
    names = ("first_length", "first_overlap", "last_length", "last_overlap")
    if landmarks is None:
        cuts = base.select("*", *[none.alias(f"cut_{x}") for x in names], F.lit(0.0).alias("marked"))
    else:
        value = F.lit(1.0) if op.name == "count" else None
        marked = F.aggregate(_inside(col("t0"), col("t1")), F.lit(0.0), lambda acc, m: acc + (value if value is not None else m["value"]))
        f_on, l_on = col("first.start") < col("m_end"), col("last.end") > col("m_start")
        lm = lambda a, b: overlap(col("m_start"), col("m_end"), a, b)
        summed = _seen(base, reqs, landmarks).groupBy(*base.columns).agg(
            F.sum(F.when(f_on, lm(col("first.start"), col("first.end")))).alias("cut_first_length"), F.sum(F.when(f_on, lm(col("t0"), col("first.end")))).alias("cut_first_overlap"),
            F.sum(F.when(l_on, lm(col("last.start"), col("last.end")))).alias("cut_last_length"), F.sum(F.when(l_on, lm(col("last.start"), col("t1")))).alias("cut_last_overlap"),
            F.sum(marked).alias("marked"),
        )
        cuts = summed.na.fill(0, [f"cut_{x}" for x in names]).na.fill(0.0, ["marked"])
    some = F.coalesce("n", none) > 0
    pieces = cuts.select(
        "req_id", "stream_id", "marked",
        F.when(some, col("first.sum")).otherwise(0.0).alias("first_sum"),
        F.when(some & (col("n") > 1), col("last.sum")).otherwise(0.0).alias("last_sum"),
        F.coalesce("total", F.lit(0.0)).alias("total"),
        *[
            F.when(some, x).otherwise(F.lit(1).cast("long")).alias(name)
            for name, x in (
                ("first_length", col("first.end") - col("first.start") + 1 - col("cut_first_length")),
                ("first_overlap", overlap(col("first.start"), col("first.end"), col("t0"), col("t1")) - col("cut_first_overlap")),
                ("last_length", col("last.end") - col("last.start") + 1 - col("cut_last_length")),
                ("last_overlap", overlap(col("last.start"), col("last.end"), col("t0"), col("t1")) - col("cut_last_overlap")),
            )
        ],
    )
    middle = col("total") - (col("first_sum") + col("last_sum"))
    one = F.lit(1).cast("long")
    parts = [(col("marked"), one, one), (col("first_sum"), col("first_overlap"), col("first_length")), (middle, one, one), (col("last_sum"), col("last_overlap"), col("last_length"))]
    upper = lower = mean = var = F.lit(0.0)
    for s, o, size in parts:
        q = F.try_divide(o.cast("double"), size.cast("double"))
        # a part of no length that overlaps: the ratio is infinite, as is what it is multiplied with
        q = F.when(size == 0, F.lit(math.inf)).otherwise(q)
        upper = upper + s
        lower = lower + F.when(o == size, s).otherwise(0.0)
        mean = mean + F.when(o > 0, s * q).otherwise(0.0)
        var = var + F.when(o > 0, s * q * (1 - q)).otherwise(0.0)
    out = pieces.select("req_id", "stream_id", lower.alias("lower"), upper.alias("upper"), mean.alias("mean"), var.alias("var"))
    z = inv_cdf((1 + confidence) / 2)
    if math.isinf(z):
        lo, hi = col("lower"), col("upper")
    else:
        spread = F.lit(z * sd) * F.when(col("var") < 0, F.lit(math.nan)).otherwise(F.sqrt(F.abs("var")))
        pick = lambda f, x, y: F.when(F.isnan(x), x).otherwise(f(x, y))
        lo, hi = pick(F.greatest, col("mean") - spread, col("lower")), pick(F.least, col("mean") + spread, col("upper"))
    out = out.withColumns({"ci_lower": lo, "ci_upper": hi})
    return out.select("req_id", "stream_id", col("mean").alias("value"), (col("ci_upper") - col("ci_lower")).alias("error"), "lower", "upper", "mean", "var", "ci_lower", "ci_upper", F.lit(False).alias("is_upper_bound"))


def _extreme(windows: DataFrame, reqs: DataFrame, op: Op, landmarks: DataFrame | None, confidence: float, sd: float) -> DataFrame:
    largest = op.name != "min"
    best, pick = (F.max, F.greatest) if largest else (F.min, F.least)
    base = _met(windows, reqs).agg(op.merge(F.col(op.name)).alias("whole"))
    if landmarks is None:
        base = base.select("*", F.lit(None).cast("double").alias("marked"))
    else:
        values = F.transform(_inside(F.col("t0"), F.col("t1")), lambda m: m["value"])
        base = _seen(base, reqs, landmarks).groupBy(*base.columns).agg(best(F.array_max(values) if largest else F.array_min(values)).alias("marked"))
    value = F.coalesce(pick("whole", "marked"), F.lit(op.identity))
    error = F.when(F.col("marked").isNotNull(), 0.0).otherwise(1.0)
    nothing = F.lit(None).cast("double")
    return base.select(
        "req_id", "stream_id", value.alias("value"), error.alias("error"), *[nothing.alias(x) for x in ("lower", "upper")], value.alias("mean"), *[nothing.alias(x) for x in ("var", "ci_lower", "ci_upper")], F.lit(largest).alias("is_upper_bound")
    )


def empty(op: str | Op) -> Mapping[str, float]:
    """What a query that meets nothing returns."""
    op = chosen([op])[0]
    return {"value": op.identity, "error": 1.0 if op.kind == "extreme" else 0.0}
