"""From any table to the elements of many streams: normalising, order repair, count markers, landmarks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros(ts: str | Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone (read as UTC)."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def elements(df: DataFrame, stream: str | Column, ts: str | Column, value: str | Column, tie: Sequence[str | Column] = ()) -> DataFrame:
    """(stream_id, ts, value, seq...): the elements; rows without stream or time are no elements.

    `tie` columns, named seq0, seq1, ..., order elements of one time.
    """
    col = lambda x: F.col(x) if isinstance(x, str) else x
    out = df.select(
        col(stream).cast("long").alias("stream_id"), col(ts).cast("long").alias("ts"), col(value).cast("double").alias("value"),
        *[col(x).alias(f"seq{i}") for i, x in enumerate(tie)],
    )
    return out.where("stream_id is not null and ts is not null")


def _ties(df: DataFrame) -> list[str]:
    return sorted((x for x in df.columns if x.startswith("seq")), key=lambda x: (len(x), x))


def repair_order(arrivals: DataFrame, seq: str = "seq0") -> DataFrame:
    """Arrival order: an element earlier than the one before it gets that one's (repaired) time plus one.

    Sequential by nature, so each stream streams through one task in bounded memory: a batch that is in
    order passes as it is.
    """
    kept = arrivals.select("stream_id", "ts", "value", F.col(seq).cast("long").alias("seq0"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, last = None, 0
        for batch in batches:
            ids, ts = batch.column(0).to_numpy(), batch.column(1).to_numpy().copy()
            at = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else []
            for lo, hi in zip(at, np.append(at[1:], len(ids)) if len(ids) else []):
                last = last if ids[lo] == stream else None
                stream, x = ids[lo], ts[lo:hi]
                if (last is not None and x[0] < last) or (x[1:] < x[:-1]).any():
                    for i, t in enumerate(x.tolist()):
                        last = t if last is None or t >= last else last + 1
                        x[i] = last
                last = int(x[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ts), batch.column(2), batch.column(3)], names=batch.schema.names)

    return kept.repartition("stream_id").sortWithinPartitions("stream_id", "seq0").mapInArrow(fold, kept.schema)


def count_markers(df: DataFrame, bucket: int | None = None) -> DataFrame:
    """Adds c, the 0-based place of each element in its stream, and n, the stream's size.

    By default one exchange by stream serves both and any later grouping by stream.  For streams too
    long for one task, `bucket` is a stretch of time: elements are numbered inside (stream, stretch) and
    the stretches' sizes, summed ahead, are added; only those sizes ever meet in one task.
    """
    order = ["ts", *_ties(df), "value"]
    if bucket is None:
        w = Window.partitionBy("stream_id")
        return df.withColumns({"c": (F.row_number().over(w.orderBy(*order)) - 1).cast("long"), "n": F.count("*").over(w)})
    cut = df.withColumn("_b", F.floor(F.col("ts") / F.lit(bucket)).cast("long"))
    sizes = cut.groupBy("stream_id", "_b").agg(F.count("*").alias("_s"))
    w = Window.partitionBy("stream_id")
    ahead = sizes.withColumns({"_a": F.sum("_s").over(w.orderBy("_b")) - F.col("_s"), "n": F.sum("_s").over(w)}).drop("_s")
    inner = cut.withColumn("_r", F.row_number().over(Window.partitionBy("stream_id", "_b").orderBy(*order)) - 1)
    return inner.join(ahead, ["stream_id", "_b"]).withColumn("c", (F.col("_a") + F.col("_r")).cast("long")).drop("_a", "_r", "_b")


def split_landmarks(df: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(elements outside all landmark spans, landmark windows).

    spans: (stream_id, time_start, time_end).  A landmark window keeps its raw values, in order of time, and
    a span without elements is kept, empty.  The join is on the stream, with the span as a residual.
    """
    s = spans.select(F.col("stream_id").alias("_sid"), F.col("time_start").cast("long").alias("time_start"), F.col("time_end").cast("long").alias("time_end"))
    inside = (F.col("stream_id") == F.col("_sid")) & F.col("ts").between(F.col("time_start"), F.col("time_end"))
    rest = df.join(s, inside, "left_anti")
    point = F.struct(F.col("ts").alias("timestamp"), F.col("value").alias("value"))
    marks = s.join(df, inside, "left").groupBy(F.col("_sid").alias("stream_id"), "time_start", "time_end")
    return rest, marks.agg(F.sort_array(F.collect_list(F.when(F.col("ts").isNotNull(), point))).alias("landmarks"))
