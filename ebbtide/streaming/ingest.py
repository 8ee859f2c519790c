"""Decayed windows of streams that never end, as Structured Streaming state."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ebbtide.plans.layout import Layout, Planner
from ebbtide.plans.sequences import Exponential, Sequence

OUT = "stream_id long, time_start long, time_end long, count_start long, count_end long, count double, sum double, max double"
STATE = "last long, time_start array<long>, time_end array<long>, count_start array<long>, count_end array<long>, count array<double>, sum array<double>, max array<double>"
LOWEST = -1.7976931348623157e308


class Stream:
    """The windows of one stream between micro-batches; appending follows the layout rule element by element."""

    def __init__(self, planner: Planner, last: int | None = None, rows: Iterable[tuple] = ()) -> None:
        self.last = last
        self.rows = {r[2]: list(r) for r in rows}
        self.layout = Layout(planner, [(r[2], r[3]) for r in sorted(self.rows.values(), key=lambda r: r[2])])

    def append(self, ts: int, value: float) -> None:
        """An element before the stream's end is re-stamped to one after it, never dropped."""
        if self.last is not None and ts < self.last:
            ts = self.last + 1
        self.last = ts
        c, real = self.layout.n, value is not None and value == value
        self.rows[c] = [ts, ts, c, c, float(real), float(value) if real else 0.0, float(value) if real else LOWEST]
        for w, s in self.layout.append():
            a, b = self.rows[w], self.rows.pop(s)
            a[1], a[3], a[4], a[5], a[6] = b[1], b[3], a[4] + b[4], a[5] + b[5], max(a[6], b[6])

    def sorted(self) -> list[list]:
        return [self.rows[k] for k in sorted(self.rows)]


def decayed_windows(stream: DataFrame, seq: Sequence = Exponential(2.0)) -> DataFrame:
    """A streaming DataFrame (stream_id, ts, value[, seq0]) to each changed stream's windows, as an update.

    State is O(windows) per stream.  Inside a micro-batch a stream's elements are put in order of (ts, seq0); across
    batches late elements are re-stamped.  Batch boundaries don't change the layout.
    """
    cols = ["stream_id", "ts", "value", *(["seq0"] if "seq0" in stream.columns else [])]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = state.get if state.exists else None
        s = Stream(Planner(seq), kept[0], zip(*kept[1:])) if kept else Stream(Planner(seq))
        rows = pd.concat(list(batches)).sort_values(cols[1:2] + cols[3:] + cols[2:3], kind="stable")
        for ts, value in zip(rows["ts"].tolist(), rows["value"].tolist()):
            s.append(ts, value)
        out = s.sorted()
        state.update((s.last, *[list(x) for x in zip(*out)]))
        frame = pd.DataFrame(out, columns=["time_start", "time_end", "count_start", "count_end", "count", "sum", "max"])
        frame.insert(0, "stream_id", np.int64(key[0]))
        yield frame

    return stream.select(*cols).groupBy("stream_id").applyInPandasWithState(step, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def start(stream: DataFrame, path: str, checkpoint: str, seq: Sequence = Exponential(2.0), **options: str) -> StreamingQuery:
    """Keeps the latest windows of every stream under path, one directory per micro-batch; see latest()."""

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return decayed_windows(stream, seq).writeStream.outputMode("update").option("checkpointLocation", checkpoint).options(**options).foreachBatch(put).start()


def latest(spark, path: str) -> DataFrame:
    """The windows of each stream as of the last micro-batch that held any of its elements."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    rows = spark.read.parquet(path)
    newest = F.max("epoch").over(Window.partitionBy("stream_id"))
    return rows.withColumn("_e", newest).where("epoch = _e").drop("_e", "epoch")
