"""The store: streams, their windows and landmarks as versioned Parquet tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence as Seq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.operators import estimate, scan
from ebbtide.operators.ingest import count_markers, split_landmarks
from ebbtide.operators.summarize import DEFAULT, OPS, chosen, coarsen, singles
from ebbtide.plans.sequences import Exponential, Sequence, from_json, to_json
from ebbtide.sources.versions import Versions

SPAN = "stream_id long, time_start long, time_end long"
WINDOWS = f"{SPAN}, count_start long, count_end long, " + ", ".join(f"{x} double" for x in OPS)
STREAMS = "stream_id long, sequence string, ops string"
OPEN = "stream_id long, time_start long"
ORDER = [c.split()[0] for c in WINDOWS.split(", ")]
#: Parts of the tables of windows and landmarks in a new store.
BUCKETS = 256


def _bucket(n: int):
    return F.pmod(F.xxhash64("stream_id"), F.lit(n)).cast("int").alias("bucket")


class Store:
    """Many streams under one path.

    Appending reads the windows kept so far, never the elements: the new elements become windows of one each and all are
    merged to the layout of the new size.  Windows and landmarks are in BUCKETS parts by a hash of the stream, and a change reads and
    writes only the parts it touches.  Every change commits one new version; what was being written when a driver is lost is never seen.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.spark, self.versions, self.closed = spark, Versions(spark, path), False
        self.buckets = int(self.versions.current()[1]["meta"].get("buckets", buckets))

    # -- catalogue
    def streams(self) -> DataFrame:
        return self.versions.read("streams", STREAMS)

    def create_streams(self, ids: Iterable[int] | DataFrame | None = None, sequence: Sequence = Exponential(2.0), ops: Seq[str] = DEFAULT, n: int = 1) -> list[int] | None:
        """Adds streams; without ids, n of them numbered after the largest so far, which are returned."""
        self._open()
        names = ",".join(op.name for op in chosen(ops))
        made = None
        if ids is None:
            first = (self.streams().agg(F.max("stream_id")).first()[0] if self.versions.current()[0] else None)
            made = list(range(0 if first is None else first + 1, (0 if first is None else first + 1) + n))
            ids = made
        rows = ids.select("stream_id").distinct() if isinstance(ids, DataFrame) else self.spark.createDataFrame([(int(i),) for i in ids], "stream_id long")
        if self.streams().join(rows, "stream_id", "left_semi").limit(1).count():
            raise ValueError("a stream of that id exists")
        self.versions.extend("streams", rows.select("stream_id", F.lit(to_json(sequence)).alias("sequence"), F.lit(names).alias("ops")), {"buckets": self.buckets})
        return made

    def stream(self, stream_id: int) -> dict:
        row = self.streams().where(F.col("stream_id") == stream_id).first()
        if row is None:
            raise KeyError(f"stream not found: {stream_id}")
        return {"stream_id": row["stream_id"], "sequence": from_json(row["sequence"]), "ops": row["ops"].split(",")}

    # -- tables
    def windows(self, parts: Iterable[int] | None = None) -> DataFrame:
        return self.versions.read_parts("windows", WINDOWS, parts)

    def landmarks(self, parts: Iterable[int] | None = None) -> DataFrame:
        return self.versions.read_parts("landmarks", estimate.LANDMARKS, parts)

    def _parts(self, streams: DataFrame) -> list[int]:
        """The parts that streams (stream_id) are in: at most `buckets` numbers."""
        return sorted(r[0] for r in streams.select(_bucket(self.buckets)).distinct().collect())

    def _replace(self, tables: dict[str, DataFrame], parts: list[int], others: dict[str, DataFrame] | None = None, meta: dict | None = None) -> None:
        """Writes parts of windows and landmarks, a task for each part, sorted for scans by time."""
        cut = {k: v.withColumn("bucket", _bucket(self.buckets)).repartition("bucket").sortWithinPartitions("bucket", "stream_id", "time_start") for k, v in tables.items()}
        self.versions.replace_parts(cut, "bucket", parts, others, meta)

    def open_landmarks(self) -> DataFrame:
        return self.versions.read("open", OPEN)

    # -- writing
    def append(self, elements: DataFrame, landmark_spans: DataFrame | None = None, meta: dict | None = None) -> None:
        """Adds elements (stream_id, ts, value, seq...) of known streams.

        Elements inside a landmark span (stream_id, time_start, time_end), or at or after the start of an open landmark, are
        kept raw and stay out of the windows.  An element that is earlier than what its stream ends with is
        summarised at that end: windows stay contiguous.  meta is committed with the elements.
        """
        self._open()
        unknown = elements.join(self.streams(), "stream_id", "left_anti").select("stream_id").limit(1).collect()
        if unknown:
            raise KeyError(f"stream not found: {unknown[0][0]}")
        changed: dict[str, DataFrame] = {}
        started = self.open_landmarks()
        spans = started.withColumn("time_end", F.lit(2**62).cast("long"))
        if landmark_spans is not None:
            spans = spans.unionByName(landmark_spans.select("stream_id", F.col("time_start").cast("long"), F.col("time_end").cast("long")))
        touched = elements.select("stream_id")
        parts = self._parts(touched if landmark_spans is None else touched.unionByName(landmark_spans.select("stream_id")))
        if not parts:
            if meta:
                self.versions.replace({}, meta)
            return
        rest, marks = split_landmarks(elements, spans.where(_bucket(self.buckets).isin(parts)).distinct())
        old_marks = self.landmarks(parts)
        merged = old_marks.unionByName(marks).select("stream_id", "time_start", "time_end", F.col("landmarks").alias("m"))
        changed["landmarks"] = merged.groupBy("stream_id", "time_start", "time_end").agg(F.sort_array(F.flatten(F.collect_list("m"))).alias("landmarks"))
        old = self.windows(parts)
        ends = old.groupBy("stream_id").agg((F.max("count_end") + 1).alias("held"), F.max("time_end").alias("latest"))
        new = count_markers(rest).join(ends, "stream_id", "left")
        new = new.withColumns({"c": F.col("c") + F.coalesce("held", F.lit(0)), "ts": F.greatest("ts", "latest")})
        both = old.unionByName(singles(new, tuple(OPS)))
        kinds = [r[0] for r in self.streams().select("sequence").distinct().collect()]  # a few layouts, whatever the streams
        made = []
        for kind in kinds:
            own = both if len(kinds) == 1 else both.join(self.streams().where(F.col("sequence") == kind).select("stream_id"), "stream_id", "left_semi")
            made.append(coarsen(own, from_json(kind), tuple(OPS)))
        out = made[0]
        for p in made[1:]:
            out = out.unionByName(p)
        changed["windows"] = out.select(*ORDER)
        self._replace(changed, parts, meta=meta)

    def start_landmark(self, stream_id: int, ts: int) -> None:
        self._open()
        self.stream(stream_id)
        if self.open_landmarks().where(F.col("stream_id") == stream_id).count():
            raise ValueError("a landmark is open")
        self.versions.extend("open", self.spark.createDataFrame([(stream_id, ts)], OPEN))

    def end_landmark(self, stream_id: int, ts: int) -> None:
        """Closes the stream's open landmark at ts; its window is seen by queries from now on."""
        self._open()
        row = self.open_landmarks().where(F.col("stream_id") == stream_id).first()
        if row is None:
            raise ValueError("no landmark is open")
        mine = (F.col("stream_id") == stream_id) & (F.col("time_end") == 2**62)
        empty = self.spark.createDataFrame([(stream_id, row["time_start"], 2**62, [])], estimate.LANDMARKS)
        parts = self._parts(empty)
        held = self.landmarks(parts)
        some = held.where(mine).limit(1).count() > 0
        closed = (held if some else held.unionByName(empty)).withColumn("time_end", F.when(mine, F.lit(ts)).otherwise(F.col("time_end")))
        self._replace({"landmarks": closed}, parts, {"open": self.open_landmarks().where(F.col("stream_id") != stream_id)})

    def delete_windows(self, starts: DataFrame) -> None:
        """Removes the summary windows that starts (stream_id, time_start) names."""
        self._open()
        parts = self._parts(starts)
        self._replace({"windows": scan.delete_starts(self.windows(parts), starts)}, parts)

    def delete_landmarks(self, starts: DataFrame) -> None:
        self._open()
        parts = self._parts(starts)
        self._replace({"landmarks": scan.delete_starts(self.landmarks(parts), starts)}, parts)

    # -- reading
    def query(self, op: str, reqs: DataFrame | Iterable[tuple], confidence: float = 0.95, sd_multiplier: float = 1.0) -> DataFrame:
        """Answers requests (req_id, stream_id, t0, t1); landmarks still open are not seen.

        Of requests that are given as rows, only the parts of their streams are read, and of windows only their span of time.
        """
        self._open()
        chosen([op])
        parts, windows = None, None
        if not isinstance(reqs, DataFrame):
            rows = list(reqs)
            reqs = estimate.requests(self.spark, rows)
            parts = self._parts(reqs)
            if rows:
                windows = scan.range_scan(self.windows(parts), min(r[2] for r in rows), max(r[3] for r in rows))
        windows = self.windows(parts) if windows is None else windows
        seen = self.landmarks(parts).where(F.col("time_end") < 2**62)
        return estimate.estimate(windows, reqs, op, seen, confidence, sd_multiplier)

    def scan(self, t0: int, t1: int) -> DataFrame:
        return scan.range_scan(self.windows(), t0, t1)

    def register_views(self, prefix: str = "") -> None:
        """windows, landmarks and streams as temporary views, for SQL."""
        for name in ("windows", "landmarks", "streams"):
            getattr(self, name)().createOrReplaceTempView(prefix + name)

    def close(self) -> None:
        self.closed = True

    def _open(self) -> None:
        if self.closed:
            raise RuntimeError("the store is closed")
