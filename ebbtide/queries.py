"""The library's queries over the driver's tables, and the SQL that should give the same rows."""

from __future__ import annotations

import atexit
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ebbtide.functions import normal, stats
from ebbtide.operators import estimate, ingest, scan, summarize
from ebbtide.operators.log import Log, replay
from ebbtide.plans.layout import layouts
from ebbtide.plans.sequences import Exponential, Power
from ebbtide.sources.shared import fresh_path
from ebbtide.sources.store import Store

#: 2024-01-10, 2024-01-24 and landmark spans of every user, in microseconds.
T0, T1 = 1704844800000000, 1706054400000000
DAY = 86_400_000_000
SPANS = ((T0 + 2 * DAY, T0 + 4 * DAY), (T0 + 10 * DAY, T0 + 11 * DAY), (T1 - DAY // 2, T1 + DAY), (T1 + 3 * DAY, T1 + 4 * DAY))
Z95 = 1.9599639845400536
POWER, EXP15 = Power(1, 1, 10, 1), Exponential(1.5)


def r4(c: str | Column) -> Column:
    return F.round(c, 4) + F.lit(0.0)  # no negative zero


def events(spark: SparkSession, d: str) -> DataFrame:
    df = spark.read.parquet(f"{d}/events.parquet")
    return ingest.elements(df, "user_id", ingest.micros("ts"), "value", ["event_id"])


def numbered(spark: SparkSession, d: str) -> DataFrame:
    return ingest.count_markers(events(spark, d))


def windows(spark: SparkSession, d: str) -> DataFrame:
    return summarize.summarize(numbered(spark, d))


def spans(spark: SparkSession, d: str) -> DataFrame:
    users = events(spark, d).select("stream_id").distinct()
    both = F.array(*[F.struct(F.lit(a).alias("time_start"), F.lit(b).alias("time_end")) for a, b in SPANS])
    return users.select("stream_id", F.inline(both))


def with_landmarks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rest, marks = ingest.split_landmarks(events(spark, d), spans(spark, d))
    return summarize.summarize(ingest.count_markers(rest)), marks


def reqs(spark: SparkSession, d: str, t0: int = T0, t1: int = T1) -> DataFrame:
    """One request per stream."""
    users = events(spark, d).select("stream_id").distinct()
    return users.select(F.col("stream_id").cast("string").alias("req_id"), "stream_id", F.lit(t0).alias("t0"), F.lit(t1).alias("t1"))


def _shown(df: DataFrame) -> DataFrame:
    return df.select("stream_id", *[r4(x).alias(x) for x in ("value", "error", "lower", "upper", "mean", "var", "ci_lower", "ci_upper")])


def _windows_shown(df: DataFrame) -> DataFrame:
    return df.select("stream_id", "time_start", "time_end", "count_start", "count_end", r4("count").alias("cnt"), r4("sum").alias("sm"), r4("max").alias("mx"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """The sum of each user's values in a span of time, from decayed windows, with its confidence interval."""
    return _shown(estimate.estimate(windows(spark, d), reqs(spark, d), "sum"))


def _full(spark: SparkSession, d: str, op: str, seq=Exponential(2.0)) -> DataFrame:
    w = summarize.summarize(numbered(spark, d), seq)
    out = estimate.estimate(w, reqs(spark, d, 0, 2**52), op)
    return out.select("stream_id", r4("value").alias("value"), r4("error").alias("error"))


def q_ingest_count_markers(spark, d):
    return numbered(spark, d).select("stream_id", F.col("seq0").alias("event_id"), "ts", "c", "n")


def q_count_markers_two_pass(spark, d):
    return ingest.count_markers(events(spark, d), bucket=DAY).select("stream_id", F.col("seq0").alias("event_id"), "ts", "c", "n")


def q_layout_exp2(spark, d):
    return summarize.window_sizes(windows(spark, d))


def q_summarize_exp2(spark, d):
    return _windows_shown(windows(spark, d))


def q_window_merge(spark, d):
    pairs = windows(spark, d).withColumn("pair", F.floor((F.row_number().over(Window.partitionBy("stream_id").orderBy("count_start")) - 1) / 2))
    return _windows_shown(summarize.merge_windows(pairs, ["stream_id", "pair"]))


def q_summary_range_scan(spark, d):
    return _windows_shown(scan.range_scan(windows(spark, d), T0, T1))


def q_index_scan(spark, d):
    return _windows_shown(scan.index_scan(windows(spark, d), T0, T1))


def q_window_count(spark, d):
    return scan.window_count(windows(spark, d))


def q_point_get(spark, d):
    w = windows(spark, d)
    first = w.groupBy("stream_id").agg(F.min("time_start").alias("time_start"))
    return _windows_shown(scan.point_get(w, first))


def q_delete_window(spark, d):
    w = windows(spark, d)
    return _windows_shown(scan.delete_starts(w, w.groupBy("stream_id").agg(F.min("time_start").alias("time_start"))))


def q_count_estimate(spark, d):
    return _shown(estimate.estimate(windows(spark, d), reqs(spark, d), "count"))


def q_sum_estimate_sd2(spark, d):
    return _shown(estimate.estimate(windows(spark, d), reqs(spark, d), "sum", sd_multiplier=2.0))


def q_sum_estimate_cl100(spark, d):
    return _shown(estimate.estimate(windows(spark, d), reqs(spark, d), "sum", confidence=1.0))


def q_count_full_range(spark, d):
    return _full(spark, d, "count")


def q_sum_full_range(spark, d):
    return _full(spark, d, "sum")


def q_max_full_range(spark, d):
    return _full(spark, d, "max")


def q_power_full_range(spark, d):
    return _full(spark, d, "sum", POWER)


def q_exp15_full_range(spark, d):
    return _full(spark, d, "count", EXP15)


def q_power_layout(spark, d):
    return summarize.window_sizes(summarize.summarize(numbered(spark, d), POWER))


def q_exp15_layout(spark, d):
    return summarize.window_sizes(summarize.summarize(numbered(spark, d), EXP15))


def q_buffered_layout(spark, d):
    """Layouts of elements that come in buffers of 32."""
    return summarize.window_sizes(summarize.summarize(numbered(spark, d), buffer=32))


def q_buffered_full_range(spark, d):
    w = summarize.summarize(numbered(spark, d), POWER, buffer=32)
    return estimate.estimate(w, reqs(spark, d, 0, 2**52), "sum").select("stream_id", r4("value").alias("value"), r4("error").alias("error"))


def q_min_estimate(spark, d):
    w = summarize.summarize(numbered(spark, d), ops=("min",))
    return estimate.estimate(w, reqs(spark, d), "min").select("stream_id", r4("value").alias("value"), "error", "is_upper_bound")


def q_max_estimate(spark, d):
    w, marks = with_landmarks(spark, d)
    return estimate.estimate(w, reqs(spark, d), "max", marks).select("stream_id", r4("value").alias("value"), "error", "is_upper_bound")


def q_landmark_build(spark, d):
    one = lambda m: F.concat_ws(":", m["timestamp"].cast("string"), F.format_string("%.2f", m["value"]))
    text = F.array_join(F.transform("landmarks", one), " ")
    return with_landmarks(spark, d)[1].select("stream_id", "time_start", "time_end", F.size("landmarks").cast("long").alias("n"), text.alias("landmarks"))


def q_landmark_scan(spark, d):
    return scan.landmark_scan(with_landmarks(spark, d)[1], T0 + 3 * DAY, T0 + 5 * DAY).select("stream_id", "time_start", "time_end", F.size("landmarks").cast("long").alias("n"))


def _marked(spark, d, op):
    w, marks = with_landmarks(spark, d)
    return _shown(estimate.estimate(w, reqs(spark, d), op, marks))


def q_count_landmark(spark, d):
    return _marked(spark, d, "count")


def q_sum_landmark(spark, d):
    return _marked(spark, d, "sum")


def q_order_repair(spark, d):
    arrive = F.conv(F.substring(F.md5(F.col("seq0").cast("string")), 1, 8), 16, 10).cast("long") * 1000000 + F.col("seq0")
    e = events(spark, d)
    return ingest.repair_order(e.withColumn("seq0", arrive)).select("stream_id", F.col("seq0").alias("arrival"), "ts", "value")


def q_empty_range(spark, d):
    w, r = windows(spark, d), reqs(spark, d, 1, 2)
    parts = [estimate.estimate(w, r, op).select("stream_id", F.lit(op).alias("op"), "value", "error") for op in ("count", "sum", "max")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def q_stream_stats(spark, d):
    s = stats.stream_statistics(events(spark, d))
    return s.select("stream_id", "first_ts", "last_ts", "n", *[r4(f"value_{x}").alias(f"value_{x}") for x in ("mean", "var", "sample_var", "sd", "cv")])


def q_interval_stats(spark, d):
    e = events(spark, d).withColumn("ts", F.floor(F.col("ts") / 1000000))
    s = stats.stream_statistics(e)
    return s.select("stream_id", *[F.round(f"interval_{x}", 1).alias(f"interval_{x}") for x in ("mean", "var", "sample_var", "sd")], r4("interval_cv").alias("interval_cv"))


def q_normal_pdf(spark, d):
    return events(spark, d).select(F.col("seq0").alias("event_id"), F.round(normal.pdf(F.col("value"), 50.0, 25.0), 10).alias("density"))


def q_normal_cdf(spark, d):
    return events(spark, d).select(F.col("seq0").alias("event_id"), F.round(normal.cdf(F.col("value"), 50.0, 25.0), 10).alias("p"))


def q_multi_request(spark, d):
    users = events(spark, d).select("stream_id").distinct()
    k = F.explode(F.sequence(F.lit(0), F.lit(9))).alias("k")
    many = users.select("stream_id", k).select(
        F.concat_ws("/", F.col("stream_id").cast("string"), F.col("k").cast("string")).alias("req_id"), "stream_id", (F.lit(T0) + F.col("k") * DAY).alias("t0"), (F.lit(T0) + F.col("k") * DAY + 4 * DAY).alias("t1")
    )
    out = estimate.estimate(windows(spark, d), many, "count")
    return out.select("req_id", *[r4(x).alias(x) for x in ("value", "error", "lower", "upper", "var")])


def _log(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select((F.col("event_id") + 1).alias("index"), F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("data"))


def _kept(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver's Python ends."""
    path = fresh_path(spark, name)
    atexit.register(_drop, spark, path)
    return path


def _drop(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the JVM may be gone already
        pass


def _written_log(spark: SparkSession, d: str) -> Log:
    """The events as records, appended in two batches."""
    log, rows = Log(spark, _kept(spark, "log")), _log(spark, d)
    half = rows.count() // 2
    log.append(rows.where(F.col("index") <= half))
    log.append(rows.where(F.col("index") > half))
    return Log(spark, log.versions.path)


def _records(df: DataFrame) -> DataFrame:
    return df.select("index", F.col("data").cast("string").alias("data"))


def q_wal_read_range(spark, d):
    """The middle half of the log."""
    log = _written_log(spark, d)
    lo, hi = log.bounds()
    return _records(log.scan(lo + (hi - lo + 1) // 4, hi - (hi - lo + 1) // 4))


def q_wal_truncate(spark, d):
    """The log without its first and last quarter."""
    log = _written_log(spark, d)
    lo, hi = log.bounds()
    log.truncate_front(lo + (hi - lo + 1) // 4)
    log.truncate_back(hi - (hi - lo + 1) // 4)
    return _records(Log(spark, log.versions.path).records())


def q_log_replay(spark, d):
    """Estimates from a store that is filled by two replays of a log."""
    e = spark.read.parquet(f"{d}/events.parquet")
    line = F.concat_ws("|", F.col("user_id").cast("string"), ingest.micros("ts").cast("string"), F.col("value").cast("string"), F.col("event_id").cast("string"))
    # numbered in order of time, a day in a task
    one = e.select(F.lit(0).cast("long").alias("stream_id"), ingest.micros("ts").alias("ts"), F.col("event_id").alias("seq0"), "value", line.alias("data"))
    records = ingest.count_markers(one, bucket=DAY).select((F.col("c") + 1).alias("index"), "data")

    def decode(rows: DataFrame) -> DataFrame:
        parts = F.split(F.col("data").cast("string"), r"\|")
        return rows.select(parts[0].cast("long").alias("stream_id"), parts[1].cast("long").alias("ts"), parts[2].cast("double").alias("value"), parts[3].cast("long").alias("seq0"))

    log, path = Log(spark, _kept(spark, "log")), _kept(spark, "store")
    store = Store(spark, path, buckets=8)
    store.create_streams(events(spark, d))
    half = records.count() // 2
    log.append(records.where(F.col("index") <= half))
    replay(log, store, decode)
    log.append(records.where(F.col("index") > half))
    replay(log, Store(spark, path), decode)
    replay(log, Store(spark, path), decode)  # nothing is left to apply
    return _shown(Store(spark, path).query("sum", reqs(spark, d)))


def q_store_append_query(spark, d):
    """Append, reopen, append, query: what comes before T0 + 7 days first, then the rest."""
    path, e = _kept(spark, "store"), events(spark, d)
    store = Store(spark, path, buckets=8)
    store.create_streams(e)
    store.append(e.where(F.col("ts") < T0 + 7 * DAY))
    store.close()
    Store(spark, path).append(e.where(F.col("ts") >= T0 + 7 * DAY))
    return _shown(Store(spark, path).query("sum", reqs(spark, d)))


def q_store_landmarks(spark, d):
    """The windows of a store whose elements came with landmark spans, and estimates with what the landmarks hold."""
    path, e = _kept(spark, "store"), events(spark, d)
    store = Store(spark, path, buckets=8)
    store.create_streams(e)
    store.append(e, spans(spark, d))
    return _shown(Store(spark, path).query("sum", reqs(spark, d)))


def q_store_windows(spark, d):
    """All windows of a store of another schedule, after two appends."""
    path, e = _kept(spark, "store"), events(spark, d)
    store = Store(spark, path, buckets=8)
    store.create_streams(e, POWER)
    store.append(e.where(F.col("ts") < T0 + 7 * DAY))
    store.append(e.where(F.col("ts") >= T0 + 7 * DAY))
    return summarize.window_sizes(Store(spark, path).windows())


def q_incremental_append(spark, d):
    """Half of each stream summarised first, the rest appended to the windows: the same layout and sums."""
    n = numbered(spark, d)
    half = n.where(F.col("c") < F.floor(F.col("n") / 2)).withColumn("n", F.floor(F.col("n") / 2))
    rest = n.where(F.col("c") >= F.floor(F.col("n") / 2))
    return _windows_shown(summarize.coarsen(summarize.summarize(half).unionByName(summarize.singles(rest))))


def q_lineitem_summary(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    tie = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    e = ingest.elements(li, "l_suppkey", ingest.micros("l_shipdate"), "l_quantity", tie)
    return _windows_shown(summarize.summarize(ingest.count_markers(e)))


def q_orders_summary(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    e = ingest.elements(o, "o_custkey", ingest.micros("o_orderdate"), "o_totalprice", ["o_orderkey"])
    return _windows_shown(summarize.summarize(ingest.count_markers(e)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {k[2:]: v for k, v in globals().items() if k.startswith("q_")}
    return {"sum_estimate": flagship, **own}


# -- the same in SQL -------------------------------------------------------------------------------

_E = "e AS (SELECT user_id AS stream_id, event_id, epoch_us(ts) AS ts, value FROM events)"
_SPANS = "sp AS (SELECT stream_id, a AS time_start, b AS time_end FROM (SELECT DISTINCT stream_id FROM e), (VALUES " + ", ".join(f"({a}::BIGINT, {b}::BIGINT)" for a, b in SPANS) + ") v(a, b))"
_REST = "rest AS (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM sp WHERE sp.stream_id = e.stream_id AND e.ts BETWEEN sp.time_start AND sp.time_end))"


def _windows_sql(src: str, order: str = "ts, event_id", name: str = "w") -> str:
    return f"""
 {name}_c AS (SELECT *, count(*) OVER (PARTITION BY stream_id) n, row_number() OVER (PARTITION BY stream_id ORDER BY {order}) - 1 c FROM {src}),
 {name}_r AS (SELECT *, n - ((1::BIGINT << (length(bin(n + 1)) - 1)) - 1) r, n - 1 - c a FROM {name}_c),
 {name}_g AS (SELECT *, length(bin(a + 1)) - 1 j0 FROM {name}_r),
 {name}_h AS (SELECT *, CASE WHEN ((1::BIGINT << j0) - 1) + (r & ((1::BIGINT << j0) - 1)) <= a THEN j0 ELSE j0 - 1 END j FROM {name}_g),
 {name}_k AS (SELECT *, (a - (((1::BIGINT << j) - 1) + (r & ((1::BIGINT << j) - 1)))) >> j m FROM {name}_h),
 {name} AS (SELECT stream_id, min(ts) time_start, max(ts) time_end, min(c) count_start, max(c) count_end,
   count(value)::DOUBLE cnt, sum(value) sm, max(value) mx, min(value) mn FROM {name}_k GROUP BY stream_id, j, m)"""


_W = f"WITH {_E},{_windows_sql('e')}"
_WL = f"WITH {_E}, {_SPANS}, {_REST},{_windows_sql('rest')}, lm AS (SELECT sp.stream_id, sp.time_start, sp.time_end, e.ts, e.value FROM sp LEFT JOIN e ON e.stream_id = sp.stream_id AND e.ts BETWEEN sp.time_start AND sp.time_end)"
_SHOW = "stream_id, time_start, time_end, count_start, count_end, round(cnt, 4) cnt, round(sm, 4) sm, round(mx, 4) mx"


def _estimate_sql(head: str, value: str, mark: str | None = None, z: float | None = Z95, reqs: str | None = None, cols: str = "stream_id, round(mean, 4) + 0.0 AS value, round(hi - lo, 4) + 0.0 AS error, round(lower, 4) + 0.0 AS lower, round(upper, 4) + 0.0 AS upper, round(mean, 4) + 0.0 AS mean, round(var, 4) + 0.0 AS var, round(lo, 4) + 0.0 AS ci_lower, round(hi, 4) + 0.0 AS ci_upper") -> str:
    ov = lambda l1, r1, l2, r2: f"greatest(least({r1}, {r2}) - greatest({l1}, {l2}) + 1, 0)"
    reqs = reqs or f"SELECT DISTINCT stream_id::VARCHAR req_id, stream_id, {T0}::BIGINT t0, {T1}::BIGINT t1 FROM e"
    lo, hi = ("lower", "upper") if z is None else (f"greatest(mean - {z} * sqrt(var), lower)", f"least(mean + {z} * sqrt(var), upper)")
    marks = (
        f"""mk AS (SELECT q.req_id, sum(CASE WHEN ts BETWEEN t0 AND t1 THEN {mark} ELSE 0 END) marked FROM q JOIN lm USING (stream_id) GROUP BY 1),
 nx AS (SELECT q.req_id, min(sp.time_start) nxt FROM q JOIN sp USING (stream_id) WHERE sp.time_start >= t1 GROUP BY 1),
 ls AS (SELECT fl.req_id, fl.t0, fl.t1, fs, fe, las, lae, sp.time_start ms, sp.time_end me FROM fl JOIN sp USING (stream_id) LEFT JOIN nx USING (req_id)
   WHERE sp.time_end >= fl.t0 AND sp.time_start <= coalesce(nxt, fl.t1)),
 ct AS (SELECT req_id, sum(CASE WHEN fs < me THEN {ov('ms', 'me', 'fs', 'fe')} ELSE 0 END) xfl, sum(CASE WHEN fs < me THEN {ov('ms', 'me', 't0', 'fe')} ELSE 0 END) xfo,
   sum(CASE WHEN lae > ms THEN {ov('ms', 'me', 'las', 'lae')} ELSE 0 END) xll, sum(CASE WHEN lae > ms THEN {ov('ms', 'me', 'las', 't1')} ELSE 0 END) xlo FROM ls GROUP BY 1),"""
        if mark else "mk AS (SELECT req_id, 0 marked FROM q), ct AS (SELECT req_id, 0 xfl, 0 xfo, 0 xll, 0 xlo FROM q),"
    )
    return f"""{head}, q AS ({reqs}),
 mt AS (SELECT q.req_id, q.stream_id, q.t0, q.t1, w.time_start, w.time_end, w.count_start, {value} v FROM q JOIN w ON w.stream_id = q.stream_id AND w.time_end >= q.t0 AND w.time_start <= q.t1),
 fl AS (SELECT req_id, stream_id, t0, t1, count(*) nw, sum(v) total, arg_min(time_start, count_start) fs, arg_min(time_end, count_start) fe, arg_min(v, count_start) fv,
   arg_max(time_start, count_start) las, arg_max(time_end, count_start) lae, arg_max(v, count_start) lv FROM mt GROUP BY ALL),
 {marks}
 pc AS (SELECT q.req_id, q.stream_id, coalesce(marked, 0) mark, coalesce(fv, 0) fv, CASE WHEN nw > 1 THEN lv ELSE 0 END lv, coalesce(total, 0) total,
   coalesce(fe - fs + 1, 1) - coalesce(xfl, 0) fln, coalesce({ov('fs', 'fe', 'q.t0', 'q.t1')}, 1) - coalesce(xfo, 0) fov,
   coalesce(lae - las + 1, 1) - coalesce(xll, 0) lln, coalesce({ov('las', 'lae', 'q.t0', 'q.t1')}, 1) - coalesce(xlo, 0) lov
   FROM q LEFT JOIN fl USING (req_id) LEFT JOIN mk USING (req_id) LEFT JOIN ct USING (req_id)),
 es AS (SELECT req_id, stream_id, mark + total AS upper,
   mark + (total - fv - lv) + CASE WHEN fov = fln THEN fv ELSE 0 END + CASE WHEN lov = lln THEN lv ELSE 0 END AS lower,
   mark + (total - fv - lv) + CASE WHEN fov > 0 THEN fv * (fov::DOUBLE / fln) ELSE 0 END + CASE WHEN lov > 0 THEN lv * (lov::DOUBLE / lln) ELSE 0 END AS mean,
   CASE WHEN fov > 0 THEN fv * (fov::DOUBLE / fln) * (1 - fov::DOUBLE / fln) ELSE 0 END + CASE WHEN lov > 0 THEN lv * (lov::DOUBLE / lln) * (1 - lov::DOUBLE / lln) ELSE 0 END AS var FROM pc),
 ci AS (SELECT *, {lo} AS lo, {hi} AS hi FROM es)
SELECT {cols} FROM ci"""


def _full_sql(value: str, error: str = "0.0") -> str:
    return f"SELECT user_id AS stream_id, round({value}, 4) AS value, {error}::DOUBLE AS error FROM events GROUP BY user_id"


def _layout_sql(seq, buffer: int = 0, most: int = 400) -> str:
    """Sizes of the windows for streams of up to `most` elements, as the planner (held to golden tables in the tests) has them."""
    sizes = {n: " ".join(str(b - a + 1) for a, b in spans) for n, spans in layouts(seq, range(1, most + 1), buffer)}
    rows = ", ".join(f"({n}, '{x}')" for n, x in sizes.items())
    return (
        f"WITH l(n, sizes) AS (VALUES {rows}), s AS (SELECT user_id AS stream_id, count(*) n FROM events GROUP BY user_id) "
        "SELECT stream_id, len(string_split(sizes, ' ')) AS n_windows, sizes FROM s JOIN l USING (n)"
    )


def _horner(coefficients: tuple[float, ...], x: str) -> str:
    text = repr(coefficients[0]) + "::DOUBLE"
    for c in coefficients[1:]:
        text = f"({text} * {x} + {c!r}::DOUBLE)"
    return text


def _cdf_sql() -> str:
    small, middle, large = (
        f"({_horner(p, x)} / {_horner(q, x)})" for (p, q), x in ((normal.SMALL, "(v * v)"), (normal.MIDDLE, "y"), (normal.LARGE, "(1 / (y * y))"))
    )
    far = f"exp(-y * y) * ({1 / math.sqrt(math.pi)!r}::DOUBLE - {large} / (y * y)) / y"
    return f"""WITH z AS (SELECT event_id, (value - 50.0) / {25.0 * math.sqrt(2)!r}::DOUBLE v FROM events), a AS (SELECT *, abs(v) y FROM z),
 u AS (SELECT *, CASE WHEN y <= 4 THEN exp(-y * y) * {middle} WHEN y < 27 THEN {far} ELSE 0 END upper FROM a)
SELECT event_id, round(CASE WHEN y <= 0.46875 THEN 0.5 + v * {small} / 2 WHEN v < 0 THEN upper / 2 ELSE 1 - upper / 2 END, 10) AS p FROM u"""


def oracle_sql() -> dict[str, str]:
    markers = f"WITH {_E} SELECT stream_id, event_id, ts, row_number() OVER (PARTITION BY stream_id ORDER BY ts, event_id) - 1 AS c, count(*) OVER (PARTITION BY stream_id) AS n FROM e"
    landmark_max = f"{_WL}, q AS (SELECT DISTINCT stream_id FROM e), a AS (SELECT stream_id, max(mx) m FROM w WHERE time_end >= {T0} AND time_start <= {T1} GROUP BY 1), b AS (SELECT stream_id, max(value) m FROM lm WHERE ts BETWEEN {T0} AND {T1} GROUP BY 1) SELECT stream_id, round(coalesce(greatest(a.m, b.m), -1.7976931348623157e308), 4) AS value, CASE WHEN b.m IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS error, true AS is_upper_bound FROM q LEFT JOIN a USING (stream_id) LEFT JOIN b USING (stream_id)"
    many = f"SELECT stream_id || '/' || k req_id, stream_id, {T0} + k * {DAY}::BIGINT t0, {T0} + k * {DAY}::BIGINT + 4 * {DAY}::BIGINT t1 FROM (SELECT DISTINCT stream_id FROM e), range(10) r(k)"
    landmark_scan = (T0 + 3 * DAY, T0 + 5 * DAY)
    logs = "SELECT event_id + 1 AS index, user_id || '|' || event_type AS data FROM events"
    middle = f"SELECT index, data FROM ({logs}), (SELECT count(*) // 4 AS q, count(*) AS n FROM events) WHERE index BETWEEN 1 + q AND n - q"
    moment = lambda x: f"coalesce(avg({x}), 0)"
    sql = {
        "sum_estimate": _estimate_sql(_W, "sm"),
        "ingest_count_markers": markers,
        "count_markers_two_pass": markers,
        "layout_exp2": f"{_W} SELECT stream_id, count(*) AS n_windows, string_agg((count_end - count_start + 1)::VARCHAR, ' ' ORDER BY count_start) AS sizes FROM w GROUP BY stream_id",
        "summarize_exp2": f"{_W} SELECT {_SHOW} FROM w",
        "incremental_append": f"{_W} SELECT {_SHOW} FROM w",
        "window_merge": f"{_W}, p AS (SELECT *, (row_number() OVER (PARTITION BY stream_id ORDER BY count_start) - 1) // 2 pair FROM w) SELECT stream_id, min(time_start) AS time_start, max(time_end) AS time_end, min(count_start) AS count_start, max(count_end) AS count_end, round(sum(cnt), 4) AS cnt, round(sum(sm), 4) AS sm, round(max(mx), 4) AS mx FROM p GROUP BY stream_id, pair",
        "summary_range_scan": f"{_W} SELECT {_SHOW} FROM w WHERE time_end >= {T0} AND time_start <= {T1}",
        "index_scan": f"{_W}, b AS (SELECT stream_id, max(CASE WHEN time_start <= {T0} THEN time_start END) lo, min(CASE WHEN time_start >= {T1} THEN time_start END) hi FROM w GROUP BY 1) SELECT {_SHOW} FROM w JOIN b USING (stream_id) WHERE time_start >= coalesce(lo, time_start) AND time_start <= coalesce(hi, time_start)",
        "window_count": f"{_W} SELECT stream_id, count(*) AS n_windows FROM w GROUP BY stream_id",
        "point_get": f"{_W} SELECT {_SHOW} FROM w QUALIFY time_start = min(time_start) OVER (PARTITION BY stream_id)",
        "delete_window": f"{_W} SELECT {_SHOW} FROM w QUALIFY time_start > min(time_start) OVER (PARTITION BY stream_id)",
        "count_estimate": _estimate_sql(_W, "cnt"),
        "sum_estimate_sd2": _estimate_sql(_W, "sm", z=2 * Z95),
        "sum_estimate_cl100": _estimate_sql(_W, "sm", z=None),
        "count_full_range": _full_sql("count(*)::DOUBLE"),
        "exp15_full_range": _full_sql("count(*)::DOUBLE"),
        "sum_full_range": _full_sql("sum(value)"),
        "power_full_range": _full_sql("sum(value)"),
        "buffered_full_range": _full_sql("sum(value)"),
        "max_full_range": _full_sql("max(value)", "1.0"),
        "min_estimate": f"{_W}, q AS (SELECT DISTINCT stream_id FROM e), a AS (SELECT stream_id, min(mn) m FROM w WHERE time_end >= {T0} AND time_start <= {T1} GROUP BY 1) SELECT stream_id, round(coalesce(m, 1.7976931348623157e308), 4) AS value, 1.0::DOUBLE AS error, false AS is_upper_bound FROM q LEFT JOIN a USING (stream_id)",
        "max_estimate": landmark_max,
        "landmark_build": f"{_WL} SELECT stream_id, time_start, time_end, count(ts) AS n, coalesce(string_agg(ts::VARCHAR || ':' || printf('%.2f', value), ' ' ORDER BY ts, value), '') AS landmarks FROM lm GROUP BY stream_id, time_start, time_end",
        "landmark_scan": f"{_WL}, a AS (SELECT stream_id, time_start, time_end, count(ts) AS n FROM lm GROUP BY ALL), x AS (SELECT *, min(CASE WHEN time_start >= {landmark_scan[1]} THEN time_start END) OVER (PARTITION BY stream_id) nxt FROM a) SELECT stream_id, time_start, time_end, n FROM x WHERE time_end >= {landmark_scan[0]} AND time_start <= coalesce(nxt, {landmark_scan[1]})",
        "count_landmark": _estimate_sql(_WL, "cnt", mark="1"),
        "sum_landmark": _estimate_sql(_WL, "sm", mark="value"),
        "order_repair": f"WITH RECURSIVE {_E}, o AS (SELECT *, ('0x' || substr(md5(event_id::VARCHAR), 1, 8))::BIGINT * 1000000 + event_id AS arrival FROM e), s AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY arrival) k FROM o), f AS (SELECT stream_id, arrival, k, ts, value FROM s WHERE k = 1 UNION ALL SELECT s.stream_id, s.arrival, s.k, CASE WHEN s.ts < f.ts THEN f.ts + 1 ELSE s.ts END, s.value FROM f JOIN s ON s.stream_id = f.stream_id AND s.k = f.k + 1) SELECT stream_id, arrival, ts, value FROM f",
        "empty_range": "SELECT DISTINCT user_id AS stream_id, v.op, v.value, v.error FROM events, (VALUES ('count', 0.0::DOUBLE, 0.0::DOUBLE), ('sum', 0.0, 0.0), ('max', -1.7976931348623157e308, 1.0)) v(op, value, error)",
        "stream_stats": f"WITH {_E} SELECT stream_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n, round({moment('value')}, 4) AS value_mean, round(coalesce(var_pop(value), 0), 4) AS value_var, round(coalesce(var_samp(value), 0), 4) AS value_sample_var, round(coalesce(stddev_samp(value), 0), 4) AS value_sd, round(coalesce(stddev_samp(value) / avg(value), 0), 4) AS value_cv FROM e GROUP BY stream_id",
        "interval_stats": f"WITH {_E}, g AS (SELECT stream_id, ((ts // 1000000) - lag(ts // 1000000) OVER (PARTITION BY stream_id ORDER BY ts, event_id))::DOUBLE gap FROM e) SELECT stream_id, round({moment('gap')}, 1) AS interval_mean, round(coalesce(var_pop(gap), 0), 1) AS interval_var, round(coalesce(var_samp(gap), 0), 1) AS interval_sample_var, round(coalesce(stddev_samp(gap), 0), 1) AS interval_sd, round(coalesce(stddev_samp(gap) / avg(gap), 0), 4) AS interval_cv FROM g GROUP BY stream_id",
        "normal_pdf": "SELECT event_id, round(exp(-((value - 50.0) / 25.0) * ((value - 50.0) / 25.0) / 2) / (25.0 * sqrt(2 * pi())), 10) AS density FROM events",
        "multi_request": _estimate_sql(_W, "cnt", reqs=many, cols="req_id, round(mean, 4) + 0.0 AS value, round(hi - lo, 4) + 0.0 AS error, round(lower, 4) + 0.0 AS lower, round(upper, 4) + 0.0 AS upper, round(var, 4) + 0.0 AS var"),
        "wal_read_range": middle,
        "wal_truncate": middle,
        "log_replay": _estimate_sql(_W, "sm"),
        "store_append_query": _estimate_sql(_W, "sm"),
        "store_landmarks": _estimate_sql(_WL, "sm", mark="value"),
        "store_windows": _layout_sql(POWER),
        "power_layout": _layout_sql(POWER),
        "exp15_layout": _layout_sql(EXP15),
        "buffered_layout": _layout_sql(Exponential(2.0), 32),
        "normal_cdf": _cdf_sql(),
        "lineitem_summary": "WITH e AS (SELECT l_suppkey AS stream_id, epoch_us(l_shipdate) AS ts, l_quantity AS value, * FROM lineitem)," + _windows_sql("e", "ts, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus") + f" SELECT {_SHOW} FROM w",
        "orders_summary": "WITH e AS (SELECT o_custkey AS stream_id, epoch_us(o_orderdate) AS ts, o_totalprice AS value, o_orderkey FROM orders)," + _windows_sql("e", "ts, o_orderkey, value") + f" SELECT {_SHOW} FROM w",
    }
    return sql


