import math

import pytest
from pyspark.sql import functions as F

from ebbtide.functions import normal, stats
from ebbtide.operators import estimate, ingest, scan, summarize
from ebbtide.operators.summarize import Op
from ebbtide.plans.sequences import Exponential, Power

WINDOW = "stream_id long, time_start long, time_end long, count_start long, count_end long, count double, sum double, max double"
MARKS = [(1, 2, 5, [(3, 1.0)]), (1, 5, 9, [(6, 1.0), (7, 1.0), (8, 1.0)])]


def windows(spark, skip=()):
    return spark.createDataFrame([(1, 5 * i, 5 * i + 4, i, i, 1.0, 1.0, 1.0) for i in range(5) if i not in skip], WINDOW)


def one(spark, w, op, t0, t1, marks=None, **kw):
    lm = spark.createDataFrame(marks, estimate.LANDMARKS) if marks is not None else None
    rows = estimate.estimate(w, estimate.requests(spark, [("r", 1, t0, t1)]), op, lm, **kw).collect()
    assert len(rows) == 1
    return rows[0]


def test_goldens(spark):
    r = one(spark, windows(spark), "sum", 3, 21)
    assert (r.lower, r.upper) == (3, 5) and r.mean == pytest.approx(3.8) and r["var"] == pytest.approx(0.48)
    r = one(spark, windows(spark, (2,)), "sum", 1, 21, MARKS)
    assert (r.lower, r.upper) == (6, 8) and r.mean == pytest.approx(6.9) and r["var"] == pytest.approx(0.49)
    r = one(spark, windows(spark, (2,)), "count", 1, 21, MARKS, confidence=0.5)
    assert r.value == pytest.approx(6.9) and r.error == pytest.approx(0.9442857, abs=1e-6)


def test_infinite_quantile_gives_bounds(spark):
    r = one(spark, windows(spark), "sum", 3, 21, confidence=1.0)
    assert (r.ci_lower, r.ci_upper) == (3, 5)


def test_max_and_its_error_flag(spark):
    w = spark.createDataFrame([(1, 0, 9, 0, 9, 10.0, 45.0, 9.0), (1, 10, 19, 10, 19, 10.0, 145.0, 19.0)], WINDOW)
    r = one(spark, w, "max", 3, 12)
    assert (r.value, r.error, r.is_upper_bound) == (19.0, 1.0, True)
    assert one(spark, w, "max", 3, 12, [(1, 4, 6, [(5, 2.0)])]).error == 0.0
    assert one(spark, w, "max", 3, 5, [(1, 4, 6, [(5, 99.0)])]).value == 99.0


def test_nothing_met_is_the_identity(spark):
    for op in ("count", "sum", "max"):
        r = one(spark, windows(spark), op, 1000, 2000)
        assert {"value": r.value, "error": r.error} == dict(estimate.empty(op))
    none = spark.createDataFrame([], WINDOW)
    assert one(spark, none, "sum", 0, 9).value == 0


def test_edge_covered_by_a_landmark(spark):
    """Length and overlap both 0: the sum counts in the bounds, not in the mean."""
    w = spark.createDataFrame([(1, 0, 4, 0, 0, 1.0, 5.0, 5.0), (1, 10, 14, 1, 1, 1.0, 7.0, 7.0)], WINDOW)
    r = one(spark, w, "sum", 0, 14, [(1, 0, 4, [])])
    assert (r.lower, r.upper, r.mean) == (12, 12, 7)


def test_landmark_in_a_gap_before_the_first_window(spark):
    """Clipped at t0, not at the window's start: the overlap shrinks, the length doesn't."""
    w = spark.createDataFrame([(1, 10, 19, 0, 9, 10.0, 10.0, 1.0), (1, 20, 29, 10, 19, 10.0, 10.0, 1.0)], WINDOW)
    r = one(spark, w, "sum", 5, 29, [(1, 5, 12, [])])
    assert r.mean == pytest.approx(10 + 10 * 2 / 7)


def test_touching_landmarks_are_not_subtracted(spark):
    w = spark.createDataFrame([(1, 5, 9, 0, 4, 5.0, 5.0, 1.0)], WINDOW)
    assert one(spark, w, "sum", 5, 9, [(1, 2, 5, [])]).mean == 5


def test_negative_sum_has_no_deviation(spark):
    w = spark.createDataFrame([(1, 0, 9, 0, 9, 10.0, -10.0, 1.0)], WINDOW)
    assert math.isnan(one(spark, w, "sum", 0, 4).error)


def test_unknown_operator(spark):
    with pytest.raises(ValueError):
        one(spark, windows(spark), "median", 0, 1)


def series(spark, n, value=lambda i: float(i)):
    return spark.createDataFrame([(1, i, value(i)) for i in range(n)], "stream_id long, ts long, value double")


def test_end_to_end(spark):
    w = summarize.summarize(ingest.count_markers(series(spark, 100))).cache()
    assert w.count() == 9
    for op, want in (("count", 100), ("sum", 4950), ("max", 99)):
        r = one(spark, w, op, 0, 99)
        assert r.value == want and (op == "max" or r.error == 0)


def test_end_to_end_with_landmark(spark):
    spans = spark.createDataFrame([(1, 90, 99)], "stream_id long, time_start long, time_end long")
    rest, marks = ingest.split_landmarks(series(spark, 100), spans)
    w = summarize.summarize(ingest.count_markers(rest))
    assert w.count() == 10
    for op, want in (("count", 100), ("sum", 4950)):
        r = estimate.estimate(w, estimate.requests(spark, [("r", 1, 0, 99)]), op, marks).first()
        assert r.value == want and r.error == 0


@pytest.mark.parametrize("seq", [Power(1, 1, 10, 1), Exponential(1.5), Exponential(2.0)])
def test_full_range_is_exact_and_appends_agree(spark, seq):
    n = 300
    all_ = ingest.count_markers(series(spark, n, lambda i: 2.0 * i))
    w = summarize.summarize(all_, seq)
    assert one(spark, w, "sum", 0, n).value == n * (n - 1) and one(spark, w, "max", 0, n).value == 2 * (n - 1)
    half = all_.where("c < 150").withColumn("n", F.lit(150).cast("long"))
    grown = summarize.coarsen(summarize.summarize(half, seq).unionByName(summarize.singles(all_.where("c >= 150"))), seq)
    assert sorted(map(tuple, grown.collect())) == sorted(map(tuple, w.collect()))


def test_null_values_count_in_spans_only(spark):
    df = spark.createDataFrame([(1, 0, None), (1, 1, 2.0), (None, 1, 2.0), (1, None, 2.0)], "s long, t long, v double")
    w = summarize.summarize(ingest.count_markers(ingest.elements(df, "s", "t", "v"))).agg(F.sum("count"), F.sum("sum"), F.max("count_end")).first()
    assert tuple(w) == (1.0, 2.0, 1)


def test_user_defined_operator(spark):
    squares = Op("squares", lambda v: F.sum(v * v), F.sum, 0.0, "sum")
    w = summarize.summarize(ingest.count_markers(series(spark, 5)), ops=("count", squares))
    assert one(spark, w, squares, 0, 4).value == 30


def test_scans(spark):
    w = windows(spark)
    assert scan.range_scan(w, 6, 16).count() == 3 and scan.delete_range(w, 6, 16).count() == 2
    assert sorted(r[0] for r in scan.index_scan(w, 8, 15).select("time_start").collect()) == [5, 10, 15]
    assert sorted(r[0] for r in scan.index_scan(w.where("time_start <> 15"), 5, 15).select("time_start").collect()) == [5, 10, 20]
    lm = spark.createDataFrame([(1, 3 * i, 3 * i + 2, [(3 * i + 1, float(i))]) for i in range(3)], estimate.LANDMARKS)
    assert scan.landmark_scan(lm, 1, 3).count() == 2
    five = spark.createDataFrame([(1, 5 * i, 5 * i + 4, i, i, 1.0, 2.0 * i + 1, 2.0 * i + 1) for i in range(5)], WINDOW)
    r = summarize.merge_windows(scan.range_scan(five, 1, 23), ["stream_id"]).first()
    assert (r.time_end, r["count"], r["max"], r["sum"]) == (24, 5, 9, 25)
    assert scan.point_get(w, w.where("stream_id = 1 and time_start = 10")).count() == 1 and scan.window_count(w).first().n_windows == 5


def test_order_repair(spark):
    ts = [10, 5, 7, 11, 20, 20, 3, -4]
    df = spark.createDataFrame([(s, t, 1.0, i) for s in (1, 2) for i, t in enumerate(ts)], "stream_id long, ts long, value double, seq0 long")
    got = ingest.repair_order(df).where("stream_id = 2").orderBy("seq0").collect()
    assert [r.ts for r in got] == [10, 11, 12, 13, 20, 20, 21, 22]


def test_two_pass_markers_agree(spark):
    df = spark.createDataFrame([(i % 3, (i * 37) % 50, 1.0, i) for i in range(200)], "stream_id long, ts long, value double, seq0 long")
    a, b = ingest.count_markers(df), ingest.count_markers(df, bucket=7)
    assert sorted(map(tuple, a.select(*sorted(a.columns)).collect())) == sorted(map(tuple, b.select(*sorted(a.columns)).collect()))


def test_moments(spark):
    r = spark.range(1, 100).agg(*stats.moments("id")).first()
    assert r["mean"] == 50 and r["var"] == pytest.approx(816.6667, abs=1e-4) and r["sample_var"] == 825 and r["cv"] == pytest.approx(0.5744563, abs=1e-6)
    assert [x or 0 for x in spark.range(0).agg(*stats.moments("id")).first()] == [0] * 6
    s = stats.stream_statistics(spark.createDataFrame([(1, 1, 1.0), (1, 4, 3.0), (1, 9, 5.0)], "stream_id long, ts long, value double")).first()
    assert (s.first_ts, s.last_ts, s.n, s.interval_mean, s.value_mean) == (1, 9, 3, 4, 3)


def test_normal(spark):
    assert normal.inv_cdf(0.975) == pytest.approx(1.959963984540054) and normal.inv_cdf(0) == -math.inf and normal.inv_cdf(1) == math.inf and math.isnan(normal.inv_cdf(2))
    r = spark.range(1).select(normal.pdf(F.lit(0.0)).alias("d"), normal.cdf(F.lit(1.96)).alias("p")).first()
    assert r.d == pytest.approx(0.3989423) and r.p == pytest.approx(0.9750021)
    assert normal.bounds(1, 2) == (-5, 7)


def test_plan_has_one_exchange(spark):
    plan = summarize.summarize(ingest.count_markers(series(spark, 50)))
    plan.collect()
    assert plan._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange hashpartitioning") == 1
