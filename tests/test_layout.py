import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ebbtide.plans.layout import Layout, Planner, buffered_spans, exp2_key, layouts
from ebbtide.plans.sequences import Exponential, Power, from_json, to_json

EXP2 = {1: "1", 3: "2 1", 6: "2 2 1 1", 7: "4 2 1", 15: "8 4 2 1", 22: "8 4 4 2 2 1 1", 31: "16 8 4 2 1"}
POWER = {1: "1", 3: "1 1 1", 6: "2 1 1 1 1", 7: "2 1 1 1 1 1", 15: "2 2 2 2 2 1 1 1 1 1", 22: "2 2 2 2 2 2 2 2 2 1 1 1 1"}


def sizes(seq, n):
    return " ".join(str(b - a + 1) for a, b in dict(layouts(seq, [n]))[n])


@pytest.mark.parametrize(("seq", "golden"), [(Exponential(2.0), EXP2), (Power(1, 1, 4, 1), POWER)])
def test_layout_goldens(seq, golden):
    assert {n: sizes(seq, n) for n in golden} == golden


def test_window_counts():
    assert {n: len(w) for n, w in layouts(Exponential(2.0), [66, 90, 100, 1000, 5000, 10000])} == {66: 8, 90: 10, 100: 9, 1000: 15, 5000: 17, 10000: 18}


@pytest.mark.parametrize(("seq", "n", "once", "twice"), [
    (Power(1, 1, 10, 1), 5000, 442, 598), (Power(1, 1, 10, 1), 10000, 598, 910), (Exponential(2.0), 5000, 16, 18), (Exponential(2.0), 10000, 18, 20), (Exponential(1.5), 10000, 33, 35),
])
def test_windows_kept_by_buffered_ingest(seq, n, once, twice):
    """n elements through a buffer of 32, then, after a flush, n more."""
    run = Layout(Planner(seq))
    for kept in (once, twice):
        for lo, hi in buffered_spans(seq, n, 32):
            run.append(hi - lo + 1)
        assert len(run.spans()) == kept
    assert len(dict(layouts(seq, [n], buffer=32))[n]) == once


def test_buffers_are_cut_largest_first():
    four = Power(1, 1, 1, 2)  # lengths 2, 4, 6, 8
    sizes = lambda n, b: [y - x + 1 for x, y in buffered_spans(four, n, b)]
    assert sizes(20, 20) == [8, 6, 4, 2] and sizes(30, 20) == [8, 6, 4, 2, 4, 2, 1, 1, 1, 1]
    both = dict(layouts(four, [7, 20, 33, 60], buffer=20))
    assert all(dict(layouts(four, [n], buffer=20))[n] == both[n] for n in both)


def test_first_containing_time():
    p = Planner(Exponential(2.0))
    assert [p.first_containing_time(*x) for x in ((98, 99, 100), (96, 99, 100), (92, 99, 100), (84, 99, 100), (80, 100, 200))] == [101, 103, 107, 115, 200]
    assert p.first_containing_time(0, 2**33, 2**33) is None


def test_covering_and_cutting():
    assert Planner(Exponential(2.0)).covering(62) == [1, 2, 4, 8, 16]
    assert Planner(Exponential(2.0)).covering(63) == [1, 2, 4, 8, 16, 32]
    assert Planner(Exponential(2.0)).covering(0) == []
    assert Planner(Power(1, 1, 1, 2)).cut(20) == [8, 6, 4, 2]
    assert Planner(Power(1, 1, 1, 2)).first_window_size == 2


def test_sequences():
    assert list(itertools.islice(Power(1, 1, 10, 1).lengths(), 100)) == [i // 10 + 1 for i in range(100)]
    for s in (Exponential(1.5), Power(2, 1, 3, 4)):
        assert from_json(to_json(s)) == s
    for bad in (lambda: Exponential(1.0), lambda: Power(0, 1, 1, 1), lambda: from_json('{"kind": "linear"}')):
        with pytest.raises(ValueError):
            bad()


def test_sequences_hold_no_position():
    s = Exponential(2.0)
    next(s.lengths())
    assert list(itertools.islice(s.lengths(), 3)) == [1, 2, 4]


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 400), st.sampled_from([Exponential(1.5), Exponential(3.0), Power(1, 1, 3, 2), Power(2, 1, 2, 1)]))
def test_layouts_are_contiguous_and_resume(n, seq):
    spans = dict(layouts(seq, [n]))[n]
    assert [a for a, _ in spans] == [0, *[b + 1 for _, b in spans[:-1]]] and spans[-1][1] == n - 1
    run = Layout(Planner(seq), dict(layouts(seq, [n]))[n])
    for _ in range(25):
        run.append()
    assert run.spans() == dict(layouts(seq, [n + 25]))[n + 25]


def test_closed_form_is_the_planner(spark):
    counts = [*range(1, 70), 127, 128, 500, 777]
    df = spark.createDataFrame([(n,) for n in counts], "n long").withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    j, m = exp2_key(F.col("c"), F.col("n"))
    got = df.groupBy("n", j.alias("j"), m.alias("m")).agg(F.min("c").alias("a"), F.max("c").alias("b")).collect()
    by = {}
    for r in got:
        by.setdefault(r.n, []).append((r.a, r.b))
    assert {n: sorted(x) for n, x in by.items()} == dict(layouts(Exponential(2.0), counts))
