import pytest
from pyspark.sql import functions as F

from ebbtide.operators.log import Log, replay
from ebbtide.plans.layout import layouts
from ebbtide.plans.sequences import Exponential, Power
from ebbtide.sources import readers
from ebbtide.sources.store import Store
from ebbtide.streaming import ingest as live


def rows(spark, a, b, stream=0):
    return spark.createDataFrame([(stream, i, float(i)) for i in range(a, b)], "stream_id long, ts long, value double")


def ask(store, op, t0=0, t1=99, stream=0):
    return store.query(op, [("r", stream, t0, t1)]).first()


def test_append_reopen_append(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    store = Store(spark, path)
    assert store.create_streams() == [0]
    store.append(rows(spark, 0, 50))
    assert (ask(store, "count").value, ask(store, "sum").value) == (50, 1225)
    store.close()
    with pytest.raises(RuntimeError):
        store.append(rows(spark, 50, 51))
    store = Store(spark, path)
    store.append(rows(spark, 50, 100))
    assert (ask(store, "count").value, ask(store, "sum").value, ask(store, "sum").error) == (100, 4950, 0)
    assert store.windows().count() == 9
    assert store.create_streams(n=2) == [1, 2]
    assert store.stream(1)["sequence"] == Exponential(2.0)
    store.versions.vacuum()
    assert ask(Store(spark, path), "max").value == 99


def test_landmarks(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.create_streams([0])
    store.append(rows(spark, 0, 90))
    store.start_landmark(0, 90)
    with pytest.raises(ValueError):
        store.start_landmark(0, 91)
    store.append(rows(spark, 90, 100))
    assert ask(store, "count").value == 90  # an open landmark is not seen
    store.end_landmark(0, 99)
    assert (ask(store, "count").value, ask(store, "sum").value, store.windows().count()) == (100, 4950, 10)
    with pytest.raises(ValueError):
        store.end_landmark(0, 99)
    store.delete_landmarks(store.landmarks())
    assert ask(store, "count").value == 90


def test_kinds_of_streams_and_errors(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.create_streams([5])
    store.create_streams([7], Power(1, 1, 4, 1))
    store.append(rows(spark, 0, 22, 5).union(rows(spark, 0, 22, 7)))
    sizes = {s: [r[0] for r in store.windows().where(F.col("stream_id") == s).orderBy("count_start").select(F.col("count_end") - F.col("count_start") + 1).collect()] for s in (5, 7)}
    assert sizes == {5: [8, 4, 4, 2, 2, 1, 1], 7: [2] * 9 + [1] * 4}
    store.delete_windows(store.windows().where("stream_id = 5").orderBy("time_start").limit(1))
    assert ask(store, "count", stream=5).value == 14
    for bad, kind in ((lambda: store.append(rows(spark, 0, 1, 9)), KeyError), (lambda: store.stream(9), KeyError), (lambda: store.create_streams([7]), ValueError), (lambda: store.create_streams([8], ops=["median"]), ValueError)):
        with pytest.raises(kind):
            bad()
    store.register_views("s_")
    assert spark.sql("SELECT count(*) FROM s_windows WHERE stream_id = 7").first()[0] == 13


def test_only_touched_parts_are_written(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    store = Store(spark, path, buckets=4)
    store.create_streams(range(12), Power(1, 1, 4, 1))
    everything = rows(spark, 0, 30, 0)
    for s in range(1, 12):
        everything = everything.union(rows(spark, 0, 30, s))
    store.append(everything)
    before = store.versions.current()[1]["tables"]
    store = Store(spark, path)
    assert store.buckets == 4
    store.append(rows(spark, 30, 45, 3), spark.createDataFrame([(3, 33, 36)], "stream_id long, time_start long, time_end long"))
    after = store.versions.current()[1]["tables"]
    assert sum(before[k] != after[k] for k in before if k.startswith("windows#")) == 1
    store.versions.vacuum()
    assert {s: ask(store, "count", stream=s).value for s in (0, 3, 11)} == {0: 30, 3: 45, 11: 30}
    got = [r[0] for r in store.windows().where("stream_id = 3").orderBy("count_start").select(F.col("count_end") - F.col("count_start") + 1).collect()]
    want = [b - a + 1 for a, b in dict(layouts(Power(1, 1, 4, 1), [41]))[41]]
    assert got == want
    store.append(rows(spark, 0, 0, 0), meta={"seen": 1})
    assert store.versions.current()[1]["meta"] == {"buckets": 4, "seen": 1}


def test_replay_applies_every_record_once(spark, tmp_path):
    log, store = Log(spark, f"file://{tmp_path}/log"), Store(spark, f"file://{tmp_path}/s", buckets=2)
    store.create_streams([0])
    batch = lambda a, b: spark.createDataFrame([(i, str(i).encode()) for i in range(a, b)], "index long, data binary")
    decode = lambda r: r.select(F.lit(0).cast("long").alias("stream_id"), F.col("index").alias("ts"), F.col("data").cast("string").cast("double").alias("value"))
    assert replay(log, store, decode) == 0
    log.append(batch(1, 11))
    assert replay(log, store, decode) == replay(log, Store(spark, f"file://{tmp_path}/s"), decode) == 10
    log.append(batch(11, 21))
    log.truncate_front(5)
    assert replay(log, store, decode) == 20 and (ask(store, "count").value, ask(store, "sum").value) == (20, 210)
    log.append(batch(21, 31))
    log.truncate_front(25)
    with pytest.raises(ValueError):
        replay(log, store, decode)


def test_stream_without_data(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    Store(spark, path).create_streams([3])
    assert ask(Store(spark, path), "sum", stream=3).value == 0


def test_log(spark, tmp_path):
    log = Log(spark, f"file://{tmp_path}/log")
    batch = lambda a, b: spark.createDataFrame([(i, f"data-{i}".encode()) for i in range(a, b)], "index long, data binary")
    assert log.bounds() == (0, 0)
    log.append(batch(1, 50))
    log.append(batch(50, 60))
    for bad in (batch(61, 62), batch(59, 61), batch(60, 62).union(batch(63, 64))):
        with pytest.raises(ValueError):
            log.append(bad)
    assert log.read(17) == b"data-17" and log.bounds() == (1, 59) and log.scan(3, 5).count() == 3
    log.truncate_front(10)
    log.truncate_back(40)
    assert log.bounds() == (10, 40)
    with pytest.raises(KeyError):
        log.read(9)
    with pytest.raises(ValueError):
        log.truncate_front(99)
    assert Log(spark, f"file://{tmp_path}/log").bounds() == (10, 40)


@pytest.mark.parametrize("seq", [Exponential(2.0), Power(1, 1, 4, 1)])
def test_streaming_equals_batch(spark, tmp_path, seq):
    from ebbtide.operators import ingest, summarize

    src = f"{tmp_path}/in"
    for k in range(3):
        spark.createDataFrame([(s, 100 * k + i, float(i)) for s in (1, 2) for i in range(20)], "stream_id long, ts long, value double").coalesce(1).write.parquet(f"{src}/part={k}")
    df = spark.readStream.schema("stream_id long, ts long, value double").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(src)
    q = live.start(df, f"{tmp_path}/out", f"{tmp_path}/cp", seq)
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = live.latest(spark, f"{tmp_path}/out")
    everything = spark.read.option("recursiveFileLookup", "true").schema("stream_id long, ts long, value double").parquet(src)
    want = summarize.summarize(ingest.count_markers(everything), seq)
    cols = ["stream_id", "time_start", "time_end", "count_start", "count_end", "count", "sum", "max"]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))


def test_late_elements_are_restamped():
    from ebbtide.plans.layout import Planner

    s = live.Stream(Planner(Exponential(2.0)))
    for ts in (10, 4, 4, 30):
        s.append(ts, 1.0)
    assert s.sorted()[-1][1] == 30 and s.last == 30 and sum(r[4] for r in s.sorted()) == 4 and s.rows[0][0] == 10


def test_readers(spark):
    d = "/root/testdata/sf0.001"
    e = readers.read(spark, f"{d}/events.parquet", "user_id", "ts", "value", ["event_id"])
    assert e.columns == ["stream_id", "ts", "value", "seq0"] and e.count() == 1000
    assert readers.read_stream(spark, f"{d}/", "user_id long, ts timestamp, value double", "user_id", "ts", "value", pathGlobFilter="events*").isStreaming
