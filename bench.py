"""Times the headline queries: one JSON line. BENCH_SF_DIR: the tables, BENCH_CPUS: cores."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path
from statistics import median

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "sum_estimate", "count_estimate", "sum_landmark", "max_estimate", "multi_request", "summarize_exp2", "lineitem_summary", "orders_summary",
    "power_full_range", "exp15_full_range", "order_repair", "incremental_append", "stream_stats", "sum_full_range", "power_layout",
)
#: Requests over windows that a store holds already.
REQUESTS = (1, 1_500, 15_000)


def prebuilt(spark, d: str, timed) -> dict[str, float]:
    """Seconds of estimates by number of requests, and of planning the largest, over a store that is filled before."""
    import random
    import tempfile

    from pyspark.sql import functions as F

    from ebbtide import queries as q
    from ebbtide.sources.store import Store

    store, took, rng = Store(spark, "file://" + tempfile.mkdtemp(prefix="bench-") + "/store", buckets=8), {}, random.Random(1)
    e = q.events(spark, d)
    store.create_streams(e)
    store.append(e)
    streams = [r[0] for r in e.select("stream_id").distinct().orderBy("stream_id").collect()]
    for n in REQUESTS:
        starts = [q.T0 + rng.randrange(10) * q.DAY for _ in range(n)]
        rows = [(str(i), streams[i % len(streams)], t, t + 4 * q.DAY) for i, t in enumerate(starts)]
        reqs = rows if n == 1 else spark.createDataFrame(rows, "req_id string, stream_id long, t0 long, t1 long").repartition(F.col("stream_id")).cache()
        took[f"store_query_{n}"] = timed(lambda reqs=reqs: store.query("sum", reqs))
        if n == REQUESTS[-1]:
            began = time.perf_counter()
            store.query("sum", reqs)._jdf.queryExecution().executedPlan()
            took[f"store_query_{n}_plan"] = round(time.perf_counter() - began, 3)
    return took


def main() -> None:
    from pyspark.sql import SparkSession

    from ebbtide import ship
    from ebbtide.queries import queries

    d, cpus, runs = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    found, took = queries(), {}

    def timed(make) -> float:
        times = []
        for _ in range(runs + 1):  # the first compiles
            began = time.perf_counter()
            make().write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        return round(median(times[1:]), 3)

    for name in HEADLINE:
        took[name] = timed(lambda name=name: found[name](spark, d))
    took |= prebuilt(spark, d, timed)
    rows = spark.read.parquet(f"{d}/lineitem.parquet").count()
    kept = found["lineitem_summary"](spark, d).count()
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": d.rstrip("/").rsplit("sf", 1)[-1],
        "elements_per_sec": round(rows / took["lineitem_summary"]), "elements_per_window": round(rows / kept, 1),
    }))


if __name__ == "__main__":
    main()
