import numpy as np
import pytest

from ebbtide.llm import queries, vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def sample(seed=0):
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    for _ in range(40):
        base = rng.normal(size=16)
        for _ in range(rng.integers(1, 8)):
            rows.append((i, [float(np.float32(x)) for x in base + rng.normal(size=16) * rng.choice([0, 0.05, 0.2, 0.3])], int(rng.integers(2))))
            i += 1
    nan = float("nan")
    rows += [(i, None, 1), (i + 1, [0.0] * 16, 1), (i + 2, [nan] + [1.0] * 15, 1), (i + 3, [float("inf")] + [1.0] * 15, 1), (i + 4, [1.0] * 16, None), (i + 5, [1.0] * 16, None)]
    rows += [(i + 6, [], 1), (i + 7, [None] + [1.0] * 15, 1), (i + 8, [1.0, 2.0], 1), (i + 9, [2.0, 4.0], 1), (None, rows[0][1], rows[0][2]), (i + 10, [1e30] * 16, 1), (i + 11, [1e-30] * 16, 1)]
    return rows


def brute(rows, limit=0.93):
    ok = [r for r in rows if r[0] is not None and r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    n, par = {r[0]: 0 for r in rows}, {r[0]: r[0] for r in rows}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for a in range(len(ok)):
        for b in range(a):
            x, y = np.array(ok[a][1], np.float64), np.array(ok[b][1], np.float64)
            if ok[a][2] == ok[b][2] and len(x) == len(y) and (x / np.abs(x).max()) @ (y / np.abs(y).max()) / np.linalg.norm(x / np.abs(x).max()) / np.linalg.norm(y / np.abs(y).max()) >= limit:
                n[ok[a][0]] += 1
                n[ok[b][0]] += 1
                p, q = find(ok[a][0]), find(ok[b][0])
                par[max(p, q)] = min(p, q)
    return n, {i: find(i) for i in par}


@pytest.mark.parametrize("block", [1000, 4])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", block)
    rows = sample()
    got = vectors.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    n, comp = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_links, r.component_id, r.kept) == (n[r.vec_id], comp[r.vec_id], comp[r.vec_id] == r.vec_id), r


def test_recall_and_odd_tables(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    assert vectors.near_duplicates(df).count() == 500
    assert vectors.near_duplicates(df.limit(0)).count() == 0
    twice = vectors.near_duplicates(df.unionByName(df).selectExpr("*", "1 AS dim", "2 AS id", "3 AS component")).collect()
    assert len(twice) == 1000 and all(r.n_links >= 1 for r in twice)
    doubles = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [1.0, 0.1], 1)], "vec_id long, embedding array<double>, label int")
    assert [r.n_links for r in vectors.near_duplicates(doubles).collect()] == [1, 1]


def test_plan_follows_the_label():
    assert vectors.plan(10, 0.93, 1e-3)[0] < vectors.plan(10**6, 0.93, 1e-3)[0] and vectors.plan(0, 0.93, 1e-3)[1] >= 1


@pytest.mark.parametrize("name", ["op1_minhash_near_dedup", "op7_embedding_near_dedup", "op8_substring_dedup"])
def test_same_rows_in_any_number_of_partitions(spark, name):
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = []
        for n in (1, 24):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            rows.append(sorted(map(str, queries.queries()[name](spark, "/root/testdata/sf0.001").collect())))
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert rows[0] == rows[1] and rows[0]
