"""The stages, one after the other, on what tables can hold; and the queries with SQL against it."""

import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from ebbtide.llm import leaks, minhash, passages, quality, queries
from tests.llm.test_text_operators import DOCS, coverage, prose

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    rng = random.Random(2)
    rows = [(i, prose(rng, 60, 10**6), "en", f"src{i % 4}") for i in range(40)]
    rows += [(40 + i, rows[i][1], "en", "src0") for i in range(3)]  # copies
    rows += [(43, rows[5][1] + " one more", "en", "src1"), (44, "zz!! " * 60, "en", "src2"), (45, "$$$ ### %%% &&& | " * 30, "en", "src2")]
    passage = prose(rng, 60, 10**6)
    rows += [(50 + i, prose(rng, 45, 10**6) + " " + passage + " " + prose(rng, 40, 10**6), "en", "src0") for i in range(4)]
    item = prose(rng, 30, 10**6)
    rows += [(60, prose(rng, 30, 10**6) + " " + item.upper() + " end", "en", "src3"), (70, None, None, None), (71, "", None, "src9"), (None, prose(rng, 50, 10**6), None, None)]
    df = spark.createDataFrame([(i, t, lang, s, len(t) if t is not None else None) for i, t, lang, s in rows], DOCS)
    df.write.parquet(f"{at}/documents.parquet")
    marks = [(i, 1, 0) for i in range(40)] + [(44, 0, 0), (45, 0, 0)] + [(1000 + i, 0, 0) for i in range(9)] + [(None, 1, None), (3, None, 0)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (None, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names, steps = [s[0] for s in pipeline.STAGES], {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, folder)
        docs = spark.createDataFrame(out.collect(), out.schema)
        steps[name] = {r.doc_id: r for r in docs.collect()}
        if name != names[-1]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    good, near, cut, clean, mixed = (steps[n] for n in names)
    assert set(range(40)) | {50, 51, 52, 53, 60, 70, 71, None} <= set(good) and not {44, 45} & set(good)
    assert set(good) - set(near) == {40, 41, 42, 43} & set(good)
    assert set(cut) == set(near) and cut[50].text == near[50].text
    assert all(len(cut[i].text) < len(near[i].text) and cut[i].n_chars == len(cut[i].text) for i in (51, 52, 53))
    assert not coverage([(r.doc_id, r.text) for r in cut.values()], 51)
    assert set(clean) == set(cut) - {60}
    assert set(mixed) == set(clean) and sorted(r.mix_position for r in mixed.values()) == list(range(len(clean)))


def test_run_is_the_stages(spark, folder):
    out = pipeline.run(spark, folder)
    assert [r.mix_position for r in out.collect()] == list(range(out.count()))
    assert {50, 0, None} <= {r.doc_id for r in out.collect()}


def test_stages_of_empty_and_wider_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0
        wide = stage(spark, docs.withColumns({"score": F.lit(1), "id": F.lit("x"), "kept": F.lit(None).cast("string"), "gone_spans": F.lit(0), "gone_id": F.lit("y"), "copy_id": F.lit("y"), "leak_id": F.lit("z"), "m_hash": F.lit("q"), "component_id": F.lit(2)}), folder)
        assert {"score", "id", "kept", "gone_spans", "copy_id", "leak_id", "m_hash", "component_id"} <= set(wide.columns) and wide.count() > 30


def test_all_of_one_stage_gone(spark, folder):
    only = spark.createDataFrame([(1, "same words again and again here " * 10, "en", "a", 1), (2, "same words again and again here " * 10, "en", "a", 1)], DOCS)
    assert [r.doc_id for r in pipeline.distinct_documents(spark, only, folder).collect()] == [1]
    left = pipeline.distinct_passages(spark, only, folder).collect()
    assert [r.doc_id for r in left] == [1]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        at = f"/root/testdata/sf0.001/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{at + '/*' if os.path.isdir(at) else at}')")
    return c


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_against_sql(spark, con, name):
    df = queries.queries()[name](spark, "/root/testdata/sf0.001")
    got = sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)
    out = con.execute(queries.oracle_sql()[name])
    cols = [x[0] for x in out.description]
    order = sorted(range(len(cols)), key=cols.__getitem__)
    assert sorted(cols) == sorted(df.columns) and got == sorted((tuple(r[i] for i in order) for r in out.fetchall()), key=str)


def test_all_are_registered():
    found = entry.queries()
    assert {f"op{n}_" for n in range(1, 11)} == {x.split("_")[0] + "_" for x in found if x.startswith("op")} and "pipeline" in found


def test_stages_are_the_operators_whole(spark):
    """On a real table: each stage keeps what its operator's own result says."""
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    scores = quality.score(docs, spark.read.parquet(f"{d}/labels.parquet"))
    assert ids(pipeline.good_quality(spark, docs, d)) == ids(scores.where("predicted = 1"))
    assert ids(pipeline.distinct_documents(spark, docs, d)) == ids(minhash.near_duplicates(docs, words=5, num=80, den=100).where("kept"))
    assert ids(pipeline.without_benchmark(spark, docs, d)) == ids(docs) - ids(leaks.leaks(docs, spark.read.parquet(f"{d}/benchmark.parquet")))
    spans = passages.repeated(docs).where("not kept").select("doc_id").distinct()
    before = {r.doc_id: r.text for r in docs.collect()}
    after = {r.doc_id: r.text for r in pipeline.distinct_passages(spark, docs, d).collect()}
    assert {i for i in before if before[i] != after.get(i)} == ids(spans)
