"""A corpus from raw documents: quality, near-duplicates, repeated passages, benchmark leaks, mixture.

Each stage works on all that the one before it kept; run() writes every stage's result as Parquet in the
shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.llm import common, leaks, minhash, mixing, passages, quality
from ebbtide.llm.queries import TARGET


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the line classifier rejects."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8 or more) the document with the smallest doc_id; rows with a null doc_id stay."""
    return minhash.without_copies(docs, words=5, num=80, den=100)


def distinct_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages cut from all documents but the first that holds them; n_chars follows the text."""
    return passages.without_repeats(docs).withColumn("n_chars", F.length("text").cast("long"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item."""
    return leaks.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order that mixes sources to their target weights."""
    return mixing.mixed(docs, TARGET).orderBy("mix_position")


STAGES = [
    ("quality classifier", good_quality),
    ("near-dedup", distinct_documents),
    ("substring dedup", distinct_passages),
    ("decontamination", without_benchmark),
    ("mixing", mixture),
]
#: No SQL expresses the classifier; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with common.scratch_scope(spark):  # what a stage writes for itself goes with it
            made = stage(spark, docs, sf_dir)
            docs = common.materialise(made, "stage-" + name.replace(" ", "-"), scoped=False)
        if before is not None:
            common.drop_scratch(before)
        before = docs
    return docs
