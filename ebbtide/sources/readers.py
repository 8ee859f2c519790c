"""Elements from files, tables and streams: Spark's own readers, projected to (stream_id, ts, value, seq...)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T

from ebbtide.operators.ingest import elements, micros


def read(spark: SparkSession, path: str | list[str], stream: str | Column, ts: str, value: str | Column, tie: Sequence[str | Column] = (), fmt: str = "parquet", **options: str) -> DataFrame:
    """Batch source; a timestamp column becomes microseconds, an integer one is taken as it is."""
    return _project(spark.read.format(fmt).options(**options).load(path), stream, ts, value, tie)


def read_stream(spark: SparkSession, path: str, schema: str | T.StructType, stream: str | Column, ts: str, value: str | Column, tie: Sequence[str | Column] = (), fmt: str = "parquet", **options: str) -> DataFrame:
    """Streaming source; back-pressure by maxFilesPerTrigger or maxBytesPerTrigger among the options."""
    return _project(spark.readStream.format(fmt).schema(schema).options(**options).load(path), stream, ts, value, tie)


def _project(df: DataFrame, stream: str | Column, ts: str, value: str | Column, tie: Sequence[str | Column]) -> DataFrame:
    kind = df.schema[ts].dataType
    return elements(df, stream, micros(ts) if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) else ts, value, tie)
