"""A log of consecutively numbered records as immutable Parquet versions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.sources.store import Store
from ebbtide.sources.versions import Versions

SCHEMA = "index long, data binary"


class Log:
    """Records (index, data), numbered from 1 without gaps; each change is a new version, committed by a rename."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.versions = spark, Versions(spark, path)

    def records(self) -> DataFrame:
        return self.versions.read("log", SCHEMA)

    def bounds(self) -> tuple[int, int]:
        """(first index, last index), (0, 0) of an empty log; read from Parquet statistics."""
        lo, hi = self.records().agg(F.min("index"), F.max("index")).first()
        return lo or 0, hi or 0

    def append(self, batch: DataFrame) -> None:
        """Adds a batch (index, data) that must begin at last + 1 and have no gap; all of it or nothing."""
        batch = batch.select(F.col("index").cast("long").alias("index"), F.col("data").cast("binary").alias("data"))
        n, distinct, lo, hi = batch.agg(F.count("index"), F.count_distinct("index"), F.min("index"), F.max("index")).first()
        if not n:
            return
        last = self.bounds()[1]
        if distinct != n or hi - lo + 1 != n or lo != (last + 1 if last else lo) or lo < 1:
            raise ValueError(f"out of order: the batch holds {lo} to {hi} ({n} records), the log ends at {last}")
        self.versions.extend("log", batch)

    def read(self, index: int) -> bytes:
        row = self.records().where(F.col("index") == index).first()
        if row is None:
            raise KeyError(index)
        return bytes(row["data"])

    def scan(self, first: int, last: int) -> DataFrame:
        return self.records().where(F.col("index").between(first, last))

    def truncate_front(self, index: int) -> None:
        """Keeps records from index on."""
        self._keep(index, F.col("index") >= index)

    def truncate_back(self, index: int) -> None:
        """Keeps records up to index."""
        self._keep(index, F.col("index") <= index)

    def _keep(self, index: int, kept) -> None:
        lo, hi = self.bounds()
        if not lo <= index <= hi or not lo:
            raise ValueError(f"index {index} is out of range {lo}..{hi}")
        self.versions.replace({"log": self.records().where(kept)})


def replay(log: Log, store: Store, decode: Callable[[DataFrame], DataFrame]) -> int:
    """Appends to the store what the log holds beyond the last record that it has applied; the number of that record afterwards.

    decode makes elements (stream_id, ts, value, seq...) of records (index, data).  The number is committed in the store's version together with
    the elements, so a replay that is lost or repeated applies every record once.
    """
    applied = int(store.versions.current()[1]["meta"].get("applied", 0))
    first, last = log.bounds()
    if last <= applied:
        return applied
    if first > applied + 1:
        raise ValueError(f"records {applied + 1} to {first - 1} are gone from the log")
    store.append(decode(log.scan(applied + 1, last)), meta={"applied": last})
    return last
