"""Shared plumbing: scratch tables, connected components, grouped Arrow streams, block pairs."""

from __future__ import annotations

import atexit
import math
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.sources.shared import fresh_path

#: Edges whose components one task finds, in some 100 MB.
ONE_TASK = 1_000_000

_scopes: list[list[str]] = []


def scratch_path(spark: SparkSession, name: str, scoped: bool = True) -> str:
    """A fresh path in the shared folder, removed at the end of the scratch_scope() it is made in, or when the driver's Python ends."""
    path = fresh_path(spark, name)
    if _scopes and scoped:
        _scopes[-1].append(path)
    else:
        atexit.register(remove, spark, path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession):
    """Removes all scratch tables that are made inside; what is made of them must be written before the end."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder, if it is there."""
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the JVM may be gone already
        pass


def materialise(df: DataFrame, name: str, scoped: bool = True) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: the lineage ends there. What isn't scoped outlives the scratch_scope()."""
    spark = df.sparkSession
    path = scratch_path(spark, name, scoped)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(df: DataFrame) -> None:
    """Deletes a table made by materialise(), once nothing lazy reads it any more."""
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        if "/ebbtide/" in f:
            remove(df.sparkSession, f)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node with an edge; component is the smallest node reachable.

    Large-star and small-star rounds in turn: each is a grouped minimum (combined map-side, so a
    node with very many neighbours costs no more than any other) and an equi-join that AQE may split.
    Every round is written to the shared folder; only two numbers reach the driver.  Once no more than ONE_TASK
    edges are left, one task does the rest instead: each round costs the driver several plans.  Edges with a
    null end and self loops are ignored; an empty table gives an empty table.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} <> {b}").distinct()
    e, before = materialise(e, "cc"), None
    left = e.count()
    for _ in range(max_rounds):
        if left <= ONE_TASK:
            kind = e.schema["u"].dataType.simpleString()
            done = materialise(e.coalesce(1).mapInArrow(settled, f"node {kind}, component {kind}"), "cc")
            drop_scratch(e)
            return done
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        out = large.join(small, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = materialise(out.unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "cc")
        now = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_scratch(e)
        e = new
        if now == before:
            break
        before, left = now, now[0]
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges (u, v) to (node, component): roots are hung on their smallest neighbour, and chains cut short, until no edge joins two roots."""
    ends = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches if x.num_rows]
    if not ends:
        return
    u, v = (np.concatenate(x) for x in zip(*ends))
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v, root = at[: len(u)], at[len(u) :], np.arange(len(ids))
    while len(u):
        u, v = np.maximum(root[u], root[v]), np.minimum(root[u], root[v])
        apart = u != v
        u, v = u[apart], v[apart]
        np.minimum.at(root, u, v)
        while (root[root] != root).any():
            root = root[root]
    for i in range(0, len(ids), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + 100_000]), pa.array(ids[root[i : i + 100_000]])], names=["node", "component"])


def blocks(df: DataFrame, key: Sequence[str], weight: str, limit: int) -> DataFrame:
    """df with nb: into how many blocks its group (same key) goes, ceil(sum of weights / limit)."""
    total = df.groupBy(*key).agg(F.greatest(F.ceil(F.sum(weight) / F.lit(float(limit))), F.lit(1)).cast("int").alias("nb"))
    return df.join(total, list(key))


def paired(df: DataFrame, ident: str) -> DataFrame:
    """Sends each row of a group of nb blocks to every pair of blocks that has its own; any two rows of a group meet.

    A row's block is named by the hash of its ident.  Adds bi, bj (bi <= bj) and bk, the row's own block.
    """
    out = df.withColumn("bk", F.pmod(F.xxhash64(F.lit("block"), ident), F.col("nb")).cast("int"))
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    return out.withColumn("bi", F.least("bk", "other")).withColumn("bj", F.greatest("bk", "other")).drop("other", "nb")


def block_pairs(df: DataFrame, key: Sequence[str], weight: str, ident: str, limit: int) -> DataFrame:
    """Splits groups that are too heavy for one task into pairs of blocks; loses no pair of rows.

    A pair holds about twice the limit.  Where rows are yet to be widened, blocks() before and paired() after that
    copy nothing early.
    """
    return paired(blocks(df, key, weight, limit), ident)


def clustered(df: DataFrame, keys: Sequence[str], then: Sequence[str] = ()) -> DataFrame:
    """Rows of one key in one partition, next to each other."""
    return df.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, *then)


def grouped(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Cuts a stream of clustered batches into tables that hold whole groups only (many each)."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cut = _last_start(batch, keys)
        if held and not (cut == 0 and _same(held[-1], batch, keys)):
            if not _same(held[-1], batch, keys):
                yield pa.Table.from_batches(held)
                held = []
            if cut:
                held.append(batch.slice(0, cut))
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(cut))
        elif held:
            held.append(batch)
        else:
            if cut:
                yield pa.Table.from_batches([batch.slice(0, cut)])
            held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def starts(table: pa.Table | pa.RecordBatch, keys: Sequence[str]) -> np.ndarray:
    """Where a new group begins, and the number of rows at the end."""
    n = table.num_rows
    new = np.zeros(n, bool)
    if n:
        new[0] = True
    for k in keys:
        x = table.column(k).to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table.column(k).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.append(np.flatnonzero(new), n)


def _last_start(batch: pa.RecordBatch, keys: Sequence[str]) -> int:
    return int(starts(batch, keys)[-2])


def _same(x: pa.RecordBatch, y: pa.RecordBatch, keys: Sequence[str]) -> bool:
    return all(x.column(k)[x.num_rows - 1].as_py() == y.column(k)[0].as_py() for k in keys)


def forest(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest over 0..n-1: near(i, rest) tells which of rest are linked with i.

    Rows already reached are never compared with one another, so a group of n rows that are all
    alike costs n comparisons, and at most n - 1 edges come out.
    """
    left, frm, to = np.arange(n), [], []
    while len(left) > 1:
        stack, left = [int(left[0])], left[1:]
        while stack and len(left):
            i = stack.pop()
            hit = near(i, left)
            if hit.any():
                found = left[hit]
                frm.append(np.full(len(found), i))
                to.append(found)
                stack.extend(found.tolist())
                left = left[~hit]
    if not frm:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(frm), np.concatenate(to)


def screen(values: int, num: int, den: int, miss: float) -> int:
    """How many of `values` two-bit MinHash values must agree, so that pairs at similarity num / den fail with a chance of at most `miss`."""
    p, below = num / den + (1 - num / den) / 4, 0.0
    for k in range(values + 1):
        below += math.comb(values, k) * p**k * (1 - p) ** (values - k)
        if below > miss:
            return k
    return values


_ODD = np.uint64(0x5555555555555555)


def agreeing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of the two-bit values that rows of 64-bit numbers hold, how many are equal."""
    d = x ^ y
    return 32 * x.shape[-1] - np.bitwise_count((d | d >> np.uint64(1)) & _ODD).sum(-1, dtype=np.int64)


def two_bit(sig: np.ndarray) -> np.ndarray:
    """Signatures (rows x values) to sketches: the last two bits of every value, 32 values in a 64-bit number."""
    two = (sig & 3).astype(np.uint64).reshape(len(sig), -1, 32)
    return np.bitwise_or.reduce(two << (np.arange(32, dtype=np.uint64) * np.uint64(2)), axis=2)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of df has."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def crc_part(ident: str | Column) -> Column:
    """crc32 of the id as text, mod 4; part 2 is held out from all training."""
    return F.crc32(F.col(ident).cast("string") if isinstance(ident, str) else ident.cast("string")) % 4
