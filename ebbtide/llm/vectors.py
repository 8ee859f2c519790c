"""Embedding near-dedup: random-hyperplane sign hashing in several tables, exact cosines, components.

Equal vectors of a label collapse to one first.  Each distinct vector gets, in each of T tables, a
key of k hyperplane signs; k follows the logarithm of the largest label, so that a bucket holds about
one unrelated vector at any size, and T follows from k so that a pair at the threshold meets in
some table with probability 1 - `miss`.  Only buckets that hold two or more vectors fetch them.
Inside a bucket (crowded ones in pairs of blocks) cosines are exact and in double precision.  A pair
counts in the first table where it meets, which its two key lists tell, so no pair is ever written:
what leaves a bucket is a count per vector and a spanning forest of the links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm import common

BLOCK_ROWS = 1000


@lru_cache(8)
def planes(dim: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(dim * 7919 + 13)).standard_normal((n, dim)).T.astype(np.float32)


def plan(largest: int, cosine: float, miss: float) -> tuple[int, int]:
    """(bits, tables) for labels of at most `largest` distinct vectors."""
    agree = 1 - math.acos(max(-1.0, min(1.0, cosine))) / math.pi
    bits = min(30, max(6, math.ceil(math.log2(max(largest, 2)))))
    return bits, max(1, math.ceil(math.log(miss) / math.log1p(-(agree**bits) + 1e-15)))


def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, vec, label) to (id, label, dim, vec bytes); vec is null where it can't be linked."""
    for batch in batches:
        col = batch.column(1)
        wide, kind = col.type.value_type, np.float32 if pa.types.is_float32(col.type.value_type) else np.float64
        off = np.asarray(col.offsets)
        flat = col.values.cast(pa.float32() if kind is np.float32 else pa.float64(), safe=False) if wide not in (pa.float32(), pa.float64()) else col.values
        x = flat.to_numpy(zero_copy_only=False).astype(kind, copy=False)  # null components become NaN
        null, out, dims = np.asarray(col.is_null()), [], []
        bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
        some = np.concatenate([[0], np.cumsum(x != 0)])
        for i in range(batch.num_rows):
            a, b = int(off[i]), int(off[i + 1])
            ok = not null[i] and b > a and bad[b] == bad[a] and some[b] > some[a]
            out.append((x[a:b] + kind(0)).tobytes() if ok else None)
            dims.append(b - a if ok else 0)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], names=["id", "label", "dim", "vec"])


def _unit(raw: list[bytes], dim: int) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float32 if len(raw[0]) == 4 * dim else np.float64).reshape(len(raw), dim).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow of the squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def keys(batches: Iterator[pa.RecordBatch], bits: int, tables: int) -> Iterator[pa.RecordBatch]:
    """(id, dim, vec) to (id, keys): the tables' keys as 32-bit numbers."""
    weight = (1 << np.arange(bits, dtype=np.int64)).astype(np.float64)
    for batch in batches:
        dims = batch.column(1).to_numpy()
        raw = batch.column(2).to_pylist()
        out = np.zeros((len(dims), tables), np.int32)
        for d in np.unique(dims).tolist():
            at = np.flatnonzero(dims == d)
            x = _unit([raw[i] for i in at], d).astype(np.float32)
            for t in range(tables):
                sign = x @ planes(d, bits * tables)[:, t * bits : (t + 1) * bits] >= 0
                out[at, t] = (sign @ weight).astype(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(out), pa.list_(pa.int32()))], names=["id", "keys"])


def links(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """Bucket rows (g, bi, bj, bk, t, id, label, dim, vec, keys, mult), to (a, b, n): a null b carries n links of a."""
    by = ["g", "bi", "bj"]
    for table in common.grouped(batches, by):
        at = common.starts(table, by)
        ids, bk, mult, tab = (table.column(c).to_numpy() for c in ("id", "bk", "mult", "t"))
        kind = np.stack([table.column("label").to_numpy(), table.column("dim").to_numpy(), tab], 1)
        col = table.column("keys").combine_chunks()
        allk = col.flatten().to_numpy().reshape(len(col), -1) if len(col) else np.empty((0, 1))
        raw = table.column("vec").to_pylist()
        split = (table.column("bi").to_numpy() != table.column("bj").to_numpy())
        a, b, n = [], [], []
        for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
            if hi - lo < 2:
                continue
            rows = np.arange(lo, hi)
            for sub in [rows] if (kind[lo:hi] == kind[lo]).all() else [rows[(kind[rows] == k).all(1)] for k in np.unique(kind[rows], axis=0)]:
                if len(sub) < 2:
                    continue
                x = _unit([raw[i] for i in sub], int(kind[sub[0], 1]))
                near = x @ x.T >= cosine
                np.fill_diagonal(near, False)
                if split[sub[0]]:
                    near &= bk[sub][:, None] != bk[sub][None, :]
                if not near.any():
                    continue
                i, j = np.nonzero(np.triu(near))
                t, k = int(kind[sub[0], 2]), allk[sub]
                met = np.zeros(len(i), bool)
                for s in range(t):
                    met |= k[i, s] == k[j, s]
                near[i[met], j[met]] = near[j[met], i[met]] = False
                m = near @ mult[sub]
                got = np.flatnonzero(m)
                a.append(ids[sub][got])
                b.append(np.full(len(got), -1))
                n.append(m[got])
                x, y = common.forest(len(sub), lambda p, rest: near[p, rest])
                a.append(ids[sub][x])
                b.append(ids[sub][y])
                n.append(np.zeros(len(x), np.int64))
        if a:
            a, b, n = np.concatenate(a), np.concatenate(b), np.concatenate(n)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=n > 0), pa.array(n.astype(np.int64))], names=["a", "b", "n"])


def near_duplicates(vectors: DataFrame, cosine: float = 0.93, miss: float = 5e-4, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per row of vectors.

    Two vectors are linked when their labels are equal and not null, their lengths are equal, and their
    cosine is at least `cosine`.  A vector that is null, empty, all zeros or holds a null or a
    non-finite component is linked with nothing.  n_links counts the other vectors linked directly,
    equal ones included; component_id is the smallest vec_id reachable; kept: it is the row's own.  Rows
    that repeat a vec_id count as vectors of their own; a null vec_id takes part in nothing, its component_id
    is null and it is kept.  Other columns are ignored.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).alias("vec"), F.col(label).cast("long").alias("label"))
    rows = rows.mapInArrow(clean, "id long, label long, dim int, vec binary")
    rows = rows.withColumn("d1", F.xxhash64("vec")).withColumn("d2", F.xxhash64(F.lit("x"), "vec"))
    ok = rows.where("id is not null and label is not null and vec is not null")
    reps = ok.groupBy("label", "dim", "d1", "d2").agg(F.min("id").alias("id"), F.count("*").alias("mult"), F.any_value("vec").alias("vec"))
    reps = common.materialise(reps, "vec-reps")
    largest = reps.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    bits, tables = plan(largest, cosine, miss)
    signed = reps.select("id", "dim", "vec").mapInArrow(lambda it: keys(it, bits, tables), "id long, keys array<int>")
    full = common.materialise(reps.join(signed, "id"), "vec-keys")

    light = full.select("id", F.posexplode("keys").alias("t", "key"), "label", "dim")
    light = light.select("id", "t", F.xxhash64("label", "dim", "t", "key").alias("g"), F.lit(1).alias("one"))
    many = light.groupBy("g").agg(F.count("*").alias("c")).where("c > 1").select("g")
    spread = common.block_pairs(light.join(many, "g"), ["g"], "one", "id", BLOCK_ROWS)
    found = spread.select("id", "t", "g", "bi", "bj", "bk").join(full, "id")
    found = common.clustered(found, ["g", "bi", "bj"]).mapInArrow(lambda it: links(it, cosine), "a long, b long, n long")
    found = common.materialise(found, "vec-links")
    comp = common.connected_components(found.where("b is not null"))
    degree = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n"))

    named = (
        reps.select("label", "dim", "d1", "d2", F.col("id").alias("rep"), "mult")
        .join(comp, F.col("rep") == F.col("node"), "left")
        .join(degree, F.col("rep") == F.col("a"), "left")
        .select("label", "dim", "d1", "d2", F.coalesce("component", "rep").alias("component"), (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"))
    )
    out = rows.drop("vec").join(named.withColumn("linkable", F.lit(True)), ["label", "dim", "d1", "d2"], "left")
    use = F.col("linkable").isNotNull() & F.col("id").isNotNull()
    own = F.when(use, F.col("component")).otherwise(F.col("id"))
    return out.select(F.col("id").alias("vec_id"), F.when(use, F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(own == F.col("id"), F.lit(True)).alias("kept"))
