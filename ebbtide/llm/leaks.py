"""Benchmark decontamination by q-gram filtering and banded alignment.

Text is reduced to lower-case letters and digits with single spaces.  An item of m characters may be met
with up to e = m * budget // 100 edits; then it shares at least m - q + 1 - q * e of its q-grams with the text,
all of them on e + 1 neighbouring diagonals.  So q-gram hits are counted in diagonal bands that overlap by
e, regions that reach the bound are retained, and the item is aligned there inside the band.  No leak within the
budget is lost, and none is reported that has more edits.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm import common, flat

Q, BUDGET = 10, 8
#: Characters of benchmark items that one pass over the documents holds in memory; more items take more passes.
PASS_CHARS = 8_000_000
#: Hits, and characters of alignments, that are held at a time.
HITS, ALIGNED = 2_000_000, 8_000_000
BITS = 22
U = np.uint64
_KEEP = np.full(256, 32, np.uint8)
for _c in [*range(48, 58), *range(97, 123), *range(128, 256)]:
    _KEEP[_c] = _c
for _c in range(65, 91):
    _KEEP[_c] = _c + 32


def normal(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Reduced bytes and offsets: each text begins with its first kept byte and ends with one space."""
    x = _KEEP[data]
    if len(x) > 1:  # capitals of U+00C0 to U+00DE
        cap = (x[:-1] == 0xC3) & (x[1:] >= 0x80) & (x[1:] <= 0x9E) & (x[1:] != 0x97)
        x[1:][cap] += 0x20
    gap = x == 32
    head = np.zeros(len(x) + 1, bool)
    head[off] = True
    drop = gap.copy()
    drop[1:] &= gap[:-1] | head[1:-1]
    kept = np.flatnonzero(~drop)
    size = np.searchsorted(kept, off)
    # one space at the end of every text, whether it had one or not
    n = np.diff(size)
    out = np.full(len(kept) + len(n), 32, np.uint8)
    out[np.arange(len(kept)) + np.repeat(np.arange(len(n)), n)] = x[kept]
    return out, size + np.arange(len(size))


def grams(x: np.ndarray) -> np.ndarray:
    """Hash of every Q bytes."""
    if len(x) < Q:
        return np.empty(0, U)
    a = x.astype(U)
    a = a[:-1] << U(8) | a[1:]
    b = a[:-2] << U(16) | a[2:]
    c = b[:-4] << U(32) | b[4:]
    n = len(x) - Q + 1
    return (c[:n] ^ (a[8 : 8 + n] * U(0x9E3779B97F4A7C15))) * U(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Items:
    ids: np.ndarray
    text: list[np.ndarray]
    size: np.ndarray
    edits: np.ndarray
    least: np.ndarray
    keys: np.ndarray  # distinct grams, sorted
    at: np.ndarray  # where each one's places begin
    item: np.ndarray
    place: np.ndarray
    bitmap: np.ndarray


def index(ids: list[int], texts: list[str], budget: int = BUDGET) -> Items:
    """Items of fewer than Q reduced characters have no q-gram and are left out."""
    data, off = flat.span(pa.array(texts, pa.string()))
    x, off = normal(data, off)
    parts = [x[a : b - 1] for a, b in zip(off, off[1:])]
    parts = [p[:-1] if len(p) and p[-1] == 32 else p for p in parts]
    use = [i for i, p in enumerate(parts) if len(p) >= Q]
    parts = [parts[i] for i in use]
    size = np.array([len(p) for p in parts], np.int64)
    edits = np.minimum(size * budget // 100, np.maximum((size - Q) // Q, 0))
    h = [grams(p) for p in parts]
    every = np.concatenate([np.empty(0, U), *h])
    item = np.repeat(np.arange(len(h)), [len(y) for y in h])
    place = np.concatenate([np.empty(0, np.int64), *[np.arange(len(y)) for y in h]]).astype(np.int64)
    order = np.argsort(every, kind="stable")
    keys, at = np.unique(every[order], return_index=True)
    bitmap = np.zeros(1 << BITS, bool)
    bitmap[keys >> U(64 - BITS)] = True
    return Items(np.array([ids[i] for i in use], np.int64), parts, size, edits, size - Q + 1 - Q * edits, keys, np.append(at, len(every)), item[order], place[order], bitmap)


def align(item: np.ndarray, windows: np.ndarray, wide: int) -> np.ndarray:
    """Least edits between the item and a stretch of each window that begins and ends on one of `wide` diagonals."""
    d = np.zeros((len(windows), wide), np.int32)
    step = np.arange(wide, dtype=np.int32)
    far = np.full((len(windows), 1), 1 << 20, np.int32)
    for i, c in enumerate(item):
        sub = d + (windows[:, i : i + wide] != c)
        gone = np.concatenate([d[:, 1:], far], 1) + 1  # the item's character has no partner
        d = np.minimum(sub, gone)
        d = np.minimum.accumulate(d - step, axis=1) + step  # characters of the text without partner
    return d.min(1)


def _counted(rows: np.ndarray) -> np.ndarray:
    """Rows (text, item, band, n) with n summed by the others."""
    rows = rows[np.lexsort(rows[:, 2::-1].T)]
    new = np.flatnonzero(np.append(True, (rows[1:, :3] != rows[:-1, :3]).any(1))) if len(rows) else np.empty(0, np.int64)
    out = rows[new]
    out[:, 3] = np.add.reduceat(rows[:, 3], new) if len(new) else 0
    return out


def find(text: pa.Array, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, item, edits) of all items met within their budget; the best place of each pair."""
    none = np.empty(0, np.int64)
    x, off = normal(*flat.span(text))
    g = grams(x)
    hit = np.flatnonzero(items.bitmap[g >> U(64 - BITS)]) if len(g) and len(items.keys) else none
    k = np.minimum(np.searchsorted(items.keys, g[hit]), max(len(items.keys) - 1, 0)) if len(hit) else none
    ok = items.keys[k] == g[hit] if len(hit) else np.empty(0, bool)
    hit, k = hit[ok], k[ok]
    if not len(hit):
        return none, none, none
    n = items.at[k + 1] - items.at[k]
    total = np.concatenate([[0], np.cumsum(n)])
    parts, i = [], 0
    while i < len(hit):  # hits a few at a time; of each only how many fall into a band is kept
        j = max(i + 1, int(np.searchsorted(total, total[i] + HITS, "right")) - 1)
        m = n[i:j]
        ix = np.repeat(items.at[k[i:j]] - total[i:j], m) + np.arange(total[i], total[j])
        item, where = items.item[ix], np.repeat(hit[i:j], m)
        doc = np.searchsorted(off, where, "right") - 1
        diag = where - items.place[ix] + int(items.size.max())
        e = items.edits[item]
        # bands of 2(e + 1) diagonals, one every e + 1: any e + 1 neighbours are inside one band
        rows = np.stack([np.concatenate([doc, doc]), np.concatenate([item, item]), np.concatenate([diag // (e + 1), diag // (e + 1) - 1]), np.ones(2 * len(doc), np.int64)], 1)
        parts.append(_counted(rows))
        if len(parts) > 8:
            parts = [_counted(np.concatenate(parts))]
        i = j
    y = _counted(np.concatenate(parts))
    cand = y[y[:, 3] >= items.least[y[:, 1]]]
    out_doc, out_item, out_edits = [], [], []
    for it in np.unique(cand[:, 1]).tolist():
        every = cand[cand[:, 1] == it]
        m, e1 = int(items.size[it]), int(items.edits[it]) + 1
        wide = 2 * e1 + 2 * (e1 - 1)
        step = max(1, ALIGNED // (m + wide))
        for i in range(0, len(every), step):
            rows = every[i : i + step]
            begin = rows[:, 2] * e1 - int(items.size.max()) - (e1 - 1)
            j = begin[:, None] + np.arange(m + wide)
            inside = (j >= off[rows[:, 0]][:, None]) & (j < off[rows[:, 0] + 1][:, None])
            w = np.where(inside, x[np.clip(j, 0, len(x) - 1)], 0)
            d = align(items.text[it], w, wide)
            good = d <= items.edits[it]
            out_doc.append(rows[good, 0])
            out_item.append(rows[good, 1])
            out_edits.append(d[good])
    if not out_doc:
        return none, none, none
    doc, item, edits = np.concatenate(out_doc), np.concatenate(out_item), np.concatenate(out_edits).astype(np.int64)
    order = np.lexsort([edits, item, doc])
    doc, item, edits = doc[order], item[order], edits[order]
    best = np.append(True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])) if len(doc) else np.empty(0, bool)
    return doc[best], item[best], edits[best]


def leaks(docs: DataFrame, benchmark: DataFrame, budget: int = BUDGET, pass_chars: int = PASS_CHARS) -> DataFrame:
    """(doc_id, item_id, edits, item_chars): every benchmark item met whole in a document, within its budget of edits.

    Text is reduced to lower-case letters (a-z, and those of Latin-1) and digits, other runs to one space.  An
    item of m reduced characters may have m * budget // 100 edits (at most m // 10 - 1).  Items that are null or shorter than 10
    reduced characters, null texts and null ids match nothing; rows that repeat an id count once, with the least
    edits.  A part of an item, however long, is no leak.  The items reach the executors as an index file in the shared folder, one for every
    pass_chars characters of them, each with a pass over the documents of its own.
    """
    spark = docs.sparkSession
    known = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = known.agg(F.sum(F.length("text"))).first()[0] or 0
    passes = max(1, -(-total // pass_chars))
    two = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).where("id is not null and text is not null")
    out = None
    for p in range(passes):
        root = common.scratch_path(spark, "leak-items")
        mine = known.where(F.pmod(F.xxhash64(F.lit("pass"), "item_id", "text"), F.lit(passes)) == p)  # about pass_chars characters
        made = mine.repartition(1).mapInArrow(_build(root, budget), "path string").collect()  # one path
        part = two.mapInArrow(_run(made[0][0]), SCHEMA) if made else spark.createDataFrame([], SCHEMA)
        if passes > 1:  # then an index is gone before the next is made
            part = common.materialise(part, "leaks")
            common.remove(spark, root)
        out = part if out is None else out.unionByName(part)
    return out.groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"), F.min_by("item_chars", "edits").alias("item_chars"))


SCHEMA = "doc_id long, item_id long, edits int, item_chars int"


def _build(root: str, budget: int):
    """Rows (item_id, text) of one task to a file that holds their index; its path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts = [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            texts += batch.column(1).to_pylist()
        if ids:
            system, at = fs.FileSystem.from_uri(root)
            system.create_dir(at, recursive=True)
            name = uuid.uuid4().hex  # an attempt that is lost leaves a file that nothing reads
            with system.open_output_stream(f"{at}/{name}") as f:
                f.write(pickle.dumps(index(ids, texts, budget)))
            yield pa.RecordBatch.from_arrays([pa.array([f"{root}/{name}"])], names=["path"])

    return run


@lru_cache(1)
def _loaded(path: str) -> Items:
    system, at = fs.FileSystem.from_uri(path)
    with system.open_input_stream(at) as f:
        return pickle.loads(f.read())  # our own file of this run


def _run(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _loaded(path)
        for batch in batches:
            for lo, hi, text in flat.chunks(batch.column(1)):
                doc, item, edits = find(text, items)
                if len(doc):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(batch.column(0).to_numpy()[lo:hi][doc]), pa.array(items.ids[item]), pa.array(edits.astype(np.int32)), pa.array(items.size[item].astype(np.int32))],
                        names=["doc_id", "item_id", "edits", "item_chars"],
                    )

    return run


def without_leaks(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """docs without those that hold a benchmark item; rows with a null doc_id stay."""
    ident = common.fresh(docs, "leak_id")[0]
    bad = leaks(docs, benchmark, **settings).select(F.col("doc_id").alias(ident)).distinct()
    return docs.join(bad, docs["doc_id"] == bad[ident], "left_anti")
