"""Repeated passages by sparse suffix arrays.

Suffixes are kept only at minimiser places, which depend on nothing but the words around them, so two
documents that share a long enough passage keep the same places in it.  Kept suffixes that begin with the same
ANCHOR words are candidates; for those alone the words before and after are fetched, as hashes of every window
of `least` words around the place.  Windows that different documents hold are matches, whole
groups of one anchor at a time, or one window at a time where an anchor has too many places for a task; the result
are the matches, joined where they touch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.llm import common, flat

K, W, ANCHOR = 10, 30, 20
#: Words kept before a place: the first place of a match is among its first W words.
LEFT = W
#: Places of one anchor that one task may compare.
HOLD = 100_000


def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to (key, id, pos): the anchors at minimiser places."""
    for batch in batches:
        for lo, hi, text in flat.chunks(batch.column(1)):
            h, _, _, woff = flat.words(*flat.span(text))
            p = flat.minimisers(h, woff, K, W)
            doc = np.searchsorted(woff, p, "right") - 1
            ok = p + ANCHOR <= woff[doc + 1]
            p, doc = p[ok], doc[ok]
            key = flat.ngrams(h, ANCHOR)[p].view(np.int64) if len(p) else np.empty(0, np.int64)
            ids = batch.column(0).to_numpy()[lo:hi]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[doc]), pa.array((p - woff[doc]).astype(np.int32))], names=["key", "id", "pos"])


def contexts(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(id, text, found: [(key, pos, heavy)]) to (key, id, pos, win, one); win has, for each o under LEFT, a 64-bit hash of the `least` words that begin o words before the place, 0 where the text has fewer.

    A place of a heavy key gives a row for each such window instead: one is its hash, pos its first word, and win is null.
    """
    names = ["key", "id", "pos", "win", "one"]
    for batch in batches:
        for lo, hi, text in flat.chunks(batch.column(1)):
            h, _, _, woff = flat.words(*flat.span(text))
            g = np.append(np.maximum(flat.ngrams(h, least), np.uint64(1)), np.uint64(0))
            found = batch.column(2).slice(lo, hi - lo)
            item = found.flatten()
            keys, pos = item.field(0).to_numpy(), item.field(1).to_numpy().astype(np.int64)
            weighs = item.field(2).to_numpy(zero_copy_only=False)
            n = np.diff(np.asarray(found.offsets))
            doc = np.repeat(np.arange(hi - lo), n)
            for i in range(0, len(keys), 20_000):
                d, p, key, heavy = (x[i : i + 20_000] for x in (doc, pos, keys, weighs))
                x = (woff[d] + p)[:, None] - np.arange(LEFT)
                win = g[np.where((x >= woff[d][:, None]) & (x + least <= woff[d + 1][:, None]), x, len(g) - 1)]
                ids = batch.column(0).to_numpy()[lo:hi][d]
                if not heavy.all():
                    r = ~heavy
                    yield pa.RecordBatch.from_arrays([pa.array(key[r]), pa.array(ids[r]), pa.array(p[r].astype(np.int32)), _binary(win[r]), pa.nulls(int(r.sum()), pa.int64())], names=names)
                r, o = np.nonzero(win * heavy[:, None])
                for j in range(0, len(r), 100_000):
                    rj, oj = r[j : j + 100_000], o[j : j + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(key[rj]), pa.array(ids[rj]), pa.array((p[rj] - oj).astype(np.int32)), pa.nulls(len(rj), pa.binary()), pa.array(win[rj, oj].view(np.int64))], names=names)


def _binary(x: np.ndarray) -> pa.Array:
    off = np.arange(len(x) + 1, dtype=np.int32) * np.int32(x.shape[1] * x.itemsize)
    return pa.BinaryArray.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(x))])


def _wide(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint64).reshape(len(col), LEFT)


def _windows(key, win, ids, pos, least: int) -> np.ndarray:
    """Matches (id, start, end, other) of just `least` words around each place, with whatever row of another document.

    For every share of words before the place, rows are grouped by exactly those words; any longer match is made of such ones,
    and two that share a place overlap.
    """
    base = flat.mix(key.view(np.uint64))
    first, last, other = np.full(len(key), -1), np.full(len(key), -1), np.full(len(key), np.iinfo(np.int64).max)
    for o in range(LEFT):
        rows = np.flatnonzero(win[:, o])
        if len(rows) < 2:
            continue
        h = flat.mix(base[rows] + win[rows, o])
        order = np.argsort(h, kind="stable")
        at = np.flatnonzero(np.append(True, h[order][1:] != h[order][:-1]))
        mine = ids[rows][order]
        size = np.diff(np.append(at, len(rows)))
        lo, hi = np.repeat(np.minimum.reduceat(mine, at), size), np.repeat(np.maximum.reduceat(mine, at), size)
        hit = lo < hi
        at_row = rows[order][hit]
        other[at_row] = np.minimum(other[at_row], np.where(mine == lo, hi, lo)[hit])
        first[at_row] = o
        last[at_row] = np.where(last[at_row] < 0, o, last[at_row])
    i = np.flatnonzero(first >= 0)
    return np.stack([ids[i], pos[i] - first[i], pos[i] - last[i] + least, other[i]])


def matches(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, id, pos, win) by key, to matches (id, start, end, other)."""
    for table in common.grouped(batches, ["key"]):
        key, ids, pos = (table.column(c).to_numpy() for c in ("key", "id", "pos"))
        m = _windows(key, _wide(table.column("win")), ids, pos.astype(np.int64), least)
        if m.shape[1]:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.unique(m, axis=1)], names=["id", "start", "end", "other"])


def repeated(docs: DataFrame, least: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, end, n_words, other_doc_id): maximal runs of words that another document holds too.

    Words are the runs of other characters than white space, A-Z lower-cased; start and end count words, end
    is exclusive.  A run has at least `least` words (50 or more) in one exact match; matches that overlap or touch are joined,
    and other_doc_id is the smallest partner met.  Documents of equal text are compared once, and each but that
    of the smallest doc_id has one run over all of its words.  A document with the smallest doc_id of its equals also has that
    run.  Null or empty texts and null ids have none.  Repeats inside one document aren't reported.
    """
    if least < ANCHOR + W:
        raise ValueError(f"a match of fewer than {ANCHOR + W} words may hold no anchor")
    two = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).where("id is not null and text is not null")
    digest = two.select("id", F.xxhash64("text").alias("d1"), F.xxhash64(F.lit("x"), "text").alias("d2"), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n"))
    same = digest.groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.max("id").alias("high"), F.count_distinct("id").alias("copies"))
    same = common.materialise(same, "suffix-same")
    whole = same.where("copies > 1")

    every = common.materialise(two.mapInArrow(places, "key long, id long, pos int"), "suffix-places")
    reps = same.select(F.col("rep").alias("id")).distinct()
    rows = common.materialise(every.join(reps, "id", "left_semi"), "suffix-reps")
    common.drop_scratch(every)
    many = rows.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n")).where("lo < hi")
    many = common.materialise(many.select("key", (F.col("n") > HOLD).alias("heavy")), "suffix-keys")

    cand = rows.join(many, "key").groupBy("id").agg(F.collect_set(F.struct("key", "pos", "heavy")).alias("found"))
    around = two.join(cand, "id").mapInArrow(lambda it: contexts(it, least), "key long, id long, pos int, win binary, one long")
    heavy = many.where("heavy").limit(1).count()
    if heavy:
        around = common.materialise(around, "suffix-around")  # read for either kind of key: texts move once
    light = common.clustered(around.where("one is null").select("key", "id", "pos", "win"), ["key"])
    hits = light.mapInArrow(lambda it: matches(it, least), "id long, start long, end long, other long")
    if heavy:
        # too many rows for one task: each window is a group of its own, of which only two numbers are asked
        rest = around.where("one is not null").select("key", F.col("one").alias("win"), "id", F.col("pos").cast("long").alias("start"))
        met = rest.groupBy("key", "win").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi")
        other = F.when(F.col("id") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("other")
        hits = hits.unionByName(rest.join(met, ["key", "win"]).select("id", "start", (F.col("start") + least).alias("end"), other))

    before = Window.partitionBy("id").orderBy("start", "end")
    reach = hits.distinct().withColumn("reach", F.max("end").over(before.rowsBetween(Window.unboundedPreceding, -1)))
    run = reach.withColumn("run", F.sum(F.when(F.col("reach").isNull() | (F.col("start") > F.col("reach")), 1).otherwise(0)).over(before))
    joined = run.groupBy("id", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("other").alias("other")).drop("run")

    # documents with equals: one run each, and none of the shorter ones
    copies = digest.join(whole, ["d1", "d2"]).where(F.col("n") >= least)
    full = copies.select("id", F.lit(0).cast("long").alias("start"), F.col("n").alias("end"), F.when(F.col("id") == F.col("rep"), F.col("high")).otherwise(F.col("rep")).alias("other"))
    out = full.distinct().unionByName(joined.join(full.select("id").distinct(), "id", "left_anti"))
    return out.select(F.col("id").alias("doc_id"), "start", "end", (F.col("end") - F.col("start")).alias("n_words"), F.col("other").alias("other_doc_id"))
