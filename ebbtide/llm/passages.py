"""Substring dedup by MinHash banding of paragraphs.

Paragraphs are the lines of a text and, for passages that sit inside a longer line, windows: runs of WINDOW words
that begin at content-selected places, so that any 51 words hold a whole one.  Both go the same way.  Equal ones count
once; bands of two MinHash values of the five-word shingles bring paragraphs together; a sketch of VALUES values
screens each pair of a band, so that chance and boilerplate chain nothing; pairs that pass meet on their full
shingle sets and are linked if the exact Jaccard similarity is at least 0.8.  The components of the links are
classes; of each class that spans several documents the first paragraph stays and the others go.  Windows that go and follow
each other become one passage, extended to where the documents differ.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.llm import common, flat, minhash

WINDOW, SHINGLE, SHORTEST = 20, 5, 5
#: Bands of two values. A line at similarity 0.8 is missed with a chance of 2 in 1,000. Unequal windows of 16 shingles at 0.8 share 15 of 17,
#: so two bands miss 1 in 20 of them.
LINE_BANDS, WINDOW_BANDS = 6, 2
#: Two-bit values of a sketch; one pair in 10,000 at similarity 0.8 fails the screen.
VALUES, SCREENED = 64, 1e-4
#: A window begins at a minimiser of 28 4-grams: any 51 words hold a whole window of 20.
K, W = 4, 28
STEP = K + W
#: Words on either side of a window that tell which of its partners go on like it.
SIDE = 10
BLOCK_ELEMENTS = 1_500_000
#: Paragraphs of one band that one task may compare.
HOLD = 50_000
_rng = np.random.Generator(np.random.PCG64(4242))
_A = _rng.integers(1, 2**32, VALUES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_B = _rng.integers(0, 2**32, VALUES, dtype=np.uint64).astype(np.uint32)
UNITS = "id long, start int, end int, kind int, key long, bands array<long>, s1 long, s2 long, before int, after int"


def _lines(data: np.ndarray, off: np.ndarray, s: np.ndarray) -> np.ndarray:
    """The first word of each line that has any, and the number of words at the end."""
    cuts = np.unique(np.concatenate([off, np.flatnonzero(data == 10)]))
    line = np.searchsorted(cuts, s, "right")
    return np.append(np.flatnonzero(np.append(True, line[1:] != line[:-1])) if len(s) else [], len(s)).astype(np.int64)


def _thinned(h: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Of neighbouring places with equal words (one word over and over) the first, the last and every W-th: each window keeps one."""
    if len(p) < 2:
        return p
    g = flat.ngrams(h, K)[p]
    new = np.append(True, (p[1:] != p[:-1] + 1) | (g[1:] != g[:-1]))
    start = p[new][np.cumsum(new) - 1]
    return p[((p - start) % W == 0) | np.append(new[1:], True)]


def _few(sh: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which stretches sh[a:b] have at most three distinct shingles, and a hash of each one's set."""
    first = sh[np.minimum(a[:, None] + np.arange(4), b[:, None] - 1)]
    again = np.zeros(len(first), bool)
    for i in range(1, 4):
        again |= (first[:, i, None] == first[:, :i]).any(1)  # of four shingles two are equal, or there are fewer
    at, sums = [], []
    for i in np.flatnonzero(again).tolist():
        x = set(sh[a[i] : b[i]].tolist())
        if len(x) <= 3:
            at.append(i)
            sums.append(sorted(x) + [0] * (3 - len(x)))
    x = np.array(sums, np.uint64).reshape(-1, 3)
    return np.array(at, np.int64), flat.mix(flat.mix(flat.mix(x[:, 0]) + x[:, 1]) + x[:, 2])


def _sides(h: np.ndarray, woff: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of the SIDE words from each place on, 0 where its text has fewer."""
    g = np.append(flat.ngrams(h, SIDE) >> np.uint64(33), np.zeros(SIDE, np.uint64)).astype(np.int32) | 1
    inside = (at >= woff[doc]) & (at + SIDE <= woff[doc + 1])
    return np.where(inside, g[np.where(inside, at, 0)], 0).astype(np.int32)


def units(batches: Iterator[pa.RecordBatch], window: int, shortest: int) -> Iterator[pa.RecordBatch]:
    """(id, text) to UNITS: lines (kind 0) and windows (kind 1); start and end count words."""
    for batch in batches:
        for lo, hi, text in flat.chunks(batch.column(1)):
            data, off = flat.span(text)
            h, s, _, woff = flat.words(data, off)
            if len(h) < shortest:
                continue
            loff = _lines(data, off, s)
            a, b = loff[:-1], loff[1:]
            long = b - a >= shortest
            a, b = a[long], b[long]
            p = _thinned(h, flat.minimisers(h, woff, K, W))
            p = p[p + window <= woff[np.searchsorted(woff, p, "right")]] if len(p) else p
            start, end = np.concatenate([a, p]), np.concatenate([b, p + window])
            n, kind = end - start, np.repeat(np.array([0, 1], np.int32), [len(a), len(p)])
            if not len(n):
                continue
            power, back = flat._powers(len(h) + 1)
            total = np.concatenate([[np.uint64(0)], np.cumsum(h * power[:-1], dtype=np.uint64)])
            key = flat.mix((total[end] - total[start]) * back[start] + n.astype(np.uint64) + (kind.astype(np.uint64) << np.uint64(40)))

            # every five words of the chunk have a shingle; a unit's are those from its start to four before its end
            sh, _ = flat.shingles(h, np.array([0, len(h)]), SHINGLE)
            some = np.flatnonzero(n >= SHINGLE)
            ends = np.stack([start[some], end[some] - SHINGLE + 1], 1).ravel()
            x, sig, low = (sh >> np.uint64(32)).astype(np.uint32), np.zeros((len(n), VALUES), np.uint16), []
            x = np.append(x, x[-1:])
            for j in range(VALUES if len(some) else 0):
                y = np.minimum.reduceat(x * _A[j] + _B[j], ends)[::2]
                sig[some, j] = (y * np.uint32(0x9E3779B1)) >> np.uint32(16)
                if j < 2 * LINE_BANDS:
                    low.append(y.astype(np.uint64))
            sketch = common.two_bit(sig).view(np.int64)
            count = np.where(n < SHINGLE, 0, np.where(kind == 0, LINE_BANDS, WINDOW_BANDS))
            band = np.zeros((len(n), LINE_BANDS), np.uint64)
            for i in range(LINE_BANDS if len(some) else 0):
                band[some, i] = flat.mix((low[2 * i] << np.uint64(32) | low[2 * i + 1]) + flat.mix(kind[some].astype(np.uint64) * np.uint64(64) + np.uint64(i)))
            lines = some[kind[some] == 0]
            if len(lines):
                at, sums = _few(sh, start[lines], end[lines] - SHINGLE + 1)
                band[lines[at], 0], count[lines[at]] = sums, 1  # at 0.8 such sets are equal
            band = band & ~np.uint64(1) | kind.astype(np.uint64)[:, None]  # the last bit tells windows
            doc = np.searchsorted(woff, start, "right") - 1
            inside = kind == 1
            before, after = np.zeros((2, len(n)), np.int32)
            before[inside], after[inside] = _sides(h, woff, doc[inside], start[inside] - SIDE), _sides(h, woff, doc[inside], end[inside])
            offsets = pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32))
            values = pa.array(band[np.arange(LINE_BANDS) < count[:, None]].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(batch.column(0).to_numpy()[lo:hi][doc]), pa.array((start - woff[doc]).astype(np.int32)), pa.array((end - woff[doc]).astype(np.int32)),
                    pa.array(kind), pa.array(key.view(np.int64)), pa.ListArray.from_arrays(offsets, values),
                    pa.array(sketch[:, 0]), pa.array(sketch[:, 1]), pa.array(before), pa.array(after),
                ],
                names=["id", "start", "end", "kind", "key", "bands", "s1", "s2", "before", "after"],
            )


def crowded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (b, key, id) by b and key, to distinct (b, key) of bands that hold several keys, and if they are windows several documents."""
    for table in common.grouped(batches, ["b"]):
        b, key, ids = (table.column(c).to_numpy() for c in ("b", "key", "id"))
        at = common.starts(table, ["b"])
        lo, hi = at[:-1], at[1:] - 1
        met = (key[lo] != key[hi]) & ((b[lo] & 1 == 0) | (np.minimum.reduceat(ids, lo) < np.maximum.reduceat(ids, lo)))
        row = np.repeat(met, np.diff(at))
        row[1:] &= (b[1:] != b[:-1]) | (key[1:] != key[:-1])
        if row.any():
            yield pa.RecordBatch.from_arrays([pa.array(b[row]), pa.array(key[row])], names=["b", "key"])


def screened(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Rows (b, bi, bj, key, own, s1, s2) by band and block pair, to edges (a, b): a spanning forest of each group's pairs that pass the screen.

    Rows of equal own, which is a document or 0 for none, aren't linked.
    """
    keys = ["b", "bi", "bj"]
    for table in common.grouped(batches, keys):
        at, ids, own = common.starts(table, keys), table.column("key").to_numpy(), table.column("own").to_numpy()
        sketch = np.stack([table.column(c).to_numpy() for c in ("s1", "s2")], 1).view(np.uint64)
        size = np.diff(at)
        two = at[:-1][size == 2]
        two = two[(common.agreeing(sketch[two], sketch[two + 1]) >= least) & ((own[two] != own[two + 1]) | (own[two] == 0))]
        out = [(ids[two], ids[two + 1])]
        for i in np.flatnonzero(size > 2).tolist():
            out.append(minhash.sketch_forest(*(x[at[i] : at[i + 1]] for x in (ids, sketch)), least, own[at[i] : at[i + 1]]))
        a, b = (np.concatenate(x) for x in zip(*out))
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def stretch_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, wanted: [(start, end, id, component, nb)]) to (id, component, nb, items): the distinct shingles of each stretch."""
    for batch in batches:
        for lo, hi, text in flat.chunks(batch.column(0)):
            h, _, _, woff = flat.words(*flat.span(text))
            sh, _ = flat.shingles(h, np.array([0, len(h)]), SHINGLE)
            wanted = batch.column(1).slice(lo, hi - lo)
            item = wanted.flatten()
            first = np.repeat(woff[:-1], np.diff(np.asarray(wanted.offsets)))
            a, b, *rest = (item.field(i).to_numpy() for i in range(5))
            for i in range(0, len(a), 20_000):
                ends = zip((first + a)[i : i + 20_000].tolist(), (first + b - SHINGLE + 1)[i : i + 20_000].tolist())
                items = [np.unique(sh[x:y]).tobytes() for x, y in ends]
                yield pa.RecordBatch.from_arrays([*(pa.array(r[i : i + 20_000]) for r in rest), pa.array(items, pa.binary())], names=["id", "component", "nb", "items"])


def classes(two: DataFrame, units_: DataFrame, num: int, den: int) -> DataFrame:
    """(node, component) of the keys of linked paragraphs."""
    # every band row moves once; windows of one document only are of no interest to each other, they overlap
    hung = common.clustered(units_.select(F.explode("bands").alias("b"), "key", "id"), ["b"], ["key"])
    cand = common.materialise(hung.mapInArrow(crowded, "b long, key long"), "passage-bands")
    some = units_.join(cand.select("key").distinct(), "key", "left_semi").groupBy("key", "kind")
    some = some.agg(F.min(F.struct("id", "start", "end", "s1", "s2")).alias("at"), F.max("id").alias("last"))
    own = F.when((F.col("kind") == 1) & (F.col("at.id") == F.col("last")), F.xxhash64("last")).otherwise(F.lit(0).cast("long"))
    some = common.materialise(some.select("key", "at.*", own.alias("own")), "passage-some")
    rows = cand.join(some.select("key", "own", "s1", "s2"), "key").withColumn("one", F.lit(1))
    rows = common.clustered(common.block_pairs(rows, ["b"], "one", "key", HOLD), ["b", "bi", "bj"]).select("b", "bi", "bj", "key", "own", "s1", "s2")
    least = common.screen(VALUES, num, den, SCREENED)
    met = common.connected_components(rows.mapInArrow(lambda it: screened(it, least), "a long, b long"))

    inside = met.join(some, F.col("node") == F.col("key")).select("id", "start", "end", "node", "component", (F.col("end") - F.col("start")).alias("n"))
    inside = common.blocks(inside, ["component"], "n", BLOCK_ELEMENTS)
    # a text goes once, with all that is asked of it
    wanted = inside.groupBy(F.col("id").alias("wid")).agg(F.collect_list(F.struct("start", "end", F.col("node").alias("id"), "component", "nb")).alias("wanted"))
    sets = two.join(wanted, F.col("id") == F.col("wid")).select("text", "wanted").mapInArrow(stretch_sets, "id long, component long, nb int, items binary")
    sets = common.clustered(common.paired(sets, "id"), ["component", "bi", "bj"])
    return common.connected_components(sets.mapInArrow(lambda it: minhash.confirm(it, num, den), "a long, b long"))


def repeated(
    docs: DataFrame, window: int = WINDOW, num: int = 80, den: int = 100, shortest: int = SHORTEST, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, start, end, kind, class_id, first_doc_id, kept): paragraphs of classes that span several documents.

    Words are the runs of other characters than white space, A-Z lower-cased; start and end count words, end is
    exclusive.  kind is `paragraph`, a line of `shortest` words or more, or `passage`, of `window` words or more.  kept is true for the
    class's first one, by (doc_id, start).  Equal windows that follow each other are one passage, as far as the documents agree; it and the
    stretch of an earlier document that holds the same words are a class of their own.  Windows that are like another one and equal to none stay as they are.
    Paragraphs are linked if den * |x & y| >= num * |x | y| for their sets of five-word shingles (fewer words are one shingle).
    Null or empty texts and null ids have no paragraphs; rows that repeat are one; a passage of rows that share a doc_id
    reaches as far as in any of them.
    """
    two = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).where("id is not null and text is not null")
    all_ = common.materialise(two.mapInArrow(lambda it: units(it, window, shortest), UNITS), "passage-units")
    comp = classes(two, all_, num, den)

    # what is met once only, and linked with nothing, goes no further
    met = all_.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).join(comp, F.col("key") == F.col("node"), "left")
    met = met.where("low < high or component is not null").select("key", F.coalesce("component", "key").alias("class_id"))
    place = ["id", "start", "end", "kind", "key", "class_id", "before", "after"]
    same = common.materialise(all_.join(met, "key").select(*place).distinct(), "passage-same")
    first = F.min(F.struct("id", "start", "end", "key")).alias("first")
    spread = same.groupBy("kind", "class_id").agg(first, F.max("id").alias("high"), (F.min("key") < F.max("key")).alias("mixed"))
    out = same.join(spread.where("first.id < high").drop("high"), ["kind", "class_id"])
    own = (F.col("id") == F.col("first.id")) & (F.col("start") == F.col("first.start"))
    shown = [F.col("id").alias("doc_id"), "start", "end"]
    rest = ["class_id", F.col("first.id").alias("first_doc_id"), own.alias("kept")]
    lined = out.where("kind = 0").select(*shown, F.lit("paragraph").alias("kind"), *rest)

    # a window's partners are the first of its equals, and the first of those that go on like it before or after
    windows, gone = same.where("kind = 1"), None
    for side in ([], ["before"], ["after"]):
        known = windows.where(F.col(side[0]) != 0) if side else windows
        alike = known.groupBy("key", *side).agg(first, F.max("id").alias("last")).where("first.id < last").drop("last")
        later = F.col("id") > F.col("first.id") if side else ~own
        pieces = known.join(alike, ["key", *side]).where(later)
        pieces = pieces.select("id", "start", "end", F.col("first.id").alias("fid"), (F.col("start") - F.col("first.start")).alias("diag"))
        gone = pieces if gone is None else gone.unionByName(pieces)
    runs = extended(two, gone).withColumn("class_id", F.xxhash64("fid", F.col("start") - F.col("diag"), F.col("end") - F.col("diag"), F.lit("passage")))

    def placed(doc: str, back: Column, kept: bool) -> Column:
        return F.struct(F.col(doc).alias("doc_id"), (F.col("start") - back).alias("start"), (F.col("end") - back).alias("end"), F.lit(kept).alias("kept"))

    both = F.inline(F.array(placed("id", F.lit(0), False), placed("fid", F.col("diag"), True)))
    found = runs.select("class_id", "fid", both).withColumns({"kind": F.lit("passage"), "first_doc_id": F.col("fid")}).select(*lined.columns).distinct()

    # windows that are like those of an earlier document, and equal to none
    new = windows.groupBy("key").agg(F.min("id").alias("held"))
    near = out.where("kind = 1 and mixed").join(new, "key").where((F.col("id") == F.col("held")) & (F.col("id") != F.col("first.id")) & (F.col("key") != F.col("first.key")))
    near = near.select("class_id", "first", F.struct("id", "start", "end", F.lit(False).alias("kept")).alias("at"))
    firsts = F.struct("first.id", "first.start", "first.end", F.lit(True).alias("kept"))
    near = near.select("class_id", F.col("first.id").alias("fid"), F.inline(F.array("at", firsts)))
    near = near.select(*shown, F.lit("passage").alias("kind"), "class_id", F.col("fid").alias("first_doc_id"), "kept").distinct()
    return lined.unionByName(found).unionByName(near)


def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(wid, text, asked: [(pos, side)]) to (wid, pos, side, near): 32-bit hashes of STEP words, from pos on (side 1) or before it and backwards (side 0); 0 beyond the text."""
    for batch in batches:
        for lo, hi, text in flat.chunks(batch.column(1)):
            h, _, _, woff = flat.words(*flat.span(text))
            w = np.append(np.maximum((h >> np.uint64(33)).astype(np.int32), 1), np.int32(0))
            asked = batch.column(2).slice(lo, hi - lo)
            item, wid = asked.flatten(), batch.column(0).to_numpy()[lo:hi]
            pos, side = item.field(0).to_numpy(), item.field(1).to_numpy()
            doc = np.repeat(np.arange(hi - lo), np.diff(np.asarray(asked.offsets)))
            for i in range(0, len(pos), 50_000):
                d, p, r = doc[i : i + 50_000], pos[i : i + 50_000], side[i : i + 50_000]
                at = (woff[d] + p)[:, None]
                x = np.where((r == 0)[:, None], at - 1 - np.arange(STEP), at + np.arange(STEP))
                near = w[np.where((x >= woff[d][:, None]) & (x < woff[d + 1][:, None]), x, len(h))]
                offsets = pa.array(np.arange(len(d) + 1, dtype=np.int32) * STEP)
                yield pa.RecordBatch.from_arrays([pa.array(wid[d]), pa.array(p), pa.array(r), pa.ListArray.from_arrays(offsets, pa.array(near.ravel()))], names=["wid", "pos", "side", "near"])


def extended(two: DataFrame, pieces: DataFrame) -> DataFrame:
    """Passages (id, start, end, fid, diag) of pieces (id, start, end, fid, diag) whose partner is diag words earlier in document fid.

    Pieces of one partner and diagonal that overlap or touch are one run.  The places of a passage's pieces are at most STEP
    words from one another and from its ends, so a run that goes on by up to STEP words each way reaches the end or the next run.
    What stands around a place is fetched once, however many runs end there.
    """
    order = Window.partitionBy("id", "fid", "diag").orderBy("start")
    fresh = F.coalesce(F.col("start") > F.lag("end").over(order), F.lit(True)).cast("int")
    runs = pieces.distinct().withColumn("fresh", fresh).withColumn("nth", F.sum("fresh").over(order))
    runs = common.materialise(runs.groupBy("id", "fid", "diag", "nth").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("nth"), "passage-runs")
    side = F.explode(F.array(F.lit(0), F.lit(1))).alias("side")
    ends = runs.select("*", side).withColumn("pos", F.when(F.col("side") == 0, F.col("start")).otherwise(F.col("end"))).withColumn("fpos", F.col("pos") - F.col("diag"))
    asked = ends.select(F.col("id").alias("wid"), "pos", "side").unionByName(ends.select(F.col("fid").alias("wid"), F.col("fpos").alias("pos"), "side")).distinct()
    asked = asked.groupBy("wid").agg(F.collect_list(F.struct("pos", "side")).alias("asked"))  # two for every word of a text at most
    near = two.join(asked, F.col("id") == F.col("wid")).select("wid", "text", "asked").mapInArrow(around, "wid long, pos int, side int, near array<int>")
    near = common.materialise(near, "passage-around")
    mine = near.select(F.col("wid").alias("id"), "pos", "side", F.col("near").alias("mine"))
    theirs = near.select(F.col("wid").alias("fid"), F.col("pos").alias("fpos"), "side", F.col("near").alias("theirs"))
    both = ends.join(mine, ["id", "pos", "side"]).join(theirs, ["fid", "fpos", "side"])
    differs = F.array_position(F.zip_with("mine", "theirs", lambda x, y: (x != y) | (x == 0)), True)
    more = both.select("id", "fid", "diag", "start", "end", "side", F.when(differs == 0, F.lit(STEP)).otherwise(differs - 1).cast("int").alias("n"))
    of = lambda k: F.max(F.when(F.col("side") == k, F.col("n")))
    found = more.groupBy("id", "fid", "diag", "start", "end").agg(of(0).alias("l"), of(1).alias("r"))
    return found.select("id", "fid", "diag", (F.col("start") - F.col("l")).alias("start"), (F.col("end") + F.col("r")).alias("end"))


def _cut(batches: Iterator[pa.RecordBatch], place: int) -> Iterator[pa.RecordBatch]:
    """Rows with the text in column `place` and the spans [(start, end)] last, to rows without the spans' words and the white space after them."""
    for batch in batches:
        for lo, hi, text in flat.chunks(batch.column(place)):
            spans = batch.column(batch.num_columns - 1).slice(lo, hi - lo)
            hit = np.flatnonzero(np.asarray(spans.is_valid()))
            columns = [batch.column(i).slice(lo, hi - lo) for i in range(batch.num_columns - 1)]
            if len(hit):
                new, gone = text.to_pylist(), []
                part, lists = text.take(pa.array(hit)), spans.take(pa.array(hit)).to_pylist()
                data, off = flat.span(part)
                _, s, _, woff = flat.words(data, off)
                raw = data.tobytes()
                for d, d_spans in enumerate(lists):
                    keep, x, left = [], int(off[d]), int(woff[d + 1] - woff[d])
                    ends, seen = np.append(s[woff[d] : woff[d + 1]], off[d + 1]), 0
                    for a, b in sorted((r["start"], r["end"]) for r in d_spans):
                        a = max(a, seen)
                        b = min(b, len(ends) - 1)
                        if b > a:
                            keep.append(raw[x : int(ends[a])])
                            x, seen, left = int(ends[b]), b, left - (b - a)
                    keep.append(raw[x : int(off[d + 1])])
                    new[hit[d]] = b"".join(keep).decode()
                    if not left:
                        gone.append(hit[d])
                columns[place] = pa.array(new, text.type)
                if gone:
                    stay = pa.array(np.setdiff1d(np.arange(hi - lo), gone))
                    columns = [c.take(stay) for c in columns]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])


def without_repeats(docs: DataFrame, **settings) -> DataFrame:
    """docs with the repeated units cut from all documents but the first; a document of which no word is left goes.

    Other columns stay as they were; rows that share a doc_id are cut alike, as far as they have the words.
    """
    ident, spans = common.fresh(docs, "gone_id", "gone_spans")
    gone = repeated(docs, **settings).where("not kept").groupBy(F.col("doc_id").alias(ident)).agg(F.collect_list(F.struct("start", "end")).alias(spans))
    hit = docs.join(gone, docs["doc_id"] == gone[ident], "left").drop(ident)
    place = docs.columns.index("text")
    return hit.mapInArrow(lambda it: _cut(it, place), docs.schema)
