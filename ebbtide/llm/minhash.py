"""MinHash near-dedup with an LSH forest.

Every distinct shingle set has `trees` signatures of `depth` values.  Sets whose signatures in a tree share a
prefix are a region, which is never cut: one too large for a task is split into pairs of blocks.  The prefix a pair
must share adapts to the region: it starts at two values and grows while the region holds more than `crowd` rows, but
only as deep as the trees together still miss fewer than MISSED pairs.  Inside a
region a sketch of all 128 values screens pairs and a spanning forest of the pairs that pass comes
out, linear in the region however alike its rows are.  The connected components of those edges
only say which sets have to meet: inside each component (heavy ones in pairs of blocks) links are
decided on the full sets, and components of the confirmed links are the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm import common, flat

TREES, DEPTH, FIRST_DEPTH, CROWD = 16, 8, 2, 2048
#: The chance that the sketch of 128 values of 2 bits screens a pair off that is as similar as asked: 90 must agree at 0.85, 83 at 0.8.
SCREENED = 1e-8
#: Elements of shingle sets in one block of a heavy component.
BLOCK_ELEMENTS = 1_500_000
#: Rows of a region that one task may compare.
HOLD = 50_000
#: The share of linked pairs that may be missed by crowded regions.
MISSED = 1e-5

_rng = np.random.Generator(np.random.PCG64(77))
_A = _rng.integers(1, 2**32, TREES * DEPTH, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_B = _rng.integers(0, 2**32, TREES * DEPTH, dtype=np.uint64).astype(np.uint32)


def deepest(num: int, den: int) -> int:
    """The longest prefix that pairs at similarity num / den share in some tree but for MISSED of them; 4 at 0.85, 2 at 0.8."""
    ok = [d for d in range(FIRST_DEPTH, DEPTH + 1) if (1 - (num / den) ** d) ** TREES <= MISSED]
    return max(ok, default=FIRST_DEPTH)


def signatures(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(id, text) to (id, n, d1, d2, sig, sketch); sig has the trees' values as big-endian 16-bit numbers."""
    m = TREES * DEPTH
    for batch in batches:
        for lo, hi, text in flat.chunks(batch.column(1)):
            h, _, _, woff = flat.words(*flat.span(text))
            s, off = flat.shingles(h, woff, k)
            n, (d1, d2) = np.zeros(hi - lo, np.int64), np.zeros((2, hi - lo), np.uint64)
            for i in range(hi - lo):
                x = np.sort(s[off[i] : off[i + 1]])
                if len(x):
                    x = x[np.append(True, x[1:] != x[:-1])]
                    n[i], d1[i], d2[i] = len(x), x.sum(), flat.mix(x + np.uint64(99)).sum()
            sig = np.zeros((hi - lo, m), np.uint16)
            if full := np.flatnonzero(np.diff(off)).tolist():
                x, at = (s >> np.uint64(32)).astype(np.uint32), off[full]
                for j in range(m):
                    low = np.minimum.reduceat(x * _A[j] + _B[j], at)
                    sig[full, j] = (low * np.uint32(0x9E3779B1)) >> np.uint32(16)
            sketch = common.two_bit(sig)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), pa.array(n), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), _binary(sig.astype(">u2")), _binary(sketch)],
                names=["id", "n", "d1", "d2", "sig", "sketch"],
            )


def _binary(x: np.ndarray) -> pa.Array:
    wide = x.shape[1] * x.itemsize
    off = np.arange(len(x) + 1, dtype=np.int32) * np.int32(wide)
    return pa.BinaryArray.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(x))])


def _rows(col: pa.Array, dtype: str, wide: int) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    _, at, raw = col.buffers()
    off = np.frombuffer(at, np.int32)[col.offset : col.offset + len(col) + 1]
    return np.frombuffer(raw, np.uint8)[off[0] : off[-1]].view(dtype).reshape(len(col), wide)


def sketch_forest(ids: np.ndarray, sketch: np.ndarray, least: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs whose sketches agree in `least` values, and whose own differs or is 0."""

    def near(i: int, rest: np.ndarray) -> np.ndarray:
        hit = common.agreeing(sketch[rest], sketch[i]) >= least
        return hit if own is None or own[i] == 0 else hit & (own[rest] != own[i])

    a, b = common.forest(len(ids), near)
    return ids[a], ids[b]


def _region(lcp: np.ndarray, ids: np.ndarray, sketch: np.ndarray, lo: int, hi: int, depth: int, out: list, most: int, least: int) -> None:
    """lcp[i]: values that the signatures of rows i - 1 and i share. Goes deeper while the region is crowded, down to most."""
    if hi - lo < 2:
        return
    if hi - lo <= CROWD or depth >= most:
        out.append(sketch_forest(ids[lo:hi], sketch[lo:hi], least))
    else:
        cuts = [lo, *(lo + 1 + np.flatnonzero(lcp[lo + 1 : hi] <= depth)).tolist(), hi]
        for x, y in zip(cuts, cuts[1:]):
            _region(lcp, ids, sketch, x, y, depth + 1, out, most, least)


def candidates(batches: Iterator[pa.RecordBatch], most: int, least: int) -> Iterator[pa.RecordBatch]:
    """Rows (tree, region, bi, bj, sig, id, sketch) by region and block pair, sorted by sig, to edges (a, b)."""
    keys = ["tree", "region", "bi", "bj"]
    for table in common.grouped(batches, keys):
        at = common.starts(table, keys)
        sig, sketch = _rows(table.column("sig"), ">u2", DEPTH), _rows(table.column("sketch"), "<u8", 4)
        ids, depth = table.column("id").to_numpy(), table.column("region").combine_chunks()
        same = np.logical_and.accumulate(sig[1:] == sig[:-1], axis=1).sum(1)
        lcp = np.concatenate([[0], same])
        size, out = np.diff(at), []
        two = at[:-1][size == 2]
        two = two[common.agreeing(sketch[two], sketch[two + 1]) >= least]
        out.append((ids[two], ids[two + 1]))
        for i in np.flatnonzero(size > 2).tolist():
            _region(lcp, ids, sketch, int(at[i]), int(at[i + 1]), len(depth[int(at[i])].as_py()) // 2, out, most, least)
        a, b = (np.concatenate(x) for x in zip(*out))
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def regions(rows: DataFrame, most: int) -> DataFrame:
    """(tree, sig, id, sketch) with region, the shortest prefix of sig that no more than HOLD rows share, or that of most values; those still larger go into pairs of blocks bi, bj."""
    whole = lambda df: df.withColumns({"bi": F.lit(0), "bj": F.lit(0)})
    left, done = rows, []
    for depth in range(FIRST_DEPTH, most + 1):
        left = left.withColumn("region", F.substring("sig", 1, 2 * depth))
        big = common.materialise(left.groupBy("tree", "region").count().where(F.col("count") > HOLD).select("tree", "region"), "minhash-big")
        if not big.limit(1).count():
            done.append(whole(left))
            break
        done.append(whole(left.join(big, ["tree", "region"], "left_anti")))
        left = left.join(big, ["tree", "region"], "left_semi")
    else:
        done.append(common.block_pairs(left.withColumn("one", F.lit(1)), ["tree", "region"], "one", "id", max(HOLD // 2, 1)))
    shown = ["tree", "region", "bi", "bj", "sig", "id", "sketch"]
    out = done[0].select(*shown)
    for x in done[1:]:
        out = out.unionByName(x.select(*shown))
    return out


def shingle_sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(text, ...) to (..., items): the sorted distinct shingle hashes as bytes."""
    for batch in batches:
        for lo, hi, text in flat.chunks(batch.column(0)):
            h, _, _, woff = flat.words(*flat.span(text))
            s, off = flat.shingles(h, woff, k)
            items = [np.unique(s[off[i] : off[i + 1]]).tobytes() for i in range(hi - lo)]
            rest = [batch.column(i).slice(lo, hi - lo) for i in range(1, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(items, pa.binary())], names=[*batch.schema.names[1:], "items"])


def set_forest(sets: list[np.ndarray], num: int, den: int, apart: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links den * |x & y| >= num * |x | y| among sorted sets of distinct items."""
    size = np.array([len(x) for x in sets], np.int64)
    items, inverse = np.unique(np.concatenate(sets), return_inverse=True) if len(sets) else (np.empty(0), np.empty(0, np.int64))
    off = np.concatenate([[0], np.cumsum(size)])
    flag = np.zeros(len(items), bool)

    def near(i: int, rest: np.ndarray) -> np.ndarray:
        ok = (np.minimum(size[rest], size[i]) * den >= np.maximum(size[rest], size[i]) * num) & (size[rest] > 0)
        hit, some = np.zeros(len(rest), bool), rest[ok]
        if len(some):
            mine = inverse[off[i] : off[i + 1]]
            flag[mine] = True
            n, o = size[some], np.concatenate([[0], np.cumsum(size[some])])
            common_ = np.add.reduceat(flag[inverse[np.repeat(off[some] - o[:-1], n) + np.arange(o[-1])]].astype(np.int64), o[:-1])
            flag[mine] = False
            hit[ok] = den * common_ >= num * (size[i] + n - common_)
        return hit

    return common.forest(len(sets), near)


def _pair(x: np.ndarray, y: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.sort(np.concatenate([x, y]))
    same = int((both[1:] == both[:-1]).sum())
    linked = same > 0 and den * same >= num * (len(both) - same)
    return np.zeros(int(linked), np.int64), np.ones(int(linked), np.int64)


def confirm(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Rows (component, bi, bj, id, items) by group, to confirmed edges (a, b)."""
    keys = ["component", "bi", "bj"]
    for table in common.grouped(batches, keys):
        at, ids, col = common.starts(table, keys), table.column("id").to_numpy(), table.column("items")
        a, b = [], []
        for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
            sets = [np.frombuffer(x, np.uint64) for x in (y.as_buffer() for y in col.slice(lo, hi - lo))]
            x, y = _pair(*sets, num, den) if len(sets) == 2 else set_forest(sets, num, den)
            a.append(ids[lo:hi][x])
            b.append(ids[lo:hi][y])
        a, b = np.concatenate(a), np.concatenate(b)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def near_duplicates(docs: DataFrame, words: int = 3, num: int = 85, den: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row per row of docs.

    Words are the runs of other characters than space and \\t\\n\\v\\f\\r, A-Z lower-cased.  Two documents
    are linked when den * |x & y| >= num * |x | y| for their sets of distinct shingles of `words` words; a
    shorter text is one shingle, and a text without words (or null) has none and is linked with
    nothing.  component_id is the smallest doc_id reachable over links, itself included; kept tells
    whether that is the row's own.  Rows that share a doc_id count as one document for links; a null
    doc_id takes part in nothing: its component_id is null and it is kept.  Other columns are ignored.
    """
    two = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    made = "id long, n long, d1 long, d2 long, sig binary, sketch binary"
    sig = common.materialise(two.mapInArrow(lambda it: signatures(it, words), made), "minhash-sig")

    # equal sets: the smallest id stands for all
    full = sig.where("n > 0 and id is not null")
    reps = full.groupBy("d1", "d2", "n").agg(F.min_by(F.struct("id", "sig", "sketch"), "id").alias("r")).select("d1", "d2", F.col("n").alias("size"), "r.*")
    reps = common.materialise(reps, "minhash-reps")
    rows = reps.select(F.posexplode(F.array([F.substring("sig", 1 + 2 * DEPTH * t, 2 * DEPTH) for t in range(TREES)])).alias("tree", "sig"), "id", "sketch")
    most, least = deepest(num, den), common.screen(TREES * DEPTH, num, den, SCREENED)
    rows = common.clustered(regions(rows, most), ["tree", "region", "bi", "bj"], ["sig", "id"])
    met = common.connected_components(rows.mapInArrow(lambda it: candidates(it, most, least), "a long, b long"))

    # which of them are linked, on the full sets: every text is cut into shingles once
    inside = met.join(reps.select(F.col("id").alias("node"), "size"), "node")
    inside = common.blocks(inside, ["component"], "size", BLOCK_ELEMENTS).select("node", "component", "nb")
    texts = two.where("id is not null and text is not null").join(inside, F.col("id") == F.col("node"))
    sets = texts.select("text", "id", "component", "nb").mapInArrow(lambda it: shingle_sets(it, words), "id long, component long, nb int, items binary")
    sets = common.clustered(common.paired(sets, "id"), ["component", "bi", "bj"])
    links = sets.mapInArrow(lambda it: confirm(it, num, den), "a long, b long")
    comp = common.connected_components(links)

    named = reps.join(comp, F.col("id") == F.col("node"), "left").select("d1", "d2", "size", F.coalesce("component", "id").alias("component_id"))
    out = sig.join(named, (sig.d1 == named.d1) & (sig.d2 == named.d2) & (sig.n == named["size"]) & sig.id.isNotNull() & (sig.n > 0), "left")
    comp_id = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), comp_id.alias("component_id"), F.coalesce(F.col("id") == comp_id, F.lit(True)).alias("kept"))


def without_copies(docs: DataFrame, **settings) -> DataFrame:
    """docs with one document of each component, that of the smallest doc_id; rows with a null doc_id stay."""
    ident = common.fresh(docs, "copy_id")[0]
    gone = near_duplicates(docs, **settings).where("not kept").select(F.col("doc_id").alias(ident)).distinct()
    return docs.join(gone, docs["doc_id"] == gone[ident], "left_anti")
