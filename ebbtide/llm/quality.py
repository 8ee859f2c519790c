"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line is good or bad, judged by its own features and those of the lines before and after, with
weights for the transitions.  The document's quality is the mean of its lines' good marginals
(forward-backward), weighted by line length and put through a fitted logistic curve.  Training lines
take their document's label at first; then lines in bad documents that the model holds good are
relabelled, since a bad document may hold good lines, and the model is fitted again.  All steps run on flat
arrays of lines: forward-backward is a segmented prefix product of 2 x 2 matrices.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm import common, flat

#: The bound of the training sample: labelled documents, which are read whole.
SAMPLE_DOCS = 3000
_CLASSES = [b"#$%&*|<>=~^@\\{}[]_+/", b"!", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"|", bytes(range(128, 256)), b".,;:", bytes(range(97, 123))]
_LUT = np.zeros((len(_CLASSES), 256), np.uint8)
for _i, _c in enumerate(_CLASSES):
    _LUT[_i, list(_c)] = 1
WIDE = 14


def line_features(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, weights, offsets): of all lines that aren't blank, their bytes, and each text's lines."""
    data, off = flat.span(text)
    h, s, e, woff = flat.words(data, off)
    cuts = np.unique(np.concatenate([off, np.flatnonzero(data == 10)]))
    # a line is a stretch between cuts that holds words
    line = np.searchsorted(cuts, s, "right")
    new = np.append(True, line[1:] != line[:-1]) if len(s) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    n = len(first)
    loff = np.searchsorted(first, woff)
    if not n:
        return np.zeros((0, WIDE)), np.zeros(0), loff
    last = np.append(first[1:], len(s)) - 1
    ls, le = s[first], e[last]
    size = (le - ls).astype(np.float64)
    count = (last - first + 1).astype(np.float64)
    f = np.empty((n, WIDE))
    f[:, 0] = np.log1p(size) / 5
    for i in range(len(_CLASSES)):
        c = np.concatenate([[0], np.cumsum(_LUT[i][data], dtype=np.int64)])
        f[:, 1 + i] = (c[le] - c[ls]) / size
    f[:, 3] /= f[:, 3] + f[:, 8] + 1e-9  # of the ASCII letters, the share of capitals
    f[:, 8] = (size / count) / 10
    doc = np.repeat(np.arange(len(woff) - 1), np.diff(woff))
    rep = np.zeros(len(h))
    rep[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    f[:, 9] = np.add.reduceat(rep, first) / count
    x, soff = flat.shingles(h, woff, 3)
    owner = np.repeat(np.arange(len(soff) - 1), np.diff(soff))
    again = _repeated(flat.mix(x + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    at = np.minimum(np.arange(len(x)) - np.repeat(soff[:-1], np.diff(soff)) + np.repeat(woff[:-1], np.diff(soff)), len(h) - 1)
    f[:, 10] = np.bincount(np.searchsorted(first, at, "right") - 1, again, n) / count
    total = np.cumsum(h, dtype=np.uint64)
    text_hash = flat.mix(total[last] - total[first] + h[first] + doc[first].astype(np.uint64))
    f[:, 11] = _repeated(text_hash) & (count >= 3)
    f[:, 12] = count < 3
    f[:, 13] = 1 / count
    return f, size, loff


def _repeated(x: np.ndarray) -> np.ndarray:
    """True where an equal number is elsewhere in x."""
    order = np.argsort(x, kind="stable")
    y = x[order]
    same = np.zeros(len(x) + 1, bool)
    same[1:-1] = y[1:] == y[:-1]
    out = np.empty(len(x), bool)
    out[order] = same[:-1] | same[1:]
    return out


def with_neighbours(f: np.ndarray, loff: np.ndarray) -> np.ndarray:
    """Own, previous and next line's features (zeros beyond the text) and a constant."""
    prev, nxt = np.zeros_like(f), np.zeros_like(f)
    prev[1:], nxt[:-1] = f[:-1], f[1:]
    some = np.diff(loff) > 0
    prev[loff[:-1][some]] = 0
    nxt[loff[1:][some] - 1] = 0
    return np.concatenate([f, prev, nxt, np.ones((len(f), 1))], 1)


def _scan(m: np.ndarray, pos: np.ndarray, longest: int) -> np.ndarray:
    """Prefix products m[first] @ ... @ m[i] inside each segment, scaled; pos: place in the segment."""
    m, d = m.copy(), 1
    while d < longest:
        i = np.flatnonzero(pos >= d)
        p = np.matmul(m[i - d], m[i])
        m[i] = p / p.max((1, 2), keepdims=True)
        d *= 2
    return m


def marginals(emit: np.ndarray, trans: np.ndarray, loff: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line, and the expected transition counts; emit: each line's score for good, trans: 2 x 2 scores."""
    n = np.diff(loff)
    pos = np.arange(loff[-1]) - np.repeat(loff[:-1], n)
    rev = np.repeat(n, n) - 1 - pos
    longest = int(n.max(initial=0))
    node = np.stack([np.exp(-np.maximum(emit, 0)), np.exp(np.minimum(emit, 0))], 1)  # bad, good
    t = np.exp(trans - trans.max())
    step = t[None] * node[:, None, :]
    first = np.flatnonzero(pos == 0)
    step_f = step.copy()
    step_f[first] = node[first][:, None, :]  # no transition into the first line
    ahead = _scan(step_f, pos, longest)[:, 0, :]
    # backward: the product of the steps after a line, applied to ones
    flip = _scan(np.swapaxes(step[::-1], 1, 2), rev[::-1], longest)[::-1]
    tail = np.swapaxes(flip, 1, 2).sum(2)
    back = np.ones((len(emit), 2))
    inner = np.flatnonzero(rev > 0)
    back[inner] = tail[inner + 1]
    both = ahead * back
    good = both[:, 1] / both.sum(1)
    pair = ahead[inner][:, :, None] * step[inner + 1] * back[inner + 1][:, None, :]
    pair /= pair.sum((1, 2), keepdims=True)
    return good, pair.sum(0)


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    trans: np.ndarray
    curve: tuple[float, float]
    prior: float

    def lines(self, f: np.ndarray, loff: np.ndarray) -> np.ndarray:
        emit = np.clip(with_neighbours((f - self.mean) / self.scale, loff) @ self.weights, -30, 30)
        return marginals(emit, self.trans, loff)[0]

    def pooled(self, text: pa.Array) -> np.ndarray:
        """The length-weighted mean of the good marginals; NaN without lines."""
        f, size, loff = line_features(text)
        g = self.lines(f, loff)
        c, w = np.concatenate([[0], np.cumsum(g * size)]), np.concatenate([[0], np.cumsum(size)])
        with np.errstate(invalid="ignore", divide="ignore"):
            return (c[loff[1:]] - c[loff[:-1]]) / (w[loff[1:]] - w[loff[:-1]])

    def scores(self, text: pa.Array) -> np.ndarray:
        x = self.pooled(text)
        a, b = self.curve
        return np.where(np.isnan(x), self.prior, 1 / (1 + np.exp(-(a * np.nan_to_num(x) + b))))


def fit(texts: list[str], labels: np.ndarray, rounds: int = 2, steps: int = 200) -> Model:
    """Fits on whole texts with labels 0 or 1; a set of one class or none gives its constant."""
    labels = np.asarray(labels, np.float64)
    prior = float((labels.sum() + 1) / (len(labels) + 2))
    parts = [line_features(part) for _, _, part in flat.chunks(pa.array(texts, pa.string()))] if texts else []
    f = np.concatenate([np.zeros((0, WIDE)), *[p[0] for p in parts]])
    n = np.concatenate([np.zeros(0, np.int64), *[np.diff(p[2]) for p in parts]])
    loff = np.concatenate([[0], np.cumsum(n)])
    mean, scale = (f.mean(0), f.std(0) + 1e-3) if len(f) else (np.zeros(WIDE), np.ones(WIDE))
    x = with_neighbours((f - mean) / scale, loff)
    w, trans = np.zeros(x.shape[1]), np.zeros((2, 2))
    if len(set(labels.tolist())) < 2 or not len(f):
        return Model(mean, scale, w, trans, (0.0, float(np.log(prior / (1 - prior)))), prior)
    owner = np.repeat(labels, n)
    y = owner.copy()
    each = np.repeat(1 / np.maximum(n, 1), n)  # a document counts once, whatever its lines
    each *= np.where(owner > 0, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9))
    inner = np.flatnonzero(np.arange(len(f)) + 1 < np.repeat(loff[1:], n))
    for _ in range(rounds):
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[inner].astype(int), y[inner + 1].astype(int)), 1)
        m1, v1, m2, v2 = np.zeros_like(w), np.zeros_like(w), np.zeros((2, 2)), np.zeros((2, 2))
        for k in range(1, steps + 1):
            good, pairs = marginals(np.clip(x @ w, -30, 30), trans, loff)
            g = x.T @ ((y - good) * each) / len(labels) - 1e-3 * w
            gt = (seen - pairs) / max(len(inner), 1) - 1e-3 * trans
            m1, v1, m2, v2 = 0.9 * m1 + 0.1 * g, 0.99 * v1 + 0.01 * g * g, 0.9 * m2 + 0.1 * gt, 0.99 * v2 + 0.01 * gt * gt
            a, b = 1 - 0.9**k, 1 - 0.99**k
            w = w + 0.05 * (m1 / a) / (np.sqrt(v1 / b) + 1e-8)
            trans = trans + 0.05 * (m2 / a) / (np.sqrt(v2 / b) + 1e-8)
        good, _ = marginals(np.clip(x @ w, -30, 30), trans, loff)
        y = np.where(owner > 0, 1.0, (good > 0.5).astype(np.float64))
        lost = np.repeat(np.array([y[i:j].all() if j > i else False for i, j in zip(loff, loff[1:])]), n) & (owner == 0)
        y[lost] = 0  # a bad document keeps a bad line
    model = Model(mean, scale, w, trans, (1.0, 0.0), prior)
    pool = np.concatenate([model.pooled(part) for _, _, part in flat.chunks(pa.array(texts, pa.string()))])
    ok = ~np.isnan(pool)
    return Model(mean, scale, w, trans, _curve(pool[ok], labels[ok]), prior)


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and place of a logistic curve, by Newton steps on smoothed targets."""
    a, b = 1.0, 0.0
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        r, q = t - p, np.maximum(p * (1 - p), 1e-6)
        h = np.array([[(q * x * x).sum() + 1e-2, (q * x).sum()], [(q * x).sum(), q.sum() + 1e-2]])
        da, db = np.linalg.solve(h, [(r * x).sum() - 1e-2 * a, r.sum() - 1e-2 * b])
        size = max(abs(da), abs(db), 1.0)
        a, b = a + da / size, b + db / size
    return float(a), float(b)


def training_sample(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_DOCS) -> tuple[list[str], np.ndarray]:
    """At most `limit` labelled documents outside part 2, drawn by a hash of their ids (the classifier's documented bound).

    A doc_id whose labels contradict each other counts as 0; of texts that share a drawn id each is taken, up to the limit.
    """
    known = labels.where("quality in (0, 1) and doc_id is not null").where(common.crc_part("doc_id") != 2)
    known = known.groupBy(F.col("doc_id").alias("labelled")).agg(F.min(F.col("quality").cast("int")).alias("quality"))
    known = known.orderBy(F.xxhash64(F.lit("quality"), "labelled"), "labelled").limit(limit)
    both = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("labelled"))  # at most `limit` pairs of numbers
    rows = both.where("text is not null").orderBy("doc_id", F.xxhash64("text")).limit(limit).select("text", "quality").collect()
    return [r[0] for r in rows], np.array([r[1] for r in rows], np.float64)


def score(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of docs.

    Only labels of documents whose crc32(doc_id as text) mod 4 isn't 2 are learnt from, and only text is
    an input of a score; contradicting labels of one doc_id count as 0.  A text that is null, empty or blank gets the share of good documents
    among the training labels (smoothed).  Labels other than 0 and 1 are ignored; without labels of both
    classes every score is that share, 0.5 when there are none.  held_out is false for a null doc_id.
    """
    model = fit(*training_sample(docs, labels, sample_docs))
    two = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, text in flat.chunks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(model.scores(text))], names=["doc_id", "score"])

    out = two.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    held = F.coalesce(common.crc_part("doc_id") == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, threshold: float = 0.7) -> DataFrame:
    """The rows of docs that score() predicts to be good, with all their columns; no row moves between partitions."""
    model = fit(*training_sample(docs, labels, sample_docs))
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, text in flat.chunks(batch.column(place)):
                yield batch.slice(lo, hi - lo).filter(pa.array(model.scores(text) >= threshold))

    return docs.mapInArrow(run, docs.schema)
