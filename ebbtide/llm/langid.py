"""Language identification: a bidirectional gated recurrent network over bytes.

Trained in numpy by backpropagation through time on windows of a bounded sample.  Every byte of a text
gets a distribution over the languages; the document's is their mean.  Texts are read whole, in stretches of
WINDOW bytes that run as one batch, so the cost follows the bytes and a very long text needs no more
memory than a short one.  Both directions start afresh, from zero states, in every stretch: a byte is labelled from
what its stretch holds.  A-Z count as a-z.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.llm import common, flat

#: The bounds of the training sample: documents of a language, documents in all, and stretches of EXCERPT characters drawn from all over each.
PER_LANG, SAMPLE_DOCS, EXCERPTS, EXCERPT = 300, 20_000, 32, 40
HIDDEN, WINDOW, BATCH = 8, 128, 2048


@dataclass
class Direction:
    """One reading direction: what a byte adds to the gates (3H x 256), and the recurrent weights (3H x H)."""

    table: np.ndarray
    u: np.ndarray

    def step(self, byte: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        n = len(h)
        x, a = self.table.take(byte, axis=1), self.u @ h
        zr = np.tanh((x[: 2 * n] + a[: 2 * n]) * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)
        z, r, an = zr[:n], zr[n:], a[2 * n :]
        c = np.tanh(x[2 * n :] + r * an)
        return c + z * (h - c), z, r, c, an

    def run(self, text: np.ndarray) -> np.ndarray:
        """States after each byte; text: steps x windows, states: steps x H x windows."""
        h = np.zeros((self.u.shape[1], text.shape[1]), np.float32)
        out = np.empty((len(text), *h.shape), np.float32)
        for t in range(len(text)):
            h = self.step(text[t], h)[0]
            out[t] = h
        return out

    def gradients(self, text: np.ndarray, kept: list, d_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backpropagation through time; kept: (h before, z, r, c, an) of each step."""
        n = self.u.shape[1]
        du, dx, dh = np.zeros_like(self.u), np.empty((len(text), 3 * n, text.shape[1]), np.float32), 0
        for t in range(len(text) - 1, -1, -1):
            h, z, r, c, an = kept[t]
            dh = dh + d_out[t]
            dc = dh * (1 - z) * (1 - c * c)
            dz = dh * (h - c) * z * (1 - z)
            dr = dc * an * r * (1 - r)
            da = np.concatenate([dz, dr, dc * r])
            du += da @ h.T
            dx[t] = np.concatenate([dz, dr, dc])
            dh = dh * z + self.u.T @ da
        table = np.zeros((256, 3 * n), np.float32)
        np.add.at(table, text.ravel(), dx.transpose(0, 2, 1).reshape(-1, 3 * n))
        return table.T.copy(), du


@dataclass
class Model:
    langs: list[str]
    fore: Direction
    back: Direction
    out: np.ndarray  # languages x 2H
    bias: np.ndarray

    def probabilities(self, text: pa.Array) -> np.ndarray:
        """Pooled over all bytes of each text: texts x languages; zeros without bytes."""
        data, off = flat.span(text)
        data, size = flat.LOWER[data], np.diff(off)
        per = -(-size // WINDOW)
        owner = np.repeat(np.arange(len(size)), per)
        begin = np.repeat(off[:-1] - np.concatenate([[0], np.cumsum(per)])[:-1] * WINDOW, per) + np.arange(per.sum()) * WINDOW
        long = np.minimum(off[1:][owner] - begin, WINDOW)
        total = np.zeros((len(size), len(self.langs)))
        order = np.argsort(-long, kind="stable")  # windows of like length together
        padded = np.concatenate([data, np.zeros(WINDOW, np.uint8)])
        for i in range(0, len(order), BATCH):
            w = order[i : i + BATCH]
            steps = int(long[w[0]])
            x = padded[begin[w][None, :] + np.arange(steps)[:, None]]
            live = np.arange(steps)[:, None] < long[w][None, :]
            # backwards: each window from its own last byte
            turn = np.where(live, long[w][None, :] - 1 - np.arange(steps)[:, None], np.arange(steps)[:, None])
            hb = self.back.run(np.take_along_axis(x, turn, 0))
            ragged = not live.all()
            if ragged:
                hb = np.take_along_axis(hb, turn[:, None, :], 0)
            else:
                hb = hb[::-1]
            p = np.zeros((len(self.langs), len(w)), np.float32)
            h = np.zeros((HIDDEN, len(w)), np.float32)
            for t in range(steps):
                h = self.fore.step(x[t], h)[0]
                y = np.exp(self.out[:, :HIDDEN] @ h + self.out[:, HIDDEN:] @ hb[t] + self.bias[:, None])
                y /= y.sum(0)
                p += y * live[t] if ragged else y
            np.add.at(total, owner[w], p.T)
        return total / np.maximum(size, 1)[:, None]


def fit(texts: list[bytes], langs: list[str], steps: int = 260, batch: int = 96, length: int = 40, seed: int = 5) -> Model:
    """Trains on random windows, languages in equal shares."""
    rng = np.random.Generator(np.random.PCG64(seed))
    names = sorted(set(langs))
    by = [[np.frombuffer(t, np.uint8) for t, x in zip(texts, langs) if x == k and t] for k in names]
    names, by = [k for k, x in zip(names, by) if x], [x for x in by if x]
    n, c = HIDDEN, max(len(names), 1)
    f32 = lambda x: x.astype(np.float32)
    make = lambda: Direction(f32(rng.normal(0, 0.3, (3 * n, 256))), f32(rng.normal(0, 0.3, (3 * n, n))))
    m = Model(names, make(), make(), f32(rng.normal(0, 0.3, (c, 2 * n))), np.zeros(c, np.float32))
    if len(names) < 2:
        return m
    params = [m.fore.table, m.fore.u, m.back.table, m.back.u, m.out, m.bias]
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for k in range(1, steps + 1):
        y = rng.integers(0, c, batch)
        x, live = np.full((length, batch), 32, np.uint8), np.zeros((length, batch), np.float32)
        for i, lang in enumerate(y.tolist()):
            t = by[lang][rng.integers(len(by[lang]))]
            size = int(min(len(t), rng.integers(8, length + 1)))
            at = rng.integers(0, len(t) - size + 1)
            x[:size, i], live[:size, i] = flat.LOWER[t[at : at + size]], 1
        states, kept = [], []
        for d, text in ((m.fore, x), (m.back, x[::-1])):
            h, out, keep = np.zeros((n, batch), np.float32), [], []
            for t in range(length):
                new, z, r, cc, an = d.step(text[t], h)
                keep.append((h, z, r, cc, an))
                h = new
                out.append(h)
            states.append(np.stack(out))
            kept.append(keep)
        hf, hb = states[0], states[1][::-1]
        s = m.out[:, :n] @ hf + m.out[:, n:] @ hb + m.bias[:, None]
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[:, y, np.arange(batch)] -= 1
        g = p * live[:, None, :] / live.sum()
        both = np.concatenate([hf, hb], 1)
        grads = [
            *m.fore.gradients(x, kept[0], np.matmul(m.out[:, :n].T, g)),
            *m.back.gradients(x[::-1], kept[1], np.matmul(m.out[:, n:].T, g)[::-1]),
            np.tensordot(g, both, ((0, 2), (0, 2))),
            g.sum((0, 2)),
        ]
        norm = np.sqrt(sum(float((q * q).sum()) for q in grads))
        rate = 0.03 * min(1.0, 2 * (1 - k / (steps + 1)))
        for q, grad, a, b in zip(params, grads, m1, m2):
            grad = grad / max(1.0, norm)
            a += 0.1 * (grad - a)
            b += 0.01 * (grad * grad - b)
            q -= (rate * (a / (1 - 0.9**k)) / (np.sqrt(b / (1 - 0.99**k)) + 1e-8)).astype(np.float32)
    return m


def training_sample(docs: DataFrame, per_lang: int = PER_LANG) -> tuple[list[bytes], list[str]]:
    """EXCERPTS stretches of each of at most per_lang texts of a language outside part 2, drawn by a hash of their ids.

    Only ids, languages and hashes of texts are ranked; what is drawn is a row, so a doc_id may have several, null texts among them.
    The stretches begin anywhere in the whole text.
    """
    known = docs.where("lang is not null and text is not null and doc_id is not null").where(common.crc_part("doc_id") != 2)
    known = known.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    mark = F.xxhash64("text")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64(F.lit("lang"), "doc_id"), "doc_id", "mark"))
    drawn = known.select("doc_id", "lang", mark.alias("mark")).withColumn("rank", rank).where(F.col("rank") <= per_lang)
    drawn = drawn.orderBy("rank", "lang", "doc_id", "mark").limit(SAMPLE_DOCS).select("doc_id", "lang", "mark").distinct()
    # at most SAMPLE_DOCS rows of an id, a language's name and a number are broadcast
    rows = known.withColumn("mark", mark).join(F.broadcast(drawn), ["doc_id", "lang", "mark"])
    places = F.greatest(F.length("text") - EXCERPT + 1, F.lit(1))
    begin = F.transform(F.sequence(F.lit(1), F.lit(EXCERPTS)), lambda i: F.pmod(F.xxhash64("doc_id", "mark", i), places).cast("int") + 1)
    rows = rows.select("lang", "doc_id", "mark", F.transform(begin, lambda i: F.substr("text", i, F.lit(EXCERPT))).alias("parts"))
    rows = rows.dropDuplicates(["doc_id", "lang", "mark"]).orderBy("doc_id", "lang", "mark").collect()
    return [x.encode() for r in rows for x in r["parts"]], [r["lang"] for r in rows for _ in r["parts"]]


def identify(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row per row of docs.

    Learns from text and non-null lang of documents whose crc32(doc_id as text) mod 4 isn't 2; only
    the text is an input of a prediction.  A text that is null or has no letter (Unicode category L) is `und`
    with score 0; so is every text when nothing could be learnt from.  One learnt language is always
    predicted, with score 1.  held_out is false for a null doc_id.
    """
    model = fit(*training_sample(docs, per_lang))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, text in flat.chunks(batch.column(1)):
                p = model.probabilities(text) if model.langs else np.zeros((hi - lo, 1))
                best = p.argmax(1)
                names = [model.langs[i] if model.langs else "und" for i in best.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(lo, hi - lo) for i in (0, 2)), pa.array(names, pa.string()), pa.array(p[np.arange(hi - lo), best].astype(np.float64))],
                    names=["doc_id", "letters", "lang", "p"],
                )

    two = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    out = two.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, letters boolean, lang string, p double")
    score = F.when(F.col("letters"), F.least(F.greatest("p", F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))
    return out.select(
        "doc_id", F.coalesce(common.crc_part("doc_id") == 2, F.lit(False)).alias("held_out"),
        F.when(F.col("letters"), F.col("lang")).otherwise(F.lit("und")).alias("lang_pred"), score.alias("score"),
    )
