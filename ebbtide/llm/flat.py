"""Words and shingles of whole Arrow string columns, in flat numpy arrays without a loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64)
_P = 0x9E3779B97F4A7C15 | 1
_Q = pow(_P, -1, 2**64)
_pow = [np.ones(1, U), np.ones(1, U)]
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow[0]) < n:
        size = max(n, CHUNK + 4096)
        for i, base in enumerate((_P, _Q)):
            x = np.full(size, base, U)
            x[0] = 1
            _pow[i] = np.cumprod(x, dtype=U)
    return _pow[0][:n], _pow[1][:n]


def span(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array and the n + 1 offsets into them; null counts as empty."""
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    kind = np.int64 if pa.types.is_large_string(arr.type) else np.int32
    off = np.frombuffer(arr.buffers()[1], kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64) if len(arr) else np.zeros(1, np.int64)
    raw = arr.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None else np.empty(0, np.uint8)
    return data, off - off[0]


def chunks(arr: pa.Array | pa.ChunkedArray, size: int = CHUNK) -> Iterator[tuple[int, int, pa.Array]]:
    """(first row, end row, slice) with about size bytes each; a longer text is alone, and whole."""
    base = 0
    for part in arr.chunks if isinstance(arr, pa.ChunkedArray) else [arr]:
        _, off = span(part)
        i = 0
        while i < len(part):
            j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
            yield base + i, base + j, part.slice(i, j - i)
            i = j
        base += len(part)


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, offsets) of all words; offsets: of each text's words. A-Z count as a-z."""
    n = len(data)
    if not n:
        z = np.empty(0, np.int64)
        return np.empty(0, U), z, z, np.zeros(len(off), np.int64)
    gap = SPACE[data]
    head = np.zeros(n + 1, bool)
    head[off] = True
    first, last = ~gap, ~gap
    first[1:] &= gap[:-1] | head[1:-1]
    last[:-1] &= gap[1:] | head[1:-1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, back = _powers(n)
    total = np.empty(n + 1, U)
    total[0] = 0
    np.cumsum(_BYTE[LOWER[data]] * power, out=total[1:])
    h = mix((total[e] - total[s]) * back[s] + (e - s).astype(U))
    return h, s, e, np.searchsorted(s, off)


def shingles(h: np.ndarray, woff: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words inside each text, and their offsets by text.

    A text of 1 to k - 1 words has one shingle, its whole sequence; one without words has none.
    """
    n = np.diff(woff)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    off = np.concatenate([[0], np.cumsum(count)])
    at = np.repeat(woff[:-1] - off[:-1], count) + np.arange(off[-1])
    size = np.repeat(np.minimum(n, k), count)
    x = np.full(len(at), 0x2545F4914F6CDD1D, U)
    padded = np.concatenate([h, np.zeros(k, U)])
    for i in range(k):
        step = mix(x * U(0x9E3779B97F4A7C15) + padded[at + i])
        x = np.where(i < size, step, x) if (size <= i).any() else step
    return x, off


def ngrams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of h[i : i + k] for every i that leaves room, whatever the texts; constant work for any k."""
    n = len(h)
    if n < k:
        return np.empty(0, U)
    power, back = _powers(n)
    total = np.empty(n + 1, U)
    total[0] = 0
    np.cumsum(h * power, out=total[1:])
    return mix((total[k:] - total[: n - k + 1]) * back[: n - k + 1] + U(k))


def sliding(x: np.ndarray, w: int, pick: np.ufunc) -> np.ndarray:
    """pick (np.minimum or np.maximum) over every w neighbours, by doubling."""
    size, out = 1, x
    while size * 2 <= w:
        out = pick(out[:-size], out[size:])
        size *= 2
    return pick(out[: len(x) - w + 1], out[w - size : len(x) - size + 1]) if size < w else out


def minimisers(h: np.ndarray, woff: np.ndarray, k: int, w: int) -> np.ndarray:
    """Places whose k-gram is least in some window of w k-grams of one text; ties are all kept.

    Any k + w - 1 words of a text hold a place, and which one depends on those words alone.
    """
    g = ngrams(h, k)
    if len(g) < w:
        return np.empty(0, np.int64)
    low = sliding(g, w, np.minimum)
    doc_end = np.repeat(woff[1:], np.diff(woff))
    inside = np.arange(len(low)) + k + w - 1 <= doc_end[: len(low)]
    low = np.where(inside, low, U(0))
    pad = np.zeros(w - 1, U)
    return np.flatnonzero(g == sliding(np.concatenate([pad, low, pad]), w, np.maximum))
