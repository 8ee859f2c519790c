"""Which elements share a window.

The layout of a stream is a function of its length sequence and its number of elements alone: with
one-element appends an adjacent pair of windows that spans L elements merges when the age of its
newest element reaches the start of the first target window of length L or more.  So layouts are
planned once for each number of elements, on the executors, never by looking at values; for base 2 they have a closed form
in bit arithmetic, which stays inside generated code and needs no join.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.plans.sequences import MAX_LENGTH, Exponential, Sequence


class Planner:
    """Target markers of one sequence, memoised as far as asked for."""

    def __init__(self, seq: Sequence) -> None:
        self.seq = seq
        self._next = seq.lengths()
        self._starts: list[int] = []  # age at which each target window begins
        self._ends: list[int] = []
        self._long: list[int] = []  # record lengths, and where each is first reached
        self._first: list[int] = []
        self._grow()

    def _grow(self) -> None:
        length = next(self._next)
        start = self._ends[-1] if self._ends else 0
        self._starts.append(start)
        self._ends.append(start + length)
        if not self._long or length > self._long[-1]:
            self._long.append(length)
            self._first.append(start)

    @property
    def first_window_size(self) -> int:
        return self._ends[0]

    def first_marker(self, length: int) -> int | None:
        """Age at which the first target window of at least that length begins."""
        if length > MAX_LENGTH:
            return None
        while self._long[-1] < length:
            self._grow()
        return self._first[bisect_left(self._long, length)]

    def first_containing_time(self, left: int, right: int, now: int) -> int | None:
        """The first count of elements >= now at which counts [left, right] lie in one target window."""
        length, age = right - left + 1, now - 1 - right
        marker = self.first_marker(length)
        if marker is None:
            return None
        if marker >= age:
            return marker + right + 1
        while self._starts[-1] <= age:
            self._grow()
        i = bisect_right(self._starts, age)
        lo, hi = self._starts[i - 1], self._starts[i]
        if now - 1 - left <= hi:
            return now
        return None if hi - lo + 1 < length else hi + right + 2

    def covering(self, n: int) -> list[int]:
        """Lengths of the leading target windows that together hold at most n elements."""
        while self._ends[-1] <= n:
            self._grow()
        return [e - s for s, e in zip(self._starts, self._ends) if e <= n]

    def cut(self, n: int) -> list[int]:
        """Sizes into which a full buffer of n elements is cut, oldest (largest) first."""
        return self.covering(n)[::-1]


class Layout:
    """Windows of a growing stream as count spans, merged as elements arrive one at a time."""

    def __init__(self, planner: Planner, spans: Iterable[tuple[int, int]] = ()) -> None:
        self.planner = planner
        self.end: dict[int, int] = {}
        self._succ: dict[int, int] = {}
        self._pred: dict[int, int] = {}
        self._due: list[tuple[int, int, int]] = []
        self.last: int | None = None
        self.n = 0
        for lo, hi in spans:
            self.n = hi + 1
            self._push(lo, hi)

    def _push(self, lo: int, hi: int) -> None:
        self.end[lo] = hi
        if self.last is not None:
            self._succ[self.last], self._pred[lo] = lo, self.last
            self._schedule(self.last)
        self.last = lo

    def _schedule(self, w: int) -> None:
        s = self._succ.get(w)
        if s is not None:
            due = self.planner.first_containing_time(w, self.end[s], self.n)
            if due is not None:
                heapq.heappush(self._due, (due, w, self.end[s]))

    def append(self, size: int = 1) -> list[tuple[int, int]]:
        """Adds a window of that many elements; returns the pairs (kept, absorbed) of window starts that merged, in order."""
        c = self.n
        self.n += size
        self._push(c, self.n - 1)
        merged = []
        while self._due and self._due[0][0] <= self.n:
            _, w, end = heapq.heappop(self._due)
            s = self._succ.get(w)
            if w not in self.end or s is None or self.end[s] != end:
                continue  # the pair has changed since
            merged.append((w, s))
            self.end[w] = self.end.pop(s)
            after = self._succ.pop(s, None)
            self._pred.pop(s)
            if after is None:
                self._succ.pop(w)
                self.last = w
            else:
                self._succ[w], self._pred[after] = after, w
                self._schedule(w)
            if w in self._pred:
                self._schedule(self._pred[w])
        return merged

    def copy(self) -> Layout:
        other = Layout(self.planner)
        other.end, other._succ, other._pred = dict(self.end), dict(self._succ), dict(self._pred)
        other._due, other.last, other.n = list(self._due), self.last, self.n
        return other

    def spans(self) -> list[tuple[int, int]]:
        return sorted(self.end.items())


def buffered_spans(seq: Sequence, n: int, buffer: int) -> list[tuple[int, int]]:
    """Windows of n elements as they come from a buffer of at most that size: each full buffer is cut largest first.

    A buffer holds as many leading target windows as fit; what is left at the end is cut the same way, and
    then element by element.
    """
    planner = Planner(seq)
    full = planner.cut(buffer)
    out, at = [], 0
    for size in [*(full * (n // sum(full)) if full else []), *planner.cut(n % sum(full) if full else n)]:
        out.append((at, at + size - 1))
        at += size
    return out + [(c, c) for c in range(at, n)]


def layouts(seq: Sequence, counts: Iterable[int], buffer: int = 0) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(n, spans) for each distinct n, all from one run up to the largest."""
    planner = Planner(seq)
    run, full = Layout(planner), planner.cut(buffer) if buffer else [1]
    for n in sorted({int(x) for x in counts if x and x > 0}):
        while full and run.n + sum(full) <= n:
            for size in full:
                run.append(size)
        last = run
        if run.n < n:  # an unfinished buffer is cut as far as it goes
            last = run.copy()
            rest = n - last.n
            for size in [*planner.cut(rest), *[1] * (rest - sum(planner.cut(rest)))]:
                last.append(size)
        yield n, last.spans()


def exp2_key(c: Column, n: Column) -> tuple[Column, Column]:
    """(level, place): the window of the element with 0-based count c among n, for base 2.

    Sizes are the digits of n in bijective base 2: level j has 1 + bit j of n - (2^k - 1) windows of size 2^j.
    """
    one = F.lit(1).cast("long")
    floor_log = lambda x: (F.length(F.bin(x)) - 1).cast("int")
    shl = lambda j: F.call_function("shiftleft", one, j)
    r = n - (shl(floor_log(n + 1)) - 1)
    age = n - 1 - c
    begin = lambda j: (shl(j) - 1) + r.bitwiseAND(shl(j) - 1)
    j0 = floor_log(age + 1)
    j = F.when(begin(j0) <= age, j0).otherwise(j0 - 1)
    return j, F.call_function("shiftright", age - begin(j), j)


def layout_frame(counts: DataFrame, seq: Sequence, buffer: int = 0) -> DataFrame:
    """(n, count_start, count_end) of the layouts for numbers of elements (n), planned where they are.

    Numbers go to tasks by range and a task plans all of its own in one run up to the largest, in time proportional to that.
    """

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ns = [x for batch in batches for x in batch.column(0).to_pylist()]  # 8 bytes for each distinct size of a stream
        for n, spans in layouts(seq, ns, buffer):
            for i in range(0, len(spans), 50_000):
                part = spans[i : i + 50_000]
                columns = [[n] * len(part), [x[0] for x in part], [x[1] for x in part]]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["n", "count_start", "count_end"])

    return counts.select("n").distinct().repartitionByRange("n").mapInArrow(plan, "n long, count_start long, count_end long")


def with_window(df: DataFrame, seq: Sequence, stream: str = "stream_id", c: str = "c", n: str = "n", gaps: bool = False, buffer: int = 0) -> tuple[DataFrame, list[str]]:
    """df with columns that together name each row's window, and those columns' names.

    Base 2 takes the closed form.  Otherwise the layouts of the distinct numbers of elements are joined by (n, count) and
    window starts are carried forward along the stream.  With gaps (rows need not begin where a window does) each stream gets
    its window starts as rows of their own for the carrying, so the work is in proportion to rows and windows.
    """
    if isinstance(seq, Exponential) and seq.base == 2.0 and not buffer:
        j, m = exp2_key(F.col(c), F.col(n))
        return df.withColumns({"w_level": j, "w_place": m}), ["w_level", "w_place"]
    plan = layout_frame(df.select(F.col(n).alias("n")), seq, buffer).select(F.col("n").alias("l_n"), F.col("count_start").alias("l_c"))
    if gaps:
        starts = df.select(stream, n).distinct().join(plan, F.col(n) == F.col("l_n")).select(stream, F.col("l_c").alias(c), F.col("l_c"))
        both = df.withColumn("l_c", F.lit(None).cast("long")).unionByName(starts, allowMissingColumns=True)
        carried = F.max("l_c").over(Window.partitionBy(stream).orderBy(c).rangeBetween(Window.unboundedPreceding, Window.currentRow))
        return both.withColumn("w_start", carried).where("l_c is null").drop("l_c"), ["w_start"]
    marked = df.join(plan, (F.col(n) == F.col("l_n")) & (F.col(c) == F.col("l_c")), "left")
    carried = F.last("l_c", ignorenulls=True).over(Window.partitionBy(stream).orderBy(c))
    return marked.withColumn("w_start", carried).drop("l_n", "l_c"), ["w_start"]
