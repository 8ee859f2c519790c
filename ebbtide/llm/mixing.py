"""Mixing sources to target weights by Pfair scheduling.

Block j of a source with weight w of the total P may be placed from slot floor(j P / w) on and must be before
slot ceil((j + 1) P / w).  Giving each slot to the released block with the earliest deadline keeps every source
within one block of its share at all times.  The order has period P and depends on the weights alone, so
it is planned once; numbering the documents and placing them are DataFrame expressions.
"""

from __future__ import annotations

from collections.abc import Mapping
from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.llm import common

BLOCK = 16
#: Stretches of a source's order that are numbered apart: three hexadecimal digits of a document's hash.
DIGITS = 3


def schedule(weights: list[int]) -> list[int]:
    """For each slot of a period, which source it belongs to."""
    if not weights or min(weights) < 1:
        raise ValueError("weights must be positive whole numbers")
    total, done, out = sum(weights), [0] * len(weights), []
    for t in range(total):
        ready = [(-(-(done[i] + 1) * total // w), i) for i, w in enumerate(weights) if done[i] < w and done[i] * total // w <= t]
        i = min(ready)[1]
        done[i] += 1
        out.append(i)
    return out


def plan(weights: Mapping[str, int], rest: int) -> tuple[list[str | None], list[int], list[int]]:
    """(sources with None for all others, their weights in lowest terms, owners of the period's slots)."""
    names: list[str | None] = [*sorted(weights), None]
    w = [int(weights[k]) for k in names[:-1]] + [int(rest)]
    d = gcd(*w)
    w = [x // d for x in w]
    return names, w, schedule(w)


def mixed(docs: DataFrame, weights: Mapping[str, int], rest: int = 1, block: int = BLOCK, doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """docs with mix_group, mix_block, mix_slot and mix_position (from 0), unsorted; no row is lost or repeated.

    Sources without a weight of their own, and null, share the weight `rest` as one group (mix_group -1).  Inside a group
    rows are in order of md5(doc_id) (null ids first), then doc_id.  While all groups last, each has within one block of its share of any
    beginning of the order; slots of groups that have run out are passed over, and the others keep their proportions.
    Rows that repeat a doc_id are rows like others, in any order among themselves.  Columns of docs named mix_* are replaced.
    """
    names, w, owner = plan(weights, rest)
    period = sum(w)
    place = [[t for t, o in enumerate(owner) if o == i] for i in range(len(w))]
    ahead = [[sum(1 for s in slots if s < t) for slots in place] for t in range(period)]  # blocks of each group before a slot of the period

    docs = docs.drop("mix_group", "mix_block", "mix_slot", "mix_position")
    g, h, b, r, q, ahead_of = common.fresh(docs, "m_group", "m_hash", "m_stretch", "m_row", "m_number", "m_before")
    number = F.coalesce(F.create_map(*[F.lit(x) for i, k in enumerate(names[:-1]) for x in (k, i)])[F.col(source)] if weights else F.lit(None).cast("int"), F.lit(len(w) - 1))
    hashed = F.coalesce(F.md5(F.col(doc_id).cast("string")), F.lit(""))
    d = docs.withColumns({g: number, h: hashed}).withColumn(b, F.substring(h, 1, DIGITS))

    # each group's rows: one number for every weight
    held = {x[0]: x[1] for x in d.groupBy(g).count().collect()}
    # how many rows of the group come before each stretch: at most 16^3 rows for every weight
    sizes = d.groupBy(F.col(g).alias("sg"), F.col(b).alias("sb")).agg(F.count("*").alias("n"))
    before = sizes.select("sg", "sb", (F.sum("n").over(Window.partitionBy("sg").orderBy("sb")) - F.col("n")).alias(ahead_of))
    if len(w) <= 100:  # then at most 410,000 rows of three small columns
        before = F.broadcast(before)

    d = d.withColumn(r, F.row_number().over(Window.partitionBy(g, b).orderBy(h, doc_id)) - 1)
    d = d.join(before, (d[g] == before["sg"]) & (d[b] == before["sb"])).withColumn(q, F.col(ahead_of) + F.col(r))
    weight, slots, counts = _array(w), _array(place), _array(ahead)
    d = d.withColumn("mix_block", F.floor(F.col(q) / block).cast("long"))
    own = weight[F.col(g)]
    d = d.withColumn("mix_slot", F.floor(F.col("mix_block") / own).cast("long") * period + slots[F.col(g)][F.pmod("mix_block", own).cast("int")])
    turn, rem = F.floor(F.col("mix_slot") / period).cast("long"), F.pmod("mix_slot", F.lit(period)).cast("int")
    position = F.pmod(q, F.lit(block))
    for i, x in enumerate(w):
        if i in held:
            position = position + F.least(F.lit(held[i]), (turn * x + counts[rem][i]) * block)
    d = d.withColumn("mix_position", position.cast("long"))
    group = F.when(F.col(g) == len(w) - 1, -1).otherwise(F.col(g)).cast("int")
    return d.select(*[docs[c] for c in docs.columns], group.alias("mix_group"), "mix_block", "mix_slot", "mix_position")


def _array(x: list) -> Column:
    return F.array(*[_array(y) if isinstance(y, list) else F.lit(y) for y in x])


def mixed_sql(weights: Mapping[str, int], rest: int = 1, block: int = BLOCK) -> str:
    """DuckDB SQL over documents for (doc_id, source, mix_group, mix_block, mix_slot, mix_position)."""
    names, w, owner = plan(weights, rest)
    period = sum(w)
    seen = [0] * len(w)
    slots = []
    for t, o in enumerate(owner):
        slots.append(f"({o}, {seen[o]}, {t}, {w[o]})")
        seen[o] += 1
    case = " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(names[:-1]))
    group = f"CASE source {case} ELSE {len(w) - 1} END" if case else "0"
    return f"""WITH d AS (SELECT doc_id, source, {group} g FROM documents),
 q AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY md5(doc_id::VARCHAR), doc_id) - 1 q FROM d),
 s(g, k, t, w) AS (VALUES {', '.join(slots)}),
 p AS (SELECT q.*, q.q // {block} b, (q.q // {block}) // s.w * {period} + s.t slot FROM q JOIN s ON s.g = q.g AND s.k = (q.q // {block}) % s.w)
SELECT doc_id, source, (CASE WHEN g = {len(w) - 1} THEN -1 ELSE g END)::INTEGER AS mix_group, b AS mix_block, slot AS mix_slot,
 row_number() OVER (ORDER BY slot, q) - 1 AS mix_position FROM p"""
