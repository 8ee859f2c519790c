"""Chat formatting: tool calls linked with their results, ordered, validated and written as canonical JSON.

An assistant's text that is a JSON object with an array `tool_calls` of {id, name, arguments} holds calls; a tool's
text {tool_call_id, content} is a result; all other texts are plain.  Calls and results are hash-joined by
conversation and identifier.  An argument that contains ${id} needs the result of that call, so calls have
levels; a call's result follows it, and both follow all that they need.  Everything is DataFrame functions; JSON
goes through the variant type, whose objects are sorted by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.llm import common


def canonical(v: Column) -> Column:
    """A variant as JSON with sorted keys and without white space."""
    return F.to_json(v)


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def _type_fits(kind: Column, want: Column) -> Column:
    return (
        F.when(kind == "STRING", want == "string").when(kind == "BOOLEAN", want == "boolean").when(kind.startswith("ARRAY"), want == "array")
        .when(kind.startswith("OBJECT"), want == "object").when(kind.endswith("INT"), want.isin("integer", "number"))
        .when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), want == "number").otherwise(want == "null")
    )


def parsed(messages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(plain messages, calls, results) of messages (conv_id, turn, role, text)."""
    looks = F.coalesce(F.col("text").rlike(r"^\s*\{"), F.lit(False))
    m = messages.select("conv_id", "turn", "role", "text").withColumn("v", F.when(looks & F.col("role").isin("assistant", "tool"), F.try_parse_json("text")))
    m = m.withColumn("calls", F.when(F.col("role") == "assistant", F.try_variant_get("v", "$.tool_calls", "array<variant>")))
    m = m.withColumn("result_id", F.when(F.col("role") == "tool", F.try_variant_get("v", "$.tool_call_id", "string")))
    some = F.coalesce(F.size("calls") > 0, F.lit(False))
    plain = m.where(~some & F.col("result_id").isNull()).select("conv_id", "turn", "role", "text")

    c = m.where(some).select("conv_id", "turn", F.posexplode("calls").alias("pos", "c"))
    args = F.try_variant_get("c", "$.arguments", "variant")
    args = F.when(F.schema_of_variant(args) == "STRING", F.try_parse_json(F.try_variant_get("c", "$.arguments", "string"))).otherwise(args)
    ident, name = (F.try_variant_get("c", f"$.{x}", "string") for x in ("id", "name"))
    calls = c.select("conv_id", "turn", "pos", ident.alias("call_id"), name.alias("name"), args.alias("args"))
    content = F.try_variant_get("v", "$.content", "variant")
    text = F.when(F.schema_of_variant(content) == "STRING", F.try_variant_get("v", "$.content", "string")).when(content.isNotNull(), canonical(content))
    results = m.where(F.col("result_id").isNotNull()).select("conv_id", F.col("turn").alias("r_turn"), "result_id", text.alias("content"))
    return plain, calls, results


def _refs(args: Column) -> Column:
    return F.regexp_extract_all(F.to_json(args), F.lit(r"\$\{([^}\"]+)\}"), F.lit(1))


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level, ready) of the first call of each identifier: depth of its needs, and the latest turn among them.

    Calls that need each other in a circle, or need one that does, have no row; a need that is no call of the conversation is passed over.
    Every round gives the calls whose needs all have a level theirs, and then lets each need of a call that itself has just one
    point to what that one needs: a chain of n calls takes about log2(n) rounds.
    """
    by = ["conv_id", "call_id"]
    own = calls.where("call_id is not null and conv_id is not null").groupBy(*by)
    own = own.agg(F.min(F.struct("turn", "pos")).alias("at"), F.min_by(F.array_distinct(_refs(F.col("args"))), F.struct("turn", "pos")).alias("refs"))
    own = common.materialise(own.select(*by, "at.turn", "refs"), "chat-calls")
    known = own.select("conv_id", F.col("call_id").alias("need"))
    needs = own.select(*by, "turn", F.explode("refs").alias("need")).join(known, ["conv_id", "need"])
    # steps: how many levels the need is below; through: the latest turn of the calls in between
    needs = needs.select(*by, "turn", "need", F.lit(1).alias("steps"), F.lit(None).cast(needs.schema["turn"].dataType).alias("through"))
    needs = common.materialise(needs, "chat-needs")
    done = own.join(needs, by, "left_anti").select(*by, F.lit(0).alias("level"), F.col("turn").alias("ready"))
    if needs.isEmpty():
        return done
    done = common.materialise(done, "chat-levels")
    while True:
        met = needs.join(done.withColumnRenamed("call_id", "need"), ["conv_id", "need"], "left").groupBy(*by)
        new = met.agg(
            F.count("*").alias("n"), F.count("level").alias("k"), F.max(F.col("level") + F.col("steps")).alias("level"),
            F.max(F.greatest("turn", "through", "ready")).alias("ready"),
        )
        new = common.materialise(new.where("k = n").select(*by, "level", "ready"), "chat-levels")
        if new.isEmpty():
            return done
        done = done.unionByName(new)
        rest = needs.join(new, by, "left_anti")
        one = rest.groupBy(*by).agg(
            F.count("*").alias("n"), F.any_value("need").alias("next"), F.any_value("steps").alias("more"), F.max(F.greatest("turn", "through")).alias("also")
        )
        one = one.where("n = 1").select("conv_id", F.col("call_id").alias("need"), "next", "more", "also")
        needs = rest.join(one, ["conv_id", "need"], "left").select(
            *by, "turn", F.coalesce("next", "need").alias("need"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.greatest("through", "also").alias("through")
        )
        needs = common.materialise(needs, "chat-needs")


def _place(after: int, level: Column, turn: Column, pos: Column, kind: int) -> Column:
    """Where a row stands inside its turn: plain messages, then calls by level, turn and place, each with its result."""
    return F.struct(F.lit(after).alias("a"), F.coalesce(level, F.lit(1 << 30)).alias("l"), turn.alias("t"), pos.alias("p"), F.lit(kind).alias("k"))


def _listed(problems: list[Column]) -> Column:
    return F.array_sort(F.array_compact(F.array(*problems)))


def _schema_problems(held: Column) -> list[Column]:
    """Of calls joined with `tool` and `wanted`, the parameters (p, t, r) of the tool of their name."""

    def of(key: Column) -> Column:
        return F.filter("wanted", lambda w: w["p"] == key)

    def misfits(entry: Column) -> Column:
        return F.exists(of(entry["key"]), lambda w: ~_type_fits(F.schema_of_variant(entry["value"]), w["t"]))

    entries = F.map_entries(held)
    return [
        F.when(F.col("tool").isNull(), "unknown_tool"),
        F.when(F.exists("wanted", lambda w: w["r"] & ~F.array_contains(F.map_keys(held), w["p"])), "missing_argument"),
        F.when(F.exists(entries, lambda e: F.size(of(e["key"])) == 0) & F.col("tool").isNotNull(), "unknown_argument"),
        F.when(F.exists(entries, misfits), "wrong_type"),
    ]


def _with_schemas(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    part = F.struct(F.col("parameter").alias("p"), F.col("type").alias("t"), F.coalesce("required", F.lit(False)).alias("r"))
    tools = schemas.groupBy(F.col("name").alias("tool")).agg(F.collect_list(F.when(F.col("parameter").isNotNull(), part)).alias("wanted"))
    return calls.join(tools, F.col("name") == F.col("tool"), "left")


def _call_rows(calls: DataFrame, firsts: DataFrame, linked: DataFrame, problems: list[Column]) -> DataFrame:
    """Calls with their problems; calls: nth, level and ready besides their own columns."""
    by = ["conv_id", "call_id"]
    # needs that no call of the conversation meets
    refs = calls.select(*by, F.explode(_refs(F.col("args"))).alias("need"))
    known = firsts.select("conv_id", F.col("call_id").alias("need"))
    lost = refs.join(known, ["conv_id", "need"], "left_anti").select(*by).distinct().withColumn("lost", F.lit(True))
    rows = calls.join(linked, by, "left").join(lost, by, "left")
    problems = [*problems, F.when((F.col("nth") == 1) & F.col("answered").isNull(), "no_result"), F.when(F.col("lost"), "unknown_need")]
    rest = F.substring(_json(id=F.col("call_id"), name=F.col("name"), role=F.lit("assistant")), 2, 1 << 30)
    text = F.concat(F.lit('{"arguments":'), F.coalesce(canonical(F.col("args")), F.lit("null")), F.lit(","), rest)
    turn = F.when(F.col("nth") == 1, F.coalesce("ready", "turn")).otherwise(F.col("turn"))
    return rows.select(
        "conv_id", turn.alias("turn"), _place(1, F.col("level"), F.col("turn"), F.col("pos"), 0).alias("o"),
        F.lit("call").alias("kind"), "call_id", text.alias("json"), _listed(problems).alias("problems"),
    )


def _result_rows(results: DataFrame, firsts: DataFrame) -> DataFrame:
    """Results, the first of each identifier beside its call."""
    joined = results.join(firsts.withColumnRenamed("call_id", "result_id"), ["conv_id", "result_id"], "left")
    own = (F.col("r_nth") == 1) & F.col("c_turn").isNotNull()
    far = F.lit(1 << 30)
    place = F.when(own, _place(1, F.col("level"), F.col("turn"), F.col("pos"), 1)).otherwise(_place(1, far, F.col("r_turn"), far, 1))
    problems = [F.when(F.col("r_nth") > 1, "duplicate_result"), F.when(F.col("c_turn").isNull(), "orphan_result")]
    return joined.select(
        "conv_id", F.when(own, F.col("c_turn")).otherwise(F.col("r_turn")).alias("turn"), place.alias("o"), F.lit("result").alias("kind"), F.col("result_id").alias("call_id"),
        _json(content=F.col("content"), role=F.lit("tool"), tool_call_id=F.col("result_id")).alias("json"), _listed(problems).alias("problems"),
    )


def _plain_rows(plain: DataFrame) -> DataFrame:
    zero = F.lit(0)
    return plain.select(
        "conv_id", "turn", _place(0, zero, F.col("turn"), zero, 0).alias("o"), F.lit("message").alias("kind"), F.lit(None).cast("string").alias("call_id"),
        _json(content=F.col("text"), role=F.col("role")).alias("json"), F.array().cast("array<string>").alias("problems"),
    )


def formatted(messages: DataFrame, schemas: DataFrame | None = None) -> DataFrame:
    """(conv_id, turn, step, kind, call_id, json, problems): one row per plain message, call and result, to be read by turn and step.

    messages: (conv_id, turn, role, text); schemas: (name, parameter, type, required), types as in JSON Schema; a tool without parameters has one row
    with a null parameter.  A result has the turn of its call and the step after it; a call that needs others has at least their turn.  problems, sorted:
    bad_arguments, circular, duplicate_call, duplicate_result, missing_argument, no_id, no_result, orphan_result, unknown_argument,
    unknown_need, unknown_tool, wrong_type.  A result whose call isn't in the conversation stays at its own turn.  Of calls or results that share an
    identifier the first (by turn, then place or content) is linked and the others are kept where they were.  Rows that repeat stay; a null conversation or
    identifier links with nothing, and rows without a conversation are numbered among their equals only; null texts are JSON null.  Other columns are ignored.
    """
    by = ["conv_id", "call_id"]
    plain, calls, results = parsed(messages)
    usable = F.col("call_id").isNotNull() & F.col("conv_id").isNotNull()
    first = Window.partitionBy(*by).orderBy("turn", "pos", F.to_json("args"), "name")
    level = levels(calls)
    alone = calls.where(~usable).withColumn("nth", F.lit(0))  # never in one window: nothing links them
    calls = calls.where(usable).withColumn("nth", F.row_number().over(first)).unionByName(alone).join(level, by, "left")
    held = F.try_variant_get("args", "$", "map<string,variant>")
    problems = [
        F.when(~usable, "no_id"), F.when(held.isNull(), "bad_arguments"), F.when(F.col("nth") > 1, "duplicate_call"), F.when(usable & F.col("level").isNull(), "circular"),
    ]
    if schemas is not None:
        calls, problems = _with_schemas(calls, schemas), problems + _schema_problems(held)
    lone = results.where("conv_id is null").withColumn("r_nth", F.lit(1))
    order = Window.partitionBy("conv_id", "result_id").orderBy("r_turn", "content")
    results = results.where("conv_id is not null").withColumn("r_nth", F.row_number().over(order)).unionByName(lone)
    linked = results.where("r_nth = 1 and conv_id is not null").select("conv_id", F.col("result_id").alias("call_id"), F.lit(True).alias("answered"))
    firsts = calls.where("nth = 1").select(*by, F.coalesce("ready", "turn").alias("c_turn"), "level", "turn", "pos")
    every = _plain_rows(plain).unionByName(_call_rows(calls, firsts, linked, problems)).unionByName(_result_rows(results, firsts))
    apart = F.when(F.col("conv_id").isNull(), F.xxhash64("o", "json"))
    step = F.row_number().over(Window.partitionBy("conv_id", "turn", apart).orderBy("o", "json")) - 1
    return every.select("conv_id", "turn", step.cast("long").alias("step"), "kind", "call_id", "json", "problems")


def conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, json) of formatted rows: each conversation as one canonical JSON object, for conversations that fit a row."""
    parts = F.sort_array(F.collect_list(F.struct("turn", "step", "json")))
    body = F.array_join(F.transform(parts, lambda p: p["json"]), ",")
    return rows.groupBy("conv_id").agg(F.concat(F.lit('{"conv_id":'), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), F.lit(',"messages":['), body, F.lit("]}")).alias("json"))
