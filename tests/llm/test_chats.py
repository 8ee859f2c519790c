import json
import random
import re

import duckdb
from pyspark.sql import functions as F

from ebbtide.llm import chats, common, queries

SCHEMA = "conv_id long, turn long, role string, text string"


def call(*calls):
    return json.dumps({"tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in calls]})


def result(i, content):
    return json.dumps({"content": content, "tool_call_id": i})


ROWS = [
    (1, 0, "user", 'Say "hi" / é\n'),
    (1, 1, "assistant", call(("b", "sum", {"y": 2, "x": "${a}"}), ("a", "get", {"key": "k"}))),
    (1, 2, "tool", result("b", {"z": 1, "a": [1, {"d": 1, "c": 2}]})),
    (1, 3, "tool", result("a", "5")),
    (1, 4, "assistant", "done"),
    (2, 0, "assistant", call(("c", "get", {"key": 1, "more": True}), ("d", "none", {}), ("e", "sum", {"x": 1.5}), ("c", "get", {"key": "again"}))),
    (2, 1, "tool", result("zz", "orphan")),
    (2, 2, "tool", result("c", "r1")),
    (2, 3, "tool", result("c", "r2")),
    (3, 0, "assistant", call(("p", "get", {"key": "${q}"}), ("q", "get", {"key": "${p}"}), (None, "get", {"key": "x"}), ("s", "get", {"key": "${nobody}"}))),
    (3, 1, "assistant", '{"tool_calls": [{"id": "t", "name": "get", "arguments": "{\\"key\\": \\"v\\"}"}, {"id": "u", "name": "get", "arguments": "{oops"}]}'),
    (4, 0, "user", None), (4, None, None, ""), (None, 0, "user", "x"), (4, 1, "assistant", "{ not json"), (4, 1, "assistant", "{ not json"), (4, 2, "tool", "{}"),
    (5, 0, "user", call(("a", "get", {}))),
]
TOOLS = [("get", "key", "string", True), ("sum", "x", "number", True), ("sum", "y", "integer", False)]


def run(spark, rows=ROWS, tools=True):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"v": F.lit(1), "level": F.lit("x")}).repartition(3)
    return chats.formatted(df, spark.createDataFrame(TOOLS, "name string, parameter string, type string, required boolean") if tools else None)


def test_linked_and_ordered(spark):
    got = run(spark).where("conv_id = 1").orderBy("turn", "step").collect()
    assert [(r.kind, r.call_id) for r in got] == [("message", None), ("call", "a"), ("result", "a"), ("call", "b"), ("result", "b"), ("message", None)]
    assert got[2].json == '{"content":"5","role":"tool","tool_call_id":"a"}'
    assert json.loads(got[4].json)["content"] == '{"a":[1,{"c":2,"d":1}],"z":1}'
    assert got[3].json == '{"arguments":{"x":"${a}","y":2},"id":"b","name":"sum","role":"assistant"}'
    assert got[0].json == json.dumps({"content": 'Say "hi" / é\n', "role": "user"}, ensure_ascii=False, separators=(",", ":"))
    # x of call b is a reference, so a string where a number is asked for
    assert [r.problems for r in got] == [[], [], [], ["wrong_type"], [], []]


def test_problems(spark):
    got = {(r.conv_id, r.kind, r.call_id, r.step): r.problems for r in run(spark).collect()}
    two = {(k[1], k[2]): set() for k in got if k[0] == 2}
    for k, v in got.items():
        if k[0] == 2:
            two[k[1], k[2]] |= {tuple(v)}
    assert two["call", "c"] == {("unknown_argument", "wrong_type"), ("duplicate_call",)}
    assert two["call", "d"] == {("no_result", "unknown_tool")} and two["call", "e"] == {("no_result",)}
    assert two["result", "zz"] == {("orphan_result",)} and two["result", "c"] == {(), ("duplicate_result",)}
    three = {k[2]: v for k, v in got.items() if k[0] == 3}
    assert three["p"] == three["q"] == ["circular", "no_result"] and three[None] == ["no_id"] and three["s"] == ["no_result", "unknown_need"]
    assert three["t"] == ["no_result"] and three["u"] == ["bad_arguments", "no_result"] or three["u"] == ["bad_arguments", "missing_argument", "no_result"]


def test_every_row_is_there(spark):
    got = run(spark).collect()
    assert sum(r.kind == "message" for r in got) == 9
    assert sum(r.kind == "call" for r in got) == 12 and sum(r.kind == "result" for r in got) == 5
    for r in got:
        assert json.dumps(json.loads(r.json), sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r.json
    assert any(r.conv_id is None for r in got) and len({(r.conv_id, r.turn, r.step) for r in got}) == len(got)


def test_deep_chain(spark):
    n = 12
    rows = [(1, 100 - i, "assistant", call((f"c{i}", "get", {"key": f"${{c{i - 1}}}" if i else "x"}))) for i in range(n)] + [(1, 200 + i, "tool", result(f"c{i}", str(i))) for i in range(n)]
    got = run(spark, rows).orderBy("turn", "step").collect()
    assert [(r.kind, r.call_id) for r in got] == [(k, f"c{i}") for i in range(n) for k in ("call", "result")] and all(not r.problems for r in got)


def test_levels_of_chains_forks_and_circles(spark, monkeypatch):
    rng, needs = random.Random(3), {}
    for i in range(70):
        needs[i] = [i - 1] if i and i < 40 else sorted(rng.sample(range(i), rng.choice([0, 1, 1, 2]))) if i else []
    needs |= {100: [101], 101: [102], 102: [100], 103: [100, 5], 104: [103]}
    turns = {i: rng.randrange(500) for i in needs}
    rows = [(1, turns[i], "assistant", call((f"c{i}", "get", {"key": " ".join(f"${{c{k}}}" for k in v)}))) for i, v in needs.items()]
    want = {}
    for i in range(70):
        want[i] = (max((want[k][0] + 1 for k in needs[i]), default=0), max([turns[i], *(want[k][1] for k in needs[i])]))
    rounds, write = [], common.materialise
    monkeypatch.setattr(common, "materialise", lambda df, name: rounds.append(name) or write(df, name))
    got = chats.levels(chats.parsed(spark.createDataFrame(rows, SCHEMA))[1]).collect()
    assert {int(r.call_id[1:]): (r.level, r.ready) for r in got} == want and rounds.count("chat-needs") < 20


def test_the_query_against_sql(spark, tmp_path):
    rows = [(1, t, "assistant" if t % 2 else "user", "x" * k) for t, k in enumerate((3, 9, 4, 22, 7, 13, 5, 91, 0, 77))] + [(2, 3, "assistant", None), (2, 4, "user", None), (3, 0, "system", "é\n\"")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    want = con.execute(queries.oracle_sql()["op6_chat_format"]).fetchall()
    got = queries.op6_chat_format(spark, str(tmp_path))
    shown = [tuple(r) for r in got.select("conv_id", "turn", "step", "kind", "call_id", "json", "problems").collect()]
    assert sorted(shown, key=str) == sorted(want, key=str)
    assert {p for r in shown for p in r[6].split(",")} >= {"missing_argument", "no_result", "unknown_argument", "unknown_need", "unknown_tool", "wrong_type"}


def test_empty_and_long(spark):
    assert run(spark, []).count() == 0
    assert run(spark, [(1, 0, "user", "x" * 500_000), (1, 1, "assistant", call(("a", "get", {"key": "y" * 200_000})))]).count() == 2


def test_whole_conversations(spark):
    got = {r.conv_id: json.loads(r.json) for r in chats.conversations(run(spark, tools=False)).collect()}
    assert [m["role"] for m in got[1]["messages"]] == ["user", "assistant", "tool", "assistant", "tool", "assistant"]
    assert got[None]["conv_id"] is None


def test_no_python(spark):
    assert not re.search("Python|Pandas|Arrow", run(spark)._jdf.queryExecution().optimizedPlan().toString())
