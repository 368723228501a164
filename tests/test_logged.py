"""Raw logs as traces: tool calls with arguments, previews, call-sites, requests, recorded files."""

import json

import pytest
from pyspark.sql import functions as F

from spanloom.functions import logged as L
from spanloom.functions import wording as W
from spanloom.sources import recorded
from spanloom.sources.logs import RAW_RUN


def read(spark, f, raw):
    raw = raw if isinstance(raw, str) or raw is None else json.dumps(raw)
    got = spark.createDataFrame([(raw,)], "raw string").select(f(F.col("raw")).alias("x")).first()["x"]
    return [tuple(x) for x in got] if isinstance(got, list) else got


def said(**message):
    return {"generations": [[{"message": message}]]}


CALLS = [
    {"name": "b", "args": {"y": 1, "x": {"d": 2, "c": 3}}},
    {"function": {"name": "a", "arguments": '{"k": "v"}'}},
    {"name": "words", "args": "not json"},
    {"name": "null", "arguments": None},
    {"name": "none"},
    {"args": {"x": 1}},
    "text",
]


def test_tool_calls(spark):
    want = [("b", '{"x":{"c":3,"d":2},"y":1}'), ("a", '{"k":"v"}'), ("words", '{"_":"not json"}'), ("null", '{"_":null}'), ("none", "{}")]
    assert read(spark, L.tool_calls, said(kwargs={"tool_calls": CALLS})) == want
    assert read(spark, L.tool_calls, said(tool_calls=[], additional_kwargs={"tool_calls": CALLS[:1]})) == want[:1]
    assert read(spark, L.tool_calls, "no json") == read(spark, L.tool_calls, None) == []


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        (said(content=" well ", tool_calls=CALLS[1:2]), 'well\n[calls a({"k":"v"})]'),
        (said(content="", tool_calls=CALLS[4:5]), "[calls none({})]"),
        ({"answer": " kept "}, "kept"),
        ({}, ""),
        (None, ""),
    ],
)
def test_behaviour(spark, raw, want):
    assert read(spark, L.behaviour, raw) == want


def test_rendered(spark):
    assert read(spark, lambda c: L.rendered(c, F.lit(None).cast("array<struct<name:string,args:string>>")), "  ") == "(empty output)"
    assert read(spark, lambda c: L.rendered(c, F.array(F.struct(F.lit(None).cast("string").alias("name"), F.lit("{}").alias("args")))), "x") == "x\n[calls ?({})]"


def test_preview(spark):
    assert read(spark, L.preview, {"a": "x" * 300}) == '{"a":"' + "x" * 234 + "…"
    assert read(spark, L.preview, {"a": 1}) == '{"a":1}' and read(spark, L.preview, "two\nlines") == "two lines"
    assert read(spark, L.preview, {}) == read(spark, L.preview, None) == ""


@pytest.mark.parametrize(
    ("by", "meta", "want"),
    [
        (None, {"agent_id": "a", "langgraph_node": "", "node": "n"}, ("a", "n")),
        (None, {}, ("p", "run")),
        ("run_name", {"node": "n"}, ("p", "run")),
        ("langgraph_node", {"node": "n"}, ("p", "run")),
        ("metadata:the team", {"the team": 7}, ("p", "7")),
        ("metadata:team", {}, ("p", "unknown")),
        (None, None, ("p", "run")),
    ],
)
def test_call_site(spark, by, meta, want):
    assert tuple(read(spark, lambda c: F.struct(*L.call_site(F.try_parse_json(c), F.lit("run"), F.lit("p"), by)), meta)) == want


def test_version_and_path(spark):
    on = lambda f: lambda c: f(F.try_parse_json(c))
    assert read(spark, on(L.version), {"revision_id": "", "ls_revision_id": 5}) == "5" and read(spark, on(L.version), None) == ""
    assert read(spark, on(L.path), {"langgraph_checkpoint_ns": ["a:1", "LangGraph:2", "b:3"]}) == "a/b"
    assert read(spark, on(L.path), {"langgraph_checkpoint_ns": "LangGraph:2", "graph": "g"}) == "g" and read(spark, on(L.path), {}) == ""


def test_as_sent(spark):
    sent = lambda c: L.as_sent(F.try_parse_json(c))
    chat = [{"role": "developer", "content": "c"}]
    assert json.loads(read(spark, sent, {"messages": chat, "model": "m", "stop": ["a"], "seed": None, "top_p": 0})) == {"messages": chat, "top_p": 0, "stop": ["a"]}
    for body in ({"messages": []}, {"messages": [{"role": "human"}]}, {"messages": ["x"]}, {}, None):
        assert read(spark, sent, body) is None


def test_neutral_tools(spark):
    tools = [("f", '{"name": "f", "description": "d", "parameters": {"type": "object"}}'), ("g", '{"input_schema": {"a": 1}}'), ("h", "{}"), ("bad", "{")]
    got = spark.createDataFrame([(tools,)], "t array<struct<name:string,schema_json:string>>").select(L.neutral_tools(F.col("t")).alias("x")).first()["x"]
    assert [tuple(t) for t in got] == [("f", "d", '{"type":"object"}'), ("g", "", '{"a":1}'), ("h", "", '{"properties":{},"type":"object"}')]


def test_raw_request_without_an_object(spark):
    rows = spark.createDataFrame([('[{"role": "user", "content": "q"}]', None), ("{", "{"), (None, "{}")], "request string, response string")
    got = rows.select(*L.request_trace(F.col("request"), F.col("response"))).collect()
    assert [[tuple(m) for m in r["input_messages"]] for r in got] == [[("user", "q")], [], []]
    assert {(r["trace_id"], r["node_id"], r["model_raw"], r["output"], r["input_tokens"], r["logged_request"]) for r in got} == {("", "no-system-prompt", "", "", 0, None)}


def test_problems(spark):
    roles = lambda *r: F.array(*[F.lit(x) for x in r]).cast("array<string>")
    rows = spark.range(1).select(
        L.trace_problems(F.lit(""), roles(), F.lit(0), F.lit("m"), F.lit(False)).alias("all"),
        L.trace_problems(F.lit("a"), roles("user"), F.lit(1), F.lit("m"), F.lit(None).cast("boolean")).alias("warned"),
    )
    got = rows.select("*", L.valid(F.col("all")).alias("a"), L.valid(F.col("warned")).alias("w")).first()
    assert [p.split("'")[0] for p in got["all"]] == ["missing agent_id", "no input_messages", "no input_tokens", "unknown model "]
    assert not got["a"] and got["w"] and len(got["warned"]) == 1


def test_keys_with(spark):
    deep = {"a": [{"Cached": [1, 2]}, "cache"], "cache": {"x": {"my_cache": "v"}}}
    got = read(spark, lambda c: L.keys_with(c, "cache"), deep)
    assert sorted(got) == [("a[0].Cached", "[1,2]"), ("cache", '{"x":{"my_cache":"v"}}'), ("cache.x.my_cache", "v")]
    assert read(spark, lambda c: L.keys_with(c, "cache"), "{") == read(spark, lambda c: L.keys_with(c, "cache"), None) == []


def test_wording(spark):
    x = F.lit(None).cast("double")
    got = spark.range(1).select(W.money(x), W.whole(x), W.milliseconds(x), W.percent(x), W.against(F.lit(1.0), F.lit(0.0)), W.change(x), W.percent(F.lit(0.125)), W.against(F.lit(1.0), F.lit(8.0)))
    assert list(got.first()) == ["—", "0", "—", "—", None, "", "13%", -87]


def test_whole_tables_of_traces_read_json_once(spark):
    run = {"outputs": {"generations": [[{"message": {"kwargs": {"content": "so", "tool_calls": [{"name": "find", "args": {"b": 1, "a": 2}}]}}}]], "llm_output": {"token_usage": {"prompt_tokens": 7}}}, "extra": {"metadata": {"agent": "x", "langgraph_checkpoint_ns": "a:1|b:2"}, "invocation_params": {"model": "m"}}}
    rows = [{f: None for f in RAW_RUN.fieldNames()} | {"id": str(i), "inputs": json.dumps(["hi"])} | {k: v if isinstance(v, str) else json.dumps(v) for k, v in parts.items()} for i, parts in enumerate([run, {"outputs": "{", "extra": "[]"}, {}])]
    raw = spark.createDataFrame(rows, RAW_RUN)
    whole = L.run_traces(raw, "p", more={"n": lambda meta: F.col("id")})
    assert [r[1:] for r in map(tuple, whole.collect())] == list(map(tuple, raw.select(*L.run_trace("p")).collect()))
    assert whole.first()["output"] == 'so\n[calls find({"a":2,"b":1})]' and whole.first()["graph_path"] == "a/b"
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(whole.select("output", "graph_path", "model_raw")).count("parseJson") <= 4
    assert plan(raw.select(L.behaviour(F.col("outputs")))).count("parseJson") <= 4  # once for the outputs, and for arguments
    asked, reply = json.dumps({"messages": [{"role": "user", "content": "hi"}], "seed": 3}), json.dumps({"id": "r1", "choices": [{"message": {"content": "yes"}}]})
    logged = spark.createDataFrame([(asked, reply), ("{", None)], "request string, response string")
    assert L.request_traces(logged, "request", "response").collect() == logged.select(*L.request_trace(F.col("request"), F.col("response"))).collect()


def test_halves_of_shares_go_up_by_their_digits(spark):
    shares = [0.145, 0.285, -0.145, -0.005, 0.1449999, 1e13, 0.0]
    got = spark.createDataFrame([(x,) for x in shares], "x double").select(W.percent(F.col("x")).alias("p")).collect()
    assert [r["p"] for r in got] == ["15%", "29%", "-14%", "0%", "14%", "1000000000000000%", "0%"]


def test_recorded(spark, tmp_path):
    for name, agent, nodes in (("one", "shared", ["x", "", None]), ("shared", "two", ["y"]), ("zero", "two", [])):
        (tmp_path / f"{name}.json").write_text(json.dumps({"agent": agent, "traces": [{"trace_id": f"{name}{i}", "node_id": n} for i, n in enumerate(nodes)]}))
    nodes = lambda project: [r["node"] for r in recorded.read_recorded(spark, str(tmp_path), project).orderBy("place").collect()]
    assert nodes("one") == ["x", "llm", "llm"] and nodes("shared") == ["y"] and nodes("two") == ["y"] and nodes("nobody") == []
    assert sorted(tuple(r) for r in recorded.recorded_agents(spark, str(tmp_path)).collect()) == [("shared", 3), ("two", 0), ("two", 1)]
