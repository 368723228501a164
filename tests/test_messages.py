"""Shapes in which platforms log messages, answers and tools."""

import json

import pytest
from pyspark.sql import functions as F

from spanloom.functions import messages as M


def read(spark, f, raw):
    raw = raw if isinstance(raw, str) or raw is None else json.dumps(raw)
    return spark.createDataFrame([(raw,)], "raw string").select(f(F.col("raw")).alias("x")).first()["x"]


BUILT = {"lc": 1, "type": "constructor", "id": ["a", "schema", "HumanMessage"], "kwargs": {"content": "hi"}}


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ({"messages": [{"role": "system", "content": "s"}, {"role": "human", "content": "u"}]}, [("system", "s"), ("user", "u")]),
        ({"messages": [[BUILT, {"type": "ai", "data": {"content": "yes"}}]]}, [("user", "hi"), ("assistant", "yes")]),
        ({"messages": [], "input": "question"}, [("user", "question")]),
        ('"just a prompt"', [("user", "just a prompt")]),
        (["one", {"type": "tool", "content": [{"text": "a"}, {"type": "thinking", "text": "no"}, "b"]}], [("user", "one"), ("tool", "a\nb")]),
        ({"other": 1}, []),
        ("not json", []),
        (None, []),
    ],
)
def test_messages(spark, raw, want):
    assert [tuple(m) for m in read(spark, M.messages, raw)] == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ({"generations": [[{"text": "t", "message": {"kwargs": {"content": "from message"}}}]]}, "from message"),
        ({"generations": [{"text": "t"}]}, "t"),
        ({"answer": "a"}, "a"),
        ({"messages": [{"role": "user", "content": "q"}, {"role": "ai", "content": "last"}]}, "last"),
        ({"choices": [{"message": {"content": "chosen"}}]}, "chosen"),
        ({"x": 1}, '{"x":1}'),
        ('"plain"', "plain"),
        ({}, ""),
        (None, ""),
    ],
)
def test_output(spark, raw, want):
    assert read(spark, M.output, raw) == want


def test_tools(spark):
    calls = {"generations": [[{"message": {"kwargs": {"tool_calls": [{"name": "b"}, {"function": {"name": "a"}}, {"name": "b"}]}}}]]}
    assert read(spark, M.tools_called, calls) == ["a", "b"]
    assert read(spark, M.tools_called, None) == []
    defined = read(spark, M.tools_defined, [{"type": "function", "function": {"name": "f", "x": 1}}, {"name": "g"}, {"no": 1}, "s"])
    assert [d["name"] for d in defined] == ["f", "g"] and json.loads(defined[0]["schema_json"]) == {"name": "f", "x": 1}


@pytest.mark.parametrize(
    ("raw", "want"),
    [("required", "any"), ("auto", None), ('"any"', "any"), ("search", "search"), ({"type": "tool", "name": "t"}, "t"), ({"type": "function", "function": {"name": "f"}}, "f"), ({"type": "auto"}, None), (None, None)],
)
def test_tool_choice(spark, raw, want):
    assert read(spark, M.tool_choice, raw) == want
