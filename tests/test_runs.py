"""Rules about single calls, and exports."""

import json

import pytest
from pyspark.sql import functions as F

from spanloom.functions import runs as R
from spanloom.operators import jobs
from spanloom.plans.fixtures import table
from spanloom.sources import sinks


def one(spark, column, schema=None, row=None):
    df = spark.createDataFrame([row], schema) if schema else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_feedback(spark):
    schema = "s map<string, struct<avg: double, n: int>>"
    score, n = R.feedback(F.col("s"))
    row = ({"a": (0.5, 3), "b": (1.0, None), "c": (None, 7)},)
    assert one(spark, score, schema, row) == 0.75 and one(spark, n, schema, row) == 3
    assert one(spark, score, schema, (None,)) is None and one(spark, n, schema, (None,)) == 0


def test_times(spark):
    t = lambda s: F.lit(s).cast("timestamp")
    assert one(spark, R.runtime_ms(t("2024-01-01 00:00:00"), t("2024-01-01 00:00:01.9999"))) == 1999
    assert one(spark, R.runtime_ms(t(None), t("2024-01-01 00:00:01"))) == 0
    assert one(spark, R.ttft_ms(t("2024-01-01 00:00:02"), t("2024-01-01 00:00:01"))) == 0
    assert one(spark, R.ttft_ms(t("2024-01-01 00:00:02"), t(None))) is None


@pytest.mark.parametrize(("recorded", "tokens", "output", "most", "want"), [(100, 9, "", 8192, 100), (0, 300, "", 8192, 900), (0, 0, "x" * 4000, 8192, 3000), (0, 10, "", 8192, 512), (0, 9000, "", 8192, 8192)])
def test_replay_budget(spark, recorded, tokens, output, most, want):
    assert one(spark, R.replay_budget(F.lit(recorded), F.lit(tokens), F.lit(output), F.lit(most))) == want


@pytest.mark.parametrize(
    ("error", "status", "want"),
    [("Prompt is too long", 400, "too large"), ("budget_exceeded", 400, "account"), ("no", 401, "account"), ("not allowed to access model", 403, "request"), ("boom", 500, "request"), (None, None, None)],
)
def test_judge_error(spark, error, status, want):
    assert one(spark, R.judge_error(F.lit(error).cast("string"), F.lit(status).cast("int"))) == want


def test_request_text(spark):
    schema = "m array<struct<role: string, content: string>>, t array<string>"
    text = R.request_text(F.col("m"), F.col("t"))
    talk = [("system", "be kind"), ("user", "hi"), ("critic", "hm")]
    assert one(spark, text, schema, (talk, ["{}"])) == "SYSTEM:\nbe kind\n\nTOOLS the model could call:\n{}\n\nUSER:\nhi\n\nCRITIC:\nhm"
    assert one(spark, text, schema, (talk[:1], ["{}"])).endswith("call:\n{}")
    assert one(spark, text, schema, (talk[1:2], [])) == "USER:\nhi"


def test_problems_come_at_once(spark):
    schema = "d boolean, l array<string>, m string, r array<string>"
    p = R.problems(F.col("d"), F.col("l"), F.col("m"), F.col("r"))
    assert len(one(spark, p, schema, (True, ["a", "a", "original"], None, ["system"]))) == 5
    assert one(spark, p, schema, (False, ["a", "b"], "m", ["user"])) == []


def test_exports(spark, tmp_path):
    cells = table(spark, "/root/testdata/sf0.001", "cells")
    # Invariants: a cell for the original and each candidate of every request; one document a job.
    assert cells.groupBy("job_id", "seq").count().where("count <> 3").count() == 0
    rows = jobs.with_original(cells)
    sinks.write_csv(rows, str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.count() * 3 == cells.count() * 2 and back.columns == rows.columns
    documents = sinks.job_json(jobs.summary(cells), jobs.routing(cells)).collect()
    assert len(documents) == cells.select("job_id").distinct().count() and [s["label"] for s in json.loads(documents[0]["document"])["summary"]] == ["original", "mini", "router"]


def test_store_and_snapshots(spark, tmp_path):
    path = str(tmp_path / "kv")
    schema = "key string, value string, created_at long, seq long"
    sinks.put(spark.createDataFrame([("a", "1", 1, 1), ("b", "x", 1, 2)], schema), path)
    sinks.put(spark.createDataFrame([("a", "2", 2, 1), ("b", None, 3, 1)], schema), path)
    assert [tuple(r) for r in sinks.state(spark, path).collect()] == [("a", "2", 2)]
    sinks.pin(spark.range(3), str(tmp_path / "snap"), "s1")
    sinks.pin(spark.range(5), str(tmp_path / "snap"), "s2")
    assert sinks.pinned(spark, str(tmp_path / "snap"), "s1").count() == 3
    assert sinks.pinned(spark, str(tmp_path / "snap"), "s1").columns == ["id"]


def test_snapshots_of_others_are_not_shown(spark, tmp_path):
    path, own = str(tmp_path / "snap"), ("langsmith", "w1", "agent")
    sinks.pin(spark.range(4), path, "s1", own)
    assert sinks.pinned(spark, path, "s1", own).count() == sinks.pinned(spark, path, "s1").count() == 4
    for other in (("bigquery", "w1", "agent"), ("langsmith", "w2", "agent"), ("langsmith", "w1", "other")):
        assert sinks.pinned(spark, path, "s1", other).count() == 0
