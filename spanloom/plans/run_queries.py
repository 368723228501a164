"""Queries over raw logs: runs and requests as traces, keys of responses, recorded traces, figures in words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import logged as L
from spanloom.functions import wording as W
from spanloom.operators import graph as G
from spanloom.operators import profile as P
from spanloom.operators import results as R
from spanloom.plans.fixtures import oracle, table
from spanloom.plans.registry import query
from spanloom.sources import recorded
from spanloom.sources.logs import RAW_RUN

_E = "SELECT event_id AS e, user_id, event_type, value, CAST(regexp_extract(props, '[0-9]+', 0) AS bigint) AS k FROM {events}"
_EVENTS = "e AS (" + _E.format(events="events") + ")"


def _events(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(_E, events=spark.read.parquet(f"{d}/events.parquet"))


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """Raw runs as a platform logs them, with every other field missing now and then."""
    fields = {
        "id": "CAST(e AS string)",
        "trace_id": "if(e % 5 = 0, '', CAST(user_id AS string))",
        "run_type": "'llm'",
        "name": "if(e % 8 = 0, '', event_type)",
        "inputs": "to_json(named_struct('messages', array(named_struct('role', if(k % 17 = 0, 'ai', 'human'), 'content', event_type))))",
        "outputs": """to_json(named_struct('generations', array(array(named_struct('message', named_struct('kwargs', named_struct('content', if(k % 4 = 0, '', concat('said ', k)),
            'tool_calls', if(k % 3 = 0, array(named_struct('name', 'find', 'args', named_struct('z', 1, 'k', k))), NULL)))))), 'llm_output', named_struct('token_usage', named_struct('prompt_tokens', k, 'completion_tokens', 2 * k,
            'cache_read_input_tokens', if(k % 2 = 0, k % 11, NULL), 'input_token_details', named_struct('cache_read', k % 13, 'cache_creation', if(k % 2 = 1, k % 5, NULL)), 'completion_tokens_details', named_struct('reasoning_tokens', if(k % 9 = 0, 7, NULL))))))""",
        "extra": """to_json(named_struct('metadata', named_struct('agent', if(e % 2 = 0, 'helper', NULL), 'langgraph_node', if(k % 3 = 0, concat('n', k % 7), NULL), 'node', if(k % 3 = 1, 'plain', NULL), 'tenant', if(k % 4 = 0, 't1', NULL),
            'revision', if(e % 3 = 0, concat('r', k % 4), NULL), 'LANGSMITH_HOST_REVISION_ID', if(e % 3 = 1, 'host', NULL), 'langgraph_checkpoint_ns', if(k % 5 = 0, 'billing:1|LangGraph:2|refund:3', NULL), 'subgraph', if(k % 5 = 1, 'side', NULL),
            'ls_max_tokens', if(e % 7 = 0, 300, NULL), 'ls_model_name', 'other'), 'invocation_params', named_struct('model', if(e % 4 = 0, 'm-a', NULL), 'model_name', if(e % 4 = 1, 'm-b', NULL), 'max_tokens', if(k % 6 = 0, 100, NULL),
            'max_completion_tokens', if(k % 6 = 1, 200, NULL), 'reasoning_effort', if(k % 10 = 0, 'low', NULL), 'extra_body', if(k % 10 = 1, named_struct('thinking', named_struct('type', 'on')), NULL))))""",
        "prompt_tokens": "if(e % 3 = 0, CAST(k + 1000 AS string), NULL)",
        "prompt_tokens_details": """'{"cached_tokens": 3}'""",
    }
    return _events(spark, d).selectExpr(*[f"{fields.get(f.name, 'CAST(NULL AS string)')} AS {f.name}" for f in RAW_RUN.fields])


_MODEL = "CASE e % 4 WHEN 0 THEN 'm-a' WHEN 1 THEN 'm-b' ELSE 'other' END"
_IN = "CASE WHEN e % 3 = 0 THEN k + 1000 ELSE k END"


@query(
    f"""WITH {_EVENTS} SELECT CASE WHEN e % 5 = 0 THEN CAST(e AS VARCHAR) ELSE CAST(user_id AS VARCHAR) END AS trace_id, e, CASE WHEN e % 2 = 0 THEN 'helper' ELSE 'proj' END AS agent_id,
CASE WHEN k % 3 = 0 THEN concat('n', k % 7) WHEN k % 3 = 1 THEN 'plain' WHEN e % 8 = 0 THEN 'node' ELSE event_type END AS node_id, CASE WHEN k % 4 = 0 THEN 't1' ELSE 'unknown' END AS tenant,
CASE WHEN k % 5 = 0 THEN 'billing/refund' WHEN k % 5 = 1 THEN 'side' ELSE '' END AS graph_path, {_MODEL} AS model_raw,
array_to_string([x FOR x IN [CASE WHEN k % 4 <> 0 THEN concat('said ', k) END, CASE WHEN k % 3 = 0 THEN '[calls find({{"k":' || k || ',"z":1}})]' END] IF x IS NOT NULL], chr(10)) AS output,
k % 9 = 0 OR k % 10 IN (0, 1) AS thinking_enabled, {_IN} AS input_tokens, 2 * k AS output_tokens, CASE WHEN k % 2 = 0 AND k % 11 <> 0 THEN k % 11 WHEN k % 13 <> 0 THEN k % 13 ELSE 3 END AS cached_tokens,
CASE WHEN k % 2 = 1 THEN k % 5 ELSE 0 END AS cache_write_tokens, CASE WHEN k % 6 = 0 THEN 100 WHEN k % 6 = 1 THEN 200 WHEN e % 7 = 0 THEN 300 ELSE 0 END AS max_output_tokens,
CASE e % 3 WHEN 0 THEN concat('r', k % 4) WHEN 1 THEN 'host' ELSE '' END AS revision,
array_to_string([x FOR x IN [CASE WHEN k % 17 = 0 THEN 'no user turn' END, CASE WHEN {_IN} <= 0 THEN 'no input_tokens' END, CASE WHEN e % 4 > 1 THEN 'unknown model ''other'' (not in the model catalog)' END] IF x IS NOT NULL], '; ') AS problems,
k % 17 <> 0 AND {_IN} > 0 AS valid FROM e"""
)
def runs_traces(spark: SparkSession, d: str) -> DataFrame:
    """Raw llm runs as traces, with their problems."""
    tenant = lambda meta: L.call_site(meta, F.col("name"), F.lit("proj"), "metadata:tenant")[1]
    rows = L.run_traces(_runs(spark, d), "proj", more={"e": lambda _: F.col("id").cast("long"), "tenant": tenant})
    roles = F.transform("input_messages", lambda m: m["role"])
    rows = rows.withColumn("found", L.trace_problems(F.col("agent_id"), roles, F.col("input_tokens"), F.col("model_raw"), F.col("model_raw") != "other"))
    shown = ["trace_id", "e", "agent_id", "node_id", "tenant", "graph_path", "model_raw", "output", "thinking_enabled", "input_tokens", "output_tokens", "cached_tokens", "cache_write_tokens", "max_output_tokens", "revision"]
    return rows.select(*shown, F.array_join("found", "; ").alias("problems"), L.valid(F.col("found")).alias("valid"))


_STRIPPED = "regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')"


@query(
    f"""SELECT concat('r', conv_id, '-', turn) AS trace_id, concat('you-help-with-', conv_id % 5, '-', substr(sha1('You help with #'), 1, 6)) AS node_id, CASE WHEN turn % 2 = 0 THEN 'served' ELSE 'asked' END AS model_raw,
array_to_string([x FOR x IN [nullif({_STRIPPED}, ''), CASE WHEN turn % 3 = 0 THEN '[calls look({{"a":' || turn || ',"b":1}})]' END] IF x IS NOT NULL], chr(10)) AS output, CASE WHEN turn % 3 = 0 THEN 'look' ELSE '' END AS tools_called,
100 + turn AS input_tokens, 10 + turn AS output_tokens, CASE WHEN turn % 4 = 0 THEN 40 ELSE 0 END AS cached_tokens, CASE WHEN turn % 5 = 0 THEN 64 ELSE 0 END AS max_output_tokens,
CASE WHEN conv_id % 6 <> 0 THEN 'messages,tool_choice,seed' END AS sent FROM conversations WHERE role IN ('user', 'assistant')"""
)
def requests_traces(spark: SparkSession, d: str) -> DataFrame:
    """Logged requests and responses as traces; some have a role that no chat has, and are not sent again as they were."""
    system = F.struct(F.when(F.col("conv_id") % 6 == 0, "SystemMessage").otherwise("system").alias("role"), F.concat(F.lit("You help with "), (F.col("conv_id") % 5).cast("string")).alias("content"))
    asked = F.struct(F.col("role"), F.coalesce("text", F.lit("")).alias("content"))
    body = F.struct(F.lit("asked").alias("model"), F.array(system, asked).alias("messages"), F.lit("auto").alias("tool_choice"), F.col("turn").alias("seed"), F.lit(True).alias("stream"), F.when(F.col("turn") % 5 == 0, 64).alias("max_tokens"))
    arguments = F.concat(F.lit('{"b": 1, "a": '), F.col("turn").cast("string"), F.lit("}"))
    call = F.array(F.struct(F.lit("function").alias("type"), F.struct(F.lit("look").alias("name"), arguments.alias("arguments")).alias("function")))
    message = F.struct(F.coalesce("text", F.lit("")).alias("content"), F.when(F.col("turn") % 3 == 0, call).alias("tool_calls"))
    details = F.struct(F.when(F.col("turn") % 4 == 0, 40).alias("cached_tokens"))
    usage = F.struct((F.col("turn") + 100).alias("prompt_tokens"), (F.col("turn") + 10).alias("completion_tokens"), details.alias("prompt_tokens_details"))
    ident = F.concat(F.lit("r"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    reply = F.struct(ident.alias("id"), F.when(F.col("turn") % 2 == 0, "served").alias("model"), F.array(F.struct(message.alias("message"))).alias("choices"), usage.alias("usage"))
    rows = spark.read.parquet(f"{d}/conversations.parquet").where("role IN ('user', 'assistant')").select(F.to_json(body).alias("request"), F.to_json(reply).alias("response"))
    traces = L.request_traces(rows, "request", "response")
    shown = ["trace_id", "node_id", "model_raw", "output", "input_tokens", "output_tokens", "cached_tokens", "max_output_tokens"]
    return traces.select(*shown, F.array_join("tools_called", ",").alias("tools_called"), F.array_join(F.json_object_keys("logged_request"), ",").alias("sent"))


@query(
    f"""WITH {_EVENTS} SELECT e, 'usage.cache_read' AS path, CAST(k AS VARCHAR) AS value FROM e UNION ALL SELECT e, 'usage.details.cachedTokens', CAST(k % 5 AS VARCHAR) FROM e WHERE e % 2 = 0
UNION ALL SELECT e, 'parts[1].CACHE', '{{"on":true}}' FROM e UNION ALL SELECT e, 'parts[1].CACHE.cached', event_type FROM e WHERE false"""
)
def responses_cache_keys(spark: SparkSession, d: str) -> DataFrame:
    """Everything in a response whose key speaks of a cache, at any depth."""
    raw = """to_json(named_struct('usage', named_struct('cache_read', k, 'details', named_struct('cachedTokens', if(e % 2 = 0, k % 5, NULL), 'other', 1)), 'parts', array(NULL, named_struct('CACHE', named_struct('on', true)))))"""
    rows = _events(spark, d).selectExpr("e", f"{raw} AS raw")
    return rows.select("e", F.explode(L.keys_with(F.col("raw"), "cache")).alias("x")).select("e", "x.path", "x.value")


@query(
    f"""WITH {_EVENTS} SELECT e, CASE WHEN e % 6 = 0 THEN '—' ELSE '$' || format('{{:,.2f}}', value * 100) END AS money, format('{{:,}}', k * 1000) AS whole, format('{{:,}}', CAST(floor(value * 10 + 0.5) AS BIGINT)) || ' ms' AS took,
CAST(floor(value / 8 + 0.5) AS BIGINT) || '%' AS share, CASE WHEN k <> 50 THEN CAST(floor((value / (k - 50) - 1) * 100 + 0.5) AS BIGINT) END AS against, CASE WHEN k > 50 THEN '+' WHEN k < 50 THEN '−' ELSE '±' END || abs(k - 50) || '%' AS change,
k || ' run' || CASE WHEN k = 1 THEN '' ELSE 's' END AS counted FROM e"""
)
def wording_figures(spark: SparkSession, d: str) -> DataFrame:
    v, k = F.col("value"), F.col("k")
    money = W.money(F.when(F.col("e") % 6 != 0, v * 100), 2)
    return _events(spark, d).select(
        "e", money.alias("money"), W.whole(k * 1000).alias("whole"), W.milliseconds(v * 10).alias("took"), W.percent(v / 800).alias("share"),
        W.against(v, k - 50).alias("against"), W.change(k - 50).alias("change"), W.counted(k, "run").alias("counted"),
    )


@query(f"WITH {_EVENTS} SELECT CASE WHEN k % 4 < 2 THEN 'llm' ELSE concat('n', k % 7) END AS node, count(*) AS runs FROM e GROUP BY 1")
def recorded_flat_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Traces of a source without run trees as a flat graph."""
    traces = _events(spark, d).selectExpr("CAST(e AS string) AS trace_id", "CASE k % 4 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE concat('n', k % 7) END AS node_id")
    return G.resolve(recorded.flat_runs(traces)).groupBy("node").agg(F.count(F.lit(1)).alias("runs"))


@query(f"WITH {_EVENTS} SELECT e, 'g' || k % 3 AS graph_path, event_type AS node, e % 2 = 0 AS testable, CAST(k - 10 AS BIGINT) AS opportunity FROM (SELECT * FROM e ORDER BY k DESC, e LIMIT 5) WHERE e % 2 = 0 AND k > 10")
def proof_first_pick(spark: SparkSession, d: str) -> DataFrame:
    """What a user is shown as chosen: the limit is the feature."""
    return P.first_pick(_ranked(spark, d), [F.desc("opportunity"), F.col("e")])


@query(f"WITH {_EVENTS} SELECT e, 'g' || k % 3 AS graph_path, event_type AS node, e % 2 = 0 AS testable, CAST(k - 10 AS BIGINT) AS opportunity FROM e WHERE k % 3 = 1 AND contains(event_type, 'c')")
def proof_matching(spark: SparkSession, d: str) -> DataFrame:
    return P.matching(_ranked(spark, d), "g1", "C")


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).selectExpr("e", "concat('g', k % 3) AS graph_path", "event_type AS node", "e % 2 = 0 AS testable", "CAST(k - 10 AS bigint) AS opportunity")


@query("SELECT DISTINCT o_custkey + 1 AS id FROM orders WHERE o_custkey + 1 NOT IN (SELECT user_id FROM events)")
def jobs_unknown_ids(spark: SparkSession, d: str) -> DataFrame:
    """Selected ids that no log has."""
    chosen = spark.read.parquet(f"{d}/orders.parquet").select((F.col("o_custkey") + 1).alias("id"))
    return R.unknown(chosen, spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("id")), "id")


@query(oracle("SELECT DISTINCT concat(CASE WHEN event_id % 2 = 0 THEN 'A_' ELSE 'a%' END, event_id) AS item FROM cells WHERE event_id % 2 = 0 AND label = 'mini' AND verdict = 'outside'", "cells"))
def jobs_found(spark: SparkSession, d: str) -> DataFrame:
    """Results searched by a part of their id in which wildcards mean themselves."""
    prefix = F.when(F.col("event_id") % 2 == 0, "A_").otherwise("a%")
    return R.found(table(spark, d, "cells").withColumn("item", F.concat(prefix, F.col("event_id").cast("string"))), "item", "a_", "mini", "outside")
