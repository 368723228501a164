"""Tables of the agent-log domain, derived from general tables by SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.catalog import ALIAS_SQL, CATALOG_SQL, MIGRATION_SQL

_NUMBERED = """SELECT event_id, user_id, event_type, value, ts, props, CAST(regexp_extract(props, '[0-9]+', 0) AS bigint) AS k,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS bigint) AS ord FROM {events}"""

#: Runs of traces: a user's events as a heap-shaped tree.
RUNS = f"""SELECT r.event_id AS run_id, r.user_id AS trace_id, r.ord AS ord, p.event_id AS parent_id,
  CASE r.event_type WHEN 'view' THEN 'chain' WHEN 'purchase' THEN 'tool' WHEN 'signup' THEN 'retriever' ELSE 'llm' END AS run_type,
  CASE WHEN r.k % 13 = 0 THEN 'langgraph' ELSE concat('n', CAST(r.k % 7 AS string)) END AS name,
  CASE WHEN r.event_id % 3 = 0 THEN NULL ELSE concat('n', CAST(r.k % 7 AS string)) END AS node_hint,
  CASE WHEN r.event_type = 'error' THEN 'failed' ELSE '' END AS error,
  CASE WHEN r.event_type = 'error' AND r.event_id % 3 <> 0 THEN '' WHEN r.k % 4 = 0 THEN r.props WHEN r.k % 4 = 1 THEN concat('label ', CAST(r.k AS string))
    ELSE concat('Answer number ', CAST(r.k AS string), ' told in a few more words.') END AS output,
  CAST(floor(r.value * 10) AS bigint) AS runtime_ms, 50 + r.k * 7 AS in_tokens, (r.event_id * 3 + r.k) % 90 AS out_tokens, r.k % 3 AS n_tools,
  (r.user_id + r.k % 2) % 46 AS model_ord, concat('rev', CAST(CAST(floor((day(r.ts) - 1) / 10) AS bigint) AS string)) AS revision,
  CAST(CAST(r.ts AS date) AS string) AS day, CASE WHEN r.k % 5 = 0 THEN 'tool' ELSE 'user' END AS last_role, r.k AS k,
  CASE r.k % 11 WHEN 0 THEN 'billing' WHEN 1 THEN '/refund/' ELSE '' END AS graph_path, (r.k % 5 = 0 OR r.k % 8 = 1) AS tool_turn,
  CASE WHEN r.k % 17 = 0 THEN '' ELSE concat('m', CAST((r.user_id + r.k % 2) % 46 AS string)) END AS model_name, r.k % 40 AS cost_micros,
  CASE WHEN r.k % 3 = 0 THEN CAST(r.k % 5 AS double) / 4 END AS feedback_score, CASE WHEN r.k % 4 <> 0 THEN r.k * 3 END AS ttft_ms,
  CASE WHEN r.k % 7 = 3 THEN 'Hello there' WHEN r.k % 2 = 0 THEN concat('Plan the next steps for the request ', CAST(r.k AS string)) ELSE concat('Review the answer below for any mistakes ', CAST(r.k AS string)) END AS prompt
FROM ({_NUMBERED}) r LEFT JOIN ({_NUMBERED}) p ON p.user_id = r.user_id AND r.ord > 1 AND p.ord = CAST(floor(r.ord / 2) AS bigint)"""

#: Calls: every assistant turn with the turns before it.
TURNS = "SELECT conv_id, turn, role, text FROM {conversations}"

_ITEMS = """SELECT event_id, user_id % 20 AS job_id, CAST(row_number() OVER (PARTITION BY user_id % 20 ORDER BY event_id) AS bigint) AS seq, event_type, value FROM {events}"""
#: One row for each request and label: the original and two candidates.
CELLS = f"""SELECT i.event_id, i.job_id, i.seq, c.label, c.pos, 5 AS runs, CAST((i.event_id + 7 * c.pos) % 6 AS bigint) AS kept, CAST((i.event_id * 3) % 5 AS bigint) AS agree,
  CAST(floor(i.value * 10) AS bigint) * (c.pos + 1) AS latency_ms, CAST(i.event_id % 97 AS bigint) * (4 - c.pos) AS cost_micros,
  CASE WHEN c.pos = 0 THEN 'original-model' WHEN c.pos = 1 THEN 'mini-model' ELSE concat('routed-', i.event_type) END AS served_model,
  CASE WHEN c.pos = 0 THEN NULL WHEN i.event_id % 11 = 0 THEN 'unverified' WHEN ((i.event_id * 3) % 5) / 4.0 < 0.6 - 0.000000001 THEN 'unverified'
    WHEN ((i.event_id + 7 * c.pos) % 6) / 5.0 + 0.000000001 >= ((i.event_id * 3) % 5) / 4.0 - 0.2 THEN 'within' ELSE 'outside' END AS verdict
FROM ({_ITEMS}) i CROSS JOIN (SELECT * FROM (VALUES ('original', 0), ('mini', 1), ('router', 2)) AS t(label, pos)) c"""

#: Votes of judges on runs of candidates; kept is null for an abstention.
VOTES = """SELECT e.event_id AS item, c.pos AS cand, r.run AS run, v.vote AS vote,
  CASE WHEN (e.event_id * 31 + r.run * 7 + v.vote * 3 + c.pos) % 7 = 0 THEN NULL WHEN (e.event_id * 31 + r.run * 7 + v.vote * 3 + c.pos) % 7 <= 2 THEN false ELSE true END AS kept,
  CASE WHEN (e.event_id + v.vote) % 4 = 0 THEN 'acceptable: other words' ELSE concat('reason ', CAST((e.event_id + r.run) % 3 AS string)) END AS reason
FROM {events} e CROSS JOIN (SELECT * FROM (VALUES (1), (2)) AS t(pos)) c CROSS JOIN (SELECT * FROM (VALUES (0), (1), (2), (3), (4)) AS t(run)) r
CROSS JOIN (SELECT * FROM (VALUES (0), (1), (2)) AS t(vote)) v"""

#: Runs of the original (cand 0, whose first run is the recorded one) and of two candidates.
ANSWERS = """SELECT e.event_id AS item, c.pos AS cand, r.run AS run, CASE WHEN c.pos = 0 THEN 'original-model' WHEN (e.event_id + r.run) % 4 = 0 THEN 'mini-b' WHEN (e.event_id + r.run) % 7 = 0 THEN '' ELSE 'mini-a' END AS model,
  CASE WHEN (e.event_id + r.run * 3 + c.pos) % 9 = 0 THEN NULL ELSE (e.event_id * 7 + r.run * 11 + c.pos) % 900 END AS latency_ms, CASE WHEN (e.event_id + r.run) % 8 = 0 THEN NULL ELSE (e.event_id * 13 + r.run) % 5000 END AS cost_micros,
  CASE WHEN (e.event_id + r.run + c.pos) % 10 = 0 THEN 'failed' ELSE '' END AS error, c.pos = 0 AND r.run = 0 AS recorded
FROM {events} e CROSS JOIN (SELECT * FROM (VALUES (0), (1), (2)) AS t(pos)) c CROSS JOIN (SELECT * FROM (VALUES (0), (1), (2), (3), (4)) AS t(run)) r"""

#: Deployments of a gateway, named after catalog models in the ways that gateways name them.
DEPLOYED = f"""SELECT p.p_partkey AS deployment, concat(CASE p.p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'bedrock/us.' WHEN 2 THEN 'vertex/' ELSE 'x' END, c.name,
  CASE p.p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN '-20250101' ELSE ':v2' END) AS wire_name, p.p_size AS max_output, CASE WHEN p.p_partkey % 7 = 0 THEN 'embedding' ELSE 'chat' END AS mode
FROM {{part}} p JOIN ({CATALOG_SQL}) c ON c.ord = p.p_partkey % 61"""

#: Model names as logs write them, one for each part: as in the catalog, dated, shouted, behind a route, misspelt, cut, by alias, unknown.
NAMES = f"""SELECT p.p_partkey AS part, CASE WHEN p.p_partkey % 97 = 0 THEN concat('unknown-', CAST(p.p_partkey AS string)) ELSE CASE p.p_partkey % 8 WHEN 0 THEN c.name WHEN 1 THEN concat(c.name, '-20240101') WHEN 2 THEN upper(c.name)
  WHEN 3 THEN concat('bedrock/us.', c.name, '-v1:0') WHEN 4 THEN concat(c.name, 'x') WHEN 5 THEN a.alias WHEN 6 THEN concat(a.alias, '-20250101') ELSE substr(c.name, 1, 6) END END AS raw
FROM {{part}} p JOIN ({CATALOG_SQL}) c ON c.ord = p.p_partkey % 61
JOIN (SELECT alias, row_number() OVER (ORDER BY alias) - 1 AS n, count(*) OVER () AS n_all FROM ({ALIAS_SQL})) a ON a.n = p.p_partkey % a.n_all"""

TABLES = {"names": NAMES, "runs": RUNS, "turns": TURNS, "cells": CELLS, "votes": VOTES, "answers": ANSWERS, "deployed": DEPLOYED}
_BASE = {"names": "part", "runs": "events", "turns": "conversations", "cells": "events", "votes": "events", "answers": "events", "deployed": "part"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    base = _BASE[name]
    return spark.sql(TABLES[name], **{base: spark.read.parquet(f"{sf_dir}/{base}.parquet")})


def oracle(body: str, *names: str, recursive: bool = False) -> str:
    """SQL over derived tables: runs, turns, cells, votes, answers, deployed; catalog, alias, migration are always there."""
    ctes = [f"catalog AS ({CATALOG_SQL})", f"alias AS ({ALIAS_SQL})", f"migration AS ({MIGRATION_SQL})"]
    ctes += [f"{n} AS (" + TABLES[n].format(**{_BASE[n]: _BASE[n]}) + ")" for n in names]
    body = body.strip()
    more = body.startswith("WITH ")
    return "WITH " + "RECURSIVE " * recursive + ", ".join(ctes) + (", " + body[5:] if more else " " + body)
