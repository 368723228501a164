"""Queries over an agent's profile and over results of validations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom import catalog as C
from spanloom.functions.text import round_even
from spanloom.operators import facts
from spanloom.operators import graph as G
from spanloom.operators import profile as P
from spanloom.operators import results as R
from spanloom.plans.fixtures import oracle, table
from spanloom.plans.graph_queries import _CALLS, _FUNCTIONS, _GENERIC, _STATS, calls, graph_function_nodes, resolved
from spanloom.plans.ladder_queries import deployed
from spanloom.plans.registry import query
from spanloom.plans.text_queries import step
from spanloom.sources.storage import cut

_NODES = f"""{_STATS}, mc AS (SELECT key, k.name AS model, count(*) AS n, min(run_id) AS first FROM calls JOIN catalog k ON k.ord = model_ord WHERE usable GROUP BY ALL),
mm AS (SELECT key, arg_min(model, (-n, first)) AS model FROM mc GROUP BY key),
raw_nodes AS (SELECT s.*, mm.model, samples AS calls, CASE WHEN samples % 2 = 0 THEN samples * 0.25::DOUBLE ELSE 0.0::DOUBLE END AS cost_platform FROM stats s JOIN mm USING (key)),
priced AS (SELECT n.*, (avg_in * p.input + avg_out * p.output) / 1e6 AS listed, CASE WHEN cost_platform > 0 THEN cost_platform / greatest(1, calls) END AS stated FROM raw_nodes n LEFT JOIN (SELECT * FROM catalog WHERE ord % 3 <> 0) p ON p.name = n.model),
nodes AS (SELECT *, CASE WHEN listed IS NOT NULL THEN 'catalog' WHEN stated IS NOT NULL THEN 'platform' ELSE 'unknown' END AS source, round_even(coalesce(listed, stated) * 10000, 6) AS per_basis, round_even(coalesce(listed, stated), 9) AS per_call,
  round_even(CASE WHEN listed IS NOT NULL THEN listed * calls WHEN stated IS NOT NULL THEN cost_platform END, 9) AS total_measured FROM priced),
structural AS (SELECT concat_ws('/', 'agent', nullif(trim(graph_path, '/'), ''), coalesce(node_hint, name, run_type)) AS key, any_value(coalesce(node_hint, name, run_type)) AS node, any_value(trim(graph_path, '/')) AS graph_path, run_type AS type, count(*) AS calls, CAST(round_even(avg(runtime_ms), 0) AS BIGINT) AS avg_ms, round_even(count(*) FILTER (WHERE error <> '') / count(*), 3) AS error_rate
  FROM runs WHERE run_type IN ('tool', 'retriever') AND lower(trim(coalesce(node_hint, name, run_type))) NOT IN ('', 'langgraph') GROUP BY key, type),
{_FUNCTIONS}"""


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """Priced call-sites; a third of the catalog counts as unpriced, and every other site has the platform's figure."""
    rows = calls(spark, d)
    names = C.catalog(spark).select(F.col("ord").cast("long").alias("model_ord"), F.col("name").alias("model"), (F.col("ord") % 3 != 0).alias("priced_"), "input", "output")
    models = G.modal(rows.where("usable").join(F.broadcast(names), "model_ord"), ["key"], "model", "run_id").select("key", "model")
    stats = G.node_figures(rows).drop("ttft_ms", "feedback_score").join(models, "key").withColumn("calls", F.col("samples"))
    stats = stats.withColumn("cost_platform", F.when(F.col("samples") % 2 == 0, F.col("samples") * 0.25).otherwise(0.0))
    return P.with_cost(stats, C.catalog(spark).where("ord % 3 <> 0"), 10_000)


def structural(spark: SparkSession, d: str) -> DataFrame:
    rows = G.structural_nodes(table(spark, d, "runs"), "agent")
    return rows.withColumn("error_rate", round_even(F.col("errors") / F.col("calls"), 3))


@query(oracle(f"WITH {_NODES} SELECT key, model, source, per_call, per_basis, total_measured FROM nodes", "runs", recursive=True))
def profile_costs(spark: SparkSession, d: str) -> DataFrame:
    """Call-sites with their cost: dear ones first, unpriced ones last."""
    return nodes(spark, d).select("key", "model", "source", "per_call", "per_basis", "total_measured").orderBy(F.desc_nulls_last("per_basis"), "key")


@query(
    oracle(
        f"""WITH {_NODES} SELECT count(*) AS call_sites, CAST(sum(calls) AS BIGINT) AS total_calls, CAST(sum(avg_in * calls) AS BIGINT) AS total_in, CAST(sum(avg_out * calls) AS BIGINT) AS total_out, round_even(sum(per_basis), 4) AS total_cost_basis,
round_even(sum(errors_excluded) / greatest(1, sum(calls) + sum(errors_excluded)), 3) AS error_rate, bool_or(source = 'unknown') AS price_incomplete,
(SELECT count(*) FROM structural WHERE type = 'tool') AS tool_count, (SELECT count(*) FROM structural WHERE type = 'retriever') AS retriever_count, (SELECT count(*) FROM functions) AS function_count FROM nodes""",
        "runs",
        recursive=True,
    )
)
def profile_header(spark: SparkSession, d: str) -> DataFrame:
    functions = graph_function_nodes(spark, d).select("key", F.lit("function").alias("type"))
    return P.header(nodes(spark, d), structural(spark, d).select("key", "type").unionByName(functions))


@query(
    oracle(
        f"""WITH {_NODES} SELECT 'busiest' AS what, arg_min(node, (-calls, key)) AS node, CAST(max(calls) AS DOUBLE) AS value FROM nodes
UNION ALL SELECT 'costliest', arg_min(node, (-per_basis, key)), max(per_basis) FROM nodes WHERE per_basis IS NOT NULL UNION ALL SELECT 'slowest', arg_min(node, (-avg_ms, key)), CAST(max(avg_ms) AS DOUBLE) FROM structural WHERE avg_ms > 0""",
        "runs",
        recursive=True,
    )
)
def profile_hotspots(spark: SparkSession, d: str) -> DataFrame:
    # Written are the columns that are read, so that no other figure is computed.
    return P.hotspots(cut(nodes(spark, d).select("key", "node", "calls", "per_basis")), structural(spark, d))


@query(
    oracle(
        f"""WITH {_NODES}, a AS (SELECT coalesce(graph_path, '') AS graph_path, key, 'llm' AS type, per_basis FROM nodes UNION ALL SELECT graph_path, key, type, NULL FROM structural UNION ALL SELECT '', key, 'function', NULL FROM functions)
SELECT graph_path, CASE WHEN graph_path <> '' THEN graph_path ELSE 'top level' END AS name, CAST(row_number() OVER (PARTITION BY graph_path ORDER BY type <> 'llm', coalesce(per_basis, 0) DESC, key, type) AS INT) AS place, key FROM a""",
        "runs",
        recursive=True,
    )
)
def profile_sections(spark: SparkSession, d: str) -> DataFrame:
    return P.sections(P.all_nodes(nodes(spark, d), structural(spark, d), graph_function_nodes(spark, d)))


@query(
    oracle(
        f"""WITH {_NODES} SELECT key, array_to_string([x FOR x IN [CASE WHEN n_tool_input / calls >= 0.5 THEN 'tool-result handler' WHEN tools / calls >= 0.5 THEN 'tool-caller' END, CASE WHEN out_type = 'json' THEN 'JSON out' WHEN out_type = 'short' OR avg_out < 12 THEN 'short-answer' ELSE 'free-form out' END,
CASE WHEN avg_in >= 4000 THEN 'long-context' END] IF x IS NOT NULL][1:2], ' · ') AS shape, '' AS summary FROM nodes
UNION ALL SELECT key || '#' || type, '', type || ' node · ' || concat_ws(', ', calls || CASE WHEN calls = 1 THEN ' call' ELSE ' calls' END, CASE WHEN error_rate <> 0 THEN CAST(round_even(error_rate * 100, 0) AS BIGINT) || '% error' END, CASE WHEN avg_ms <> 0 THEN avg_ms || 'ms avg' END) FROM structural""",
        "runs",
        recursive=True,
    )
)
def profile_shapes(spark: SparkSession, d: str) -> DataFrame:
    """What each node does, in words, by its measures."""
    n = nodes(spark, d)
    words = P.shape(F.col("out_type"), F.col("avg_out"), F.col("avg_in"), F.col("n_tool_input") / F.col("calls"), F.col("tools") / F.col("calls"))
    said = P.structural_summary(F.col("type"), F.col("calls"), F.col("error_rate"), F.col("avg_ms"))
    others = structural(spark, d).select(F.concat_ws("#", "key", "type").alias("key"), F.lit("").alias("shape"), said.alias("summary"))
    return n.select("key", words.alias("shape"), F.lit("").alias("summary")).unionByName(others)


_EDGES = f"""fe AS (SELECT trace_id, ord, run_id, CASE WHEN run_type = 'llm' THEN CASE WHEN trim(output) <> '' THEN concat_ws('/', 'agent', nullif(path, ''), node) END
  WHEN lower(trim(coalesce(node_hint, name))) NOT IN ({_GENERIC}) THEN concat_ws('/', 'agent', nullif(trim(graph_path, '/'), ''), coalesce(node_hint, name)) END AS k FROM resolved),
fl AS (SELECT *, lag(k) OVER (PARTITION BY trace_id ORDER BY ord, run_id) AS before FROM fe WHERE k IS NOT NULL),
edges AS (SELECT DISTINCT src, dst FROM (SELECT k AS src, lead(k) OVER (PARTITION BY trace_id ORDER BY ord, run_id) AS dst FROM fl WHERE before IS NULL OR before <> k) WHERE dst IS NOT NULL AND src <> dst)"""
_SYSTEM = "concat('You are ', name, CASE WHEN k % 7 = 3 AND k % 19 = 0 THEN concat(', number ', CAST(k AS string)) ELSE '' END)"
_USER = "concat(CASE WHEN k % 7 IN (1, 2) AND k % 3 <> 0 THEN '[2] quoted: ' ELSE '' END, prompt, CASE WHEN k % 7 = 4 THEN concat(chr(10), 'go on with ', CAST(k % 3 AS string)) ELSE '' END)"
_OUTPUT = "concat(output, CASE WHEN k % 7 >= 5 THEN concat(chr(10), 'Signed, with regards ', CAST(run_id AS string)) ELSE '' END)"
#: What the usable calls said, as SQL over ``calls``.
_SAID = f"""SELECT *, {_SYSTEM} AS system_text, {_USER} AS user_text, {_OUTPUT} AS said FROM calls WHERE usable"""


def said(calls_: DataFrame) -> DataFrame:
    """Usable calls with the messages that went before: system, user (in two turns for one node), a tool's result, and the tools
    that the answer calls."""
    k = F.col("k")
    rows = calls_.where("usable").withColumn("system", F.expr(_SYSTEM)).withColumn("user", F.expr(_USER)).withColumn("output", F.expr(_OUTPUT))
    first = F.split("user", "\n")
    several, tool = k % 7 == 4, F.col("tool_turn")
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    turns = F.array(
        message("system", F.col("system")),
        message("user", first[0]),
        F.when(several, message("assistant", F.lit("yes"))),
        F.when(several, message("user", F.get(first, F.lit(1)))),
        F.when(tool, message("tool", F.lit("a result"))),
    )
    rows = rows.withColumn("messages", F.array_compact(turns))
    called = F.when(F.col("n_tools") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("n_tools") - 1), lambda i: F.concat(F.lit("tool"), ((k + i) % 9).cast("string")))).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("roles", F.col("messages.role")).withColumn("contents", F.col("messages.content")).withColumn("tools_called", called)


@query(
    oracle(
        f"""WITH {_NODES}, {_EDGES}, u AS ({_SAID}),
b AS (SELECT key, count(*) AS n, count(DISTINCT system_text) AS distinct_system, count(DISTINCT user_text) AS distinct_user, count(*) FILTER (WHERE k % 7 = 4) * 2 > count(*) AS multi_turn, bool_or(tool_turn) AS has_tool_result,
  count(*) FILTER (WHERE k % 7 IN (1, 2) AND k % 3 <> 0) * 2 > count(*) AS rag_present FROM u GROUP BY key),
sh AS (SELECT key, CASE WHEN trim(said, ' ' || chr(10)) = '' THEN 'empty' WHEN left(said, 1) IN ('{{', '[') THEN 'json' WHEN len(string_split(said, ' ')) <= 4 AND NOT contains(said, chr(10)) THEN 'label' ELSE 'prose' END AS s FROM u),
sm AS (SELECT key, {", ".join(f"count(*) FILTER (WHERE s = '{x}') AS {x}" for x in ("empty", "json", "label", "prose"))} FROM sh GROUP BY key),
ms AS (SELECT key, run_id, lower(regexp_replace(trim(said, ' ' || chr(10)), '[0-9]+', '#', 'g')) AS t FROM u), ls AS (SELECT key, run_id, unnest(string_split(t, chr(10))) AS l FROM ms),
co AS (SELECT key, l FROM ls GROUP BY key, l HAVING count(DISTINCT run_id) = (SELECT n FROM b WHERE b.key = ls.key) AND count(DISTINCT run_id) > 1), cl AS (SELECT key, list(l) AS common FROM co GROUP BY key),
ds AS (SELECT key, count(DISTINCT array_to_string(list_filter(string_split(t, chr(10)), lambda x: NOT list_contains(coalesce(common, []), x)), chr(10))) AS distinct_output FROM ms LEFT JOIN cl USING (key) GROUP BY key),
tc AS (SELECT key, string_agg(DISTINCT 'tool' || ((k + i) % 9), ', ' ORDER BY 'tool' || ((k + i) % 9)) AS tools FROM u, unnest(range(0, n_tools)) AS r(i) GROUP BY key),
up_of AS (SELECT dst AS key, string_agg(DISTINCT split_part(src, '/', -1), ', ' ORDER BY split_part(src, '/', -1)) AS names FROM edges GROUP BY dst), down_of AS (SELECT src AS key, string_agg(DISTINCT split_part(dst, '/', -1), ', ' ORDER BY split_part(dst, '/', -1)) AS names FROM edges GROUP BY src),
every AS (SELECT key, 'llm' AS kind, node, graph_path, n, distinct_system, distinct_user, out_type AS output_type, distinct_output, empty, json, label, prose, list_reverse_sort([json, label, prose])[2] >= 2 AS mixed_shapes,
  tool_input_rate AS tool_rate, avg_tools, coalesce(tools_, '') AS tools, multi_turn, has_tool_result, rag_present, untagged, mixed_model, error_rate
  FROM full_stats JOIN b USING (key) JOIN sm USING (key) JOIN ds USING (key) LEFT JOIN (SELECT key, tools AS tools_ FROM tc) USING (key)
UNION ALL BY NAME SELECT key, type AS kind, node, graph_path, '' AS tools, error_rate, node AS op, calls, avg_ms FROM structural)
SELECT every.*, coalesce(a.names, '') AS upstream, coalesce(z.names, '') AS downstream, CASE WHEN kind = 'llm' THEN array_to_string([x FOR x IN [CASE WHEN distinct_system = 1 THEN 'frame: fixed' ELSE 'frame: varies (' || distinct_system || ')' END,
  'distinct out: ' || distinct_output || '/' || n, CASE WHEN tools <> '' THEN 'calls: ' || tools END, CASE WHEN multi_turn THEN 'multi-turn' END, CASE WHEN rag_present THEN 'RAG' END] IF x IS NOT NULL], '; ') ELSE '' END AS facts,
  CASE WHEN a.names IS NOT NULL OR z.names IS NOT NULL THEN coalesce(a.names, '·') || ' → this → ' || coalesce(z.names, '·') ELSE '' END AS flow FROM every LEFT JOIN up_of a USING (key) LEFT JOIN down_of z USING (key)""",
        "runs",
        recursive=True,
    )
)
def profile_fact_packs(spark: SparkSession, d: str) -> DataFrame:
    """All facts of each node and its neighbours, and both as shown."""
    r = cut(resolved(spark, d))
    rows = G.call_sites(r, "agent")
    packs = facts.packs(G.node_stats(rows), structural(spark, d), said(rows), G.flow_edges(r, "agent"))
    shown = packs.withColumn("facts", P.facts_line(packs)).withColumn("flow", P.flow_line(F.col("upstream"), F.col("downstream")))
    for c in ("tools", "upstream", "downstream"):
        shown = shown.withColumn(c, F.array_join(c, ", "))
    return shown


@query(oracle("SELECT array_to_string(list_sort(list(DISTINCT revision)), ',') AS revisions, array_to_string(list_sort(list(DISTINCT name)), ',') AS graphs FROM runs", "runs"))
def profile_revisions(spark: SparkSession, d: str) -> DataFrame:
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return table(spark, d, "runs").agg(names("revision").alias("revisions"), names("name").alias("graphs"))


@query(oracle("SELECT coalesce(node_hint, name) AS node, run_id, output, row_number() OVER (PARTITION BY coalesce(node_hint, name) ORDER BY run_id) AS place FROM runs WHERE run_type = 'llm'", "runs"))
def profile_buckets(spark: SparkSession, d: str) -> DataFrame:
    """All calls of each node, numbered in order."""
    rows = table(spark, d, "runs").where("run_type = 'llm'").withColumn("node", F.coalesce("node_hint", "name"))
    return P.buckets(rows, "node", "run_id", ["output"])


@query(
    oracle(
        """WITH j AS (SELECT item, cand, run, list({'vote': vote, 'kept': kept, 'reason': reason} ORDER BY vote) AS judges FROM votes GROUP BY ALL),
a AS (SELECT w.item, w.cand, list({'run': w.run, 'model': model, 'latency_ms': latency_ms, 'cost_micros': cost_micros, 'error': error, 'recorded': recorded, 'judges': coalesce(judges, [])} ORDER BY w.run) AS answers
  FROM answers w LEFT JOIN j ON j.item = w.item AND j.cand = w.cand AND j.run = w.run GROUP BY w.item, w.cand),
s AS (SELECT event_id AS item, job_id, seq, pos, {'kept': kept, 'of': runs, 'answers': answers} AS own, {'cand': pos, 'label': label, 'verdict': verdict, 'kept': kept, 'of': runs, 'answers': answers} AS one
  FROM cells JOIN a ON a.item = event_id AND a.cand = pos),
r AS (SELECT item, job_id, seq, any_value(own) FILTER (WHERE pos = 0) AS reference, list(one ORDER BY pos) FILTER (WHERE pos > 0) AS candidates FROM s GROUP BY ALL),
p AS (SELECT job_id, CAST((seq - 1) // 100 + 1 AS BIGINT) AS page, list({'seq': seq, 'item': item, 'reference': reference, 'candidates': candidates} ORDER BY seq) AS results FROM r GROUP BY ALL)
SELECT job_id, page, CAST(to_json({'job_id': job_id, 'page': page, 'results': results}) AS VARCHAR) AS document FROM p""",
        "cells",
        "answers",
        "votes",
    )
)
def results_documents(spark: SparkSession, d: str) -> DataFrame:
    """Pages of results as JSON: requests, candidates, answers, votes."""
    return R.documents(*[table(spark, d, t) for t in ("cells", "answers", "votes")])


_INPUTS = f"""u AS ({_SAID}), tx AS (SELECT key, run_id, system_text, user_text, system_text || chr(10) || user_text AS text FROM u), nk AS (SELECT key, count(*) AS n FROM tx GROUP BY key),
li AS (SELECT key, run_id, unnest(list_distinct(string_split(text, chr(10)))) AS line FROM tx), lc AS (SELECT key, line, count(*) AS m FROM li GROUP BY key, line), lf AS (SELECT key, list(line) AS lines FROM lc JOIN nk USING (key) WHERE m = n GROUP BY key),
wo AS (SELECT key, run_id, text, array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(coalesce(lines, []), x)), chr(10)) AS rest FROM tx LEFT JOIN lf USING (key)),
ws AS (SELECT key, run_id, list_filter(list_distinct(regexp_split_to_array(lower(rest), '\\s+')), lambda x: x <> '') AS w, list_filter(list_distinct(regexp_split_to_array(lower(text), '\\s+')), lambda x: x <> '') AS every FROM wo),
l0 AS (SELECT key, run_id, CASE WHEN len(w) > 0 THEN w ELSE every END AS w FROM ws), {", ".join(step(i, "key", "run_id") for i in range(1, 6))},
picked AS ({" UNION ALL ".join(f"SELECT key, run_id FROM k{i}" for i in range(1, 6))})"""


def sampled(calls_: DataFrame) -> DataFrame:
    """Up to five calls of each call-site whose inputs differ: the limit is the feature."""
    text = F.concat_ws("\n", "system", "user")
    return facts.diverse_sample(calls_.select("key", "run_id", text.alias("text")), "key", "run_id", "text", 5)


@query(
    oracle(
        f"""WITH {_CALLS}, {_INPUTS}
SELECT key, count(*) AS n_total, count(DISTINCT system_text) AS distinct_system_all, count(DISTINCT user_text) AS distinct_user_all, count(p.run_id) AS sampled,
  count(DISTINCT system_text) FILTER (WHERE p.run_id IS NOT NULL) AS distinct_system_in_sample FROM tx LEFT JOIN picked p USING (key, run_id) GROUP BY key""",
        "runs",
        recursive=True,
    )
)
def profile_coverage(spark: SparkSession, d: str) -> DataFrame:
    """What a sample of calls that differ shows of each call-site."""
    rows = cut(said(calls(spark, d)))
    return P.coverage(rows, sampled(rows), "key", "run_id", "system", "user")


@query(
    oracle(
        f"""WITH {_CALLS}, {_INPUTS}, s AS (SELECT u.*, min(system_text) OVER (PARTITION BY key) = max(system_text) OVER (PARTITION BY key) AS same, string_split(user_text, chr(10)) AS parts FROM u JOIN picked USING (key, run_id)),
m AS (SELECT *, [x FOR x IN [{{'role': 'system', 'content': system_text}}, {{'role': 'user', 'content': parts[1]}}, CASE WHEN k % 7 = 4 THEN {{'role': 'assistant', 'content': 'yes'}} END, CASE WHEN k % 7 = 4 THEN {{'role': 'user', 'content': parts[2]}} END,
  CASE WHEN tool_turn THEN {{'role': 'tool', 'content': 'a result'}} END] IF x IS NOT NULL] AS messages FROM s)
SELECT key, run_id, trace_id, model_name AS model, array_to_string([x.role || ' (' || length(x.content) || CASE WHEN x.role <> 'system' THEN '' WHEN same THEN ', same' ELSE ', own' END || '): ' || x.content FOR x IN messages], chr(10)) AS messages,
  left(said, 2000) AS output, CAST(length(said) AS INT) AS output_chars FROM m""",
        "runs",
        recursive=True,
    )
)
def profile_digests(spark: SparkSession, d: str) -> DataFrame:
    """Sampled calls as an analyst reads them, their messages as text."""
    rows = cut(said(calls(spark, d)))
    chosen = rows.join(sampled(rows), ["key", "run_id"], "left_semi")
    mark = lambda m: F.when(m["role"] != "system", "").when(m["identical_across_sample"], ", same").otherwise(", own")
    line = lambda m: F.concat(m["role"], F.lit(" ("), m["chars"].cast("string"), mark(m), F.lit("): "), m["text"])
    return facts.digests(chosen, "key").withColumn("messages", F.array_join(F.transform("messages", line), "\n"))



_WIRE = """m AS (SELECT wire_name, arg_max(name, (length(name), -ord)) AS model FROM (SELECT DISTINCT wire_name FROM deployed WHERE mode = 'chat') JOIN catalog ON regexp_matches(' ' || lower(trim(wire_name)) || ' ', '[^a-z0-9]' || replace(name, '.', '\\.') || '[^a-z0-9]') GROUP BY wire_name),
p AS (SELECT model, arg_min(wire_name, (CASE WHEN wire_name = model THEN 0 ELSE 1 END, length(wire_name), wire_name)) AS pick FROM m GROUP BY model)"""


def _flavours(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    rows = deployed(spark, d).where("model IS NOT NULL AND mode = 'chat'").select("model", "wire_name").distinct()
    order = F.struct(F.when(F.col("wire_name") == F.col("model"), 0).otherwise(1).alias("other"), F.length("wire_name").alias("n"), F.col("wire_name"))
    return rows.withColumn("pick", F.min(order).over(Window.partitionBy("model"))["wire_name"])


@query(oracle(f"WITH {_WIRE} SELECT c.name AS model, c.name IN (SELECT model FROM m) AS available FROM catalog c UNION ALL SELECT 'unheard-of', false", "deployed"))
def gateway_available(spark: SparkSession, d: str) -> DataFrame:
    models = C.catalog(spark).select(F.col("name").alias("model")).union(spark.sql("SELECT 'unheard-of'"))
    return P.available(models, _flavours(spark, d))


@query(oracle(f"WITH {_WIRE}, w AS (SELECT name FROM catalog UNION SELECT wire_name FROM m UNION SELECT 'unheard-of') SELECT w.name, CASE WHEN w.name IN (SELECT wire_name FROM m) THEN w.name ELSE p.pick END AS serving FROM w LEFT JOIN p ON p.model = w.name", "deployed"))
def gateway_serving_names(spark: SparkSession, d: str) -> DataFrame:
    f = cut(_flavours(spark, d))
    wanted = C.catalog(spark).select("name").union(f.select("wire_name")).union(spark.sql("SELECT 'unheard-of'")).distinct()
    return P.serving_names(wanted, f)


_PROVED = """SELECT event_id AS key, CASE event_id % 3 WHEN 0 THEN 'SAFE' WHEN 1 THEN 'NOT-SAFE' ELSE 'LOW-EVIDENCE' END AS verdict, CAST(event_id % 400 AS double) AS downgrade_usd, CAST(event_id % 900 AS double) AS cost FROM {events}"""


def _proved(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(_PROVED, events=spark.read.parquet(f"{d}/events.parquet"))


@query("WITH p AS (" + _PROVED.format(events="events") + ") SELECT *, CASE WHEN verdict = 'SAFE' THEN downgrade_usd ELSE 0.0::DOUBLE END AS kept_usd FROM p")
def proof_retained(spark: SparkSession, d: str) -> DataFrame:
    return P.retained(_proved(spark, d))


@query("WITH p AS (" + _PROVED.format(events="events") + ") SELECT round_even(sum(cost), 4) AS total_cost, round_even(sum(downgrade_usd) FILTER (WHERE verdict = 'SAFE'), 4) AS verified_savings, count(*) FILTER (WHERE verdict = 'SAFE') AS safe FROM p")
def proof_kpis(spark: SparkSession, d: str) -> DataFrame:
    return P.kpis(_proved(spark, d))


@query("WITH p AS (" + _PROVED.format(events="events") + "), k AS (SELECT CAST(floor(o_totalprice) AS BIGINT) % 2000 AS key, min(o_orderkey) AS place FROM orders GROUP BY 1) SELECT p.*, k.place FROM p JOIN k USING (key)")
def proof_selected(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose keys were asked for, in the order of asking."""
    keys = spark.read.parquet(f"{d}/orders.parquet").select((F.floor("o_totalprice") % 2000).alias("key"), F.col("o_orderkey").alias("place"))
    return P.selected(_proved(spark, d), keys, "key", "place")


@query(oracle("WITH a AS (SELECT item, CAST(sum(coalesce(cost_micros, 0)) AS BIGINT) AS c FROM answers WHERE NOT recorded GROUP BY item), v AS (SELECT item, CAST(sum((item + vote) % 7) AS BIGINT) AS c FROM votes GROUP BY item) SELECT item, a.c + coalesce(v.c, 0) AS spend_micros FROM a LEFT JOIN v USING (item)", "answers", "votes"))
def results_spend(spark: SparkSession, d: str) -> DataFrame:
    return R.spend(table(spark, d, "answers"), table(spark, d, "votes").withColumn("cost_micros", (F.col("item") + F.col("vote")) % 7))


@query(oracle("SELECT item, count(*) FILTER (WHERE NOT recorded AND cost_micros IS NULL AND error = '') AS unpriced FROM answers GROUP BY item", "answers"))
def results_unpriced(spark: SparkSession, d: str) -> DataFrame:
    return R.unpriced(table(spark, d, "answers"))


_AVG = "CAST(round_even(avg(nullif(latency_ms, 0)), 0) AS BIGINT) AS latency_ms, CAST(round_even(avg(cost_micros), 0) AS BIGINT) AS cost_micros"


@query(oracle(f"SELECT item, {_AVG} FROM answers WHERE cand = 0 AND NOT recorded AND error = '' GROUP BY item", "answers"))
def results_original_averages(spark: SparkSession, d: str) -> DataFrame:
    return R.original_averages(table(spark, d, "answers"))


@query(
    oracle(
        f"""WITH m AS (SELECT item, cand, model, count(*) AS n, min(run) AS first FROM answers WHERE cand > 0 AND model <> '' AND error = '' GROUP BY ALL), s AS (SELECT item, cand, arg_min(model, (-n, first)) AS served_model FROM m GROUP BY ALL),
o AS (SELECT item, {_AVG} FROM answers WHERE cand = 0 AND NOT recorded AND error = '' GROUP BY item)
SELECT i.item, 0 AS cand, o.latency_ms, o.cost_micros, NULL AS served_model FROM (SELECT DISTINCT item FROM answers) i LEFT JOIN o USING (item)
UNION ALL SELECT a.*, s.served_model FROM (SELECT item, cand, {_AVG} FROM answers WHERE cand > 0 GROUP BY ALL) a LEFT JOIN s USING (item, cand)""",
        "answers",
    )
)
def results_cells(spark: SparkSession, d: str) -> DataFrame:
    return R.cells(table(spark, d, "answers"))


@query("SELECT role, count(*) AS replies, count(*) FILTER (WHERE trim(CASE WHEN conv_id % 9 = 0 THEN ' ' ELSE text END) = '') AS blank, count(*) FILTER (WHERE contains(lower(CASE WHEN conv_id % 9 = 0 THEN ' ' ELSE text END), 'the') OR contains(lower(CASE WHEN conv_id % 9 = 0 THEN ' ' ELSE text END), 'please')) AS canned FROM conversations GROUP BY role")
def judges_replies(spark: SparkSession, d: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/conversations.parquet").withColumn("text", F.when(F.col("conv_id") % 9 == 0, " ").otherwise(F.col("text")))
    return R.judge_replies(t, "role", ["the", "please"])


@query(
    oracle(
        """WITH v AS (SELECT item, cand, item % 5 AS family, item % 2 = 0 AS expected, count(*) FILTER (WHERE kept) AS yes, count(*) FILTER (WHERE NOT kept) AS no, count(*) FILTER (WHERE kept IS NULL) AS unsure FROM votes WHERE run = 0 GROUP BY ALL)
SELECT family, expected, count(*) AS cases, count(*) FILTER (WHERE (yes + no) * 2 > yes + no + unsure AND (yes * 2 > yes + no) <> expected) AS wrong, count(*) FILTER (WHERE (yes + no) * 2 <= yes + no + unsure) AS unclear, count(*) FILTER (WHERE yes > 0 AND no > 0) AS split FROM v GROUP BY ALL""",
        "votes",
    )
)
def judges_confusion(spark: SparkSession, d: str) -> DataFrame:
    """Judges on cases of known outcome: each case is judged on its first run."""
    v = table(spark, d, "votes").where("run = 0").groupBy("item", "cand").agg(F.count_if("kept").alias("yes"), F.count_if(~F.col("kept")).alias("no"), F.count_if(F.col("kept").isNull()).alias("unsure"))
    return R.confusion(v.withColumn("family", F.col("item") % 5).withColumn("expected", F.col("item") % 2 == 0), ["family", "expected"])


@query("WITH c AS (SELECT sha1(concat(event_type, event_id % 700)) AS k FROM events), h AS (SELECT sha1(concat(event_type, event_id % 1000)) AS k FROM events WHERE event_type = 'click') SELECT DISTINCT k FROM c WHERE k NOT IN (SELECT k FROM h)")
def judges_uncached(spark: SparkSession, d: str) -> DataFrame:
    """Calls that a cache of earlier calls, keyed by a digest of the request, doesn't answer."""
    e = spark.read.parquet(f"{d}/events.parquet")
    key = lambda n: F.sha1(F.concat("event_type", (F.col("event_id") % n).cast("string"))).alias("k")
    return R.uncached(e.select(key(700)), e.where("event_type = 'click'").select(key(1000)), "k")
