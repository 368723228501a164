"""Queries over run trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.text import SCAFFOLDING, eligible
from spanloom.operators import graph as G
from spanloom.plans.fixtures import oracle, table
from spanloom.plans.registry import query

_GENERIC = ", ".join(f"'{x}'" for x in SCAFFOLDING)
_LABEL = f"CASE WHEN coalesce(node_hint, '') <> '' THEN node_hint WHEN run_type = 'chain' AND lower(trim(name)) NOT IN ({_GENERIC}) THEN name END"
_UP = f"""up AS (SELECT trace_id, run_id, parent_id AS at, 1 AS depth FROM runs WHERE parent_id IS NOT NULL
  UNION ALL SELECT up.trace_id, up.run_id, p.parent_id, depth + 1 FROM up JOIN runs p ON p.trace_id = up.trace_id AND p.run_id = up.at WHERE p.parent_id IS NOT NULL),
above AS (SELECT up.run_id, depth, {_LABEL} AS label FROM up JOIN runs p ON p.trace_id = up.trace_id AND p.run_id = up.at),
nearest AS (SELECT run_id, arg_min(label, depth) AS label FROM above WHERE label IS NOT NULL GROUP BY run_id),
named AS (SELECT r.*, coalesce(nullif(r.node_hint, ''), n.label, nullif(r.name, ''), 'llm') AS node, coalesce(nullif(r.node_hint, ''), n.label) IS NOT NULL AS tagged FROM runs r LEFT JOIN nearest n ON n.run_id = r.run_id),
resolved AS (SELECT n.*, CASE WHEN n.graph_path <> '' THEN trim(n.graph_path, '/') ELSE coalesce(p.path, '') END AS path FROM named n LEFT JOIN (SELECT a.run_id, string_agg(a.label, '/' ORDER BY a.depth DESC) AS path
  FROM above a JOIN named m ON m.run_id = a.run_id WHERE a.label IS NOT NULL AND lower(trim(a.label)) NOT IN ({_GENERIC}) AND a.label <> m.node GROUP BY a.run_id) p ON p.run_id = n.run_id)"""
_CALLS = f"""{_UP},
ll AS (SELECT *, trim(output) <> '' AS usable FROM resolved WHERE run_type = 'llm'),
fc AS (SELECT node, run_id, trace_id, CASE WHEN len(string_split(prompt, ' ')) >= 6 THEN string_split(prompt, ' ')[1:6] END AS six FROM ll WHERE NOT tool_turn),
fr AS (SELECT node, six, left(regexp_replace(lower(array_to_string(six[1:3], '')), '[^a-z0-9]+', '', 'g'), 14) AS frame FROM fc WHERE six IS NOT NULL GROUP BY node, six HAVING count(*) >= greatest(2, 0.2 * (SELECT count(*) FROM fc x WHERE x.node = fc.node))),
ft AS (SELECT node, trace_id, count(*) AS n, count(DISTINCT fr.six) AS k FROM fc LEFT JOIN fr USING (node, six) GROUP BY ALL),
fk AS (SELECT node FROM ft WHERE n >= 2 GROUP BY node HAVING count(*) FILTER (WHERE k >= 2) * 2 >= count(*) INTERSECT SELECT node FROM fr GROUP BY node HAVING count(*) >= 2),
fv AS (SELECT run_id, frame FROM fc JOIN fr USING (node, six) WHERE node IN (SELECT node FROM fk)),
v AS (SELECT ll.*, CASE WHEN tool_turn THEN 'after-tool' ELSE coalesce(frame, 'initial') END AS v FROM ll LEFT JOIN fv USING (run_id)),
w AS (SELECT *, min(v) OVER (PARTITION BY path, node) <> max(v) OVER (PARTITION BY path, node) AS several FROM v),
calls AS (SELECT *, CASE WHEN several THEN v ELSE '' END AS variant, concat_ws('/', 'agent', nullif(path, ''), node) AS site,
  concat_ws('/', 'agent', nullif(path, ''), node) || CASE WHEN several THEN '~' || v ELSE '' END AS key FROM w)"""
_STATS = f"""{_CALLS},
agg AS (SELECT key, min(node) AS node, min(path) AS graph_path, min(variant) AS variant, count(*) FILTER (WHERE usable) AS samples,
  count(DISTINCT trace_id) FILTER (WHERE usable) AS traces, count(*) FILTER (WHERE NOT usable) AS errors_excluded,
  CAST(round_even(avg(in_tokens) FILTER (WHERE usable), 0) AS BIGINT) AS avg_in, CAST(round_even(avg(out_tokens) FILTER (WHERE usable), 0) AS BIGINT) AS avg_out,
  CAST(round_even(avg(runtime_ms) FILTER (WHERE usable), 0) AS BIGINT) AS avg_ms, CAST(sum(n_tools) FILTER (WHERE usable) AS BIGINT) AS tools,
  count(*) FILTER (WHERE usable AND left(output, 1) IN ('{{', '[')) AS n_json, count(*) FILTER (WHERE usable AND tool_turn) AS n_tool_input,
  min({{'t': trace_id, 'o': ord, 'u': NOT tagged}}) FILTER (WHERE usable) AS seen, sum(cost_micros) FILTER (WHERE usable) / 1e6 AS cost_ls,
  round_even(avg(feedback_score) FILTER (WHERE usable), 3) AS feedback_score, CAST(round_even(avg(ttft_ms) FILTER (WHERE usable), 0) AS BIGINT) AS ttft_ms,
  list_sort(list(out_tokens) FILTER (WHERE usable)) AS outs, min(day) FILTER (WHERE usable) AS first_day, max(day) FILTER (WHERE usable) AS last_day FROM calls GROUP BY key),
mn AS (SELECT key, model_name AS v, count(*) AS n, min({{'t': trace_id, 'o': ord}}) AS first FROM calls WHERE usable GROUP BY ALL),
ml AS (SELECT key, list(v ORDER BY n DESC, first)[1] AS model, string_agg(CASE WHEN v = '' THEN '?' ELSE v END || ' x' || n, ', ' ORDER BY n DESC, first) AS models,
  CAST(to_json(list({{'name': CASE WHEN v = '' THEN '?' ELSE v END, 'calls': n}} ORDER BY n DESC, first)) AS VARCHAR) AS models_list, count(*) > 1 AS mixed_model FROM mn GROUP BY key),
stats AS (SELECT agg.* EXCLUDE (outs, seen), seen.t AS seen_trace, seen.o AS seen_ord, seen.u AS untagged, round_even(tools / samples, 1) AS avg_tools, round_even(n_tool_input / samples, 2) AS tool_input_rate, CAST(outs[least(len(outs) - 1, CAST(floor(len(outs) * 0.5) AS INT)) + 1] AS BIGINT) AS out_p50, CAST(outs[least(len(outs) - 1, CAST(floor(len(outs) * 0.95) AS INT)) + 1] AS BIGINT) AS out_p95,
  CASE WHEN n_json * 2 > samples THEN 'json' WHEN avg_out < 25 THEN 'short' ELSE 'free-form' END AS out_type,
  round_even(errors_excluded / (samples + errors_excluded), 3) AS error_rate FROM agg WHERE samples > 0),
full_stats AS (SELECT stats.*, ml.* EXCLUDE (key) FROM stats JOIN ml USING (key))"""


def resolved(spark: SparkSession, d: str) -> DataFrame:
    return G.resolve(table(spark, d, "runs"))


def calls(spark: SparkSession, d: str) -> DataFrame:
    return G.call_sites(resolved(spark, d), "agent")


@query(oracle(f"WITH {_UP} SELECT trace_id, run_id, node, tagged, path FROM resolved", "runs", recursive=True))
def graph_resolve_nodes(spark: SparkSession, d: str) -> DataFrame:
    return resolved(spark, d).select("trace_id", "run_id", "node", "tagged", "path")


@query(oracle(f"WITH {_UP} SELECT r.trace_id, r.run_id, n.label FROM runs r LEFT JOIN nearest n ON n.run_id = r.run_id", "runs", recursive=True))
def graph_nearest_label_by_jumps(spark: SparkSession, d: str) -> DataFrame:
    return G.nearest_label(table(spark, d, "runs"), small=0)


@query(oracle(f"WITH {_STATS} SELECT * FROM full_stats", "runs", recursive=True))
def graph_node_stats(spark: SparkSession, d: str) -> DataFrame:
    return G.node_stats(calls(spark, d)).withColumn("models_list", F.to_json("models_list")).orderBy(F.desc("avg_out"), "key")


@query(
    oracle(
        f"""WITH {_CALLS}, c AS (SELECT key, k.name AS model, count(*) AS n, min(run_id) AS first FROM calls JOIN catalog k ON k.ord = model_ord WHERE usable GROUP BY ALL)
SELECT key, arg_min(model, (-n, first)) AS model, CAST(count(*) AS INT) AS n_values, string_agg(model || ' x' || n, ', ' ORDER BY -n, first) AS listed FROM c GROUP BY key""",
        "runs",
        recursive=True,
    )
)
def graph_modal_models(spark: SparkSession, d: str) -> DataFrame:
    from spanloom.catalog import catalog

    rows = calls(spark, d).where("usable").join(catalog(spark).select(F.col("ord").cast("long").alias("model_ord"), F.col("name").alias("model")), "model_ord")
    return G.modal(rows, ["key"], "model", "run_id").drop("named")


@query(
    oracle(
        f"""SELECT concat_ws('/', 'agent', nullif(trim(graph_path, '/'), ''), coalesce(node_hint, name, run_type)) AS key, run_type AS type, min(coalesce(node_hint, name, run_type)) AS node, min(trim(graph_path, '/')) AS graph_path, count(*) AS calls, count(*) FILTER (WHERE error <> '') AS errors, count(DISTINCT trace_id) AS traces,
CAST(round_even(avg(runtime_ms), 0) AS BIGINT) AS avg_ms FROM runs WHERE run_type IN ('tool', 'retriever') AND lower(trim(coalesce(node_hint, name, run_type))) NOT IN ({_GENERIC}) GROUP BY ALL""",
        "runs",
    )
)
def graph_structural_nodes(spark: SparkSession, d: str) -> DataFrame:
    return G.structural_nodes(table(spark, d, "runs"), "agent")


_SPLIT = "SELECT * REPLACE (CASE WHEN node_hint IN ('n5', 'n6') AND run_type <> 'chain' THEN NULL ELSE node_hint END AS node_hint) FROM runs"
_FUNCTIONS = f"""s AS ({_SPLIT}), functions AS (SELECT 'agent/' || node_hint AS key, count(*) AS calls, count(DISTINCT trace_id) AS traces, arg_min(output, (trace_id, ord)) FILTER (WHERE output <> '') AS out_sample
  FROM s WHERE run_type = 'chain' AND coalesce(node_hint, '') <> '' AND node_hint NOT IN (SELECT node_hint FROM s WHERE run_type <> 'chain' AND node_hint IS NOT NULL) GROUP BY ALL)"""


@query(
    oracle(
        f"WITH {_FUNCTIONS} SELECT * FROM functions",
        "runs",
    )
)
def graph_function_nodes(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "runs")
    hidden = F.col("node_hint").isin("n5", "n6") & (F.col("run_type") != "chain")
    return G.function_nodes(runs.withColumn("node_hint", F.when(~F.coalesce(hidden, F.lit(False)), F.col("node_hint"))), "agent")


@query(
    oracle(
        f"""WITH {_UP}, k AS (SELECT trace_id, ord, run_id, CASE WHEN run_type = 'llm' THEN CASE WHEN trim(output) <> '' THEN concat_ws('/', 'agent', nullif(path, ''), node) END
  WHEN lower(trim(coalesce(node_hint, name))) NOT IN ({_GENERIC}) THEN concat_ws('/', 'agent', nullif(trim(graph_path, '/'), ''), coalesce(node_hint, name)) END AS k FROM resolved),
c AS (SELECT *, lag(k) OVER (PARTITION BY trace_id ORDER BY ord, run_id) AS before FROM k WHERE k IS NOT NULL),
p AS (SELECT k AS src, lead(k) OVER (PARTITION BY trace_id ORDER BY ord, run_id) AS dst FROM c WHERE before IS NULL OR before <> k)
SELECT src, dst, count(*) AS count FROM p WHERE dst IS NOT NULL GROUP BY ALL""",
        "runs",
        recursive=True,
    )
)
def graph_flow_edges(spark: SparkSession, d: str) -> DataFrame:
    return G.flow_edges(resolved(spark, d), "agent")


#: Sums of fractions depend on their order, and a mean near a half of its last digit shows it: variants are added up in this one.
_SMALLEST_FIRST = "ORDER BY samples, seen_trace, seen_ord"


@query(
    oracle(
        f"""WITH {_STATS}, m AS (SELECT graph_path, node, CAST(sum(samples) AS BIGINT) AS calls, {", ".join(f"arg_min({c}, (seen_trace, seen_ord)) AS {c}" for c in ("variant", "model", "models", "models_list", "untagged"))},
  {", ".join(f"arg_min({c}, (-samples, seen_trace, seen_ord)) AS {c}" for c in ("out_p50", "out_p95", "out_type"))}, {", ".join(f"CAST(round_even(sum({c} * samples) / sum(samples), 0) AS BIGINT) AS {c}" for c in ("avg_in", "avg_out", "avg_ms"))},
  bool_or(mixed_model) AS mixed, round_even(sum(cost_ls), 6) AS cost_ls, CAST(sum(errors_excluded) AS BIGINT) AS errors_excluded, round_even(sum(avg_tools * samples {_SMALLEST_FIRST}) / sum(samples), 1) AS avg_tools,
  round_even(sum(tool_input_rate * samples {_SMALLEST_FIRST}) / sum(samples), 2) AS tool_input_rate, CAST(round_even(sum(ttft_ms * samples) / sum(samples) FILTER (WHERE ttft_ms IS NOT NULL), 0) AS BIGINT) AS ttft_ms,
  round_even(sum(feedback_score * samples {_SMALLEST_FIRST}) / sum(samples) FILTER (WHERE feedback_score IS NOT NULL), 3) AS feedback_score, count(*) AS variants FROM full_stats GROUP BY graph_path, node),
t AS (SELECT path AS graph_path, node, min(site) AS key, count(DISTINCT trace_id) AS traces FROM calls WHERE usable GROUP BY ALL)
SELECT m.*, key, traces, round_even(errors_excluded / (calls + errors_excluded), 3) AS error_rate FROM m JOIN t USING (graph_path, node)""",
        "runs",
        recursive=True,
    )
)
def graph_merge_variants(spark: SparkSession, d: str) -> DataFrame:
    rows = calls(spark, d)
    return G.merge_variants(G.node_stats(rows), rows).withColumn("models_list", F.to_json("models_list"))


@query(oracle("SELECT coalesce(node_hint, '(no node)') AS node, run_type, count(*) AS runs FROM runs GROUP BY ALL", "runs"))
def graph_run_types_by_node(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "runs").groupBy(F.coalesce("node_hint", F.lit("(no node)")).alias("node"), "run_type").agg(F.count(F.lit(1)).alias("runs"))


@query(
    oracle(
        """SELECT run_type, count(*) AS runs, count(DISTINCT trace_id) AS traces, string_agg(DISTINCT revision, ',' ORDER BY revision) AS revisions,
count(*) FILTER (WHERE trim(output) = '' AND error <> '') AS errored FROM runs GROUP BY run_type""",
        "runs",
    )
)
def graph_run_totals(spark: SparkSession, d: str) -> DataFrame:
    why = eligible(F.col("error"), F.col("output"))
    return (
        table(spark, d, "runs")
        .groupBy("run_type")
        .agg(
            F.count(F.lit(1)).alias("runs"),
            F.count_distinct("trace_id").alias("traces"),
            F.array_join(F.array_sort(F.collect_set("revision")), ",").alias("revisions"),
            F.count_if(why == "errored, no output").alias("errored"),
        )
    )


@query(
    oracle(
        f"""WITH {_UP}, p AS (SELECT path FROM resolved WHERE run_type = 'llm' AND path <> '' UNION SELECT coalesce(node_hint, name) FROM runs WHERE run_type = 'tool')
SELECT path FROM p""",
        "runs",
        recursive=True,
    )
)
def graph_paths_union(spark: SparkSession, d: str) -> DataFrame:
    r = resolved(spark, d)
    llm = r.where("run_type = 'llm' AND path <> ''").select("path")
    return llm.union(r.where("run_type = 'tool'").select(F.coalesce("node_hint", "name"))).distinct()


@query(
    oracle(
        f"""WITH {_UP}, e AS (SELECT trace_id, ord, run_id, 'agent/' || node AS k FROM resolved),
p AS (SELECT k AS src, lead(k) OVER (PARTITION BY trace_id ORDER BY ord, run_id) AS dst FROM e), d AS (SELECT DISTINCT src, dst FROM p WHERE dst IS NOT NULL AND src <> dst)
SELECT coalesce(u.dst, w.src) AS key, coalesce(u.up, '') AS upstream, coalesce(w.down, '') AS downstream
FROM (SELECT dst, string_agg(src, ',' ORDER BY src) AS up FROM d GROUP BY dst) u FULL JOIN (SELECT src, string_agg(dst, ',' ORDER BY dst) AS down FROM d GROUP BY src) w ON u.dst = w.src""",
        "runs",
        recursive=True,
    )
)
def graph_neighbours(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    e = resolved(spark, d).select("trace_id", "ord", "run_id", F.concat(F.lit("agent/"), F.col("node")).alias("src"))
    e = e.withColumn("dst", F.lead("src").over(Window.partitionBy("trace_id").orderBy("ord", "run_id"))).where("dst IS NOT NULL AND src <> dst")
    up = e.groupBy(F.col("dst").alias("key")).agg(F.array_join(F.array_sort(F.collect_set("src")), ",").alias("upstream"))
    down = e.groupBy(F.col("src").alias("key")).agg(F.array_join(F.array_sort(F.collect_set("dst")), ",").alias("downstream"))
    return up.join(down, "key", "full").select("key", F.coalesce("upstream", F.lit("")).alias("upstream"), F.coalesce("downstream", F.lit("")).alias("downstream"))


@query(
    oracle(
        """WITH t AS (SELECT * REPLACE (CASE WHEN run_type = 'tool' AND name IN ('n2', 'n3') THEN 'task-' || name ELSE name END AS name) FROM runs),
up AS (SELECT trace_id, run_id, parent_id AS at, 1 AS depth FROM t WHERE run_type = 'llm' AND parent_id IS NOT NULL UNION ALL SELECT up.trace_id, up.run_id, p.parent_id, depth + 1 FROM up JOIN t p ON p.run_id = up.at WHERE p.parent_id IS NOT NULL),
a AS (SELECT up.run_id, depth, p.name, p.run_type = 'tool' AND starts_with(p.name, 'task') AS task FROM up JOIN t p ON p.run_id = up.at), n AS (SELECT run_id, min(depth) AS d FROM a WHERE task GROUP BY run_id)
SELECT r.trace_id, r.run_id, CASE WHEN n.d IS NULL THEN '(orchestrator)' ELSE coalesce(b.name, '(task, unnamed)') END AS agent FROM t r LEFT JOIN n USING (run_id) LEFT JOIN a b ON b.run_id = r.run_id AND b.depth = n.d - 1 WHERE r.run_type = 'llm'""",
        "runs",
        recursive=True,
    )
)
def graph_sub_agents(spark: SparkSession, d: str) -> DataFrame:
    named = F.when((F.col("run_type") == "tool") & F.col("name").isin("n2", "n3"), F.concat(F.lit("task-"), "name")).otherwise(F.col("name"))
    return G.sub_agents(table(spark, d, "runs").withColumn("name", named))


@query(
    oracle(
        """WITH m AS (SELECT *, CASE WHEN run_type = 'chain' AND k % 3 = 0 THEN name || 'Middleware.before' ELSE name END AS n FROM runs)
SELECT count(DISTINCT trace_id) AS traces, count(*) AS runs, count(*) FILTER (WHERE run_type = 'llm') AS llm, count(*) FILTER (WHERE run_type = 'chain') AS chains, count(*) FILTER (WHERE run_type = 'chain' AND contains(n, 'Middleware')) AS middleware,
CAST(round_even(100.0::DOUBLE * count(*) FILTER (WHERE run_type = 'chain' AND contains(n, 'Middleware')) / greatest(1, count(*)), 0) AS BIGINT) AS noise_percent FROM m""",
        "runs",
    )
)
def graph_noise(spark: SparkSession, d: str) -> DataFrame:
    """How much of a log is middleware."""
    middle = F.when((F.col("run_type") == "chain") & (F.col("k") % 3 == 0), F.concat("name", F.lit("Middleware.before"))).otherwise(F.col("name"))
    return G.noise(table(spark, d, "runs").withColumn("name", middle))
