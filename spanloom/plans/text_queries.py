"""Queries over texts: roles, prompts, answers, usage, and facts about call-sites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions import text as X
from spanloom.operators import facts
from spanloom.plans.fixtures import oracle, table
from spanloom.plans.registry import query

_ROLE = "CASE WHEN lower(role) IN ('human', 'humanmessage', 'user') THEN 'user' WHEN lower(role) IN ('ai', 'aimessage', 'assistant') THEN 'assistant' WHEN lower(role) IN ('system', 'systemmessage') THEN 'system' WHEN lower(role) IN ('tool', 'toolmessage', 'function', 'functionmessage') THEN 'tool' ELSE 'user' END"
_RAW_ROLE = "CASE turn % 5 WHEN 0 THEN upper(role) WHEN 1 THEN concat(role, 'Message') WHEN 2 THEN 'Human' WHEN 3 THEN 'FunctionMessage' ELSE role END"
_STRIP = "regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')"


def turns(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/conversations.parquet")


@query(f"WITH t AS (SELECT conv_id, turn, {_RAW_ROLE} AS role FROM conversations), n AS (SELECT conv_id, turn, {_ROLE} AS role FROM t) SELECT shape, count(*) AS conversations FROM (SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS shape FROM n GROUP BY conv_id) GROUP BY shape")
def text_role_shapes(spark: SparkSession, d: str) -> DataFrame:
    rows = turns(spark, d).selectExpr("conv_id", "turn", f"{_RAW_ROLE} AS role").withColumn("role", X.norm_role(F.col("role")))
    shape = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ">")
    return rows.groupBy("conv_id").agg(shape.alias("shape")).groupBy("shape").agg(F.count(F.lit(1)).alias("conversations"))


_CALLS = """c AS (SELECT conv_id, turn, role, text, string_agg(CASE WHEN role = 'user' THEN text END, ' ') OVER w AS user_text, count(CASE WHEN role = 'user' THEN 1 END) OVER w AS users, count(*) OVER w AS n_messages
 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def calls(spark: SparkSession, d: str) -> DataFrame:
    return _calls(turns(spark, d))


def _calls(rows: DataFrame) -> DataFrame:
    """A call for every assistant turn, with the messages before it."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("messages", F.collect_list(F.struct("role", F.col("text").alias("content"))).over(w))
    return rows.where("role = 'assistant'").select(F.col("conv_id").alias("trace_id"), "turn", "messages", F.col("text").alias("output"))


@query(
    f"""WITH {_CALLS} SELECT conv_id AS trace_id, turn, n_messages, concat('agent/node', conv_id % 3) AS key, coalesce(user_text, '') AS user_text, greatest(1, CAST(floor(length(text) / 4) AS BIGINT)) AS out_tokens,
 array_to_string([x FOR x IN [CASE WHEN n_messages = 0 THEN 'no input_messages' WHEN users = 0 THEN 'no user turn' END, CASE WHEN n_messages < 2 THEN 'no input_tokens' END] IF x IS NOT NULL], '; ') AS problems,
 CASE WHEN trim(text) = '' THEN 'empty output' ELSE 'ok' END AS usable FROM c WHERE role = 'assistant'"""
)
def text_calls(spark: SparkSession, d: str) -> DataFrame:
    """Traces with the list of their problems, the call-site key and whether the answer is usable."""
    rows = calls(spark, d)
    n = F.size("messages")
    has_user = F.exists("messages", lambda m: m["role"] == "user")
    problems = F.array_compact(F.array(F.when(n == 0, "no input_messages").when(~has_user, "no user turn"), F.when(n < 2, "no input_tokens")))
    user = F.array_join(F.transform(F.filter("messages", lambda m: m["role"] == "user"), lambda m: m["content"]), " ")
    key = F.concat(F.lit("agent/node"), (F.col("trace_id") % 3).cast("string"))
    return rows.select("trace_id", "turn", n.cast("long").alias("n_messages"), key.alias("key"), user.alias("user_text"), X.approx_tokens(F.col("output")).alias("out_tokens"), F.array_join(problems, "; ").alias("problems"), X.eligible(F.lit(""), F.col("output")).alias("usable"))


@query(
    """WITH t AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'assistant' ELSE 'user' END AS role, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM conversations WHERE role <> 'system'),
g AS (SELECT *, sum(CASE WHEN before = role THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM t WHERE text <> ''))
SELECT conv_id, CAST(island AS BIGINT) AS island, min(role) AS role, string_agg(text, chr(10) ORDER BY turn) AS content FROM g GROUP BY conv_id, island"""
)
def text_merged_turns(spark: SparkSession, d: str) -> DataFrame:
    """Neighbouring turns of one role as one message, without the system's."""
    return _merged(turns(spark, d))


_REPLAYED = "SELECT conv_id, turn, CASE WHEN conv_id % 5 = 0 AND turn = 0 THEN 'assistant' WHEN conv_id % 10 = 3 THEN 'system' ELSE role END AS role, CASE WHEN conv_id % 10 = 7 THEN ' ' ELSE text END AS text FROM {conversations}"


@query(
    f"""WITH c AS ({_REPLAYED.format(conversations="conversations")}), t AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'assistant' ELSE 'user' END AS role, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM c WHERE role <> 'system'),
g AS (SELECT *, sum(CASE WHEN before = role THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM t WHERE text <> '')),
m AS (SELECT conv_id, CAST(island AS BIGINT) AS island, min(role) AS role, string_agg(text, chr(10) ORDER BY turn) AS content FROM g GROUP BY conv_id, island)
SELECT * FROM m UNION ALL SELECT conv_id, 0, 'user', '(continue)' FROM m WHERE island = 1 AND role <> 'user' UNION ALL SELECT DISTINCT conv_id, 1, 'user', '(no user turn)' FROM c WHERE conv_id NOT IN (SELECT conv_id FROM m)"""
)
def text_replay_turns(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as a re-run sends them: merged turns that begin with a user's, put in where there is none."""
    rows = spark.sql(_REPLAYED, conversations=turns(spark, d))
    return starting_with_user(_merged(rows), rows.select("conv_id").distinct())


# What stands for a user's turn that a conversation lacks.
CONTINUE, NO_USER_TURN = "(continue)", "(no user turn)"


def starting_with_user(merged: DataFrame, conversations: DataFrame) -> DataFrame:
    """Merged turns (conv_id, island from 1, role, content), and a user's turn before those of a conversation that begins otherwise
    (island 0) or has none."""
    said = lambda island, text: [F.lit(island).cast("long").alias("island"), F.lit("user").alias("role"), F.lit(text).alias("content")]
    late = merged.where("island = 1 AND role <> 'user'").select("conv_id", *said(0, CONTINUE))
    silent = conversations.join(merged.where("island = 1"), "conv_id", "left_anti").select("conv_id", *said(1, NO_USER_TURN))
    return merged.unionByName(late).unionByName(silent)


def _merged(rows: DataFrame) -> DataFrame:
    rows = rows.where("role <> 'system'").withColumn("role", F.when(F.col("role") == "assistant", "assistant").otherwise("user")).withColumn("text", X.strip(F.col("text"))).where("text <> ''")
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = rows.withColumn("new", F.when(F.lag("role").over(w).eqNullSafe(F.col("role")), 0).otherwise(1)).withColumn("island", F.sum("new").over(w))
    content = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n")
    return rows.groupBy("conv_id", "island").agg(F.min("role").alias("role"), content.alias("content"))


@query(
    """WITH s AS (SELECT conv_id, CASE WHEN conv_id % 4 = 0 THEN '' ELSE text || ' 12345' END AS s FROM conversations WHERE turn = 0)
SELECT conv_id, CASE WHEN trim(s) = '' THEN 'no-system-prompt' ELSE array_to_string(regexp_extract_all(lower(s), '[a-z0-9]+')[1:4], '-') || '-' || left(sha1(regexp_replace(s, '[0-9]+', '#', 'g')), 6) END AS name FROM s"""
)
def text_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    s = F.when(F.col("conv_id") % 4 == 0, "").otherwise(F.concat("text", F.lit(" 12345")))
    return turns(spark, d).where("turn = 0").select("conv_id", X.fingerprint(s).alias("name"))


@query(
    f"""WITH d AS (SELECT doc_id, text, {_STRIP} AS s FROM documents)
SELECT doc_id, CASE WHEN s = '' THEN 'empty' WHEN left(s, 1) IN ('{{', '[') THEN 'json' WHEN len(regexp_split_to_array(s, '\\s+')) <= 4 AND NOT contains(s, chr(10)) THEN 'label' ELSE 'prose' END AS shape,
 sha256(CASE WHEN length(text) > 1400 THEN left(text, 900) || chr(10) || '[...]' || chr(10) || right(text, 400) ELSE text END) AS digest, greatest(1, CAST(floor(length(text) / 4) AS BIGINT)) AS tokens FROM d"""
)
def text_shapes(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", X.out_shape(t).alias("shape"), F.sha2(X.digest(t), 256).alias("digest"), X.approx_tokens(t).alias("tokens"))


@query(
    """WITH u AS (SELECT event_id AS id, event_id % 900 AS prompt, CASE WHEN event_id % 3 = 0 THEN event_id % 500 ELSE 0 END AS given, event_id % 200 AS read, CASE WHEN event_id % 5 = 0 THEN event_id % 300 END AS nested, event_id % 70 AS write, event_id % 400 AS output FROM events),
n AS (SELECT *, greatest(read, coalesce(nested, 0)) AS cached FROM u), i AS (SELECT *, coalesce(nullif(given, 0), greatest(0, prompt - cached - write)) AS input FROM n)
SELECT id, input, cached, round_even((input * 3.0::DOUBLE + output * 15.0::DOUBLE + cached * 0.3::DOUBLE + write * 3.75::DOUBLE) / 1e6, 9) AS usd FROM i"""
)
def text_usage_cost(spark: SparkSession, d: str) -> DataFrame:
    """Token usage in either provider's shape, and its cost; a price of 0 for cache writes counts as 1.25 times the input's."""
    e = F.col("event_id")
    zero = F.lit(0).cast("long")
    given = F.when(e % 3 == 0, e % 500).otherwise(zero)
    tokens, cached = X.usage_of(e % 900, given, e % 200, F.when(e % 5 == 0, e % 300), e % 70)
    price = {"input": F.lit(3.0), "output": F.lit(15.0), "cache_read": F.lit(0.3), "cache_write": F.lit(0.0)}
    usd = X.cost_usd({"input": tokens, "output": e % 400, "cache_read": cached, "cache_write": e % 70}, price, 9)
    return spark.read.parquet(f"{d}/events.parquet").select(e.alias("id"), tokens.cast("long").alias("input"), cached.cast("long").alias("cached"), usd.alias("usd"))


@query(
    """WITH e AS (SELECT event_id, concat('router:', event_id, '|', CASE WHEN event_id % 3 = 0 THEN 'RunnableSequence' ELSE event_type END, ':x|worker:', event_id % 5) AS ns, CASE WHEN event_id % 4 = 0 THEN 'worker' ELSE 'other' END AS own FROM events)
SELECT event_id, array_to_string([p FOR p IN [trim(split_part(s, ':', 1)) FOR s IN string_split(ns, '|')] IF lower(p) NOT IN ('', 'langgraph', 'runnablesequence') AND p <> own], '/') AS path FROM e"""
)
def text_graph_path(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    middle = F.when(e % 3 == 0, "RunnableSequence").otherwise(F.col("event_type"))
    ns = F.concat(F.lit("router:"), e.cast("string"), F.lit("|"), middle, F.lit(":x|worker:"), (e % 5).cast("string"))
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", X.graph_path(ns, F.when(e % 4 == 0, "worker").otherwise("other")).alias("path"))


@query(
    """WITH d AS (SELECT doc_id, source, 'Header line' || chr(10) || text || ' ' || doc_id AS t FROM documents), n AS (SELECT doc_id, source, lower(regexp_replace(trim(t, ' ' || chr(10)), '[0-9]+', '#', 'g')) AS t FROM d),
l AS (SELECT doc_id, source, p, string_split(t, chr(10))[p] AS l FROM n, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS u(p)), k AS (SELECT source, count(*) AS n FROM n GROUP BY source),
c AS (SELECT source, l FROM l GROUP BY source, l HAVING count(DISTINCT doc_id) = (SELECT n FROM k WHERE k.source = l.source) AND count(DISTINCT doc_id) > 1),
r AS (SELECT n.doc_id, n.source, coalesce(string_agg(l.l, chr(10) ORDER BY p) FILTER (WHERE l.l IS NOT NULL), '') AS t FROM n LEFT JOIN (SELECT * FROM l WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.source = l.source AND c.l = l.l)) l ON l.doc_id = n.doc_id GROUP BY n.doc_id, n.source)
SELECT source, count(DISTINCT t) AS distinct_output FROM r GROUP BY source"""
)
def facts_frame_stripped(spark: SparkSession, d: str) -> DataFrame:
    """Distinct documents of each source, whole texts, without the lines that all of a source have."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    t = F.concat(F.lit("Header line\n"), F.col("text"), F.lit(" "), F.col("doc_id").cast("string"))
    return facts.frame_stripped(docs.select("source", "doc_id", t.alias("t")), "source", "doc_id", "t")


@query(
    oracle(
        """WITH s AS (SELECT coalesce(node_hint, name) AS node, CASE WHEN trim(output) = '' THEN 'empty' WHEN left(output, 1) IN ('{', '[') THEN 'json' WHEN len(string_split(output, ' ')) <= 4 THEN 'label' ELSE 'prose' END AS s FROM runs),
g AS (SELECT node, count(*) FILTER (WHERE s = 'empty') AS empty, count(*) FILTER (WHERE s = 'json') AS json, count(*) FILTER (WHERE s = 'label') AS label, count(*) FILTER (WHERE s = 'prose') AS prose FROM s GROUP BY node)
SELECT *, list_reverse_sort([json, label, prose])[2] >= 2 AS mixed FROM g""",
        "runs",
    )
)
def facts_shape_mix(spark: SparkSession, d: str) -> DataFrame:
    return facts.shape_mix(table(spark, d, "runs").withColumn("node", F.coalesce("node_hint", "name")), "node", "output")


@query(
    """WITH m AS (SELECT conv_id, turn, CASE WHEN role = 'user' AND (conv_id + turn) % 5 = 0 THEN 'tool' ELSE role END AS role, CASE WHEN conv_id % 3 = 0 THEN '[2] ' || text WHEN conv_id % 7 = 1 THEN 'Retrieved: ' || text ELSE text END AS text FROM conversations),
r AS (SELECT c.conv_id, c.turn, count(*) FILTER (WHERE p.role = 'user') > 1 OR count(*) FILTER (WHERE p.role = 'assistant') > 0 AS multi, count(*) FILTER (WHERE p.role = 'tool') > 0 AS tool,
 count(*) FILTER (WHERE p.role = 'user' AND (regexp_matches(p.text, '\\[[0-9]+\\]') OR contains(lower(p.text), 'retrieved'))) > 0 AS quoted FROM m c LEFT JOIN m p ON p.conv_id = c.conv_id AND p.turn < c.turn WHERE c.role = 'assistant' GROUP BY ALL)
SELECT conv_id % 7 AS node, count(*) AS n, count(*) FILTER (WHERE multi) * 2 > count(*) AS multi_turn, bool_or(tool) AS has_tool_result, count(*) FILTER (WHERE quoted) * 2 > count(*) AS rag_present FROM r GROUP BY ALL"""
)
def facts_structure(spark: SparkSession, d: str) -> DataFrame:
    """Calls in which every fifth user's turn is a tool's result, and some conversations quote documents."""
    role = F.when((F.col("role") == "user") & ((F.col("conv_id") + F.col("turn")) % 5 == 0), "tool").otherwise(F.col("role"))
    text = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("[2] "), "text")).when(F.col("conv_id") % 7 == 1, F.concat(F.lit("Retrieved: "), "text")).otherwise(F.col("text"))
    rows = _calls(turns(spark, d).select("conv_id", "turn", role.alias("role"), text.alias("text")))
    rows = rows.select((F.col("trace_id") % 7).alias("node"), F.transform("messages", lambda m: m["role"]).alias("roles"), F.transform("messages", lambda m: m["content"]).alias("contents"))
    return facts.structure(rows, "node")


@query(oracle("SELECT coalesce(node_hint, '(none)') AS node, string_agg(DISTINCT tool, ',' ORDER BY tool) AS tools, count(DISTINCT tool) AS n_tools FROM (SELECT node_hint, 'tool' || ((k + i) % 9) AS tool FROM runs, unnest(range(0, n_tools)) AS u(i)) GROUP BY ALL", "runs"))
def facts_tools_called(spark: SparkSession, d: str) -> DataFrame:
    called = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n_tools") - 1), lambda i: F.concat(F.lit("tool"), ((F.col("k") + i) % 9).cast("string")))
    rows = table(spark, d, "runs").where("n_tools > 0").select(F.coalesce("node_hint", F.lit("(none)")).alias("node"), F.explode(called).alias("tool"))
    return rows.groupBy("node").agg(F.array_join(F.array_sort(F.collect_set("tool")), ",").alias("tools"), F.count_distinct("tool").alias("n_tools"))


@query(oracle("SELECT coalesce(node_hint, '(none)') AS node, count(*) AS n, count(DISTINCT name) AS distinct_system, count(DISTINCT output) AS distinct_user, count(DISTINCT model_ord) AS models, min(name) = max(name) AS same_system FROM runs GROUP BY ALL", "runs"))
def facts_buckets(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "runs").groupBy(F.coalesce("node_hint", F.lit("(none)")).alias("node"))
    same = F.min("name") == F.max("name")
    return g.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("name").alias("distinct_system"), F.count_distinct("output").alias("distinct_user"), F.count_distinct("model_ord").alias("models"), same.alias("same_system"))


def step(i: int, by: str, item: str) -> str:
    """SQL that keeps each group's first item, and leaves out what is like it."""
    both = "len(list_intersect(l.w, k.w))"
    return f"""k{i} AS (SELECT {by}, min({item}) AS {item}, arg_min(w, {item}) AS w FROM l{i - 1} GROUP BY {by}),
l{i} AS (SELECT l.* FROM l{i - 1} l JOIN k{i} k ON k.{by} = l.{by} WHERE l.{item} > k.{item} AND {both} / greatest(1, len(l.w) + len(k.w) - {both}) < 0.8)"""


@query(
    f"""WITH t AS (SELECT source, doc_id, text, unnest(list_distinct(string_split(text, chr(10)))) AS line FROM documents),
c AS (SELECT source, line FROM t GROUP BY source, line HAVING count(DISTINCT doc_id) = (SELECT count(*) FROM documents x WHERE x.source = t.source)), f AS (SELECT source, list(line) AS lines FROM c GROUP BY source),
r AS (SELECT source, doc_id, text, array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(coalesce(lines, []), x)), chr(10)) AS rest FROM documents LEFT JOIN f USING (source)),
v AS (SELECT source, doc_id, list_filter(list_distinct(regexp_split_to_array(lower(rest), '\\s+')), lambda x: x <> '') AS w, list_filter(list_distinct(regexp_split_to_array(lower(text), '\\s+')), lambda x: x <> '') AS every FROM r),
l0 AS (SELECT source, doc_id, CASE WHEN len(w) > 0 THEN w ELSE every END AS w FROM v), {", ".join(step(i, "source", "doc_id") for i in range(1, 6))}
{" UNION ALL ".join(f"SELECT source, doc_id FROM k{i}" for i in range(1, 6))}"""
)
def facts_diverse_sample(spark: SparkSession, d: str) -> DataFrame:
    """A bounded sample of inputs that differ: the limit is the feature."""
    return facts.diverse_sample(spark.read.parquet(f"{d}/documents.parquet").select("source", "doc_id", "text"), "source", "doc_id", "text", 5)


@query(
    oracle(
        """WITH c AS (SELECT coalesce(node_hint, name) AS node, run_id, trace_id, string_split(CASE WHEN k % 2 = 0 THEN 'Plan the next steps for the request ' ELSE 'Review the answer below for any mistakes ' END || k, ' ')[1:6] AS six FROM runs WHERE run_type = 'llm'),
r AS (SELECT node, six, left(regexp_replace(lower(array_to_string(six[1:3], '')), '[^a-z0-9]+', '', 'g'), 14) AS frame FROM c GROUP BY node, six HAVING count(*) >= greatest(2, 0.2 * (SELECT count(*) FROM c x WHERE x.node = c.node))),
t AS (SELECT node, trace_id, count(*) AS n, count(DISTINCT r.six) AS k FROM c LEFT JOIN r USING (node, six) GROUP BY ALL),
ok AS (SELECT node FROM t WHERE n >= 2 GROUP BY node HAVING count(*) FILTER (WHERE k >= 2) * 2 >= count(*) INTERSECT SELECT node FROM r GROUP BY node HAVING count(*) >= 2)
SELECT node, run_id, CASE WHEN node IN (SELECT node FROM ok) THEN coalesce(r.frame, '') ELSE '' END AS frame FROM c LEFT JOIN r USING (node, six)""",
        "runs",
    )
)
def facts_frame_variants(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "runs").where("run_type = 'llm'").withColumn("node", F.coalesce("node_hint", "name"))
    said = F.concat(F.when(F.col("k") % 2 == 0, "Plan the next steps for the request ").otherwise("Review the answer below for any mistakes "), F.col("k").cast("string"))
    return facts.frame_variants(runs.withColumn("prompt", said), "node", "run_id", "trace_id", "prompt")
