"""Queries over logs: scans, diagnostics and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import runs
from spanloom.operators import diagnose
from spanloom.plans.fixtures import oracle, table
from spanloom.plans.registry import query
from spanloom.sources import logs
from spanloom.streaming import jobs as streams

_NEWEST = "roots AS (SELECT trace_id FROM runs WHERE parent_id IS NULL ORDER BY day DESC, run_id DESC LIMIT 40)"


@query(oracle(f"WITH {_NEWEST} SELECT run_id, trace_id, ord FROM runs WHERE trace_id IN (SELECT trace_id FROM roots)", "runs"))
def logs_newest_traces(spark: SparkSession, d: str) -> DataFrame:
    return logs.newest_traces(table(spark, d, "runs"), 40).select("run_id", "trace_id", "ord")


@query(oracle("WITH r AS (SELECT * FROM runs WHERE parent_id IS NULL) SELECT run_id, revision FROM r WHERE revision = (SELECT arg_max(revision, (day, run_id)) FROM r) ORDER BY day DESC, run_id DESC LIMIT 100", "runs"))
def logs_latest_revision(spark: SparkSession, d: str) -> DataFrame:
    """The newest revision's roots, newest first: the limit is the feature."""
    return logs.latest_revision(table(spark, d, "runs").where("parent_id IS NULL"), 100).select("run_id", "revision")


@query(oracle("SELECT count(*) AS n, count(*) >= 120 AS capped FROM (SELECT 1 FROM runs WHERE parent_id IS NULL LIMIT 120)", "runs"))
def logs_capped_count(spark: SparkSession, d: str) -> DataFrame:
    """A count that stops at its cap: the limit is the feature."""
    return logs.capped_count(table(spark, d, "runs").where("parent_id IS NULL"), 120)


@query(oracle("SELECT run_id, output FROM (SELECT run_id, output, row_number() OVER (PARTITION BY output ORDER BY run_id) AS k FROM runs WHERE output <> '') WHERE k <= 5", "runs"))
def logs_capped_per_prompt(spark: SparkSession, d: str) -> DataFrame:
    """At most five copies of each prompt."""
    return logs.capped_per_group(table(spark, d, "runs").where("output <> ''"), F.col("output"), "run_id", 5).select("run_id", "output")


@query(oracle("SELECT day, count(*) AS runs FROM runs WHERE CAST(day AS DATE) >= DATE '2024-01-30' - 3 GROUP BY day", "runs"))
def logs_window(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "runs").where(logs.in_window(F.col("day"), "2024-01-30", hours=60)).groupBy("day").agg(F.count(F.lit(1)).alias("runs"))


@query(oracle("SELECT DISTINCT node_hint AS agent FROM runs WHERE node_hint IS NOT NULL ORDER BY lower(node_hint) LIMIT 200", "runs"))
def logs_agents(spark: SparkSession, d: str) -> DataFrame:
    """Names for a menu: the limit is the feature."""
    return table(spark, d, "runs").where("node_hint IS NOT NULL").select(F.col("node_hint").alias("agent")).distinct().orderBy(F.lower("agent")).limit(200)


@query(oracle("SELECT run_id, coalesce(nullif(output, ''), error) AS response FROM runs WHERE run_id IN (SELECT doc_id FROM documents)", "runs"))
def logs_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Responses of the runs that any document is numbered after."""
    ids = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("run_id"))
    return logs.lookup(table(spark, d, "runs"), ids, "run_id").select("run_id", F.coalesce(F.when(F.col("output") != "", F.col("output")), F.col("error")).alias("response"))


@query(
    """SELECT o_orderkey, o_custkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' AND o_orderdate >= DATE '1993-06-01')
WHERE k <= 5 ORDER BY o_orderkey LIMIT 2000"""
)
def logs_scan(spark: SparkSession, d: str) -> DataFrame:
    """A log of orders (priority as run type, status as agent, customer as prompt) by type, agent and window, at most five copies of a
    prompt, 2,000 rows in all: the limits are the feature."""
    rows = spark.read.parquet(f"{d}/orders.parquet")
    out = logs.scan(rows, "o_orderkey", "o_custkey", equal={"o_orderpriority": "1-URGENT", "o_orderstatus": "F"}, time="o_orderdate", since="1993-06-01")
    return out.select("o_orderkey", "o_custkey", "o_orderdate")


#: Logged calls as JSON: requests that are objects or bare messages, parameters beside them that clash with the body, are null or unknown.
_LOGGED = """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN concat('[{{"content":"q', event_id, '","role":"user"}}]')
  ELSE concat('{{"messages":[{{"content":"q', event_id, '","role":"user"}}],"temperature":', event_id % 3, ',"x":{{"a":[1,null]}},"model":"asked-', event_id % 4, '"', CASE WHEN event_id % 7 = 0 THEN ',"stop":null' ELSE '' END, '}}') END AS request,
  CASE WHEN event_id % 6 = 0 THEN NULL WHEN event_id % 11 = 0 THEN '[1]' ELSE concat('{{"temperature":9,"max_tokens":', event_id % 900, ',"stop":["a","b"],"seed":null,"unknown":1,"tools":[{{"name":"t', event_id % 3, '"}}]}}') END AS params,
  CASE WHEN event_id % 8 = 0 THEN NULL WHEN event_id % 8 = 1 THEN '{{"choices":[]}}' ELSE concat('{{"model":"answered-', event_id % 3, '"}}') END AS response, CASE WHEN event_id % 9 = 0 THEN 'routed' WHEN event_id % 9 = 1 THEN '' END AS served FROM {events}"""
_BESIDE = ", ".join(f"'{k}'" for k in logs.BESIDE)


@query(
    f"""WITH c AS ({_LOGGED.format(events="events")}), l AS (SELECT * FROM c WHERE event_id IN (SELECT doc_id FROM documents)),
b AS (SELECT event_id, j.key, CAST(j.value AS VARCHAR) AS value FROM l, json_each(CASE WHEN left(request, 1) = '{{' THEN request ELSE '{{"messages":' || request || '}}' END) AS j),
p AS (SELECT event_id, j.key, CAST(j.value AS VARCHAR) AS value FROM l, json_each(CASE WHEN left(params, 1) = '{{' THEN params ELSE '{{}}' END) AS j WHERE j.key IN ({_BESIDE}) AND CAST(j.value AS VARCHAR) <> 'null'),
m AS (SELECT event_id, '"' || coalesce(nullif(served, ''), json_extract_string(response, '$.model')) || '"' AS value FROM l)
SELECT event_id, key, value FROM b WHERE key <> 'model' OR event_id NOT IN (SELECT event_id FROM m WHERE value IS NOT NULL)
UNION ALL SELECT p.* FROM p WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.event_id = p.event_id AND b.key = p.key) UNION ALL SELECT event_id, 'model', value FROM m WHERE value IS NOT NULL"""
)
def logs_lookup_requests(spark: SparkSession, d: str) -> DataFrame:
    """Requests of the calls that any document is numbered after: parameters under the body, the model that answered on top; a row
    for each key."""
    calls = spark.sql(_LOGGED, events=spark.read.parquet(f"{d}/events.parquet"))
    ids = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("event_id"))
    found = logs.lookup(calls, ids, "event_id")
    whole = logs.whole_request(*[F.col(c) for c in ("request", "params", "response", "served")])
    return found.select("event_id", F.explode(whole)).select("event_id", "key", F.to_json("value").alias("value"))


@query(
    oracle(
        """WITH u AS (SELECT 'revision' AS field, revision AS value, day FROM runs UNION ALL SELECT 'name', name, day FROM runs UNION ALL SELECT 'node', node_hint, day FROM runs WHERE node_hint IS NOT NULL),
g AS (SELECT field, value, count(*) AS n, min(day) AS first_day, max(day) AS last_day FROM u GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS k FROM g)
SELECT field, value, n, first_day, last_day FROM r WHERE k <= 8""",
        "runs",
    )
)
def diagnose_version_fields(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent values of each version field: a top-k report."""
    rows = table(spark, d, "runs").selectExpr("stack(3, 'revision', revision, 'name', name, 'node', node_hint) AS (field, value)", "day").where("value IS NOT NULL")
    g = rows.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    from pyspark.sql import Window

    return g.withColumn("k", F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), "value"))).where("k <= 8").drop("k")


#: Metadata of events as JSON: fields that vary, one that is stable, numbers and nulls, and two that are absent.
_META = """SELECT event_id, CAST(ts AS string) AS seen, concat('{{"revision_id":"r', event_id % 13, '","LANGSMITH_HOST_REVISION_ID":', CASE WHEN event_id % 3 = 0 THEN 'null' ELSE concat('"h', event_id % 4, '"') END,
  ',"graph_id":"main","assistant_id":', event_id % 5, ',"langgraph_version":"', CASE WHEN event_id % 2 = 0 THEN '0.1' ELSE 'a version whose name is longer than what a table has room for' END, '","other":1', CASE WHEN event_id % 7 = 0 THEN concat(',"LANGSMITH_HOST_PROJECT_ID":"p', event_id % 2, '"') ELSE '' END, '}}') AS meta FROM {events}"""
_FIELDS = ", ".join(f"('{f}', {k})" for k, f in enumerate(diagnose.VERSION_FIELDS, 1))


@query(
    f"""WITH e AS ({_META.format(events="events")}), v AS (SELECT * FROM (VALUES {_FIELDS}) AS t(field, place)), u AS (SELECT field, json_extract_string(meta, '$.' || field) AS value, left(seen, 19) AS seen FROM e CROSS JOIN v),
g AS (SELECT field, value, count(*) AS n, min(seen) AS first_at, max(seen) AS last_at FROM u WHERE value IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, first_at, value) AS k, count(*) OVER (PARTITION BY field) AS n_values FROM g)
SELECT v.field, v.place, CASE WHEN n_values IS NULL THEN 'absent' WHEN n_values = 1 THEN 'STABLE (one value)' ELSE 'VARIES → ' || n_values || ' values' END AS state, left(value, 40) AS value, coalesce(n, 0) AS n, first_at, last_at
FROM v LEFT JOIN (SELECT * FROM r WHERE k <= 8) r USING (field)"""
)
def diagnose_version_matrix(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent values of eight version fields of metadata: a top-k report."""
    return diagnose.version_fields(spark.sql(_META, events=spark.read.parquet(f"{d}/events.parquet")), "meta", "seen")


@query(oracle("SELECT revision, count(*) AS runs, count(DISTINCT trace_id) AS traces, min(day) AS first_day, max(day) AS last_day, count(*) FILTER (WHERE error <> '') AS errors FROM runs GROUP BY revision", "runs"))
def diagnose_tally(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "runs").groupBy("revision")
    return g.agg(F.count(F.lit(1)).alias("runs"), F.count_distinct("trace_id").alias("traces"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count_if(F.col("error") != "").alias("errors"))


@query(
    oracle(
        """WITH g AS (SELECT trace_id, count(*) AS n, count(*) FILTER (WHERE run_type = 'llm') AS llm, count(*) FILTER (WHERE node_hint IS NULL) AS untagged, count(*) FILTER (WHERE error <> '') AS errors FROM runs GROUP BY trace_id)
SELECT trace_id, n, array_to_string([x FOR x IN [CASE WHEN llm = 0 THEN 'no model calls' END, CASE WHEN untagged * 2 > n THEN 'mostly untagged' END, CASE WHEN errors * 4 > n THEN 'many errors' END, CASE WHEN n < 50 THEN 'few runs' END] IF x IS NOT NULL], '; ') AS flags FROM g""",
        "runs",
    )
)
def diagnose_flags(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "runs").groupBy("trace_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("run_type") == "llm").alias("llm"), F.count_if(F.col("node_hint").isNull()).alias("untagged"), F.count_if(F.col("error") != "").alias("errors"))
    flags = F.array_compact(F.array(F.when(F.col("llm") == 0, "no model calls"), F.when(F.col("untagged") * 2 > F.col("n"), "mostly untagged"), F.when(F.col("errors") * 4 > F.col("n"), "many errors"), F.when(F.col("n") < 50, "few runs")))
    return g.select("trace_id", "n", F.array_join(flags, "; ").alias("flags"))


@query(
    """SELECT event_type AS judge, count(*) AS calls, count(*) FILTER (WHERE event_id % 3 = 0) AS reads, CAST(sum(event_id % 500) AS BIGINT) AS read_tokens, CAST(round_even(100.0 * count(*) FILTER (WHERE event_id % 3 = 0) / count(*), 0) AS BIGINT) AS hit_pct,
 count(*) FILTER (WHERE event_id % 50 = 0) AS blank, CASE WHEN count(*) FILTER (WHERE event_id % 3 = 0) * 2 > count(*) THEN 'cache works' WHEN count(*) FILTER (WHERE event_id % 3 = 0) > 0 THEN 'cache partly works' ELSE 'no cache' END AS said FROM events GROUP BY event_type"""
)
def diagnose_judge_cache(spark: SparkSession, d: str) -> DataFrame:
    hit = F.count_if(F.col("event_id") % 3 == 0)
    n = F.count(F.lit(1))
    said = F.when(hit * 2 > n, "cache works").when(hit > 0, "cache partly works").otherwise("no cache")
    g = spark.read.parquet(f"{d}/events.parquet").groupBy(F.col("event_type").alias("judge"))
    return g.agg(n.alias("calls"), hit.alias("reads"), F.sum(F.col("event_id") % 500).alias("read_tokens"), F.bround(hit * 100.0 / n).cast("long").alias("hit_pct"), F.count_if(F.col("event_id") % 50 == 0).alias("blank"), said.alias("said"))


@query(
    """WITH a AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+')) AS n FROM documents), b AS (SELECT doc_id, n FROM a WHERE doc_id % 2 = 0)
SELECT n, count(*) AS copies FROM (SELECT n FROM a EXCEPT ALL SELECT n FROM b) GROUP BY n"""
)
def diagnose_numbers_difference(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of texts less those of some of them, as multisets."""
    a = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("([0-9]+)"), 1)).alias("n"))
    return a.select("n").exceptAll(a.where("doc_id % 2 = 0").select("n")).groupBy("n").agg(F.count(F.lit(1)).alias("copies"))


@query("SELECT event_type AS k, arg_max(value, event_id) AS v, count(*) AS writes, CAST(floor(epoch(max(ts))) AS BIGINT) AS last_at FROM events GROUP BY event_type")
def store_last_write_wins(spark: SparkSession, d: str) -> DataFrame:
    """A key-value store's state: the last write of each key."""
    g = spark.read.parquet(f"{d}/events.parquet").groupBy(F.col("event_type").alias("k"))
    return g.agg(F.max_by("value", "event_id").alias("v"), F.count(F.lit(1)).alias("writes"), F.unix_timestamp(F.max("ts").cast("timestamp")).alias("last_at"))


def _stream(spark: SparkSession, d: str) -> DataFrame:
    table_ = spark.read.parquet(f"{d}/events.parquet")
    # A stream reads a folder: the table's own, or where the table is one file, this file in the folder around it.
    single = any(f.endswith("/events.parquet") for f in table_.inputFiles())
    stream = spark.readStream.schema(table_.schema)
    return stream.option("pathGlobFilter", "events.parquet").parquet(d) if single else stream.parquet(f"{d}/events.parquet")


#: When events arrive: in four runs by day of the month; every 17th a run late, every 101st two runs late.
_ARRIVAL = "least(3, floor((day(ts) - 1) / 8) + CASE WHEN event_id % 101 = 0 THEN 2 WHEN event_id % 17 = 0 THEN 1 ELSE 0 END)"


@query(
    f"""WITH e AS (SELECT *, CAST({_ARRIVAL} AS BIGINT) AS run, date_trunc('day', ts) AS d FROM events), m AS (SELECT run, max(ts) AS latest FROM e GROUP BY run),
w AS (SELECT r.run, max(m.latest) - INTERVAL 10 DAY AS mark FROM (SELECT DISTINCT run FROM e) r LEFT JOIN m ON m.run < r.run GROUP BY r.run),
k AS (SELECT e.*, coalesce(d + INTERVAL 1 DAY <= mark, false) AS late FROM e JOIN w USING (run))
SELECT CASE WHEN NOT late THEN strftime(d, '%Y-%m-%d') END AS day, event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM k GROUP BY ALL"""
)
def stream_daily(spark: SparkSession, d: str) -> DataFrame:
    """Counts of days, upserted by four runs of one stream, part of whose rows are late; without a day: rows too late for their
    window."""
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("run", F.expr(_ARRIVAL).cast("long"))
    runs_ = [e.where(F.col("run") == k).drop("run") for k in range(4)]
    counted, arrived = streams.upserted(runs_, lambda s: streams.daily(s, "10 days"), ["day", "event_type"])
    seen = counted.groupBy("event_type").agg(F.sum("n").alias("seen"), F.sum("ids").alias("seen_ids"))
    late = arrived.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids")).join(seen, "event_type", "left").na.fill(0)
    late = late.select(F.lit(None).cast("string").alias("day"), "event_type", (F.col("n") - F.col("seen")).alias("n"), (F.col("ids") - F.col("seen_ids")).alias("ids"))
    return counted.unionByName(late.where("n > 0"))


@query(
    """WITH e AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events), s AS (SELECT *, sum(CASE WHEN before IS NULL OR ts - before > INTERVAL 1 DAY THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e)
SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS first, count(*) AS n FROM s GROUP BY user_id, k"""
)
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """The stream's sessions over all events as a batch, those that may still go on included."""
    return streams.sessions(spark.read.parquet(f"{d}/events.parquet"))


@query(
    """WITH RECURSIVE l AS (SELECT event_id % 500 AS item, 'w' || (user_id % 5) AS worker, event_id % 1000 + 1 AS second, ['claim', 'claim', 'beat', 'done'][event_id % 4 + 1] AS kind FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY second, worker, kind) AS k FROM l),
s AS (SELECT DISTINCT item, CAST(0 AS BIGINT) AS k, '' AS holder, CAST(0 AS BIGINT) AS seen, false AS done, '' AS worker, CAST(0 AS BIGINT) AS second, '' AS kind, false AS accepted, '' AS lapsed, CAST(0 AS BIGINT) AS lapsed_at FROM n
  UNION ALL SELECT item, k, CASE WHEN ok THEN worker ELSE held END, CASE WHEN ok THEN second ELSE seen END, CASE WHEN ok THEN kind = 'done' ELSE done END, worker, second, kind, ok, lapsed, seen + 120
  FROM (SELECT *, NOT done AND (held = worker OR (held = '' AND kind = 'claim')) AS ok FROM (
    SELECT n.*, s.seen, s.done, CASE WHEN s.holder <> '' AND NOT s.done AND n.second - s.seen > 120 THEN s.holder ELSE '' END AS lapsed, CASE WHEN s.holder <> '' AND NOT s.done AND n.second - s.seen > 120 THEN '' ELSE s.holder END AS held
    FROM s JOIN n ON n.item = s.item AND n.k = s.k + 1))),
z AS (SELECT item, arg_max(holder, k) AS holder, arg_max(seen, k) AS seen, arg_max(done, k) AS done FROM s GROUP BY item)
SELECT item, worker, second, kind, accepted FROM s WHERE k > 0 UNION ALL SELECT item, lapsed, lapsed_at, 'freed', true FROM s WHERE lapsed <> ''
UNION ALL SELECT item, holder, seen + 120, 'freed', true FROM z WHERE holder <> '' AND NOT done AND seen + 121 <= (SELECT max(second) FROM l)"""
)
def stream_claims(spark: SparkSession, d: str) -> DataFrame:
    """Claims, beats and results on requests as a stream with a state and a timer for each request."""
    e = _stream(spark, d)
    kind = F.element_at(F.array(F.lit("claim"), F.lit("claim"), F.lit("beat"), F.lit("done")), (F.col("event_id") % 4 + 1).cast("int"))
    log = e.select((F.col("event_id") % 500).alias("item"), F.concat(F.lit("w"), (F.col("user_id") % 5).cast("string")).alias("worker"), (F.col("event_id") % 1000 + 1).alias("second"), kind.alias("kind"))
    return streams.drained(streams.claims(log), "claims")


@query("SELECT DISTINCT user_id % 20 AS job_id FROM events")
def stream_callbacks(spark: SparkSession, d: str) -> DataFrame:
    e = _stream(spark, d).select((F.col("user_id") % 20).alias("job_id"), "ts")
    return streams.drained(streams.callbacks_once(e), "callbacks")


@query(
    """WITH c AS (SELECT event_id, event_id % 5 * 100 AS recorded, event_id % 700 AS tokens, CASE event_id % 6 WHEN 0 THEN 'prompt is too long' WHEN 1 THEN 'Credit balance is too low' WHEN 2 THEN 'not allowed to access model' WHEN 3 THEN 'boom' ELSE '' END AS error, CASE WHEN event_id % 7 = 0 THEN 401 ELSE 500 END AS status FROM events)
SELECT event_id, CAST(least(1024, CASE WHEN recorded > 0 THEN recorded ELSE greatest(512, tokens * 3) END) AS BIGINT) AS budget,
 CASE WHEN error = '' THEN NULL WHEN NOT contains(error, 'not allowed to access') AND (status = 401 OR contains(lower(error), 'credit balance')) THEN 'account' WHEN contains(error, 'too long') THEN 'too large' ELSE 'request' END AS about
FROM c WHERE recorded > 0 OR tokens > 0"""
)
def calls_budget_and_errors(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    error = F.element_at(F.array(*[F.lit(x) for x in ("prompt is too long", "Credit balance is too low", "not allowed to access model", "boom", "", "")]), (e % 6 + 1).cast("int"))
    recorded, tokens = e % 5 * 100, e % 700
    rows = spark.read.parquet(f"{d}/events.parquet").where((recorded > 0) | (tokens > 0))
    about = runs.judge_error(error, F.when(e % 7 == 0, 401).otherwise(500))
    return rows.select("event_id", runs.replay_budget(recorded, tokens, F.lit(""), F.lit(1024)).alias("budget"), about.alias("about"))


@query(
    """WITH e AS (SELECT user_id, event_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS until FROM events)
SELECT event_id, CAST(coalesce(trunc(date_diff('microsecond', ts, until) / 1000), 0) AS BIGINT) AS runtime_ms, CASE WHEN until IS NOT NULL THEN CAST(greatest(0, trunc(date_diff('microsecond', until, ts) / 1000)) AS BIGINT) END AS ttft_ms FROM e"""
)
def calls_times(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    e = spark.read.parquet(f"{d}/events.parquet").withColumn("until", F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return e.select("event_id", runs.runtime_ms(F.col("ts"), F.col("until")).alias("runtime_ms"), runs.ttft_ms(F.col("until"), F.col("ts")).alias("ttft_ms"))


@query(
    """WITH i AS (SELECT event_id AS id, event_id % 900 AS item, CASE WHEN event_id % 4 = 0 THEN '' ELSE event_type END AS model, event_id % 5 AS kind FROM events), n AS (SELECT *, count(*) OVER (PARTITION BY item) > 1 AS twice FROM i)
SELECT id, array_to_string([x FOR x IN [CASE WHEN twice THEN 'duplicate item id' END, CASE WHEN kind = 1 THEN 'candidate labels must be unique' END,
 CASE WHEN kind = 2 THEN 'candidate label ''original'' is reserved for the original model' END, CASE WHEN model = '' THEN 'request.model is required' END, CASE WHEN kind = 3 THEN 'request.messages needs a user message' END] IF x IS NOT NULL], '; ') AS problems FROM n"""
)
def jobs_submit_problems(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    kind = F.col("event_id") % 5
    second = F.when(kind == 1, "mini").when(kind == 2, "original").otherwise("router")
    twice = F.count(F.lit(1)).over(Window.partitionBy(F.col("event_id") % 900)) > 1
    p = runs.problems(twice, F.array(F.lit("mini"), second), F.when(F.col("event_id") % 4 == 0, "").otherwise(F.col("event_type")), F.array(F.lit("system"), F.when(kind == 3, "assistant").otherwise("user")))
    return spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("id"), F.array_join(p, "; ").alias("problems"))


@query("SELECT conv_id, (turn // 2) AS part, 'USER:' || chr(10) || 'q' || conv_id || chr(10) || chr(10) || upper(role) || ':' || chr(10) || text AS request, turn FROM conversations WHERE role IN ('user', 'assistant')")
def judges_request_text(spark: SparkSession, d: str) -> DataFrame:
    """The request as a judge reads it."""
    first = F.struct(F.lit("user").alias("role"), F.concat(F.lit("q"), F.col("conv_id").cast("string")).alias("content"))
    messages = F.array(first, F.struct("role", F.col("text").alias("content")))
    rows = spark.read.parquet(f"{d}/conversations.parquet").where("role IN ('user', 'assistant')")
    return rows.select("conv_id", F.floor(F.col("turn") / 2).alias("part"), runs.request_text(messages, F.array().cast("array<string>")).alias("request"), "turn")


@query(
    """SELECT conv_id, turn, CASE WHEN lower(role) = 'system' THEN 'system' WHEN role = 'user' THEN 'user' ELSE 'assistant' END AS role, CASE WHEN conv_id % 3 = 1 THEN 'a' || chr(10) || text ELSE text END AS content FROM conversations WHERE text <> ''"""
)
def messages_normalised(spark: SparkSession, d: str) -> DataFrame:
    """Messages logged in three shapes (plain, serialised constructor with parts, type and data), read back alike."""
    from spanloom.functions.messages import messages

    kind = F.col("conv_id") % 3
    t = spark.read.parquet(f"{d}/conversations.parquet").where("text <> ''")
    plain = F.to_json(F.struct("role", F.col("text").alias("content")))
    parts = F.array(F.struct(F.lit("text").alias("type"), F.lit("a").alias("text")), F.struct(F.lit("thinking").alias("type"), F.lit("no").alias("text")), F.struct(F.lit("text").alias("type"), F.col("text").alias("text")))
    name = F.when(F.col("role") == "user", "HumanMessage").when(F.col("role") == "system", "SystemMessage").otherwise("AIMessage")
    built = F.to_json(F.struct(F.lit("constructor").alias("type"), F.array(F.lit("schema"), name).alias("id"), F.struct(parts.alias("content")).alias("kwargs")))
    kept = F.to_json(F.struct(F.when(F.col("role") == "assistant", "ai").otherwise(F.col("role")).alias("type"), F.struct(F.col("text").alias("content")).alias("data")))
    one = F.when(kind == 0, plain).when(kind == 1, built).otherwise(kept)
    rows = t.select("conv_id", "turn", F.concat(F.lit('{"messages": ['), one, F.lit("]}")).alias("inputs"))
    m = messages(F.col("inputs"))[0]
    return rows.select("conv_id", "turn", m["role"].alias("role"), m["content"].alias("content"))
