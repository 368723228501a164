"""Queries over votes, verdicts and validation jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions.text import coherence, parse_coherence, parse_fit
from spanloom.operators import jobs as J
from spanloom.operators import results as R
from spanloom.operators import votes as V
from spanloom.plans.fixtures import oracle, table
from spanloom.plans.registry import query

_OUT = """need AS (SELECT v.* FROM votes v JOIN (SELECT item, cand, run, kept AS k0 FROM votes WHERE vote = 0) f USING (item, cand, run) WHERE vote = 0 OR k0 IS NULL OR NOT k0),
g AS (SELECT item, cand, run, count(*) AS n, count(kept) AS decided, count(*) FILTER (WHERE kept) AS yes, count(*) FILTER (WHERE kept AND starts_with(reason, 'acceptable:')) AS loose,
  arg_min(reason, vote) FILTER (WHERE kept) AS ry, arg_min(reason, vote) FILTER (WHERE NOT kept) AS rn, arg_min(reason, vote) AS ra FROM need GROUP BY ALL),
o AS (SELECT item, cand, run, n, decided, yes, loose, decided * 2 > n AND yes * 2 > decided AS kept, CASE WHEN decided * 2 <= n THEN 'unclear' WHEN yes * 2 > decided THEN CASE WHEN loose * 2 > yes THEN 'acceptable' ELSE 'match' END ELSE 'drift' END AS category,
  coalesce(CASE WHEN decided * 2 > n AND yes * 2 > decided THEN ry ELSE rn END, ra) AS reason FROM g),
runs_of AS (SELECT *, CASE WHEN kept THEN yes ELSE decided - yes END || '/' || decided AS votes FROM o)"""
_CAND = f"""{_OUT}, c AS (SELECT item, cand, count(*) AS "of", count(*) FILTER (WHERE kept) AS kept, count(*) FILTER (WHERE category = 'match') AS match, count(*) FILTER (WHERE category = 'acceptable') AS acceptable,
  count(*) FILTER (WHERE category = 'drift') AS drift, count(*) FILTER (WHERE category = 'unclear') AS unclear FROM runs_of GROUP BY ALL),
judged AS (SELECT *, CASE WHEN item % 13 = 0 OR unclear > 0 OR (item % 5) / 4.0 < 0.6 - 1e-9 THEN 'unverified' WHEN kept / "of" + 1e-9 >= (item % 5) / 4.0 - 0.2 THEN 'within' ELSE 'outside' END AS verdict FROM c)"""


def judged(spark: SparkSession, d: str) -> DataFrame:
    rows = V.candidates(V.run_outcomes(V.needed_votes(table(spark, d, "votes"))))
    failed = F.when(F.col("item") % 13 == 0, 1).otherwise(0) + F.col("unclear")
    return rows.withColumn("verdict", V.verdict(F.col("kept"), F.col("of"), failed, F.col("item") % 5, F.lit(4)))


@query(oracle(f"WITH {_OUT} SELECT * FROM runs_of", "votes"))
def votes_run_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return V.run_outcomes(V.needed_votes(table(spark, d, "votes")))


@query(oracle(f"WITH {_CAND} SELECT * FROM judged", "votes"))
def votes_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return judged(spark, d)


@query(
    oracle(
        f"""WITH {_CAND}, dr AS (SELECT r.item, r.cand, r.reason, count(*) AS n, min(r.run) AS first FROM runs_of r JOIN judged j ON j.item = r.item AND j.cand = r.cand WHERE r.reason <> '' AND r.kept = (j.verdict = 'within') GROUP BY ALL),
jr AS (SELECT item, cand, arg_min(reason, (-n, first)) AS judge_reason FROM dr GROUP BY ALL),
av AS (SELECT item, cand, CAST(round_even(avg(nullif(latency_ms, 0)), 0) AS BIGINT) AS latency_ms, CAST(round_even(avg(cost_micros), 0) AS BIGINT) AS cost_micros FROM answers GROUP BY ALL)
SELECT j.item, j.cand, j.kept, j."of", round_even(j.kept / j."of", 3) AS fit_rate, j.verdict, coalesce(jr.judge_reason, '') AS judge_reason, latency_ms, cost_micros
FROM judged j LEFT JOIN jr ON jr.item = j.item AND jr.cand = j.cand LEFT JOIN av ON av.item = j.item AND av.cand = j.cand""",
        "votes",
        "answers",
    )
)
def votes_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Candidates with their verdict, the judges' most common reason for it, and mean time and cost of an answer."""
    outcomes = V.run_outcomes(V.needed_votes(table(spark, d, "votes")))
    rows, by = judged(spark, d), ["item", "cand"]
    out = rows.join(V.judge_reasons(outcomes, rows), by, "left").join(V.averages(table(spark, d, "answers")), by, "left")
    fit = F.bround(F.col("kept") / F.col("of"), 3).alias("fit_rate")
    return out.select("item", "cand", "kept", "of", fit, "verdict", F.coalesce("judge_reason", F.lit("")).alias("judge_reason"), "latency_ms", "cost_micros")


@query(
    oracle(
        f"""WITH {_CAND} SELECT 'node' || (item % 40) AS key, count(*) AS n, count(*) FILTER (WHERE verdict = 'within') AS safe,
CASE WHEN count(*) < 3 THEN 'LOW-EVIDENCE' WHEN count(*) FILTER (WHERE verdict = 'within') >= ceil(count(*) * 0.8::DOUBLE) THEN 'SAFE' ELSE 'NOT-SAFE' END AS verdict FROM judged GROUP BY ALL""",
        "votes",
    )
)
def votes_node_safe(spark: SparkSession, d: str) -> DataFrame:
    return V.node_safe(judged(spark, d).withColumn("key", F.concat(F.lit("node"), (F.col("item") % 40).cast("string"))))


@query(
    """WITH i AS (SELECT event_id AS id, event_id % 2 = 0 AS recorded, CAST(event_id % 3 AS INT) AS n FROM events)
SELECT id, -1 AS who, CAST(r AS INT) AS run FROM i, unnest(range(1, 5 + CASE WHEN recorded THEN 0 ELSE 1 END)) AS u(r)
UNION ALL SELECT id, CAST(c AS INT), CAST(r AS INT) FROM i, unnest(range(0, n)) AS u(c), unnest(range(1, 6)) AS v(r)"""
)
def votes_call_plan(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    return V.plan_calls(e.select(F.col("event_id").alias("id"), (F.col("event_id") % 2 == 0).alias("recorded"), (F.col("event_id") % 3).cast("int").alias("candidates")))


@query(
    """WITH a AS (SELECT conv_id AS item, turn, trim('  ' || text || CASE WHEN turn % 3 = 0 THEN '!' ELSE '' END) AS output FROM conversations), r AS (SELECT DISTINCT conv_id AS item, trim(text) AS output FROM conversations)
SELECT item, turn FROM a JOIN r USING (item, output)"""
)
def votes_exact_copies(spark: SparkSession, d: str) -> DataFrame:
    """Answers that equal a turn of their conversation; every third one was changed."""
    t = spark.read.parquet(f"{d}/conversations.parquet")
    changed = F.concat(F.lit("  "), "text", F.when(F.col("turn") % 3 == 0, "!").otherwise(""))
    return V.exact_copies(t.select(F.col("conv_id").alias("item"), "turn", changed.alias("output")), t.select(F.col("conv_id").alias("item"), F.col("text").alias("output"))).select("item", "turn")


_REPLIES = """SELECT event_id AS id, CASE event_id % 8 WHEN 0 THEN 'EQUIVALENT: same facts' WHEN 1 THEN concat('Verdict: DRIFT - dropped ', event_type) WHEN 2 THEN 'I think so' WHEN 3 THEN concat('thinking\n**VARIATION** shorter ', event_type)
 WHEN 4 THEN 'UNSURE' WHEN 5 THEN 'BROKE.' WHEN 6 THEN concat('KEPT | ', event_type, ' |') ELSE '' END AS reply,
 CASE event_id % 6 WHEN 0 THEN 'DIVERGENT 2, 4\n2: other' WHEN 1 THEN 'DIVERGENT none' WHEN 2 THEN concat('CONSISTENT ', CAST(event_id % 7 AS string), '/4') WHEN 3 THEN 'no idea' WHEN 4 THEN 'Divergent: 1,1,9' ELSE 'CONSISTENT 3/4\nDIVERGENT 4' END AS coherence FROM events"""
_REPLIES_DUCK = _REPLIES.replace("\\n", "' || chr(10) || '")


@query(
    f"""WITH r AS ({_REPLIES_DUCK}), w AS (SELECT id, regexp_extract(reply, '(?m)^\\W*(?:[Vv]erdict\\W*)?(EQUIVALENT|VARIATION|DRIFT|UNSURE|KEPT|BROKE)\\b', 1) AS word,
 trim(regexp_extract(reply, '(?m)^\\W*(?:[Vv]erdict\\W*)?(?:EQUIVALENT|VARIATION|DRIFT|UNSURE|KEPT|BROKE)\\b(.*)$', 1), ' .:-*_|' || chr(9)) AS tail FROM r),
k AS (SELECT id, word, tail, CASE WHEN word IN ('EQUIVALENT', 'VARIATION', 'KEPT') THEN true WHEN word IN ('DRIFT', 'BROKE') THEN false END AS kept FROM w),
d AS (SELECT *, coalesce(nullif(tail, ''), CASE WHEN kept THEN 'matches the set' WHEN NOT kept THEN 'differs from the set' ELSE 'the judge is unsure' END) AS why FROM k)
SELECT id, kept, CASE word WHEN '' THEN 'no verdict in the judge''s reply' WHEN 'VARIATION' THEN 'acceptable: ' || why WHEN 'UNSURE' THEN 'unclear: ' || why ELSE why END AS reason FROM d"""
)
def judges_parse_fit(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.sql(_REPLIES.replace("FROM events", "FROM {events}"), events=spark.read.parquet(f"{d}/events.parquet"))
    kept, reason = parse_fit(F.col("reply"))
    return rows.select("id", kept.alias("kept"), reason.alias("reason"))


@query(
    f"""WITH r AS ({_REPLIES_DUCK}), p AS (SELECT id, regexp_extract(coherence, '(?mi)^\\W*DIVERGENT\\b[:\\s]*(none|[0-9, ]+)', 1) AS listed, TRY_CAST(nullif(regexp_extract(coherence, '(?i)CONSISTENT\\W*(\\d+)\\s*/\\s*\\d+', 1), '') AS INT) AS stated FROM r)
SELECT id, CAST(CASE WHEN listed <> '' THEN 4 - len(list_filter(list_distinct(list_transform(regexp_extract_all(listed, '[0-9]+'), lambda x: CAST(x AS INT))), lambda x: x BETWEEN 1 AND 4)) WHEN stated IS NOT NULL THEN greatest(0, least(stated, 4)) END AS INT) AS agree FROM p"""
)
def judges_parse_coherence(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.sql(_REPLIES.replace("FROM events", "FROM {events}"), events=spark.read.parquet(f"{d}/events.parquet"))
    return rows.select("id", parse_coherence(F.col("coherence"), F.lit(4)).alias("agree"))


@query(
    f"""WITH r AS (SELECT id, coherence || chr(10) || '2: differs by ' || id || ' ' || chr(10) || ' 4 - second' || chr(10) || '9: beyond' || CASE WHEN id % 3 = 0 THEN chr(10) || '2 - the last' ELSE '' END AS reply FROM ({_REPLIES_DUCK})),
p AS (SELECT id, reply, regexp_extract(reply, '(?mi)^\\W*DIVERGENT\\b[:\\s]*(none|[0-9, ]+)', 1) AS listed, TRY_CAST(nullif(regexp_extract(reply, '(?i)CONSISTENT\\W*(\\d+)\\s*/\\s*\\d+', 1), '') AS INT) AS stated,
  regexp_extract_all(reply, '(?m)^\\s*(\\d+)\\s*[:\\-]\\s*(.+)$', 1) AS ns, regexp_extract_all(reply, '(?m)^\\s*(\\d+)\\s*[:\\-]\\s*(.+)$', 2) AS ws FROM r),
q AS (SELECT *, list_sort(list_filter(list_distinct(list_transform(regexp_extract_all(listed, '[0-9]+'), lambda x: CAST(x AS INT))), lambda x: x BETWEEN 1 AND 4)) AS div FROM p),
w AS (SELECT id, n, arg_max(left(trim(why), 120), i) AS why FROM (SELECT id, unnest(ns) AS n, unnest(ws) AS why, generate_subscripts(ns, 1) AS i FROM q) WHERE CAST(n AS INT) BETWEEN 1 AND 4 GROUP BY id, n),
s AS (SELECT id, string_agg(n || ': ' || why, '; ' ORDER BY CAST(n AS INT)) AS reasons FROM w GROUP BY id)
SELECT id, CAST(CASE WHEN listed <> '' THEN 4 - len(div) ELSE greatest(0, least(stated, 4)) END AS INT) AS agree, array_to_string(div, ',') AS divergent, coalesce(reasons, '') AS reasons FROM q LEFT JOIN s USING (id) WHERE listed <> '' OR stated IS NOT NULL"""
)
def judges_coherence(spark: SparkSession, d: str) -> DataFrame:
    """Readable replies about an original's four answers: how many agree, which don't, and why."""
    rows = spark.sql(_REPLIES.replace("FROM events", "FROM {events}"), events=spark.read.parquet(f"{d}/events.parquet"))
    more = F.concat("coherence", F.lit("\n2: differs by "), F.col("id").cast("string"), F.lit(" \n 4 - second\n9: beyond"), F.when(F.col("id") % 3 == 0, "\n2 - the last").otherwise(""))
    c = rows.select("id", coherence(more, F.lit(4)).alias("c")).where("c IS NOT NULL")
    said = F.transform("c.reasons", lambda x: F.concat(x["number"].cast("string"), F.lit(": "), x["reason"]))
    return c.select("id", "c.agree", F.array_join("c.divergent", ",").alias("divergent"), F.array_join(said, "; ").alias("reasons"))


_V = ", ".join(f"count(*) FILTER (WHERE verdict = '{v}') AS {v}" for v in J.VERDICTS)
_SUMMARY = f"""s AS (SELECT job_id, label, min(pos) AS pos, count(*) AS requests, {_V}, round_even(avg(kept / runs), 3) AS avg_rate,
  CAST(round_even(avg(latency_ms), 0) AS BIGINT) AS avg_latency_ms, CAST(round_even(avg(cost_micros), 0) AS BIGINT) AS avg_cost_micros FROM cells GROUP BY job_id, label)"""


@query(
    oracle(
        f"""WITH {_SUMMARY}, b AS (SELECT job_id, avg_latency_ms AS l0, avg_cost_micros AS c0 FROM s WHERE label = 'original')
SELECT s.*, CASE WHEN label <> 'original' THEN CAST(round_even((avg_cost_micros - c0) / nullif(c0, 0) * 100, 0) AS BIGINT) END AS cost_vs_original_pct,
  CASE WHEN label <> 'original' THEN CAST(round_even((avg_latency_ms - l0) / nullif(l0, 0) * 100, 0) AS BIGINT) END AS latency_vs_original_pct,
  CASE WHEN label <> 'original' THEN round_even(within / requests, 3) END AS within_rate FROM s JOIN b USING (job_id)""",
        "cells",
    )
)
def jobs_summary(spark: SparkSession, d: str) -> DataFrame:
    return J.summary(table(spark, d, "cells"))


@query(
    oracle(
        f"""WITH g AS (SELECT job_id, label, served_model, count(*) AS requests, {_V} FROM cells WHERE label <> 'original' GROUP BY ALL), w AS (SELECT *, count(*) OVER (PARTITION BY job_id, label) AS k FROM g)
SELECT * EXCLUDE (k) FROM w WHERE k > 1""",
        "cells",
    )
)
def jobs_routing(spark: SparkSession, d: str) -> DataFrame:
    return J.routing(table(spark, d, "cells"))


@query(oracle("SELECT job_id, seq FROM cells WHERE label <> 'original' GROUP BY ALL HAVING bool_or(verdict <> 'within')", "cells"))
def jobs_problems(spark: SparkSession, d: str) -> DataFrame:
    return J.matching(table(spark, d, "cells"), show="problems")


@query(oracle("SELECT job_id, seq FROM cells WHERE label <> 'original' GROUP BY ALL HAVING count(DISTINCT verdict) > 1 AND bool_or(label = 'mini' AND verdict = 'outside')", "cells"))
def jobs_split_and_outside(spark: SparkSession, d: str) -> DataFrame:
    return J.matching(table(spark, d, "cells"), show="split", label="mini", verdict="outside")


@query(oracle("SELECT seq, label, verdict, latency_ms FROM cells WHERE job_id = 3 ORDER BY seq, pos LIMIT 50 OFFSET 100", "cells"))
def jobs_page(spark: SparkSession, d: str) -> DataFrame:
    """A page of a report: the limit is the feature."""
    return table(spark, d, "cells").where("job_id = 3").orderBy("seq", "pos").offset(100).limit(50).select("seq", "label", "verdict", "latency_ms")


@query(
    oracle(
        """WITH w AS (SELECT * EXCLUDE (event_id), max(CASE WHEN label = 'original' THEN latency_ms END) OVER o AS original_latency_ms, max(CASE WHEN label = 'original' THEN cost_micros END) OVER o AS original_cost_micros,
max(CASE WHEN label = 'original' THEN kept END) OVER o AS original_kept FROM cells WINDOW o AS (PARTITION BY job_id, seq)) SELECT * FROM w WHERE label <> 'original'""",
        "cells",
    )
)
def jobs_export_rows(spark: SparkSession, d: str) -> DataFrame:
    return J.with_original(table(spark, d, "cells")).drop("event_id")


_ITEMS = """SELECT event_id, user_id % 20 AS job_id, CAST(row_number() OVER (PARTITION BY user_id % 20 ORDER BY event_id) AS bigint) AS seq, CASE WHEN event_id % 3 = 0 THEN 'done' END AS result,
 CASE WHEN event_id % 4 = 0 THEN 1000 - event_id % 400 END AS claimed_at, concat('w', CAST(event_id % 6 AS string)) AS worker, event_id % 50 AS spend FROM {events}"""


def _items(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(_ITEMS, events=spark.read.parquet(f"{d}/events.parquet"))


_RATE = "j.kept || '/' || j.\"of\" || ' vs original ' || j.item % 5 || '/4)'"


@query(
    oracle(
        f"""WITH {_CAND}, v AS (SELECT item, cand, CASE WHEN item % 17 = 0 THEN 'unverified' ELSE verdict END AS verdict FROM judged),
dr AS (SELECT r.item, r.cand, r.reason, count(*) AS n, min(r.run) AS first FROM runs_of r JOIN v j ON j.item = r.item AND j.cand = r.cand WHERE r.reason <> '' AND r.kept = (j.verdict = 'within') GROUP BY ALL),
jr AS (SELECT item, cand, arg_min(reason, (-n, first)) AS judge_reason FROM dr GROUP BY ALL),
av AS (SELECT item, cand, CAST(round_even(avg(nullif(latency_ms, 0)), 0) AS BIGINT) AS latency_ms, CAST(round_even(avg(cost_micros), 0) AS BIGINT) / 1e6 AS cost_usd FROM answers WHERE cand > 0 OR (NOT recorded AND error = '') GROUP BY ALL),
sn AS (SELECT item, cand, model, count(*) AS n, min(run) AS first FROM answers WHERE model <> '' AND error = '' GROUP BY ALL), sv AS (SELECT item, cand, arg_min(model, (-n, first)) AS served_model FROM sn GROUP BY ALL),
it AS ({_ITEMS.replace("{events}", "events")})
SELECT it.job_id, it.seq, CAST(j.cand AS INT) AS pos, j.item AS request_id, 'original-model' AS original_model, CASE WHEN j.item % 17 = 0 THEN '?' ELSE CAST(j.item % 5 AS VARCHAR) END || '/4' AS original_consistency, o.latency_ms AS original_avg_latency_ms, o.cost_usd AS original_avg_cost_usd,
  CASE WHEN j.cand = 1 THEN 'mini' ELSE 'router' END AS label, CASE WHEN j.cand = 1 THEN 'mini-a' ELSE 'router-x' END AS candidate_model, sv.served_model, v.verdict, j.kept || '/' || j."of" AS fit, round_even(j.kept / j."of", 3) AS fit_rate, a.latency_ms AS avg_latency_ms, a.cost_usd AS avg_cost_usd,
  CASE WHEN f.failed > 0 THEN f.failed || ' of ' || j."of" || ' candidate calls failed' WHEN j.item % 17 = 0 THEN 'the original''s consistency could not be read from the judge''s reply'
   WHEN (j.item % 5) / 4.0 < 0.6 - 1e-9 THEN 'the original gave different answers here (' || j.item % 5 || '/4 consistent); no stable behaviour to certify against'
   WHEN v.verdict = 'within' THEN 'stays within the original''s own range (' || {_RATE} ELSE 'less consistent than the original (' || {_RATE} END AS reason, coalesce(jr.judge_reason, '') AS judge_reason, match, acceptable, drift, unclear
FROM judged j JOIN (SELECT item, cand, CASE WHEN item % 13 = 0 THEN 1 ELSE 0 END + unclear AS failed FROM judged) f ON f.item = j.item AND f.cand = j.cand
JOIN v ON v.item = j.item AND v.cand = j.cand
JOIN it ON it.event_id = j.item LEFT JOIN av o ON o.item = j.item AND o.cand = 0 LEFT JOIN av a ON a.item = j.item AND a.cand = j.cand LEFT JOIN sv ON sv.item = j.item AND sv.cand = j.cand LEFT JOIN jr ON jr.item = j.item AND jr.cand = j.cand""",
        "votes",
        "answers",
    )
)
def jobs_export(spark: SparkSession, d: str) -> DataFrame:
    """Results of jobs as a spreadsheet has them: verdicts with their reasons, folded from votes and answers."""
    outcomes = V.run_outcomes(V.needed_votes(table(spark, d, "votes")))
    item, answers, by = F.col("item"), table(spark, d, "answers"), ["item", "cand"]
    agree = F.when(item % 17 != 0, item % 5)  # every 17th item's consistency could not be read
    failed = F.when(item % 13 == 0, 1).otherwise(0) + F.col("unclear")
    rows = V.candidates(outcomes).withColumn("failed", failed).withColumn("verdict", V.verdict(F.col("kept"), F.col("of"), F.col("failed"), agree, F.lit(4)))
    rows = rows.withColumn("reason", V.verdict_reason(F.col("verdict"), F.col("kept"), F.col("of"), F.col("failed"), agree, F.lit(4)))
    rows = rows.join(V.judge_reasons(outcomes, rows), by, "left")
    original = answers.where("cand = 0").select("item", "cand").distinct().select(*by, agree.alias("kept"), F.lit(4).cast("long").alias("of"))
    every = rows.unionByName(original, allowMissingColumns=True).join(R.cells(answers), by, "left").join(_items(spark, d).select(F.col("event_id").alias("item"), "job_id", "seq"), "item")
    named = lambda *names: F.element_at(F.array(*[F.lit(n) for n in names]), F.col("cand") + 1)
    cells = every.withColumns({"pos": F.col("cand").cast("int"), "label": named("original", "mini", "router"), "model": named("original-model", "mini-a", "router-x"), "cost_usd": F.col("cost_micros") / 1e6})
    return J.export_rows(cells.withColumnsRenamed({"of": "runs", "item": "request_id"}))


@query(oracle("SELECT job_id, label, string_agg(DISTINCT served_model, ',' ORDER BY served_model) AS models FROM cells GROUP BY ALL", "cells"))
def jobs_models(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cells").groupBy("job_id", "label").agg(F.array_join(F.array_sort(F.collect_set("served_model")), ",").alias("models"))


@query(
    "WITH i AS (" + _ITEMS.format(events="events") + "), f AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq) AS k FROM i WHERE result IS NULL AND (claimed_at IS NULL OR claimed_at < 1000 - 120)) SELECT job_id, seq, worker FROM f WHERE k <= 5"
)
def jobs_claims(spark: SparkSession, d: str) -> DataFrame:
    return J.claims(_items(spark, d), 1000).select("job_id", "seq", "worker")


@query(
    "WITH i AS (" + _ITEMS.format(events="events") + "), g AS (SELECT job_id, floor((seq - 1) / 5) AS g, sum(spend) AS s FROM i GROUP BY ALL), b AS (SELECT job_id, g, coalesce(sum(s) OVER (PARTITION BY job_id ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g) "
    "SELECT i.job_id, i.seq, CAST(before AS BIGINT) AS spent_before FROM i JOIN b ON b.job_id = i.job_id AND b.g = floor((i.seq - 1) / 5) WHERE before < 3000"
)
def jobs_within_budget(spark: SparkSession, d: str) -> DataFrame:
    return J.within_budget(_items(spark, d), 3000).select("job_id", "seq", "spent_before")


@query("WITH i AS (" + _ITEMS.format(events="events") + ") SELECT job_id, count(DISTINCT worker) AS workers, count(*) FILTER (WHERE result IS NOT NULL) AS done FROM i WHERE claimed_at >= 1000 - 120 GROUP BY job_id")
def jobs_workers(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d).where("claimed_at >= 1000 - 120").groupBy("job_id").agg(F.count_distinct("worker").alias("workers"), F.count_if(F.col("result").isNotNull()).alias("done"))


@query("SELECT user_id AS job_id, arg_max(event_type, event_id) AS status, max(event_id) AS seq FROM events GROUP BY user_id")
def jobs_last_status(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    return J.last_status(e.select(F.col("user_id").alias("job_id"), F.col("event_type").alias("status"), F.col("event_id").alias("seq")))


@query(oracle("WITH i AS (" + _ITEMS.replace("{events}", "events") + ") SELECT job_id, seq FROM i WHERE result IS NOT NULL AND NOT EXISTS (SELECT 1 FROM cells c WHERE c.job_id = i.job_id AND c.seq = i.seq AND c.kept > 2)", "cells"))
def jobs_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Finished requests without a cell of the wanted kind."""
    return _items(spark, d).where("result IS NOT NULL").join(table(spark, d, "cells").where("kept > 2"), ["job_id", "seq"], "left_anti").select("job_id", "seq")


@query(
    oracle(
        f"""WITH {_SUMMARY}, c AS (SELECT *, within / requests AS rate FROM s WHERE label <> 'original')
SELECT job_id, arg_min(label, (-rate, avg_cost_micros, label)) AS best, concat(arg_min(label, (-rate, avg_cost_micros, label)), ' of ', count(*), ' candidates') AS said FROM c GROUP BY job_id""",
        "cells",
    )
)
def jobs_conclusion(spark: SparkSession, d: str) -> DataFrame:
    s = J.summary(table(spark, d, "cells")).where("label <> 'original'")
    best = F.min_by("label", F.struct((-F.col("within") / F.col("requests")).alias("r"), "avg_cost_micros", "label"))
    g = s.groupBy("job_id").agg(best.alias("best"), F.count(F.lit(1)).alias("n"))
    return g.select("job_id", "best", F.format_string("%s of %d candidates", "best", "n").alias("said"))


@query("WITH i AS (" + _ITEMS.format(events="events") + ") SELECT job_id, concat_ws('-', CAST(count(*) FILTER (WHERE result IS NOT NULL) AS string), CAST(count(DISTINCT worker) AS string), CAST(coalesce(max(claimed_at), 0) AS string)) AS etag FROM i GROUP BY job_id")
def jobs_etag(spark: SparkSession, d: str) -> DataFrame:
    g = _items(spark, d).groupBy("job_id")
    parts = [F.count_if(F.col("result").isNotNull()), F.count_distinct("worker"), F.coalesce(F.max("claimed_at"), F.lit(0))]
    return g.agg(F.concat_ws("-", *[p.cast("string") for p in parts]).alias("etag"))


@query(
    """WITH l AS (SELECT doc_id, quality, toxic, doc_id % 4 AS kind FROM labels)
SELECT kind, quality AS expected, count(*) AS total, count(*) FILTER (WHERE quality = 1 - toxic) AS agree, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS false_pass FROM l GROUP BY ALL"""
)
def judges_accuracy(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/labels.parquet")
    return rows.groupBy((F.col("doc_id") % 4).alias("kind"), F.col("quality").alias("expected")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("quality") == 1 - F.col("toxic")).alias("agree"), F.count_if((F.col("quality") == 1) & (F.col("toxic") == 1)).alias("false_pass")
    )


@query(oracle("SELECT job_id, seq, label, row_number() OVER (PARTITION BY job_id, served_model ORDER BY seq, label) = 1 AS warm FROM cells", "cells"))
def jobs_warm_first(spark: SparkSession, d: str) -> DataFrame:
    """The first call of each prompt prefix, which warms the provider's cache for the rest."""
    w = Window.partitionBy("job_id", "served_model").orderBy("seq", "label")
    return table(spark, d, "cells").select("job_id", "seq", "label", (F.row_number().over(w) == 1).alias("warm"))
