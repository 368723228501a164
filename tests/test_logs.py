"""Log scans, lookups, raw runs and result documents on small cases."""

import json

import pytest
from pyspark.sql import functions as F
from test_queries import SF

from spanloom.functions import logged, text
from spanloom.operators import diagnose, profile, results, votes
from spanloom.plans.queries import QUERIES
from spanloom.sources import logs


def test_scan_pushes_its_conditions(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = QUERIES["logs_scan"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = next(x for x in plan.splitlines() if "PushedFilters" in x)
    for part in ("EqualTo(o_orderpriority,1-URGENT)", "EqualTo(o_orderstatus,F)", "GreaterThanOrEqual(o_orderdate"):
        assert part in pushed
    assert "o_comment" not in pushed and plan.count("WindowGroupLimit") == 2  # thinned before the shuffle and after


def test_scan_composes_or_leaves_out_each_condition(spark):
    rows = spark.createDataFrame([(i, f"2024-01-{1 + i % 20:02d}", "llm" if i % 2 else "tool", f"p{i % 3}") for i in range(60)], "id long, day string, kind string, prompt string")
    every = [tuple(r) for r in rows.collect()]

    def want(kind=None, since=None, copies=None, limit=None):
        out, seen = [], {}
        for r in sorted(every):
            if (kind is None or r[2] == kind) and (since is None or r[1] >= since):
                seen[r[3]] = seen.get(r[3], 0) + 1
                if copies is None or seen[r[3]] <= copies:
                    out.append(r)
        return out[:limit]

    for kind in (None, "llm"):
        for since in (None, "2024-01-10"):
            for copies in (None, 2):
                for limit in (None, 5):
                    got = logs.scan(rows, "id", "prompt", equal={"kind": kind} if kind else None, time="day", since=since, copies=copies, limit=limit)
                    assert sorted(map(tuple, got.collect())) == want(kind, since, copies, limit)
    assert logs.scan(rows.limit(0), "id", "prompt", time="day", since="2024-01-01").count() == 0


BODY = ['{"messages":[1],"top_p":1,"model":"m"}', '[{"role":"user"}]', '"hi"', "{}", "not json", None, '{"messages":null,"stop":null}']
PARAMS = ['{"top_p":2,"seed":3,"stop":["x"],"max_tokens":null,"messages":9,"model":"p","other":1}', "[1]", "", None, '{"max_completion_tokens":{"b":1,"a":[null]}}']


@pytest.mark.parametrize("served", [None, "", "s"])
def test_whole_request(spark, served):
    def want(request, params, response):
        try:
            asked = json.loads(request) if request else None
        except ValueError:
            asked = None
        body = dict(asked) if isinstance(asked, dict) else {"messages": asked}
        try:
            beside = json.loads(params) if params else None
        except ValueError:
            beside = None
        if isinstance(beside, dict):
            body = {**{k: beside[k] for k in logs.BESIDE if beside.get(k) is not None}, **body}
        model = served or (json.loads(response) if response else {}).get("model")
        return {**body, "model": model} if model else body

    cases = [(i, b, p, r) for i, (b, p, r) in enumerate((b, p, r) for b in BODY for p in PARAMS for r in (None, "{}", '{"model":"r"}'))]
    rows = spark.createDataFrame([(*c, served) for c in cases], "id long, q string, p string, r string, s string")
    got = {x["id"]: json.loads(x["j"]) for x in rows.select("id", F.to_json(logs.whole_request(*[F.col(c) for c in "qprs"]), {"ignoreNullFields": "false"}).alias("j")).collect()}
    for i, b, p, r in cases:
        assert got[i] == want(b, p, r), (b, p, r)


def test_runs_have_times_and_feedback(spark, tmp_path):
    run = {"id": "1", "run_type": "llm", "start_time": "2024-01-01T00:00:00", "end_time": "2024-01-01T00:00:01.5", "first_token_time": "2024-01-01T00:00:00.25", "feedback_stats": {"good": {"avg": 0.5, "n": 2}, "other": {"avg": 1.0, "n": 3}, "none": {"n": 4}}}
    (tmp_path / "a.json").write_text(json.dumps([run, {"id": "2", "start_time": "bad"}]))
    got = {r["trace_id"]: tuple(r)[1:] for r in logs.read_runs(spark, str(tmp_path)).select(*logged.run_trace()).select("trace_id", "runtime_ms", "ttft_ms", "feedback_score", "feedback_n").collect()}
    assert got == {"1": (1500, 250, 0.75, 5), "2": (0, None, None, 0)}


def test_buckets_number_all_calls(spark):
    rows = [(n, i, "x") for n in ("a", "b", None) for i in range(0, 40_000, 7 if n == "a" else 4001)]
    got = profile.buckets(spark.createDataFrame([r for r in rows if r[0]], "node string, run_id long, o string"), "node", "run_id", ["o"])
    want = {(n, i): k + 1 for n in ("a", "b") for k, i in enumerate(sorted(r[1] for r in rows if r[0] == n))}
    assert {(r["node"], r["run_id"]): r["place"] for r in got.collect()} == want
    few = profile.buckets(spark.createDataFrame(rows[:100], "node string, run_id long, o string"), "node", "run_id", [], most=3)
    assert sorted(r["place"] for r in few.collect()) == [1, 2, 3]


def test_documents_are_pages_in_order(spark):
    cells = spark.createDataFrame([(i, 1, i, label, pos, 1, 2, None if pos == 0 else "within") for i in range(1, 8) for pos, label in enumerate(("original", "mini"))], "event_id long, job_id long, seq long, label string, pos int, kept long, runs int, verdict string")
    answers = spark.createDataFrame([(i, c, r, "m", None, 5, 'say "x"\n', c == 0) for i in range(1, 8) for c in (0, 1) for r in (1, 0) if i != 3], "item long, cand int, run int, model string, latency_ms long, cost_micros long, error string, recorded boolean")
    votes = spark.createDataFrame([(i, 1, r, v, None if v == 0 else True, f"w{v}") for i in range(1, 8) for r in (0, 1) for v in (2, 0, 1)], "item long, cand int, run int, vote int, kept boolean, reason string")
    got = {(r["job_id"], r["page"]): json.loads(r["document"]) for r in results.documents(cells, answers, votes, page_items=3).collect()}
    assert [len(got[1, p]["results"]) for p in (1, 2, 3)] == [3, 3, 1] and [x["seq"] for x in got[1, 2]["results"]] == [4, 5, 6]
    first = got[1, 1]["results"][0]
    assert first["reference"]["answers"][0]["judges"] == [] and first["reference"]["answers"][0]["recorded"] is True
    answer = first["candidates"][0]["answers"][1]
    assert answer["run"] == 1 and answer["latency_ms"] is None and answer["error"] == 'say "x"\n'
    assert answer["judges"] == [{"vote": v, "kept": None if v == 0 else True, "reason": f"w{v}"} for v in (0, 1, 2)]
    assert got[1, 1]["results"][2]["reference"]["answers"] is None  # a request that nothing answered
    assert results.documents(cells.limit(0), answers, votes).count() == 0


def test_call_site_by_a_key_with_quotes(spark):
    rows = spark.createDataFrame([('{"a\'b":"x","c\\"d":"y","plain":"z"}',)], "m string").select(F.try_parse_json("m").alias("m"))
    for key, want in (("a'b", "x"), ('c"d', "y"), ("plain", "z"), ("none", "unknown")):
        assert rows.select(logged.call_site(F.col("m"), F.lit("n"), F.lit("p"), f"metadata:{key}")[1].alias("n")).first()["n"] == want
    with pytest.raises(ValueError, match="both kinds"):
        logged.call_site(F.col("m"), F.lit("n"), F.lit("p"), "metadata:a'b\"c")


def test_reasons_of_runs_and_candidates(spark):
    """A run's reason is its outcome's first vote's, a candidate's the most common one of the runs that came out as its verdict."""
    kept = {0: [True], 1: [False, True, False], 2: [None, None, None], 3: [False, False, True], 4: [True]}
    rows = [(1, 1, run, v, k, f"{'yes' if k else 'no' if k is False else 'open'}{v if run != 3 else 0}") for run, votes_ in kept.items() for v, k in enumerate(votes_)]
    outcomes = votes.run_outcomes(spark.createDataFrame(rows, "item long, cand int, run int, vote int, kept boolean, reason string"))
    assert {r["run"]: (r["kept"], r["reason"]) for r in outcomes.collect()} == {0: (True, "yes0"), 1: (False, "no0"), 2: (False, "open0"), 3: (False, "no0"), 4: (True, "yes0")}
    for verdict, want in (("within", "yes0"), ("outside", "no0"), ("unverified", "no0")):
        told = spark.createDataFrame([(1, 1, verdict)], "item long, cand int, verdict string")
        assert votes.judge_reasons(outcomes, told).first()["judge_reason"] == want
    answers = spark.createDataFrame([(1, 1, 0, None), (1, 1, 10, 4), (1, 1, 21, 0), (2, 1, 0, None)], "item long, cand int, latency_ms long, cost_micros long")
    assert {r["item"]: (r["latency_ms"], r["cost_micros"]) for r in votes.averages(answers).collect()} == {1: (16, 2), 2: (None, None)}


def test_coherence_of_replies(spark):
    replies = ["CONSISTENT 3/4\nDIVERGENT 2\n2: longer", "DIVERGENT none", "divergent 4, 2, 9, 2\n2 - a\n\n 4:  b \n5: out\n4: again", "CONSISTENT 9/9", "consistent: 1 / 4\n1: " + "x" * 200, "nothing to read\n1: why", "", None]
    got = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i long, r string").select("i", text.coherence(F.col("r"), F.lit(4)).alias("c")).orderBy("i").collect()
    told = [None if r["c"] is None else (r["c"]["agree"], r["c"]["divergent"], [tuple(x) for x in r["c"]["reasons"]]) for r in got]
    assert told == [(3, [2], [(2, "longer")]), (4, [], []), (2, [2, 4], [(2, "a"), (4, "again")]), (4, [], []), (1, [], [(1, "x" * 120)]), None, None, None]


def test_version_fields_absent_stable_and_varying(spark):
    rows = [(json.dumps({"graph_id": "g", "revision_id": f"r{i % 10}"}), f"2024-01-0{1 + i % 3}T00:00:00.5") for i in range(30)] + [("no json", "2024"), (None, None)]
    got = diagnose.version_fields(spark.createDataFrame(rows, "m string, at string"), "m", "at").collect()
    by = {}
    for r in got:
        by.setdefault(r["field"], []).append(r)
    assert len(by) == 8 and len(by["revision_id"]) == 8 and by["revision_id"][0]["state"] == "VARIES → 10 values"
    assert [(r["state"], r["value"], r["n"], r["first_at"], r["last_at"]) for r in by["graph_id"]] == [("STABLE (one value)", "g", 30, "2024-01-01T00:00:00", "2024-01-03T00:00:00")]
    assert [(r["state"], r["value"], r["n"]) for r in by["assistant_id"]] == [("absent", None, 0)]


def test_only_what_is_served_is_proposed(spark):
    from spanloom import catalog as C
    from spanloom.operators import ladder

    catalog = C.catalog(spark)
    sites = spark.createDataFrame([(r["name"], r["name"], 1000, 1000, False) for r in catalog.where("callable").collect()], "key string, model string, avg_in long, avg_out long, mixed boolean")
    every = ladder.next_cheaper(sites, catalog, "2026-01-15")
    first = every.first()["target"]
    few = ladder.next_cheaper(sites, catalog, "2026-01-15", every.where(F.col("target") != first).select(F.col("target").alias("model")))
    assert every.count() > few.where(F.col("target") != first).count() - 1 and few.where(F.col("target") == first).count() == 0
    assert ladder.next_cheaper(sites, catalog, "2026-01-15", every.limit(0).select(F.col("target").alias("model"))).count() == 0
    down = ladder.downgrades(sites, catalog, C.migrations(spark), "2026-01-15", 100, every.limit(0).select(F.col("target").alias("model")))
    assert down.count() == 0 and ladder.downgrades(sites, catalog, C.migrations(spark), "2026-01-15", 100).count() > 0


def _dealt(df):
    """How often a plan deals rows by a key."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_documents_and_votes_are_dealt_once(spark):
    from spanloom.operators import results, votes
    from spanloom.plans.fixtures import table

    tables = [table(spark, "/root/testdata/sf0.001", t) for t in ("cells", "answers", "votes")]
    own = sum(_dealt(t) for t in tables)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert _dealt(results.documents(*tables)) - own == 4  # each table by item, requests by page
        assert _dealt(votes.candidates(votes.run_outcomes(votes.needed_votes(tables[2])))) == _dealt(tables[2]) + 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_votes_of_a_run_without_a_first_one_count_for_nothing(spark):
    from spanloom.operators import votes

    rows = [(1, 1, 0, 0, True, "a"), (1, 1, 0, 1, False, "b"), (1, 1, 1, 0, None, "c"), (1, 1, 1, 1, True, "d"), (1, 1, 2, 1, True, "e"), (1, None, 0, 0, False, "f"), (1, 1, 3, 0, False, "g"), (1, 1, 3, 2, True, "h")]
    spent = votes.needed_votes(spark.createDataFrame(rows, "item long, cand int, run int, vote int, kept boolean, reason string"))
    assert sorted(r["reason"] for r in spent.collect()) == ["a", "c", "d", "g", "h"] and spent.columns == ["item", "cand", "run", "vote", "kept", "reason"]
