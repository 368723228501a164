"""Queries over whole tables, against plain Python on the smallest tables."""

import re
from collections import Counter
from itertools import groupby

from spanloom.plans.fixtures import table
from spanloom.plans.queries import QUERIES
from test_queries import SF

SPACE = " \t\n\v\f\r"


def got(spark, name):
    return Counter(map(tuple, QUERIES[name](spark, SF).collect()))


def conversations(spark):
    return sorted(spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect())


def test_merged_turns(spark):
    want = Counter()
    for conv, turns in groupby(conversations(spark), key=lambda r: r.conv_id):
        said = [("assistant" if r.role == "assistant" else "user", r.text.strip(SPACE)) for r in turns if r.role != "system"]
        for k, (role, texts) in enumerate(groupby([x for x in said if x[1]], key=lambda x: x[0]), 1):
            want[conv, k, role, "\n".join(t for _, t in texts)] += 1
    assert got(spark, "text_merged_turns") == want


def test_frame_stripped(spark):
    by = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("source", "doc_id", "text").collect():
        t = re.sub("[0-9]+", "#", f"Header line\n{r.text} {r.doc_id}".strip(" \n")).lower()
        by.setdefault(r.source, []).append(t.split("\n"))
    want = Counter()
    for source, texts in by.items():
        shared = set.intersection(*map(set, texts)) if len(texts) > 1 else set()
        want[source, len({"\n".join(x for x in t if x not in shared) for t in texts})] += 1
    assert got(spark, "facts_frame_stripped") == want


def test_frame_stripped_beyond_40_characters(spark, tmp_path):
    rows = [("a", i, "x" * 50 + f"\n{word}\nlast") for i, word in enumerate(["one", "two", "one"])]
    spark.createDataFrame(rows, "source string, doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [r.distinct_output for r in QUERIES["facts_frame_stripped"](spark, str(tmp_path)).collect()] == [2]


def test_lookup_and_latest_revision(spark):
    runs = table(spark, SF, "runs").collect()
    ids = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    assert got(spark, "logs_lookup") == Counter((r.run_id, r.output if r.output else r.error) for r in runs if r.run_id in ids)
    roots = sorted((r for r in runs if r.parent_id is None), key=lambda r: (r.day, r.run_id), reverse=True)
    want = [(r.run_id, r.revision) for r in roots if r.revision == roots[0].revision][:100]
    assert want and [tuple(r) for r in QUERIES["logs_latest_revision"](spark, SF).collect()] == want


def test_exact_copies(spark):
    by = {}
    for r in conversations(spark):
        by.setdefault(r.conv_id, set()).add(r.text.strip(SPACE))
    want = Counter((r.conv_id, r.turn) for r in conversations(spark) if ("  " + r.text + "!" * (r.turn % 3 == 0)).strip(SPACE) in by[r.conv_id])
    assert got(spark, "votes_exact_copies") == want


def test_results_are_in_order(spark):
    edges = [r["count"] for r in QUERIES["graph_flow_edges"](spark, SF).collect()]
    usd = [r["usd"] for r in QUERIES["ladder_downgrades"](spark, SF).collect()]
    out = [r["avg_out"] for r in QUERIES["graph_node_stats"](spark, SF).collect()]
    assert all(x == sorted(x, reverse=True) and x for x in (edges, usd, out))
    costs = [r["per_basis"] for r in QUERIES["profile_costs"](spark, SF).collect()]
    assert [c is None for c in costs] == sorted(c is None for c in costs)
