"""Call-sites on a small log: recorded paths, tools' turns, authored frames, and merged variants."""

from itertools import permutations

import duckdb
import pytest

from spanloom.operators import graph as G
from spanloom.plans.queries import SQL

RUN = "trace_id long, run_id long, parent_id long, ord long, run_type string, name string, node_hint string, graph_path string, tool_turn boolean, prompt string, error string, output string, in_tokens long, out_tokens long, runtime_ms long, n_tools long, day string, model_name string, cost_micros long, feedback_score double, ttft_ms long"


def run(trace, i, node, path="", tool=False, prompt="short", error="", output="fine", model="m", parent=None, kind="llm", score=None, ttft=None):
    return (trace, i, parent, i, kind, node, node, path, tool, prompt, error, output, 10, 20 + i, 5, 1, f"2024-01-{i:02d}", model, 7, score, ttft)


def sites(spark, rows):
    return G.call_sites(G.resolve(spark.createDataFrame(rows, RUN)), "a")


def test_same_named_nodes_of_two_subgraphs_stay_apart(spark):
    rows = [run(1, 1, "root", kind="chain"), run(1, 2, "worker", "billing", parent=1), run(1, 3, "worker", "/billing/", parent=1), run(2, 4, "worker", "refund"), run(2, 5, "worker"), run(1, 6, "worker", parent=1)]
    got = {r["run_id"]: r["key"] for r in sites(spark, rows).collect()}
    assert got == {2: "a/billing/worker", 3: "a/billing/worker", 4: "a/refund/worker", 5: "a/worker", 6: "a/root/worker"}


def test_variants_by_tool_turns_and_frames(spark):
    plan, review = "Plan the next steps for request {}", "Review the answer below for mistakes {}"
    rows = [run(t, 10 * t + k, "n", prompt=(plan if k == 1 else review).format(t)) for t in range(1, 4) for k in (1, 2)]
    rows += [run(1, 50, "n", tool=True, prompt=plan.format(9)), run(2, 51, "n", prompt="too short"), run(1, 52, "alone", prompt=plan.format(1))]
    got = {r["run_id"]: r["variant"] for r in sites(spark, rows).collect()}
    assert got == {**{10 * t + 1: "planthenext" for t in range(1, 4)}, **{10 * t + 2: "reviewtheanswe" for t in range(1, 4)}, 50: "after-tool", 51: "initial", 52: ""}


def test_failed_calls_count_against_their_site_alone(spark):
    rows = [run(1, 1, "n"), run(1, 2, "n", error="transient"), run(2, 3, "n", error="boom", output=""), run(2, 4, "gone", error="boom", output="")]
    got = G.node_stats(sites(spark, rows)).collect()
    assert [(r["key"], r["samples"], r["traces"], r["errors_excluded"], r["error_rate"]) for r in got] == [("a/n", 2, 1, 1, 0.333)]


def test_merge_takes_each_figure_from_the_right_variant(spark):
    rows = [run(1, 1, "n", model="x", score=0.5), run(1, 2, "n", tool=True, model="y", ttft=30), run(1, 3, "n", tool=True, model="", output="{}"), run(2, 4, "n", tool=True, model="y", output="{}", ttft=10)]
    calls = sites(spark, rows)
    stats = {r["variant"]: r for r in G.node_stats(calls).collect()}
    late = stats["after-tool"]
    assert late["model"] == "y" and late["models"] == "y x2, ? x1" and [tuple(m) for m in late["models_list"]] == [("y", 2), ("?", 1)] and late["mixed_model"]
    assert (late["ttft_ms"], late["feedback_score"], late["tool_input_rate"], late["avg_tools"], late["cost_ls"]) == (20, None, 1.0, 1.0, 2.1e-05)
    (m,) = G.merge_variants(G.node_stats(calls), calls).collect()
    assert (m["key"], m["calls"], m["traces"], m["variants"]) == ("a/n", 4, 2, 2)  # traces are counted, not added up
    assert m["model"] == "x" and m["variant"] == "initial" and m["mixed"] and m["out_type"] == "json"
    assert (m["ttft_ms"], m["feedback_score"], m["tool_input_rate"]) == (20, 0.5, 0.75)


def test_merged_means_are_rounded_as_in_sql(spark):
    calls = sites(spark, [run(1, i, "n", tool=i <= 23) for i in range(1, 41)])
    for parts in (1, 7):
        (m,) = G.merge_variants(G.node_stats(calls).repartition(parts), calls).collect()
        assert (m["calls"], m["variants"], m["tool_input_rate"]) == (40, 2, 0.57)  # 0.575 * 100 is less than 57.5


def test_structural_nodes_and_edges_by_recorded_path(spark):
    rows = [run(1, 1, "search", "billing", kind="tool"), run(1, 2, "search", "", kind="tool"), run(1, 3, "worker", "billing")]
    runs = spark.createDataFrame(rows, RUN)
    assert {(r["key"], r["graph_path"]) for r in G.structural_nodes(runs, "a").collect()} == {("a/billing/search", "billing"), ("a/search", "")}
    assert {(r["src"], r["dst"]) for r in G.flow_edges(G.resolve(runs), "a").collect()} == {("a/billing/search", "a/search"), ("a/search", "a/billing/worker")}


def test_noise_of_middleware(spark):
    rows = [run(1, i, "n", kind=k)[:5] + (name,) + run(1, i, "n")[6:] for i, (k, name) in enumerate([("chain", "AMiddleware.x"), ("chain", "plain"), ("llm", "Middleware"), ("chain", None)], 1)]
    assert tuple(G.noise(spark.createDataFrame(rows, RUN)).first()) == (1, 4, 1, 3, 1, 25)
    assert tuple(G.noise(spark.createDataFrame([], RUN)).first()) == (0, 0, 0, 0, 0, 0)


def test_replayed_conversations_begin_with_a_user(spark):
    from spanloom.plans.text_queries import starting_with_user

    merged = spark.createDataFrame([(1, 1, "user", "hi"), (1, 2, "assistant", "yes"), (2, 1, "assistant", "so"), (2, 2, "user", "go")], "conv_id long, island long, role string, content string")
    every = spark.createDataFrame([(1,), (2,), (3,)], "conv_id long")
    got = sorted(map(tuple, starting_with_user(merged, every).collect()))
    assert got == [(1, 1, "user", "hi"), (1, 2, "assistant", "yes"), (2, 0, "user", "(continue)"), (2, 1, "assistant", "so"), (2, 2, "user", "go"), (3, 1, "user", "(no user turn)")]


def test_figures_that_nobody_reads_are_not_computed(spark):
    calls = sites(spark, [run(1, 1, "n"), run(2, 2, "n"), run(2, 3, "gone", error="boom", output="")])
    few = G.node_figures(calls).select("key", "samples", "avg_in")
    plan, before = (t._jdf.queryExecution().optimizedPlan().toString() for t in (few, calls))
    assert plan.count("Join") <= before.count("Join") and "Expand" not in plan and "n_json" not in plan
    assert [tuple(r) for r in few.collect()] == [("a/n", 2, 10)]


@pytest.mark.parametrize("column", ["feedback_score", "avg_tools", "tool_input_rate"])
def test_merged_fractions_in_sql_do_not_depend_on_the_order_of_rows(column):
    """A mean next to a half of its last digit, from three variants in every order."""
    variants, want = {
        "feedback_score": ([(36, 0.527), (27, 0.517), (39, 0.326)], 0.447),
        "avg_tools": ([(34, 0.6), (16, 2.8), (22, 0.8)], 1.2),
        "tool_input_rate": ([(12, 0.04), (25, 1.79), (39, 1.13)], 1.17),
    }[column]
    whole = SQL["graph_merge_variants"]
    m = whole[whole.index("m AS (SELECT graph_path, node, CAST(sum(samples)") : whole.index("\nt AS (SELECT path AS graph_path")].rstrip(",")
    texts = ", ".join(f"'x' AS {c}" for c in ("graph_path", "node", "variant", "model", "models", "models_list", "out_type"))
    longs = ", ".join(f"1 AS {c}" for c in ("out_p50", "out_p95", "avg_in", "avg_out", "avg_ms", "errors_excluded", "ttft_ms"))
    rest = ", ".join(f"0.5::DOUBLE AS {c}" for c in ("cost_ls", "feedback_score", "avg_tools", "tool_input_rate") if c != column)
    con, got = duckdb.connect(), set()
    con.execute("SET threads = 1")
    for order in permutations(enumerate(variants)):
        rows = ", ".join(f"({k}, {n}, {x}::DOUBLE)" for k, (n, x) in order)
        stats = f"SELECT *, {texts}, {longs}, {rest}, false AS untagged, false AS mixed_model, 1 AS seen_ord FROM (VALUES {rows}) AS v(seen_trace, samples, {column})"
        got.add(con.execute(f"WITH full_stats AS MATERIALIZED ({stats}), {m} SELECT {column} FROM m").fetchone()[0])
    assert got == {want}
