"""Run trees to an execution graph: call-sites, their statistics, structural nodes, totals and flow edges.

A run is a row with trace_id, run_id, parent_id, ord (its place in the trace), run_type, name and node_hint.  Keys of
every exchange are the trace, the run or the call-site; what is gathered of a trace is bounded (see ``upward``).
Traces may be of any depth.  Where a trace has a run id several times, children mean the first of these runs in order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.text import eligible, is_generic, is_json, round_even
from spanloom.operators import facts
from spanloom.sources.storage import cut

#: Traces of up to so many runs are walked in one array; larger ones by joins.
SMALL_TRACE = 1024


def _own_label() -> Column:
    named_chain = F.when((F.col("run_type") == "chain") & ~is_generic(F.col("name")), F.col("name"))
    return F.coalesce(F.when(F.col("node_hint") != "", F.col("node_hint")), named_chain)


def upward(runs: DataFrame, value: Column, joined: Callable[[Column, Column], Column], small: int = SMALL_TRACE) -> DataFrame:
    """trace_id, run_id and said: what ``value`` is for a run and its ancestors, from the run up.

    joined(nearer, further) puts two stretches of a way up together.  By pointer doubling: each run knows a stretch and
    the run above it; in a round it takes over that run's stretch and pointer, so k rounds pass 2 ** k runs and none is
    missed, however deep the trace.  Traces of up to ``small`` runs do all rounds on an array; larger ones join on
    (trace, run) in each round, so no trace need fit in a row.  In a cycle stretches repeat, which joined should allow.
    """
    own = runs.select("trace_id", "ord", "run_id", F.col("parent_id").alias("at"), value.alias("said"))
    sizes = own.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n_"))
    largest = sizes.agg(F.max("n_")).first()[0] or 0
    if largest <= small:
        return _upward_in_arrays(own, joined)
    big = sizes.where(F.col("n_") > small).select("trace_id")
    rest = own.join(big, "trace_id", "left_anti")
    return _upward_in_arrays(rest, joined).unionByName(_upward_by_joins(own.join(big, "trace_id", "left_semi"), joined, largest))


def _upward_in_arrays(own: DataFrame, joined: Callable[[Column, Column], Column]) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("ord", "run_id", "at", "said")))
    traces = own.groupBy("trace_id").agg(rows.alias("rows"))
    traces = traces.select("trace_id", "rows", F.transform("rows", lambda r: r["run_id"]).alias("ids"))
    above = F.transform("rows", lambda r: F.coalesce(F.array_position("ids", r["at"]), F.lit(0)).cast("int") - 1)
    first = F.struct(above.alias("up"), F.transform("rows", lambda r: r["said"]).alias("said"))

    def jump(s: Column, _: Column) -> Column:
        up = F.transform(s["up"], lambda u: F.when(u >= 0, F.get(s["up"], u)).otherwise(-1))
        said = F.transform(s["said"], lambda x, i: F.when(F.get(s["up"], i) >= 0, joined(x, F.get(s["said"], F.get(s["up"], i)))).otherwise(x))
        # A tree of depth h is done after log2(h) rounds; the others, which a chain would need, pass it on.
        return F.when(F.exists(s["up"], lambda u: u >= 0), F.struct(up.alias("up"), said.alias("said"))).otherwise(s)

    rounds = F.sequence(F.lit(1), F.ceil(F.log2(F.size("rows"))).cast("int") + 1)
    end = traces.select("trace_id", "ids", F.aggregate(rounds, first, jump)["said"].alias("said"))
    each = end.select("trace_id", "ids", F.posexplode(F.arrays_zip("ids", "said")).alias("at", "r"))
    return each.where(F.array_position("ids", F.col("r.ids")) == F.col("at") + 1).select("trace_id", F.col("r.ids").alias("run_id"), "r.said")


def _upward_by_joins(own: DataFrame, joined: Callable[[Column, Column], Column], largest: int) -> DataFrame:
    first = F.min_by(F.struct("at", "said"), F.struct("ord", "at", "said")).alias("f")
    state = cut(own.groupBy("trace_id", "run_id").agg(first).select("trace_id", "run_id", "f.at", "f.said"))
    for _ in range(largest.bit_length() + 1):
        if not state.where("at IS NOT NULL").limit(1).count():
            break
        ahead = state.select("trace_id", F.col("run_id").alias("at"), F.col("at").alias("next_"), F.col("said").alias("further_"), F.lit(True).alias("there_"))
        moved = state.join(ahead, ["trace_id", "at"], "left")
        said = F.when(F.col("there_"), joined(F.col("said"), F.col("further_"))).otherwise(F.col("said"))
        state = cut(moved.select("trace_id", "run_id", F.col("next_").alias("at"), said.alias("said")))
    return state.select("trace_id", "run_id", "said")


def _of_parent(runs: DataFrame, said: DataFrame, name: str) -> DataFrame:
    """``runs`` with what was said of their parents and above; null without a parent."""
    return runs.join(said.select("trace_id", F.col("run_id").alias("parent_id"), F.col("said").alias(name)), ["trace_id", "parent_id"], "left")


def resolve(runs: DataFrame, small: int = SMALL_TRACE) -> DataFrame:
    """``runs`` with node, tagged and path.

    node: the run's hint, else that of the nearest ancestor with a hint or the name of the nearest named chain, else its
    own name (then tagged is false).  path: the recorded ``graph_path`` if the run has one, else named ancestors from the
    outermost, without the node itself.
    """
    label = _own_label()
    named = F.when(label.isNotNull(), F.array(F.struct("run_id", label.alias("label")))).otherwise(F.array().cast(_NAMED.format(dict(runs.dtypes)["run_id"])))
    said = upward(runs, named, lambda near, far: F.array_distinct(F.concat(near, far)), small)
    rows = _of_parent(runs, said, "above_").withColumn("above_", F.coalesce(F.transform("above_", lambda x: x["label"]), F.array().cast("array<string>")))
    own = F.when(F.col("node_hint") != "", F.col("node_hint"))
    found = F.coalesce(own, F.get("above_", F.lit(0)))
    rows = rows.withColumn("node", F.coalesce(found, F.when(F.col("name") != "", F.col("name")), F.lit("llm"))).withColumn("tagged", found.isNotNull())
    path = F.array_join(F.reverse(F.filter("above_", lambda x: ~is_generic(x) & (x != F.col("node")))), "/")
    if "graph_path" in runs.columns:
        path = F.coalesce(F.when(F.col("graph_path") != "", _bare(F.col("graph_path"))), path)
    return rows.withColumn("path", path).select(*runs.columns, "node", "tagged", "path")


def _bare(path: Column) -> Column:
    return F.btrim(path, F.lit("/"))


def _recorded_key(runs: DataFrame, agent: str, name: Column) -> Column:
    """agent/[recorded path/]name of a run that is no call."""
    at = _recorded_path(runs)
    return F.concat_ws("/", F.lit(agent), F.when(at != "", at), name)


def _recorded_path(runs: DataFrame) -> Column:
    return F.coalesce(_bare(F.col("graph_path")), F.lit("")) if "graph_path" in runs.columns else F.lit("")


_NAMED = "array<struct<run_id:{},label:string>>"


def nearest_label(runs: DataFrame, small: int = SMALL_TRACE) -> DataFrame:
    """trace_id, run_id and label: the nearest label above a run."""
    said = upward(runs, _own_label(), F.coalesce, small)
    return _of_parent(runs, said, "label").select("trace_id", "run_id", "label")


def call_sites(resolved: DataFrame, agent: str) -> DataFrame:
    """llm runs with their call-site key: agent/[path/]node, and ~variant only where a (path, node) has several.

    A variant is after-tool where any message of the call (``tool_turn``) is a tool's, else the authored frame that its
    ``prompt`` begins with (see ``facts.frame_variants``), else initial.
    """
    calls = cut(resolved.where(F.col("run_type") == "llm"))  # read for frames, kinds, the calls and, mostly, statistics
    first = calls.where(~F.col("tool_turn")).select("node", "run_id", "trace_id", "prompt")
    frames = facts.frame_variants(first, "node", "run_id", "trace_id", "prompt").where("frame <> ''").select("run_id", "frame")
    variant = F.when(F.col("tool_turn"), "after-tool").otherwise(F.coalesce("frame", F.lit("initial")))
    calls = cut(calls.join(frames.dropDuplicates(["run_id"]), "run_id", "left").withColumn("variant_", variant).drop("frame"))
    # Added up before the shuffle, so a call-site of a third of all calls is as good as any.
    kinds = calls.groupBy("path", "node").agg((F.min("variant_") != F.max("variant_")).alias("several_"))
    calls = calls.join(kinds, ["path", "node"]).withColumn("variant", F.when(F.col("several_"), F.col("variant_")).otherwise("")).drop("several_")
    topology = F.concat_ws("/", F.lit(agent), F.when(F.col("path") != "", F.col("path")), F.col("node"))
    key = F.concat(topology, F.when(F.col("variant") != "", F.concat(F.lit("~"), F.col("variant"))).otherwise(""))
    return calls.withColumn("site", topology).withColumn("key", key).withColumn("usable", eligible(F.col("error"), F.col("output")) == "ok").drop("variant_")


def nearest_rank(rows: DataFrame, by: str, value: str, quantiles: dict[str, float]) -> DataFrame:
    """Quantiles of each group by truncated nearest rank, from how often each value occurs: no group is gathered."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("n_"))
    upto = Window.partitionBy(by).orderBy(value)
    all_ = Window.partitionBy(by)
    counted = counted.withColumn("upto_", F.sum("n_").over(upto)).withColumn("of_", F.sum("n_").over(all_))
    at = lambda q: F.least(F.col("of_") - 1, F.floor(F.col("of_") * F.lit(q)))
    return counted.groupBy(by).agg(*[F.min(F.when(F.col("upto_") > at(q), F.col(value))).cast("long").alias(name) for name, q in quantiles.items()])


def modal(rows: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """The most common value of each group (the first seen of equals), how many values there are, and all as "name xN" and as
    (name, calls); an empty name is listed as "?"."""
    name = lambda x: F.when(x["v"] == "", "?").otherwise(x["v"])
    counted = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n_"), F.min(order).alias("first_"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("n_")).alias("less"), F.col("first_"), F.col(value).alias("v"), F.col("n_").alias("n"))))
    return counted.groupBy(*by).agg(ranked.alias("all_")).select(
        *by,
        F.col("all_")[0]["v"].alias(value),
        F.size("all_").alias("n_values"),
        F.array_join(F.transform("all_", lambda x: F.concat(name(x), F.lit(" x"), x["n"].cast("string"))), ", ").alias("listed"),
        F.transform("all_", lambda x: F.struct(name(x).alias("name"), x["n"].alias("calls"))).alias("named"),
    )


def node_stats(calls: DataFrame) -> DataFrame:
    """``node_figures`` with quantiles of out_tokens and the models that served each call-site."""
    rows = calls.where("usable")
    models = modal(rows.withColumn("seen_", F.struct("trace_id", "ord")), ["key"], "model_name", "seen_")
    models = models.select("key", F.col("model_name").alias("model"), F.col("listed").alias("models"), F.col("named").alias("models_list"), (F.col("n_values") > 1).alias("mixed_model"))
    ranks = nearest_rank(rows, "key", "out_tokens", {"out_p50": 0.5, "out_p95": 0.95})
    zero = F.lit(0).cast("long")
    stats = node_figures(calls).join(ranks, "key", "left").join(models, "key")
    return stats.withColumn("out_p50", F.coalesce("out_p50", zero)).withColumn("out_p95", F.coalesce("out_p95", zero))


def node_figures(calls: DataFrame) -> DataFrame:
    """Figures of each call-site over its usable calls, by one aggregation of which Spark does what is asked for; unusable calls count
    in errors_excluded alone.  seen_trace, seen_ord: the first usable call."""
    ok = F.col("usable")
    of = lambda c: F.when(ok, c)
    n = F.count_if(ok)
    stats = calls.groupBy("key").agg(
        F.min("node").alias("node"),
        F.min("path").alias("graph_path"),
        F.min("variant").alias("variant"),
        n.alias("samples"),
        F.count_distinct(of(F.col("trace_id"))).alias("traces"),
        F.count_if(~ok).alias("errors_excluded"),
        F.bround(F.avg(of(F.col("in_tokens")))).cast("long").alias("avg_in"),
        F.bround(F.avg(of(F.col("out_tokens")))).cast("long").alias("avg_out"),
        F.bround(F.avg(of(F.col("runtime_ms")))).cast("long").alias("avg_ms"),
        F.sum(of(F.col("n_tools"))).alias("tools"),
        F.count_if(ok & is_json(F.col("output"))).alias("n_json"),
        F.count_if(ok & F.col("tool_turn")).alias("n_tool_input"),
        F.min(of(F.col("day"))).alias("first_day"),
        F.max(of(F.col("day"))).alias("last_day"),
        F.min(of(F.struct("trace_id", "ord", (~F.col("tagged")).alias("untagged")))).alias("seen_"),
        (F.sum(of(F.col("cost_micros"))) / 1e6).alias("cost_ls"),
        round_even(F.avg(of(F.col("feedback_score"))), 3).alias("feedback_score"),
        F.bround(F.avg(of(F.col("ttft_ms")))).cast("long").alias("ttft_ms"),
    )
    stats = stats.where("samples > 0")  # a call-site of errors alone is no node
    stats = stats.select("*", F.col("seen_.trace_id").alias("seen_trace"), F.col("seen_.ord").alias("seen_ord"), "seen_.untagged").drop("seen_")
    per_call = lambda c, digits: round_even(F.col(c) / F.col("samples"), digits)
    stats = stats.withColumn("avg_tools", per_call("tools", 1)).withColumn("tool_input_rate", per_call("n_tool_input", 2))
    kind = F.when(F.col("n_json") * 2 > F.col("samples"), "json").when(F.col("avg_out") < 25, "short").otherwise("free-form")
    rate = round_even(F.col("errors_excluded") / (F.col("samples") + F.col("errors_excluded")), 3)
    return stats.withColumn("out_type", kind).withColumn("error_rate", rate)


def structural_nodes(runs: DataFrame, agent: str) -> DataFrame:
    """Tools and retrievers by name: calls, errors, traces and mean time."""
    rows = runs.where(F.col("run_type").isin("tool", "retriever")).withColumn("node", F.coalesce("node_hint", "name", "run_type"))
    rows = rows.where(~is_generic(F.col("node")))
    return rows.groupBy(_recorded_key(runs, agent, F.col("node")).alias("key"), F.col("run_type").alias("type")).agg(
        F.first("node").alias("node"),
        F.first(_recorded_path(runs)).alias("graph_path"),
        F.count(F.lit(1)).alias("calls"),
        F.count_if(F.col("error") != "").alias("errors"),
        F.count_distinct("trace_id").alias("traces"),
        F.bround(F.avg("runtime_ms")).cast("long").alias("avg_ms"),
    )


def function_nodes(runs: DataFrame, agent: str) -> DataFrame:
    """Named chains whose node has no llm, tool or retriever run, with the first answer that is not empty."""
    chains = runs.where((F.col("run_type") == "chain") & (F.coalesce("node_hint", F.lit("")) != "") & ~is_generic(F.col("node_hint")))
    busy = runs.where(F.col("run_type").isin("llm", "tool", "retriever")).select("node_hint").distinct()
    rows = chains.join(busy, "node_hint", "left_anti")
    sample = F.min_by(F.when(F.col("output") != "", F.col("output")), F.when(F.col("output") != "", F.struct("trace_id", "ord")))
    return rows.groupBy(F.concat(F.lit(agent + "/"), F.col("node_hint")).alias("key")).agg(F.count(F.lit(1)).alias("calls"), F.count_distinct("trace_id").alias("traces"), sample.alias("out_sample"))


def flow_edges(resolved: DataFrame, agent: str) -> DataFrame:
    """Pairs of neighbouring nodes inside traces, repeats of one node collapsed, counted; A to B to A is kept.  The most
    frequent first, of equals the one seen first."""
    name = F.coalesce("node_hint", "name")
    own = F.when(~is_generic(name), _recorded_key(resolved, agent, name))
    llm = F.when(eligible(F.col("error"), F.col("output")) == "ok", F.concat_ws("/", F.lit(agent), F.when(F.col("path") != "", F.col("path")), F.col("node")))
    keyed = resolved.withColumn("k_", F.when(F.col("run_type") == "llm", llm).otherwise(own)).where("k_ IS NOT NULL")
    w = Window.partitionBy("trace_id").orderBy("ord", "run_id")
    kept = keyed.withColumn("before_", F.lag("k_").over(w)).where("before_ IS NULL OR before_ <> k_")
    pairs = kept.withColumn("dst", F.lead("k_").over(w)).where("dst IS NOT NULL")
    counted = pairs.groupBy(F.col("k_").alias("src"), "dst").agg(F.count(F.lit(1)).alias("count"), F.min(F.struct("trace_id", "ord")).alias("seen_"))
    return counted.orderBy(F.desc("count"), "seen_").drop("seen_")


def merge_variants(stats: DataFrame, calls: DataFrame) -> DataFrame:
    """Variants of a (path, node) as one row: means weighted by samples, percentiles and kind of answers of the largest variant (the
    first seen of equals), models and tag of the one seen first, and traces counted over all of its calls.

    Means of fractions are added up from the smallest variant on, so that they don't depend on how rows are dealt; a (path, node)
    has as many variants as frames that each begin a fifth of its calls, so few are gathered."""
    weight, by = F.sum("samples"), ["graph_path", "node"]
    seen = F.struct("seen_trace", "seen_ord")
    largest = F.struct((-F.col("samples")).alias("less"), seen.alias("seen"))
    weighted = lambda c: F.sum(F.col(c) * F.col("samples"))
    products = lambda c: F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("samples", "seen_trace", "seen_ord", (F.col(c) * F.col("samples")).alias("x")))))
    in_order = lambda c: F.aggregate(products(c), F.lit(0.0), lambda total, p: total + p["x"])
    of_given = lambda c: F.sum(F.when(F.col(c).isNotNull(), F.col("samples")))
    mean = lambda c: F.bround(weighted(c) / weight).cast("long").alias(c)
    merged = stats.groupBy(*by).agg(
        weight.alias("calls"),
        *[F.min_by(c, seen).alias(c) for c in ("variant", "model", "models", "models_list", "untagged")],
        *[F.min_by(c, largest).alias(c) for c in ("out_p50", "out_p95", "out_type")],
        *[mean(c) for c in ("avg_in", "avg_out", "avg_ms")],
        F.bool_or("mixed_model").alias("mixed"),
        F.bround(F.sum("cost_ls"), 6).alias("cost_ls"),
        F.sum("errors_excluded").alias("errors_excluded"),
        round_even(in_order("avg_tools") / weight, 1).alias("avg_tools"),
        round_even(in_order("tool_input_rate") / weight, 2).alias("tool_input_rate"),
        F.bround(F.try_divide(weighted("ttft_ms"), of_given("ttft_ms"))).cast("long").alias("ttft_ms"),
        round_even(F.try_divide(in_order("feedback_score"), of_given("feedback_score")), 3).alias("feedback_score"),
        F.count(F.lit(1)).alias("variants"),
    )
    traces = calls.where("usable").groupBy(F.col("path").alias("graph_path"), "node").agg(F.first("site").alias("key"), F.count_distinct("trace_id").alias("traces"))
    return merged.join(traces, by).withColumn("error_rate", round_even(F.col("errors_excluded") / (F.col("calls") + F.col("errors_excluded")), 3))


def sub_agents(runs: DataFrame, small: int = SMALL_TRACE) -> DataFrame:
    """llm runs with ``agent``: the run right below the nearest tool above it whose name starts with "task", else the
    orchestrator."""
    task = F.coalesce((F.col("run_type") == "tool") & F.startswith("name", F.lit("task")), F.lit(False))
    # Of a stretch: whether a task is in it, the run right below that (null if outside), and the outermost run.
    own = F.struct(task.alias("found"), F.lit(None).cast("string").alias("below"), F.col("name").alias("last"))

    def joined(near: Column, far: Column) -> Column:
        below = F.when(near["found"], near["below"]).when(far["found"], F.coalesce(far["below"], near["last"]))
        return F.struct((near["found"] | far["found"]).alias("found"), below.alias("below"), far["last"].alias("last"))

    rows = _of_parent(runs.where("run_type = 'llm'"), upward(runs, own, joined, small), "above_")
    agent = F.when(F.col("above_.found"), F.coalesce("above_.below", F.lit("(task, unnamed)"))).otherwise("(orchestrator)")
    return rows.select("trace_id", "run_id", agent.alias("agent"))


def noise(runs: DataFrame) -> DataFrame:
    """One row: traces, runs, llm and chain runs, chains of middleware, and their share of all runs in whole percent."""
    chain = F.col("run_type") == "chain"
    middleware = F.count_if(chain & F.coalesce(F.contains("name", F.lit("Middleware")), F.lit(False)))
    n = F.count(F.lit(1))
    return runs.agg(F.count_distinct("trace_id").alias("traces"), n.alias("runs"), F.count_if(F.col("run_type") == "llm").alias("llm"), F.count_if(chain).alias("chains"), middleware.alias("middleware"), F.bround(middleware * 100 / F.greatest(n, F.lit(1))).cast("long").alias("noise_percent"))
