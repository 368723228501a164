"""The profile of an agent: what its call-sites cost, their shape in words, totals, hotspots and sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_cost(nodes: DataFrame, prices: DataFrame, basis: int, digits: int = 6) -> DataFrame:
    """Nodes (model, calls, avg_in, avg_out, cost_platform) with per_call, per_basis, total_measured and source: by the
    catalog's price, else by the platform's own figure, else unknown and null."""
    price = prices.select(F.col("name").alias("model"), "input", "output")
    rows = nodes.join(F.broadcast(price), "model", "left")
    listed = (F.col("avg_in") * F.col("input") + F.col("avg_out") * F.col("output")) / 1e6
    stated = F.when(F.col("cost_platform") > 0, F.col("cost_platform") / F.greatest(F.lit(1), F.col("calls")))
    rows = rows.withColumn("per_call", F.coalesce(listed, stated)).withColumn("source", F.when(listed.isNotNull(), "catalog").when(stated.isNotNull(), "platform").otherwise("unknown"))
    total = F.when(listed.isNotNull(), listed * F.col("calls")).otherwise(F.when(stated.isNotNull(), F.col("cost_platform")))
    return rows.withColumn("per_basis", F.bround(F.col("per_call") * basis, digits)).withColumn("total_measured", F.bround(total, digits + 3)).withColumn("per_call", F.bround("per_call", digits + 3)).drop("input", "output")


def shape(out_type: Column, avg_out: Column, avg_in: Column, tool_input_rate: Column, avg_tools: Column) -> Column:
    """What a call-site does, in up to two words, by its measures."""
    zero = F.lit(0)
    tools = F.when(F.coalesce(tool_input_rate, zero) >= 0.5, "tool-result handler").when(F.coalesce(avg_tools, zero) >= 0.5, "tool-caller")
    out = F.when(out_type == "json", "JSON out").when((out_type == "short") | (F.coalesce(avg_out, zero) < 12), "short-answer").otherwise("free-form out")
    long = F.when(F.coalesce(avg_in, zero) >= 4000, "long-context")
    return F.array_join(F.slice(F.array_compact(F.array(tools, out, long)), 1, 2), " · ")


def structural_summary(kind: Column, calls: Column, error_rate: Column, avg_ms: Column) -> Column:
    """One line about a tool, retriever or function."""
    said = F.concat(calls.cast("string"), F.when(calls == 1, " call").otherwise(" calls"))
    errors = F.when(error_rate != 0, F.concat(F.bround(error_rate * 100).cast("long").cast("string"), F.lit("% error")))
    time = F.when(avg_ms != 0, F.concat(avg_ms.cast("string"), F.lit("ms avg")))
    return F.concat(kind, F.lit(" node · "), F.concat_ws(", ", said, errors, time))


def facts_line(facts: DataFrame) -> Column:
    """The facts worth showing of a node with distinct_system, distinct_output, n, tools, multi_turn and rag_present."""
    frame = F.when(F.col("distinct_system") == 1, "frame: fixed").when(F.col("distinct_system").isNotNull(), F.concat(F.lit("frame: varies ("), F.col("distinct_system").cast("string"), F.lit(")")))
    distinct = F.when(F.col("distinct_output").isNotNull() & (F.col("n") > 0), F.concat(F.lit("distinct out: "), F.col("distinct_output").cast("string"), F.lit("/"), F.col("n").cast("string")))
    tools = F.when(F.size("tools") > 0, F.concat(F.lit("calls: "), F.array_join("tools", ", ")))
    return F.array_join(F.array_compact(F.array(frame, distinct, tools, F.when(F.col("multi_turn"), "multi-turn"), F.when(F.col("rag_present"), "RAG"))), "; ")


def flow_line(upstream: Column, downstream: Column) -> Column:
    """``a → this → b``; empty without neighbours."""
    shown = lambda names: F.when(F.size(names) > 0, F.array_join(names, ", ")).otherwise("·")
    return F.when((F.size(upstream) > 0) | (F.size(downstream) > 0), F.concat(shown(upstream), F.lit(" → this → "), shown(downstream))).otherwise("")


def header(nodes: DataFrame, structural: DataFrame, digits: int = 6) -> DataFrame:
    """One row of totals over priced call-sites and the other nodes."""
    calls, errors = F.sum("calls"), F.sum("errors_excluded")
    of_nodes = nodes.agg(
        F.count(F.lit(1)).alias("call_sites"),
        F.coalesce(calls, F.lit(0)).alias("total_calls"),
        F.coalesce(F.sum(F.col("avg_in") * F.col("calls")), F.lit(0)).alias("total_in"),
        F.coalesce(F.sum(F.col("avg_out") * F.col("calls")), F.lit(0)).alias("total_out"),
        F.bround(F.coalesce(F.sum("per_basis"), F.lit(0.0)), digits - 2).alias("total_cost_basis"),
        F.bround(F.coalesce(errors, F.lit(0)) / F.greatest(F.lit(1), calls + errors), 3).alias("error_rate"),
        F.coalesce(F.bool_or(F.col("source") == "unknown"), F.lit(False)).alias("price_incomplete"),
    )
    kinds = structural.agg(*[F.count_if(F.col("type") == k).alias(f"{k}_count") for k in ("tool", "retriever", "function")])
    return of_nodes.withColumn("one_", F.lit(1)).join(kinds.withColumn("one_", F.lit(1)), "one_").drop("one_")  # a row each


def hotspots(nodes: DataFrame, structural: DataFrame) -> DataFrame:
    """The busiest and the costliest call-site and the slowest other node: (what, node, value); the first of equals by key."""
    # Descending order of the measure and ascending of the key in one comparison: the least (-measure, key).
    busiest = nodes.agg(F.min(F.struct((-F.col("calls")).cast("double").alias("m"), "key", "node")).alias("b"))
    priced = nodes.where("per_basis IS NOT NULL").agg(F.min(F.struct((-F.col("per_basis")).alias("m"), "key", "node")).alias("b"))
    slow = structural.where("avg_ms > 0").agg(F.min(F.struct((-F.col("avg_ms")).cast("double").alias("m"), "key", "node")).alias("b"))
    parts = [t.where("b IS NOT NULL").select(F.lit(what).alias("what"), F.col("b.node").alias("node"), (-F.col("b.m")).alias("value")) for what, t in (("busiest", busiest), ("costliest", priced), ("slowest", slow))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def all_nodes(nodes: DataFrame, structural: DataFrame, functions: DataFrame) -> DataFrame:
    """Call-sites, tools and retrievers, and functions as one table; what a kind lacks is null."""
    return nodes.withColumn("type", F.lit("llm")).unionByName(structural, allowMissingColumns=True).unionByName(functions.withColumn("type", F.lit("function")), allowMissingColumns=True)


def sections(every: DataFrame) -> DataFrame:
    """graph_path, name, place and key: nodes by subgraph, the top level first, then by name; call-sites first, dear ones first."""
    path = F.coalesce("graph_path", F.lit(""))
    rows = every.select(path.alias("graph_path"), "key", "type", "per_basis")
    order = Window.partitionBy("graph_path").orderBy((F.col("type") != "llm").cast("int"), F.coalesce("per_basis", F.lit(0.0)).desc(), "key", "type")
    name = F.when(F.col("graph_path") != "", F.col("graph_path")).otherwise("top level")
    return rows.select("graph_path", name.alias("name"), F.row_number().over(order).alias("place"), "key").orderBy("graph_path", "place")


def buckets(calls: DataFrame, by: str, order: str, shown: list[str], most: int | None = None, block: int = 1 << 12) -> DataFrame:
    """The calls of each call-site in order, numbered from 1; ``most``: only the first so many of each.

    Orders are whole numbers.  A call-site's calls are numbered in blocks of ``block`` orders, each a group of its own, and start
    after those of the blocks before, so a call-site that has a third of all calls is many tasks' work."""
    rows = calls.select(by, order, *shown, F.floor(F.col(order) / block).alias("block_"))
    sizes = rows.groupBy(by, "block_").agg(F.count(F.lit(1)).alias("n_"))
    before = F.coalesce(F.sum("n_").over(Window.partitionBy(by).orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy(by, "block_").orderBy(order))
    rows = rows.withColumn("own_", own).join(sizes.select(by, "block_", before.alias("before_")), [by, "block_"])
    out = rows.select(by, order, *shown, (F.col("own_") + F.col("before_")).alias("place"))
    return out if most is None else out.where(F.col("place") <= most)


def coverage(calls: DataFrame, sample: DataFrame, by: str, item: str, system: str, user: str) -> DataFrame:
    """How much of each group a sample (by, item) covers; texts are told apart by their SHA-256."""
    own = calls.select(by, item, *[F.sha2(F.coalesce(F.col(c), F.lit("")), 256).alias(n) for c, n in ((system, "s_"), (user, "u_"))])
    every = own.groupBy(by).agg(F.count(F.lit(1)).alias("n_total"), F.count_distinct("s_").alias("distinct_system_all"), F.count_distinct("u_").alias("distinct_user_all"))
    chosen = own.join(sample.select(by, item), [by, item], "left_semi").groupBy(by).agg(F.count(F.lit(1)).alias("sampled"), F.count_distinct("s_").alias("distinct_system_in_sample"))
    return every.join(chosen, by, "left").na.fill(0, ["sampled", "distinct_system_in_sample"])


def available(models: DataFrame, served: DataFrame | None) -> DataFrame:
    """``models`` (model) with ``available``: what a gateway serves; everything where that is not known (``served`` None)."""
    if served is None:
        return models.withColumn("available", F.lit(True))
    here = served.select("model").distinct().withColumn("here_", F.lit(True))
    return models.join(F.broadcast(here), "model", "left").withColumn("available", F.coalesce("here_", F.lit(False))).drop("here_")  # as many rows as models are served


def serving_names(wanted: DataFrame, flavours: DataFrame) -> DataFrame:
    """``wanted`` (name) with serving: a wire name as it is, else the flavour picked for that model, else null (it can't be
    placed).  flavours: model, wire_name, pick."""
    wire = flavours.select(F.col("wire_name").alias("name"), F.lit(True).alias("wire_")).distinct()
    pick = flavours.select(F.col("model").alias("name"), F.col("pick").alias("pick_")).distinct()
    rows = wanted.join(wire, "name", "left").join(pick, "name", "left")
    return rows.withColumn("serving", F.when(F.col("wire_"), F.col("name")).otherwise(F.col("pick_"))).drop("wire_", "pick_")


def retained(rows: DataFrame) -> DataFrame:
    """Only a safe downgrade keeps its dollars: rows with verdict and downgrade_usd get ``kept_usd``."""
    return rows.withColumn("kept_usd", F.when(F.col("verdict") == "SAFE", F.col("downgrade_usd")).otherwise(0.0))


def selected(rows: DataFrame, keys: DataFrame, key: str, place: str) -> DataFrame:
    """The rows that were asked for, in the order of asking; unknown keys are absent, a key asked twice counts once."""
    asked = keys.groupBy(key).agg(F.min(place).alias(place))
    return rows.join(asked, key).orderBy(place)


def kpis(rows: DataFrame) -> DataFrame:
    """One row of a report: total cost, verified savings and safe call-sites."""
    safe = F.col("verdict") == "SAFE"
    return rows.agg(F.bround(F.sum("cost"), 4).alias("total_cost"), F.bround(F.coalesce(F.sum(F.when(safe, F.col("downgrade_usd"))), F.lit(0.0)), 4).alias("verified_savings"), F.count_if(safe).alias("safe"))


def first_pick(ranked: DataFrame, order: list[Column], most: int = 5) -> DataFrame:
    """What is chosen at first: of the first ``most`` rows, those that can be tested and would save something."""
    return ranked.orderBy(*order).limit(most).where("testable AND opportunity > 0")


def matching(rows: DataFrame, graph: str = "", find: str = "") -> DataFrame:
    """Rows of one graph (all without one) whose node has ``find``, in either case."""
    rows = rows.where(F.col("graph_path") == graph) if graph else rows
    return rows.where(F.contains(F.lower("node"), F.lower(F.lit(find))))
