"""Facts about the answers and prompts of a call-site."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.text import masked, omitted, out_shape
from spanloom.sources.storage import cut


def common_lines(rows: DataFrame, by: str, row: str, text: str, form: Callable[[Column], Column] = lambda t: t) -> DataFrame:
    """The lines that all rows of each group have, ``form`` of the text taken: (by, n_, common_), written.

    Such a line is in the group's shortest text too, so only that text's lines are counted in the others.  Texts stay where they
    lie: what is shuffled are the counts.  The tables that meet the texts have a row for each group and are written, so that Spark
    knows their size and broadcasts them if they are small.
    """
    rows = rows.select(F.col(by).alias("g_"), F.col(row).alias("r_"), F.coalesce(F.col(text), F.lit("")).alias("t_"))
    lines = F.array_distinct(F.split(form(F.col("t_")), "\n"))
    same = lambda *names: reduce(and_, [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in names])
    sizes = cut(rows.groupBy("g_").agg(F.count(F.lit(1)).alias("n_"), F.min_by("r_", F.length("t_")).alias("r_")))
    shortest = rows.alias("x").join(sizes.alias("y"), same("g_", "r_")).select("y.g_", "n_", lines.alias("can_"))
    can = cut(shortest.dropDuplicates(["g_"]))
    met = rows.alias("x").join(can.alias("y"), same("g_")).select("y.g_", "n_", F.explode(F.array_intersect("can_", lines)).alias("l_"))
    all_have = met.groupBy("g_", "n_", "l_").agg(F.count(F.lit(1)).alias("m_")).where("m_ = n_")
    common = all_have.groupBy("g_").agg(F.collect_list("l_").alias("common_"))  # at most the shortest text
    none = F.array().cast("array<string>")
    return cut(can.alias("x").join(common.alias("y"), same("g_"), "left").select(F.col("x.g_").alias(by), "n_", F.coalesce("common_", none).alias("common_")))


def without(lines: Column, common: Column) -> Column:
    return F.filter(lines, lambda x: ~F.array_contains(common, x))


def frame_stripped(rows: DataFrame, by: str, row: str, text: str) -> DataFrame:
    """Distinct texts of each group after masking numbers and dropping the lines that all of its rows have.

    Texts are told apart by their SHA-256, so none is shuffled.  A group without a name (null) is a group.
    """
    frames = common_lines(rows, by, row, text, masked)
    own = rows.alias("x").join(frames.alias("y"), F.col(f"x.{by}").eqNullSafe(F.col(f"y.{by}")))
    lines = F.split(masked(F.col(f"x.{text}")), "\n")
    left = F.array_join(F.when(F.col("n_") > 1, without(lines, F.col("common_"))).otherwise(lines), "\n")
    return own.select(f"y.{by}", F.sha2(left, 256).alias("t_")).groupBy(by).agg(F.count_distinct("t_").alias("distinct_output"))


def shape_mix(rows: DataFrame, by: str, text: str) -> DataFrame:
    """How many answers have each shape, and whether a second shape shows at least twice (empty ones aside)."""
    g = rows.withColumn("s_", out_shape(F.col(text))).groupBy(by)
    out = g.agg(*[F.count_if(F.col("s_") == s).alias(s) for s in ("empty", "json", "label", "prose")])
    second = F.sort_array(F.array("json", "label", "prose"), asc=False)[1]
    return out.withColumn("mixed", second >= 2)


def structure(calls: DataFrame, by: str) -> DataFrame:
    """Of calls with arrays ``roles`` and ``contents``: whether most have several turns, any has a tool's result, and most
    quote retrieved documents."""
    users = F.size(F.filter("roles", lambda r: r == "user"))
    multi = (users > 1) | F.array_contains("roles", "assistant")
    quoted = F.exists(F.zip_with("roles", "contents", lambda r, c: (r == "user") & (c.rlike(r"\[\d+\]") | F.contains(F.lower(c), F.lit("retrieved")))), lambda x: x)
    g = calls.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(multi).alias("multi"), F.bool_or(F.array_contains("roles", "tool")).alias("has_tool_result"), F.count_if(quoted).alias("quoted"))
    return g.select(by, "n", (F.col("multi") * 2 > F.col("n")).alias("multi_turn"), "has_tool_result", (F.col("quoted") * 2 > F.col("n")).alias("rag_present"))


def words_of(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != ""))


def _alike(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b))) >= 0.8


def _kept_in_rounds(left: DataFrame, by: str, rounds: int) -> DataFrame:
    """(by, o_, w_, round_): in each round the first row of each group, after which what is like it goes."""
    kept = None
    for k in range(1, rounds + 1):
        first = cut(left.groupBy(by).agg(F.min(F.struct("o_", "w_")).alias("k_")))
        one = first.select(by, "k_.o_", "k_.w_", F.lit(k).alias("round_"))
        kept = one if kept is None else kept.unionByName(one)
        if k < rounds:
            # Written each round: the next one reads it twice.
            left = cut(left.join(first, by).where((F.col("o_") > F.col("k_.o_")) & ~_alike(F.col("k_.w_"), F.col("w_"))).select(by, "o_", "w_"))
    return kept


def diverse_sample(rows: DataFrame, by: str, order: str, text: str, most: int, block: int = 64) -> DataFrame:
    """Up to ``most`` rows of each group, in order, whose word sets are less than 0.8 alike with every kept one.

    Lines that all rows of a group have are left out first.  The greedy walk is ``most`` rounds over all groups at once: each
    keeps a group's first row and drops what is alike.  It begins with the first ``block`` rows of each group, which mostly are
    enough; groups that are not full then go on with all of their other rows, so none is gathered and none is cut short.
    """
    common = common_lines(rows, by, order, text)

    def word_sets(some: DataFrame, *more: str) -> DataFrame:
        said = F.coalesce(F.col(text), F.lit(""))
        rest = words_of(F.array_join(without(F.split(said, "\n"), F.col("common_")), "\n"))
        return some.join(common, by).select(by, F.col(order).alias("o_"), F.when(F.size(rest) > 0, rest).otherwise(words_of(said)).alias("w_"), *more)

    # Only so many rows of a group leave each task: Spark limits the groups before it sorts them.
    place = F.row_number().over(Window.partitionBy(by).orderBy(order))
    heads = cut(rows.select(by, order).withColumn("k_", place).where(F.col("k_") <= block))
    kept = cut(_kept_in_rounds(cut(word_sets(rows.join(heads, [by, order], "left_semi"))), by, most))
    seen = heads.groupBy(by).agg(F.max(order).alias("last_"), F.count(F.lit(1)).alias("h_"))
    so_far = kept.groupBy(by).agg(F.count(F.lit(1)).alias("c_"), F.collect_list("w_").alias("sets_")).where(F.col("c_") < most)
    unfilled = cut(so_far.join(seen, by).join(common.select(by, "n_"), by).where("h_ < n_").drop("h_", "n_"))
    kept = kept.select(by, F.col("o_").alias(order))
    if unfilled.isEmpty():
        return kept
    others = word_sets(rows.join(unfilled, by).where(F.col(order) > F.col("last_")), "sets_")
    others = cut(others.where(~F.exists("sets_", lambda s: _alike(s, F.col("w_")))).drop("sets_"))
    later = _kept_in_rounds(others, by, most - 1).join(unfilled.select(by, "c_"), by).where(F.col("c_") + F.col("round_") <= most)
    return kept.unionByName(later.select(by, F.col("o_").alias(order)))


def frame_variants(calls: DataFrame, by: str, item: str, trace: str, text: str) -> DataFrame:
    """Authored kinds of calls at one node: (by, item, frame), where frame is '' unless at least two frames recur and meet
    inside traces.

    A frame is a beginning of six words or more that calls share, so calls of one frame are those with equal first six
    words.  It is real with two calls and a fifth of the node's; of traces with several calls, half must have two.
    """
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"(?U)\s+"), lambda w: w != "")
    rows = calls.select(by, item, trace, F.when(F.size(words) >= 6, F.slice(words, 1, 6)).alias("six_"), F.col(text).alias("t_"))
    n = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n_"))
    frames = rows.groupBy(by, "six_").agg(F.count(F.lit(1)).alias("size_"), F.min("t_").alias("t_"))
    frames = frames.withColumn("place_", F.row_number().over(Window.partitionBy(by).orderBy("t_")) - 1).join(n, by)
    real = frames.where(F.col("six_").isNotNull() & (F.col("size_") >= F.greatest(F.lit(2.0), F.col("n_") * 0.2)))
    slug = F.substring(F.regexp_replace(F.lower(F.array_join(F.slice("six_", 1, 3), "")), "[^a-z0-9]+", ""), 1, 14)
    real = real.select(by, "six_", F.when(slug != "", slug).otherwise(F.concat(F.lit("f"), F.col("place_").cast("string"))).alias("frame_"))
    per_trace = rows.join(real, [by, "six_"], "left").groupBy(by, trace).agg(F.count(F.lit(1)).alias("c_"), F.count_distinct("frame_", "six_").alias("r_"))
    met = per_trace.where("c_ >= 2").groupBy(by).agg(F.count(F.lit(1)).alias("several_"), F.count_if(F.col("r_") >= 2).alias("both_")).where(F.col("both_") * 2 >= F.col("several_"))
    two = real.groupBy(by).agg(F.count(F.lit(1)).alias("k_")).where("k_ >= 2").join(met, by, "left_semi")
    shown = real.join(two, by, "left_semi")
    return rows.join(shown, [by, "six_"], "left").select(by, item, F.coalesce("frame_", F.lit("")).alias("frame"))


def bucket_facts(calls: DataFrame, by: str, system: str, user: str) -> DataFrame:
    """How many calls each call-site has, and how many system prompts and users' texts differ, by their SHA-256."""
    seen = lambda c: F.count_distinct(F.sha2(F.coalesce(F.col(c), F.lit("")), 256))
    return calls.groupBy(by).agg(F.count(F.lit(1)).alias("n"), seen(system).alias("distinct_system"), seen(user).alias("distinct_user"))


def tools_called(calls: DataFrame, by: str, tools: str) -> DataFrame:
    """The distinct names in ``tools`` of each call-site, in order."""
    return calls.select(by, F.explode(tools).alias("t_")).distinct().groupBy(by).agg(F.array_sort(F.collect_list("t_")).alias("tools"))


def neighbours(edges: DataFrame) -> DataFrame:
    """Names of the nodes before and after each key of (src, dst): key, upstream, downstream, in order, itself left out."""
    rows = edges.where("src <> dst").select("src", "dst").distinct()
    name = lambda c: F.substring_index(F.col(c), "/", -1)
    both = rows.select(F.col("dst").alias("key"), name("src").alias("up_"), F.lit(None).cast("string").alias("down_"))
    both = both.unionByName(rows.select(F.col("src").alias("key"), F.lit(None).cast("string").alias("up_"), name("dst").alias("down_")))
    names = lambda c: F.array_sort(F.collect_set(c))
    return both.groupBy("key").agg(names("up_").alias("upstream"), names("down_").alias("downstream"))


def packs(nodes: DataFrame, structural: DataFrame, calls: DataFrame, edges: DataFrame) -> DataFrame:
    """All that is known of each node without a model's help, a row each; what a kind of node lacks is null.

    nodes: as ``graph.node_stats`` gives them; structural: key, type, node, graph_path, calls, error_rate, avg_ms; calls: the
    usable ones with key, run_id, system, user, roles, contents, tools_called and output; edges: as ``graph.flow_edges``.
    """
    none = F.array().cast("array<string>")
    own = nodes.select("key", F.lit("llm").alias("kind"), "node", "graph_path", F.col("out_type").alias("output_type"), F.col("tool_input_rate").alias("tool_rate"), "avg_tools", "untagged", "mixed_model", "error_rate")
    known = [
        bucket_facts(calls, "key", "system", "user"),
        structure(calls, "key").drop("n"),
        shape_mix(calls, "key", "output").withColumnRenamed("mixed", "mixed_shapes"),
        frame_stripped(calls.select("key", "run_id", "output"), "key", "run_id", "output"),
        tools_called(calls, "key", "tools_called"),
    ]
    for part in known:
        own = own.join(part, "key", "left")
    other = structural.select("key", F.col("type").alias("kind"), "node", "graph_path", F.col("node").alias("op"), "calls", "error_rate", "avg_ms")
    flow = neighbours(edges)
    rows = own.unionByName(other, allowMissingColumns=True).join(flow, "key", "left")
    for c in ("tools", "upstream", "downstream"):
        rows = rows.withColumn(c, F.coalesce(c, none))
    return rows


def digests(sample: DataFrame, by: str, most: int = 2000) -> DataFrame:
    """Sampled calls (by, run_id, trace_id, model_name, roles, contents, output) as an analyst reads them: long messages by head
    and tail with their length, whether a system message is the whole system text of all of the sample, and the answer's
    beginning."""
    same = Window.partitionBy(by)  # a sample is bounded
    system = F.array_join(F.transform(F.filter(F.arrays_zip("roles", "contents"), lambda m: m["roles"] == "system"), lambda m: m["contents"]), "\n")
    rows = sample.withColumn("system_", system)
    one = F.when(F.min("system_").over(same) == F.max("system_").over(same), F.col("system_"))
    rows = rows.withColumn("one_", one)
    said = F.zip_with("roles", "contents", lambda r, c: F.struct(
        r.alias("role"),
        F.length(c).alias("chars"),
        omitted(c).alias("text"),
        F.when(r == "system", F.coalesce(c == F.col("one_"), F.lit(False))).alias("identical_across_sample"),
    ))
    return rows.select(by, "run_id", "trace_id", F.col("model_name").alias("model"), said.alias("messages"), F.substring("output", 1, most).alias("output"), F.length("output").alias("output_chars"))
