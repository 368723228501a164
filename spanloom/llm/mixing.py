"""Mix sources to target weights: whole copies for certain, then Pareto order sampling for what is left.

Targets: sources in order of name (null last) have the weights of ``weights`` in turn and share ``share`` of all words.
No target exceeds ``max_copies`` times its source's words; what is above is shared by weight among the others until
none is above (solved at once by ordering sources by words over weight).

A document is to be taken ``e`` = min(max_copies, k * size ** size_power) times, where k is what makes the expected
words of its source equal the target: longer documents of a source are the likelier ones (``size_power`` 0: all alike).
floor(e) copies are certain, and the rest ``p`` is the document's own inclusion probability in a Pareto sample of its
source: documents are ranked by (u / (1 - u)) / (p / (1 - p)) with a uniform u, and the first ones are taken.  The
sample's size is fixed in words, by what the target leaves after the certain copies: it ends before the document that
would pass this, and later documents that still fit fill the gap, to the nearest word count.  u is a hash of the id, so
reruns agree.

k comes from a table of the sizes that occur in a source: with the j longest sizes at the limit it would be k_j, and the
largest of all k_j is the one that fits.

Running sums over a source of any size: ranks are cut into ``cuts`` ranges, words are summed for each range (on the
map side first), and only the documents of the one range where the sum passes the target are sorted.  Sources
themselves are one row each and are ordered in one task, so they may be millions, not billions.

Cases: null texts have size 0; null sources are a source of their own; rows with equal ids and equal sizes are told
apart only by their number; a null id is hashed as such; an empty table gives an empty result; sources of size 0 have
target 0; columns that are called like the results are kept, and the results then get underscores before their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.arrowmap import append_struct, free_name
from spanloom.llm.store import written
from spanloom.llm.textnp import Texts, words_of

#: Up to so many sources, their table is broadcast.
BROADCAST_SOURCES = 100_000


def n_words(texts: Texts) -> list[np.ndarray]:
    return [words_of(texts).count]


def with_size(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` and the number of words of ``text`` (null: 0) as ``name``."""
    out = append_struct(df, text, name, n_words, T.StructType([T.StructField("n", T.LongType())]))
    return out.withColumn(name, F.col(f"`{name}`.n"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), share: float = 1.0, max_copies: float = 3) -> DataFrame:
    """From source, source_size (a row for each source): also target."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    rows = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1))
    rows = rows.withColumn("most", F.col("source_size") * float(max_copies))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_ratio = Window.orderBy((F.col("most") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("most").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weight_left = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("level", (F.sum("source_size").over(everything) * share - before) / weight_left)
    # The level rises while a source's own ratio is below it, and falls from the first source on that stays under its
    # limit: the highest level is the one that all sources under their limit share.
    final = F.max("level").over(everything)
    target = F.least("most", final * F.col("weight"))
    return rows.select("source", "source_size", target.alias("target"))


def _uniform(doc_id: Column, seed: int) -> Column:
    h = F.pmod(F.xxhash64(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(seed)), F.lit(1 << 52))
    return (h.cast("double") + 0.5) / float(1 << 52)


def _fill(rows: DataFrame, eligible: Column, need: Column, took: str, nearest: bool, few: bool, cuts: int) -> DataFrame:
    """``rows`` with a boolean ``took``: eligible rows of a key in order of rank while their words stay within ``need``;
    with ``nearest`` also the next one, if that comes nearer to it."""
    rows = rows.withColumn("fits", eligible).withColumn("need", need)
    rows = rows.withColumn("place", F.least(F.floor(F.col("rank") * cuts), F.lit(cuts - 1)).cast("int"))
    by_cut = rows.where("fits").groupBy("key", "place").agg(F.sum("size").alias("words"), F.first("need").alias("need"))
    by_cut = by_cut.withColumn("upto", F.sum("words").over(Window.partitionBy("key").orderBy("place")))
    # The range where the sum passes the need is the only one whose documents are sorted.
    passing = by_cut.where("upto > need").groupBy("key").agg(F.min(F.struct("place", (F.col("upto") - F.col("words")).alias("before"))).alias("edge"))
    passing = written(passing, "edges")
    rows = rows.join(F.broadcast(passing) if few else passing, "key", "left")
    at, open_ = F.coalesce("edge.place", F.lit(cuts)), F.col("need") > 0
    border = F.col("fits") & (F.col("place") == at)
    inside = rows.where(~border).withColumn(took, F.col("fits") & (F.col("place") < at) & open_)
    order = Window.partitionBy("key").orderBy("rank", "size", "tie").rowsBetween(Window.unboundedPreceding, 0)
    gap = F.col("need") - F.col("edge.before") - F.sum("size").over(order)
    enough = (gap >= 0) | (gap + F.col("size") > -gap) if nearest else gap >= 0
    edge = rows.where(border).withColumn(took, enough & open_)
    return inside.unionByName(edge).drop("fits", "need", "place", "edge")


def expected_copies(by_size: DataFrame, max_copies: float, size_power: float) -> DataFrame:
    """key and factor: what the power of a size is multiplied by to give a document's expected copies.

    by_size: key, size, n (documents of that size) and target of the key.
    """
    weight = F.pow(F.col("size").cast("double"), F.lit(size_power))
    rows = by_size.where("size > 0").withColumn("words", (F.col("size") * F.col("n")).cast("double")).withColumn("part", weight * F.col("words"))
    longer = Window.partitionBy("key").orderBy(F.desc("size"))
    capped = F.coalesce(F.sum("words").over(longer.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_ = F.sum("part").over(longer.rowsBetween(0, Window.unboundedFollowing))
    return rows.select("key", ((F.col("target") - max_copies * capped) / open_).alias("k")).groupBy("key").agg(F.max("k").alias("factor"))


def mix(docs: DataFrame, id_col: str = "doc_id", source: str = "source", size: str = "size", weights: tuple[float, ...] = (1, 2, 3), share: float = 1.0, max_copies: int = 3, size_power: float = 0.5, seed: int = 11, cuts: int = 4096) -> DataFrame:
    """All columns of ``docs`` and source_size, target (both of the row's source), chance (its inclusion probability
    beyond certain copies), copies and taken (words, repeats counted).

    docs is read several times: pass a table that is stored.
    """
    names = {x: free_name(docs, x) for x in ("source_size", "target", "chance", "copies", "taken")}
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    by_size = docs.groupBy(F.col(f"`{source}`").alias("source"), F.col(f"`{size}`").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    by_size = written(by_size.withColumn("key", key), "source-sizes")
    sizes = by_size.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goal = written(targets(sizes, weights, share, max_copies).withColumn("key", key).drop("source"), "targets")
    few = goal.count() <= BROADCAST_SOURCES
    at_hand = lambda t: F.broadcast(t) if few else t
    by_size = by_size.select("key", "size", "n").join(at_hand(goal), "key")
    factor = written(expected_copies(by_size, max_copies, size_power), "factors")
    expected = F.least(F.lit(float(max_copies)), F.coalesce("factor", F.lit(0.0)) * F.pow(F.col("size").cast("double"), F.lit(size_power)))
    certain = F.floor(expected + 1e-9).cast("long")
    sure = by_size.join(at_hand(factor), "key", "left").groupBy("key").agg(F.sum(certain * F.col("size") * F.col("n")).alias("sure"))
    goal = goal.join(factor, "key", "left").join(sure, "key")
    goal = written(goal.select("key", "factor", F.struct("source_size", "target", F.greatest(F.lit(0.0), F.col("target") - F.col("sure")).alias("left_over")).alias("goal")), "goals")
    packed = F.struct(*[F.col(f"`{x}`") for x in docs.columns]).alias("row")  # whatever they are called
    rows = docs.select(packed, F.col(f"`{id_col}`").alias("id"), F.col(f"`{source}`").alias("source"), F.col(f"`{size}`").alias("size"))
    rows = rows.withColumn("key", key).drop("source").join(at_hand(goal), "key")
    rows = rows.withColumn("copies", certain).withColumn("chance", F.greatest(F.lit(0.0), expected - certain)).drop("factor")
    u, p = _uniform(F.col("id"), seed), F.col("chance")
    odds = (u / (1 - u)) * F.try_divide(1 - p, p)
    rows = rows.withColumn("rank", F.coalesce(odds / (1 + odds), F.lit(1.0))).withColumn("tie", F.xxhash64("id", "size")).drop("id")
    # First the sample in order of rank, up to the first document that would pass the need; then later documents that
    # still fit, so that one very long document doesn't leave a source far from its target.
    may = F.col("copies") < max_copies
    rows = written(_fill(rows, may, F.col("goal.left_over"), "first", False, few, cuts), "sampled")
    got = rows.groupBy("key").agg(F.sum(F.when(F.col("first"), F.col("size")).otherwise(0)).alias("got"))
    got = written(got, "got")
    rows = rows.join(at_hand(got), "key")
    left = F.col("goal.left_over") - F.col("got")
    rows = _fill(rows, may & ~F.col("first") & (F.col("size") <= left), left, "second", True, few, cuts)
    copies = F.col("copies") + F.col("first").cast("long") + F.col("second").cast("long")
    out = {"source_size": F.col("goal.source_size"), "target": F.col("goal.target"), "chance": F.col("chance"), "copies": copies, "taken": copies * F.col("size")}
    return rows.select("row.*", *[out[x].alias(names[x]) for x in out])
