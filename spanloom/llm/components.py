"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.store import new_path, remove, written_at


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links (a, b), a > b.  Large: each node's larger neighbours go to its smallest one.  Small: the smaller ones."""
    around = _both(edges) if large else edges
    least = around.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = around.join(least, "a")
    if large:
        return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a > b").distinct()


def components(links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """From links (a, b): node and component (its smallest node) of every node that has a link to another one.

    Each round is a few aggregations by node, written to shared storage; the number of rounds grows with the logarithm
    of the longest path.
    """
    pair = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    spark = links.sparkSession
    path = new_path(spark, "links")
    edges = written_at(links.where("a <> b").select(*pair).distinct(), path)
    before = None
    for _ in range(most_rounds):
        last, path = path, new_path(spark, "links")
        edges = written_at(_star(_star(edges, True), False), path)
        remove(spark, last)
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"links still change after {most_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
