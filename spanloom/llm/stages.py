"""Operators as stages that take and give a table like ``documents``: each makes its decisions take effect.

A stage keeps all columns, whatever they are called.  Where it changes texts, ``n_chars`` follows if there is one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.llm.arrowmap import free_name
from spanloom.llm.decontaminate import find_phrases, without
from spanloom.llm.mixing import BROADCAST_SOURCES, mix, with_size
from spanloom.llm.ngram_join import set_components, with_seal
from spanloom.llm.quality_rules import fit_rules, judge
from spanloom.llm.secret_scan import scan_secrets
from spanloom.llm.sift import BROADCAST_IDS, not_listed, only_listed
from spanloom.llm.store import FEW_ROWS, batch_rows, written


def _with_text(df: DataFrame, columns: list[str], text: Column) -> DataFrame:
    new = free_name(df, "new_text")  # not "text": a later column of the same select could mean the new one by it
    made = F.col(f"`{new}`")
    length = {"n_chars": F.length(made).cast("long")} if "n_chars" in columns else {}
    return df.withColumn(new, text).select(*[{"text": made, **length}.get(c, F.col(f"`{c}`")).alias(c) for c in columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned list reject go."""
    batch_rows(spark, FEW_ROWS)
    rules = fit_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out, name = judge(docs, rules)
    return out.where(F.col(f"`{name}`.kept")).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows whose sets links connect, the one of the smallest id stays; of those with this id, the longest text (the first in
    order among equal lengths).  Each row is judged by its own set: rows that share an id and nothing else all stay, as
    do rows without an id and those without words."""
    parts = written(set_components(docs.select("doc_id", "text")), "components").where("id IS NOT NULL")
    seal, of_set, least, chars = (free_name(docs, x) for x in ("set_seal", "set_class", "set_least", "set_chars"))
    twice = written(parts.groupBy("id").count().where("count > 1").select(F.col("id").alias("gone_id")), "twice")
    goes = written(not_listed(parts.where("id <> component"), "id", twice, "gone_id").select(F.col("id").alias("gone_id")), "goes")
    left = not_listed(docs, "doc_id", goes, "gone_id")
    once = not_listed(left, "doc_id", twice, "gone_id")
    # Rows of repeated ids, few as a rule, are told apart by their sets.
    sets = only_listed(parts.where("n > 0"), "id", twice, "gone_id").select(F.col("seal").alias(seal), F.col("class").alias(of_set), F.col("component").alias(least)).distinct()
    again = with_seal(only_listed(left, "doc_id", twice, "gone_id"), "text", seal)
    bare = again.where(F.col(seal) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    first = again.where(F.col(seal) != 0).join(sets, seal).where(F.col(least) == F.col("doc_id"))
    best = F.max(F.struct(F.length("text").alias(chars), F.xxhash64("text").alias(seal), row)).alias("best")
    return once.unionByName(bare).unionByName(first.groupBy("doc_id", of_set).agg(best).select("best.row.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of benchmark phrases are cut from texts; a document of which no word is left goes."""
    batch_rows(spark, FEW_ROWS)
    out, name = find_phrases(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    out = out.where(~((F.col(f"`{name}`.n_hit") > 0) & (F.col(f"`{name}`.n_hit") == F.col(f"`{name}`.n_words"))))
    return _with_text(out, docs.columns, without(F.col("text"), F.col(f"`{name}`.spans")))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in texts; a null text stays null."""
    batch_rows(spark, FEW_ROWS)
    name = free_name(docs, "secrets")
    out = scan_secrets(docs, name, mask="[secret]")
    return _with_text(out, docs.columns, F.when(F.col("text").isNotNull(), F.col(f"`{name}`.masked")))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: each document as often as it is taken (column ``copy`` counts from 1), with all its columns and its
    size, source_size, target and taken.  Documents that are not taken go.  A new column whose name is used already gets
    underscores before it.

    Texts take no part in the sampling: it is of ids, sources and sizes, and its outcome is joined to the documents.  Rows
    that are alike in all three share its outcomes in the order of a hash of their texts."""
    batch_rows(spark, FEW_ROWS)
    key = [F.col("doc_id").alias("mix_id"), F.col("source").alias("mix_source")]
    sized = with_size(docs.select(*key, "text"), "text", "mix_size").select("mix_id", "mix_source", "mix_size")
    mixed = written(mix(written(sized, "sizes"), "mix_id", "mix_source", "mix_size"), "mix")
    copies = F.sort_array(F.collect_list(F.col("copies").cast("byte")), asc=False).alias("mix_copies")
    alike = mixed.groupBy("mix_id", "mix_source", "mix_size").agg(copies)
    alike = F.broadcast(alike) if mixed.count() <= BROADCAST_IDS else alike
    goals = written(mixed.groupBy(F.col("mix_source").alias("of_source")).agg(F.first("source_size").alias("mix_total"), F.first("target").alias("mix_target")), "goals")
    goals = F.broadcast(goals) if goals.count() <= BROADCAST_SOURCES else goals
    size, at = free_name(docs, "size"), free_name(docs, "mix_place")
    rows = with_size(docs, "text", size)
    met = F.col("doc_id").eqNullSafe(F.col("mix_id")) & F.col("source").eqNullSafe(F.col("mix_source")) & (F.col(f"`{size}`") == F.col("mix_size"))
    rows = rows.join(alike, met).drop("mix_id", "mix_source", "mix_size")
    single = rows.where(F.size("mix_copies") == 1).withColumn(at, F.lit(1))
    order = Window.partitionBy("doc_id", "source", size).orderBy(F.xxhash64("text"))
    rows = single.unionByName(rows.where(F.size("mix_copies") > 1).withColumn(at, F.row_number().over(order)))
    own = F.get("mix_copies", F.col(at) - 1).cast("long")
    rows = rows.where(own > 0).join(goals, F.col("source").eqNullSafe(F.col("of_source")))
    new = {size: F.col(f"`{size}`"), "source_size": F.col("mix_total"), "target": F.col("mix_target"), "taken": own * F.col(f"`{size}`")}
    number = F.explode(F.sequence(F.lit(1).cast("long"), own)).alias(free_name(docs, "copy"))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], *[x.alias(name if name == size else free_name(docs, name)) for name, x in new.items()], number)
