"""Query op8: quality rules on ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm.quality_rules import fit_rules, judge


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rules = fit_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out, name = judge(docs, rules)
    stats = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return out.select("doc_id", *[f"{name}.{c}" for c in stats])
