"""Query op2: repeated 100-byte strings of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm.suffix_dedup import remove_repeated_bytes


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
