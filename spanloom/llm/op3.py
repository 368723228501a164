"""Query op3: secrets in ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm.secret_scan import scan_secrets


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan_secrets(docs, "found").select("doc_id", "found.n_assign", "found.n_access", "found.n_hex", "found.base_sha256", "found.spans")
