"""Query op6: all ``documents`` mixed to weights of their sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm.mixing import mix, with_size
from spanloom.llm.store import written


def mix_documents(docs: DataFrame) -> DataFrame:
    sized = with_size(docs.select("doc_id", "source", "text"), "text", "size").select("doc_id", "source", "size")
    return mix(written(sized, "sizes")).select("doc_id", "source", "size", "source_size", "target", "taken", "chance")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
