"""Query op1: the language of every text of ``documents``, learned from those that are not held out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.langid import identify, train


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))
    train_part = F.pmod(F.crc32(F.col("train_id").cast("string")), F.lit(3)) != 1
    model = train(docs, where=train_part)
    out = identify(docs.select("doc_id", "text"), model, "found")
    return out.select("doc_id", held_out.alias("held_out"), F.col("found.lang").alias("lang_pred"), "found.score", "found.n_spans")
