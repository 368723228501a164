"""A corpus from raw documents: quality rules, near-duplicates, benchmark phrases, secrets, and a mix of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm import stages
from spanloom.llm.store import new_path, remove, written_at

STAGES = [
    ("quality_rules", stages.quality_rules),
    ("ngram_jaccard_join", stages.near_duplicates),
    ("benchmark_decontamination", stages.decontamination),
    ("secret_scans", stages.secrets),
    ("source_mixing", stages.mixing),
]
#: Learned rules and a tokenizer's verdicts are beyond SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each on what the one before has written, which then goes."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = new_path(spark, name)
        docs = written_at(stage(spark, docs, sf_dir), path)
        if last:
            remove(spark, last)
        last = path
    return docs
