"""Recorded traces of one agent in JSON files, and a flat graph of sources that log no run tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_recorded(spark: SparkSession, path: str, project: str) -> DataFrame:
    """Traces (variants) of the files whose name, else whose ``agent``, is ``project``, with their call-site ``node``.
    Of several files that fit equally, the first by name."""
    files = spark.read.schema("agent string, traces array<variant>").option("multiLine", True).json(path)
    name = F.regexp_replace(F.substring_index(F.input_file_name(), "/", -1), r"\.json$", "")
    fitting = files.withColumn("file_", name).where((F.col("file_") == project) | (F.col("agent") == project))
    one = fitting.orderBy(F.col("file_") != project, "file_").limit(1)
    rows = one.select("agent", F.posexplode("traces").alias("place", "trace"))
    return rows.withColumn("node", call_site(F.try_variant_get("trace", "$.node_id", "string")))


def call_site(node_id: Column) -> Column:
    return F.coalesce(F.when(node_id != "", node_id), F.lit("llm"))


def recorded_agents(spark: SparkSession, path: str) -> DataFrame:
    """agent and runs of each file."""
    files = spark.read.schema("agent string, traces array<variant>").option("multiLine", True).json(path)
    name = F.regexp_replace(F.substring_index(F.input_file_name(), "/", -1), r"\.json$", "")
    return files.select(F.coalesce("agent", name).alias("agent"), F.coalesce(F.size("traces"), F.lit(0)).alias("runs"))


def flat_runs(traces: DataFrame) -> DataFrame:
    """Traces (trace_id, node_id) as llm runs without parents: a graph of call-sites alone."""
    node = call_site(F.col("node_id"))
    hint = F.when(F.col("node_id") != "", F.col("node_id"))
    return traces.withColumns({"run_id": F.col("trace_id"), "parent_id": F.lit(None).cast(traces.schema["trace_id"].dataType), "run_type": F.lit("llm"), "name": node, "node_hint": hint, "ord": F.lit(1).cast("long")})
