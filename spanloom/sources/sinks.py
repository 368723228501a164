"""Exports of a job, and a key-value store and snapshots as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(rows: DataFrame, path: str) -> None:
    """A row for each request and candidate, with the original's figures beside it; one header a file."""
    rows.write.option("header", True).option("escape", '"').csv(path)


def job_json(summary: DataFrame, routing: DataFrame) -> DataFrame:
    """A document for each job: its labels and, where several models answered, its routing."""
    labels = summary.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("pos", "label", "requests", "within", "outside", "unverified"))).alias("summary"))
    routes = routing.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("label", "served_model", "requests"))).alias("routing"))
    both = labels.join(routes, "job_id", "left")
    return both.select("job_id", F.to_json(F.struct("job_id", "summary", "routing")).alias("document"))


def put(rows: DataFrame, path: str) -> None:
    """Append writes (key, value, created_at, seq) to a store."""
    rows.select("key", "value", "created_at", "seq").write.mode("append").parquet(path)


def state(spark: SparkSession, path: str) -> DataFrame:
    """What a store holds: the last write of each key; a null value removes it."""
    last = spark.read.parquet(path).groupBy("key").agg(F.max_by(F.struct("value", "created_at"), F.struct("created_at", "seq")).alias("w"))
    return last.select("key", "w.value", "w.created_at").where("value IS NOT NULL")


#: Whose data a snapshot is: columns beside its own.
OWNER = ["owner_source", "owner_workspace", "owner_project"]


def pin(rows: DataFrame, path: str, snapshot: str, owner: tuple[str, str, str] = ("", "", "")) -> None:
    """Keep a snapshot that later steps read instead of fetching again; owner: its source, workspace and project."""
    owned = rows.select("*", *[F.lit(x).alias(c) for c, x in zip(OWNER, owner, strict=True)], F.lit(snapshot).alias("snapshot"))
    owned.write.mode("append").partitionBy("snapshot").parquet(path)


def pinned(spark: SparkSession, path: str, snapshot: str, owner: tuple[str, str, str] | None = None) -> DataFrame:
    """A snapshot's rows; with an owner, none where it is another's, as an id alone gives no right to it."""
    rows = spark.read.parquet(path).where(F.col("snapshot") == snapshot)
    for column, value in zip(OWNER, owner or (), strict=False):
        rows = rows.where(F.col(column) == value)
    return rows.drop("snapshot", *OWNER)
