"""Shared storage for intermediate tables, and how many partitions to use.

Intermediate tables are written under ``spark.checkpoint.dir`` (a folder that all executors see), so a lost executor
costs only the tasks that it ran.  A temporary folder is used only where a local session names none, as in tests.  Tables
stay until the folder is cleared, but for those of rounds, which go when the next round is written.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting by which the shuffle files of a query go when it ends.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; one of our own where it is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage and survives lost executors."""
    return written_at(df, new_path(df.sparkSession, name))


def written_at(df: DataFrame, path: str) -> DataFrame:
    """The table's own shuffles are not needed again, so their files go at once: else they lie on the disks of executors until
    the driver happens to collect its garbage, those of all steps at worst."""
    conf = df.sparkSession.conf
    before = conf.get(SHUFFLES_GO, "false")
    conf.set(SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(SHUFFLES_GO, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def batch_rows(spark: SparkSession, rows: int) -> None:
    """From now on so many rows in an Arrow batch.  A batch of whole documents is held several times over by the executor
    and its Python worker; operators that work on each document by itself need no more than a thousand at once, those
    that count or pack within a batch want the most."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


#: Rows of a batch for work on single documents, and for work across a batch.
FEW_ROWS, MANY_ROWS = 1_000, 10_000


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def without_nulls(df: DataFrame, key: str) -> DataFrame:
    """Rows that have a key: a row without one cannot be named in a result."""
    return df.where(df[key].isNotNull())
