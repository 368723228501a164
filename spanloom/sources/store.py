"""A key-value table of Parquet files: batches are merged by key, a batch may be repeated, and old batches are folded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folders of a store: batches as they came, what batches were folded to, and marks of folds that are complete.
BATCH, BASE, DONE = "batch", "base", "done"


class Store:
    """Rows by ``keys``: the one of the last batch counts.

    Each batch is a folder of its own, named by its number, so a repeated batch takes its own place and changes nothing.
    ``compact`` folds batches to one table; its number is marked only once it is there, and readers leave out what a marked
    fold holds, so a fold that breaks off does no harm.  Neither takes a lock: one writer at a time, any number of readers.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str]):
        self.spark, self.path, self.columns, self.keys = spark, path, schema.fieldNames(), keys
        self.schema = T.StructType([*schema.fields, T.StructField("kind", T.StringType()), T.StructField("number", T.LongType())])
        # So that there is something to read before the first batch.
        spark.createDataFrame([], schema).write.mode("ignore").parquet(self._folder(BATCH, -1))

    def _folder(self, kind: str, number: int) -> str:
        return f"{self.path}/kind={kind}/number={number}"

    def merge(self, rows: DataFrame, number: int) -> None:
        """Insert or replace rows by key.  Of rows with equal keys in one batch, the largest counts."""
        one = rows.groupBy(*self.keys).agg(F.max(F.struct(*self.columns)).alias("row")).select("row.*")
        one.select(*self.columns).write.mode("overwrite").parquet(self._folder(BATCH, number))

    def _all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).option("basePath", self.path).parquet(self.path)

    def _folded(self) -> int:
        """The last batch that a complete fold holds."""
        last = self._all().where(F.col("kind") == DONE).agg(F.max("number")).first()[0]
        return -2 if last is None else last

    def _upto(self, number: int | None) -> DataFrame:
        base = self._folded()
        rows = self._all().where(((F.col("kind") == BASE) & (F.col("number") == base)) | ((F.col("kind") == BATCH) & (F.col("number") > base)))
        rows = rows if number is None else rows.where(F.col("number") <= number)
        last = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*self.columns), "number").alias("row"))
        return last.select("row.*")

    def rows(self) -> DataFrame:
        return self._upto(None)

    def peek(self, **key: object) -> DataFrame:
        """The row of a key; the condition is pushed to the files."""
        out = self.rows()
        for name, value in key.items():
            out = out.where(F.col(name) == F.lit(value))
        return out

    def compact(self, number: int) -> None:
        """Fold all batches up to this one."""
        if number > self._folded():
            self._upto(number).write.mode("overwrite").parquet(self._folder(BASE, number))
            mark = self.spark.createDataFrame([tuple(None for _ in self.columns)], T.StructType([T.StructField(f.name, f.dataType) for f in self.schema.fields[:-2]]))
            mark.coalesce(1).write.mode("overwrite").parquet(self._folder(DONE, number))

    def clear(self, number: int) -> None:
        """Forget everything up to batch ``number``: an empty fold takes its place."""
        empty = self.spark.createDataFrame([], T.StructType(self.schema.fields[:-2]))
        empty.write.mode("overwrite").parquet(self._folder(BASE, number))
        mark = self.spark.createDataFrame([tuple(None for _ in self.columns)], T.StructType([T.StructField(f.name, f.dataType) for f in self.schema.fields[:-2]]))
        mark.coalesce(1).write.mode("overwrite").parquet(self._folder(DONE, number))
