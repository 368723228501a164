"""Streams over agent logs: daily counts with a watermark, sessions, claims on requests, and callbacks sent once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from spanloom.sources.storage import new_path
from spanloom.sources.store import Store


def daily(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Events, errors and users of each day and type; rows later than the watermark are dropped."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", lateness)
    g = timed.groupBy(F.window("at", "1 day").alias("w"), "event_type")
    return g.agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "ids")


def sessions(events: DataFrame, gap: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    """A user's sessions: events that follow each other within ``gap``."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", lateness)
    g = timed.groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.unix_timestamp("w.start").alias("first"), "n")


class Claims(StatefulProcessor):
    """One holder for each item; a timer frees a claim whose worker hasn't shown up for ``stale`` seconds.

    A row is judged in order of time.  A claim is accepted if nobody holds the item or its own worker does; beats and results are
    accepted from the holder alone; nothing is after a result.  A lapsed claim gives a row of kind ``freed`` at the second it
    lapsed: when a later row of the item shows it, else when the watermark has passed it.  A batch's rows of one item are
    sorted in memory, so it is the size of a micro-batch that bounds them.
    """

    def __init__(self, stale: int):
        self.stale = stale

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("claim", "holder string, seen long, done boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        holder, seen, done = self.state.get() if self.state.exists() else ("", 0, False)
        before = self._lapses(holder, seen, done)
        for r in sorted(rows, key=lambda r: (r["second"], r["worker"], r["kind"])):
            if holder and not done and r["second"] - seen > self.stale:
                yield Row(item=key[0], worker=holder, second=seen + self.stale, kind="freed", accepted=True)
                holder = ""
            own = holder == r["worker"]
            ok = not done and (own or (not holder and r["kind"] == "claim"))
            if ok:
                holder, seen, done = r["worker"], r["second"], r["kind"] == "done"
            yield Row(item=key[0], worker=r["worker"], second=r["second"], kind=r["kind"], accepted=ok)
        self.state.update((holder, seen, done))
        after = self._lapses(holder, seen, done)
        if before != after:
            if before is not None:
                self.handle.deleteTimer(before)
            if after is not None:
                self.handle.registerTimer(after)

    def _lapses(self, holder: str, seen: int, done: bool) -> int | None:
        """The millisecond at which a claim is free again."""
        return (seen + self.stale + 1) * 1000 if holder and not done else None

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        holder, seen, done = self.state.get()
        if holder and not done:
            self.state.update(("", seen, False))
            yield Row(item=key[0], worker=holder, second=seen + self.stale, kind="freed", accepted=True)

    def close(self) -> None:
        pass


def claims(log: DataFrame, stale: int = 120) -> DataFrame:
    """What becomes of claims on requests: a stream of (item, worker, second, kind) with kinds claim, beat and done, to the same rows
    with ``accepted``, and a row of kind ``freed`` for each claim that lapsed.  Seconds are those
    since 1970; rows behind the latest second of earlier batches are late and left out.  Needs the state store of ``drained``."""
    timed = log.withColumn("at", F.timestamp_seconds("second")).withWatermark("at", "0 seconds")
    schema = "item long, worker string, second long, kind string, accepted boolean"
    return timed.groupBy("item").transformWithState(Claims(stale), schema, "append", "eventTime")


def callbacks_once(finished: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """One callback for each job, however often it is reported finished within the watermark."""
    timed = finished.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", lateness)
    return timed.dropDuplicatesWithinWatermark(["job_id"]).select("job_id")


def drained(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over what is there and give its output as a table (for batch use and tests).  The output and the
    checkpoint lie in shared storage; rows whose window the watermark has not passed are not in it."""
    spark = stream.sparkSession
    path = new_path(spark, name)
    spark.createDataFrame([], stream.schema).write.parquet(path)  # what is read where the stream has no batch
    sink = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", new_path(spark, f"{name}-state"))
    run_out(spark, sink.outputMode("append"))
    return spark.read.schema(stream.schema).parquet(path)


def run_out(spark: SparkSession, sink: DataStreamWriter) -> None:
    """Run a stream over all that is there now.  State with timers needs RocksDB; a session's own choice comes back after."""
    key, rocks = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(key, None)
    spark.conf.set(key, rocks)
    try:
        query = sink.trigger(availableNow=True).start()
        try:
            query.awaitTermination()
        finally:
            query.stop()
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def upserted(arriving: list[DataFrame], shape: Callable[[DataFrame], DataFrame], keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Runs of a stream, one for each table that arrives, all on one checkpoint: a windowed aggregation in update mode, whose
    changed rows go to a store by key.  Windows that the watermark has not passed are in it too, and a run that is repeated
    changes nothing.  Gives the store's rows, and all that arrived."""
    spark = arriving[0].sparkSession
    inbox, state = new_path(spark, "inbox"), new_path(spark, "upserts-state")
    arriving[0].limit(0).write.parquet(inbox)  # a stream can't start on a folder that isn't there
    stream = shape(spark.readStream.schema(arriving[0].schema).parquet(inbox))
    store = Store(spark, new_path(spark, "upserts"), stream.schema, keys)
    for rows in arriving:
        rows.write.mode("append").parquet(inbox)
        run_out(spark, stream.writeStream.outputMode("update").option("checkpointLocation", state).foreachBatch(store.merge))
    return store.rows(), spark.read.schema(arriving[0].schema).parquet(inbox)

