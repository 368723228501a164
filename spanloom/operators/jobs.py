"""Reports over a validation job's cells: one row for each request and label (the original at pos 0)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VERDICTS = ["within", "outside", "unverified"]


def _verdicts() -> list[Column]:
    return [F.count_if(F.coalesce(F.col("verdict") == v, F.lit(False))).alias(v) for v in VERDICTS]


def summary(cells: DataFrame) -> DataFrame:
    """Each label of a job, with differences from the original in percent of rounded means."""
    g = cells.groupBy("job_id", "label").agg(
        F.min("pos").alias("pos"),
        F.count(F.lit(1)).alias("requests"),
        *_verdicts(),
        F.bround(F.avg(F.try_divide(F.col("kept").cast("double"), F.col("runs"))), 3).alias("avg_rate"),
        F.bround(F.avg("latency_ms")).cast("long").alias("avg_latency_ms"),
        F.bround(F.avg("cost_micros")).cast("long").alias("avg_cost_micros"),
    )
    job = Window.partitionBy("job_id")
    base = lambda c: F.max(F.when(F.col("label") == "original", F.col(c))).over(job)
    percent = lambda c: F.when(F.col("label") != "original", F.bround(F.try_divide((F.col(c) - base(c)).cast("double"), base(c)) * 100).cast("long"))
    g = g.withColumn("cost_vs_original_pct", percent("avg_cost_micros")).withColumn("latency_vs_original_pct", percent("avg_latency_ms"))
    return g.withColumn("within_rate", F.when(F.col("label") != "original", F.bround(F.col("within") / F.col("requests"), 3)))


def routing(cells: DataFrame) -> DataFrame:
    """Candidates that several models answered: how each model did."""
    g = cells.where("label <> 'original'").groupBy("job_id", "label", "served_model").agg(F.count(F.lit(1)).alias("requests"), *_verdicts())
    several = F.count(F.lit(1)).over(Window.partitionBy("job_id", "label"))
    return g.withColumn("several", several).where("several > 1").drop("several")


def matching(cells: DataFrame, show: str = "all", label: str | None = None, verdict: str | None = None) -> DataFrame:
    """Requests (job_id, seq) that a filter of results keeps: label and verdict hold on one candidate; problems have a
    candidate that is not within; split ones have candidates of different verdicts."""
    rows = cells.where("label <> 'original'")
    one = F.lit(True)
    one = one & (F.col("label") == label) if label else one
    one = one & (F.col("verdict") == verdict) if verdict else one
    g = rows.groupBy("job_id", "seq").agg(F.bool_or(one).alias("one"), F.bool_or(F.col("verdict") != "within").alias("problem"), F.count_distinct("verdict").alias("n"))
    keep = {"all": F.lit(True), "problems": F.col("problem"), "split": F.col("n") > 1}[show]
    return g.where(F.col("one") & keep).select("job_id", "seq")


def with_original(cells: DataFrame) -> DataFrame:
    """Candidate rows with the original's figures beside them, for export."""
    w = Window.partitionBy("job_id", "seq")
    carried = [F.max(F.when(F.col("label") == "original", F.col(c))).over(w).alias(f"original_{c}") for c in ("latency_ms", "cost_micros", "kept")]
    return cells.select("*", *carried).where("label <> 'original'")


#: Columns of an export, in order: the original's, then a candidate's.
EXPORT = """request_id original_model original_consistency original_avg_latency_ms original_avg_cost_usd label candidate_model served_model verdict
fit fit_rate avg_latency_ms avg_cost_usd reason judge_reason match acceptable drift unclear""".split()


def export_rows(cells: DataFrame) -> DataFrame:
    """A row for each request and candidate with the original's figures beside it, in the columns of ``EXPORT`` after job_id, seq
    and pos.

    cells: job_id, seq, pos (0: the original), request_id, label, model, served_model, verdict, kept, runs, latency_ms, cost_usd,
    reason, judge_reason and the four counts of answers.  Requests meet their original by a join, so a job's size is no matter.
    """
    share = F.concat(F.coalesce(F.col("kept").cast("string"), F.lit("?")), F.lit("/"), F.col("runs").cast("string"))
    of = {"original_model": F.col("model"), "original_consistency": share, "original_avg_latency_ms": F.bround("latency_ms").cast("long"), "original_avg_cost_usd": F.col("cost_usd")}
    original = cells.where("pos = 0").select("job_id", "seq", *[c.alias(n) for n, c in of.items()])
    own = {
        "candidate_model": F.col("model"),
        "fit": share,
        "fit_rate": F.bround(F.try_divide(F.col("kept").cast("double"), F.col("runs")), 3),
        "avg_latency_ms": F.bround("latency_ms").cast("long"),
        "avg_cost_usd": F.col("cost_usd"),
        "judge_reason": F.coalesce("judge_reason", F.lit("")),
    }
    rows = cells.where("pos > 0").withColumns(own).join(original, ["job_id", "seq"], "left")
    return rows.select("job_id", "seq", "pos", *EXPORT)


def claims(items: DataFrame, now: int, stale: int = 120, size: int = 5) -> DataFrame:
    """The next group: the first ``size`` free requests of each job (no result, and no claim younger than ``stale``)."""
    free = items.where(F.col("result").isNull() & (F.col("claimed_at").isNull() | (F.col("claimed_at") < now - stale)))
    return free.withColumn("place", F.row_number().over(Window.partitionBy("job_id").orderBy("seq"))).where(F.col("place") <= size).drop("place")


def within_budget(items: DataFrame, budget: int, size: int = 5) -> DataFrame:
    """Requests that run before a job's spend reaches its budget, which is looked at between groups of ``size``."""
    group = F.floor((F.col("seq") - 1) / size)
    spent = F.sum("spend").over(Window.partitionBy("job_id").orderBy("group_").rangeBetween(Window.unboundedPreceding, -1))
    rows = items.withColumn("group_", group.cast("long"))
    return rows.withColumn("spent_before", F.coalesce(spent, F.lit(0))).where(F.col("spent_before") < budget).drop("group_")


def last_status(events: DataFrame) -> DataFrame:
    """Each job's status: that of its last event."""
    return events.groupBy("job_id").agg(F.max_by("status", "seq").alias("status"), F.max("seq").alias("seq"))
