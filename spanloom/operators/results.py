"""Results of a validation: runs of the original and of candidates to spend, averages and cells.

Runs are rows (item, cand, run, model, latency_ms, cost_micros, error, recorded); cand 0 is the original, whose recorded
run cost nothing anew.  Money is in millionths of a dollar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.messages import let


def spend(runs: DataFrame, votes: DataFrame) -> DataFrame:
    """item and what its fresh runs and its judges (item, cost_micros) cost."""
    fresh = runs.where("NOT recorded").select("item", "cost_micros").unionByName(votes.select("item", "cost_micros"))
    return fresh.groupBy("item").agg(F.sum(F.coalesce("cost_micros", F.lit(0))).alias("spend_micros"))


def unpriced(runs: DataFrame) -> DataFrame:
    """item and how many of its fresh runs succeeded without a price."""
    return runs.groupBy("item").agg(F.count_if(~F.col("recorded") & F.col("cost_micros").isNull() & (F.col("error") == "")).alias("unpriced"))


def _averages(runs: DataFrame) -> DataFrame:
    timed = F.when(F.col("latency_ms") != 0, F.col("latency_ms"))
    return runs.groupBy("item", "cand").agg(F.bround(F.avg(timed)).cast("long").alias("latency_ms"), F.bround(F.avg("cost_micros")).cast("long").alias("cost_micros"))


def original_averages(runs: DataFrame) -> DataFrame:
    """item, latency_ms and cost_micros of the original's fresh runs without an error."""
    return _averages(runs.where("cand = 0 AND NOT recorded AND error = ''")).drop("cand")


def cells(runs: DataFrame) -> DataFrame:
    """A row for each item and label: the original by its fresh runs, candidates by all of theirs, with the model that
    served most of a candidate's runs (the first seen of equals)."""
    items = runs.where("cand = 0").select("item").distinct()
    original = items.join(original_averages(runs), "item", "left").select("item", F.lit(0).alias("cand"), "latency_ms", "cost_micros", F.lit(None).cast("string").alias("served_model"))
    others = runs.where("cand > 0")
    counted = others.where("model <> '' AND error = ''").groupBy("item", "cand", "model").agg(F.count(F.lit(1)).alias("n"), F.min("run").alias("first"))
    served = counted.groupBy("item", "cand").agg(F.min_by("model", F.struct((-F.col("n")).alias("less"), "first")).alias("served_model"))
    return original.unionByName(_averages(others).join(served, ["item", "cand"], "left").select("item", "cand", "latency_ms", "cost_micros", "served_model"))


def judge_replies(replies: DataFrame, by: str, canned: list[str]) -> DataFrame:
    """Of judges' raw replies (text): all, blank ones, and those that say one of the canned phrases."""
    text = F.lower(F.coalesce("text", F.lit("")))
    known = F.exists(F.array(*[F.lit(c) for c in canned]), lambda c: F.contains(text, c))
    return replies.groupBy(by).agg(F.count(F.lit(1)).alias("replies"), F.count_if(F.trim(text) == "").alias("blank"), F.count_if(known).alias("canned"))


def confusion(votes: DataFrame, by: list[str]) -> DataFrame:
    """Of judged cases (expected, yes, no, unsure votes) by kind: wrong, unclear and split ones."""
    decided = F.col("yes") + F.col("no")
    unclear = decided * 2 <= decided + F.col("unsure")
    said = F.col("yes") * 2 > decided
    return votes.groupBy(*by).agg(F.count(F.lit(1)).alias("cases"), F.count_if(~unclear & (said != F.col("expected"))).alias("wrong"), F.count_if(unclear).alias("unclear"), F.count_if((F.col("yes") > 0) & (F.col("no") > 0)).alias("split"))


def uncached(calls: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Calls whose answer is not in the cache, each once."""
    return calls.dropDuplicates([key]).join(cache.select(key).distinct(), key, "left_anti")


def unknown(selected: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Keys that were selected but that nothing is known of, each once."""
    return selected.select(key).distinct().join(known, key, "left_anti")


def found(cells: DataFrame, by: str, text: str, label: str | None = None, verdict: str | None = None) -> DataFrame:
    """Results (by) whose id has ``text`` literally, in either case, and of which one and the same cell has label and verdict."""
    rows = cells.where(F.contains(F.lower(F.col(by).cast("string")), F.lower(F.lit(text))))
    rows = rows.where(F.col("label") == label) if label else rows
    return (rows.where(F.col("verdict") == verdict) if verdict else rows).select(by).distinct()


def documents(cells: DataFrame, answers: DataFrame, votes: DataFrame, page_items: int = 100) -> DataFrame:
    """Pages of a job's results as JSON: (job_id, page from 1, document).  A document has its requests in order, a request the
    original's answers and its candidates in order, a candidate its answers, an answer its judges' votes.

    cells: event_id, job_id, seq, label, pos (0: the original), kept, runs, verdict; answers: item, cand, run, model,
    latency_ms, cost_micros, error, recorded; votes: item, cand, run, vote, kept, reason.  Each table is dealt once, by item, and the three
    meet on the item alone, so they are not dealt again for inner keys; what is gathered of an item is what its request has.  Requests
    go to their page as text; a page bounds what is gathered there.  Null fields are written as null.
    """
    listed = lambda *c: F.array_sort(F.collect_list(F.struct(*c)))
    as_json = lambda x: F.to_json(x, {"ignoreNullFields": "false"})
    dealt = lambda rows, *keys: rows.dropna(subset=list(keys)).repartition("item")  # noqa: E731  (a row without its keys belongs to nothing)
    vote, answer, side = ["vote", "kept", "reason"], ["run", "model", "latency_ms", "cost_micros", "error", "recorded"], ["cand", "label", "verdict", "kept", "of"]
    judged = dealt(votes, "item", "cand", "run").groupBy("item").agg(listed("cand", "run", *vote).alias("judges_"))
    told = dealt(answers, "item", "cand").groupBy("item").agg(listed("cand", *answer).alias("told_"))
    sides = cells.select(F.col("event_id").alias("item"), F.col("pos").alias("cand"), "job_id", "seq", "label", "verdict", "kept", F.col("runs").alias("of")).repartition("item")
    sides = sides.groupBy("item").agg(F.first("job_id").alias("job_id"), F.first("seq").alias("seq"), listed(*side).alias("sides_"))
    rows = sides.join(told, "item", "left").join(judged, "item", "left")
    none = judged.schema["judges_"].dataType
    judges = F.coalesce("judges_", F.array().cast(none))

    def with_judges(a: Column) -> Column:
        own = F.transform(F.filter(judges, lambda v: (v["cand"] == a["cand"]) & (v["run"] == a["run"])), lambda v: F.struct(*[v[c].alias(c) for c in vote]))
        return F.struct(*[a[c].alias(c) for c in answer], own.alias("judges"))

    def answers_of(cand: Column) -> Column:
        own = F.transform(F.filter("told_", lambda a: a["cand"] == cand), with_judges)
        return let(own, lambda x: F.when(F.size(x) > 0, x))

    own = F.array_max(F.transform(F.filter("sides_", lambda s: s["cand"] == 0), lambda s: F.struct(s["kept"].alias("kept"), s["of"].alias("of"), answers_of(s["cand"]).alias("answers"))))
    others = F.transform(F.filter("sides_", lambda s: s["cand"] > 0), lambda s: F.struct(*[s[c].alias(c) for c in side], answers_of(s["cand"]).alias("answers")))
    page = (F.floor((F.col("seq") - 1) / page_items) + 1).cast("long").alias("page")
    requests = rows.select("job_id", page, "seq", "item", as_json(F.struct("seq", "item", own.alias("reference"), others.alias("candidates"))).alias("text_"))
    pages = requests.groupBy("job_id", "page").agg(listed("seq", "item", "text_").alias("results_"))
    key = as_json(F.struct("job_id", "page"))
    results = F.concat(F.lit(',"results":['), F.array_join(F.transform("results_", lambda r: r["text_"]), ","), F.lit("]}"))
    return pages.select("job_id", "page", F.concat(F.substring(key, F.lit(1), F.length(key) - 1), results).alias("document"))
