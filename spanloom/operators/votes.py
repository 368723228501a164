"""Judges' votes to verdicts: majority with abstentions, roll-up of a candidate's runs, and the verdict rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPSILON = 1e-9


def plan_calls(items: DataFrame, reference_runs: int = 4, candidate_runs: int = 5) -> DataFrame:
    """One row for each model call of an item (id, recorded, candidates): who (-1: the original) and which run."""
    extra = F.when(F.col("recorded"), 0).otherwise(1)
    own = F.transform(F.sequence(F.lit(1), F.lit(reference_runs) + extra), lambda r: F.struct(F.lit(-1).alias("who"), r.alias("run")))
    others = F.flatten(F.transform(F.sequence(F.lit(0), F.col("candidates") - 1), lambda c: F.transform(F.sequence(F.lit(1), F.lit(candidate_runs)), lambda r: F.struct(c.cast("int").alias("who"), r.alias("run")))))
    both = F.when(F.col("candidates") > 0, F.concat(own, others)).otherwise(own)
    return items.select("id", F.explode(both).alias("call")).select("id", "call.who", "call.run")


def needed_votes(votes: DataFrame) -> DataFrame:
    """The votes that are spent: the first one, and the others only where the first is not a pass; none of a run that has no first.

    Votes are dealt once, by item, which serves what is folded of runs and candidates too."""
    run = Window.partitionBy("item", "cand", "run")
    first = F.col("vote") == 0
    # Whether there is a first vote, and whether it is a pass.
    rows = votes.dropna(subset=["item", "cand", "run"]).repartition("item").withColumn("first_", F.max(F.when(first, F.coalesce("kept", F.lit(False)))).over(run))
    return rows.where("first_ IS NOT NULL AND (vote = 0 OR NOT first_)").drop("first_")


def run_outcomes(votes: DataFrame) -> DataFrame:
    """Each run's outcome: kept by a majority of the votes that decide, if those are more than half of all; reason: of the first
    vote for that outcome, else of the first one."""
    g = votes.groupBy("item", "cand", "run").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("kept").alias("decided"),
        F.count_if("kept").alias("yes"),
        F.count_if(F.col("kept") & F.startswith("reason", F.lit("acceptable:"))).alias("loose"),
        *[F.min_by("reason", F.when(which, F.col("vote"))).alias(name) for name, which in (("yes_", F.col("kept")), ("no_", ~F.col("kept")), ("any_", F.lit(True)))],
    )
    judged = F.col("decided") * 2 > F.col("n")
    g = g.withColumn("kept", judged & (F.col("yes") * 2 > F.col("decided")))
    category = F.when(~judged, "unclear").when(F.col("kept"), F.when(F.col("loose") * 2 > F.col("yes"), "acceptable").otherwise("match")).otherwise("drift")
    shown = F.concat(F.when(F.col("kept"), F.col("yes")).otherwise(F.col("decided") - F.col("yes")).cast("string"), F.lit("/"), F.col("decided").cast("string"))
    reason = F.coalesce(F.when(F.col("kept"), F.col("yes_")).otherwise(F.col("no_")), F.col("any_"))
    return g.withColumn("category", category).withColumn("votes", shown).withColumn("reason", reason).drop("yes_", "no_", "any_")


def verdict(kept: Column, runs: Column, failed: Column, agree: Column, of: Column, floor: float = 0.6, margin: float = 0.2) -> Column:
    """within, outside or unverified, by the candidate's rate against the original's own."""
    own, rate = agree / of, kept / runs
    return (
        F.when((failed > 0) | agree.isNull() | (own < floor - EPSILON), "unverified").when(rate + EPSILON >= own - margin, "within").otherwise("outside")
    )


def verdict_reason(said: Column, kept: Column, runs: Column, failed: Column, agree: Column, of: Column, floor: float = 0.6) -> Column:
    """Why ``verdict`` said so."""
    share = lambda a, b: F.concat(a.cast("string"), F.lit("/"), b.cast("string"))
    rates = F.concat(F.lit(" ("), share(kept, runs), F.lit(" vs original "), share(agree, of), F.lit(")"))
    # The reasons as reports word them.
    calls_failed = F.concat(failed.cast("string"), F.lit(" of "), runs.cast("string"), F.lit(" candidate calls failed"))
    unread = F.lit("the original's consistency could not be read from the judge's reply")
    unstable = F.concat(F.lit("the original gave different answers here ("), share(agree, of), F.lit(" consistent); no stable behaviour to certify against"))
    within = F.concat(F.lit("stays within the original's own range"), rates)
    outside = F.concat(F.lit("less consistent than the original"), rates)
    return (
        F.when(failed > 0, calls_failed).when(agree.isNull(), unread).when(agree / of < floor - EPSILON, unstable).when(said == "within", within).otherwise(outside)
    )


def candidates(outcomes: DataFrame) -> DataFrame:
    """Each candidate's kept runs, answers by category, and whether a run could not be judged."""
    answers = [F.count_if(F.col("category") == c).alias(c) for c in ("match", "acceptable", "drift", "unclear")]
    return outcomes.groupBy("item", "cand").agg(F.count(F.lit(1)).alias("of"), F.count_if("kept").alias("kept"), *answers)


def judge_reasons(outcomes: DataFrame, verdicts: DataFrame) -> DataFrame:
    """item, cand and judge_reason: the most common reason of a candidate's runs that came out as its verdict (a run is kept where
    that is within); of equals the one of the first run."""
    decisive = outcomes.join(verdicts.select("item", "cand", "verdict"), ["item", "cand"]).where((F.col("reason") != "") & (F.col("kept") == (F.col("verdict") == "within")))
    counted = decisive.groupBy("item", "cand", "reason").agg(F.count(F.lit(1)).alias("n_"), F.min("run").alias("first_"))
    return counted.groupBy("item", "cand").agg(F.min_by("reason", F.struct((-F.col("n_")).alias("n"), "first_")).alias("judge_reason"))


def averages(answers: DataFrame) -> DataFrame:
    """item, cand, latency_ms and cost_micros: means over the runs that were timed (a time of 0 is none), and over the priced ones."""
    timed = F.when(F.col("latency_ms") != 0, F.col("latency_ms"))
    return answers.groupBy("item", "cand").agg(F.bround(F.avg(timed)).cast("long").alias("latency_ms"), F.bround(F.avg("cost_micros")).cast("long").alias("cost_micros"))


def node_safe(inputs: DataFrame, share: float = 0.8, least: int = 3) -> DataFrame:
    """A call-site is SAFE if at least ``share`` of its inputs are within; with fewer inputs than ``least`` it can't be told."""
    g = inputs.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") == "within").alias("safe"))
    return g.withColumn("verdict", F.when(F.col("n") < least, "LOW-EVIDENCE").when(F.col("safe") >= F.ceil(F.col("n") * F.lit(share)), "SAFE").otherwise("NOT-SAFE"))


def exact_copies(answers: DataFrame, references: DataFrame) -> DataFrame:
    """Candidate answers that equal one of their item's reference answers, white space around aside."""
    from spanloom.functions.text import strip

    own = references.select("item", strip(F.col("output")).alias("text_")).distinct()
    return answers.withColumn("text_", strip(F.col("output"))).join(own, ["item", "text_"], "left_semi").drop("text_")
