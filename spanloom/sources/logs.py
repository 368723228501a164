"""Scans of run and request logs: files, whole traces, the newest revision, windows, caps and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW_RUN = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "trace_id", "parent_run_id", "dotted_order", "run_type", "name", "start_time", "end_time", "error", "inputs", "outputs", "extra", "prompt_tokens", "completion_tokens", "prompt_tokens_details", "completion_tokens_details", "total_cost", "first_token_time", "feedback_stats")]
)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Raw runs of JSON files: a run a line, an array of runs, or an object with a ``runs`` array.  Free-form parts stay
    JSON strings."""
    wrapped = T.StructType([*RAW_RUN.fields, T.StructField("runs", T.ArrayType(RAW_RUN))])
    rows = spark.read.schema(wrapped).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    own = F.struct(*[F.col(f.name) for f in RAW_RUN.fields])
    return rows.select(F.explode(F.coalesce("runs", F.array(own))).alias("r")).select("r.*").where("id IS NOT NULL")


def newest_traces(runs: DataFrame, n: int) -> DataFrame:
    """All runs of the ``n`` traces whose roots are newest: whole traces, never single spans."""
    roots = runs.where("parent_id IS NULL").orderBy(F.desc("day"), F.desc("run_id")).limit(n).select("trace_id")
    return runs.join(F.broadcast(roots), "trace_id", "left_semi")  # n is a parameter and bounds the broadcast


def latest_revision(roots: DataFrame, n: int, revision: str | None = None) -> DataFrame:
    """Roots of one revision (the newest root's, unless given), newest first, at most ``n``."""
    newest = roots.where("revision <> ''").agg(F.max_by("revision", F.struct("day", "run_id")).alias("target"))
    rows = roots.where(F.col("revision") == revision) if revision else roots.join(F.broadcast(newest), F.col("revision") == F.col("target"), "left_semi")
    return rows.orderBy(F.desc("day"), F.desc("run_id")).limit(n)


def capped_count(rows: DataFrame, cap: int) -> DataFrame:
    """How many rows there are, counted up to ``cap``, and whether there may be more."""
    return rows.limit(cap).agg(F.count(F.lit(1)).alias("n")).withColumn("capped", F.col("n") >= cap)


def capped_per_group(rows: DataFrame, by: Column, order: str, per_group: int) -> DataFrame:
    """At most ``per_group`` rows of each group, the first in order."""
    w = Window.partitionBy(by).orderBy(order)
    return rows.withColumn("place_", F.row_number().over(w)).where(F.col("place_") <= per_group).drop("place_")


def in_window(day: Column, as_of: str, days: int | None = None, hours: int | None = None) -> Column:
    """On or after ``as_of`` less some days (hours count as whole days begun; 7 by default)."""
    n = days if days is not None else -(-hours // 24) if hours else 7
    return F.to_date(day) >= F.date_sub(F.lit(as_of).cast("date"), n)


def scan(rows: DataFrame, id: str, prompt: str, *, equal: dict[str, str] | None = None, time: str | None = None, since: object = None, copies: int | None = 5, limit: int | None = 2000) -> DataFrame:
    """A log in one scan: rows of given values (run type, agent, node: ``equal`` goes by column), on or after ``since``, at most so many
    copies of each prompt, and so many rows in all; of more, those of the smallest ids.

    Conditions are plain comparisons of columns with literals of their own type, so that files and partitions are
    skipped by them.  Copies are thinned in each task before any row is shuffled.  None: no such limit."""
    kinds = dict(rows.dtypes)
    for column, value in (equal or {}).items():
        rows = rows.where(F.col(column) == F.lit(value).cast(kinds[column]))
    if time is not None and since is not None:
        rows = rows.where(F.col(time) >= F.lit(since).cast(kinds[time]))
    if copies is not None:
        rows = capped_per_group(rows, F.col(prompt), id, copies)
    return rows if limit is None else rows.orderBy(id).limit(limit)


# Fields that may be logged beside the body of a request instead of in it.
BESIDE = ["max_tokens", "max_completion_tokens", "tools", "tool_choice", "parallel_tool_calls", "response_format", "temperature", "top_p", "seed", "stop", "reasoning_effort", "frequency_penalty", "presence_penalty"]


def whole_request(request: Column, params: Column, response: Column, served: Column) -> Column:
    """The request of a logged call as a map from key to value (variants), whatever keys there are.

    Known fields of ``params`` (JSON) lie under the body: they count where the body doesn't name the key.  On top is the
    model that answered: ``served``, else the response's.  A request that is no object is its messages.  Inner objects have
    their keys in order.
    """
    parsed = lambda c: F.try_parse_json(c)
    is_object = lambda v: F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))
    fields = lambda v: F.when(is_object(v), v.cast("map<string,variant>"))
    stated = lambda v: F.coalesce(F.schema_of_variant(v) != "VOID", F.lit(False))
    asked = parsed(request)
    body = F.coalesce(fields(asked), F.create_map(F.lit("messages"), asked))
    under = F.map_filter(fields(parsed(params)), lambda k, v: k.isin(BESIDE) & stated(v) & ~F.map_contains_key(body, k))
    nothing = F.create_map().cast("map<string,variant>")
    answered = F.coalesce(F.when(served != "", served), F.try_variant_get(parsed(response), "$.model", "string"))
    top = F.when(answered != "", F.create_map(F.lit("model"), F.to_variant_object(F.create_map(F.lit("m"), answered)).cast("map<string,variant>")["m"]))
    own = F.when(answered != "", F.map_filter(body, lambda k, v: k != "model")).otherwise(body)
    return F.map_concat(F.coalesce(under, nothing), own, F.coalesce(top, nothing))


def lookup(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is asked for; unknown ids are absent."""
    return rows.join(ids.select(key).distinct(), key, "left_semi")
