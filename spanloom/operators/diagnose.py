"""What a log's metadata says about versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Metadata that may tell the version of an agent's code, the likeliest first.
VERSION_FIELDS = ["LANGSMITH_HOST_REVISION_ID", "LANGSMITH_LANGGRAPH_API_REVISION", "revision_id", "assistant_id", "graph_id", "LANGSMITH_HOST_PROJECT_ID", "langgraph_version", "langgraph_api_version"]


def version_fields(rows: DataFrame, meta: str, at: str, fields: list[str] = VERSION_FIELDS, most: int = 8) -> DataFrame:
    """field, place, state, value, n, first_at, last_at: the ``most`` most frequent values of each field of JSON metadata, when they were
    seen, and whether the field is absent, stable or varies.  An absent field is a row without a value.

    One pass explodes each row to the fields that it has; values are counted before the shuffle.  Of values that are as frequent, those
    come first that were seen first."""
    v = F.try_parse_json(meta)
    pairs = F.array(*[F.struct(F.lit(k).alias("place"), F.lit(f).alias("field"), F.try_variant_get(v, f"$['{f}']", "string").alias("value")) for k, f in enumerate(fields, 1)])
    found = rows.select(F.explode(F.filter(pairs, lambda p: p["value"].isNotNull())).alias("p"), F.substring(at, 1, 19).alias("at_")).select("p.*", "at_")
    counted = found.groupBy("place", "field", "value").agg(F.count(F.lit(1)).alias("n"), F.min("at_").alias("first_at"), F.max("at_").alias("last_at"))
    by = Window.partitionBy("field")
    ranked = counted.withColumn("k_", F.row_number().over(by.orderBy(F.desc("n"), "first_at", "value"))).withColumn("of_", F.count(F.lit(1)).over(by))
    every = rows.sparkSession.createDataFrame([(k, f) for k, f in enumerate(fields, 1)], "place int, field string")
    shown = F.broadcast(every).join(ranked.where(F.col("k_") <= most).drop("place"), "field", "left")
    state = F.when(F.col("of_").isNull(), "absent").when(F.col("of_") == 1, "STABLE (one value)").otherwise(F.concat(F.lit("VARIES → "), F.col("of_").cast("string"), F.lit(" values")))
    return shown.select("field", "place", state.alias("state"), F.substring("value", 1, 40).alias("value"), F.coalesce("n", F.lit(0)).alias("n"), "first_at", "last_at")
