"""Query op11: fill-in-the-middle of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.fill_in_middle import fill_in_middle, restored
from spanloom.llm.store import FEW_ROWS, batch_rows


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch_rows(spark, FEW_ROWS)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out, name = fill_in_middle(docs, F.concat(F.lit("1:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    made = F.col(name)
    back = F.sha2(restored(made["output"], made["form"]), 256)
    return out.select("doc_id", f"{name}.n", f"{name}.form", f"{name}.prefix_chars", f"{name}.middle_chars", F.sha2(made["output"], 256).alias("output_sha256"), back.alias("restored_sha256"))


OP11_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, t, CASE WHEN t = '' THEN [] ELSE regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') END AS w, CAST('0x' || h[1:8] AS UBIGINT) AS h1,
  CAST('0x' || h[9:16] AS UBIGINT) AS h2, CAST('0x' || h[17:24] AS UBIGINT) AS h3, CAST('0x' || h[25:32] AS UBIGINT) AS h4 FROM d),
c AS (SELECT *, len(w) AS n, CAST(least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS BIGINT) AS a, CAST(greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS BIGINT) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, coalesce(array_to_string(w[1:a], ''), '') AS pre, coalesce(array_to_string(w[a + 1:b], ''), '') AS mid, coalesce(array_to_string(w[b + 1:], ''), '') AS post FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || post || '<M>' || mid ELSE '<S>' || post || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN t ELSE pre || mid || post END) AS restored_sha256
FROM p
"""
