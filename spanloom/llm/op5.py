"""Query op5: sequences of 50 words of ``documents`` that a document of a smaller id has."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm.substring_dedup import remove_repeated_words


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_words(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP5_SQL = """
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT rid, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM d, unnest(range(1, len(w) - 48)) AS u(i)),
f AS (SELECT h, min(doc_id) AS first_id FROM g GROUP BY h),
r AS (SELECT DISTINCT rid, p FROM g JOIN f USING (h), unnest(range(i, i + 50)) AS u(p) WHERE doc_id > first_id),
k AS (SELECT d.rid, count(r.p) AS n_removed, string_agg(w[q], ' ' ORDER BY q) FILTER (WHERE r.p IS NULL) AS kept
  FROM d, unnest(range(1, len(w) + 1)) AS u(q) LEFT JOIN r ON r.rid = d.rid AND r.p = q GROUP BY d.rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (rid)
"""
