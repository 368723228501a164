"""Query op9: verdicts on the URLs of ``pages``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm.url_filter import entries_of, judge_urls

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages, entries_of(spark, RULES))


OP9_SQL = (
    "WITH p AS (SELECT page_id, "
    "coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, "
    "coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path, row_number() OVER () AS rid FROM pages), "
    "r(verdict, rh, rp) AS (VALUES " + ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES) + "), "
    "m AS (SELECT p.rid, rh || rp AS rule, verdict, row_number() OVER (PARTITION BY p.rid ORDER BY length(rh || rp) DESC, length(rh) DESC) AS k "
    "FROM p JOIN r ON (p.host = rh OR ends_with(p.host, '.' || rh)) AND starts_with(p.path, rp)) "
    "SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM p LEFT JOIN m ON m.rid = p.rid AND m.k = 1"
)
