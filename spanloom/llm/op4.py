"""Query op4: ``pages`` written as WARC records and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.warc import archive_folder, read_archives, write_archives


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    folder = archive_folder(spark)
    index = write_archives(pages, folder)
    return read_archives(index, folder).select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, max(page_id) AS largest FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest HAVING count(*) > 1)
SELECT p.page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
  CASE WHEN payload_bytes >= 1000 AND g.largest IS NOT NULL AND p.page_id IS DISTINCT FROM g.largest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND g.largest IS NOT NULL AND p.page_id IS DISTINCT FROM g.largest THEN g.largest END AS refers_to
FROM p LEFT JOIN g USING (payload_digest)
"""
