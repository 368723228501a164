"""Query op12: the prefix trie of ``conversations``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm.prefix_trie import trie_report


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_report(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))


_CRC32 = """xor(4294967295, list_reduce(flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1])),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END, CAST(4294967295 AS BIGINT)))"""
OP12_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(concat(length(role), ':', role, text))) AS n FROM t),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {_CRC32} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
s AS (SELECT c.conv_id, o.n AS place, role, text FROM c JOIN o ON o.conv_id = c.base WHERE o.n <= c.h),
k AS (SELECT conv_id, h, (SELECT count(*) FROM s WHERE s.conv_id = c.conv_id) AS shared FROM c),
r AS (SELECT * FROM s UNION ALL SELECT conv_id, o.n - h + shared, role, text FROM o JOIN k USING (conv_id) WHERE o.n > h),
p AS (SELECT conv_id, place AS depth, list(md5(concat(length(role), ':', role, text))) OVER (PARTITION BY conv_id ORDER BY place) AS node,
  len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words FROM r
  UNION ALL SELECT conv_id, 0, [], 0 FROM c),
g AS (SELECT conv_id, depth, md5(array_to_string(node, ',')) AS node, md5(array_to_string(node[:depth - 1], ',')) AS up, words FROM p),
n AS (SELECT depth, node, min(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words FROM g GROUP BY depth, node),
m AS (SELECT depth, up, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY depth, up),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN m ON m.depth = n.depth + 1 AND m.up = n.node),
x AS (SELECT g.depth, g.node, sum(CASE WHEN f.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((f.n_convs - 1) * f.words) AS saved_tokens
  FROM f JOIN g ON g.conv_id = f.conv_id AND g.depth <= f.depth GROUP BY g.depth, g.node),
l AS (SELECT conv_id, max(depth) AS depth FROM g GROUP BY conv_id),
e AS (SELECT depth, node, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM l JOIN g USING (conv_id, depth) GROUP BY depth, node)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
  CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM f JOIN x USING (depth, node) LEFT JOIN n AS u ON u.depth = f.depth - 1 AND u.node = f.up LEFT JOIN e ON e.depth = f.depth AND e.node = f.node
"""
