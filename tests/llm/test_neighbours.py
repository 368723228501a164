"""Nearest neighbours by learned partitions against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm.learned_partitions import balanced_parts, fit_router, nearest, neighbours, recall_of, unit
from spanloom.llm.op13 import op13_learned_partitions
from spanloom.llm.store import batch_rows

ROW = "vec_id long, embedding array<float>, label int, part string, seal int"


def table(spark, rows, kind=ROW):
    return spark.createDataFrame([(i, v, 1, "p", 2) for i, v in rows], kind).repartition(5)


def usable(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute(rows, k=5, every=50):
    rows = [(i, np.asarray(v, dtype=np.float64)) for i, v in rows if i is not None and usable(v)]
    sizes = [len(v) for _, v in rows]
    dims = min(set(sizes), key=lambda d: (-sizes.count(d), d)) if rows else 0
    rows = [(i, v) for i, v in rows if len(v) == dims]
    out = []
    for n, (i, q) in enumerate(rows):
        if i % every:
            continue
        score = [(-float(sum(a * b for a, b in zip(q, v, strict=True))) / (math.sqrt(sum(a * a for a in q)) * math.sqrt(sum(a * a for a in v))), j) for m, (j, v) in enumerate(rows) if m != n]
        out += [(i, rank + 1, j, round(-s, 9)) for rank, (s, j) in enumerate(sorted((round(s, 13), j) for s, j in score)[:k])]
    return sorted(out)


def got(df):
    assert df.columns[:4] == ["query_id", "rank", "vec_id", "score"]
    return sorted((r[0], r[1], r[2], round(r[3], 9)) for r in df.collect())


def awkward():
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.standard_normal(6).astype(np.float32)]) for i in range(260)]
    hot = rows[17][1]
    rows += [(1000 + i, hot) for i in range(120)]  # a third of all rows; queries among them
    rows += [(50, rows[50][1]), (50, rows[50][1]), (100, rows[3][1]), (None, hot), (2000, None), (2001, []), (2002, [0.0] * 6), (2050, [None] + [1.0] * 5), (2051, [float("nan")] * 6), (2052, [float("inf")] + [0.0] * 5), (2100, [1.0, 2.0]), (2101, [1.0] * 7), (2150, [2 * x for x in hot]), (-50, [-x for x in hot])]
    return rows


@pytest.mark.parametrize("how", [{}, {"tile_rows": 7, "block_queries": 2}, {"fit_rows": 60, "k": 3}])
def test_all_parts_equal_brute_force(spark, how):
    rows = awkward()
    assert got(nearest(table(spark, rows), F.col("vec_id") % 50 == 0, exact=True, **how)) == brute(rows, how.get("k", 5))


def test_small_batches(spark):
    rows = awkward()
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        batch_rows(spark, 3)
        assert got(nearest(table(spark, rows), F.col("vec_id") % 50 == 0, exact=True, tile_rows=40)) == brute(rows)
    finally:
        batch_rows(spark, int(before))


def test_doubles_beyond_the_range_of_squares(spark):
    rows = [(i, [1e200 * x for x in v] if i % 2 else [1e-200 * x for x in v]) for i, v in awkward()[:120]]
    want = [(q, r, v) for q, r, v, _ in brute(awkward()[:120])]
    assert [x[:3] for x in got(nearest(table(spark, rows, ROW.replace("float", "double")), F.col("vec_id") % 50 == 0, exact=True))] == want


@pytest.mark.parametrize("rows", [[], [(0, [1.0])], [(0, None), (None, [1.0])], [(50, [1.0, 2.0]), (51, [2.0, 1.0])], [(1, [1.0]), (2, [3.0])]])
def test_few_rows(spark, rows):
    assert got(nearest(table(spark, rows), F.col("vec_id") % 50 == 0)) == brute(rows)


def test_query_finds_nine_in_ten(spark):
    folder = "/root/testdata/sf0.1"
    found = op13_learned_partitions(spark, folder).cache()
    truth = nearest(spark.read.parquet(f"{folder}/embeddings.parquet"), F.col("vec_id") % 50 == 0, exact=True).cache()
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert got(truth) == brute(rows)
    assert recall_of(found, truth) >= 0.9
    assert [r["rank"] for r in found.orderBy("query_id", "rank").collect()] == [1, 2, 3, 4, 5] * (found.count() // 5)
    near = {(r["query_id"], r["vec_id"]): r["score"] for r in truth.collect()}
    assert all(near.get((r["query_id"], r["vec_id"]), r["score"]) == r["score"] for r in found.collect())


def test_parts_are_balanced_and_follow_the_graph():
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((8, 16)) * 4
    x = unit(centres[rng.integers(0, 8, 1600)] + rng.standard_normal((1600, 16)))
    near = neighbours(x, x, 10, own=True)
    for parts in (2, 5, 8):
        part = balanced_parts(near, parts)
        sizes = np.bincount(part, minlength=parts)
        assert sizes.max() - sizes.min() <= parts
        assert np.mean(part[near] == part[:, None]) > 0.75


def test_routing_probes_few_parts_where_there_is_structure():
    """Vectors around many centres: a few of 16 parts hold the neighbours."""
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((200, 24))
    vectors = centres[rng.integers(0, 200, 6000)] + 0.2 * rng.standard_normal((6000, 24))
    router = fit_router(vectors[:4000], 16)
    asked, rest = unit(vectors[4000:]), unit(vectors[:4000])
    row, part = router.probed(asked)
    own = router.own_part(rest)
    truth = own[neighbours(asked, rest, 5, own=False)]
    met = set(zip(row.tolist(), part.tolist(), strict=True))
    assert np.mean([(i, p) in met for i in range(len(asked)) for p in truth[i]]) > 0.93
    assert len(row) / len(asked) < 6
    assert router.mass < 1
