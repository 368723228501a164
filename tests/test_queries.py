"""Each query with SQL for its result, against DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from spanloom.plans.queries import QUERIES, SQL

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(x):
    if x is None:
        return None
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9)
    return x if isinstance(x, (int, bool, str)) else plain(x.item()) if hasattr(x, "item") else str(x)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=str)
    if name not in SQL:
        assert got
        return
    result = duck.execute(SQL[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    want = sorted(([plain(r[names.index(c)]) for c in columns] for r in result.fetchall()), key=str)
    assert got == want
