import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from brute import documents  # noqa: E402

DOC = "doc_id long, text string, lang string, source string, n_chars long, n_words long, found string, `row` string, quality_stats int, size string"


def table(spark, rows):
    """Rows as a table like ``documents``, with extra columns whose names the operators use themselves."""
    full = [(i, t, lang, s, None if t is None else len(t), -1, "f", "r", 7, "s") for i, t, lang, s in rows]
    return spark.createDataFrame(full, DOC).repartition(5)


@pytest.fixture(scope="session")
def rows():
    return documents()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return table(spark, rows).cache()


@pytest.fixture(scope="session")
def none(spark):
    return table(spark, [])


@pytest.fixture(scope="session")
def folder(spark, docs, rows, tmp_path_factory):
    """A folder of tables for whole queries."""
    path = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{path}/documents.parquet")
    items = [(1, rows[5][1]), (2, next(r[1] for r in rows if r[0] == 50)[:300]), (3, "one two three"), (None, "lost"), (5, None), (5, "one two three")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    labels = [(r[0], 0 if (r[1] or "").startswith("x") else 1, 0) for r in rows] + [(None, 1, 0), (3, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path
