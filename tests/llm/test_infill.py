"""Fill-in-the-middle against plain Python, and its checkpoints against a count of every unit."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from brute import sha
from conftest import table
from pyspark.sql import functions as F

from spanloom.llm.fill_in_middle import checkpoints, fill_in_middle, restored
from spanloom.llm.op11 import op11_fill_in_middle
from spanloom.llm.textnp import chunks, whole

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")
AWKWARD = ["", "a", " ", "abc", "ab1cd", "é", "aé b", "日本語 text", "x" * 3000, "1" * 3000, "a1" * 900, "é" * 700 + "abc", "<", "<P", "a<P>b", "<S>", "x<M>", "<<S", "P><S<M", "\0a\0", "a\nb\r\n", "\U0001f600k" * 90, None, "same", "same"]


def infilled(doc_id, text):
    text = text or ""
    h = [int(hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = UNIT.findall(text)
    n = len(units)
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, post = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    spm = h[3] % 100 < 20
    made = f"<S>{post}<P>{pre}<M>{mid}" if spm else f"<P>{pre}<S>{post}<M>{mid}"
    return n, "spm" if spm else "psm", len(pre), len(mid), sha(made), sha(text)


def by_row(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_against_plain_python(spark, folder, rows):
    out = op11_fill_in_middle(spark, folder)
    assert by_row(out) == sorted(((i, *infilled(i, t)) for i, t, *_ in rows), key=str)
    assert {r["form"] for r in out.collect()} == {"plain", "psm", "spm"}


def test_awkward_texts_and_clashing_names(spark):
    rows = [(None if k % 7 == 6 else k % 40, t, None, None) for k, t in enumerate(AWKWARD * 4)]
    docs = table(spark, rows).withColumn("infilled", F.lit("mine")).withColumn("seed_digest", F.lit(1))
    out, name = fill_in_middle(docs, F.concat(F.lit("1:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), every=3)
    assert out.columns[:-1] == docs.columns and name == "_infilled"
    made = F.col(name)
    got = out.select("doc_id", f"{name}.n", f"{name}.form", f"{name}.prefix_chars", f"{name}.middle_chars", F.sha2(made["output"], 256), F.sha2(restored(made["output"], made["form"]), 256))
    assert by_row(got) == sorted(((i, *infilled(i, t)) for i, t, *_ in rows), key=str)


def test_empty_table(spark, none):
    out, name = fill_in_middle(none, F.col("source"))
    assert out.select(f"{name}.*").collect() == []


def test_all_or_none_infilled(docs):
    plain, name = fill_in_middle(docs, F.col("source"), infilled_percent=0)
    assert {r[0] for r in plain.select(f"{name}.form").collect()} == {"plain"}
    first, name = fill_in_middle(docs, F.col("source"), infilled_percent=100, spm_percent=100)
    assert {r[0] for r in first.where("length(text) > 0").select(f"{name}.form").collect()} == {"spm"}
    with pytest.raises(ValueError, match="checkpoints"):
        fill_in_middle(docs, F.col("source"), every=0)


@pytest.mark.parametrize("every", [1, 2, 5, 64])
@pytest.mark.parametrize("block", [1, 7, 100, 1 << 18])
def test_every_cut_by_checkpoints(every, block):
    texts = [t or "" for t in AWKWARD if len(t or "") < 800] + ["z" * 50, "z" * 50]
    for piece in chunks(whole(pa.array(texts)), 1 << 20):
        index = checkpoints(piece, every, block)
        for k in range(len(piece)):
            text = piece.bytes_of(k).decode()
            units = UNIT.findall(text)
            assert index.count[k] == len(units)
            for u in {*range(min(len(units), 9)), *range(max(0, len(units) - 4), len(units) + 1), len(units) // 2}:
                before = "".join(units[:u])
                assert index.cut(k, u) == (len(before.encode()), len(before))
    assert (np.diff(index.unit) > 0).all() and len(index.unit) <= index.first_unit[-1] / every + len(texts)
