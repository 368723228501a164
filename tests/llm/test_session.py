"""Whole queries on one session's reused workers: many small rows after a heavy job, and the language query by its contract."""

import random
import re
import zlib

import brute

from spanloom.llm.decontaminate import find_phrases
from spanloom.llm.op1 import op1_language_id
from spanloom.llm.quality_rules import with_stats
from spanloom.llm.store import batch_rows
from spanloom.llm.suffix_dedup import remove_repeated_bytes


def small_rows(n, seed=5):
    rng = random.Random(seed)
    words = ["one", "ONE", "two", "three", "x", "é", "four", "a#b", "\n", "  ", "zehn"]
    return [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 7)))) for i in range(n)]


def test_many_small_rows_after_a_heavy_job(spark, docs):
    """Workers that a suffix job has used, batches of a few rows: every row still has its own bytes."""
    items = [(1, "one two three"), (2, "four x"), (3, "é")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = small_rows(20_000)
    many = spark.createDataFrame(rows, "doc_id long, text string").repartition(8).cache()
    want = brute.phrases(rows, items)
    stats = {i: brute.statistics(t) for i, t in rows}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in (7, 500):
            assert remove_repeated_bytes(docs).count() == docs.count()  # sets its own size of batches
            batch_rows(spark, size)
            found, name = find_phrases(many, benchmark)
            got = {r["doc_id"]: (r["n_words"], r["n_hit"]) for r in found.select("doc_id", f"{name}.n_words", f"{name}.n_hit").collect()}
            assert got == {i: tuple(x[:2]) for i, x in want.items()}
            told = with_stats(many, "text", "stats")
            got = {r["doc_id"]: r["n_words"] for r in told.select("doc_id", "stats.n_words").collect()}
            assert got == {i: s[0] for i, s in stats.items()}
    finally:
        batch_rows(spark, int(before))
        many.unpersist()


def test_language_query_by_its_contract(spark, folder, rows):
    """One row for each row, split by the id's CRC, a learned language or none, and a score between 0 and 1; twice the same."""
    out = op1_language_id(spark, folder)
    got = out.select("doc_id", "held_out", "lang_pred", "score").collect()
    assert sorted((r["doc_id"] for r in got), key=str) == sorted((r[0] for r in rows), key=str)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 3 == 1
    learned = {lang for i, t, lang, _ in rows if lang is not None and t is not None and not held(i)}
    text = {r[0]: r[1] for r in rows}
    for r in got:
        assert r["held_out"] == held(r["doc_id"]) or r["doc_id"] is None
        assert 0 <= r["score"] <= 1 and r["lang_pred"] in learned | {"und"}
        if not re.search(r"[^\W\d_]", text[r["doc_id"]] or ""):
            assert r["lang_pred"] == "und"
    assert sorted(map(str, got)) == sorted(map(str, op1_language_id(spark, folder).select("doc_id", "held_out", "lang_pred", "score").collect()))
