"""The prefix trie of conversations against plain Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from spanloom.llm.op12 import op12_prefix_trie
from spanloom.llm.prefix_trie import rolled_up, trie_report
from spanloom.llm.store import batch_rows, partitions

TURNS = "conv_id long, turn long, role string, text string, depth int, n_convs string, `at` int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def said(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, said(role or "", text or ""), role or "", text or ""))
    turns = {c: [(x[3], x[4]) for x in sorted(v)] for c, v in own.items()}
    full = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        full[c] = tuple(turns.get(base, [])[:h] + mine[h:])
    members = defaultdict(list)
    for c, seq in full.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    out = []
    for node, convs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        children = [n for n in below if len(n) == len(node) + 1]
        leaves = [n for n in below if not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in members)]
        saved = sum((len(members[n]) - 1) * len(WORD.findall(n[-1][1])) for n in below if n)
        ends = ",".join(map(str, sorted(c for c in convs if len(full[c]) == len(node))))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, 3, "x", 1) for r in rows], TURNS).repartition(5)


def got(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def conversations(seed=1):
    rng = random.Random(seed)
    rows = []
    for c in [*range(-45, 70), 1000, 1001, 1019, 10**12 + 7]:
        if c % 20 == 0 and c % 60 == 20:
            continue  # a family without its first conversation
        for t in range(rng.choice([0, 1, 2, 3, 5, 9])):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["a b", "a", "", None, "word " * 40, "é ñ\x0bß"])))
    rows += [(7, 3, "user", "tie"), (7, 3, "user", "tie"), (7, 3, "tool", "tie"), (7, None, "user", "first"), (7, None, None, None), (None, 0, "user", "lost"), (None, None, None, None)]
    return rows


def test_against_plain_python(spark):
    rows = conversations()
    assert got(trie_report(table(spark, rows))) == brute(rows)


def test_query_and_small_batches(spark, tmp_path):
    """One group of equal conversations and one first turn hold most rows; batches of two rows split every run of equal keys."""
    rows = conversations(2) + [(c, t, "user", f"hot {t}") for c in range(2000, 2150) for t in range(4)] + [(c, 0, "user", "hot 0") for c in range(3000, 3080)]
    table(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        batch_rows(spark, 2)
        assert got(op12_prefix_trie(spark, str(tmp_path))) == brute(rows)
    finally:
        batch_rows(spark, int(before))


def test_one_long_conversation_over_all_partitions(spark):
    rows = [(20, t, "user", f"turn {t} of {t % 7}") for t in range(150)] + [(21, t, "user", f"turn {t} of {t % 7}") for t in range(140)]
    assert got(trie_report(table(spark, rows))) == brute(rows)
    from spanloom.llm.prefix_trie import numbered

    where = numbered(table(spark, rows)).where("conv_id = 20").select("part").distinct().count()
    assert where > partitions(spark) // 2


@pytest.mark.parametrize("rows", [[], [(None, 0, "user", "lost")], [(1, 0, "user", "a")], [(3, 0, "user", "gone"), (5, 0, "user", "gone too")]])
def test_few_rows(spark, rows):
    assert got(trie_report(table(spark, rows))) == brute(rows)


def test_rollup_takes_logarithmic_rounds(spark, monkeypatch):
    """A path of 1,000 nodes: sums of all suffixes after ten rounds of doubling."""
    from spanloom.llm import prefix_trie

    rounds = []
    keep = prefix_trie.written_at
    monkeypatch.setattr(prefix_trie, "written_at", lambda df, path: rounds.append(path) or keep(df, path))
    up = lambda c: F.when(F.col("id") > 0, c)
    edges = spark.range(1000).select(F.col("id").alias("depth"), F.col("id").alias("a"), F.lit(0).cast("long").alias("b"), up(F.col("id") - 1).alias("up_depth"), up(F.col("id") - 1).alias("up_a"), up(F.lit(0).cast("long")).alias("up_b"), F.col("id").alias("x"))
    sums = {r["a"]: r["x"] for r in rolled_up(edges, ["x"]).collect()}
    assert sums == {i: sum(range(i, 1000)) for i in range(1000)}
    assert len(rounds) == 11
