"""A prefix trie of conversations: shared first turns as nodes, with figures of every subtree.

Nodes are keyed by depth and a 128-bit digest of their turns, so the trie is a table of edges (node, parent).  What a
subtree adds up to goes to *all* ancestors by pointer jumping: in round k each node adds the sums of the nodes whose
2^k-th ancestor it is, and pointers double, so a conversation of a million turns takes twenty rounds.

Nothing gathers a conversation or a node.  Turns are sorted by range over all partitions, so a conversation may span many:
its places and digests are running figures inside a partition plus those of the partitions before.  Digests of a prefix are
the exclusive or of hashes of (place, turn), so partitions can be combined in any order.

Cases: a null role or text is an empty one; turns are ordered by turn (null first), equal ones by the MD5 of what they say;
rows without conv_id belong to no conversation; other columns are ignored; no conversations give no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.store import new_path, partitions, remove, written, written_at
from spanloom.llm.textnp import releasing

KEY = ["depth", "a", "b"]
PARENT = ["up_depth", "up_a", "up_b"]
WORD = r"[^\x20\x09-\x0D]+"


def numbered(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (conv_id, part, at, said, words) in the order of conversations and turns, without texts: part is the partition that
    holds the row, at its place in the whole order, said an MD5 of role and text."""
    r, t = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text))
    said = F.unhex(F.md5(F.concat(F.length(r).cast("string"), F.lit(":"), r, t)))
    rows = turns.where(F.col(f"`{conv}`").isNotNull()).select(F.col(f"`{conv}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), said.alias("said"), F.regexp_count(t, F.lit(WORD)).cast("long").alias("words"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "said"]
    rows = rows.repartitionByRange(partitions(turns.sparkSession), *order).sortWithinPartitions(*order)
    return rows.select("conv_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"), "said", "words")


def _stretches(rows: DataFrame) -> DataFrame:
    """For each conversation and partition: its rows there, the first one's place, its rows in partitions before, and in all."""
    found = rows.groupBy("conv_id", "part").agg(F.min("at").alias("from_at"), F.count(F.lit(1)).alias("n"))
    conv = Window.partitionBy("conv_id")
    earlier = F.coalesce(F.sum("n").over(conv.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return found.withColumn("before", earlier).withColumn("in_all", F.sum("n").over(conv))


def place_hashes(place: Column, said: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of a turn at a place."""
    return F.xxhash64(place, said), F.xxhash64(said, place, F.lit("b"))


def rebuilt(rows: DataFrame, family: int = 20, most_shared: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like the first of their family: conversation c gets the first h turns of c - c % family (all if
    it has fewer, none if it is absent), then its own after the first h; h is the CRC-32 of c modulo most_shared.

    Gives turns (conv_id, part, place from 1, said, words), part -1 for shared ones, and conversations (conv_id, length)."""
    parts = written(_stretches(rows), "stretches")
    convs = parts.groupBy("conv_id").agg(F.first("in_all").alias("own")).withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % most_shared)
    convs = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % family)
    lengths = convs.select(F.col("conv_id").alias("base"), F.col("own").alias("in_base"))
    convs = written(convs.join(lengths, "base", "left").withColumn("shared", F.least("h", F.coalesce("in_base", F.lit(0)))), "convs")
    placed = rows.join(parts.drop("n"), ["conv_id", "part"]).withColumn("ord", F.col("at") - F.col("from_at") + F.col("before") + 1)
    own_part = parts.select("conv_id", "part").join(convs.select("conv_id", "h", "shared"), "conv_id")
    own = placed.join(own_part, ["conv_id", "part"]).where(F.col("ord") > F.col("h"))
    own = own.select("conv_id", "part", (F.col("ord") - F.col("h") + F.col("shared")).alias("place"), "said", "words")
    first = placed.where((F.col("conv_id") % family == 0) & (F.col("ord") < most_shared)).select(F.col("conv_id").alias("base"), F.col("ord").alias("place"), "said", "words")
    heads = convs.where("shared > 0").select("conv_id", "base", "shared").join(first, "base").where("place <= shared")
    heads = heads.select("conv_id", F.lit(-1).alias("part"), "place", "said", "words")
    length = F.col("shared") + F.greatest(F.col("own") - F.col("h"), F.lit(0))
    return own.unionByName(heads), convs.select("conv_id", length.alias("length"))


def prefixes(turns: DataFrame) -> DataFrame:
    """Of every conversation and place: key of the node that its first turns make, and of that node's parent."""
    a, b = place_hashes(F.col("place"), F.col("said"))
    turns = turns.select("conv_id", "part", "place", "words", a.alias("ha"), b.alias("hb"))
    conv = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = turns.groupBy("conv_id", "part").agg(F.bit_xor("ha").alias("ha"), F.bit_xor("hb").alias("hb"))
    sums = sums.select("conv_id", "part", *[F.coalesce(F.bit_xor(f"h{x}").over(conv), F.lit(0)).alias(f"before_{x}") for x in "ab"])
    within = Window.partitionBy("conv_id", "part").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = turns.join(sums, ["conv_id", "part"])
    for x in "ab":
        out = out.withColumn(x, F.bit_xor(f"h{x}").over(within).bitwiseXOR(F.col(f"before_{x}")))
    up = [(F.col("place") - 1).alias("up_depth"), *[F.col(x).bitwiseXOR(F.col(f"h{x}")).alias(f"up_{x}") for x in "ab"]]
    return out.select("conv_id", F.col("place").alias("depth"), "a", "b", *up, "words")


def trie(places: DataFrame, convs: DataFrame) -> DataFrame:
    """Nodes (key, parent's key, conv_id: smallest member, n_convs, words), the root among them."""
    nodes = places.groupBy(*KEY).agg(*[F.max(c).alias(c) for c in PARENT], F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"))
    nothing = [F.lit(None).cast("long").alias(c) for c in PARENT]
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    return nodes.unionByName(root.select(*[F.lit(0).cast("long").alias(c) for c in KEY], *nothing, "conv_id", "n_convs", F.lit(0).cast("long").alias("words")))


def _at(keys: list[str], other: list[str]) -> list[Column]:
    return [F.col(k).alias(o) for k, o in zip(keys, other, strict=True)]


def rolled_up(edges: DataFrame, figures: list[str]) -> DataFrame:
    """Of a forest of edges (KEY, PARENT), each figure summed over every node's subtree, the node included.

    Round k: what a node's descendants of fewer than 2^k steps sum to is known; descendants of exactly 2^k steps bring theirs,
    and each pointer becomes that of the node that it points to.  Written each round; the pointers of the
    last round, all null, end it after the logarithm of the deepest path.  Joins have one row a key on their right side and
    are Spark's to split where many nodes point to one."""
    spark = edges.sparkSession
    path, reach = new_path(spark, "rollup"), [f"to_{c}" for c in KEY]
    now = written_at(edges.select(*KEY, *_at(PARENT, reach), *figures), path)
    while (open_ := now.where(F.col(reach[0]).isNotNull())).limit(1).count():
        brought = open_.groupBy(*reach).agg(*[F.sum(c).alias(f"more_{c}") for c in figures])
        brought = brought.select(*_at(reach, KEY), *[f"more_{c}" for c in figures])
        further = open_.select(*_at(KEY, reach), *_at(reach, [f"new_{c}" for c in KEY]))
        moved = open_.join(further, reach, "left").select(*KEY, *_at([f"new_{c}" for c in KEY], reach), *figures)
        moved = moved.unionByName(now.where(F.col(reach[0]).isNull()))  # those that are through take no part in the join
        added = moved.join(brought, KEY, "left").select(*KEY, *reach, *[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in figures])
        last, path = path, new_path(spark, "rollup")
        now = written_at(added, path)
        remove(spark, last)
    return now.select(*KEY, *figures)


def ends_digest(places: DataFrame, convs: DataFrame) -> DataFrame:
    """Of nodes at which conversations end, the SHA-256 of these conversations' ids, ascending, joined by commas.

    A node may end a third of all conversations: sorted ranges of them are packed to strings where they lie, and the strings
    of a node, few and in order, go through one running digest.  Neither step holds a node's list."""
    ends = places.join(convs.where("length > 0"), ["conv_id"]).where(F.col("depth") == F.col("length")).select(*KEY, "conv_id")
    ends = ends.unionByName(convs.where("length = 0").select(*[F.lit(0).cast("long").alias(c) for c in KEY], "conv_id"))
    ends = ends.repartitionByRange(partitions(places.sparkSession), *KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")
    packed = ends.mapInArrow(releasing(_pack), "depth long, a long, b long, first_id long, ids string")
    order = [*KEY, "first_id"]
    return packed.repartition(*KEY).sortWithinPartitions(*order).mapInArrow(releasing(_digest), "depth long, a long, b long, ends_sha256 string")


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each run of equal keys in a batch: the first id, and all of them as text."""
    for batch in batches:
        out: list[list] = []
        for *key, conv in _rows(batch):
            if out and out[-1][:3] == key:
                out[-1][4].append(str(conv))
            else:
                out.append([*key, conv, [str(conv)]])
        if out:
            *columns, ids = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array([",".join(x) for x in ids])], names=[*KEY, "first_id", "ids"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each key; the state of the last one is carried from batch to batch."""
    names, last, state = [*KEY, "ends_sha256"], None, hashlib.sha256()
    for batch in batches:
        out: list[tuple] = []
        for *key, _, ids in _rows(batch):
            if key == last:
                state.update(b",")
            else:
                if last is not None:
                    out.append((*last, state.hexdigest()))
                last, state = key, hashlib.sha256()
            state.update(ids.encode())
        if out:
            *columns, digests = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(digests)], names=names)
    if last is not None:
        yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in last), pa.array([state.hexdigest()])], names=names)


def trie_report(turns: DataFrame, family: int = 20, most_shared: int = 4) -> DataFrame:
    """A row for each node of the rebuilt conversations' trie: conv_id (smallest member), depth, parent_conv_id (null at the
    root), n_convs, n_children, n_leaves (childless nodes of the subtree), saved_tokens (words that one copy of each shared
    turn would save in the subtree), ends_sha256 (of the members that end there)."""
    rows = written(numbered(turns), "turns")
    shared, convs = rebuilt(rows, family, most_shared)
    convs = written(convs, "lengths")
    places = written(prefixes(written(shared, "rebuilt")), "places")
    nodes = written(trie(places, convs), "nodes")
    children = nodes.where("up_depth IS NOT NULL").groupBy(*PARENT).agg(F.count(F.lit(1)).alias("n_children")).select(*_at(PARENT, KEY), "n_children")
    known = written(nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "children")
    figures = known.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("words"))
    sums = rolled_up(figures, ["n_leaves", "saved_tokens"])
    parents = known.select(*_at(KEY, PARENT), F.col("conv_id").alias("parent_conv_id"))
    named = written(known.join(parents, PARENT, "left"), "named")
    out = named.join(sums, KEY).join(ends_digest(places, convs), KEY, "left")
    nobody = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nobody).alias("ends_sha256"))
