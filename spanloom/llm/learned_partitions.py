"""Approximate nearest neighbours by learned partitions of the space.

A bounded sample gives a neighbour graph, which recursive bisection cuts into parts of equal size with few edges between
them.  A small classifier learns from the graph which parts a vector's neighbours are in.  It deals every row of the table to
its most probable part, and routes a query to its most probable parts until their probabilities add up to a mass that is
calibrated on held-out vectors of the sample; there the query is reranked by exact cosine.  On data with structure that is a
few parts, on shapeless data most of them: recall is held, not cost.

Parts are tables of rows, cut into tiles of bounded size; a task holds one tile and streams the queries that probe it.
Large groups: rows of one and the same vector count as far as their k + 1 smallest ids, which are all that a result can
name; tiles and blocks of queries split a part that holds a third of all rows.

Cases: vectors that are null, empty, zero, or hold a null or non-finite component take no part, nor do rows without id, nor
vectors whose length isn't the most frequent one (the smaller of equals).  Repeated rows are rows of their own: a query's own row
is left out once, and a query that is there twice is answered twice.  Equal scores go by id.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.store import partitions, written
from spanloom.llm.textnp import releasing

#: Vectors with more copies than a result can name are thinned before anything else; so many of them are broadcast.
BROADCAST_VECTORS = 50_000
FOUND = "query_id long, query_seal long, copies long, vec_id long, score double"


def scaled(raw: np.ndarray) -> np.ndarray:
    """Vectors in double precision, each times a power of two (which changes no cosine) so that no square overflows."""
    x = raw.astype(np.float64)
    if not len(x):
        return x
    _, exponent = np.frexp(np.abs(x).max(axis=1))
    return np.ldexp(x, -exponent[:, None])


def lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt(in_turn(x, x))


def in_turn(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Products of rows summed component by component, so that equal vectors give equal sums wherever they stand."""
    out = np.zeros(len(x))
    for d in range(x.shape[1]):
        out += x[:, d] * y[:, d]
    return out


def unit(raw: np.ndarray) -> np.ndarray:
    x = scaled(raw)
    return x / lengths(x)[:, None]


def neighbours(of: np.ndarray, among: np.ndarray, k: int, own: bool, block: int = 512) -> np.ndarray:
    """Places of the k nearest unit vectors; own: row i of both is the same vector and not its own neighbour."""
    out = np.empty((len(of), k), dtype=np.int64)
    for lo in range(0, len(of), block):
        s = of[lo : lo + block] @ among.T
        if own:
            s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -np.inf
        near = np.argpartition(-s, k - 1, axis=1)[:, :k]
        order = np.argsort(-np.take_along_axis(s, near, 1), axis=1, kind="stable")
        out[lo : lo + block] = np.take_along_axis(near, order, 1)
    return out


def balanced_parts(near: np.ndarray, parts: int, seed: int = 0) -> np.ndarray:
    """Cut a neighbour graph into parts whose sizes differ by a node or so, with few edges between them.

    Recursive bisection: a vector that is smooth along edges (power iteration on the lazy random walk, without its constant
    component) is split at its quantile, then nodes of both sides change places as long as that saves edges."""
    n, rng, out = len(near), np.random.default_rng(seed), np.zeros(len(near), dtype=np.int64)
    todo = [(np.arange(n), parts, 0)]
    while todo:
        nodes, count, first = todo.pop()
        if count == 1:
            out[nodes] = first
            continue
        left = count // 2
        side = _bisected(near, nodes, len(nodes) * left // count, rng)
        todo += [(nodes[~side], left, first), (nodes[side], count - left, first + left)]
    return out


def _bisected(near: np.ndarray, nodes: np.ndarray, size: int, rng: np.random.Generator, rounds: int = 40) -> np.ndarray:
    """For each node whether it is on the second side; the first one gets ``size`` nodes."""
    n, place = len(nodes), np.full(len(near), -1)
    place[nodes] = np.arange(n)
    a, b = np.repeat(np.arange(n), near.shape[1]), place[near[nodes]].ravel()
    a, b = a[b >= 0], b[b >= 0]
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    degree = np.bincount(a, minlength=n) + 1e-9
    smooth = rng.standard_normal(n)
    for _ in range(rounds):
        smooth = (smooth + np.bincount(a, weights=smooth[b], minlength=n) / degree) / 2
        smooth -= (smooth * degree).sum() / degree.sum()
        smooth /= np.linalg.norm(smooth) + 1e-300
    side = np.ones(n, dtype=bool)
    side[np.argsort(smooth, kind="stable")[:size]] = False
    cut = np.count_nonzero(side[a] != side[b])
    for _ in range(rounds):
        inside = np.bincount(a, weights=side[a] == side[b], minlength=n)
        gain = degree - 2 * inside
        here, there = np.flatnonzero(side), np.flatnonzero(~side)
        here, there = here[np.argsort(-gain[here], kind="stable")], there[np.argsort(-gain[there], kind="stable")]
        most = min(len(here), len(there))
        moved = int(np.count_nonzero(gain[here[:most]] + gain[there[:most]] > 0))
        if not moved:
            break
        moved = max(1, moved // 3)  # all at once would undo each other's gains
        side[here[:moved]], side[there[:moved]] = False, True
        now = np.count_nonzero(side[a] != side[b])
        if now >= cut:
            side[here[:moved]], side[there[:moved]] = True, False
            break
        cut = now
    return side


@dataclass
class Router:
    """A classifier of one hidden layer, and the mass of probability that a query's parts must reach."""

    weights: list[np.ndarray]
    mass: float

    @property
    def parts(self) -> int:
        return len(self.weights[3])

    def hidden(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.weights[0] + self.weights[1], 0)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.hidden(x) @ self.weights[2] + self.weights[3]
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def own_part(self, x: np.ndarray) -> np.ndarray:
        return self.probabilities(x).argmax(axis=1)

    def ranked(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Parts from the most probable on, and the mass of those before each."""
        p = self.probabilities(x)
        order = np.argsort(-p, axis=1, kind="stable")
        mass = np.cumsum(np.take_along_axis(p, order, 1), axis=1)
        return order, np.concatenate([np.zeros((len(x), 1)), mass[:, :-1]], axis=1)

    def probed(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row, part): each row's parts in order of probability until their mass is reached; the first one always."""
        order, before = self.ranked(x)
        take = before < self.mass
        take[:, 0] = True
        row, rank = np.nonzero(take)
        return row, order[row, rank]


def fit_router(vectors: np.ndarray, parts: int, k: int = 5, recall: float = 0.95, links: int = 10, hidden: int = 128, epochs: int = 12, seed: int = 0) -> Router:
    """Graph, parts and classifier from four fifths of some vectors; the mass from the others: the least one at which these find
    ``recall`` of their true k neighbours among the four fifths.  (In a whole table neighbours are nearer, so it finds more.)"""
    x, rng = unit(vectors).astype(np.float32), np.random.default_rng(seed)
    held = rng.permutation(len(x)) % 5 == 0 if len(x) >= 40 else np.zeros(len(x), dtype=bool)
    known, asked = x[~held], x[held]
    links, k = min(links, len(known) - 1), min(k, len(known))
    parts = max(1, min(parts, len(known) // 16))
    dims, factor = x.shape[1], np.float32(np.sqrt(x.shape[1]))
    weights = [rng.standard_normal((dims, hidden)) * np.sqrt(2 / dims) * factor, np.zeros(hidden), rng.standard_normal((hidden, parts)) * 0.05, np.zeros(parts)]
    router = Router([w.astype(np.float32) for w in weights], 1.0)
    if parts == 1:
        return router
    near = neighbours(known, known, links, own=True)
    part = balanced_parts(near, parts, seed)
    goal = np.zeros((len(known), parts), dtype=np.float32)
    np.add.at(goal, (np.repeat(np.arange(len(known)), links), part[near].ravel()), 1)
    goal[np.arange(len(known)), part] += 1
    goal /= links + 1
    _train(router, known, goal, rng, epochs)
    if len(asked):
        order, before = router.ranked(asked)
        place = np.argsort(order, axis=1)
        true = router.own_part(known)[neighbours(asked, known, k, own=False)]
        needed = np.sort(np.take_along_axis(before, np.take_along_axis(place, true, 1), 1).ravel())
        router.mass = float(np.nextafter(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))], 2))
    return router


def _train(router: Router, x: np.ndarray, goal: np.ndarray, rng: np.random.Generator, epochs: int, rate: float = 2e-3, decay: float = 2e-6) -> None:
    """Adam on the cross-entropy with the shares of parts among neighbours."""
    first, second, step = [np.zeros_like(w) for w in router.weights], [np.zeros_like(w) for w in router.weights], 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
            a, h = x[rows], router.hidden(x[rows])
            out = (router.probabilities(a) - goal[rows]) / len(rows)
            back = (out @ router.weights[2].T) * (h > 0)
            step += 1
            for w, g, m, v in zip(router.weights, (a.T @ back, back.sum(0), h.T @ out, out.sum(0)), first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8) + decay * w


def usable(df: DataFrame, id: str, vector: str) -> DataFrame:
    """Rows (vec_id, seal, vector) that take part."""
    v = F.col("vector")
    good = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(f"`{id}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").alias("vector")).where(F.col("vec_id").isNotNull() & v.isNotNull() & good)
    sizes = rows.groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    return rows.where(F.size("vector") == (sizes[0] if sizes else 0)).select("vec_id", F.xxhash64("vector").alias("seal"), "vector")


def thinned(rows: DataFrame, most: int) -> DataFrame:
    """Of rows with the same vector, those of the ``most`` smallest ids: no result can name another.  Only vectors that have more
    rows are grouped, and of these each task hands on so many rows at most."""
    often = written(rows.groupBy("seal").count().where(F.col("count") > most).select("seal"), "often")
    n = often.count()
    if not n:
        return rows
    often = F.broadcast(often) if n <= BROADCAST_VECTORS else often
    among = Window.partitionBy("seal", "vector").orderBy("vec_id")
    few = rows.join(often, "seal", "left_semi").withColumn("k", F.row_number().over(among)).where(F.col("k") <= most)
    return rows.join(often, "seal", "left_anti").unionByName(few.drop("k"))


def _sample(rows: DataFrame, n_rows: int, most: int) -> np.ndarray:
    """At most so many rows, by a hash of id and vector, in its order."""
    h = F.xxhash64("vec_id", "seal", F.lit("fit"))
    share = min(1.0, (most + 5 * most**0.5 + 10) / max(n_rows, 1))
    chosen = rows.where(F.abs(h / F.lit(2.0**63)) <= share).orderBy(h, "vec_id").limit(most).select("vector").toArrow()
    column = chosen.column(0).combine_chunks()
    return _matrix(column.chunk(0) if isinstance(column, pa.ChunkedArray) and column.num_chunks else column)


def _matrix(column: pa.Array) -> np.ndarray:
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    return _matrix(batch.column(batch.schema.get_field_index("vector")))


def _dealt(rows: DataFrame, shared, every_probe: bool) -> DataFrame:
    """Rows with the column ``part``: their own one, or a row for each that they probe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        router = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                piece = batch.slice(lo, 4096)
                x = unit(_vectors(piece))  # in double precision, so that a row and its query are dealt alike
                row, part = router.probed(x) if every_probe else (np.arange(len(x)), router.own_part(x))
                columns = piece.take(pa.array(row)).columns if every_probe else piece.columns
                yield pa.RecordBatch.from_arrays([*columns, pa.array(part.astype(np.int32))], names=[*batch.schema.names, "part"])

    return rows.mapInArrow(releasing(run), T.StructType([*rows.schema.fields, T.StructField("part", T.IntegerType())]))


class _Tile:
    """The rows of one tile, and the queries' best among them."""

    def __init__(self, ids: np.ndarray, seals: np.ndarray, raw: np.ndarray, k: int):
        order = np.argsort(ids, kind="stable")
        self.ids, self.seals, self.x, self.k = ids[order], seals[order], scaled(raw[order]), k
        self.length = lengths(self.x) if len(ids) else np.zeros(0)

    def best(self, ids: np.ndarray, seals: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's row, id, score) of each query's k best, its own row left out once."""
        q = scaled(raw)
        length = lengths(q)
        s = (q / length[:, None]) @ (self.x / self.length[:, None]).T
        lo, hi = np.searchsorted(self.ids, ids), np.searchsorted(self.ids, ids, side="right")
        for i in np.flatnonzero(hi > lo):
            own = np.flatnonzero(self.seals[lo[i] : hi[i]] == seals[i])
            if len(own):
                s[i, lo[i] + own[0]] = -np.inf
        most = min(self.k, s.shape[1])
        least = np.partition(s, s.shape[1] - most, axis=1)[:, s.shape[1] - most]
        row, col = np.nonzero((s >= least[:, None] - 1e-9) & (s > -np.inf))
        score = in_turn(q[row], self.x[col]) / (length[row] * self.length[col])
        order = np.lexsort((self.ids[col], -score, row))
        row, col, score = row[order], col[order], score[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        keep = rank < self.k
        return row[keep], self.ids[col[keep]], score[keep]


def _reranked(k: int, at_once: int = 256):
    """For mapInArrow over rows sorted by (part, tile, block, asks): rows of a tile are held, queries stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, tile = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("part", "tile", "block", "asks")], axis=1)
            ends = [*(np.flatnonzero((whole[1:] != whole[:-1]).any(axis=1)) + 1), len(whole)]
            for lo, hi in zip([0, *ends[:-1]], ends, strict=True):
                now, asks = tuple(whole[lo, :3]), bool(whole[lo, 3])
                if now != key:
                    key, held, tile = now, [], None
                piece = batch.slice(lo, hi - lo)
                ids, seals = (piece.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "seal"))
                if not asks:
                    held.append((ids, seals, _vectors(piece)))
                    continue
                if tile is None and held:
                    tile, held = _Tile(*(np.concatenate(x) for x in zip(*held, strict=True)), k), []
                if tile is None:
                    continue  # a part that no row is in
                raw, copies = _vectors(piece), piece.column("copies").to_numpy(zero_copy_only=False)
                for at in range(0, len(ids), at_once):
                    some = slice(at, at + at_once)
                    row, found, score = tile.best(ids[some], seals[some], raw[some])
                    arrays = [ids[some][row], seals[some][row], copies[some][row], found, score]
                    yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["query_id", "query_seal", "copies", "vec_id", "score"])

    return releasing(run)


def nearest(df: DataFrame, is_query: Column, id: str = "vec_id", vector: str = "embedding", k: int = 5, recall: float = 0.95, fit_rows: int = 16_384, part_rows: int = 2_048, most_parts: int = 256, tile_rows: int = 8_192, block_queries: int = 65_536, exact: bool = False) -> DataFrame:
    """For each row of ``df`` for which ``is_query`` (of its column ``vec_id``) holds, its k nearest other rows by cosine: query_id,
    rank from 1, vec_id, score.

    recall: what the calibration aims at.  fit_rows: the most rows that graph and classifier are fitted on (they pass through
    the driver; all else is dealt from the whole table).  part_rows, most_parts: a part for so many rows, and how many at
    most.  tile_rows, block_queries: how many rows a task holds, and how many queries it streams past them.  exact: probe
    all parts, to measure recall by."""
    spark = df.sparkSession
    good = usable(df, id, vector)
    rows = written(thinned(good, k + 1), "vectors")
    n_rows = rows.count()
    asked = good.where(is_query).groupBy("vec_id", "seal").agg(F.first("vector").alias("vector"), F.count(F.lit(1)).alias("copies"))
    if not n_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    router = fit_router(_sample(rows, n_rows, fit_rows), max(4, min(most_parts, n_rows // part_rows)), k, recall)
    router.mass = 2.0 if exact else router.mass
    shared = spark.sparkContext.broadcast(router)
    probes = written(_dealt(asked, shared, True), "probes")
    dealt = written(_dealt(rows, shared, False), "dealt")
    count = lambda t, most: {r[0]: -(-r[1] // most) for r in t.groupBy("part").count().collect()}  # noqa: E731  a row for each part
    tiles, blocks = count(dealt, tile_rows), count(probes, block_queries)
    of_part = lambda x: F.get(F.array(*[F.lit(max(1, x.get(p, 0))) for p in range(router.parts)]), "part")
    number = lambda x, salt: F.pmod(F.xxhash64("vec_id", "seal", F.lit(salt)), of_part(x)).cast("int")
    each = lambda x: F.explode(F.sequence(F.lit(0), of_part(x) - 1))
    held = dealt.select("part", number(tiles, "tile").alias("tile"), each(blocks).alias("block"), F.lit(False).alias("asks"), "vec_id", "seal", "vector", F.lit(1).cast("long").alias("copies"))
    asking = probes.select("part", each(tiles).alias("tile"), number(blocks, "block").alias("block"), F.lit(True).alias("asks"), "vec_id", "seal", "vector", "copies")
    key = ["part", "tile", "block"]
    tasks = min(10_000, max(partitions(spark), sum(tiles.get(p, 0) * blocks.get(p, 0) for p in range(router.parts))))
    met = held.unionByName(asking).repartition(tasks, *key).sortWithinPartitions(*key, "asks")
    found = met.mapInArrow(_reranked(k), FOUND)
    order = Window.partitionBy("query_id", "query_seal", "copies").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("col")


def recall_of(found: DataFrame, truth: DataFrame) -> float:
    """Share of the true neighbours that were found."""
    key = ["query_id", "vec_id"]
    total, met = truth.select(*key).distinct(), found.select(*key).distinct()
    return total.join(met, key, "left_semi").count() / max(1, total.count())
