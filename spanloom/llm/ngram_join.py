"""Similarity join of documents on sets of word shingles: exact Jaccard, size-aware, heavy and light.

Two sets link when their intersection is at least ``similarity`` of their union.  Equal sets are one class from the
start.  All shingles are ordered: those of many characters first, those found frequent last.  A set of n shingles that
links with another one shares at least t = ceil(similarity * n) of its shingles with it, so in that order:

*  among its first n - t + k shingles are k of the other set's as well (*heavy* sets: inverted lists of these; k grows
   with n, and a pair must meet in k lists, so that one shared passage makes no candidate), and
*  among its first n - t + 2 are two of them (*light* sets: all subsets of two of these, each a key of its own).

Subsets are more keys, but almost only similar sets share two; lists are fewer keys with more partners to verify.  Sets
of up to ``boundary`` shingles are light.  The boundary is the size for which sampled sets cost least: a key for each
subset or list, and ``pair_cost`` keys for every partner that would be verified in vain.  Such partners are counted in
the batch that a sampled set comes from and scaled up to all documents, so the boundary grows with the corpus.  Light
sets that could link with a heavy one are in the lists too, where two light sets do not meet.

Lists and subsets of up to ``small_list`` sets give their pairs; a longer one gives a star, and stars that touch are a
*cluster*: sets that meet in a longer list are in one cluster, however many lists they share.  A cluster's sets are dealt into
tiles of about ``tile_sets``, and each two tiles meet in a task.  Tasks verify on whole sets, skip sets that are linked
through others already and give a spanning forest.  So nothing emits all pairs of a group, and no link between components
is lost; a cluster of m sets that do not link costs (m / tile_sets) ** 2 tasks of bounded size.

As a corpus grows, shingles that meet by chance fill longer lists, and such lists join sets that have nothing in common to
clusters that grow with all sets.  Where clusters would ship more than a twentieth of all sets, the shingles of long lists are
put last as well and all lists are made anew, as often as that makes clusters smaller.

Cases: a null text or one without words has an empty set and no links; a text of fewer words than a shingle has one
shingle, all its words; rows without an id have their own n_shingles, no links and no component; rows of equal id are
one node, each with its own n_shingles; an empty table gives an empty result; extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from spanloom.llm.arrowmap import append_struct, free_name
from spanloom.llm.components import components
from spanloom.llm.repeats import _batches, _by_bucket, _split, expand, pack
from spanloom.llm.sift import only_listed
from spanloom.llm.store import MANY_ROWS, batch_rows, new_path, partitions, remove, without_nulls, written, written_at

#: Lists are made anew at most so often.
MOST_ROUNDS = 4
from spanloom.llm.textnp import U64, Texts, chunks, grams, mix, releasing, whole, word_hash, words_of

def _ranked(hashes: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """Hashes whose order puts shingles of many characters first: they are the rarer ones."""
    return ((U64(63) - np.minimum(chars, 63).astype(U64)) << U64(58)) | (hashes >> U64(6))


def shingle_sets(texts: Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each document in order, and offsets."""
    words = words_of(texts)
    h = word_hash(texts, words, lower=True)
    g, first = grams(h, words.first, size)
    count = words.count
    chars = np.concatenate([[0], np.cumsum(words.end - words.start)])
    at = expand(words.first[:-1], np.diff(first))
    g = _ranked(g, chars[at + size] - chars[at])
    out = []
    for d in range(len(texts)):
        x = np.sort(g[first[d] : first[d + 1]])
        if not len(x) and count[d]:
            acc = U64(count[d])
            with np.errstate(over="ignore"):
                for v in h[words.first[d] : words.first[d + 1]]:
                    acc = acc * U64(0x5851F42D4C957F2D) + v
            x = _ranked(mix(np.array([acc], dtype=U64)), chars[words.first[d + 1]] - chars[words.first[d]])
        out.append(x[np.append(True, x[1:] != x[:-1])] if len(x) else x)
    return (np.concatenate(out) if out else np.zeros(0, U64)), np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int64)


def seals(sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A hash of each set; 0 for an empty one."""
    total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(sets + U64(0x9E3779B97F4A7C15)), dtype=U64)])
    n = np.diff(offsets)
    return np.where(n > 0, mix(total[offsets[1:]] - total[offsets[:-1]] + n.astype(U64)), U64(0)).view(np.int64)


def least_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    return -(-percent * n // 100)


def shared_lists(n: np.ndarray, percent: int) -> np.ndarray:
    """In how many lists two sets must meet, at the size of the set that needs fewer."""
    return np.minimum(least_overlap(n, percent), 1 + n // 25)


def scan(docs: DataFrame, size: int, percent: int, frequent_df: int, local_df: int = 3, n_sample: int = 4) -> DataFrame:
    """Rows of three kinds: a document (id, n, seal); a frequent shingle of a batch (gram, df); what a sampled set would
    cost (n, subsets, lists, and partners in vain of either, for each document of its batch)."""
    schema = to_arrow_schema(T.StructType.fromDDL(_SCAN))
    names = schema.names

    def rows_of(**columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            if not batch.num_rows:
                continue
            own_n, own_seals, fresh = [], [], []
            for piece in chunks(whole(batch.column(1))):
                sets, offsets = shingle_sets(piece, size)
                s = seals(sets, offsets)
                new = np.array([x not in seen and not seen.add(x) for x in s.tolist()], dtype=bool)
                n = np.diff(offsets)
                own_n.append(n)
                own_seals.append(s)
                fresh.append((sets[np.repeat(new, n)], n[new], s[new]))
            if len(seen) > 1 << 20:
                seen.clear()  # copies are counted again at worst; counts only order shingles
            n, s = np.concatenate(own_n), np.concatenate(own_seals)
            yield rows_of(id=batch.column(0), n=n, seal=s)
            sets, n, s = (np.concatenate(x) for x in zip(*fresh, strict=True))
            fresh.clear()
            if not len(sets):
                continue
            ordered = np.sort(sets)
            cut = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
            df = np.diff(np.append(cut, len(ordered)))
            gram, df = ordered[cut[df >= local_df]], df[df >= local_df]
            del ordered, cut
            yield rows_of(gram=gram.view(np.int64), df=df)
            # By size: sets of every size class are sampled, those of the smallest seals.
            order = np.lexsort((s, size_class(n)))
            order = order[n[order] > 0]
            place = np.arange(len(order)) - np.searchsorted(size_class(n)[order], size_class(n)[order])
            chosen = order[place < n_sample]
            yield rows_of(class_=size_class(n)[chosen], **costs_of(sets, n, chosen, gram[df >= frequent_df], df[df >= frequent_df], percent))

    return docs.mapInArrow(releasing(run), _SCAN)


_SCAN = "id long, n long, seal long, gram long, df long, class_ long, subsets long, lists long, vain_subsets long, vain_lists long, among long"


#: Pairs of a sampled set and a document that are looked at together.
_SLICE = 1 << 20


def size_class(n: np.ndarray) -> np.ndarray:
    """Sizes in steps of about a fifth."""
    return np.floor(np.log2(np.maximum(n, 1)) * 4).astype(np.int64)


def costs_of(sets: np.ndarray, n: np.ndarray, chosen: np.ndarray, frequent: np.ndarray, df: np.ndarray, percent: int) -> dict[str, np.ndarray]:
    """For chosen sets: how many subsets and lists they give, and how many sets of this batch would be verified in vain.

    A set that has half of the shingles looked at is likely to link and costs the same either way."""
    offsets = np.concatenate([[0], np.cumsum(n)])
    owner = np.repeat(np.arange(len(n)), n)
    heads, which = [], []
    t = least_overlap(n[chosen], percent)
    subset_head, list_head = np.minimum(n[chosen] - t + 2, n[chosen]), n[chosen] - t + shared_lists(n[chosen], percent)
    for k, d in enumerate(chosen.tolist()):
        own = sets[offsets[d] : offsets[d + 1]]
        own = own[np.lexsort((own, order_key(own, frequent, df)))]
        for side, head in enumerate((subset_head[k], list_head[k])):
            heads.append(own[:head])
            which.append(np.full(head, 2 * k + side))
    vain = np.zeros(2 * len(chosen), dtype=np.int64)
    if heads:
        gram, which = np.concatenate(heads), np.concatenate(which)
        order = np.argsort(gram, kind="stable")
        gram, which = gram[order], which[order]
        wanted = np.unique(gram)
        hit = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, sets), len(wanted) - 1)] == sets)
        lo = np.searchsorted(gram, sets[hit])
        many = np.searchsorted(gram, sets[hit], side="right") - lo
        # A slice of whole documents at a time, so that a shingle that all have needs no more memory.
        begin = np.flatnonzero(np.append(True, owner[hit][1:] != owner[hit][:-1])) if len(hit) else np.zeros(0, np.int64)
        total = np.concatenate([[0], np.cumsum(many)])
        cuts = np.append(begin[np.append(True, total[begin][1:] // _SLICE != total[begin][:-1] // _SLICE)] if len(begin) else begin, len(hit))
        for x, y in zip(cuts, cuts[1:], strict=False):
            pair = which[expand(lo[x:y], many[x:y])] * len(n) + np.repeat(owner[hit[x:y]], many[x:y])
            pair, met = np.unique(pair, return_counts=True)
            k, other = pair // len(n), pair % len(n)
            own = n[chosen[k // 2]]
            asked = np.where(k % 2 == 0, 2, shared_lists(np.minimum(own, n[other]), percent))
            head = np.where(k % 2 == 0, subset_head[k // 2], list_head[k // 2])
            fits = (100 * np.minimum(own, n[other]) >= percent * np.maximum(own, n[other])) & (other != chosen[k // 2])
            vain += np.bincount(k[fits & (met >= asked) & (2 * met < head)], minlength=2 * len(chosen))
    return {"subsets": subset_head * (subset_head - 1) // 2, "lists": list_head, "vain_subsets": vain[0::2], "vain_lists": vain[1::2], "among": np.full(len(chosen), len(n))}


def order_key(sets: np.ndarray, frequent: np.ndarray, df: np.ndarray) -> np.ndarray:
    """How often each shingle was found among the frequent ones, else 0."""
    if not len(frequent):
        return np.zeros(len(sets), dtype=np.int64)
    at = np.minimum(np.searchsorted(frequent, sets), len(frequent) - 1)
    return np.where(frequent[at] == sets, df[at], 0)


def choose_boundary(sampled: DataFrame, documents: int, pair_cost: float) -> int:
    """The size up to which subsets are to be listed, so that the sampled sets together cost least; of equals, the largest.

    sampled: rows of ``scan``.  One row for each size class comes to the driver, so at most a few hundred.
    """
    scale = F.lit(documents) / F.col("among")
    cost = lambda side: F.avg(F.col(side) + F.lit(pair_cost) * scale * F.col(f"vain_{side}")).alias(side)
    rows = sampled.where("class_ IS NOT NULL").groupBy("class_").agg(cost("subsets"), cost("lists")).orderBy("class_").collect()
    best, boundary, total = 0.0, 1, 0.0
    for r in rows:
        total += r.subsets - r.lists
        if total <= best:
            best, boundary = total, largest_size(r.class_)
    return max(1, boundary)


def largest_size(size_class_: int) -> int:
    """The largest size of a class."""
    n = int(2 ** ((size_class_ + 1) / 4)) + 1
    while n > 1 and int(size_class(np.array([n]))[0]) > size_class_:
        n -= 1
    return n


def keys_of(sets: np.ndarray, offsets: np.ndarray, frequent: np.ndarray, df: np.ndarray, percent: int, boundary: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, number of the set): subsets of light sets (odd keys), and single shingles of heavy sets and of those that may
    meet one (even keys)."""
    n = np.diff(offsets)
    t = least_overlap(n, percent)
    common = order_key(sets, frequent, df)
    owner = np.repeat(np.arange(len(n)), n)
    late = np.flatnonzero(common)
    ordered = sets
    if len(late):  # the hash order holds but for frequent shingles, which go last
        order = np.lexsort((sets, common, owner))
        ordered = sets[order]
    keys, owners = [], []
    single = (n > boundary) | ((n >= 2) & (100 * n >= percent * (boundary + 1)))
    p = np.where(single, n - t + shared_lists(n, percent), 0)
    keys.append(ordered[expand(offsets[:-1], p)] & ~U64(1))
    owners.append(np.repeat(np.arange(len(n)), p))
    for size in np.unique(n[(n >= 2) & (n <= boundary)]):
        own = np.flatnonzero(n == size)
        p = int(size - least_overlap(np.array([size]), percent)[0]) + 2
        p = min(p, int(size))
        i, j = np.triu_indices(p, 1)
        rows = ordered[offsets[own][:, None] + np.arange(p)]
        lo, hi = np.minimum(rows[:, i], rows[:, j]), np.maximum(rows[:, i], rows[:, j])
        keys.append((mix(lo * U64(0xD6E8FEB86659FD93) + mix(hi)) | U64(1)).ravel())
        owners.append(np.repeat(own, len(i)))
    return np.concatenate(keys), np.concatenate(owners)


def _with_long(frequent: np.ndarray, df: np.ndarray, found: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles and those of the longest lists, ``limit`` at most; a list's key has lost the last bit of its shingle."""
    top = found.where("gram IS NOT NULL").orderBy(F.desc("df"), "gram").limit(limit).select("gram", "df").toPandas()
    key = top["gram"].to_numpy(np.int64).view(U64)
    gram, own = np.concatenate([key, key | U64(1)]), np.tile(top["df"].to_numpy(np.int64), 2)
    new = ~np.isin(gram, frequent)
    gram, own = np.concatenate([frequent, gram[new]]), np.concatenate([df, own[new]])
    order = np.argsort(gram)
    return gram[order], own[order]


def postings(docs: DataFrame, size: int, shared, percent: int, boundary: int, n_buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, df = shared.value

        def rows_of(parts: list[tuple]) -> pa.RecordBatch:
            key, seal, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            rows = []
            for bucket, at in _split(((key >> U64(1)) % U64(n_buckets)).astype(np.int64)):
                own, local = np.unique(seal[at], return_inverse=True)
                size_of = np.zeros(len(own), dtype=np.int64)
                size_of[local] = n[at]
                rows.append((bucket, pack(key[at], local.astype(np.uint32), own, size_of)))
            return _batches(["bucket", "payload"], rows, [pa.int32(), pa.binary()])

        for batch in batches:
            parts, held, seen = [], 0, set()
            for piece in chunks(whole(batch.column(0))) if batch.num_rows else ():
                sets, offsets = shingle_sets(piece, size)
                s = seals(sets, offsets)
                new = np.array([x not in seen and not seen.add(x) for x in s.tolist()], dtype=bool)
                n = np.diff(offsets)
                sets, s, n = sets[np.repeat(new, n)], s[new], n[new]
                key, owner = keys_of(sets, np.concatenate([[0], np.cumsum(n)]), frequent, df, percent, boundary)
                if len(key):
                    parts.append((key, s[owner], n[owner]))
                    held += len(key)
                if held >= 1 << 20:  # bounds what a task holds
                    yield rows_of(parts)
                    parts, held = [], 0
            if parts:
                yield rows_of(parts)

    return docs.mapInArrow(releasing(run), "bucket int, payload binary")


def candidates(percent: int, boundary: int, small_list: int, n_tasks: int):
    """For mapInArrow: lists of a bucket to pairs of seals (task, payload), links of clusters (a, b) and shingles of long lists
    (gram, df)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in _by_bucket(batches):
            key = np.concatenate([p[0] for p in parts])
            seal = np.concatenate([p[2][p[1]] for p in parts])
            n = np.concatenate([p[3][p[1]] for p in parts])
            order = np.lexsort((seal, n, key))
            key, seal, n = key[order], seal[order], n[order]
            new = np.append(True, (key[1:] != key[:-1]) | (seal[1:] != seal[:-1]))
            key, seal, n = key[new], seal[new], n[new]
            cut = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            length = np.diff(np.append(cut, len(key)))
            a, b = [], []
            for m in np.unique(length[(length > 1) & (length <= small_list)]):
                at = cut[length == m][:, None] + np.arange(m)
                i, j = np.triu_indices(int(m), 1)
                i, j = at[:, i].ravel(), at[:, j].ravel()
                fits = (100 * n[i] >= percent * n[j]) & ((n[j] > boundary) | (key[i] & U64(1) == 1))
                a.append(i[fits])
                b.append(j[fits])
            if a:
                i, j = np.concatenate(a), np.concatenate(b)
                # A subset alone is enough; of lists, two sets must share as many as the smaller one asks for.
                met = np.where(key[i] & U64(1) == 1, _ENOUGH, 1)
                pairs = _summed(np.minimum(seal[i], seal[j]), np.maximum(seal[i], seal[j]), met, shared_lists(np.minimum(n[i], n[j]), percent))
                rows = [(task, pack(*(x[k] for x in pairs)), None, None, int((pairs[2][k] >= _ENOUGH).sum()), int((pairs[2][k] < _ENOUGH).sum()), None, None) for task, k in _split((mix(pairs[0].view(U64)) % U64(n_tasks)).astype(np.int64))]
                if rows:
                    yield _batches(_FOUND, rows, [pa.int64(), pa.binary(), *[pa.int64()] * 6])
            light = (key[cut] & U64(1) == 0) & (n[cut + length - 1] <= boundary)
            for k in np.flatnonzero((length > small_list) & ~light):
                # A star for each range of sizes in which sets can link; ranges overlap by one step.
                own, size = seal[cut[k] : cut[k] + length[k]], n[cut[k] : cut[k] + length[k]]
                links, lo = [], 0
                while lo < len(own):
                    hi = int(np.searchsorted(size, size[lo] * 100 // percent, side="right"))
                    links.append(np.stack([np.full(hi - lo, own[lo]), own[lo:hi]], axis=1))
                    if hi >= len(own):
                        break
                    if 100 * size[hi - 1] >= percent * size[hi]:
                        links.append(own[[hi - 1, hi]][None, :])
                    lo = hi
                links = np.concatenate(links)
                none = pa.nulls(len(links), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none.cast(pa.string()).cast(pa.binary()), pa.array(links[:, 0]), pa.array(links[:, 1]), none, none, none, none], names=_FOUND)
            long = np.flatnonzero((length > small_list) & ~light & (key[cut] & U64(1) == 0))
            if len(long):
                none = pa.nulls(len(long), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none.cast(pa.string()).cast(pa.binary()), *[none] * 4, pa.array(key[cut[long]].view(np.int64)), pa.array(length[long].astype(np.int64))], names=_FOUND)

    return run


_ENOUGH = 1 << 20
_FOUND = ["task", "payload", "a", "b", "by_subsets", "by_lists", "gram", "df"]


def _summed(a: np.ndarray, b: np.ndarray, met: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each pair once, with the sum of ``met``."""
    order = np.lexsort((b, a))
    a, b, met, asked = a[order], b[order], met[order].astype(np.int64), asked[order]
    first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, np.int64)
    return a[first], b[first], np.add.reduceat(met, first) if len(first) else met, asked[first]


def unique_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (task, payload) sorted by task: each task's pairs that met often enough, and a row for every set needed."""
    names, kinds = ["task", "payload", "seal"], [pa.int64(), pa.binary(), pa.int64()]
    for task, parts in _by_bucket(batches):
        a, b, met, asked = _summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        pairs = np.stack([a, b], axis=1)[met >= asked]
        if len(pairs):
            needed = np.unique(pairs)
            yield _batches(names, [(task, pack(pairs.ravel()), None)], kinds)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(needed), task)), pa.nulls(len(needed)).cast(pa.binary()), pa.array(needed)], names=names)


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[x] = y
        return x != y


def verify(percent: int):
    """For cogroup: pairs of a task (none for tiles: all pairs) and its sets, to links of a spanning forest."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        from spanloom.llm.repeats import unpack

        seal = right.column(1).to_numpy() if right.num_rows else np.zeros(0, np.int64)
        seal, first = np.unique(seal, return_index=True)
        sets = [np.frombuffer(x.as_buffer(), dtype=U64) for x in right.column(2).take(pa.array(first))] if len(first) else []
        n = np.array([len(x) for x in sets], dtype=np.int64)
        forest, links = Forest(len(sets)), []
        payloads = [x for x in left.column(1) if x.is_valid]
        for raw in payloads:
            pairs = np.searchsorted(seal, unpack(raw.as_buffer())[0]).reshape(-1, 2)
            for i, j in pairs.tolist():
                if forest.root(i) != forest.root(j):
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * both >= percent * (n[i] + n[j] - both) and forest.join(i, j):
                        links.append((i, j))
        if not payloads and len(sets):
            links += _all_pairs(sets, n, forest, percent)
        at = np.array(links, dtype=np.int64).reshape(-1, 2)
        return pa.table([pa.array(seal[at[:, 0]]), pa.array(seal[at[:, 1]])], names=["a", "b"])

    return run


def _all_pairs(sets: list[np.ndarray], n: np.ndarray, forest: Forest, percent: int) -> list[tuple[int, int]]:
    """Links among all sets of a tile: each set against those larger ones within reach that nothing links to it yet.
    Shingles are numbered densely."""
    order = np.argsort(n, kind="stable")
    sizes = n[order]
    _, ids = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    mark = np.zeros(int(ids.max()) + 1, dtype=np.int32)
    part = np.arange(len(order))
    links = []
    for i in range(len(order) - 1):
        hi = int(np.searchsorted(sizes, sizes[i] * 100 // percent, side="right"))
        open_ = np.flatnonzero(part[i + 1 : hi] != part[i]) + i + 1
        if not len(open_):
            continue
        own = ids[offsets[i] : offsets[i + 1]]
        mark[own] = 1
        step = sizes[open_]
        both = np.add.reduceat(mark[ids[expand(offsets[open_], step)]], np.cumsum(step) - step)
        mark[own] = 0
        for j in open_[100 * both >= percent * (sizes[i] + step - both)].tolist():
            if forest.join(int(order[i]), int(order[j])):
                links.append((int(order[i]), int(order[j])))
                part[part == part[j]] = part[i]
    return links


def _clusters(star: DataFrame, tile_sets: int) -> tuple[DataFrame, int]:
    """(seal, component, tiles) of sets in clusters, and how many sets their tasks would read, each as often as it is read."""
    member = written(components(star).select(F.col("node").alias("seal"), "component"), "clusters")
    sizes = member.groupBy("component").agg(F.count(F.lit(1)).alias("m")).withColumn("tiles", F.ceil(F.col("m") / tile_sets).cast("int"))
    read = sizes.agg(F.sum(F.col("m") * F.greatest(F.col("tiles") - 1, F.lit(1)))).first()[0] or 0
    return member.join(sizes, "component"), read


def _cluster_tasks(rows: DataFrame) -> DataFrame:
    """(seal, task): every two tiles of a cluster meet in a task; negative numbers keep them apart from pairs' tasks."""
    rows = rows.withColumn("tile", F.pmod(F.xxhash64("seal", F.lit(5)), F.col("tiles")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    rows = rows.select("seal", "component", "tile", "tiles", other)
    task = F.xxhash64("component", F.least("tile", "other"), F.greatest("tile", "other"))
    # A tile meets itself wherever it meets another one; alone only if there is no other.
    rows = rows.where((F.col("tiles") == 1) | (F.col("tile") != F.col("other")))
    return rows.select("seal", (-F.abs(F.shiftright(task, 1)) - 1).alias("task"))


def set_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = 5, percent: int = 75, frequent_df: int = 8, frequent_limit: int = 200_000, small_list: int = 32, tile_sets: int = 4096, pair_cost: float = 200.0, most_clustered: float = 0.05, report: dict | None = None) -> DataFrame:
    """For each row: id, n (shingles), seal (of its set), class (the smallest seal that links reach from this one, its own
    included) and component (the smallest id of a row of the class).  Equal sets are one node; equal ids join nothing.  A row
    with an empty set is alone, without a class; one without an id has n alone.

    frequent_limit: of the most frequent shingles, so many (16 bytes each) are known to all tasks; it bounds memory and
    changes only the order in which shingles are looked at, never the result.  pair_cost: what a verification costs in
    keys; a key takes well under a microsecond, reading two sets again some fifty.  most_clustered: lists are made anew while
    tasks of clusters would read more than this share of the documents' number, and each time halves it.  report: gets the
    boundary, what clusters would read in each round, and how many pairs subsets and lists gave.
    """
    spark = docs.sparkSession
    batch_rows(spark, MANY_ROWS)
    every = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    scanned = written(scan(every, size, percent, frequent_df), "sets")
    nameless = scanned.where("n IS NOT NULL AND id IS NULL").select("n")
    known, rows = scanned.where("id IS NOT NULL").select("id", "n", "seal"), without_nulls(every, "id")
    counts = scanned.where("gram IS NOT NULL").groupBy("gram").agg(F.sum("df").alias("df")).where(F.col("df") >= frequent_df)
    top = counts.orderBy(F.desc("df"), "gram").limit(frequent_limit).toPandas()
    frequent = top["gram"].to_numpy(np.int64).view(U64)
    order = np.argsort(frequent)
    frequent, df = frequent[order], top["df"].to_numpy(np.int64)[order]
    documents, reads = known.count(), []
    boundary = choose_boundary(scanned, documents, pair_cost)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(partitions(spark), total // (32 << 20))
    n_buckets = max(64, total // (8 << 20))
    while True:
        shared = spark.sparkContext.broadcast((frequent, df))
        lists = postings(rows.select("text"), size, shared, percent, boundary, n_buckets).repartition(tasks, "bucket").sortWithinPartitions("bucket")
        path = new_path(spark, "candidates")
        found = written_at(lists.mapInArrow(releasing(candidates(percent, boundary, small_list, n_buckets)), "task long, payload binary, a long, b long, by_subsets long, by_lists long, gram long, df long"), path)
        clusters, read = _clusters(found.where("a IS NOT NULL").select("a", "b"), tile_sets)
        reads.append(read)
        if read <= most_clustered * documents or len(reads) > MOST_ROUNDS or (len(reads) > 1 and 2 * read > reads[-2]):
            break
        frequent, df = _with_long(frequent, df, found, frequent_limit)
        remove(spark, path)
    if report is not None:
        report.update(boundary=boundary, clustered=reads, **found.agg(F.sum("by_subsets").alias("by_subsets"), F.sum("by_lists").alias("by_lists"), F.count("a").alias("by_stars")).first().asDict())
    pairs = found.where("payload IS NOT NULL").select("task", "payload").repartition(tasks, "task").sortWithinPartitions("task")
    pairs = written(pairs.mapInArrow(releasing(unique_pairs), "task long, payload binary, seal long"), "pairs")
    needed = written(pairs.where("seal IS NOT NULL").select("seal", "task").unionByName(_cluster_tasks(clusters)), "needed")
    # One document stands for each set; its text is read again for the tasks that need the set.
    reps = known.where("n > 0").groupBy("seal").agg(F.min("id").alias("id"))
    at = needed.groupBy("seal").agg(F.collect_list("task").alias("tasks")).join(reps, "seal").select(F.col("id").alias("of_id"), F.col("seal").alias("want"), "tasks")
    at = written(at, "wanted")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["task", "seal", "shingles"], [pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            want, where = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for piece in chunks(whole(batch.column(0))) if batch.num_rows else ():
                sets, offsets = shingle_sets(piece, size)
                own = seals(sets, offsets)
                made = [(t, want[k], sets[offsets[d] : offsets[d + 1]].tobytes()) for d in range(len(piece)) for k in [piece.row + d] if own[d] == want[k] for t in where[k]]
                if made:
                    yield _batches(names, made, kinds)

    sets = only_listed(rows, "id", at, "of_id", "inner").select("text", "want", "tasks").mapInArrow(releasing(read), "task long, seal long, shingles binary")
    spec = pairs.where("payload IS NOT NULL").select("task", "payload").unionByName(clusters_spec(needed))
    links = spec.groupBy("task").cogroup(sets.groupBy("task")).applyInArrow(releasing(verify(percent)), "a long, b long")
    part = written(components(links.select("a", "b")).withColumnRenamed("node", "seal"), "linked")
    # Only linked sets are grouped; any other set's component is the smallest id that has it.
    linked = part.join(reps, "seal")
    linked = linked.join(linked.groupBy("component").agg(F.min("id").alias("least")), "component").select("seal", F.col("component").alias("class"), "least")
    of_set = reps.join(linked, "seal", "left").select("seal", F.coalesce("class", "seal").alias("class"), F.coalesce("least", "id").alias("component"))
    none = F.lit(None).cast("long")
    filled = known.where("n > 0").join(of_set, "seal", "left").select("id", "n", "seal", "class", "component")
    bare = known.where("n = 0").select("id", "n", "seal", none.alias("class"), F.col("id").alias("component"))
    return filled.unionByName(bare).unionByName(nameless.select(none.alias("id"), "n", *[none.alias(c) for c in ("seal", "class", "component")]))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """For each row: id, n_shingles and component_id (the smallest id that links reach, its own included).  Rows of equal id are one
    node here, whatever their sets, so they join the components of their sets.  how: parameters of ``set_components``."""
    rows = written(set_components(docs, id_col, text, **how), "rows")
    least, largest = F.min("component").alias("least"), F.max("component").alias("largest")
    several = written(rows.where("id IS NOT NULL").groupBy("id").agg(least, largest).where("least <> largest").select("id", "least"), "several")
    if several.count():
        joined = rows.join(several, "id").where("component <> least").select(F.col("component").alias("a"), F.col("least").alias("b"))
        merged = components(joined).select(F.col("node").alias("component"), F.col("component").alias("merged"))
        rows = rows.join(merged, "component", "left").withColumn("component", F.coalesce("merged", "component"))
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def with_seal(docs: DataFrame, text: str, name: str, size: int = 5) -> DataFrame:
    """All columns and the seal of each text's set, 0 for an empty set."""
    compute = lambda texts: [seals(*shingle_sets(texts, size))]
    at = free_name(docs, f"{name}_of")
    out = append_struct(docs, text, at, compute, T.StructType([T.StructField("seal", T.LongType())]))
    return out.withColumn(name, F.col(f"`{at}`.seal")).drop(at)


def clusters_spec(needed: DataFrame) -> DataFrame:
    return needed.where("task < 0").select("task").distinct().withColumn("payload", F.lit(None).cast("binary"))
