"""Windows that occur elsewhere in a corpus: what the byte-level and the word-level removal of repeats share.

1.  Every document gives its runs of windows (see anchors.py), packed by a bucket of the anchor's hash.  An anchor that
    a batch has twice is known to repeat: one word of it goes to its bucket, and its runs go straight on.
2.  Each bucket finds the anchors that occur twice or more; only their runs can hold a repeated window.
3.  Runs meet their texts again (in a *home*, a bucket of the id) and give contexts.  A home counts equal contexts as
    one, with its earliest occurrence and whether there are copies; the list of occurrences stays in the home.
4.  Contexts are dealt into groups by how the suffix structure wants them (by anchor, or by prefixes of variable length
    whose frequencies were counted over all homes).  A ``compare`` function, the suffix structure of the group, names the
    windows that the earliest occurrence of a context loses, and those that its copies lose.
5.  Named windows meet the home's occurrences and texts and are merged into spans.

Every exchange is by a hash of an anchor, prefix or id, packed in a few binary rows a task.  Homes and groups are as many
as the corpus needs, so memory doesn't follow the corpus.  A context that all documents share has one entry for each
home (a few megabytes of text), not for each document.  Only counts and the table of frequent prefixes are collected.

Rows of equal id and text count as one document; rows of equal id and different texts count as different documents, in
the order of a hash of their texts.  A ``salt`` other than 0 keeps a document's windows apart from all other documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from spanloom.llm.anchors import Runs
from spanloom.llm.store import MANY_ROWS, batch_rows, partitions, written
from spanloom.llm.textnp import U64, Texts, chunks, mix, prefix_sums, range_hash, releasing, whole

_CODES = ["|b1", "|u1", "<u2", "<u4", "<u8", "<i4", "<i8"]
_SMALL = 1 << 10
#: Stands in for the id of rows that have none; their salt keeps them apart.
NO_ID = -(2**63)
#: At most so many prefixes, and 4 lengths of each, are known to be frequent; groups grow before this does.
FREQUENT_PREFIXES = 100_000


def pack(*arrays: np.ndarray) -> bytes:
    """Flat arrays as bytes: a few bytes of header each, compressed unless they are short."""
    head = bytes([len(arrays), *[_CODES.index(a.dtype.str) for a in arrays]]) + np.array([a.size for a in arrays], np.uint32).tobytes()
    raw = head + b"".join(a.tobytes() for a in arrays)
    return b"\0" + raw if len(raw) < _SMALL else b"\1" + zstandard.ZstdCompressor(level=1).compress(raw)


def unpack(raw) -> list[np.ndarray]:
    raw = memoryview(raw)
    raw = raw[1:] if raw[0] == 0 else zstandard.ZstdDecompressor().decompress(raw[1:])
    n = raw[0]
    sizes, at, out = np.frombuffer(raw, np.uint32, n, n + 1), n + 1 + 4 * n, []
    for code, size in zip(raw[1 : n + 1], sizes.tolist(), strict=True):
        kind = np.dtype(_CODES[code])
        out.append(np.frombuffer(raw, kind, size, at))
        at += size * kind.itemsize
    return out


@dataclass
class Kind:
    """runs: of a piece of texts.  extent: byte ranges of runs of a piece, given their documents, starts and counts.
    prefixes: for runs given by documents and the places of their anchors, hashes of growing prefixes of the anchor (a row for
    each), or None.  compare: see Strings.  by_id: whether only a smaller id is earlier (else also an earlier start in the
    same document)."""

    runs: Callable[[Texts], tuple[Runs, np.ndarray]]
    extent: Callable[[Texts, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
    prefixes: Callable[[Texts, np.ndarray, np.ndarray], np.ndarray] | None
    compare: Callable[[Strings], tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]]
    by_id: bool


@dataclass
class Strings:
    """Distinct contexts of a group: bytes, offsets, windows in each, its anchor's hash, its earliest occurrence as a rank of
    the document (1, 2, ... in order) and a start, and whether it has copies.  ``compare`` gives (string, window) pairs that
    the earliest occurrence loses, and those that all other occurrences lose."""

    data: np.ndarray
    offsets: np.ndarray
    count: np.ndarray
    gram: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    copies: np.ndarray


def _batches(names: list[str], rows: list[tuple], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _split(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each key and where it is."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    cuts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(keys) else []
    for a, b in zip(cuts, np.append(cuts[1:], len(keys)), strict=True) if len(keys) else ():
        yield int(ordered[a]), order[a:b]


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows (bucket, payload) that come sorted: each bucket with all its payloads."""
    now, held = None, []
    for batch in batches:
        for bucket, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if bucket != now and held:
                yield now, held
                held = []
            now = bucket
            held.append(unpack(raw.as_buffer()))
    if held:
        yield now, held


def expand(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... (size of them), for each."""
    first = np.cumsum(size) - size
    return np.arange(int(size.sum())) + np.repeat(start - first, size)


def home_of(ids: np.ndarray, hashes: np.ndarray, n_buckets: int) -> np.ndarray:
    """The home of a row: by its id, and by its text's hash where it has none."""
    key = np.where(ids == NO_ID, hashes, ids).astype(np.int64)
    return (mix(key.view(U64)) % U64(n_buckets)).astype(np.int64)


def find_runs(docs: DataFrame, kind: Kind, n_buckets: int) -> DataFrame:
    """(key, known, payload): runs to be looked up, by a bucket of their anchor, and runs of anchors that repeat, by home."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, hashes, salts = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            parts, rows = [], []
            for piece in chunks(whole(batch.column(3))):
                r, doc = kind.runs(piece)
                parts.append((r.gram, doc + piece.row, r.start, r.count, r.ahead))
            gram, doc, start, count, ahead = (np.concatenate(x) for x in zip(*parts, strict=True))
            start, count, ahead = start.astype(np.uint32), count.astype(np.uint16), ahead.astype(np.uint16)
            salted = salts[doc] != 0
            if salted.any():
                gram[salted] = mix(gram[salted] ^ salts[doc[salted]].view(U64))
            known = _twins(gram)
            once = np.unique(gram[known])
            told = dict(_split((once % U64(n_buckets)).astype(np.int64)))
            single = np.flatnonzero(~known)
            asked = dict(_split((gram[single] % U64(n_buckets)).astype(np.int64)))
            nothing = np.zeros(0, dtype=np.int64)
            for bucket in sorted(told.keys() | asked.keys()):
                at = single[asked.get(bucket, nothing)]
                rows.append((bucket, False, pack(once[told.get(bucket, nothing)], np.diff(ids[doc[at]], prepend=0), hashes[doc[at]], gram[at], start[at], count[at], ahead[at])))
            many = np.flatnonzero(known)
            for home, k in _split(home_of(ids[doc[many]], hashes[doc[many]], n_buckets)):
                at = many[k]
                rows.append((home, True, pack(ids[doc[at]], hashes[doc[at]], gram[at], start[at], count[at], ahead[at])))
            if rows:
                yield _batches(["key", "known", "payload"], rows, [pa.int32(), pa.bool_(), pa.binary()])

    return docs.mapInArrow(releasing(run), "key int, known boolean, payload binary")


def _twins(values: np.ndarray) -> np.ndarray:
    """Whether each value occurs twice or more."""
    order = np.argsort(values)
    same = values[order[1:]] == values[order[:-1]]
    out = np.zeros(len(values), dtype=bool)
    out[order[1:]] = same
    out[order[:-1]] |= same
    return out


def repeated_runs(n_buckets: int):
    """For mapInArrow, rows sorted by known and key: runs whose anchor occurs twice or more, packed by home."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def asked(batches):
            for batch in batches:
                known = batch.column(1)
                for at, ready in enumerate(known.to_pylist()):
                    if ready:
                        done.append((batch.column(0)[at].as_py(), batch.column(2)[at].as_py()))
                yield batch.filter(pc.invert(known)).select([0, 2])

        done: list[tuple] = []
        for _, parts in _by_bucket(asked(batches)):
            once = np.unique(np.concatenate([p[0] for p in parts]))
            ids = np.concatenate([np.cumsum(p[1]) for p in parts])
            hashes, gram, start, count, ahead = (np.concatenate([p[i] for p in parts]) for i in range(2, 7))
            keep = np.flatnonzero(_twins(gram) | np.isin(gram, once))
            rows = []
            for h, at in _split(home_of(ids[keep], hashes[keep], n_buckets)):
                k = keep[at]
                rows.append((h, pack(ids[k], hashes[k], gram[k], start[k], count[k], ahead[k])))
            if rows:
                yield _batches(["home", "payload"], rows, [pa.int32(), pa.binary()])
            if done:
                yield _batches(["home", "payload"], done, [pa.int32(), pa.binary()])
                done.clear()
        if done:
            yield _batches(["home", "payload"], done, [pa.int32(), pa.binary()])

    return run


def pack_texts(docs: DataFrame, n_buckets: int) -> DataFrame:
    """Texts by home, compressed together: (home, payload of ids, hashes, salts, sizes, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids, hashes, salts = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
                texts = whole(batch.column(3))
                yield _batches(["home", "payload"], [(h, _pack_rows(ids, hashes, salts, texts, at)) for h, at in _split(home_of(ids, hashes, n_buckets))], [pa.int32(), pa.binary()])

    return docs.mapInArrow(releasing(run), "home int, payload binary")


def _pack_rows(ids: np.ndarray, hashes: np.ndarray, salts: np.ndarray, texts: Texts, at: np.ndarray) -> bytes:
    size = texts.offsets[at + 1] - texts.offsets[at]
    return pack(ids[at], hashes[at], salts[at], size, texts.data[expand(texts.offsets[at], size)])


def _unpack_rows(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, Texts]:
    ids, hashes, salts, size, data = (np.concatenate(x) for x in zip(*[unpack(x.as_buffer()) for x in column], strict=True))
    return ids, hashes, salts, Texts(data, np.append(0, np.cumsum(size)), 0)


def _take(texts: Texts, at: np.ndarray) -> Texts:
    size = texts.offsets[at + 1] - texts.offsets[at]
    return Texts(texts.data[expand(texts.offsets[at], size)], np.append(0, np.cumsum(size)), 0)


def _rows_of(ids: np.ndarray, hashes: np.ndarray, wanted_ids: np.ndarray, wanted_hashes: np.ndarray) -> np.ndarray:
    """The first row that has each wanted (id, hash)."""
    both = np.concatenate([ids, wanted_ids]), np.concatenate([hashes, wanted_hashes])
    order = np.lexsort((np.arange(len(both[0])), both[1], both[0]))
    a, b = both[0][order], both[1][order]
    first = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
    leader = np.empty(len(order), dtype=np.int64)
    leader[order] = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
    return leader[len(ids) :]


TEXTS, PLACES, CONTEXTS, COUNTS = range(4)
_HOME = "home int, part int, payload binary, depth int, prefix long, n long"


def contexts(kind: Kind):
    """For cogroup: texts of a home and its repeated runs to the texts concerned, the places of each context, the distinct
    contexts themselves, and how many of them have each prefix (depth 0: all)."""
    schema = to_arrow_schema(T.StructType.fromDDL(_HOME))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows or not left.num_rows:
            return schema.empty_table()
        home = left.column(0)[0].as_py()
        ids, hashes, salts, texts = _unpack_rows(left.column(1))
        run_id, run_hash, gram, start, count, ahead = (np.concatenate(x) for x in zip(*[unpack(x.as_buffer()) for x in right.column(1)], strict=True))
        used, local = np.unique(_rows_of(ids, hashes, run_id, run_hash), return_inverse=True)
        ids, hashes, salts, texts = ids[used], hashes[used], salts[used], _take(texts, used)
        order = np.lexsort((start, local))
        order = order[np.append(True, (np.diff(local[order]) != 0) | (np.diff(start[order].astype(np.int64)) != 0))]  # equal rows
        local, start, count, gram, ahead = local[order], start[order].astype(np.int64), count[order].astype(np.int64), gram[order], ahead[order].astype(np.int64)
        seal, held = np.empty(len(local), dtype=U64), []
        for piece in chunks(texts, 4 << 20):
            a, b = np.searchsorted(local, [piece.row, piece.row + len(piece)])
            if a == b:
                continue
            doc = local[a:b] - piece.row
            lo, hi = kind.extent(piece, doc, start[a:b], count[a:b])
            s = range_hash(prefix_sums(piece), lo, hi)
            apart = salts[local[a:b]] != 0
            s[apart] = mix(s[apart] ^ salts[local[a:b]][apart].view(U64))
            seal[a:b] = s
            first = np.unique(s, return_index=True)[1]
            size = hi[first] - lo[first]
            prefixes = kind.prefixes(piece, doc[first], (start + ahead)[a + first]) if kind.prefixes else np.zeros((len(first), 0), U64)
            held.append((s[first], gram[a + first], count[a + first].astype(np.uint16), size, piece.data[expand(lo[first], size)], prefixes))
        s, gram, count, size, data, prefixes = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        seals, pick = np.unique(s, return_index=True)
        begin = np.cumsum(size) - size
        data = data[expand(begin[pick], size[pick])]
        # Places of each context in order; the first of them is the earliest here.
        cls = np.searchsorted(seals, seal)
        order = np.lexsort((start, hashes[local], ids[local], cls))
        cls, local, start = cls[order], local[order], start[order]
        lead = np.searchsorted(cls, np.arange(len(seals)))
        own = ids[local]
        first = own == own[lead][cls] if kind.by_id else np.append(True, cls[1:] != cls[:-1])
        copies = np.bincount(cls, weights=~first) > 0
        prefixes = prefixes[pick]
        rows = [
            (home, TEXTS, _pack_rows(ids, hashes, salts, texts, np.arange(len(ids))), None, None, None),
            (home, PLACES, pack(np.diff(cls, prepend=0).astype(np.uint8), local.astype(np.uint32), start.astype(np.uint32), first), None, None, None),
            (home, CONTEXTS, pack(np.array([home]), seals, gram[pick], count[pick], size[pick].astype(np.uint32), data, prefixes.ravel(), own[lead], hashes[local[lead]], start[lead].astype(np.uint32), copies), None, None, None),
            (home, COUNTS, None, 0, None, len(seals)),
        ]
        for d in range(prefixes.shape[1]):
            value, n = np.unique(prefixes[:, d], return_counts=True)
            shared = n > (d > 0)
            rows += [(home, COUNTS, None, d + 1, v, m) for v, m in zip(value[shared].view(np.int64).tolist(), n[shared].tolist(), strict=True)]
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def deal(n_groups: int, lengths: int, frequent):
    """For mapInArrow: contexts of homes to (group, payload): by the anchor, or by the shortest prefix that is not frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                home, seal, gram, count, size, data, prefixes, ids, hashes, start, copies = unpack(raw.as_buffer())
                prefixes, key = prefixes.reshape(len(gram), lengths), gram.copy()
                for d in reversed(range(lengths)):
                    rare = ~np.isin(prefixes[:, d], frequent.value[d])
                    key[rare] = prefixes[rare, d]
                size = size.astype(np.int64)
                begin = np.cumsum(size) - size
                rows = []
                for group, at in _split((mix(key) % U64(n_groups)).astype(np.int64)):
                    rows.append((group, pack(home, at.astype(np.uint32), seal[at], gram[at], count[at], size[at].astype(np.uint32), data[expand(begin[at], size[at])], ids[at], hashes[at], start[at], copies[at])))
                if rows:
                    yield _batches(["key", "payload"], rows, [pa.int32(), pa.binary()])

    return run


def _runs_of(string: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Consecutive windows of a string as (string, first window, how many)."""
    order = np.lexsort((window, string))
    string, window = string[order], window[order]
    new = np.append(True, (string[1:] != string[:-1]) | (window[1:] != window[:-1] + 1)) if len(string) else np.zeros(0, dtype=bool)
    at = np.flatnonzero(new)
    return string[at], window[at], np.diff(np.append(at, len(string)))


def earlier(kind: Kind):
    """For mapInArrow: contexts of a group to removed windows (context of a home, whether of its first place, its copies or
    both, first window, how many), packed by home."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in _by_bucket(batches):
            home = np.concatenate([np.repeat(p[0], len(p[1])) for p in parts])
            cls, seal, gram, count, size, data, ids, hashes, start, copies = (np.concatenate([p[i] for p in parts]) for i in range(1, 11))
            parts.clear()
            size, start = size.astype(np.int64), start.astype(np.int64)
            begin = np.cumsum(size) - size
            _, one, string = np.unique(seal, return_index=True, return_inverse=True)
            order = np.lexsort((start, hashes, ids, string))
            home, cls, ids, hashes, start, copies, string = (x[order] for x in (home, cls, ids, hashes, start, copies, string))
            lead = np.searchsorted(string, np.arange(len(one)))
            entries = np.diff(np.append(lead, len(string)))
            rank = np.unique(ids[lead], return_inverse=True)[1]
            if not kind.by_id:
                pair = np.lexsort((hashes[lead], ids[lead]))
                a, b = ids[lead][pair], hashes[lead][pair]
                rank = np.empty(len(lead), dtype=np.int64)
                rank[pair] = np.cumsum(np.append(False, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            own = size[one]
            several = (entries > 1) | copies[lead]
            strings = Strings(data[expand(begin[one], own)], np.append(0, np.cumsum(own)), count[one].astype(np.int64), gram[one], rank, start[lead], several)
            del data
            first, other = kind.compare(strings)
            s, w, n = _runs_of(*first)
            gone = [(home[lead[s]], cls[lead[s]], np.zeros(len(s), dtype=np.uint8), w, n)]
            s, w, n = _runs_of(*other)
            at = expand(lead[s], entries[s])
            w, n = np.repeat(w, entries[s]), np.repeat(n, entries[s])
            is_lead = np.zeros(len(string), dtype=bool)
            is_lead[lead] = True
            part = np.where(is_lead[at], 1, 2).astype(np.uint8)
            keep = ~is_lead[at] | copies[at]
            gone.append((home[at][keep], cls[at][keep], part[keep], w[keep], n[keep]))
            home, cls, part, w, n = (np.concatenate(x) for x in zip(*gone, strict=True))
            rows = [(h, pack(cls[k], part[k], w[k].astype(np.uint16), n[k].astype(np.uint16))) for h, k in _split(home)]
            if rows:
                yield _batches(["home", "payload"], rows, [pa.int32(), pa.binary()])

    return run


def same_id_differs(docs: DataFrame, id_col: str) -> bool:
    """Whether an id has several rows."""
    return bool(docs.groupBy(F.col(f"`{id_col}`")).agg(F.count(F.lit(1)).alias("n")).where(f"`{id_col}` IS NOT NULL AND n > 1").limit(1).count())


def remove_repeats(docs: DataFrame, kind: Kind, finish, schema: str, lengths: int = 0, home_bytes: int = 4 << 20, most: int = 1 << 14) -> DataFrame:
    """docs: id, hash (tells rows of equal id apart), salt, text.  For each distinct (id, hash) with a removed window: id,
    hash and what ``finish`` makes of the text and the windows.

    finish(texts, document of each removed run, start, count): arrays, one value for each document.  lengths: of prefixes
    that the kind gives.  most: contexts in a group, about.
    """
    spark = docs.sparkSession
    batch_rows(spark, MANY_ROWS)
    rows = docs.select("id", "hash", "salt", "text").where("id IS NOT NULL AND text IS NOT NULL")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(partitions(spark), total // (4 * home_bytes))
    n_buckets = max(64, total // home_bytes)
    runs = find_runs(rows, kind, n_buckets).repartition(tasks, "key").sortWithinPartitions("known", "key")
    again = runs.mapInArrow(releasing(repeated_runs(n_buckets)), "home int, payload binary")
    met = pack_texts(rows, n_buckets).groupBy("home").cogroup(again.groupBy("home")).applyInArrow(releasing(contexts(kind)), _HOME)
    met = written(met, "contexts")
    counts = met.where(F.col("part") == COUNTS).groupBy("depth", "prefix").agg(F.sum("n").alias("n"))
    n_contexts = counts.where("depth = 0").agg(F.sum("n")).first()[0] or 0
    most = max(most, n_contexts // FREQUENT_PREFIXES)  # so no length has more frequent prefixes than that
    top = counts.where(F.col("n") > most).where("depth > 0").select("depth", "prefix").toPandas() if lengths else None
    frequent = spark.sparkContext.broadcast([top["prefix"][top["depth"] == d + 1].to_numpy(np.int64).view(U64) for d in range(lengths)])
    n_groups = max(64, 2 * n_contexts // most)
    strings = met.where(F.col("part") == CONTEXTS).select("payload").mapInArrow(releasing(deal(n_groups, lengths, frequent)), "key int, payload binary")
    strings = strings.repartition(tasks, "key").sortWithinPartitions("key")
    gone = strings.mapInArrow(releasing(earlier(kind)), "home int, payload binary")
    out_schema = f"id long, hash long, {schema}"
    empty = to_arrow_schema(T.StructType.fromDDL(out_schema)).empty_table()

    def end(left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows or not left.num_rows:
            return empty
        part = left.column(1).to_numpy()
        ids, hashes, _, texts = _unpack_rows(left.column(2).filter(pa.array(part == TEXTS)))
        (place,) = left.column(2).filter(pa.array(part == PLACES))
        step, local, start, first = unpack(place.as_buffer())
        own = np.cumsum(step.astype(np.int64))
        cls, which, window, count = (np.concatenate(x) for x in zip(*[unpack(x.as_buffer()) for x in right.column(1)], strict=True))
        lo = np.searchsorted(own, cls)
        n = np.searchsorted(own, cls, side="right") - lo
        at = expand(lo, n)
        which, window, count = (np.repeat(x, n).astype(np.int64) for x in (which, window, count))
        keep = (which == 2) | (first[at] == (which == 0))
        at, window, count = at[keep], window[keep], count[keep]
        used, local = np.unique(local[at], return_inverse=True)
        order = np.argsort(local, kind="stable")
        local, start, count = local[order], (start[at].astype(np.int64) + window)[order], count[order]
        made = []
        for piece in chunks(_take(texts, used)):
            a, b = np.searchsorted(local, [piece.row, piece.row + len(piece)])
            made.append(finish(piece, local[a:b] - piece.row, start[a:b], count[a:b]))
        columns = [pa.concat_arrays([pa.array(x) for x in c]) for c in zip(*made, strict=True)]
        return pa.table([pa.array(ids[used]), pa.array(hashes[used]), *columns], names=empty.schema.names)

    homes = met.where(F.col("part").isin(TEXTS, PLACES)).select("home", "part", "payload")
    return homes.groupBy("home").cogroup(gone.groupBy("home")).applyInArrow(releasing(end), out_schema)


def checked_gram(window: int, gram: int) -> int:
    """Symbols of an anchor for windows of a size."""
    if not 2 <= window < 1 << 15:
        raise ValueError(f"windows of {window} symbols: only 2 to {(1 << 15) - 1} are possible")
    return min(gram, (window + 1) // 2)


def windows_of(offsets: np.ndarray, size: int) -> np.ndarray:
    """Starts of all windows of ``size`` symbols that stay in a document."""
    n = np.maximum(np.diff(offsets) - size + 1, 0)
    return expand(offsets[:-1], n)


def covered(n: int, start: np.ndarray, count: np.ndarray, size: int) -> np.ndarray:
    """Symbols in any of the runs of windows."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + count - 1 + size, -1)
    return np.cumsum(edge[:-1]) > 0
