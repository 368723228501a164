"""Benchmark decontamination: an FM-index for each training shard, searched for all phrases of a benchmark.

A shard is some megabytes of whole documents in one task.  Its text is the sequence of its words over the alphabet of
the benchmark's words: other words can be in no phrase, so they part the text, and stretches shorter than the shortest
phrase are left out.  The shard's suffix array is made by prefix doubling (only groups that are still tied are sorted
again), its Burrows-Wheeler transform goes into a wavelet matrix, and phrases are searched backward, all at once: two
ranks for each word of a phrase.  Occurrences are located by walking to the next sampled suffix position, and the words
that they cover are merged into removal spans.

A phrase is any ``window`` consecutive words of an item; an item of fewer words, but not none, is one phrase.  Words are
hashed to 64 bits.

The benchmark is searched in blocks of at most about ``block_bytes`` of text, one after another; only a block is ever
held by the driver and the tasks.

Cases: a null text has no words and no hits; an item without an id or words is not searched for; items of equal ids
count once; repeated rows and null ids of documents are carried along; an empty benchmark hits nothing; extra columns
are carried along.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.arrowmap import append_struct, free_name
from spanloom.llm.textnp import IS_ALNUM, Texts, code_points_before, whole, word_hash, words_of


class WaveletMatrix:
    """rank(symbols, positions): how often each symbol occurs before each position."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        for level in range(bits - 1, -1, -1):
            bit = (values >> level) & 1
            ones = np.zeros(len(values) + 1, dtype=np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(values) - int(ones[-1]))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def rank(self, symbols: np.ndarray, positions: np.ndarray) -> np.ndarray:
        lo, hi = np.zeros_like(positions), positions.copy()
        for level, ones, zeros in zip(range(self.bits - 1, -1, -1), self.ones, self.zeros, strict=True):
            one = ((symbols >> level) & 1) == 1
            a, b = ones[lo], ones[hi]
            lo = np.where(one, zeros + a, lo - a)
            hi = np.where(one, zeros + b, hi - b)
        return hi - lo


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Of symbols >= 0, where each 0 is an end of its own (smaller than all else, the first the smallest)."""
    n = len(text)
    ends = text == 0
    key = np.where(ends, np.cumsum(ends) - 1, text.astype(np.int64) + int(ends.sum()))
    sa = np.argsort(key, kind="stable")
    new = np.ones(n, dtype=bool)
    new[1:] = key[sa[1:]] != key[sa[:-1]]
    rank = np.empty(n, dtype=np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    size = np.append(np.flatnonzero(new)[1:], n) - np.flatnonzero(new)
    tied = np.flatnonzero(np.repeat(size > 1, size))
    step = 1
    while len(tied):
        at = sa[tied]
        key = rank[at] * (n + 1) + rank[np.minimum(at + step, n - 1)]
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        sa[tied] = at
        new = np.ones(len(tied), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        rank[at] = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))]
        start = np.flatnonzero(new)
        size = np.append(start[1:], len(tied)) - start
        tied = tied[np.repeat(size > 1, size)]
        step *= 2
    return sa


class FMIndex:
    """Of a text whose symbols are >= 0 and that ends with 0; phrases have no 0."""

    def __init__(self, text: np.ndarray, n_symbols: int, rate: int = 16):
        sa = suffix_array(text)
        self.n = len(text)
        self.last = text[sa - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_symbols))])
        self.tree = WaveletMatrix(self.last, max(1, int(n_symbols - 1).bit_length()))
        # Sampled: every rate-th position, and those after an end, from where no step leads on.
        sampled = (sa % rate == 0) | (self.last == 0)
        self.sampled = np.concatenate([[0], np.cumsum(sampled)])
        self.samples = sa[sampled]

    def _back(self, symbols: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return self.first[symbols] + self.tree.rank(symbols, rows)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that each phrase (a row) begins; empty if it does not occur."""
        lo, hi = np.zeros(len(phrases), dtype=np.int64), np.full(len(phrases), self.n, dtype=np.int64)
        live = np.arange(len(phrases))
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, j]
            lo[live], hi[live] = self._back(c, lo[live]), self._back(c, hi[live])
            live = live[hi[live] > lo[live]]
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the text of suffixes, given by their rows."""
        rows, out, steps = rows.copy(), np.zeros(len(rows), dtype=np.int64), 0
        left = np.arange(len(rows))
        while len(left):
            r = rows[left]
            found = self.sampled[r + 1] > self.sampled[r]
            out[left[found]] = self.samples[self.sampled[r[found]]] + steps
            left, r = left[~found], r[~found]
            rows[left] = self._back(self.last[r], r)
            steps += 1
        return out


@dataclass
class Phrases:
    """A block of a benchmark.  by_size: for each size, phrases as rows of symbols and the numbers of their items as
    offsets and values."""

    words: np.ndarray
    items: list[str]
    by_size: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


def phrases_of(ids: list[str], texts: pa.Array, window: int) -> Phrases:
    items = sorted({i for i in ids if i is not None})
    piece = whole(texts)
    words = words_of(piece, IS_ALNUM)
    known, symbols = np.unique(word_hash(piece, words, lower=True), return_inverse=True)
    found: dict[int, dict[tuple[int, ...], set[int]]] = {}
    for k, name in enumerate(ids):
        own = (symbols[words.first[k] : words.first[k + 1]] + 1).tolist()
        size = min(window, len(own))
        for i in range(len(own) - size + 1) if size else ():
            owners = found.setdefault(size, {}).setdefault(tuple(own[i : i + size]), set())
            if name is not None:
                owners.add(bisect_left(items, name))
    by_size = {}
    for size, table in found.items():
        owners = [sorted(x) for x in table.values()]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in owners])])
        by_size[size] = (np.array(list(table), dtype=np.int64).reshape(-1, size), offsets, np.array([y for x in owners for y in x], dtype=np.int64))
    return Phrases(known, items, by_size)


def _expand(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, and which range each is from."""
    size = hi - lo
    which = np.repeat(np.arange(len(lo)), size)
    return np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + lo[which], which


def hits(texts: Texts, phrases: Phrases, words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which words are in an occurrence; and pairs (document, number of item) without repeats."""
    hit, none = np.zeros(len(words) + 1, dtype=np.int64), np.zeros(0, dtype=np.int64)
    if not phrases.by_size or not len(words):
        return hit[:-1] > 0, none, none
    at = np.minimum(np.searchsorted(phrases.words, hashes), len(phrases.words) - 1)
    symbols = np.where(phrases.words[at] == hashes, at + 1, 0)
    # Stretches of the benchmark's words inside a document, each with an end after it.
    part = np.ones(len(words) + 1, dtype=bool)
    part[1:-1] = (symbols[1:] == 0) | (symbols[:-1] == 0)
    part[words.first] = True
    start = np.flatnonzero(part)[:-1]
    end = np.flatnonzero(part)[1:]
    keep = (symbols[start] > 0) & (end - start >= min(phrases.by_size))
    start, end = start[keep], end[keep]
    if not len(start):
        return hit[:-1] > 0, none, none
    place, _ = _expand(start, end + 1)
    text = np.where(place < np.repeat(end, end - start + 1), symbols[np.minimum(place, len(words) - 1)], 0)
    index = FMIndex(text, len(phrases.words) + 1)
    doc, pairs = words.doc, []
    for size, (rows, offsets, owners) in phrases.by_size.items():
        lo, hi = index.search(rows)
        suffixes, phrase = _expand(lo, hi)
        begin = place[index.locate(suffixes)]
        np.add.at(hit, begin, 1)
        np.add.at(hit, begin + size, -1)
        seen = np.unique(doc[begin] * len(rows) + phrase) if len(begin) else none
        d, p = seen // len(rows), seen % len(rows)
        item, which = _expand(offsets[p], offsets[p + 1])
        pairs.append(np.unique(d[which] * len(phrases.items) + owners[item]))
    pairs = np.unique(np.concatenate(pairs))
    return np.cumsum(hit[:-1]) > 0, pairs // len(phrases.items), pairs % len(phrases.items)


RANGES = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
FIELDS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("words", RANGES), T.StructField("chars", RANGES), T.StructField("items", T.ArrayType(T.StringType()))])


def finder(phrases: Callable[[], Phrases]):
    """A function for append_struct: number of words, hit words and code points as ranges, items."""

    def find(texts: Texts) -> list:
        block = phrases()
        words = words_of(texts, IS_ALNUM)
        hit, doc, item = hits(texts, block, words, word_hash(texts, words, lower=True))
        edge = np.zeros(len(hit) + 1, dtype=np.int8)
        edge[:-1] += hit
        edge[1:] -= hit
        parts = np.zeros(len(hit) + 1, dtype=bool)  # spans end with their documents
        parts[words.first[:-1]] = True
        open_ = np.flatnonzero(hit & ((edge[:-1] == 1) | parts[:-1]))
        after = np.append(hit[1:], False) if len(hit) else hit
        close = np.flatnonzero(hit & (~after | parts[1:])) + 1
        owner = words.doc[open_]
        points = code_points_before(texts)
        origin = points[texts.offsets[owner]]
        offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))]).astype(np.int32)

        def ranges(a: np.ndarray, b: np.ndarray) -> pa.ListArray:
            return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(a), pa.array(b)], ["start", "end"]))

        in_words = ranges(open_ - words.first[owner], close - words.first[owner])
        in_chars = ranges(points[words.start[open_]] - origin, points[words.end[close - 1]] - origin)
        of_doc = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(texts)))]).astype(np.int32)
        names = pa.array([block.items[i] for i in item], pa.string())
        return [words.count, in_words, in_chars, pa.ListArray.from_arrays(pa.array(of_doc), names)]

    return find


def merged(ranges: Column) -> Column:
    """Sorted ranges that touch or overlap as one."""
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def add(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        return F.when(x["start"] <= last["end"], F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.array_sort(ranges), empty, add)


def covered(ranges: Column) -> Column:
    return F.aggregate(ranges, F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])


def without(text: Column, ranges: Column) -> Column:
    """``text`` without ranges of code points (sorted, apart)."""
    start = F.struct(F.lit("").alias("kept"), F.lit(0).cast("long").alias("at"))

    def cut(done: Column, x: Column) -> Column:
        piece = F.substring(text, (done["at"] + 1).cast("int"), (x["start"] - done["at"]).cast("int"))
        return F.struct(F.concat(done["kept"], piece).alias("kept"), x["end"].alias("at"))

    rest = lambda done: F.concat(done["kept"], F.substring(text, (done["at"] + 1).cast("int"), F.lit(2**31 - 1)))
    return F.when(F.size(ranges) == 0, text).otherwise(F.aggregate(ranges, start, cut, rest))


def find_phrases(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 10, block_bytes: int = 16 << 20, shard_bytes: int = 2 << 20) -> tuple[DataFrame, str]:
    """``docs`` and a struct column of n_words, n_hit, n_items, items (sorted), spans (code points to remove); and its name."""
    rows = benchmark.select(F.col(item).cast("string").alias("id"), F.col(item_text).alias("text")).where("text IS NOT NULL")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-size // block_bytes))
    name, columns, spark = free_name(docs, "found"), [F.col(f"`{c}`") for c in docs.columns], docs.sparkSession
    out, parts = docs, []
    for k in range(n_blocks):
        block = rows.where(F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == k).orderBy("id", "text").toPandas()  # about block_bytes
        shared = spark.sparkContext.broadcast(phrases_of(block["id"].tolist(), pa.array(block["text"].tolist(), pa.string()), window))
        parts.append(free_name(out, f"found_{k}"))
        out = append_struct(out, text, parts[-1], finder(lambda shared=shared: shared.value), FIELDS, shard_bytes)
    gather = lambda field: F.flatten(F.array(*[F.col(f"`{p}`.{field}") for p in parts]))
    in_words, in_chars, items = gather("words"), gather("chars"), F.array_sort(F.array_distinct(gather("items")))
    in_words, in_chars = (in_words, in_chars) if n_blocks == 1 else (merged(in_words), merged(in_chars))
    found = F.struct(F.col(f"`{parts[0]}`.n_words").alias("n_words"), covered(in_words).alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"), in_chars.alias("spans"))
    return out.select(*columns, found.alias(name)), name
