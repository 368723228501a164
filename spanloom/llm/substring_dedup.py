"""Removal of repeated word sequences with suffix trees that are partitioned by prefix.

Contexts (see repeats.py) are dealt by prefixes of variable length: of the words from a context's anchor on, the first 1,
2, 4 or 8, whichever is the shortest prefix that at most ``most`` contexts of the corpus have, as counted over all of
them; where even 8 are too frequent, the whole anchor.  Rare prefixes are packed into groups that fit memory.

A group's strings give a suffix for each window; a string with copies gives each twice, as its earliest occurrence and
as its copies.  *Vertically*, suffixes are split again by prefixes: a prefix of more than ``most`` suffixes is made
longer by one word until each fits (or reaches the window's size, where all its suffixes are equal and no tree is
needed), and prefixes are packed into groups of about ``most`` suffixes.  *Horizontally*, each group's subtrees grow one
word a round, for all nodes at once, reading words for those suffixes alone that still share their node with another.
Nodes that reach the depth of a window are the repeats; their leaves are its occurrences, and all removals come from them.

Cases: a null text has no words; texts shorter than a window lose nothing; a document that repeats itself loses
nothing, as only a smaller id is earlier; a row without an id is earlier than no other and loses nothing; rows of equal
id and text get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.anchors import Runs, anchor_runs
from spanloom.llm.arrowmap import append_struct
from spanloom.llm.repeats import Kind, Strings, checked_gram, covered, expand, remove_repeats, same_id_differs, windows_of
from spanloom.llm.textnp import U64, Texts, mix, word_hash, words_of

GRAM = 25
#: Lengths of prefixes by which contexts are dealt.
PREFIXES = (1, 2, 4, 8)
_FACTOR = U64(0x5851F42D4C957F2D)


def word_runs(window: int):
    gram = checked_gram(window, GRAM)

    def runs(texts: Texts) -> tuple[Runs, np.ndarray]:
        words = words_of(texts)
        h = word_hash(texts, words)
        n = max(0, len(h) - gram + 1)
        grams = np.zeros(n, dtype=U64)
        for j in range(gram if n else 0):
            grams *= _FACTOR
            grams += h[j : j + n]
        found = anchor_runs(mix(grams), windows_of(words.first, window), window - gram + 1)
        doc = np.searchsorted(words.first, found.start, side="right") - 1
        found.start = found.start - words.first[doc]
        return found, doc

    return runs


def _extent(window: int):
    def extent(texts: Texts, doc: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words = words_of(texts)
        lo = words.first[doc] + start
        return words.start[lo], words.end[lo + count - 1 + window - 1]

    return extent


def _prefixes(window: int):
    gram = checked_gram(window, GRAM)

    def prefixes(texts: Texts, doc: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Hashes of the first words of anchors, for each length; a length above the anchor's own stops there."""
        words = words_of(texts)
        h, at = word_hash(texts, words), words.first[doc] + anchor
        total, out = np.zeros(len(at), dtype=U64), []
        for j in range(PREFIXES[-1]):
            if j < gram:
                total = total * _FACTOR + h[at + j]
            if j + 1 in PREFIXES:
                out.append(mix(total))
        return np.stack(out, axis=1)

    return prefixes


def prefix_groups(symbols: np.ndarray, suffixes: np.ndarray, window: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of suffixes: (suffix, number of its prefix, length of that prefix)."""
    node, depth, left = np.zeros(len(suffixes), dtype=np.int64), 0, suffixes
    held: list[tuple[np.ndarray, int]] = []
    size = 0
    while len(left) and depth < window:
        _, node, count = np.unique(node * (int(symbols.max()) + 1) + symbols[left + depth], return_inverse=True, return_counts=True)
        depth += 1
        fits = (count <= most)[node] | (depth == window)
        order = np.flatnonzero(fits)[np.argsort(node[fits], kind="stable")]
        for own in np.split(order, np.flatnonzero(np.diff(node[order])) + 1):
            if len(own):
                held.append((left[own], depth))
                size += len(own)
            if size >= most:
                yield _group(held)
                held, size = [], 0
        left, node = left[~fits], node[~fits]
    if held:
        yield _group(held)


def _group(held: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = [len(x) for x, _ in held]
    return np.concatenate([x for x, _ in held]), np.repeat(np.arange(len(held)), sizes), np.repeat([d for _, d in held], sizes)


def deep_nodes(symbols: np.ndarray, suffixes: np.ndarray, node: np.ndarray, depth: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Leaves below nodes of at least the window's depth that have two leaves or more: (suffix, number of the node)."""
    width = int(symbols.max()) + 1
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(suffixes):
        _, node, count = np.unique(node, return_inverse=True, return_counts=True)
        shared = count[node] > 1
        deep = shared & (depth >= window)
        if deep.any():
            done.append((suffixes[deep], node[deep]))
        grow = shared & ~deep
        suffixes, node, depth = suffixes[grow], node[grow], depth[grow]
        node = node * width + symbols[suffixes + depth]
        depth = depth + 1
    if not done:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    base = np.cumsum([0] + [int(n.max()) + 1 for _, n in done])
    return np.concatenate([s for s, _ in done]), np.concatenate([n + b for (_, n), b in zip(done, base, strict=False)])


def earlier_windows(strings: Strings, window: int, most: int = 1 << 16) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """(string, window) pairs that the earliest occurrence of a string loses, as a document of smaller rank has that window,
    and those that its copies lose."""
    none = np.zeros(0, dtype=np.int64)
    texts = Texts(strings.data, strings.offsets, 0)
    words = words_of(texts)
    if not len(words):
        return (none, none), (none, none)
    _, symbols = np.unique(word_hash(texts, words), return_inverse=True)
    n = len(symbols)
    many = np.flatnonzero(strings.copies)
    # Copies are suffixes of a second row of the same words.
    suffixes = np.concatenate([expand(words.first[:-1], strings.count), expand(words.first[many] + n, strings.count[many])])
    owner = np.repeat(np.concatenate([np.arange(len(strings.count)), many]), np.concatenate([strings.count, strings.count[many]]))
    symbols = np.concatenate([symbols, symbols])
    string_of = np.full(len(symbols), -1, dtype=np.int64)
    string_of[suffixes] = owner
    found = [none]
    for group, node, depth in prefix_groups(symbols, suffixes, window, most):
        leaves, node = deep_nodes(symbols, group, node, depth, window)
        if len(leaves):
            doc = np.where(leaves < n, strings.doc[string_of[leaves]], np.iinfo(np.int64).max)
            first = np.full(int(node.max()) + 1, np.iinfo(np.int64).max)
            np.minimum.at(first, node, doc)
            found.append(leaves[doc > first[node]])
    later = np.concatenate(found)
    at, copy = later - words.first[string_of[later]], later >= n
    return (string_of[later[~copy]], at[~copy]), (string_of[later[copy]], at[copy] - n)


def _finish(window: int):
    def finish(texts: Texts, doc: np.ndarray, start: np.ndarray, count: np.ndarray) -> list:
        words = words_of(texts)
        gone = covered(len(words), words.first[doc] + start, count, window)
        total = np.concatenate([[0], np.cumsum(gone)])
        kept = []
        for d in range(len(texts)):
            keep = ~gone[words.first[d] : words.first[d + 1]]
            kept.append(hashlib.sha256(b" ".join(compress(texts.bytes_of(d).split(), keep))).hexdigest())
        return [total[words.first[1:]] - total[words.first[:-1]], kept]

    return finish


def _whole(texts: Texts) -> list:
    return [words_of(texts).count, [hashlib.sha256(b" ".join(texts.bytes_of(d).split())).hexdigest() for d in range(len(texts))]]


def remove_repeated_words(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = 50, most: int = 1 << 12) -> DataFrame:
    """For each row: id, n_words, n_removed, kept_sha256 (of the kept words, joined by one space).  most: contexts that a
    prefix may have."""
    kind = Kind(word_runs(window), _extent(window), _prefixes(window), lambda s: earlier_windows(s, window), True)
    raw = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    zero = F.lit(0).cast("long")
    seal = F.xxhash64(raw) if same_id_differs(docs, id_col) else zero
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), seal.alias("hash"), zero.alias("salt"), raw.alias("text"))
    found = remove_repeats(rows, kind, _finish(window), "n_removed long, kept_sha256 string", len(PREFIXES), most=most)
    fields = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("whole", T.StringType())])
    rows = append_struct(rows, "text", "all", _whole, fields).select("id", "hash", "all.n_words", "all.whole")
    out = rows.join(found, ["id", "hash"], "left")
    return out.select(F.col("id").alias(id_col), "n_words", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"))
