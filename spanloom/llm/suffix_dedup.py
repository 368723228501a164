"""Removal of repeated byte strings by a column-wise suffix construction over many documents at once.

A group's strings (see repeats.py) are sorted as in the multi-string algorithms that insert one symbol of every string a
round: round j puts the suffixes of length j of all strings into the collection's Burrows-Wheeler transform.  A suffix's
place follows from the place of the next shorter one and the count of its symbol before it, and its common prefix with
its neighbours from the earlier round's values between them: one sequential pass over the transform gives both.  The
transform and the common prefixes lie in two files that are read and written in turn, front to back, so memory holds
only a few numbers for each string.  Runs of common prefixes of at least the window's size are equal windows.

The files are in the task's own temporary folder, have 2 bytes for each byte of a group's strings (4 for windows of 256
bytes and more; a group has some megabytes) and go with the task; a lost task writes them again.

Cases: a null text is empty; texts shorter than a window lose nothing; a row without an id is earlier than no other row
and loses only what it repeats itself; ids as in repeats.py; rows of equal id and text get equal results; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.anchors import Runs, anchor_runs
from spanloom.llm.repeats import NO_ID, Kind, Strings, checked_gram, covered, expand, remove_repeats, same_id_differs, windows_of
from spanloom.llm.textnp import Texts, prefix_sums, range_hash

GRAM = 32


def _upto(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Least of values[0 .. i] for each i of ``at``."""
    if not len(at):
        return np.zeros(0, dtype=np.int64)
    order = np.argsort(at)
    ordered = at[order]
    cuts = np.minimum(np.append(0, ordered[:-1] + 1), ordered)
    out = np.empty(len(at), dtype=np.int64)
    out[order] = np.minimum.accumulate(np.minimum.reduceat(values[: ordered[-1] + 1], cuts).astype(np.int64))
    return out


class Collection:
    """Burrows-Wheeler transform and capped common prefixes of some strings, built column by column.

    An entry is the symbol before the suffix, plus 1 (8 bits; 0: none), and above it the suffix's common prefix with the
    entry before.  UTF-8 has no byte 255, so the symbols fit.
    """

    BLOCK = 1 << 18
    PLACE, LOW = np.uint32(24), np.uint32(0xFFFFFF)

    def __init__(self, data: np.ndarray, offsets: np.ndarray, cap: int):
        self.n, self.cap, self.data = len(offsets) - 1, cap, data
        self.start, self.size = offsets[:-1], np.diff(offsets)
        self.total = int(self.size.sum()) + self.n
        self.kind = np.uint16 if cap < 256 else np.uint32
        self.folder = tempfile.TemporaryDirectory()
        self.numbers = np.arange(self.BLOCK, dtype=np.uint32)
        self.symbols = np.arange(257, dtype=np.uint32) << self.PLACE
        self.files = [np.memmap(f"{self.folder.name}/{k}", dtype=self.kind, mode="w+", shape=(max(1, self.total),)) for k in "ab"]

    def close(self) -> None:
        self.files = []
        self.folder.cleanup()

    def _before(self, string: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The symbol before a start, plus 1; 0 at the string's own start."""
        if not len(self.data):
            return np.zeros(len(string), dtype=np.int64)
        return np.where(at > 0, self.data[np.maximum(self.start[string] + at - 1, 0)].astype(np.int64) + 1, 0)

    def build(self) -> np.ndarray:
        """All entries in order of their suffixes (a view of the last file)."""
        old, new = self.files
        live, length, size = np.arange(self.n), self.size.copy(), self.n
        symbol = self._before(live, length)
        old[: self.n] = symbol
        counts = np.bincount(symbol, minlength=256)
        place, going = live, symbol > 0
        while True:
            live, place, symbol = live[going], place[going], symbol[going]
            if not len(live):
                return old[:size]
            target, at, common = self._places(old[:size], place, symbol, counts)
            order = np.argsort(target)
            live, place = live[order], target[order]
            length[live] -= 1
            symbol = self._before(live, length[live])
            self._merge(old, new, size, place, symbol)
            size += len(live)
            new[at] = (new[at] & self.kind(0xFF)) | (common << 8).astype(self.kind)
            counts += np.bincount(symbol, minlength=256)
            old, new = new, old
            going = symbol > 0

    def _places(self, old: np.ndarray, place: np.ndarray, symbol: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the next longer suffixes go, and the places whose common prefix changes, with its new value.

        One pass over the transform, front to back.  The suffix that an entry's symbol and suffix make goes after the
        empty ones, smaller symbols, and equal symbols before.  Its common prefix with the one before it is one more than
        that of the two shorter suffixes: the least of the earlier round's values from one to the other.
        """
        first = np.append(0, self.n + np.cumsum(counts[1:]) - counts[1:])
        target = np.empty(len(place), dtype=np.int64)
        running = np.zeros(256, dtype=np.int64)
        least = np.full(256, -1, dtype=np.int64)  # common prefixes since each symbol's last entry; -1: had none
        waiting = np.zeros(256, dtype=bool)  # the last entry of a symbol is new, so the next one's value changes
        places, values = [], []
        for lo in range(0, len(old), self.BLOCK):
            block = np.asarray(old[lo : lo + self.BLOCK])
            n, common = len(block), block >> self.kind(8)
            # Symbols with their places in the block, sorted: each symbol's places stand together in order.
            keys = np.sort(((block & self.kind(0xFF)).astype(np.uint32) << self.PLACE) | self.numbers[:n])
            begin = np.searchsorted(keys, self.symbols)
            a, b = np.searchsorted(place, [lo, lo + n])
            own = symbol[a:b]
            k = np.searchsorted(keys, (own.astype(np.uint32) << self.PLACE) | (place[a:b] - lo).astype(np.uint32))
            target[a:b] = first[own] + running[own] + k - begin[own]
            last = k + 1 == begin[own + 1]
            here = begin[1:] > begin[:-1]
            changed = np.zeros(n + 1, dtype=bool)
            changed[k] = True
            changed[k[~last] + 1] = True
            changed[begin[:-1][waiting & here]] = True
            waiting[here] = False
            waiting[own[last]] = True
            k = np.flatnonzero(changed[:n])
            own, at = (keys[k] >> self.PLACE).astype(np.int64), (keys[k] & self.LOW).astype(np.int64)
            value = np.full(len(k), -1, dtype=np.int64)
            inner = k > begin[own]
            value[inner] = self._between(common, (keys[k[inner] - 1] & self.LOW).astype(np.int64) + 1, at[inner])
            outer = np.flatnonzero(~inner)
            if lo:
                value[outer] = np.where(least[own[outer]] < 0, -1, np.minimum(least[own[outer]], _upto(common, at[outer])))
            places.append(first[own] + running[own] + k - begin[own])
            values.append(np.minimum(value + 1, self.cap))
            if lo + n < len(old):
                after = (keys[begin[1:][here] - 1] & self.LOW).astype(np.int64) + 1
                rest = np.full(len(after), self.cap, dtype=np.int64)
                rest[after < n] = _upto(common[::-1], n - 1 - after[after < n])
                known = ~here & (least >= 0)
                least[known] = np.minimum(least[known], int(common.min()))
                least[here] = rest
            running += np.diff(begin)
        return target, np.concatenate(places), np.concatenate(values)

    @staticmethod
    def _between(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Least of values[lo .. hi] for each pair."""
        order = np.argsort(-lo)  # so that what lies between two ranges is not read
        ends = np.empty(2 * len(lo), dtype=np.int64)
        ends[0::2], ends[1::2] = lo[order], np.minimum(hi[order] + 1, len(values) - 1)
        if not len(lo):
            return ends
        out = np.empty(len(lo), dtype=np.int64)
        # An end beyond the values is left out of its range and looked at by itself.
        out[order] = np.minimum(np.minimum.reduceat(values, ends)[0::2], values[hi[order]])
        return out

    def _merge(self, old: np.ndarray, new: np.ndarray, size: int, target: np.ndarray, symbol: np.ndarray) -> None:
        """Front to back: new entries at their targets, old ones in order around them."""
        read = 0
        for lo in range(0, size + len(target), self.BLOCK):
            hi = min(size + len(target), lo + self.BLOCK)
            a, b = np.searchsorted(target, [lo, hi])
            took = hi - lo - (b - a)
            block, kept = np.empty(hi - lo, dtype=self.kind), np.ones(hi - lo, dtype=bool)
            kept[target[a:b] - lo] = False
            block[kept] = old[read : read + took]
            block[~kept] = symbol[a:b]
            new[lo:hi] = block
            read += took

    def suffixes(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """String and start of the suffix of each of all entries: from the empty suffixes up, a symbol at a time."""
        order = np.argsort((entries & self.kind(0xFF)).astype(np.uint8), kind="stable")
        up = np.empty(self.total, dtype=np.uint32)
        up[order] = np.arange(self.total, dtype=np.uint32)
        string, start = np.empty(self.total, dtype=np.uint32), np.empty(self.total, dtype=np.uint32)
        row, own, at = np.arange(self.n), np.arange(self.n), self.size.copy()
        while len(own):
            string[row], start[row] = own, at
            more = at > 0
            row, own, at = up[row[more]], own[more], at[more] - 1
        return string, start


def earlier_windows(strings: Strings, window: int) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """(string, window) pairs that the earliest occurrence of a string loses, and those that its copies lose.

    A run of common prefixes of at least ``window`` is one window of several strings: all but the earliest lose it.  A
    string that stands for copies is in the collection once; each of its windows is a run by itself at least, of which
    only the earliest occurrence can stay.  A string whose anchor no other has makes a collection of its own, with
    nothing to sort.
    """
    none = np.zeros(0, dtype=np.int64)
    many = np.flatnonzero(strings.copies)
    copies = np.repeat(many, strings.count[many]), expand(np.zeros(len(many), dtype=np.int64), strings.count[many])
    _, group, size = np.unique(strings.gram, return_inverse=True, return_counts=True)
    chosen = np.flatnonzero(size[group] > 1)
    if not len(chosen):
        return (none, none), copies
    length = np.diff(strings.offsets)[chosen]
    collection = Collection(strings.data[expand(strings.offsets[chosen], length)], np.append(0, np.cumsum(length)), window)
    try:
        entries = collection.build()
        equal = entries >> collection.kind(8) >= window
        member = equal | np.append(equal[1:], False)
        local, at = (x[member].astype(np.int64) for x in collection.suffixes(entries))
        del entries
    finally:
        collection.close()
    if not len(local):
        return (none, none), copies
    string, cls = chosen[local], np.cumsum(~equal[member])
    group = group[string]  # a document that is to be kept apart has anchors of its own
    order = np.lexsort((strings.start[string] + at, strings.doc[string], group, cls))
    later = np.append(False, (cls[order][1:] == cls[order][:-1]) & (group[order][1:] == group[order][:-1]))
    return (string[order][later], at[order][later]), copies


def byte_runs(window: int):
    gram = checked_gram(window, GRAM)

    def runs(texts: Texts) -> tuple[Runs, np.ndarray]:
        at = np.arange(max(0, len(texts.data) - gram + 1))
        found = anchor_runs(range_hash(prefix_sums(texts), at, at + gram), windows_of(texts.offsets, window), window - gram + 1)
        doc = np.searchsorted(texts.offsets, found.start, side="right") - 1
        found.start = found.start - texts.offsets[doc]
        return found, doc

    return runs


def _extent(window: int):
    def extent(texts: Texts, doc: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lo = texts.offsets[doc] + start
        return lo, lo + count - 1 + window

    return extent


def _finish(window: int):
    def finish(texts: Texts, doc: np.ndarray, start: np.ndarray, count: np.ndarray) -> list:
        gone = covered(len(texts.data), texts.offsets[doc] + start, count, window)
        total = np.concatenate([[0], np.cumsum(gone)])
        begins = gone & ~np.append(False, gone[:-1])
        inner = texts.offsets[:-1][np.diff(texts.offsets) > 0]
        begins[inner] = gone[inner]  # spans end with their documents
        spans = np.concatenate([[0], np.cumsum(begins)])
        a, b = texts.offsets[:-1], texts.offsets[1:]
        kept = [hashlib.sha256(texts.data[i:j][~gone[i:j]].tobytes()).hexdigest() for i, j in zip(a, b, strict=True)]
        return [total[b] - total[a], spans[b] - spans[a], kept]

    return finish


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = 100) -> DataFrame:
    """For each row: id, n_bytes, n_removed, n_spans, kept_sha256."""
    kind = Kind(byte_runs(window), _extent(window), None, lambda s: earlier_windows(s, window), False)
    raw = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    zero, given = F.lit(0).cast("long"), F.col(f"`{id_col}`").isNotNull()
    own = F.xxhash64(raw)
    seal = own if same_id_differs(docs, id_col) else F.when(given, zero).otherwise(own)
    salt = F.when(given, zero).otherwise(own.bitwiseOR(F.lit(1).cast("long")))
    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("id"), seal.alias("hash"), salt.alias("salt"), raw.alias("text"))
    found = remove_repeats(rows, kind, _finish(window), "n_removed long, n_spans long, kept_sha256 string")
    sizes = rows.select("id", "hash", "salt", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.encode("text", "UTF-8"), 256).alias("whole"))
    out = sizes.join(found, ["id", "hash"], "left")
    shown = F.when(F.col("salt") == 0, F.col("id")).alias(id_col)
    return out.select(shown, "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"))
