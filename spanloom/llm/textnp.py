"""Words, n-grams and their hashes for whole Arrow batches of texts, with numpy.

A column of texts is one run of UTF-8 bytes with offsets.  Everything here works on that run at once, cut into chunks
of whole documents, so the cost per document is a few array operations and memory follows the chunk, not the batch.
"""

from __future__ import annotations

import ctypes
import functools
import inspect
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U64 = np.uint64
#: White space of the contracts: space and U+0009 to U+000D.
SPACES = bytes([0x20, *range(0x09, 0x0E)])
_rng = np.random.default_rng(20240229)
_TABLE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_BASE = int(_rng.integers(1, 2**60)) * 8 + 5
_INVERSE = pow(_BASE, -1, 2**64)
_LOW = 16


def _powers(base: int, n: int) -> np.ndarray:
    factors = np.full(n, base, dtype=U64)
    factors[0] = 1
    return np.cumprod(factors, dtype=U64)


class _Powers:
    """base ** i mod 2 ** 64 for any array of i, from two small tables."""

    def __init__(self, base: int):
        self.low, self.step, self.high = _powers(base, 1 << _LOW), pow(base, 1 << _LOW, 2**64), np.ones(1, dtype=U64)

    def _grow(self, n: int) -> None:
        if len(self.high) < n:
            self.high = _powers(self.step, max(n, 2 * len(self.high)))

    def upto(self, n: int) -> np.ndarray:
        blocks = (n >> _LOW) + 1
        self._grow(blocks)
        return (self.high[:blocks, None] * self.low[None, :]).ravel()[:n] if blocks > 1 else self.low[:n]

    def at(self, i: np.ndarray) -> np.ndarray:
        if not len(i):
            return np.zeros(0, dtype=U64)
        self._grow((int(i.max()) >> _LOW) + 1)
        return self.high[i >> _LOW] * self.low[i & ((1 << _LOW) - 1)]


_UP, _DOWN = _Powers(_BASE), _Powers(_INVERSE)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(32))


def lut(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


IS_WORD = ~lut(SPACES)
#: Word bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z went to lower case.
IS_ALNUM = lut(bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]))


@dataclass
class Texts:
    """Some documents of a batch: their bytes and where each begins; row: of the first one in its batch."""

    data: np.ndarray
    offsets: np.ndarray
    row: int

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def bytes_of(self, k: int) -> bytes:
        return self.data[self.offsets[k] : self.offsets[k + 1]].tobytes()


def whole(column: pa.Array | pa.ChunkedArray) -> Texts:
    """All texts of a column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    column = pc.fill_null(column.cast(pa.large_string()), "") if column.type != pa.large_binary() else pc.fill_null(column, b"")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return Texts(raw, offs - offs[0], 0)


def chunks(texts: Texts, most: int = 1 << 20) -> Iterator[Texts]:
    """Runs of whole documents of about ``most`` bytes; a longer document stands alone."""
    lo, n = 0, len(texts)
    while lo < n:
        hi = int(np.searchsorted(texts.offsets, texts.offsets[lo] + most, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        a, b = texts.offsets[lo], texts.offsets[hi]
        yield Texts(texts.data[a:b], texts.offsets[lo : hi + 1] - a, texts.row + lo)
        lo = hi


@dataclass
class Words:
    """Words of some texts in order: byte ranges [start, end), and how many each document has (first: offsets)."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.count)


def words_of(texts: Texts, is_word: np.ndarray = IS_WORD) -> Words:
    """Maximal runs of word bytes; none crosses documents."""
    n = len(texts.data)
    mask = np.zeros(n + 2, dtype=bool)
    mask[1:-1] = is_word[texts.data]
    start = mask[1:] & ~mask[:-1]
    end = mask[:-1] & ~mask[1:]
    begins = texts.offsets[(texts.offsets > 0) & (texts.offsets < n)]
    joined = begins[mask[begins] & mask[begins + 1]]  # the last byte before and the first byte after are in words
    start[joined] = True
    end[joined] = True
    s, e = np.flatnonzero(start), np.flatnonzero(end)
    return Words(s, e, np.searchsorted(s, texts.offsets))


def prefix_sums(texts: Texts, lower: bool = False) -> np.ndarray:
    table = _TABLE[LOWER] if lower else _TABLE
    out = np.empty(len(texts.data) + 1, dtype=U64)
    out[0] = 0
    np.cumsum(table[texts.data] * _UP.upto(len(texts.data)), dtype=U64, out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each range, from prefix sums; equal contents and lengths give equal hashes."""
    return mix((sums[end] - sums[start]) * _DOWN.at(start) + (end - start).astype(U64) * U64(0x9E3779B97F4A7C15))


def word_hash(texts: Texts, words: Words, lower: bool = False) -> np.ndarray:
    h = range_hash(prefix_sums(texts, lower), words.start, words.end)
    # Polynomial hashes modulo 2 ** 64 have known collisions only for strings of over a thousand symbols.
    for k in np.flatnonzero(words.end - words.start > 512):
        raw = texts.data[words.start[k] : words.end[k]]
        h[k] = xxhash.xxh64_intdigest((LOWER[raw] if lower else raw).tobytes())
    return h


def grams(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n items that stay in a document, and the offsets of documents in them."""
    count = np.maximum(np.diff(first) - n + 1, 0)
    if len(h) < n:
        return np.zeros(0, dtype=U64), np.zeros(len(first), dtype=np.int64)
    out = h[: len(h) - n + 1].copy()
    for j in range(1, n):
        out *= U64(_BASE)
        out += h[j : len(h) - n + 1 + j]
    keep = np.ones(len(h), dtype=bool)  # the last n - 1 items of each document begin none
    for j in range(1, n):
        last = first[1:] - j
        keep[last[last >= first[:-1]]] = False
    return mix(out[keep[: len(out)]]), np.concatenate([[0], np.cumsum(count)])


def code_points_before(texts: Texts) -> np.ndarray:
    """For each byte position, the number of code points that begin before it."""
    out = np.zeros(len(texts.data) + 1, dtype=np.int64)
    np.cumsum((texts.data & 0xC0) != 0x80, out=out[1:])
    return out


def strings(values: list[str]) -> pa.Array:
    return pa.array(values, pa.string())


def list_array(values: pa.Array, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


def release() -> None:
    """Give freed memory back to the system: Python workers outlive their tasks and would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def releasing(f: Callable) -> Callable:
    """A function for mapInArrow or applyInArrow that leaves no freed memory behind."""
    if inspect.isgeneratorfunction(f):

        def run(batches):
            try:
                yield from f(batches)
            finally:
                release()
    else:

        def run(left, right):
            try:
                return f(left, right)
            finally:
                release()

    return functools.wraps(f)(run)
