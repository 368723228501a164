"""Fill-in-the-middle: cut texts at unit boundaries and put the middle last.

A unit is a run of ASCII letters or one other code point.  Units are counted block by block, and every ``every``-th unit of
a document leaves a checkpoint: its number, its byte and its code point.  A cut is found by binary search in the
checkpoints and a short scan from the one before it, so no list of all units is ever held, however long a text is.

Texts stay in their rows: there is no shuffle.  Cases: a null text is an empty one; an empty text, or one that holds a
sentinel, stays plain; a null seed counts as an empty string.  Rows with equal seeds and texts get equal results, and
columns of any name are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.arrowmap import free_name
from spanloom.llm.textnp import Texts, chunks, lut, releasing, whole

#: What stands before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
IS_LETTER = lut(bytes([*range(0x41, 0x5B), *range(0x61, 0x7B)]))
FIELDS = T.StructType(
    [
        T.StructField("n", T.LongType()),
        T.StructField("form", T.StringType()),
        T.StructField("prefix_chars", T.LongType()),
        T.StructField("middle_chars", T.LongType()),
        T.StructField("output", T.StringType()),
    ]
)


@dataclass
class Checkpoints:
    """Of some texts: where each document's units and code points begin in the whole run, and every so many units where
    a unit begins.  All arrays but ``first_*`` go by checkpoint and rise."""

    texts: Texts
    first_unit: np.ndarray
    first_point: np.ndarray
    unit: np.ndarray
    byte: np.ndarray
    point: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first_unit)

    def cut(self, doc: int, unit: int) -> tuple[int, int]:
        """Byte and code point of the document at which its unit of that number begins; its end for the number of all."""
        origin, end = int(self.texts.offsets[doc]), int(self.texts.offsets[doc + 1])
        if unit >= self.first_unit[doc + 1] - self.first_unit[doc]:
            return end - origin, int(self.first_point[doc + 1] - self.first_point[doc])
        k = int(np.searchsorted(self.unit, self.first_unit[doc] + unit, side="right")) - 1
        at, left = int(self.byte[k]), int(self.first_unit[doc] + unit - self.unit[k])
        point = int(self.point[k])
        reach = max(64, 8 * left)
        while left:
            raw = self.texts.data[at : min(end, at + reach)]
            starts = np.flatnonzero(unit_starts(raw, True))
            if len(starts) > left:
                break
            reach *= 4
        if left:
            stop = int(starts[left])
            point += int(np.count_nonzero((raw[:stop] & 0xC0) != 0x80))
            at += stop
        return at - origin, point - int(self.first_point[doc])


def unit_starts(raw: np.ndarray, first: bool) -> np.ndarray:
    """Which bytes begin a unit.  first: whether the first byte does so even after a letter."""
    letter = IS_LETTER[raw]
    out = (raw & 0xC0) != 0x80
    out[1:] &= ~(letter[1:] & letter[:-1])
    if len(raw) and not first and letter[0]:
        out[0] = False
    return out


def checkpoints(texts: Texts, every: int = 64, block: int = 1 << 18) -> Checkpoints:
    """Count the units of texts a block of bytes at a time; hold one unit of ``every`` of each document."""
    n, offsets = len(texts.data), texts.offsets
    first_unit, first_point = np.zeros(len(offsets), np.int64), np.zeros(len(offsets), np.int64)
    units = points = 0
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for lo in range(0, n, block):
        raw = texts.data[lo : lo + block]
        a, b = np.searchsorted(offsets, [lo, lo + len(raw)])  # documents that begin in this block
        begins = offsets[a:b] - lo
        starts = unit_starts(raw, lo == 0 or not IS_LETTER[texts.data[lo - 1]])
        starts[begins] = True
        at = np.flatnonzero(starts)
        points_before = np.cumsum((raw & 0xC0) != 0x80)
        before = lambda k: points + np.where(k > 0, points_before[k - 1], 0)
        first_unit[a:b] = units + np.searchsorted(at, begins)
        first_point[a:b] = before(begins)
        number = units + np.arange(len(at))
        doc = np.searchsorted(offsets, at + lo, side="right") - 1
        mark = (number - first_unit[doc]) % every == 0
        kept.append((number[mark], at[mark] + lo, before(at[mark])))
        units += len(at)
        points += int(points_before[-1])
    last = offsets >= n
    first_unit[last], first_point[last] = units, points
    empty = np.zeros(0, np.int64)
    unit, byte, point = (np.concatenate(x) for x in zip(*kept, strict=True)) if kept else (empty, empty, empty)
    return Checkpoints(texts, first_unit, first_point, unit, byte, point)


def _infill(texts: Texts, draws: np.ndarray, spm: int, infilled: int, every: int) -> list[list]:
    """Fields for some texts. draws: four numbers of each."""
    index = checkpoints(texts, every)
    marks = [x.encode() for x in (PREFIX, SUFFIX, MIDDLE)]
    p, s, m = marks
    out: list[list] = [index.count.tolist(), [], [], [], []]
    for k, n in enumerate(out[0]):
        raw, (h1, h2, h3, h4) = texts.bytes_of(k), draws[k].tolist()
        if not raw or h3 % 100 >= infilled or any(x in raw for x in marks):
            row = ("plain", None, None, raw)
        else:
            a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
            (from_, before), (to, upto) = index.cut(k, a), index.cut(k, b)
            pre, mid, post = raw[:from_], raw[from_:to], raw[to:]
            form, made = ("spm", [s, post, p, pre, m, mid]) if h4 % 100 < spm else ("psm", [p, pre, s, post, m, mid])
            row = (form, before, upto - before, b"".join(made))
        for column, value in zip(out[1:], row, strict=True):
            column.append(value)
    return out


def fill_in_middle(df: DataFrame, seed: Column, text: str = "text", spm_percent: int = 20, infilled_percent: int = 90, every: int = 64) -> tuple[DataFrame, str]:
    """All columns of ``df`` and a struct of n (units), form (plain, psm or spm), prefix_chars, middle_chars (code points,
    null if plain) and output (text); and the struct's name.

    seed: a string whose SHA-256 draws the cuts (its first two groups of 8 hexadecimal digits, modulo units + 1), whether
    the text is infilled (the third, modulo 100) and whether the suffix goes first (the fourth).  every: units from one
    checkpoint to the next.
    """
    if every < 1:
        raise ValueError("checkpoints need at least one unit between them")
    name, digest = free_name(df, "infilled"), free_name(df, "seed_digest")
    seeded = df.withColumn(digest, F.unhex(F.substring(F.sha2(F.coalesce(seed, F.lit("")), 256), 1, 32)))
    schema = T.StructType([*df.schema.fields, T.StructField(name, FIELDS)])
    at, fields = df.columns.index(text), [f.name for f in FIELDS.fields]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            *columns, seeds = batch.columns
            draws = np.frombuffer(b"".join(seeds.to_pylist()), dtype=">u4").reshape(-1, 4)
            for piece in chunks(whole(columns[at])):
                rows = slice(piece.row, piece.row + len(piece))
                made = [pa.array(x, kind) for x, kind in zip(_infill(piece, draws[rows], spm_percent, infilled_percent, every), kinds, strict=True)]
                made[-1] = made[-1].cast(pa.string())
                struct = pa.StructArray.from_arrays(made, fields)
                yield pa.RecordBatch.from_arrays([*(c.slice(piece.row, len(piece)) for c in columns), struct], names=[*batch.schema.names[:-1], name])

    return seeded.mapInArrow(releasing(run), schema), name


def restored(output: Column, form: Column) -> Column:
    """The text that an output of that form was made of: pieces between sentinels, as none of them is in such a text."""
    part = F.split(output, "<[PSM]>", -1)
    before, after = (F.concat(*[F.get(part, F.lit(i)) for i in order]) for order in ((1, 3, 2), (2, 3, 1)))
    return F.when(form == "plain", output).when(form == "psm", before).when(form == "spm", after)
