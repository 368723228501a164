"""Language identification: scripts narrow the candidates, then Viterbi over per-word scores labels spans.

A model holds log-likelihoods of hashed byte n-grams of words (with marks for a word's ends) for each language, and
the scripts in which each language was seen.  Every word is scored once for each distinct form in a piece of text.
Languages that were not seen in a word's script are no candidates for it (a script that no language was seen in rules
none out).  Viterbi then finds the best path of languages through a document's words, where each change costs
``switch_cost`` nats.  The path is computed in blocks: max-plus matrices for all blocks of all documents at once, then
one pass over each document's blocks, so long texts cost no Python step per word.

Training reads texts and labels of at most about ``max_train_docs`` documents per language (those whose hashed ids come
first); prediction covers every whole text and sees the text alone.

Cases: a null text, or one without letters, is ``und`` with score 0 and no spans; of tied languages the first in order
of name wins; null labels are not trained on; with no labelled row everything is ``und``; repeated rows and extra
columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from spanloom.llm.arrowmap import append_struct
from spanloom.llm.textnp import LOWER, U64, Texts, Words, chunks, code_points_before, lut, mix, releasing, whole, word_hash, words_of

UND = "und"
#: Bytes that may be in words here: ASCII letters and all bytes beyond ASCII.
_WORD = lut(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))
_ORDERS = (1, 2, 3, 4)
_BITS = 16
SCRIPTS = ["latin", "greek", "cyrillic", "armenian_hebrew", "arabic", "indic", "kana", "han", "hangul", "other"]


def _script_table() -> np.ndarray:
    """Script by the first two bytes of a UTF-8 sequence (the Unicode blocks that they stand for)."""
    table = np.full((256, 256), SCRIPTS.index("other"), dtype=np.uint8)
    ranges = [
        ("latin", 0x41, 0x024F),
        ("latin", 0x1E00, 0x1EFF),
        ("greek", 0x0370, 0x03FF),
        ("greek", 0x1F00, 0x1FFF),
        ("cyrillic", 0x0400, 0x052F),
        ("armenian_hebrew", 0x0530, 0x05FF),
        ("arabic", 0x0600, 0x077F),
        ("indic", 0x0900, 0x0DFF),
        ("kana", 0x3040, 0x30FF),
        ("han", 0x3400, 0x9FFF),
        ("hangul", 0xAC00, 0xD7A3),
    ]
    for name, lo, hi in ranges:
        for point in range(lo, hi + 1, 1 if hi < 0x800 else 64):
            raw = chr(point).encode()
            table[raw[0], raw[1] if len(raw) > 1 else slice(None)] = SCRIPTS.index(name)
    return table


_SCRIPT = _script_table()


def scripts_of(texts: Texts, start: np.ndarray) -> np.ndarray:
    """The script of the character at each position."""
    after = np.minimum(start + 1, max(0, len(texts.data) - 1))
    return _SCRIPT[texts.data[start], texts.data[after]]


def _features(texts: Texts, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of some words, and which word each belongs to."""
    size = end - start + 2
    first = np.concatenate([[0], np.cumsum(size)])
    padded = np.full(first[-1], 32, dtype=np.uint8)
    word = np.repeat(np.arange(len(start)), size)
    inner = np.ones(first[-1], dtype=bool)
    inner[first[:-1]] = False
    inner[first[1:] - 1] = False
    shift = np.repeat(start - first[:-1] - 1, size)
    padded[inner] = LOWER[texts.data[np.flatnonzero(inner) + shift[inner]]]
    h = np.zeros(len(padded), dtype=U64)
    buckets, owners = [], []
    for n in range(1, max(_ORDERS) + 1):
        m = len(padded) - n + 1
        if m <= 0:
            break
        h = h[:m] * U64(257) + padded[n - 1 :].astype(U64) + U64(1)
        whole_gram = word[:m] == word[n - 1 :]
        if n == 1:
            whole_gram &= inner
        buckets.append((mix(h[whole_gram] + U64(n * 0x9E3779B97F4A7C15 % 2**64)) >> U64(64 - _BITS)).astype(np.int64))
        owners.append(word[:m][whole_gram])
    if not buckets:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(buckets), np.concatenate(owners)


@dataclass
class Model:
    """weights: (n-gram bucket, language); allowed: (script, language)."""

    languages: list[str]
    weights: np.ndarray
    allowed: np.ndarray
    switch_cost: float


def _train_rows(docs: DataFrame, text: str, lang: str, id_col: str, where: Column, most: int) -> DataFrame:
    """About ``most`` labelled rows of each language, by hashed id; a language with fewer gives all."""
    rows = docs.select(F.col(id_col).alias("train_id"), F.col(text).alias("train_text"), F.col(lang).alias("train_lang")).where(where)
    rows = rows.where(F.col("train_lang").isNotNull() & F.col("train_text").isNotNull())
    sizes = rows.groupBy("train_lang").agg(F.count(F.lit(1)).alias("n"))
    share = sizes.select("train_lang", F.least(F.lit(1.0), F.lit(float(most)) / F.col("n")).alias("share"))
    place = F.pmod(F.xxhash64("train_id"), F.lit(1 << 20)) / float(1 << 20)
    return rows.join(F.broadcast(share), "train_lang").where(place < F.col("share")).select("train_text", "train_lang")


def train(docs: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id", where: Column | None = None, max_train_docs: int = 3000, switch_cost: float = 6.0, smoothing: float = 0.5) -> Model:
    """Counts are summed by Spark; what reaches the driver is bounded by languages times n-gram buckets."""
    rows = _train_rows(docs, text, lang, id_col, F.lit(True) if where is None else where, max_train_docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names = np.array(batch.column(1).to_pylist(), dtype=object)
            for piece in chunks(whole(batch.column(0))):
                words = words_of(piece, _WORD)
                own = names[piece.row : piece.row + len(piece)]
                for name in sorted(set(own)):
                    mine = (own == name)[words.doc] if len(words) else np.zeros(0, bool)
                    table = sums.setdefault(name, np.zeros((1 << _BITS) + len(SCRIPTS), dtype=np.int64))
                    buckets, _ = _features(piece, words.start[mine], words.end[mine])
                    table[: 1 << _BITS] += np.bincount(buckets, minlength=1 << _BITS)
                    table[1 << _BITS :] += np.bincount(scripts_of(piece, words.start[mine]), minlength=len(SCRIPTS))
        for name, table in sums.items():
            at = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(table[at])], names=["lang", "bucket", "n"])

    counted = rows.mapInArrow(releasing(count), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(set(counted["lang"]))
    table = np.zeros(((1 << _BITS) + len(SCRIPTS), len(languages)))
    table[counted["bucket"].to_numpy(), [languages.index(x) for x in counted["lang"]]] = counted["n"]
    grams, scripts = table[: 1 << _BITS] + smoothing, table[1 << _BITS :]
    weights = np.log(grams / grams.sum(axis=0)) if languages else grams
    weights = weights - weights.mean(axis=1, keepdims=True) if languages else weights
    allowed = scripts / np.maximum(scripts.sum(axis=0), 1) >= 0.001 if languages else scripts > 0
    allowed[~allowed.any(axis=1)] = True
    return Model(languages, weights.astype(np.float32), allowed, switch_cost)


def word_scores(model: Model, texts: Texts, words: Words) -> np.ndarray:
    """(word, language) scores; each distinct word is scored once."""
    if not len(words):
        return np.zeros((0, len(model.languages)), dtype=np.float32)
    _, at, back = np.unique(word_hash(texts, words, lower=True), return_index=True, return_inverse=True)
    start, end = words.start[at], words.end[at]
    buckets, owner = _features(texts, start, end)
    out = np.empty((len(at), len(model.languages)), dtype=np.float32)
    for j in range(len(model.languages)):
        out[:, j] = np.bincount(owner, weights=model.weights[buckets, j], minlength=len(at)) / len(_ORDERS)
    out[~model.allowed[scripts_of(texts, start)]] = -1e4
    return out[back]


def viterbi(scores: np.ndarray, first: np.ndarray, switch_cost: float, block: int = 64) -> np.ndarray:
    """The best language of each word; documents are ranges of words, given by offsets."""
    n, k = scores.shape
    path = np.zeros(n, dtype=np.int16)
    count = np.diff(first)
    blocks = -(-count // block)
    b0 = np.concatenate([[0], np.cumsum(blocks)])
    nb = int(b0[-1])
    if not nb:
        return path
    doc = np.repeat(np.arange(len(count)), blocks)
    nth = np.arange(nb) - b0[doc]
    begin = first[doc] + nth * block
    length = np.minimum(block, first[doc + 1] - begin)
    order = np.argsort(-length, kind="stable")  # blocks that still have words stand first
    live = np.searchsorted(-length[order], -np.arange(block), side="left")
    begin_o = begin[order]
    moves = np.full((nb, k, k), -np.inf, dtype=np.float32)
    moves[:, np.arange(k), np.arange(k)] = 0
    for t in range(block):
        if m := int(live[t]):
            x = moves[:m]
            moves[:m] = np.maximum(x, x.max(axis=2, keepdims=True) - switch_cost) + scores[begin_o[:m] + t][:, None, :]
    by_block = np.empty_like(moves)
    by_block[order] = moves
    # Through each document's blocks, all documents at once.
    entry = np.zeros((nb, k), dtype=np.float32)
    last = np.zeros((len(count), k), dtype=np.float32)
    by_count = np.argsort(-blocks, kind="stable")
    docs_with = np.searchsorted(-blocks[by_count], -np.arange(int(blocks.max())), side="left")
    for i, m in enumerate(docs_with):
        d = by_count[:m]
        b = b0[d] + i
        entry[b] = last[d]
        last[d] = (last[d][:, :, None] + by_block[b]).max(axis=1)
        last[d] -= last[d].max(axis=1, keepdims=True)
    leave = np.zeros(nb, dtype=np.int64)
    state = last.argmax(axis=1)
    for i in range(len(docs_with) - 1, -1, -1):
        d = by_count[: docs_with[i]]
        b = b0[d] + i
        leave[b] = state[d]
        state[d] = (entry[b] + by_block[b, :, state[d]]).argmax(axis=1)
    # Inside each block, from what it is entered with to the state that it is left in.
    value = entry[order].copy()
    came = np.zeros((block, nb, k), dtype=np.int16)
    for t in range(block):
        if m := int(live[t]):
            v = value[:m]
            best = v.argmax(axis=1)
            other = v[np.arange(m), best][:, None] - switch_cost
            came[t, :m] = np.where(v >= other, np.arange(k), best[:, None])
            value[:m] = np.maximum(v, other) + scores[begin_o[:m] + t]
    at = leave[order]
    for t in range(block - 1, -1, -1):
        if m := int(live[t]):
            path[begin_o[:m] + t] = at[:m]
            at[:m] = came[t, np.arange(m), at[:m]]
    return path


FIELDS = T.StructType(
    [
        T.StructField("lang", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("n_spans", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("lang", T.StringType())]))),
    ]
)


def _has_letters(texts: Texts, k: int) -> bool:
    return any(c.isalpha() for c in texts.bytes_of(k).decode("utf-8", "replace"))


def predictor(model: Model):
    """A function for append_struct: language, score, and spans in code points."""
    names = np.array([*model.languages, UND], dtype=object)

    def predict(texts: Texts) -> list:
        n, k = len(texts), len(model.languages)
        words = words_of(texts, _WORD)
        ascii_letters = np.zeros(n, dtype=bool)
        ascii_letters[words.doc[texts.data[words.start] < 128]] = True
        known = ascii_letters if k else np.zeros(n, dtype=bool)
        for d in np.flatnonzero(~ascii_letters & (words.count > 0)) if k else ():
            known[d] = _has_letters(texts, d)
        if not k:
            empty = pa.array([[]] * n, to_arrow_type(FIELDS["spans"].dataType))
            return [[UND] * n, np.zeros(n), np.zeros(n, np.int64), empty]
        path = viterbi(word_scores(model, texts, words), words.first, model.switch_cost)
        points = code_points_before(texts)
        start, end = points[words.start], points[words.end]
        doc = words.doc
        # A document's language has the most characters on the path; its score is their share.
        mass = np.bincount(doc * k + path, weights=end - start, minlength=n * k).reshape(n, k)
        best = mass.argmax(axis=1)
        total = mass.sum(axis=1)
        score = np.where(known & (total > 0), mass[np.arange(n), best] / np.maximum(total, 1), 0.0)
        opens = np.ones(len(words), dtype=bool)
        opens[1:] = (doc[1:] != doc[:-1]) | (path[1:] != path[:-1])
        opens &= known[doc] if len(words) else opens
        o = np.flatnonzero(opens)
        closes = np.ones(len(words), dtype=bool)
        closes[:-1] = (doc[1:] != doc[:-1]) | (path[1:] != path[:-1])
        c = np.flatnonzero(closes & known[doc]) if len(words) else o
        origin = points[texts.offsets[:-1]]
        spans = pa.StructArray.from_arrays([pa.array(start[o] - origin[doc[o]]), pa.array(end[c] - origin[doc[o]]), pa.array(names[path[o]], pa.string())], ["start", "end", "lang"])
        n_spans = np.bincount(doc[o], minlength=n)
        offsets = np.concatenate([[0], np.cumsum(n_spans)]).astype(np.int32)
        return [names[np.where(known, best, k)], score, n_spans, pa.ListArray.from_arrays(pa.array(offsets), spans)]

    return predict


def identify(docs: DataFrame, model: Model, name: str, text: str = "text") -> DataFrame:
    """``docs`` and a struct column ``name``: lang, score, n_spans, spans."""
    return append_struct(docs, text, name, predictor(model), FIELDS)
