"""Quality rules: statistics of whole texts, and decision lists learned from labelled ones by sequential covering.

A decision list is an ordered list of rules, each a conjunction of thresholds on statistics.  Rules are learned one
after another: *grow* adds the threshold with the largest information gain on two thirds of the labelled rows until no
kept text fits, *prune* drops the last thresholds while that raises the rule's worth on the other third, then the rows
that fit are set aside.  A rule must reach ``min_precision`` on the rows that it was not grown on.  The list becomes one
Spark ``CASE WHEN``: a text that fits a rule is rejected, one that fits none is kept.

Only fitting looks at a sample: ``max_fit_rows`` labelled rows, those whose hashed ids come first.  Statistics and
verdicts cover every row and whole texts.

Cases: a null text has no words, so every statistic is 0; a null or repeated id is judged like any other row; labels
that are null, contradictory or absent leave the list shorter, and without any label only the base rules remain; an
empty table gives an empty result; extra columns are carried along untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.arrowmap import append_struct, free_name
from spanloom.llm.textnp import U64, Texts, code_points_before, grams, lut, mix, range_hash, prefix_sums, word_hash, words_of

SYMBOLS = b"#*$%&|<>"
_SYMBOL = lut(SYMBOLS)
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_chars", "n_upper", "n_digits"]
FIELDS = T.StructType([T.StructField(n, T.LongType()) for n in STATS])
#: Ratios that rules may use: name, numerator, denominator.
FEATURES = [
    ("words", "n_words", None),
    ("chars_per_word", "word_chars", "n_words"),
    ("symbols_per_word", "n_symbols", "n_words"),
    ("dup_line_share", "n_dup_lines", "n_lines"),
    ("repeat_share", "n_repeat_words", "n_words"),
    ("words_per_line", "n_words", "n_lines"),
    ("upper_share", "n_upper", "n_chars"),
    ("digit_share", "n_digits", "n_chars"),
]
_UPPER, _DIGIT = lut(bytes(range(65, 91))), lut(bytes(range(48, 58)))


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _equal_within(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal (doc, h) together, and whether each item equals the one before it there."""
    key = mix(h ^ mix(doc.astype(U64) + U64(1)))
    order = np.argsort(key)
    same = np.zeros(len(key), dtype=bool)
    same[1:] = key[order[1:]] == key[order[:-1]]
    return order, same


def text_stats(texts: Texts) -> list[np.ndarray]:
    """The statistics of STATS for each document."""
    words = words_of(texts)
    docs = np.arange(len(texts))
    points = code_points_before(texts)
    in_words = np.concatenate([[0], np.cumsum(points[words.end] - points[words.start])])
    word_chars = in_words[words.first[1:]] - in_words[words.first[:-1]]
    # Lines: pieces between line feeds and the ends of documents, of which one with no word never counts.
    feed = np.flatnonzero(texts.data == 10)
    start = np.sort(np.concatenate([texts.offsets[:-1], feed + 1]))
    end = np.sort(np.concatenate([feed, texts.offsets[1:]]))
    filled = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    start, end = start[filled], end[filled]
    line_doc = np.searchsorted(texts.offsets, start, side="right") - 1
    lines = range_hash(prefix_sums(texts), start, end)
    for k in np.flatnonzero(end - start > 512):
        lines[k] = xxhash.xxh64_intdigest(texts.data[start[k] : end[k]].tobytes())
    order, same = _equal_within(lines, line_doc)
    dup_lines = np.bincount(line_doc[order[same]], minlength=len(docs))
    # Words in three-word windows that the text has twice or more.
    windows, first = grams(word_hash(texts, words), words.first, 3)
    window_doc = np.repeat(docs, np.diff(first))
    order, same = _equal_within(windows, window_doc)
    twice = same.copy()
    twice[:-1] |= same[1:]
    at = order[twice]
    at = at - first[window_doc[at]] + words.first[window_doc[at]]
    hit = np.zeros(len(words), dtype=bool)
    for j in range(3):
        hit[at + j] = True
    return [
        words.count,
        word_chars,
        _sums(_SYMBOL[texts.data], texts.offsets),
        dup_lines,
        _sums(hit, words.first),
        np.bincount(line_doc, minlength=len(docs)),
        points[texts.offsets[1:]] - points[texts.offsets[:-1]],
        _sums(_UPPER[texts.data], texts.offsets),
        _sums(_DIGIT[texts.data], texts.offsets),
    ]


def with_stats(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` and a struct column ``name`` of STATS."""
    return append_struct(df, text, name, text_stats, FIELDS)


def feature(stats: str, name: str) -> Column:
    _, over, under = next(f for f in FEATURES if f[0] == name)
    top = F.col(f"`{stats}`.{over}").cast("double")
    return top if under is None else F.coalesce(F.try_divide(top, F.col(f"`{stats}`.{under}").cast("double")), F.lit(0.0))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    at: float

    def column(self, stats: str) -> Column:
        x = feature(stats, self.feature)
        return x > F.lit(self.at) if self.above else x <= F.lit(self.at)

    def fits(self, table: dict[str, np.ndarray]) -> np.ndarray:
        x = table[self.feature]
        return x > self.at if self.above else x <= self.at

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.at:.6g}"


Rule = tuple[Condition, ...]


def _fits(rule: Rule, table: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, dtype=bool)
    for c in rule:
        out &= c.fits(table)
    return out


def _best_condition(table: dict[str, np.ndarray], bad: np.ndarray, inside: np.ndarray, n_cuts: int) -> tuple[float, Condition | None]:
    """The threshold with the largest gain: rejects that still fit, times the rise of their share in bits."""
    p0, n0 = int((inside & bad).sum()), int(inside.sum())
    best: tuple[float, Condition | None] = (0.0, None)
    for name, x in table.items():
        values, flags = x[inside], bad[inside]
        order = np.argsort(values, kind="stable")
        values, flags = values[order], np.cumsum(flags[order])
        ends = np.flatnonzero(np.append(values[1:] > values[:-1], False))  # a cut lies between two values
        if len(ends) > n_cuts:
            ends = ends[np.linspace(0, len(ends) - 1, n_cuts).astype(int)]
        if not len(ends):
            continue
        for above in (False, True):
            p = p0 - flags[ends] if above else flags[ends]
            t = n0 - (ends + 1) if above else ends + 1
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / t) - np.log2(p0 / n0)), -1.0)
            k = int(np.argmax(gain))
            if gain[k] > best[0] + 1e-9:
                best = (float(gain[k]), Condition(name, above, float((values[ends[k]] + values[ends[k] + 1]) / 2)))
    return best


def learn_rules(table: dict[str, np.ndarray], bad: np.ndarray, min_precision: float = 0.9, min_cover: int = 5, max_rules: int = 16, max_conditions: int = 4, n_cuts: int = 256) -> list[Rule]:
    """Rules for ``bad`` rows, by growing, pruning and setting aside what each covers.  Deterministic."""
    n = len(bad)
    left, grow = np.ones(n, dtype=bool), np.arange(n) % 3 != 0
    rules: list[Rule] = []
    while len(rules) < max_rules and int((left & bad & grow).sum()) >= min_cover:
        rule: Rule = ()
        inside = left & grow
        while len(rule) < max_conditions and (inside & ~bad).any():
            _, condition = _best_condition(table, bad, inside, n_cuts)
            if condition is None:
                break
            rule = (*rule, condition)
            inside &= condition.fits(table)
        held = left & ~grow

        def worth(r: Rule, held: np.ndarray = held) -> float:
            fit = _fits(r, table, n) & held
            good, all_ = int((fit & bad).sum()), int(fit.sum())
            return (2 * good - all_) / all_ if all_ else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        fit = _fits(rule, table, n) & held
        if not rule or int(fit.sum()) < max(1, min_cover // 2) or (fit & bad).sum() < min_precision * fit.sum():
            break
        rules.append(rule)
        left &= ~_fits(rule, table, n)
    return rules


def fit_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", max_fit_rows: int = 20_000, **how) -> list[Rule]:
    """Learn rules from at most ``max_fit_rows`` labelled rows (label 0: reject).  Only these rows reach the driver."""
    ids = (
        labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(id_col).alias("fit_id"))
        .agg(F.min(label).alias("fit_label"), F.max(label).alias("fit_other"))
        .where("fit_label = fit_other")
        .orderBy(F.xxhash64("fit_id"), "fit_id")
        .limit(max_fit_rows)
    )
    rows = docs.select(F.col(id_col).alias("fit_id"), F.col(text).alias("fit_text")).join(F.broadcast(ids), "fit_id")
    stats = with_stats(rows, "fit_text", "stats").select("fit_id", "fit_label", *[feature("stats", f[0]).alias(f[0]) for f in FEATURES])
    table = stats.orderBy(F.xxhash64("fit_id"), "fit_id", *[f[0] for f in FEATURES]).limit(max_fit_rows).toPandas()
    return learn_rules({f[0]: table[f[0]].to_numpy(float) for f in FEATURES}, table["fit_label"].to_numpy() == 0, **how)


def base_failed(stats: str) -> Column:
    """Fewer than 50 words, or more than half of them in repeated three-word windows."""
    n, repeated = F.col(f"`{stats}`.n_words"), F.col(f"`{stats}`.n_repeat_words")
    return (n < 50) | (100 * repeated > 50 * n)


def rejected_by(rules: list[Rule], stats: str) -> Column:
    """The ordered conditional expression: the number of the first rule that fits, else null."""
    out = F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(rules))):
        fits = F.lit(True)
        for c in rule:
            fits = fits & c.column(stats)
        out = F.when(fits, F.lit(k)).otherwise(out)
    return out


def judge(docs: DataFrame, rules: list[Rule], text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` and a struct column of STATS, base_failed, rule (null: none fits) and kept; and that column's name."""
    name = free_name(docs, "quality_stats")
    out = with_stats(docs, text, name)
    made = F.col(f"`{name}`").withField("base_failed", base_failed(name)).withField("rule", rejected_by(rules, name))
    out = out.withColumn(name, made)
    return out.withColumn(name, F.col(f"`{name}`").withField("kept", ~F.col(f"`{name}`.base_failed") & F.col(f"`{name}`.rule").isNull())), name
