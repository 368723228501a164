"""Rows of a large table by whether their key is listed, where the list is too long to be broadcast.

A blocked Bloom filter of the list (see url_filter.py), of bounded size, is broadcast as a table of words and tested where
rows lie.  Only rows that pass are shuffled to meet the list, which decides; so what is shuffled follows the rows listed and
a few false hits, not the table with its texts.  A longer list makes more false hits, never other results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.arrowmap import free_name
from spanloom.llm.store import written
from spanloom.llm.url_filter import _mask, _word, bloom_words

#: Lists of up to so many keys are broadcast.
BROADCAST_IDS = 500_000
#: At most so many 64-bit words of a filter, of 16 bits a key below that.
MOST_WORDS = 1 << 19


def sifted(rows: DataFrame, key: str, listed: DataFrame, at: str, most_words: int = MOST_WORDS) -> tuple[DataFrame, DataFrame]:
    """Rows whose ``key`` may be in column ``at`` of ``listed``, and those whose key is not (or is null)."""
    n = listed.count()
    words = max(8, min(most_words, n * 16 // 64))
    word, bits = free_name(rows, "sift_word"), free_name(rows, "sift_bits")
    table = written(bloom_words(listed, at, words).select(F.col("word").alias(word), F.col("bits").alias(bits)), "sift")
    own = F.col(f"`{key}`")
    met = rows.withColumn(word, _word(F.xxhash64(own), words)).join(F.broadcast(table), word, "left")
    passes = F.coalesce(own.isNotNull() & (F.col(bits).bitwiseAND(_mask(own)) == _mask(own)), F.lit(False))
    plain = [F.col(f"`{c}`") for c in rows.columns]
    return met.where(passes).select(*plain), met.where(~passes).select(*plain)


def not_listed(rows: DataFrame, key: str, listed: DataFrame, at: str) -> DataFrame:
    """Rows whose ``key`` is not in column ``at`` of ``listed``."""
    met = F.col(f"`{key}`") == F.col(at)
    if listed.count() <= BROADCAST_IDS:
        return rows.join(F.broadcast(listed), met, "left_anti")
    may, never = sifted(rows, key, listed, at)
    return never.unionByName(may.join(listed, met, "left_anti"))


def only_listed(rows: DataFrame, key: str, listed: DataFrame, at: str, how: str = "left_semi") -> DataFrame:
    """Rows whose ``key`` is in column ``at`` of ``listed``; with how="inner", and the other columns of ``listed``."""
    if listed.count() <= BROADCAST_IDS:
        listed = F.broadcast(listed)
    else:
        rows = sifted(rows, key, listed, at)[0]
    return rows.join(listed, F.col(f"`{key}`") == F.col(at), how)
