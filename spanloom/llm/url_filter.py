"""URL allow and block lists with a blocked Bloom filter before an exact hash join.  DataFrame functions only.

A listed entry is a host and the beginning of a path.  It fits a URL whose host is the entry's or a subdomain of it
and whose path starts with the entry's path; of the entries that fit, the longest one decides.

The filter is blocked: one 64-bit word a block, four bits a key, so a test reads a single word.  It holds the listed
hosts, and the pairs of host and path.  A URL's host and domains above it are tested first, so most URLs end there; for
those that pass, the beginnings of the path that have a listed length.  Only possible hits are exploded and meet the list
in a hash join, which removes the false positives; rows none of whose domains pass go by it unshuffled, also where the filter
is too large for a literal.

Cases: a null URL or one without ``://`` has an empty host and path and fits no entry; repeated rows each get their
own row of the result; entries listed twice count once, and of two verdicts for one entry the larger string (block)
wins; an empty list leaves every URL to ``default``; other columns of the input are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.arrowmap import free_name
from spanloom.llm.store import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bloom filters up to so many 64-bit words (128 KiB) travel as a literal with the plan, larger ones up to so many more as a
#: broadcast table (word, bits); beyond that they are joined by hash, and adaptive execution splits frequent words.
LITERAL_WORDS = 1 << 14
BROADCAST_WORDS = 1 << 20
#: Lists up to so many entries are broadcast in the exact join.
BROADCAST_ENTRIES = 100_000


def url_host(url: Column) -> Column:
    rest = F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _word(h: Column, words: int) -> Column:
    return F.pmod(h, F.lit(words)).cast("int")


def _mask(key: Column) -> Column:
    h = F.xxhash64(key, F.lit(7))
    places = [F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int") for k in range(4)]
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), p) for p in places]
    return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2]).bitwiseOR(bits[3])


def bloom_words(entries: DataFrame, key: str, words: int) -> DataFrame:
    """The filter as rows (word, bits); words that are 0 have no row."""
    return entries.groupBy(_word(F.xxhash64(key), words).alias("word")).agg(F.bit_or(_mask(F.col(key))).alias("bits"))


def judge_urls(pages: DataFrame, entries: DataFrame, url: str = "url", id_col: str = "page_id", default: str = "allow", bits_per_key: int = 32, literal_words: int = LITERAL_WORDS, broadcast_words: int = BROADCAST_WORDS, broadcast_entries: int = BROADCAST_ENTRIES) -> DataFrame:
    """``id_col``, host, path, rule (null if none fits) and verdict of each row of ``pages``.

    entries: host, path, verdict.  literal_words, broadcast_words, broadcast_entries: sizes up to which the filter is a
    literal, the filter is broadcast, and the list is broadcast; beyond them both are joined by hash.
    """
    listed = (
        entries.where(F.col("host").isNotNull() & F.col("path").isNotNull())
        .groupBy(F.translate("host", UPPER, LOWER).alias("host"), "path")
        .agg(F.max("verdict").alias("verdict"))
        .select("host", "path", "verdict", F.concat("host", "path").alias("rule"), F.concat_ws("\x00", "host", "path").alias("key"))
    )
    # Shapes: bounded by the longest host and path of the list, not by its length.
    shape = listed.agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.size(F.split("host", r"\."))).alias("labels"), F.collect_set(F.length("path")).alias("chars")).first()
    rid, hits, hit, host, path = (free_name(pages, x) for x in ("row_id", "hits", "hit", "host_", "path_"))
    rows = pages.select(F.col(f"`{id_col}`").alias(id_col), url_host(F.col(f"`{url}`")).alias(host), url_path(F.col(f"`{url}`")).alias(path))
    shown = [F.col(id_col), F.col(host).alias("host"), F.col(path).alias("path")]
    none = F.lit(None).cast("string")
    if not shape.n:
        return rows.select(*shown, none.alias("rule"), F.lit(default).alias("verdict"))
    keyed = listed.select("key").union(listed.select(F.concat("host", F.lit("\x00"))).distinct())
    words = max(8, 2 * shape.n * bits_per_key // 64)
    ints = lambda xs: F.array(*[F.lit(x) for x in sorted(xs)])
    dots = F.length(host) - F.length(F.replace(F.col(host), F.lit("."), F.lit("")))
    above = F.transform(F.filter(ints(shape.labels), lambda m: (F.col(host) != "") & (dots >= m - 1)), lambda m: F.concat(F.call_function("substring_index", F.col(host), F.lit("."), -m), F.lit("\x00")))
    lengths = F.filter(ints(shape.chars), lambda c: F.length(path) >= c)
    paths = lambda h: F.transform(lengths, lambda c: F.concat(h, F.substring(F.col(path), F.lit(1), c)))
    right = listed.select(F.col("key").alias(hit), "rule", F.col("verdict").alias("listed_verdict"), F.length("rule").alias("rule_chars"), F.length("host").alias("host_chars"))
    right = F.broadcast(right) if shape.n <= broadcast_entries else right
    best = F.max(F.when(F.col("rule").isNotNull(), F.struct("rule_chars", "host_chars", "rule", "listed_verdict"))).alias("best")
    judged = lambda possible: possible.join(right, hit, "left").groupBy(rid, id_col, host, path).agg(best).select(*shown, F.col("best.rule").alias("rule"), F.coalesce("best.listed_verdict", F.lit(default)).alias("verdict"))
    if words <= literal_words:
        found = {r.word: r.bits for r in bloom_words(keyed, "key", words).collect()}  # at most literal_words rows
        bits = F.array(*[F.lit(found.get(i, 0)).cast("long") for i in range(words)])
        passes = lambda k: F.get(bits, _word(F.xxhash64(k), words)).bitwiseAND(_mask(k)) == _mask(k)
        rows = rows.withColumn(hits, F.filter(F.flatten(F.transform(F.filter(above, passes), paths)), passes))
        clean = rows.where(F.size(hits) == 0).select(*shown, none.alias("rule"), F.lit(default).alias("verdict"))
        return judged(rows.where(F.size(hits) > 0).withColumn(rid, F.monotonically_increasing_id()).select(rid, id_col, host, path, F.explode(hits).alias(hit))).unionByName(clean)
    word, met_bits, above_hits = (free_name(pages, x) for x in ("word", "bloom_bits", "above_hits"))
    table = written(bloom_words(keyed, "key", words).select(F.col("word").alias(word), F.col("bits").alias(met_bits)), "url-words")
    table = F.broadcast(table) if words <= broadcast_words else table  # at most ``words`` rows of two numbers

    def passing(keys: DataFrame, key: str) -> DataFrame:
        """Keys that cannot be listed as null."""
        met = keys.withColumn(word, _word(F.xxhash64(F.col(key)), words)).join(table, word, "left")
        return met.withColumn(key, F.when(F.col(met_bits).bitwiseAND(_mask(F.col(key))) == _mask(F.col(key)), F.col(key))).drop(word, met_bits)

    # Each listed length of a host is tested where the row lies; rows that pass none are done.
    names = [free_name(pages, f"above_{m}") for m in sorted(shape.labels)]
    for m, name in zip(sorted(shape.labels), names, strict=True):
        key = F.concat(F.call_function("substring_index", F.col(host), F.lit("."), F.lit(-m)), F.lit("\x00"))
        rows = passing(rows.withColumn(name, F.when((F.col(host) != "") & (dots >= m - 1), key)), name)
    rows = rows.withColumn(above_hits, F.array_compact(F.array(*names))).drop(*names)
    clean = rows.where(F.size(above_hits) == 0).select(*shown, none.alias("rule"), F.lit(default).alias("verdict"))
    possible = rows.where(F.size(above_hits) > 0).withColumn(rid, F.monotonically_increasing_id())
    pairs = possible.select(rid, id_col, host, path, F.explode_outer(F.flatten(F.transform(above_hits, paths))).alias(hit))
    return judged(passing(pairs, hit)).unionByName(clean)


def entries_of(spark, rules: list[tuple[str, str, str]]) -> DataFrame:
    """A list of (verdict, host, path) as a table, made without Python rows."""
    made = F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for v, h, p in rules])
    return spark.range(1).select(F.inline(made))
