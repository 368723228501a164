"""Scalar functions of the trace model as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Platform roles and message classes to the four roles of a trace.
ROLES = {
    "human": "user",
    "humanmessage": "user",
    "user": "user",
    "ai": "assistant",
    "aimessage": "assistant",
    "assistant": "assistant",
    "system": "system",
    "systemmessage": "system",
    "tool": "tool",
    "toolmessage": "tool",
    "function": "tool",
    "functionmessage": "tool",
}
# Names of scaffolding that are no identity of a node.
SCAFFOLDING = ["", "langgraph", "runnablesequence", "runnableparallel", "runnablelambda", "runnableassign", "__start__", "__end__", "channelwrite", "_write", "_route"]


def norm_role(role: Column) -> Column:
    """Role of a message; an unknown or missing one is the user's."""
    known = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(role)), F.lit("user"))


def strip(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")


def is_generic(name: Column) -> Column:
    return F.lower(F.trim(F.coalesce(name, F.lit("")))).isin(SCAFFOLDING)


def approx_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(text, F.lit(""))) / 4)).cast("long")


def eligible(error: Column, output: Column) -> Column:
    """ok, or why an answer cannot be used; an error with an answer means that the agent recovered."""
    empty = strip(output) == ""
    failed = F.coalesce(error, F.lit("")) != ""
    return F.when(failed & empty, "errored, no output").when(empty, "empty output").otherwise("ok")


def masked(text: Column) -> Column:
    """Digits as #, lower case, without white space around."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\d+", "#"), r"(?U)^\s+|\s+$", ""))


def out_shape(text: Column) -> Column:
    s = strip(text)
    words = F.size(F.split(s, r"(?U)\s+"))
    first = F.substring(s, 1, 1)
    return F.when(s == "", "empty").when(first.isin("{", "["), "json").when((words <= 4) & ~F.contains(s, F.lit("\n")), "label").otherwise("prose")


def is_json(text: Column) -> Column:
    """Whether an answer parses as JSON, inside a code fence or not."""
    s = strip(text)
    body = F.regexp_replace(F.regexp_replace(s, r"^```[^\n]*\n?", ""), r"```\s*$", "")
    s = F.when(F.startswith(s, F.lit("```")), strip(body)).otherwise(s)
    return F.coalesce(F.substring(s, 1, 1).isin("{", "[") & F.try_parse_json(s).isNotNull(), F.lit(False))


def digest(text: Column, most: int = 1400, head: int = 900, tail: int = 400) -> Column:
    """A long message as its head and tail."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, head), F.lit("\n[...]\n"), F.substring(text, -tail, tail))).otherwise(text)


def omitted(text: Column, most: int = 1400, head: int = 900, tail: int = 400) -> Column:
    """A long message as its head and tail, and how much lies between; empty for null."""
    text = F.coalesce(text, F.lit(""))
    # Fixed value: the words between head and tail.
    between = F.format_string("\n...[%d chars omitted]...\n", F.length(text) - (head + tail))
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, head), between, F.substring(text, -tail, tail))).otherwise(text)


def fingerprint(system: Column) -> Column:
    """Name of a call-site by its system prompt: its first four words and a hash in which digits don't count."""
    words = F.regexp_extract_all(F.lower(system), F.lit("([a-z0-9]+)"), 1)
    name = F.array_join(F.slice(words, 1, 4), "-")
    return F.when(F.trim(F.coalesce(system, F.lit(""))) == "", F.lit("no-system-prompt")).otherwise(F.concat(name, F.lit("-"), F.substring(F.sha1(F.regexp_replace(system, r"[0-9]+", "#")), 1, 6)))


def graph_path(namespace: Column, own: Column) -> Column:
    """Path of a nested graph: the parts of its name space before their colon, without scaffolding and its own name."""
    parts = F.transform(F.split(F.coalesce(namespace, F.lit("")), r"\|"), lambda s: F.trim(F.substring_index(s, ":", 1)))
    return F.array_join(F.filter(parts, lambda s: ~is_generic(s) & ~s.eqNullSafe(own)), "/")


def round_even(x: Column, digits: int) -> Column:
    """A double to some digits as SQL's round_even has it: scaled as a double, halves to even.  ``bround`` goes by the shortest
    decimal text instead: 0.575 is 0.58 there, but 57.49999999999999 hundredths, so 0.57, here."""
    return F.rint(x * 10.0**digits) / 10.0**digits


def first_filled(*columns: Column) -> Column:
    return F.coalesce(*[F.when(c != "", c) for c in columns], F.lit(""))


def cost_usd(usage: dict[str, Column], price: dict[str, Column], digits: int = 6) -> Column:
    """Dollars of a call, to some digits; null without a price.  A cache-write price of 0 counts as 1.25 times the input's."""
    write = F.coalesce(F.when(price["cache_write"] != 0, price["cache_write"]), price["input"] * 1.25)
    read = F.coalesce(price["cache_read"], price["input"] * 0.1)
    total = usage["input"] * price["input"] + usage["output"] * price["output"] + usage["cache_read"] * read + usage["cache_write"] * write
    return F.bround(total / 1e6, digits)


def usage_of(prompt: Column, input_tokens: Column, read: Column, nested_read: Column, write: Column) -> tuple[Column, Column]:
    """(input, cache_read) tokens of either provider's shape: a stated input wins, else the prompt less what was cached."""
    zero = F.lit(0)
    cached = F.greatest(F.coalesce(read, zero), F.coalesce(nested_read, zero))
    rest = F.greatest(zero, F.coalesce(prompt, zero) - cached - F.coalesce(write, zero))
    return F.coalesce(F.when(input_tokens != 0, input_tokens), rest), cached


# How judges' replies state a verdict, what each word means, and what is said where no reason is given.
FIT_LINE = r"(?m)^\W*(?:[Vv]erdict\W*)?(EQUIVALENT|VARIATION|DRIFT|UNSURE|KEPT|BROKE)\b(.*)$"
FIT_YES, FIT_NO, FIT_ALIKE, FIT_OPEN = ["EQUIVALENT", "VARIATION", "KEPT"], ["DRIFT", "BROKE"], "VARIATION", "UNSURE"
AROUND_REASON = r"^[ \t:.\-–—*_`|]+|[ \t:.\-–—*_`|]+$"
SAID_YES, SAID_NO, SAID_OPEN, SAID_NOTHING = "matches the set", "differs from the set", "the judge is unsure", "no verdict in the judge's reply"
NUMBERED_REASON = r"(?m)^\s*(\d+)\s*[:\-]\s*(.+)$"
DIVERGENT_LIST, CONSISTENT_COUNT = r"(?mi)^\W*DIVERGENT\b[:\s]*(none|[0-9, ]+)", r"(?i)CONSISTENT\W*(\d+)\s*/\s*\d+"


def parse_fit(reply: Column) -> tuple[Column, Column]:
    """(kept, reason) of a judge's reply: the first line that starts with a verdict; null if unsure or unreadable."""
    word = F.regexp_extract(F.coalesce(reply, F.lit("")), FIT_LINE, 1)
    kept = F.when(word.isin(FIT_YES), True).when(word.isin(FIT_NO), False)
    tail = F.regexp_replace(F.regexp_extract(F.coalesce(reply, F.lit("")), FIT_LINE, 2), AROUND_REASON, "")
    default = F.when(kept, SAID_YES).when(~kept, SAID_NO).otherwise(SAID_OPEN)
    reason = F.coalesce(F.when(tail != "", F.substring(tail, 1, 240)), default)
    said = F.when(word == FIT_ALIKE, F.concat(F.lit("acceptable: "), reason)).when(word == FIT_OPEN, F.concat(F.lit("unclear: "), reason)).otherwise(reason)
    return kept, F.when(word == "", SAID_NOTHING).otherwise(said)


def _divergent(reply: Column, total: Column) -> tuple[Column, Column]:
    """The list of divergent answers as it stands in a reply ('' if there is none), and their numbers, in order."""
    listed = F.regexp_extract(F.coalesce(reply, F.lit("")), DIVERGENT_LIST, 1)
    numbers = F.transform(F.regexp_extract_all(listed, F.lit("([0-9]+)"), 1), lambda x: x.try_cast("int"))
    return listed, F.array_sort(F.array_distinct(F.filter(numbers, lambda n: (n >= 1) & (n <= total))))


def parse_coherence(reply: Column, total: Column) -> Column:
    """How many of ``total`` answers agree: those not listed as divergent, else the stated count; null if unreadable."""
    listed, numbers = _divergent(reply, total)
    divergent = F.size(numbers)
    stated = F.regexp_extract(F.coalesce(reply, F.lit("")), CONSISTENT_COUNT, 1).try_cast("int")
    return F.when(listed != "", total - divergent).otherwise(F.greatest(F.lit(0), F.least(stated, total)) + stated * 0)


def coherence(reply: Column, total: Column) -> Column:
    """(agree, divergent: numbers in order, reasons: (number, reason) in order, of several for one answer the last); null where the
    reply has no readable count."""
    agree, (_, divergent) = parse_coherence(reply, total), _divergent(reply, total)
    text = F.coalesce(reply, F.lit(""))
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(NUMBERED_REASON), 1).alias("n"), F.regexp_extract_all(text, F.lit(NUMBERED_REASON), 2).alias("why"))
    of = lambda k: F.try_element_at(F.filter(found, lambda x: x["n"].try_cast("int") == k), F.lit(-1))["why"]
    numbers = F.filter(F.sequence(F.lit(1), F.greatest(total.cast("int"), F.lit(1))), lambda k: (k <= total) & of(k).isNotNull())
    reasons = F.transform(numbers, lambda k: F.struct(k.alias("number"), F.substring(strip(of(k)), 1, 120).alias("reason")))
    return F.when(agree.isNotNull(), F.struct(agree.alias("agree"), divergent.alias("divergent"), reasons.alias("reasons")))
