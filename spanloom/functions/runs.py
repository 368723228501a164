"""Rules about single calls: feedback, times, replay budgets, errors of judges, and the request as a judge reads it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words in errors, and the names of roles in a request's text.
TOO_LARGE = ["context length", "context_length", "context window", "maximum context", "prompt is too long", "input is too long", "too many tokens"]
REFUSED = ["insufficient_quota", "credit balance is too low", "budget_exceeded", "budget has been exceeded"]
NOT_ACCOUNT = ["access model", "model_access_denied", "not allowed to access", "content policy", "content_policy", "guardrail", "safety"]
SPEAKERS = {"system": "SYSTEM", "developer": "SYSTEM", "user": "USER", "assistant": "ASSISTANT", "tool": "TOOL RESULT", "function": "TOOL RESULT"}


def feedback(stats: Column) -> tuple[Column, Column]:
    """(mean score, number of scores) of a map from name to (avg, n); names without a mean don't count."""
    scored = F.filter(F.map_values(stats), lambda s: s["avg"].isNotNull())
    total = F.aggregate(scored, F.lit(0.0), lambda a, s: a + s["avg"])
    n = F.aggregate(scored, F.lit(0).cast("long"), lambda a, s: a + F.coalesce(s["n"], F.lit(0)).cast("long"))
    return F.bround(F.try_divide(total, F.size(scored)), 3), F.coalesce(n, F.lit(0).cast("long"))


def _ms(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / 1000


def runtime_ms(start: Column, end: Column) -> Column:
    """Whole milliseconds of a run; 0 if one end is missing."""
    return F.coalesce(_ms(start, end).cast("long"), F.lit(0).cast("long"))


def ttft_ms(start: Column, first_token: Column) -> Column:
    """Whole milliseconds to the first token, not below 0; null if it is not known."""
    return F.when(start.isNotNull() & first_token.isNotNull(), F.greatest(F.lit(0).cast("long"), _ms(start, first_token).cast("long")))


def replay_budget(recorded: Column, output_tokens: Column, output: Column, model_max: Column) -> Column:
    """Tokens that a re-run may write: the recorded limit, else three times the answer and 512 at least; up to the model's."""
    written = F.when(output_tokens > 0, output_tokens).otherwise(F.floor(F.length(F.coalesce(output, F.lit(""))) / 4))
    own = F.when(recorded > 0, recorded).otherwise(F.greatest(F.lit(512), written * 3))
    return F.least(model_max, own).cast("long")


def _has(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.lower(text), w))


def judge_error(error: Column, status: Column) -> Column:
    """What a judge's error is about: request too large, the account, or one request; null without an error."""
    account = ~_has(error, NOT_ACCOUNT) & (F.coalesce(status.isin(401, 403), F.lit(False)) | _has(error, REFUSED))
    return F.when(F.coalesce(error, F.lit("")) != "", F.when(account, "account").when(_has(error, TOO_LARGE), "too large").otherwise("request"))


def request_text(messages: Column, tools: Column) -> Column:
    """A whole conversation for a judge, with the tools' schemas after the leading instructions."""
    names = F.create_map(*[F.lit(x) for pair in SPEAKERS.items() for x in pair])
    said = F.transform(messages, lambda m: F.concat(F.coalesce(F.try_element_at(names, m["role"]), F.upper(m["role"])), F.lit(":\n"), F.coalesce(m["content"], F.lit(""))))
    other = F.transform(messages, lambda m: ~F.coalesce(m["role"].isin("system", "developer"), F.lit(False)))
    first = F.array_position(other, F.lit(True))
    lead = F.when(first > 0, first - 1).otherwise(F.size(messages)).cast("int")
    block = F.array(F.concat(F.lit("TOOLS the model could call:\n"), F.array_join(tools, "\n")))
    with_tools = F.concat(F.slice(said, F.lit(1), lead), block, F.slice(said, lead + 1, F.size(said)))
    return F.array_join(F.when(F.size(tools) > 0, with_tools).otherwise(said), "\n\n")


# What is said of a submitted item that can't run.
TWICE, SAME_LABELS, RESERVED = "duplicate item id", "candidate labels must be unique", "candidate label 'original' is reserved for the original model"
NO_MODEL, LONG_MODEL, NO_USER = "request.model is required", "request.model must be a model name of at most 120 characters", "request.messages needs a user message"


def problems(duplicate: Column, labels: Column, model: Column, roles: Column) -> Column:
    """All problems of a submitted item at once; empty if it can run."""
    checks = [
        F.when(duplicate, TWICE),
        F.when(F.size(F.array_distinct(labels)) != F.size(labels), SAME_LABELS),
        F.when(F.array_contains(labels, "original"), RESERVED),
        F.when(F.coalesce(model, F.lit("")) == "", NO_MODEL).when(F.length(model) > 120, LONG_MODEL),
        F.when(~F.coalesce(F.array_contains(roles, "user"), F.lit(False)), NO_USER),
    ]
    return F.array_compact(F.array(*checks))
