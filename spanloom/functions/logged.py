"""Logged runs and requests as traces: call-sites, versions, usage, budgets, and tool calls with their arguments.

Free-form parts are JSON strings; what cannot be read counts as missing.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import messages as M
from spanloom.functions import runs as R
from spanloom.functions import text as X
from spanloom.functions.messages import _filled, _get, _is, _truthy, let

# Keys of an agent's version, fields of a request that a re-run sends as they were, and roles of a chat.
VERSIONS = ["revision_id", "revision", "ls_revision_id", "LANGSMITH_HOST_REVISION_ID", "LANGSMITH_LANGGRAPH_API_REVISION"]
SENT = ["messages", "tools", "tool_choice", "parallel_tool_calls", "response_format", "temperature", "top_p", "seed", "stop", "reasoning_effort", "frequency_penalty", "presence_penalty"]
CHAT_ROLES = ["system", "developer", "user", "assistant", "tool", "function"]


def _word(v: Column, *paths: str) -> Column:
    """The first text or number under the paths that is not empty."""
    return F.coalesce(*[_filled(_get(v, p, "string")) for p in paths])


def _count(*found: Column) -> Column:
    """The first whole number that is neither missing nor 0, else 0."""
    return F.coalesce(*[F.when(x != 0, x) for x in found], F.lit(0).cast("long"))


def _number(v: Column, *paths: str) -> Column:
    return _count(*[_get(v, p, "long") for p in paths])


def version(meta: Column) -> Column:
    """The agent's version in a run's metadata (a variant); empty if none is stated."""
    return F.coalesce(_word(meta, *[f"$.{k}" for k in VERSIONS]), F.lit(""))


def _key(name: str) -> str:
    """The path of an object's key, in the quotes that it doesn't hold."""
    quote = next((q for q in "'\"" if q not in name), None)
    if quote is None:
        raise ValueError(f"a key with both kinds of quotes can't be looked up: {name}")
    return f"$[{quote}{name}{quote}]"


def call_site(meta: Column, name: Column, project: Column, group_by: str | None = None) -> tuple[Column, Column]:
    """(agent, node) of a run.  ``group_by`` chooses the node: run_name, langgraph_node or ``metadata:<key>``; without it,
    the labels of the metadata come before the run's name."""
    agent = F.coalesce(_word(meta, "$.agent_id", "$.agent"), _filled(project), F.lit("agent"))
    if group_by and group_by.startswith("metadata:"):
        return agent, F.coalesce(_get(meta, _key(group_by.split(":", 1)[1]), "string"), F.lit("unknown"))
    labels = {"run_name": [], "langgraph_node": ["$.langgraph_node"]}.get(group_by or "", ["$.langgraph_node", "$.node"])
    known = [_word(meta, *labels)] if labels else []
    return agent, F.coalesce(*known, _filled(name), F.lit("unknown" if group_by in ("run_name", "langgraph_node") else "node"))


def path(meta: Column) -> Column:
    """Nesting of a run's graph: of its name space (a text or a list), else the graph that the metadata names."""
    space = F.coalesce(*[F.coalesce(F.array_join(_get(meta, p, "array<string>"), "|"), _word(meta, p)) for p in ("$.langgraph_checkpoint_ns", "$.langgraph_path")])
    own = let(F.when(space.isNotNull(), X.graph_path(space, F.lit(None).cast("string"))), _filled)
    return F.coalesce(own, _word(meta, "$.subgraph", "$.graph"), F.lit(""))


def preview(outputs: Column, most: int = 240) -> Column:
    """One line of a run's outputs, cut with an ellipsis; empty for empty outputs."""
    v = F.try_parse_json(outputs)
    line = F.translate(F.when(v.isNull(), outputs).otherwise(F.to_json(_truthy(v))), "\n", " ")
    return F.coalesce(F.when(F.length(line) > most, F.concat(F.substring(line, 1, most), F.lit("…"))).otherwise(line), F.lit(""))


def tool_calls(outputs: Column) -> Column:
    """(name, args) of each tool that the answer calls, in order; args is a JSON object with sorted keys, and holds what is
    no object under ``_``."""
    return let(F.try_parse_json(outputs), _calls)


def _calls(raw: Column) -> Column:
    def read(c: Column) -> Column:
        call = F.when(_is(_get(c, "$.function", "variant"), "OBJECT"), _get(c, "$.function", "variant")).otherwise(c)
        given = lambda o: F.coalesce(_get(o, "$.arguments", "variant"), _get(o, "$.args", "variant"), F.parse_json(F.lit("{}")))
        parsed = lambda v: F.coalesce(F.when(_is(v, "STRING"), F.try_parse_json(_get(v, "$", "string"))), v)
        args = lambda v: F.when(_is(v, "OBJECT"), F.to_json(v)).otherwise(F.concat(F.lit('{"_":'), F.to_json(v), F.lit("}")))
        return let(call, lambda o: F.struct(_get(o, "$.name", "string").alias("name"), let(let(given(o), parsed), args).alias("args")))

    found = F.transform(F.filter(M.called(raw), lambda c: _is(c, "OBJECT")), read)
    return F.coalesce(F.filter(found, lambda c: c["name"] != ""), F.array().cast("array<struct<name:string,args:string>>"))


def _lines(text: Column, calls: Column) -> Column:
    said = F.transform(calls, lambda c: F.concat(F.lit("[calls "), F.coalesce(c["name"], F.lit("?")), F.lit("("), F.coalesce(c["args"], F.lit("{}")), F.lit(")]")))
    return F.array_join(F.concat(F.array_compact(F.array(let(X.strip(text), _filled))), said), "\n")


def behaviour(outputs: Column) -> Column:
    """All that a run did, as text: what it said, and a line for each tool call."""
    return let(F.try_parse_json(outputs), _behaviour)


def _behaviour(raw: Column) -> Column:
    text = let(_get(M._generation(raw), "$.message", "variant"), lambda said: F.when(_is(said, "OBJECT"), X.strip(M.content(M._said_by(said)))))
    return F.coalesce(let(_lines(text, _calls(raw)), _filled), X.strip(M.answer(raw)))


def rendered(text: Column, calls: Column) -> Column:
    """A model's behaviour for a judge; says so where there is none."""
    return F.coalesce(_filled(_lines(text, F.coalesce(calls, F.array().cast("array<struct<name:string,args:string>>")))), F.lit("(empty output)"))


def neutral_tools(tools: Column) -> Column:
    """(name, description, schema) of the tools of ``tools_defined``, from either provider's key for the schema."""

    def read(t: Column) -> Column:
        v = F.try_parse_json(t["schema_json"])
        schema = F.coalesce(_truthy(_get(v, "$.input_schema", "variant")), _truthy(_get(v, "$.parameters", "variant")), F.parse_json(F.lit('{"type":"object","properties":{}}')))
        about = F.substring(F.coalesce(_get(v, "$.description", "string"), F.lit("")), 1, 1024)
        return F.struct(F.coalesce(_get(v, "$.name", "string"), t["name"]).alias("name"), about.alias("description"), F.to_json(schema).alias("schema"))

    return F.transform(F.filter(tools, lambda t: F.try_parse_json(t["schema_json"]).isNotNull()), read)


def budget(sent: Column, meta: Column) -> Column:
    """Tokens that the original might write, under any usual name; 0 if unknown."""
    own = [_get(sent, f"$.{k}", "long") for k in ("max_output_tokens", "max_tokens", "max_completion_tokens")]
    return _count(*own, _get(meta, "$.max_output_tokens", "long"), _get(meta, "$.ls_max_tokens", "long"))


def thinking(sent: Column, usage: Column, outputs: Column, details: Column) -> Column:
    """Whether a run reasoned: it counted reasoning tokens, or was sent a switch for them."""
    counted = F.coalesce(_truthy(_get(usage, "$.completion_tokens_details", "variant")), _truthy(details), _get(outputs, "$.llm_output.completion_tokens_details", "variant"))
    switches = [_truthy(_get(sent, f"$.{k}", "variant")) for k in ("reasoning_effort", "thinking", "thinking_budget", "reasoning", "extra_body.thinking")]
    return (_count(_get(counted, "$.reasoning_tokens", "long"), _get(usage, "$.reasoning_tokens", "long")) > 0) | F.coalesce(*switches).isNotNull()


def run_trace(project: str = "", group_by: str | None = None) -> list[Column]:
    """Columns of a trace over raw runs (``sources.logs.RAW_RUN``) of type llm.  For whole tables see ``run_traces``."""
    extra = F.try_parse_json("extra")
    return _run_trace(F.try_parse_json("outputs"), _get(extra, "$.metadata", "variant"), _get(extra, "$.invocation_params", "variant"), project, group_by)


def run_traces(rows: DataFrame, project: str = "", group_by: str | None = None, more: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """A table of ``run_trace``; JSON is read once for each row, not once for each column.  ``more``: further columns, of the run's
    metadata."""
    read = rows.withColumns({"outputs_": F.try_parse_json("outputs"), "extra_": F.try_parse_json("extra")})
    read = read.withColumns({"meta_": _get(F.col("extra_"), "$.metadata", "variant"), "sent_": _get(F.col("extra_"), "$.invocation_params", "variant")})
    own = [of(F.col("meta_")).alias(name) for name, of in (more or {}).items()]
    return read.select(*own, *_run_trace(F.col("outputs_"), F.col("meta_"), F.col("sent_"), project, group_by))


def _run_trace(outputs: Column, meta: Column, sent: Column, project: str, group_by: str | None) -> list[Column]:
    # Each column is bound on its own (see ``let``): written out side by side, all of them would be one piece of code too large for
    # the JVM to compile.
    of_usage = lambda use: let(_get(outputs, "$.llm_output.token_usage", "variant"), use)
    details = lambda kind: F.try_parse_json(f"{kind}_tokens_details")
    tokens = lambda kind: of_usage(lambda u: F.coalesce(F.col(f"{kind}_tokens").try_cast("long"), _get(u, f"$.{kind}_tokens", "long"), F.lit(0).cast("long")))
    read = lambda u: _count(*[_get(u, f"$.{k}", "long") for k in ("cache_read_input_tokens", "cache_read", "input_token_details.cache_read")], _get(details("prompt"), "$.cached_tokens", "long"))
    began = F.col("start_time").try_cast("timestamp")
    score, n_scores = R.feedback(F.coalesce(F.from_json("feedback_stats", "map<string,struct<avg:double,n:bigint>>"), F.create_map().cast("map<string,struct<avg:double,n:bigint>>")))
    own_tools = lambda v: F.coalesce(_truthy(_get(v, "$.tools", "variant")), _truthy(_get(v, "$.functions", "variant")))
    columns = {
        "trace_id": F.substring(F.coalesce(_filled(F.col("trace_id")), F.col("id"), F.lit("")), 1, 64),
        "agent_id": let(meta, lambda m: call_site(m, F.col("name"), F.lit(project), group_by)[0]),
        "node_id": let(meta, lambda m: call_site(m, F.col("name"), F.lit(project), group_by)[1]),
        "graph_path": let(meta, path),
        "owner": let(meta, lambda m: F.coalesce(_word(m, "$.owner", "$.team"), F.lit("n/a"))),
        "task_type": let(meta, lambda m: F.coalesce(_word(m, "$.task_type", "$.ls_task"), F.lit("unknown"))),
        "model_raw": let(sent, lambda v: F.coalesce(_word(v, "$.model", "$.model_name"), _word(meta, "$.ls_model_name"), F.lit(""))),
        "input_messages": M.messages(F.col("inputs")),
        "output": let(outputs, _behaviour),
        "tools_called": M.names_called(outputs),
        "tools_defined": M.tools_defined(F.to_json(let(sent, own_tools))),
        "tool_choice": F.to_json(_get(sent, "$.tool_choice", "variant")),
        "thinking_enabled": let(sent, lambda v: of_usage(lambda u: thinking(v, u, outputs, details("completion")))),
        "input_tokens": tokens("prompt"),
        "output_tokens": tokens("completion"),
        "cached_tokens": of_usage(read),
        "cache_write_tokens": of_usage(lambda u: _number(u, "$.cache_creation_input_tokens", "$.cache_creation", "$.input_token_details.cache_creation")),
        "max_output_tokens": let(sent, lambda v: budget(v, meta)),
        "cost_platform": F.col("total_cost").try_cast("double"),
        "revision": let(meta, version),
        "error": F.coalesce(F.col("error"), F.lit("")),
        "start_time": F.coalesce(F.col("start_time"), F.lit("")),
        "source": let(meta, lambda m: F.coalesce(_filled(F.lit(project)), _word(m, "$.ls_project"), F.lit(""))),
        "runtime_ms": R.runtime_ms(began, F.col("end_time").try_cast("timestamp")),
        "ttft_ms": R.ttft_ms(began, F.col("first_token_time").try_cast("timestamp")),
        "feedback_score": score,
        "feedback_n": n_scores,
    }
    return [c.alias(n) for n, c in columns.items()]


def as_sent(body: Column) -> Column:
    """The fields of a request (a variant) that a re-run sends as they were, as JSON; null unless its messages are a chat's."""
    stated = lambda v: F.when(~_is(v, "VOID"), v)

    def read(body: Column) -> Column:
        is_chat = lambda chat: (F.size(chat) > 0) & F.forall(chat, lambda m: F.coalesce(_get(m, "$.role", "string").isin(CHAT_ROLES), F.lit(False)))
        valid = let(_get(body, "$.messages", "array<variant>"), is_chat)
        return F.when(valid, F.to_json(F.struct(*[let(_get(body, f"$.{k}", "variant"), stated).alias(k) for k in SENT])))

    return let(body, read)


def request_trace(request: Column, response: Column) -> list[Column]:
    """Columns of a trace over a logged request and its response.  For whole tables see ``request_traces``."""
    asked, reply = F.try_parse_json(request), F.try_parse_json(response)
    body = F.when(_is(asked, "OBJECT"), asked)
    chat = _chat(asked, body)
    return _request_trace(body, reply, chat, _system(chat), _outputs(reply))


def request_traces(rows: DataFrame, request: str, response: str) -> DataFrame:
    """A table of ``request_trace``; JSON is read once for each row, not once for each column."""
    read = rows.select(F.try_parse_json(request).alias("asked_"), F.try_parse_json(response).alias("reply_"))
    read = read.withColumns({"body_": F.when(_is(F.col("asked_"), "OBJECT"), F.col("asked_")), "outputs_": _outputs(F.col("reply_"))})
    read = read.withColumn("chat_", _chat(F.col("asked_"), F.col("body_")))
    read = read.withColumn("system_", _system(F.col("chat_")))
    return read.select(*_request_trace(*[F.col(c) for c in ("body_", "reply_", "chat_", "system_", "outputs_")]))


def _chat(asked: Column, body: Column) -> Column:
    return M.messages(F.to_json(F.when(body.isNotNull(), _get(body, "$.messages", "variant")).otherwise(asked)))


def _system(chat: Column) -> Column:
    return X.strip(F.array_join(F.transform(F.filter(chat, lambda m: m["role"] == "system"), lambda m: m["content"]), "\n"))


def _outputs(reply: Column) -> Column:
    """A response's message as the outputs of a run, a variant."""
    message = F.coalesce(F.to_json(_get(reply, "$.choices[0].message", "variant")), F.lit("{}"))
    return F.try_parse_json(F.concat(F.lit('{"generations":[[{"message":'), message, F.lit("}]]}")))


def _request_trace(body: Column, reply: Column, chat: Column, system: Column, outputs: Column) -> list[Column]:
    of_usage = lambda use: let(_get(reply, "$.usage", "variant"), use)
    written = lambda u: _number(u, "$.cache_creation_input_tokens", "$.cacheWriteInputTokens")

    def used(u: Column) -> tuple[Column, Column]:
        read = _number(u, "$.cache_read_input_tokens", "$.cacheReadInputTokens", "$.cachedContentTokenCount", "$.total_cached_tokens")
        return X.usage_of(_get(u, "$.prompt_tokens", "long"), _get(u, "$.input_tokens", "long"), read, _get(u, "$.prompt_tokens_details.cached_tokens", "long"), written(u))

    columns = {
        "trace_id": F.substring(F.coalesce(_get(reply, "$.id", "string"), F.lit("")), 1, 64),
        "node_id": let(system, X.fingerprint),
        "model_raw": let(reply, lambda r: F.coalesce(_word(r, "$.model"), _word(body, "$.model"), F.lit(""))),
        "input_messages": chat,
        "output": let(outputs, _behaviour),
        "tools_called": M.names_called(outputs),
        "tools_defined": M.tools_defined(F.to_json(_get(body, "$.tools", "variant"))),
        "tool_choice": F.to_json(_get(body, "$.tool_choice", "variant")),
        "input_tokens": of_usage(lambda u: (used(u)[0] + used(u)[1] + written(u)).cast("long")),
        "output_tokens": of_usage(lambda u: _number(u, "$.output_tokens", "$.completion_tokens")),
        "cached_tokens": of_usage(lambda u: used(u)[1].cast("long")),
        "max_output_tokens": let(body, lambda b: _number(b, "$.max_tokens", "$.max_completion_tokens")),
        "logged_request": as_sent(body),
    }
    return [c.alias(n) for n, c in columns.items()]


# What is said of a trace that lacks something.
NO_AGENT, NO_MESSAGES, NO_USER, NO_TOKENS = "missing agent_id", "no input_messages", "no user turn", "no input_tokens"
UNKNOWN_MODEL, NOT_IN_CATALOG = "unknown model", "(not in the model catalog)"


def trace_problems(agent: Column, roles: Column, input_tokens: Column, model: Column, known: Column) -> Column:
    """What is wrong with a trace; a model that is not known is a warning."""
    checks = [
        F.when(F.coalesce(agent, F.lit("")) == "", NO_AGENT),
        F.when(F.coalesce(F.size(roles), F.lit(0)) <= 0, NO_MESSAGES).when(~F.array_contains(roles, "user"), NO_USER),
        F.when(F.coalesce(input_tokens, F.lit(0)) <= 0, NO_TOKENS),
        F.when(~F.coalesce(known, F.lit(False)), F.concat(F.lit(f"{UNKNOWN_MODEL} '"), F.coalesce(model, F.lit("")), F.lit(f"' {NOT_IN_CATALOG}"))),
    ]
    return F.array_compact(F.array(*checks))


def valid(problems: Column) -> Column:
    """No problem but a model that is not known."""
    return F.size(F.filter(problems, lambda p: ~F.startswith(p, F.lit(UNKNOWN_MODEL)))) == 0


def _keyed(root: object, word: str) -> Iterator[tuple[str, str]]:
    waiting = [("", root)]
    while waiting:
        at, node = waiting.pop()
        if isinstance(node, dict):
            inside = [(f"{at}.{name}" if at else name, value) for name, value in node.items()]
            hits = [pair for pair, name in zip(inside, node, strict=True) if word in name.lower()]
            yield from ((where, v if isinstance(v, str) else json.dumps(v, separators=(",", ":"))) for where, v in hits)
        else:
            inside = [(f"{at}[{i}]", value) for i, value in enumerate(node)] if isinstance(node, list) else []
        waiting += inside[::-1]


def keys_with(raw: Column, word: str) -> Column:
    """(path, value) of every key of a JSON text, at any depth, whose name has ``word`` (lower case)."""

    @F.pandas_udf("array<struct<path:string,value:string>>")
    def found(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[tuple[str, str]]:
            try:
                return list(_keyed(json.loads(text or "null"), word))
            except (ValueError, RecursionError):
                return []

        return texts.map(one)

    return found(raw)
