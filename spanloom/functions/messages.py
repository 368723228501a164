"""Free-form JSON of runs to messages, answers and tool calls, by VARIANT paths.

Arguments are JSON strings or variants; what cannot be read is empty, never an error.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.functions.text import norm_role


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def let(x: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of x, computed once for each row however often it is used.  Without it, an expression that is used at several
    places is written out at each, and so is all that it is made of."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def _kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING or the like; VOID for a missing one."""
    return F.coalesce(F.substring_index(F.schema_of_variant(v), "<", 1), F.lit("VOID"))


def _is(v: Column, kind: str) -> Column:
    return _kind(v) == kind


def _filled(text: Column) -> Column:
    return F.when(text != "", text)


def _truthy(v: Column) -> Column:
    return F.when(~F.coalesce(F.to_json(v), F.lit("null")).isin("null", '""', "[]", "{}", "0", "false"), v)


def _part(p: Column) -> Column:
    said = F.coalesce(_filled(_get(p, "$.text", "string")), _filled(_get(p, "$.content", "string")), F.to_json(p))
    thought = F.coalesce(_get(p, "$.type", "string").isin("thinking", "redacted_thinking"), F.lit(False))
    return let(_kind(p), lambda k: F.when(k == "STRING", _get(p, "$", "string")).when((k == "OBJECT") & ~thought, said))


def content(v: Column) -> Column:
    """Text of a message's content: a string, the parts of a list without reasoning, or an object's text."""

    def read(v: Column) -> Column:
        parts = F.filter(F.transform(_get(v, "$", "array<variant>"), _part), lambda x: x != "")
        whole = F.coalesce(_filled(_get(v, "$.text", "string")), _filled(_get(v, "$.content", "string")), F.to_json(v))
        of_kind = lambda k: F.when(k == "STRING", _get(v, "$", "string")).when(k == "ARRAY", F.array_join(parts, "\n")).when(k == "OBJECT", whole).when(k != "VOID", F.to_json(v))
        return F.coalesce(let(_kind(v), of_kind), F.lit(""))

    return let(v, read)


def message(m: Column) -> Column:
    """(role, content) of one message: plain, a serialised constructor, or a type with its data."""

    def read(m: Column) -> Column:
        ids = _get(m, "$.id", "array<string>")
        built = _get(m, "$.kwargs", "variant").isNotNull() & (ids.isNotNull() | (F.coalesce(_get(m, "$.type", "string"), F.lit("")) == "constructor"))
        data = _is(_get(m, "$.data", "variant"), "OBJECT") & _get(m, "$.type", "string").isNotNull()
        built_role = F.coalesce(_filled(_get(m, "$.kwargs.role", "string")), _filled(_get(m, "$.kwargs.type", "string")), F.try_element_at(ids, F.lit(-1)))
        plain_role = F.coalesce(_filled(_get(m, "$.role", "string")), _get(m, "$.type", "string"))

        def of_form(form: Column) -> Column:
            role = F.when(form == "built", built_role).when(form == "data", _get(m, "$.type", "string")).otherwise(plain_role)
            said = F.when(form == "bare", m).when(form == "built", _get(m, "$.kwargs.content", "variant")).when(form == "data", _get(m, "$.data.content", "variant")).otherwise(_get(m, "$.content", "variant"))
            return F.struct(F.when(form == "bare", "user").otherwise(norm_role(role)).alias("role"), content(said).alias("content"))

        return let(F.when(~_is(m, "OBJECT"), "bare").when(built, "built").when(data, "data").otherwise("plain"), of_form)

    return let(m, read)


def messages(inputs: Column) -> Column:
    """Messages of a run's inputs: a list, a list in a list, an object that has one under a usual key, or a prompt."""
    none = F.array().cast("array<struct<role:string,content:string>>")
    flat = lambda items: F.when(_is(F.get(items, F.lit(0)), "ARRAY"), F.flatten(F.transform(items, lambda g: _get(g, "$", "array<variant>")))).otherwise(items)

    def picked(raw: Column) -> Column:
        usual = F.coalesce(*[_truthy(_get(raw, f"$.{k}", "variant")) for k in ("messages", "input", "prompts", "prompt", "chat_history")])
        return F.when(_is(raw, "OBJECT"), usual).otherwise(raw)

    def read(raw: Column) -> Column:
        prompt = F.array(F.struct(F.lit("user").alias("role"), _get(raw, "$", "string").alias("content")))
        listed = F.transform(let(_get(raw, "$", "array<variant>"), flat), message)
        return let(_kind(raw), lambda k: F.when(k == "STRING", prompt).when(k == "ARRAY", listed).otherwise(none))

    return let(let(F.try_parse_json(inputs), picked), read)


def _generation(raw: Column) -> Column:
    levels = [_get(raw, "$.generations" + "[0]" * k, "variant") for k in (1, 2, 3)]
    return F.coalesce(*[F.when(_is(v, "OBJECT"), v) for v in levels])


def _said_by(m: Column) -> Column:
    return F.when(_is(_get(m, "$.kwargs", "variant"), "OBJECT"), _get(m, "$.kwargs.content", "variant")).otherwise(_get(m, "$.content", "variant"))


def output(outputs: Column) -> Column:
    """A run's answer: of the generation, a usual key, the last message, the first choice, else the JSON itself."""
    return let(F.try_parse_json(outputs), answer)


def answer(raw: Column) -> Column:
    """``output`` of a variant."""
    text_under = lambda k: let(_get(raw, f"$.{k}", "variant"), lambda v: F.when(_is(v, "STRING"), _get(v, "$", "string")))
    of_generation = lambda g: F.coalesce(let(_get(g, "$.message", "variant"), lambda m: F.when(_is(m, "OBJECT"), content(_said_by(m)))), _filled(_get(g, "$.text", "string")))
    cascade = F.coalesce(
        let(_generation(raw), of_generation),
        *[text_under(k) for k in ("output", "content", "text", "answer")],
        let(F.try_element_at(_get(raw, "$.messages", "array<variant>"), F.lit(-1)), lambda m: F.when(m.isNotNull(), message(m)["content"])),
        let(_get(raw, "$.choices[0]", "variant"), lambda c: F.when(_is(c, "OBJECT"), content(_get(c, "$.message.content", "variant")))),
        F.to_json(raw),
    )
    said = let(_kind(raw), lambda k: F.when(k == "STRING", _get(raw, "$", "string")).when((k == "OBJECT") & (F.to_json(raw) != "{}"), cascade))
    return F.coalesce(said, F.lit(""))


def called(raw: Column) -> Column:
    """The tool calls of an answer (a variant), as they stand; null without any."""
    own = lambda said: F.when(_is(_get(said, "$.kwargs", "variant"), "OBJECT"), _get(said, "$.kwargs", "variant")).otherwise(said)
    found = lambda o: F.coalesce(let(_get(o, "$.tool_calls", "variant"), lambda c: _get(_truthy(c), "$", "array<variant>")), _get(o, "$.additional_kwargs.tool_calls", "array<variant>"))
    return let(let(_get(_generation(raw), "$.message", "variant"), own), found)


def tools_called(outputs: Column) -> Column:
    """Sorted distinct names of the tools that the answer calls."""
    return names_called(F.try_parse_json(outputs))


def names_called(raw: Column) -> Column:
    """``tools_called`` of a variant."""
    names = F.transform(let(raw, called), lambda c: F.coalesce(_filled(_get(c, "$.name", "string")), _get(c, "$.function.name", "string")))
    return F.coalesce(F.array_sort(F.array_distinct(F.filter(names, lambda n: n != ""))), F.array().cast("array<string>"))


def tools_defined(tools: Column) -> Column:
    """(name, schema as JSON) of each tool that has a name, wrapped as a function or not."""
    own = lambda t: F.when(_is(_get(t, "$.function", "variant"), "OBJECT"), _get(t, "$.function", "variant")).otherwise(t)
    items = F.transform(F.filter(_get(F.try_parse_json(tools), "$", "array<variant>"), lambda t: _is(t, "OBJECT")), own)
    named = F.filter(items, lambda t: _get(t, "$.name", "string") != "")
    return F.transform(named, lambda t: F.struct(_get(t, "$.name", "string").alias("name"), F.to_json(t).alias("schema_json")))


def tool_choice(raw: Column) -> Column:
    """A recorded policy as any, a tool's name, or null for none: a string, or an object of either provider's shape."""
    v = F.try_parse_json(raw)
    word = F.lower(F.when(_is(v, "STRING"), _get(v, "$", "string")).when(v.isNull(), raw))
    kind = F.lower(_get(v, "$.type", "string"))
    of_word = F.when(word.isin("required", "any"), "any").when(~word.isin("auto", "none", ""), F.when(_is(v, "STRING"), _get(v, "$", "string")).otherwise(raw))
    of_kind = F.when(kind.isin("any", "required"), "any").when(kind == "tool", _get(v, "$.name", "string")).when(kind == "function", _get(v, "$.function.name", "string"))
    return F.when(_is(v, "OBJECT"), of_kind).otherwise(of_word)
