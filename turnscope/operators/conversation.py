"""Context cleaning of one request, as expressions over the arrays inside its row.

A request arrives as one JSON value, so its turns are already together. Every step below is an array
expression: no shuffle, no window, and no group larger than the value that was read.

Canonical message: ``role``, ``shape`` (string, list, parts, other), ``blocks`` and the ``raw`` variant.
Canonical block: ``kind``, ``text``, ``tool_id``, ``cached``, ``omitted`` and ``raw``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnscope.functions import variants as V
from turnscope.functions.formats import built_in, dispatch, family, own_cleaners
from turnscope.functions.kernels import estimate_chars, user_text
from turnscope.functions.nested import bind, indexes, last, part, total
from turnscope.functions.text import strip

MARK = '"cache_control":{"type":"ephemeral"}'
CACHE_POINTS = 4
CLEAN_COUNTS = ("tool_outputs_omitted", "turns_summarized", "cache_control_injected")


@dataclass(frozen=True)
class CleanOptions:
    dedup: bool = True
    prompt_caching: bool = True
    max_turns: int = 50
    keep_recent: int = 10


# --- canonical form ----------------------------------------------------------------------------------


def _block(kind, text, tool_id, cached, raw) -> Column:
    return F.struct(
        kind.alias("kind"),
        text.alias("text"),
        tool_id.alias("tool_id"),
        cached.alias("cached"),
        F.lit(False).alias("omitted"),
        raw.alias("raw"),
    )


def _plain(text: Column, kind: Column | str) -> Column:
    return _block(
        _col(kind), text, F.lit(None).cast("string"), F.lit(False), F.lit(None).cast("variant")
    )


def _list_block(item: Column) -> Column:
    kind = F.coalesce(V.string_or_null(item, "$.type"), F.lit("other"))
    result = V.at(item, "$.content")
    body = F.when(V.is_string(result) | V.is_array(result), F.try_variant_get(item, "$.content", "string"))
    return _block(
        kind,
        F.when(kind == "tool_result", body).otherwise(V.string_or_null(item, "$.text")),
        V.text_of(item, "$.tool_use_id"),
        V.has(item, "$.cache_control"),
        item,
    )


def _gemini_part(item: Column) -> Column:
    reply = V.at(item, "$.functionResponse")
    is_reply = V.is_object(reply)
    return _block(
        F.when(is_reply, "functionResponse").otherwise(F.lit("text")),
        F.when(
            is_reply, F.coalesce(F.try_variant_get(item, "$.functionResponse.response", "string"), F.lit("{}"))
        ).otherwise(V.string_or_null(item, "$.text")),
        V.text_of(item, "$.functionResponse.name"),
        F.lit(False),
        item,
    )


def _col(provider: Column | str) -> Column:
    """A wire format given by name or by column."""
    return F.lit(provider) if isinstance(provider, str) else provider


def messages_of(payload: Column, provider: Column | str) -> Column:
    """The turns of a request in canonical form."""

    def chat(m: Column) -> Column:
        content = V.at(m, "$.content")
        shape = (
            F.when(V.is_string(content), "string").when(V.is_array(content), "list").otherwise(F.lit("other"))
        )
        return F.struct(
            V.string_or_null(m, "$.role").alias("role"),
            shape.alias("shape"),
            F.when(V.is_array(content), F.transform(V.items(m, "$.content"), _list_block))
            .otherwise(F.array(_plain(V.string_or_null(m, "$.content"), "string")))
            .alias("blocks"),
            m.alias("raw"),
        )

    def turn(m: Column) -> Column:
        return F.struct(
            V.string_or_null(m, "$.role").alias("role"),
            F.lit("parts").alias("shape"),
            F.transform(V.items(m, "$.parts"), _gemini_part).alias("blocks"),
            m.alias("raw"),
        )

    return F.when(_col(provider) == "gemini", F.transform(V.items(payload, "$.contents"), turn)).otherwise(
        F.transform(V.items(payload, "$.messages"), chat)
    )


def to_blocks(df: DataFrame, payload: str, provider: Column | str, *keep: str) -> DataFrame:
    """One row per content block: ``turn_idx``, ``role``, ``block_idx`` and the block fields."""
    turns = df.select(*keep, F.posexplode(messages_of(F.col(payload), provider)).alias("turn_idx", "m"))
    blocks = turns.select(*keep, "turn_idx", "m.role", "m.shape", F.posexplode("m.blocks").alias("block_idx", "b"))
    return blocks.select(
        *keep, "turn_idx", "role", "shape", "block_idx", "b.kind", "b.text", "b.tool_id", "b.cached"
    )


# --- repeated content ---------------------------------------------------------------------------------


def _dedup_key(provider: Column, role: Column, shape: Column, block: Column) -> Column:
    """What makes two contents equal; NULL where the content is too short or of another kind."""
    kind, text = block["kind"], block["text"]
    nested = F.when(kind == "functionResponse", F.startswith(text, F.lit("{"))).when(
        kind == "tool_result", V.is_array(V.at(block["raw"], "$.content"))
    )
    size = F.when(nested, V.dumps_length(text)).otherwise(F.length(text))
    long_text = F.when(provider == "openai", F.when(role == "tool", 100).otherwise(200)).otherwise(
        F.when(kind == "string", 200).otherwise(100)
    )
    fits = F.when(provider == "openai", shape == "string").otherwise(
        kind.isin("string", "text", "tool_result", "functionResponse")
    )
    return F.when(fits & (size > long_text), text)


def _tombstone(provider: Column, role: Column, first: Column) -> Column:
    tool = (provider != "openai") | F.coalesce(role == "tool", F.lit(False))
    return F.concat(
        F.when(tool, F.lit("[Tool output")).otherwise(F.lit("[Message content")),
        F.lit(" omitted: identical output matches Turn "),
        first["turn"].cast("string"),
        F.when(provider == "anthropic", F.concat(F.lit(" ("), first["source"], F.lit(")]"))).otherwise(F.lit("]")),
    )


def dedup(messages: Column, provider: Column | str) -> Column:
    """Replace content already seen in an earlier place; the last two turns stay as they are."""
    provider = _col(provider)

    def places(m: Column, t: Column) -> Column:
        def place(b: Column, j: Column) -> Column:
            named = F.when(b["kind"] == "tool_result", F.coalesce(b["tool_id"], F.concat(F.lit("tool_result_"), t)))
            return F.struct(
                _dedup_key(provider, m["role"], m["shape"], b).alias("key"),
                t.alias("turn"),
                j.alias("block"),
                F.coalesce(named, F.concat(F.lit("turn_"), t)).alias("source"),
            )

        return F.transform(m["blocks"], place)

    def rewrite(seen: Column) -> Column:
        keys = F.transform(seen, lambda s: s["key"])

        def with_keys(names: Column) -> Column:
            def block(m: Column, t: Column, b: Column, j: Column) -> Column:
                def replace(first: Column) -> Column:
                    again = (first["turn"] != t) | (first["block"] != j)
                    gone = F.coalesce(again & (t < F.size(messages) - 2), F.lit(False))
                    return F.when(
                        gone,
                        b.withField("text", _tombstone(provider, m["role"], first)).withField("omitted", F.lit(True)),
                    ).otherwise(b)

                spot = F.array_position(names, _dedup_key(provider, m["role"], m["shape"], b))
                return bind(F.get(seen, (spot - 1).cast("int")), replace)

            return F.transform(
                messages,
                lambda m, t: m.withField("blocks", F.transform(m["blocks"], lambda b, j: block(m, t, b, j))),
            )

        # Nothing repeats in most requests: one hash-set pass decides.
        return bind(
            keys,
            lambda names: F.when(F.size(F.array_distinct(names)) < F.size(names), with_keys(names)).otherwise(messages),
        )

    seen = F.filter(F.flatten(F.transform(messages, places)), lambda s: s["key"].isNotNull())
    return bind(seen, rewrite)


def omitted_count(messages: Column) -> Column:
    return total(F.transform(messages, lambda m: F.size(F.filter(m["blocks"], lambda b: b["omitted"]))))


# --- history summary ----------------------------------------------------------------------------------


def _is_user(provider: Column, m: Column) -> Column:
    role = F.when(provider == "gemini", F.coalesce(m["role"], F.lit("user"))).otherwise(m["role"])
    answers = (
        (provider == "anthropic") & (m["shape"] == "list") & F.exists(m["blocks"], lambda b: b["kind"] == "tool_result")
    )
    return F.coalesce(role == "user", F.lit(False)) & ~answers


def summary_span(messages: Column, provider: Column | str, keep_recent: int) -> Column:
    """``struct(prefix, suffix)``: turns ``prefix … suffix-1`` are replaced; NULL when none are."""
    provider = _col(provider)
    n = F.size(messages)
    chat = provider == "openai"
    opening = (F.get(messages, F.lit(0))["role"] == "system") & (F.get(messages, F.lit(1))["role"] == "user")

    def pick(x: Column) -> Column:
        users, prefix, target = x["users"], x["prefix"], x["target"]
        after = F.array_min(F.filter(users, lambda i: F.when(chat, i >= target).otherwise(i > target) & (i > 0)))
        before = F.array_max(
            F.filter(users, lambda i: F.when(chat, (i > prefix) & (i < target)).otherwise((i >= 1) & (i <= target)))
        )
        suffix = F.when(chat, F.coalesce(after, before)).otherwise(F.coalesce(before, after))
        return F.when(suffix > prefix, F.struct(prefix.alias("prefix"), suffix.alias("suffix")))

    prefix = F.when(chat & F.coalesce(opening, F.lit(False)), 2).otherwise(F.lit(1))
    return bind(
        F.struct(
            F.filter(indexes(messages), lambda i: _is_user(provider, F.get(messages, i))).alias("users"),
            prefix.alias("prefix"),
            F.when(chat, F.greatest(prefix + 1, n - keep_recent)).otherwise(n - keep_recent).alias("target"),
        ),
        pick,
    )


def shorten(messages: Column, span: Column, provider: Column | str) -> Column:
    """Replace the turns of a span by one line that says how many they were; no span, no change."""
    gemini = _col(provider) == "gemini"
    gone = (span["suffix"] - span["prefix"]).cast("string")
    text = F.concat(F.lit("[Summary of omitted "), gone, F.lit(" intermediate conversation turns]"))
    note = F.struct(
        F.when(gemini, "model").otherwise("assistant").alias("role"),
        F.when(gemini, "parts").otherwise("string").alias("shape"),
        F.array(_plain(text, F.when(gemini, "part").otherwise("string"))).alias("blocks"),
        F.lit(None).cast("variant").alias("raw"),
    )
    cut = F.concat(
        part(messages, F.lit(0), span["prefix"]), F.array(note), part(messages, span["suffix"], F.size(messages))
    )
    return F.when(span.isNull(), messages).otherwise(cut)


def summarize(messages: Column, provider: Column | str, keep_recent: int) -> Column:
    """Cut the middle of a history down to one line."""
    return bind(summary_span(messages, provider, keep_recent), lambda span: shorten(messages, span, provider))


# --- adjacent equal roles -----------------------------------------------------------------------------


def _as_blocks(m: Column) -> Column:
    wrapped = F.transform(m["blocks"], lambda b: _plain(b["text"], "text"))
    return F.when(m["shape"].isin("list", "parts"), m["blocks"]).when(m["shape"] == "string", wrapped).otherwise(
        part(m["blocks"], F.lit(0), F.lit(0))
    )


def _merged(run: Column) -> Column:
    """One message out of a run of messages with the same role."""
    head = F.get(run, F.lit(0))
    texts = lambda rows: F.array_join(
        F.transform(rows, lambda m: F.coalesce(F.get(m["blocks"], F.lit(0))["text"], F.lit("None"))), "\n\n"
    )
    listed = F.filter(indexes(run), lambda i: F.get(run, i)["shape"].isin("list", "parts"))
    first_list = F.get(listed, F.lit(0))
    # Strings ahead of the first block list are joined before they become a block.
    lead = F.when(first_list > 1, F.array(_plain(texts(part(run, F.lit(0), first_list)), "text"))).when(
        first_list == 1, _as_blocks(head)
    )
    blocks = F.concat(
        F.coalesce(lead, part(head["blocks"], F.lit(0), F.lit(0))),
        F.flatten(F.transform(part(run, first_list, F.size(run)), _as_blocks)),
    )
    joined = head.withField("shape", F.lit("string")).withField("blocks", F.array(_plain(texts(run), "string")))
    shape = F.when(head["shape"] == "parts", "parts").otherwise(F.lit("list"))
    return (
        F.when(F.size(run) == 1, head)
        .when(first_list.isNotNull(), head.withField("shape", shape).withField("blocks", blocks))
        .otherwise(joined)
    )


def merge_roles(messages: Column) -> Column:
    """Join neighbours of the same role (no role equals no role)."""
    starts = F.filter(
        indexes(messages),
        lambda i: (i == 0) | ~F.get(messages, i)["role"].eqNullSafe(F.get(messages, i - 1)["role"]),
    )
    return bind(
        starts,
        lambda s: F.transform(
            s,
            lambda start, k: bind(
                part(messages, start, F.coalesce(F.get(s, k + 1), F.size(messages))), _merged
            ),
        ),
    )


# --- cache breakpoints --------------------------------------------------------------------------------


def _marked(items: Column) -> Column:
    return F.size(F.filter(items, lambda i: V.has(i, "$.cache_control")))


def cache_points(payload: Column, messages: Column) -> Column:
    """Markers already present in system, tools, messages and blocks."""
    in_messages = total(
        F.transform(
            messages,
            lambda m: F.size(F.filter(m["blocks"], lambda b: b["cached"]))
            + V.has(m["raw"], "$.cache_control").cast("int")
            + V.has(m["raw"], "$.content.cache_control").cast("int"),
        )
    )
    system = F.when(V.is_object(V.at(payload, "$.system")), V.has(payload, "$.system.cache_control").cast("int"))
    return (
        F.coalesce(system, _marked(V.items(payload, "$.system"))) + _marked(V.items(payload, "$.tools")) + in_messages
    )


def injection_plan(payload: Column, messages: Column) -> Column:
    """``struct(system, tools, turn)`` booleans: where a marker is added, in that order, within budget."""

    def unmarked_last(items: Column) -> Column:
        end = last(items)
        return F.coalesce(V.is_object(end) & ~V.has(end, "$.cache_control"), F.lit(False))

    def open_block(b: Column) -> Column:
        # Blocks made here have no raw value.
        return b.isNotNull() & ~b["cached"] & (b["raw"].isNull() | V.is_object(b["raw"]))

    target = F.get(messages, F.size(messages) - 2)
    can_turn = F.coalesce(
        (target["shape"] == "string")
        | ((target["shape"] == "list") & bind(last(target["blocks"]), open_block)),
        F.lit(False),
    )
    can_system = V.is_string(V.at(payload, "$.system")) | unmarked_last(V.items(payload, "$.system"))
    can_tools = unmarked_last(V.items(payload, "$.tools"))
    budget = F.lit(CACHE_POINTS) - cache_points(payload, messages)

    def decide(x: Column) -> Column:
        system = x["s"] & (x["b"] > 0)
        tools = x["t"] & (x["b"] - system.cast("int") > 0)
        turn = x["m"] & (x["b"] - system.cast("int") - tools.cast("int") > 0)
        return F.struct(system.alias("system"), tools.alias("tools"), turn.alias("turn"))

    return bind(
        F.struct(budget.alias("b"), can_system.alias("s"), can_tools.alias("t"), can_turn.alias("m")), decide
    )


def plan_size(plan: Column) -> Column:
    return (plan["system"].cast("int") + plan["tools"].cast("int") + plan["turn"].cast("int")).cast("bigint")


# --- JSON out -----------------------------------------------------------------------------------------


def _quoted(text: Column) -> Column:
    """A JSON string literal, or null."""
    wrapped = F.to_json(F.struct(text.alias("c")), {"ignoreNullFields": "false"})
    return bind(wrapped, lambda j: F.substring(j, F.lit(6), F.length(j) - 6))


def _open(object_json: Column) -> Column:
    """The text of an object without its end, ready for one more field."""
    return bind(
        object_json,
        lambda j: F.when(j == "{}", "{").otherwise(F.concat(F.substring(j, F.lit(1), F.length(j) - 1), F.lit(","))),
    )


def _set_field(raw: Column, name: Column | str, value_json: Column) -> Column:
    """The object with one field set, as JSON text."""
    name = _col(name)
    rest = F.to_json(F.map_filter(V.fields(raw), lambda k, _: k != name))
    return F.concat(_open(rest), F.lit('"'), name, F.lit('":'), value_json, F.lit("}"))


def _add_mark(object_json: Column) -> Column:
    return F.concat(_open(object_json), F.lit(MARK + "}"))


def _block_json(b: Column) -> Column:
    kind = b["kind"]
    made = F.concat(
        F.when(kind == "part", '{"text":').otherwise('{"type":"text","text":'), _quoted(b["text"]), F.lit("}")
    )
    reply = kind == "functionResponse"
    field = F.when(reply, kind).when(kind == "tool_result", "content").otherwise("text")
    nested = _set_field(
        V.at(b["raw"], "$.functionResponse"), "response", F.concat(F.lit('{"content":'), _quoted(b["text"]), F.lit("}"))
    )
    value = F.when(reply, nested).otherwise(_quoted(b["text"]))
    return (
        F.when(b["raw"].isNull(), made)
        .when(b["omitted"], _set_field(b["raw"], field, value))
        .otherwise(F.to_json(b["raw"]))
    )


def _message_json(m: Column, mark_last: Column) -> Column:
    end = F.size(m["blocks"]) - 1
    blocks = F.transform(
        F.transform(m["blocks"], _block_json),
        lambda text, j: F.when(mark_last & (j == end), _add_mark(text)).otherwise(text),
    )
    text = _quoted(F.get(m["blocks"], F.lit(0))["text"])
    value = F.when(
        m["shape"].isin("list", "parts"), F.concat(F.lit("["), F.array_join(blocks, ","), F.lit("]"))
    ).otherwise(
        F.concat(
            F.when(mark_last, '[{"type":"text","text":').otherwise(""),
            text,
            F.when(mark_last, f",{MARK}}}]").otherwise(""),
        )
    )
    name = F.when(m["shape"] == "parts", "parts").otherwise("content")
    rest = F.when(m["raw"].isNull(), F.to_json(F.struct(m["role"].alias("role")))).otherwise(
        F.to_json(F.map_filter(V.fields(m["raw"]), lambda k, _: k != name))
    )
    return F.when(m["shape"] == "other", F.to_json(m["raw"])).otherwise(
        F.concat(_open(rest), F.lit('"'), name, F.lit('":'), value, F.lit("}"))
    )


def _marked_list(items: Column) -> Column:
    out = F.transform(
        items, lambda i, k: F.when(k == F.size(items) - 1, _add_mark(F.to_json(i))).otherwise(F.to_json(i))
    )
    return F.concat(F.lit("["), F.array_join(out, ","), F.lit("]"))


def render(payload: Column, provider: Column | str, messages: Column, plan: Column) -> Column:
    """The request as JSON text with its turns replaced and its markers added."""
    name = F.when(_col(provider) == "gemini", "contents").otherwise("messages")
    spot = F.size(messages) - 2
    turns = F.transform(messages, lambda m, t: _message_json(m, plan["turn"] & (t == spot)))
    rest = F.map_filter(
        V.fields(payload),
        lambda k, _: ~((k == name) | ((k == "system") & plan["system"]) | ((k == "tools") & plan["tools"])),
    )
    text = V.string_or_null(payload, "$.system")
    system = F.when(
        text.isNotNull(), F.concat(F.lit('[{"type":"text","text":'), _quoted(text), F.lit(f",{MARK}}}]"))
    ).otherwise(_marked_list(V.items(payload, "$.system")))
    return F.concat(
        _open(F.to_json(rest)),
        F.concat(F.lit('"'), name, F.lit('":[')),
        F.array_join(turns, ","),
        F.lit("]"),
        F.when(plan["system"], F.concat(F.lit(',"system":'), system)).otherwise(""),
        F.when(plan["tools"], F.concat(F.lit(',"tools":'), _marked_list(V.items(payload, "$.tools")))).otherwise(""),
        F.lit("}"),
    )


# --- the whole pipeline -------------------------------------------------------------------------------


def clean_payload(
    df: DataFrame, payload: str, provider: str, options: CleanOptions = CleanOptions(), out: str = "clean"
) -> DataFrame:
    """Add ``out``: the cleaned JSON and what was done to it.

    ``payload`` is a VARIANT column; ``provider`` names the column with the provider. A request
    without a list of turns is returned as it is. Every step is a projection of the same row. A registered provider that
    cleans its requests itself is asked for its rows only.
    """
    own = own_cleaners()
    key = F.lower(F.trim(F.coalesce(F.col(provider), F.lit(""))))
    p, name = F.col(payload), F.col(f"_{out}_name")
    if own:
        p = F.when(~key.isin(*own), p)
    turns, span, final, plan = (F.col(f"_{out}_{x}") for x in ("turns", "span", "final", "plan"))
    zero, no = F.lit(0).cast("bigint"), F.lit(False)
    listed = V.is_array(F.when(name == "gemini", V.at(p, "$.contents")).otherwise(V.at(p, "$.messages")))

    steps = df.withColumn(f"_{out}_name", family(F.col(provider)))
    steps = steps.withColumn(f"_{out}_turns", messages_of(p, name))
    if options.dedup:
        steps = steps.withColumn(f"_{out}_turns", dedup(turns, name))
    long = F.size(turns) > options.max_turns
    steps = steps.withColumn(f"_{out}_span", F.when(long, summary_span(turns, name, options.keep_recent)))
    merges = span.isNotNull() | (long & (name == "anthropic"))
    steps = steps.withColumn(f"_{out}_final", shorten(turns, span, name))
    steps = steps.withColumn(f"_{out}_final", F.when(merges, merge_roles(final)).otherwise(final))
    marks = (name == "anthropic") & F.lit(options.prompt_caching)
    none = F.struct(no.alias("system"), no.alias("tools"), no.alias("turn"))
    steps = steps.withColumn(f"_{out}_plan", F.when(marks, injection_plan(p, final)).otherwise(none))
    steps = steps.withColumn(f"_{out}_json", F.when(listed, render(p, name, final, plan)).otherwise(F.to_json(p)))
    zero_if_null = lambda c: F.coalesce(c.cast("bigint"), zero)
    result = F.struct(
        F.col(f"_{out}_json").alias("cleaned"),
        F.when(listed, omitted_count(turns)).otherwise(zero).alias("tool_outputs_omitted"),
        zero_if_null(span["suffix"] - span["prefix"]).alias("turns_summarized"),
        F.when(listed, plan_size(plan)).otherwise(zero).alias("cache_control_injected"),
    )
    steps = steps.withColumn(f"_{out}_done", result)
    for other, clean in own.items():
        made = clean(F.col(payload), options)
        counted = [zero_if_null(made[c]).alias(c) for c in CLEAN_COUNTS]
        made = F.struct(made["cleaned"].alias("cleaned"), *counted)
        steps = steps.withColumn(f"_{out}_done", F.when(key == other, made).otherwise(F.col(f"_{out}_done")))
    done = F.col(f"_{out}_done")
    saved = V.dumps_length(F.to_json(F.col(payload))) - V.dumps_length(done["cleaned"])
    full = F.struct(*[done[c].alias(c) for c in ("cleaned", *CLEAN_COUNTS)], F.greatest(zero, saved).alias("chars_saved"))
    return steps.select(*[c for c in df.columns if c != out], full.alias(out))


# --- characters ---------------------------------------------------------------------------------------


def payload_chars(payload: Column, provider: str) -> Column:
    """Characters of a request whose turns are texts; NULL when it holds anything else.

    NULL sends the row to the recursive kernel, see ``with_chars``.
    """
    if provider == "gemini":
        return F.lit(None).cast("bigint")

    def by_turn(messages: Column) -> Column:
        plain = F.forall(
            messages,
            lambda m: (m["shape"] != "other")
            & F.forall(m["blocks"], lambda b: b["kind"].isin("string", "text", "tool_result") & b["text"].isNotNull())
            & ~F.exists(m["blocks"], lambda b: (b["kind"] == "tool_result") & ~V.is_string(V.at(b["raw"], "$.content")))
            & ~V.has(m["raw"], "$.text")
            & ~V.has(m["raw"], "$.parts"),
        )
        chars = total(
            F.transform(messages, lambda m: total(F.transform(m["blocks"], lambda b: F.length(b["text"]))))
        )
        return F.when(plain, chars)

    simple = V.is_array(V.at(payload, "$.messages"))
    for other in ("system", "prompt", "contents", "message", "parts", "choices", "candidates", "content", "text"):
        if other != "system":
            simple = simple & ~V.has(payload, f"$.{other}")
    system = (
        F.when(~V.has(payload, "$.system"), F.lit(0))
        .when(V.is_string(V.at(payload, "$.system")), F.length(V.string_or_null(payload, "$.system")))
    )
    return F.when(simple, bind(messages_of(payload, "anthropic"), by_turn) + system)


def with_chars(df: DataFrame, payload: str, json_text: str, out: str) -> DataFrame:
    """Add the character estimate of a request; only unusual shapes leave the JVM."""
    fast = df.withColumn(out, payload_chars(F.col(payload), "anthropic"))
    slow = estimate_chars(F.when(F.col(out).isNull(), F.col(json_text)))
    return fast.withColumn(out, F.coalesce(F.col(out), slow))


# --- what a prompt is matched by ------------------------------------------------------------------------


# Nested tool results read by expressions; the rest is read by a kernel.
RESULT_LEVELS = 3


def _item_texts(item: Column, depth: int = RESULT_LEVELS) -> Column:
    """Texts of a content item: its own, and those below a tool result; the first levels, see ``cache_key_parts``."""
    none = F.array().cast("array<string>")
    one = lambda text: F.when(text.isNotNull(), F.array(text)).otherwise(none)
    own = F.when(V.is_string(item), one(V.string_or_null(item))).otherwise(one(V.string_or_null(item, "$.text")))
    if depth == 0:
        return own
    below = V.at(item, "$.content")
    nested = (
        F.when(V.is_string(below), one(V.string_or_null(below)))
        .when(V.is_array(below), F.flatten(F.transform(V.items(below), lambda x: _item_texts(x, depth - 1))))
        .when(V.is_object(below), _item_texts(below, depth - 1))
        .otherwise(none)
    )
    is_result = F.coalesce(V.string_or_null(item, "$.type") == "tool_result", F.lit(False))
    return F.when(is_result, F.concat(own, nested)).otherwise(own)


def _plain_texts(value: Column) -> Column:
    """Texts of a system value that is a string or a list of strings and text blocks."""
    pick = lambda x: F.coalesce(V.string_or_null(x), V.string_or_null(x, "$.text"))
    listed = F.filter(F.transform(V.items(value), pick), lambda t: t.isNotNull())
    return F.when(V.is_string(value), F.array(V.string_or_null(value))).otherwise(listed)


def cache_key_parts(payload: Column, provider: Column | str, recent: int = 2) -> Column:
    """``struct(user_text, system_text)``: text of the last user turns (0: all), and the instructions."""
    return dispatch(provider, "key_parts", payload, recent)


def _recent(users: Column, recent: int) -> Column:
    return F.slice(users, F.greatest(F.size(users) - recent + 1, F.lit(1)), recent) if recent > 0 else users


def _role_is(m: Column, role: str) -> Column:
    return F.coalesce(V.string_or_null(m, "$.role") == role, F.lit(False))


def _said(payload: Column, texts: Column) -> Column:
    """The texts in one, or the prompt of a request without any."""
    prompt = F.coalesce(V.string_or_null(payload, "$.prompt"), F.lit(""))
    return bind(texts, lambda t: F.when(F.size(t) > 0, F.array_join(t, " ")).otherwise(prompt))


def _parts(said: Column, rules: Column) -> Column:
    return F.struct(said.alias("user_text"), strip(F.array_join(rules, " ")).alias("system_text"))


def _chat_said(payload: Column, turns: Column, recent: int) -> Column:
    """Only requests with more tool results than a fixed shape could hold below each other leave the JVM for their text."""

    def spoken(m: Column) -> Column:
        content = V.at(m, "$.content")
        return (
            F.when(V.is_array(content), F.flatten(F.transform(V.items(content), lambda x: _item_texts(x))))
            .when(V.is_string(content) | V.is_object(content), _item_texts(content))
            .when(V.kind(content) != "VOID", F.array(F.to_json(content)))
            .otherwise(F.array().cast("array<string>"))
        )

    text = F.to_json(payload)
    # Text below more nested results than ``_item_texts`` looks into needs more than that many of them.
    deep = F.regexp_count(text, F.lit('"tool_result"')) > RESULT_LEVELS
    users = F.filter(turns, lambda m: _role_is(m, "user"))
    said = _said(payload, F.flatten(F.transform(_recent(users, recent), spoken)))
    return F.coalesce(user_text(F.when(deep, text), recent), said)


@built_in("anthropic", "key_parts")
def _anthropic_parts(payload: Column, recent: int) -> Column:
    top = V.at(payload, "$.system")
    own = F.when(V.is_object(top), F.array_compact(F.array(V.string_or_null(top, "$.text")))).otherwise(_plain_texts(top))
    return _parts(_chat_said(payload, V.items(payload, "$.messages"), recent), own)


@built_in("openai", "key_parts")
def _chat_parts(payload: Column, recent: int) -> Column:
    turns = V.items(payload, "$.messages")
    system = F.filter(turns, lambda m: _role_is(m, "system"))
    ruled = F.flatten(F.transform(system, lambda m: _plain_texts(V.at(m, "$.content"))))
    rules = bind(ruled, lambda r: F.when(F.size(r) > 0, r).otherwise(_plain_texts(V.at(payload, "$.system"))))
    return _parts(_chat_said(payload, turns, recent), rules)


@built_in("gemini", "key_parts")
def _gemini_parts(payload: Column, recent: int) -> Column:
    silent = lambda m: F.coalesce(V.kind(V.at(m, "$.role")) == "VOID", ~V.has(m, "$.role"))
    text = lambda x: F.coalesce(V.string_or_null(x), V.string_or_null(x, "$.text"))
    users = F.filter(
        V.items(payload, "$.contents"),
        lambda m: _role_is(m, "user") | (V.is_object(m) & (_role_is(m, "") | silent(m))),
    )
    said = F.transform(
        _recent(users, recent),
        lambda m: F.filter(F.transform(V.items(m, "$.parts"), text), lambda t: t.isNotNull()),
    )
    first = V.at(payload, "$.system_instruction")
    rule = F.when(V.truthy(first), first).otherwise(V.at(payload, "$.systemInstruction"))
    parts = V.at(rule, "$.parts")
    by_rule = F.when(V.is_string(rule), F.array(V.string_or_null(rule))).when(
        parts.isNull() | V.is_array(parts), _plain_texts(parts)
    )
    alone = F.filter(F.array(V.string_or_null(rule, "$.text")), lambda t: t.isNotNull())
    return _parts(_said(payload, F.flatten(said)), F.coalesce(by_rule, alone))
