"""Token usage and reply text, from response objects and from event-stream text.

A stream body is one value of its record, so its events are an array inside the row; nothing is
shuffled to reassemble it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnscope.functions import variants as V
from turnscope.functions.formats import built_in, dispatch, has_streams
from turnscope.functions.kernels import estimate_chars
from turnscope.functions.nested import bind, last, total
from turnscope.functions.numbers import tokens_from_chars
from turnscope.functions.text import split_lines

BLANK = " \t\n\r\x0b\x0c"
# Markers that cannot occur in interchanged text (Unicode noncharacters): text, tool start, end.
TEXT, TOOL, END = "﷐", "﷑", "﷒"


def stream_events(body: Column) -> Column:
    """The JSON objects of the ``data:`` lines, in order; anything unreadable is left out."""
    rows = F.transform(split_lines(body), lambda r: F.btrim(r, F.lit(BLANK)))
    data = F.transform(
        F.filter(rows, lambda r: F.startswith(r, F.lit("data:"))),
        lambda r: F.btrim(F.substring(r, F.lit(6), F.length(r)), F.lit(BLANK)),
    )
    # Only objects can count; the test on the first character spares the parser the rest.
    objects = F.filter(data, lambda d: F.startswith(d, F.lit("{")))
    return F.filter(F.transform(objects, lambda d: F.try_parse_json(d)), lambda e: e.isNotNull())


def stream_rows(df: DataFrame, body: str, *keep: str) -> DataFrame:
    """One row per stream event: ``ordinal`` and the ``event`` variant."""
    return df.select(*keep, F.posexplode(stream_events(F.col(body))).alias("ordinal", "event"))


def object_counts(found, inp, out, read, create, reason) -> Column:
    """Usage of a response object; ``found`` is false when it must be estimated."""
    return F.struct(
        found.alias("found"),
        inp.alias("input_tokens"),
        out.alias("output_tokens"),
        read.alias("cache_read_input_tokens"),
        create.alias("cache_creation_input_tokens"),
        reason.alias("reasoning_tokens"),
    )


ZERO = lambda: F.lit(0).cast("bigint")


def _chat_usage(usage: Column, found: Column) -> Column:
    details = V.has(usage, "$.prompt_tokens_details.cached_tokens")
    cached = F.when(details, V.whole_at(usage, "$.prompt_tokens_details.cached_tokens")).otherwise(
        V.whole_at(usage, "$.cached_tokens")
    )
    return object_counts(
        found,
        V.whole_at(usage, "$.prompt_tokens"),
        V.whole_at(usage, "$.completion_tokens"),
        cached,
        ZERO(),
        V.whole_at(usage, "$.completion_tokens_details.reasoning_tokens"),
    )


def _gemini_usage(usage: Column, found: Column) -> Column:
    return object_counts(
        found,
        V.whole_at(usage, "$.promptTokenCount"),
        V.whole_at(usage, "$.candidatesTokenCount"),
        V.whole_at(usage, "$.cachedContentTokenCount"),
        ZERO(),
        V.whole_at(usage, "$.reasoningTokenCount"),
    )


def _gemini_block(node: Column) -> Column:
    first = V.at(node, "$.usageMetadata")
    return F.when(V.truthy(first), first).otherwise(V.at(node, "$.usage"))


@built_in("anthropic", "usage_from_object")
def _anthropic_object(response: Column) -> Column:
    usage = V.at(response, "$.usage")
    read, create = V.whole_at(usage, "$.cache_read_input_tokens"), V.whole_at(usage, "$.cache_creation_input_tokens")
    reason = V.whole_at(usage, "$.reasoning_tokens")
    return object_counts(
        V.has(usage, "$.input_tokens") & V.has(usage, "$.output_tokens"),
        V.whole_at(usage, "$.input_tokens") + read + create,
        V.whole_at(usage, "$.output_tokens"),
        read,
        create,
        F.when(reason != 0, reason).otherwise(V.whole_at(usage, "$.thinking_tokens")),
    )


@built_in("openai", "usage_from_object")
def _chat_object(response: Column) -> Column:
    usage = V.at(response, "$.usage")
    return _chat_usage(usage, V.has(usage, "$.prompt_tokens") & V.has(usage, "$.completion_tokens"))


@built_in("gemini", "usage_from_object")
def _gemini_object(response: Column) -> Column:
    return bind(
        _gemini_block(response),
        lambda u: _gemini_usage(u, V.has(u, "$.promptTokenCount") & V.has(u, "$.candidatesTokenCount")),
    )


def usage_from_object(response: Column, provider: Column | str) -> Column:
    """Reported usage of a response object; ``found`` is false when it must be estimated."""
    return dispatch(provider, "usage_from_object", response)


def _length(value: Column, path: str) -> Column:
    return F.coalesce(F.length(V.string_or_null(value, path)), F.lit(0))


def stream_counts(inp, out, read, create, reason, chars, thinking) -> Column:
    """Usage of a stream: NULL for counts it did not report, and the characters of its text and thoughts."""
    return F.struct(
        inp.alias("input_tokens"),
        out.alias("output_tokens"),
        read.alias("cache_read_input_tokens"),
        create.alias("cache_creation_input_tokens"),
        reason.alias("reasoning_tokens"),
        chars.alias("text_chars"),
        thinking.alias("thinking_chars"),
    )


def _reported(usage: Column, chars: Column) -> Column:
    return bind(
        usage,
        lambda u: stream_counts(
            F.when(u.isNotNull(), u["input_tokens"]),
            F.when(u.isNotNull(), u["output_tokens"]),
            u["cache_read_input_tokens"],
            ZERO(),
            u["reasoning_tokens"],
            chars,
            ZERO(),
        ),
    )


@built_in("anthropic", "usage_from_stream")
def _anthropic_stream(events: Column) -> Column:
    is_type = lambda e, name: F.coalesce(V.string_or_null(e, "$.type") == name, F.lit(False))
    starts = F.filter(
        events, lambda e: is_type(e, "message_start") & V.is_object(V.at(e, "$.message.usage"))
    )
    ends = F.filter(events, lambda e: is_type(e, "message_delta"))
    deltas = F.filter(events, lambda e: is_type(e, "content_block_delta"))
    out = last(F.filter(ends, lambda e: V.has(e, "$.usage.output_tokens")))
    reason = last(F.filter(ends, lambda e: V.has(e, "$.usage.thinking_tokens")))

    def counted(s: Column) -> Column:
        start = V.at(s["start"], "$.message.usage")
        read = V.whole_at(start, "$.cache_read_input_tokens")
        create = V.whole_at(start, "$.cache_creation_input_tokens")
        return stream_counts(
            F.when(start.isNotNull(), V.whole_at(start, "$.input_tokens") + read + create),
            F.when(s["out"].isNotNull(), V.whole_at(s["out"], "$.usage.output_tokens")),
            read,
            create,
            F.when(s["reason"].isNotNull(), V.whole_at(s["reason"], "$.usage.thinking_tokens")),
            s["chars"] + s["thinking"],
            s["thinking"],
        )

    return bind(
        F.struct(
            last(starts).alias("start"),
            out.alias("out"),
            reason.alias("reason"),
            total(
                F.transform(deltas, lambda e: _length(e, "$.delta.text") + _length(e, "$.delta.partial_json"))
            ).alias("chars"),
            total(F.transform(deltas, lambda e: _length(e, "$.delta.thinking"))).alias("thinking"),
        ),
        counted,
    )


@built_in("openai", "usage_from_stream")
def _chat_stream(events: Column) -> Column:
    blocks = F.filter(F.transform(events, lambda e: V.at(e, "$.usage")), lambda u: V.is_object(u))
    call = lambda c: _length(c, "$.function.name") + _length(c, "$.function.arguments")
    choice = lambda c: _length(c, "$.delta.content").cast("bigint") + total(
        F.transform(V.items(c, "$.delta.tool_calls"), call)
    )
    chars = total(F.transform(events, lambda e: total(F.transform(V.items(e, "$.choices"), choice))))
    usage = bind(last(blocks), lambda u: F.when(u.isNotNull(), _chat_usage(u, F.lit(True))))
    return _reported(usage, chars)


@built_in("gemini", "usage_from_stream")
def _gemini_stream(events: Column) -> Column:
    blocks = F.filter(F.transform(events, _gemini_block), lambda u: V.is_object(u))

    def in_part(p: Column) -> Column:
        args = V.at(p, "$.functionCall.args")
        args_size = F.when(V.is_object(args), V.dumps_length(F.to_json(args))).otherwise(
            _length(p, "$.functionCall.args")
        )
        keyed = _length(p, "$.text") + _length(p, "$.functionCall.name") + args_size
        return F.when(V.is_string(p), _length(p, "$")).otherwise(keyed).cast("bigint")

    def in_candidate(c: Column) -> Column:
        direct = F.coalesce(F.length(V.string_or_null(c)), F.length(V.string_or_null(c, "$.content")))
        return F.coalesce(
            direct.cast("bigint"), total(F.transform(V.items(c, "$.content.parts"), in_part))
        )

    def replies(e: Column) -> Column:
        options = [V.at(e, f"$.{k}") for k in ("candidates", "choices", "contents")]
        return V.items(F.coalesce(*[F.when(V.truthy(o), o) for o in options]))

    chars = total(F.transform(events, lambda e: total(F.transform(replies(e), in_candidate))))
    usage = bind(last(blocks), lambda u: F.when(u.isNotNull(), _gemini_usage(u, F.lit(True))))
    return _reported(usage, chars)


def usage_from_stream(events: Column, provider: Column | str) -> Column:
    """``struct(input_tokens?, output_tokens?, …, text_chars, thinking_chars)``; NULL counts were not reported."""
    return dispatch(provider, "usage_from_stream", events)


FIELDS = (
    "input_tokens",
    "output_tokens",
    "cache_read_input_tokens",
    "cache_creation_input_tokens",
    "reasoning_tokens",
)


def stream_usage(df: DataFrame, body: str, provider: str, request_json: str, out: str = "usage") -> DataFrame:
    """Add the five usage counts of an event stream, estimating what it does not report."""
    found = df.withColumn("_events", stream_events(F.col(body)))
    found = found.withColumn("_found", usage_from_stream(F.col("_events"), F.col(provider)))
    u = F.col("_found")
    chars = estimate_chars(F.when(u["input_tokens"].isNull(), F.col(request_json)))
    found = found.withColumn("_chars", chars)
    reason = F.when(u["reasoning_tokens"] != 0, u["reasoning_tokens"]).otherwise(tokens_from_chars(u["thinking_chars"]))
    usage = F.struct(
        F.coalesce(u["input_tokens"], tokens_from_chars(F.col("_chars"))).alias("input_tokens"),
        F.coalesce(u["output_tokens"], tokens_from_chars(u["text_chars"])).alias("output_tokens"),
        F.coalesce(u["cache_read_input_tokens"], ZERO()).alias("cache_read_input_tokens"),
        F.coalesce(u["cache_creation_input_tokens"], ZERO()).alias("cache_creation_input_tokens"),
        F.coalesce(reason, ZERO()).alias("reasoning_tokens"),
    )
    return found.select(*df.columns, usage.alias(out))


def object_usage(
    df: DataFrame, response: str, provider: str, request_json: str, response_json: str, out: str = "usage"
) -> DataFrame:
    """Add the five usage counts of a response object (VARIANT), estimating when it reports none."""
    found = df.withColumn("_found", usage_from_object(F.col(response), F.col(provider)))
    u = F.col("_found")
    found = found.withColumn("_in", estimate_chars(F.when(~u["found"], F.col(request_json))))
    found = found.withColumn("_out", estimate_chars(F.when(~u["found"], F.col(response_json))))
    guess = {"input_tokens": F.col("_in"), "output_tokens": F.col("_out")}
    usage = F.struct(
        *[
            F.when(u["found"], u[name])
            .otherwise(tokens_from_chars(guess[name]) if name in guess else ZERO())
            .alias(name)
            for name in FIELDS
        ]
    )
    return found.select(*df.columns, usage.alias(out))


def detailed_usage(
    df: DataFrame, provider: str, request_json: str, response_json: str, body: str, out: str = "usage"
) -> DataFrame:
    """Usage by the kind of reply: rows with a stream ``body`` are read as events, the others as objects."""
    plain = object_usage(
        df.withColumn("_response", V.parse(F.col(response_json))),
        "_response",
        provider,
        request_json,
        response_json,
        "_plain",
    )
    both = stream_usage(plain, body, provider, request_json, "_stream")
    return both.select(*df.columns, F.when(F.col(body).isNotNull(), F.col("_stream")).otherwise(F.col("_plain")).alias(out))


# --- reply text ---------------------------------------------------------------------------------------


def _joined(parts: Column) -> Column:
    return F.array_join(parts, "")


def _nonempty(value: Column, path: str) -> Column:
    return F.coalesce(V.string_or_null(value, path), F.lit(""))


@built_in("anthropic", "stream_text")
def _anthropic_text(events: Column) -> Column:
    def piece(e: Column) -> Column:
        name = _nonempty(e, "$.content_block.name")
        start = F.concat(F.lit(TOOL), F.when(name != "", F.concat(name, F.lit("("))).otherwise(""))
        tool = F.coalesce(V.string_or_null(e, "$.content_block.type") == "tool_use", F.lit(False))
        stop = F.coalesce(V.string_or_null(e, "$.type") == "content_block_stop", F.lit(False))
        return F.concat(
            F.when(tool, start).otherwise(""),
            *[_nonempty(e, f"$.delta.{k}") for k in ("text", "thinking", "partial_json")],
            F.when(stop, END).otherwise(""),
        )

    marked = _joined(F.transform(events, piece))
    closed = F.regexp_replace(marked, f"{TOOL}([^{END}]*+){END}?", "$1)")
    return F.translate(closed, TOOL + END, "")


@built_in("openai", "stream_text")
def _chat_text(events: Column) -> Column:
    def call(c: Column) -> Column:
        name = _nonempty(c, "$.function.name")
        return F.concat(
            F.when(name != "", F.concat(F.lit(TOOL), name, F.lit("("))).otherwise(""),
            _nonempty(c, "$.function.arguments"),
        )

    def choice(c: Column) -> Column:
        done = V.string_or_null(c, "$.finish_reason").isin("tool_calls", "stop")
        return F.concat(
            F.coalesce(F.concat(F.lit(TEXT), V.string_or_null(c, "$.delta.content")), F.lit("")),
            _joined(F.transform(V.items(c, "$.delta.tool_calls"), call)),
            F.when(F.coalesce(done, F.lit(False)), END).otherwise(""),
        )

    marked = _joined(F.transform(events, lambda e: _joined(F.transform(V.items(e, "$.choices"), choice))))
    closed = F.regexp_replace(marked, f"{TOOL}([^{TEXT}{TOOL}{END}]*+)", "$1)")
    return F.translate(closed, TEXT + END, "")


@built_in("gemini", "stream_text")
def _gemini_text(events: Column) -> Column:
    def part(p: Column) -> Column:
        call = V.at(p, "$.functionCall")
        return F.concat(
            _nonempty(p, "$.text"), F.when(V.is_object(call), F.to_json(call)).otherwise("")
        )

    return _joined(
        F.transform(
            events,
            lambda e: _joined(
                F.transform(
                    V.items(e, "$.candidates"),
                    lambda c: _joined(F.transform(V.items(c, "$.content.parts"), part)),
                )
            ),
        )
    )


def stream_text(events: Column, provider: Column | str) -> Column:
    """The reply of a stream: text in order, tool calls as ``name(arguments)``; empty for providers whose streams are not read.

    In the built-in formats each event becomes marked text; one regular expression over the joined text closes the calls.
    """
    return F.when(has_streams(provider), dispatch(provider, "stream_text", events)).otherwise(F.lit(""))


def reply_content(body: Column, response_json: Column, provider: Column) -> Column:
    """What is logged as the reply: stream text, or the object as it came."""
    return F.when(body.isNotNull(), bind(stream_events(body), lambda e: stream_text(e, provider))).otherwise(
        response_json
    )
