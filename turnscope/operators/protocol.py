"""Conversion between the two chat wire formats, as jobs over tables of requests and replies.

Rows that are exploded here come out of one JSON value each, so a window over ``payload_id`` or
``flow_id`` never holds more than that value did.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnscope.functions import variants as V
from turnscope.functions.nested import bind
from turnscope.operators.usage import stream_events

# --- pairing of calls and replies ---------------------------------------------------------------------


def pair_tool_replies(parts: DataFrame, payload: str = "payload_id") -> DataFrame:
    """Give every call and reply its call id.

    ``parts``: ``payload_id, turn_idx, part_idx, kind`` (call or reply), ``fn`` and ``given_id``. Calls
    without an id are numbered per function. A reply without an id takes the oldest call of its function
    that no such reply took before; within a turn all calls stand ahead of all replies.
    """
    c = F.col
    scope = Window.partitionBy(payload, "fn").orderBy("turn_idx", "_reply", "part_idx")
    so_far = scope.rowsBetween(Window.unboundedPreceding, 0)
    before = scope.rowsBetween(Window.unboundedPreceding, -1)
    given = F.nullif(c("given_id"), F.lit(""))
    unnamed = given.isNull()
    base = parts.withColumn("_reply", (c("kind") == "reply").cast("int"))
    counted = (
        base.withColumn("_calls", F.sum((c("kind") == "call").cast("int")).over(so_far))
        .withColumn("_new", F.sum(((c("kind") == "call") & unnamed).cast("int")).over(so_far))
        .withColumn("_asks", F.sum(((c("kind") == "reply") & unnamed).cast("int")).over(so_far))
    )
    # Asks beyond the calls so far stay unanswered; their running maximum counts them.
    short = F.when((c("kind") == "reply") & unnamed, c("_asks") - c("_calls"))
    ranked = counted.withColumn("_lost", F.greatest(F.lit(0), F.max(short).over(so_far))).withColumn(
        "_lost_before", F.greatest(F.lit(0), F.max(short).over(before))
    )
    made = F.concat(F.lit("call_"), c("fn"), F.when(c("_new") > 1, F.concat(F.lit("_"), c("_new"))).otherwise(""))
    calls = ranked.filter(c("kind") == "call").select(
        payload, "fn", c("_calls").alias("_take"), F.coalesce(given, made).alias("_queued")
    )
    wants = ranked.withColumn(
        "_take",
        F.when((c("kind") == "reply") & unnamed & (c("_lost") == c("_lost_before")), c("_asks") - c("_lost")),
    )
    joined = wants.join(calls, [payload, "fn", "_take"], "left")
    call_id = (
        F.when(c("kind") == "call", F.coalesce(given, made))
        .when(~unnamed, given)
        .otherwise(F.coalesce(c("_queued"), F.concat(F.lit("call_"), c("fn"))))
    )
    return joined.select(*parts.columns, call_id.alias("call_id"))


# --- requests -----------------------------------------------------------------------------------------


def _turns(payload: Column) -> Column:
    """Turns of a request: ``turn_idx``, ``role``, its texts, calls and replies."""

    def part(p: Column, j: Column) -> Column:
        call, reply = V.at(p, "$.functionCall"), V.at(p, "$.functionResponse")
        kind = (
            F.when(V.has(p, "$.text"), "text")
            .when(call.isNotNull(), F.when(V.is_object(call), "call"))
            .when(V.is_object(reply), "reply")
        )
        body = V.at(reply, "$.response")
        inner = F.when(V.has(body, "$.content"), V.at(body, "$.content")).otherwise(body)
        as_text = lambda v: F.coalesce(V.string_or_null(v), F.to_json(v), F.lit("{}"))
        given = F.coalesce(V.text_of(call, "$.id"), V.text_of(reply, "$.id"))
        return F.struct(
            j.alias("part_idx"),
            kind.alias("kind"),
            F.coalesce(V.text_of(call, "$.name"), V.text_of(reply, "$.name"), F.lit("")).alias("fn"),
            F.nullif(given, F.lit("")).alias("given_id"),
            F.when(kind == "text", V.text_of(p, "$.text"))
            .when(kind == "call", as_text(V.at(call, "$.args")))
            .when(kind == "reply", as_text(inner))
            .alias("body"),
        )

    def turn(t: Column, i: Column) -> Column:
        model = V.string_or_null(t, "$.role").isin("model", "assistant")

        def split(parts: Column) -> Column:
            of = lambda kind: F.filter(parts, lambda p: p["kind"] == kind)
            return F.struct(
                i.alias("turn_idx"),
                V.is_object(t).alias("valid"),
                F.when(model, "assistant").otherwise("user").alias("role"),
                F.filter(F.transform(of("text"), lambda p: p["body"]), lambda x: x.isNotNull()).alias("texts"),
                of("call").alias("calls"),
                of("reply").alias("replies"),
            )

        return bind(F.transform(V.items(t, "$.parts"), part), split)

    return F.filter(F.transform(V.items(payload, "$.contents"), turn), lambda t: t["valid"])


def tool_parts(requests: DataFrame, payload: str = "payload") -> DataFrame:
    """Calls and replies of requests (``payload_id`` and a VARIANT) as rows, as ``pair_tool_replies`` takes them."""

    def of_turn(t: Column) -> Column:
        return F.transform(
            F.concat(t["calls"], t["replies"]),
            lambda p: F.struct(t["turn_idx"].alias("turn_idx"), *[p[n].alias(n) for n in ("part_idx", "kind", "fn", "given_id", "body")]),
        )

    parts = F.flatten(F.transform(_turns(F.col(payload)), of_turn))
    return requests.select("payload_id", F.explode(parts).alias("p")).select("payload_id", "p.*")


def _call_ids(turns: Column) -> Column:
    """Call ids of the tool parts of one request, calls ahead of replies in each turn.

    A fold with the open calls as its state: a reply without an id takes the oldest open call of its function, calls
    without one are numbered per function (see ``pair_tool_replies``).
    """
    texts = F.array().cast("array<string>")
    start = F.struct(
        F.array().cast("array<struct<fn:string,id:string>>").alias("open"), texts.alias("unnamed"), texts.alias("ids")
    )

    def step(s: Column, p: Column) -> Column:
        is_call, unnamed = p["kind"] == "call", p["given_id"].isNull()
        number = F.size(F.filter(s["unnamed"], lambda x: x == p["fn"])) + 1
        made = F.concat(F.lit("call_"), p["fn"], F.when(number > 1, F.concat(F.lit("_"), number)).otherwise(""))
        spot = F.array_position(F.transform(s["open"], lambda o: o["fn"]), p["fn"]).cast("int")
        first = F.get(s["open"], spot - 1)["id"]
        answered = F.coalesce(p["given_id"], first, F.concat(F.lit("call_"), p["fn"]))
        found = F.when(is_call, F.coalesce(p["given_id"], made)).otherwise(answered)
        called = F.concat(s["open"], F.array(F.struct(p["fn"].alias("fn"), found.alias("id"))))
        left = F.concat(F.slice(s["open"], 1, spot - 1), F.slice(s["open"], spot + 1, F.size(s["open"])))
        return F.struct(
            F.when(is_call, called).when(unnamed & (spot > 0), left).otherwise(s["open"]).alias("open"),
            F.when(is_call & unnamed, F.concat(s["unnamed"], F.array(p["fn"]))).otherwise(s["unnamed"]).alias("unnamed"),
            F.concat(s["ids"], F.array(found)).alias("ids"),
        )

    tools = F.flatten(F.transform(turns, lambda t: F.concat(t["calls"], t["replies"])))
    return F.aggregate(tools, start, step, lambda s: s["ids"])


def _starts(turns: Column) -> Column:
    """Where the tool parts of each turn start among those of the request."""
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("at"))

    def step(s: Column, t: Column) -> Column:
        return F.struct(
            (s["n"] + F.size(t["calls"]) + F.size(t["replies"])).alias("n"),
            F.concat(s["at"], F.array(s["n"])).alias("at"),
        )

    return F.aggregate(turns, start, step, lambda s: s["at"])


def _message(turn_idx, part_idx, role, content, name=None, tool_call_id=None, tool_calls=None) -> Column:
    text = lambda v: (F.lit(None) if v is None else v).cast("string")
    return F.struct(
        F.struct(turn_idx.cast("int").alias("turn_idx"), part_idx.cast("int").alias("part_idx")).alias("message_idx"),
        text(role).alias("role"),
        text(content).alias("content"),
        text(name).alias("name"),
        text(tool_call_id).alias("tool_call_id"),
        text(tool_calls).alias("tool_calls"),
    )


def chat_messages(requests: DataFrame, payload: str = "payload") -> DataFrame:
    """Turn-and-part requests (``payload_id`` and a VARIANT) as chat message rows.

    ``message_idx`` sorts the messages of a request: the system text first, replies one by one. All messages of a
    request are made from its one value, inside the row; nothing is shuffled.
    """

    def of_turn(t: Column, ids: Column, start: Column) -> Column:
        calls = F.transform(
            t["calls"],
            lambda c, k: F.struct(
                F.get(ids, start + k).alias("id"),
                F.lit("function").alias("type"),
                F.struct(c["fn"].alias("name"), c["body"].alias("arguments")).alias("function"),
            ),
        )
        has_calls = F.size(t["calls"]) > 0
        text = F.when(F.size(t["texts"]) > 0, F.array_join(t["texts"], "\n")).when(~has_calls, "")
        spoken = _message(t["turn_idx"], F.lit(0), t["role"], text, tool_calls=F.when(has_calls, F.to_json(calls)))
        answers = F.transform(
            t["replies"],
            lambda r, k: _message(
                t["turn_idx"], r["part_idx"], F.lit("tool"), r["body"], r["fn"], F.get(ids, start + F.size(t["calls"]) + k)
            ),
        )
        return F.when(F.size(t["replies"]) > 0, answers).otherwise(F.array(spoken))

    def of_request(turns: Column) -> Column:
        return bind(
            F.struct(_call_ids(turns).alias("ids"), _starts(turns).alias("at")),
            lambda s: F.flatten(F.transform(turns, lambda t, i: of_turn(t, s["ids"], F.get(s["at"], i)))),
        )

    whole = F.col(payload)
    instruction = F.when(V.truthy(V.at(whole, "$.systemInstruction")), V.at(whole, "$.systemInstruction")).otherwise(
        V.at(whole, "$.system_instruction")
    )
    lines = F.filter(
        F.transform(V.items(instruction, "$.parts"), lambda p: V.text_of(p, "$.text")), lambda t: t.isNotNull()
    )
    system = bind(
        lines,
        lambda found: F.filter(
            F.array(_message(F.lit(-1), F.lit(0), F.lit("system"), F.array_join(found, "\n\n"))),
            lambda m: F.size(found) > 0,
        ),
    )
    messages = F.concat(system, bind(_turns(whole), of_request))
    return requests.select("payload_id", F.explode(messages).alias("m")).select("payload_id", "m.*")


def chat_options(payload: Column, model: Column | None = None) -> Column:
    """``struct(model, tools, temperature, max_tokens, top_p, stop)`` of a turn-and-part request."""

    def tool(d: Column) -> Column:
        parameters = V.at(d, "$.parameters")
        return F.struct(
            F.lit("function").alias("type"),
            F.struct(
                F.coalesce(V.text_of(d, "$.name"), F.lit("")).alias("name"),
                F.coalesce(V.text_of(d, "$.description"), F.lit("")).alias("description"),
                F.when(V.is_object(parameters), parameters).alias("parameters"),
            ).alias("function"),
        )

    declared = F.flatten(
        F.transform(
            F.filter(V.items(payload, "$.tools"), V.is_object),
            lambda t: F.transform(F.filter(V.items(t, "$.functionDeclarations"), V.is_object), tool),
        )
    )
    given = V.string_or_null(payload, "$.model")
    named = F.coalesce(*([model] if model is not None else []), F.nullif(given, F.lit("")), F.lit("default"))
    setting = lambda n, out: V.at(payload, f"$.generationConfig.{n}").alias(out)
    return F.struct(
        named.alias("model"),
        F.when(F.size(declared) > 0, declared).alias("tools"),
        setting("temperature", "temperature"),
        setting("maxOutputTokens", "max_tokens"),
        setting("topP", "top_p"),
        setting("stopSequences", "stop"),
    )


# --- replies ------------------------------------------------------------------------------------------


def _arguments(raw: Column) -> Column:
    """Call arguments as an object; text that is not JSON goes below ``raw``."""
    text = V.string_or_null(raw)
    parsed = F.coalesce(F.try_parse_json(text), F.parse_json(F.to_json(F.struct(text.alias("raw")))))
    return F.when(V.is_object(raw), raw).when(text.isNotNull(), parsed).otherwise(F.parse_json(F.lit("{}")))


def _part(text: Column | None, name: Column | None, args: Column | None) -> Column:
    call = F.struct(
        (name if name is not None else F.lit(None).cast("string")).alias("name"),
        (args if args is not None else F.lit(None).cast("variant")).alias("args"),
    )
    return F.struct(
        (text if text is not None else F.lit(None).cast("string")).alias("text"),
        (F.when(F.lit(name is not None), call)).alias("functionCall"),
    )


def candidates(response: Column) -> Column:
    """A chat reply as candidates; a reply without choices is one empty candidate."""

    def parts(message: Column) -> Column:
        text = V.string_or_null(message, "$.content")
        spoken = F.when(F.coalesce(text, F.lit("")) != "", F.array(_part(text, None, None))).otherwise(
            F.slice(F.array(_part(text, None, None)), 1, 0)
        )
        calls = F.transform(
            F.filter(V.items(message, "$.tool_calls"), V.is_object),
            lambda c: _part(
                None,
                F.coalesce(V.text_of(c, "$.function.name"), F.lit("")),
                _arguments(F.coalesce(V.at(c, "$.function.arguments"), F.parse_json(F.lit('"{}"')))),
            ),
        )
        return bind(
            F.concat(spoken, calls),
            lambda p: F.when(F.size(p) > 0, p).otherwise(F.array(_part(F.lit(""), None, None))),
        )

    def candidate(choice: Column, i: Column) -> Column:
        return F.struct(
            F.coalesce(V.whole_or_null(choice, "$.index"), i.cast("bigint")).alias("index"),
            F.struct(F.lit("model").alias("role"), parts(V.at(choice, "$.message")).alias("parts")).alias("content"),
            F.when(V.string_or_null(choice, "$.finish_reason") == "length", "MAX_TOKENS").otherwise("STOP").alias(
                "finishReason"
            ),
            V.is_object(choice).alias("_valid"),
        )

    rows = F.filter(F.transform(V.items(response, "$.choices"), candidate), lambda c: c["_valid"])
    empty = F.array(candidate(F.parse_json(F.lit("{}")), F.lit(0)))
    kept = F.when(F.size(V.items(response, "$.choices")) > 0, rows).otherwise(empty)
    return F.transform(kept, lambda c: c.dropFields("_valid"))


def candidate_usage(response: Column) -> Column:
    prompt, done = V.whole_at(response, "$.usage.prompt_tokens"), V.whole_at(response, "$.usage.completion_tokens")
    return F.struct(
        prompt.alias("promptTokenCount"),
        done.alias("candidatesTokenCount"),
        F.coalesce(V.whole_or_null(response, "$.usage.total_tokens"), prompt + done).alias("totalTokenCount"),
    )


def candidate_response(response: Column) -> Column:
    """The whole converted reply as JSON text."""
    return F.to_json(
        F.struct(candidates(response).alias("candidates"), candidate_usage(response).alias("usageMetadata"))
    )


# --- streams ------------------------------------------------------------------------------------------


def stream_chunks(streams: DataFrame, body: str = "body", flow: str = "flow_id") -> DataFrame:
    """Chat stream bodies as converted chunks, one row per emitted chunk in (``event_no``, ``choice_no``).

    Text passes through. Fragments of a tool call are joined per tool index and come out whole with the
    choice that finishes with ``tool_calls``. Usage goes with the first choice of its event.
    """
    c = F.col
    events = streams.select(flow, F.posexplode(stream_events(c(body))).alias("event_no", "event"))
    units = events.select(
        flow,
        "event_no",
        F.when(V.is_object(V.at(c("event"), "$.usage")), V.at(c("event"), "$.usage")).alias("usage"),
        F.posexplode_outer(V.items(c("event"), "$.choices")).alias("choice_no", "choice"),
    )
    order = Window.partitionBy(flow).orderBy("event_no", "choice_no")
    finish = V.string_or_null(c("choice"), "$.finish_reason")
    flush = F.coalesce(finish == "tool_calls", F.lit(False))
    marked = units.withColumn("finish", finish).withColumn("_flush", flush)
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    marked = marked.withColumn("_segment", F.coalesce(F.sum(c("_flush").cast("int")).over(earlier), F.lit(0)))
    fragments = marked.select(
        flow, "event_no", "choice_no", "_segment",
        F.posexplode(V.items(c("choice"), "$.delta.tool_calls")).alias("call_no", "call"),
    )
    f = c("call")
    fragments = fragments.select(
        flow,
        "_segment",
        V.whole_at(f, "$.index").alias("index"),
        F.struct("event_no", "choice_no", "call_no").alias("at"),
        F.nullif(V.text_of(f, "$.function.name"), F.lit("")).alias("name"),
        F.coalesce(V.text_of(f, "$.function.arguments"), F.lit("")).alias("arguments"),
    )
    calls = fragments.groupBy(flow, "_segment", "index").agg(
        F.max_by("name", F.when(c("name").isNotNull(), c("at"))).alias("name"),
        F.expr("listagg(arguments, '') within group (order by at)").alias("arguments"),
    )
    whole = (
        calls.filter(c("name").isNotNull())
        .groupBy(flow, "_segment")
        .agg(F.array_sort(F.array_agg(F.struct("index", "name", "arguments"))).alias("_calls"))
        .withColumn("_flush", F.lit(True))
    )
    joined = marked.join(whole, [flow, "_segment", "_flush"], "left")
    text = V.string_or_null(c("choice"), "$.delta.content")
    rows = joined.select(
        flow,
        "event_no",
        F.coalesce("choice_no", F.lit(0)).alias("choice_no"),
        text.alias("text"),
        F.to_json(
            F.transform(
                "_calls",
                lambda x: F.struct(
                    x["name"].alias("name"),
                    F.coalesce(
                        F.try_parse_json(F.when(x["arguments"] == "", "{}").otherwise(x["arguments"])),
                        F.parse_json(F.to_json(F.struct(x["arguments"].alias("raw")))),
                    ).alias("args"),
                ),
            )
        ).alias("function_calls"),
        F.when(c("finish").isin("stop", "tool_calls"), "STOP")
        .when(F.coalesce(c("finish"), F.lit("")) != "", "MAX_TOKENS")
        .alias("finish_reason"),
        *[
            F.when(
                c("usage").isNotNull() & (F.coalesce("choice_no", F.lit(0)) == 0), V.whole_at(c("usage"), f"$.{k}")
            ).alias(out)
            for k, out in (
                ("prompt_tokens", "prompt_token_count"),
                ("completion_tokens", "candidates_token_count"),
                ("total_tokens", "total_token_count"),
            )
        ],
    )
    emitted = ("text", "function_calls", "finish_reason", "prompt_token_count")
    return rows.filter(" or ".join(f"{n} is not null" for n in emitted))
