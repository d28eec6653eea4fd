"""Projection of captured exchanges to the record of the transaction log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnscope import fixed
from turnscope.functions import numbers as N
from turnscope.functions import text as X
from turnscope.functions import variants as V
from turnscope.functions.kernels import redact_payload
from turnscope.functions.providers import header
from turnscope.operators.conversation import _open, _set_field
from turnscope.operators.usage import FIELDS, detailed_usage, reply_content

VENDOR_FIELDS = ("thinking", "output_config", "context_management")
PASSIVE = ("1", "true", "yes", "baseline", "passive")
ACTIVE = ("0", "false", "no", "optimized", "active")


def turn_id(headers: Column, payload: Column, fallback: Column, names: dict[str, str] = fixed.HEADER_NAMES) -> Column:
    """``struct(turn_id, turn_id_type)``: header, else replies so far plus one, else the fallback."""
    given = header(headers, names["turn"])
    number = F.regexp_extract(F.trim(given), "^[+-]?\\d+$", 0)
    as_int = F.when(number != "", number.try_cast("bigint").cast("string"))
    counted = lambda path, roles: F.when(
        V.is_array(V.at(payload, path)),
        F.size(F.filter(V.items(payload, path), lambda m: V.string_or_null(m, "$.role").isin(*roles))) + 1,
    )
    derived = F.coalesce(
        counted("$.messages", ["assistant"]), counted("$.contents", ["model", "assistant"]), fallback
    ).cast("string")
    value = F.coalesce(as_int, given, derived)
    kind = F.when(as_int.isNull() & given.isNotNull(), "string").otherwise("int")
    return F.struct(value.alias("turn_id"), kind.alias("turn_id_type"))


def identity(headers: Column, flow_id: Column, names: dict[str, str] = fixed.HEADER_NAMES,
             agent: str = "agent", role: str = "executor") -> Column:
    """``struct(flow_id, agent_id, agent_role)`` with defaults."""
    return F.struct(
        F.coalesce(F.nullif(flow_id, F.lit("")), F.concat(F.lit("flow_"), F.substring(F.uuid(), 1, 8))).alias("flow_id"),
        F.coalesce(header(headers, names["agent"]), F.lit(agent)).alias("agent_id"),
        F.coalesce(header(headers, names["role"]), F.lit(role)).alias("agent_role"),
    )


def mode_label(headers: Column, default_passive: bool = False, names: dict[str, str] = fixed.HEADER_NAMES) -> Column:
    """baseline or optimized, by the first header that says either."""
    verdicts = []
    for key in ("passive", "mode"):
        value = F.lower(F.trim(header(headers, names[key])))
        verdicts.append(F.when(value.isin(*PASSIVE), "baseline").when(value.isin(*ACTIVE), "optimized"))
    return F.coalesce(*verdicts, F.lit("baseline" if default_passive else "optimized"))


def delta(raw_json: Column, cleaned_json: Column, stats: Column) -> Column:
    """Sizes before and after cleaning, and what the cleaner counted (zeros without a cleaner result).

    The JSON texts must be compact; sizes are those of the spaced ASCII form.
    """
    raw = F.coalesce(V.dumps_length(raw_json), F.lit(0).cast("bigint"))
    cleaned = F.coalesce(V.dumps_length(cleaned_json), F.lit(0).cast("bigint"))
    zero = F.lit(0).cast("bigint")
    count = lambda n: F.coalesce(stats[n], zero).cast("bigint").alias(n)
    return F.struct(
        raw.alias("raw_chars"),
        cleaned.alias("cleaned_chars"),
        F.when(stats.isNull(), F.greatest(zero, raw - cleaned)).otherwise(stats["chars_saved"]).alias("chars_saved"),
        count("tool_outputs_omitted"),
        count("turns_summarized"),
        count("cache_control_injected"),
    )


def usage_for_record(
    df: DataFrame, is_hit: str, provider: str, raw_json: str, cleaned_json: str, response_json: str, body: str,
    out: str = "usage",
) -> DataFrame:
    """Usage as logged: a hit counts against the raw request and reads its whole input from cache."""
    asked = df.withColumn("_asked", F.when(F.col(is_hit), F.col(raw_json)).otherwise(F.col(cleaned_json)))
    counted = detailed_usage(asked, provider, "_asked", response_json, body, out)
    u = F.col(out)
    read = F.when(F.col(is_hit), u["input_tokens"]).otherwise(u["cache_read_input_tokens"])
    order = ("input_tokens", "cache_creation_input_tokens", "cache_read_input_tokens", "output_tokens", "reasoning_tokens")
    assert set(order) == set(FIELDS)
    usage = F.struct(*[(read if n == "cache_read_input_tokens" else u[n]).alias(n) for n in order])
    return counted.withColumn(out, usage).drop("_asked")


def timing(is_hit: Column, streaming: Column, ttft_s: Column, total_s: Column, generation_s: Column,
           prefill: Column, tail: Column, decode: Column) -> Column:
    """Times in milliseconds and rates, two digits; a hit without a reading has a first token at once."""
    two = lambda v: F.bround(v, 2)
    return F.struct(
        F.coalesce(N.milliseconds(ttft_s), F.when(is_hit, F.lit(0.0))).alias("ttft_ms"),
        F.coalesce(N.milliseconds(total_s), F.lit(0.0)).alias("total_ms"),
        F.coalesce(streaming, F.lit(False)).alias("streaming"),
        N.milliseconds(generation_s).alias("generation_ms"),
        two(prefill).alias("prefill_tps"),
        two(tail).alias("tail_prefill_tps"),
        two(decode).alias("decode_tps"),
    )


def require_payloads(df: DataFrame, request: str, response: str) -> DataFrame:
    """Exchanges with a request and a reply that is not empty."""
    return df.filter(
        F.col(request).isNotNull() & F.col(response).isNotNull() & ~F.col(response).isin("", "{}", "null", "[]", '""')
    )


def _unmarked(item: Column) -> Column:
    rest = F.to_json(F.map_filter(V.fields(item), lambda k, _: k != "cache_control"))
    return F.when(V.is_object(item), rest).otherwise(F.to_json(item))


def _unmarked_list(value: Column, path: str) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(V.items(value, path), _unmarked), ","), F.lit("]"))


def strip_vendor_fields(payload: Column) -> Column:
    """The request (VARIANT) as JSON text without what engines behind a local address do not know."""

    def message(m: Column) -> Column:
        content = V.at(m, "$.content")
        bare = F.when(V.is_array(content), _unmarked_list(m, "$.content")).when(V.is_object(content), _unmarked(content))
        return F.when(bare.isNotNull(), _set_field(m, "content", bare)).otherwise(F.to_json(m))

    def section(name: str) -> tuple[Column, Column]:
        value = V.at(payload, f"$.{name}")
        if name == "messages":
            rows = F.transform(V.items(payload, "$.messages"), message)
            return V.is_array(value), F.concat(F.lit("["), F.array_join(rows, ","), F.lit("]"))
        text = F.when(V.is_array(value), _unmarked_list(payload, f"$.{name}"))
        if name == "system":
            return V.is_array(value) | V.is_object(value), F.coalesce(text, _unmarked(value))
        return V.is_array(value), text

    parts, rebuilt = [], F.lit(False)
    for name in ("messages", "system", "tools"):
        applies, text = section(name)
        parts.append(F.when(applies, F.concat(F.lit(f'"{name}":'), text)))
        rebuilt = rebuilt | applies
    changed = {n: section(n)[0] for n in ("messages", "system", "tools")}
    rest = F.map_filter(
        V.fields(payload),
        lambda k, _: ~k.isin(*VENDOR_FIELDS)
        & ~((k == "messages") & changed["messages"])
        & ~((k == "system") & changed["system"])
        & ~((k == "tools") & changed["tools"]),
    )
    tail = F.concat_ws(",", *parts)
    return F.when(rebuilt, F.concat(_open(F.to_json(rest)), tail, F.lit("}"))).otherwise(F.to_json(rest))


def strip_vendor_headers(headers: Column) -> Column:
    return F.map_filter(headers, lambda k, _: F.lower(k) != "anthropic-beta")


def for_local_target(clean: Column, is_local: Column) -> Column:
    """A cleaning result as sent to a local target: vendor fields gone, so no marker counts as injected."""
    bare = clean.withField("cleaned", strip_vendor_fields(V.parse(clean["cleaned"]))).withField(
        "cache_control_injected", F.lit(0).cast("bigint")
    )
    return F.when(is_local, bare).otherwise(clean)


def wire_record(
    exchanges: DataFrame, names: dict[str, str] = fixed.HEADER_NAMES, default_passive: bool = False
) -> DataFrame:
    """The log record of every exchange, credentials masked.

    Expects ``flow_id, url, provider, headers, ts, raw_json, cleaned_json, stats, response_json, body,
    status, is_hit, ttft_s, total_s, generation_s, fallback_turn``; ``stats`` may be NULL.
    """
    c = F.col
    raw = F.coalesce(c("raw_json"), c("cleaned_json"), F.lit("{}"))
    prepared = exchanges.withColumn("_raw", raw).withColumn("_sent", F.coalesce(c("cleaned_json"), raw))
    used = usage_for_record(prepared, "is_hit", "provider", "_raw", "_sent", "response_json", "body")
    u, streaming = c("usage"), c("body").isNotNull()
    content = reply_content(c("body"), c("response_json"), c("provider"))
    who = identity(c("headers"), c("flow_id"), names)
    turn = turn_id(c("headers"), V.parse(c("_raw")), c("fallback_turn"), names)
    sizes = delta(F.to_json(V.parse(c("_raw"))), F.to_json(V.parse(c("_sent"))), c("stats"))
    scrubbed = (
        used.withColumn("_content", content)
        .withColumn("_who", who)
        .withColumn("_turn", turn)
        .withColumn("_delta", sizes)
        .withColumn("_raw_clean", redact_payload(c("_raw")))
        .withColumn("_sent_clean", redact_payload(c("_sent")))
        .withColumn("_object", redact_payload(F.when(~streaming, c("_content"))))
    )
    prefill = N.prefill_rate(u["input_tokens"], c("ttft_s"))
    tail = N.tail_prefill_rate(u["input_tokens"], u["cache_read_input_tokens"], c("ttft_s"))
    decode = N.decode_rate(u["output_tokens"], c("generation_s"), streaming)
    unhit = lambda v: F.when(~c("is_hit"), v)
    return scrubbed.select(
        c("_turn.turn_id").alias("turn_id"),
        c("_turn.turn_id_type").alias("turn_id_type"),
        c("_who.flow_id").alias("flow_id"),
        c("_who.agent_id").alias("agent_id"),
        c("_who.agent_role").alias("agent_role"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
        "provider",
        X.redact_text(c("url")).alias("endpoint"),
        X.redact_headers(c("headers")).alias("headers"),
        c("_raw_clean").alias("raw_request"),
        c("_sent_clean").alias("cleaned_request"),
        c("_delta").alias("delta"),
        mode_label(c("headers"), default_passive, names).alias("mode"),
        F.when(c("is_hit"), "HIT").otherwise("MISS").alias("cache_action"),
        F.struct(
            "status", u.alias("usage"), F.when(streaming, X.redact_text(c("_content"))).otherwise(c("_object")).alias("content")
        ).alias("response"),
        timing(
            c("is_hit"), streaming, c("ttft_s"), c("total_s"), c("generation_s"), unhit(prefill), unhit(tail), unhit(decode)
        ).alias("timing"),
    )
