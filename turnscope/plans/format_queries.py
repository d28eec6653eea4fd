"""Queries over providers that are registered beside the built-in formats, and over a cleaner given by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnscope.functions import formats
from turnscope.functions import variants as V
from turnscope.functions.formats import ProviderFormat
from turnscope.operators import abtest as A
from turnscope.operators import conversation as C
from turnscope.operators import usage as U
from turnscope.operators.conversation import CleanOptions
from turnscope.plans.registry import query, table
from turnscope.plans.views import wire_transactions

ZERO = lambda: F.lit(0).cast("bigint")


def echo_format() -> ProviderFormat:
    """A made-up format: ``{"ask": …}``, answered by ``{"in": …, "out": …}`` or by events ``{"say": …}``."""
    return ProviderFormat(
        clean=lambda payload, options: F.struct(
            F.to_json(F.struct(V.text_of(payload, "$.ask").alias("ask"))).alias("cleaned"),
            F.lit(1).alias("tool_outputs_omitted"),
            F.lit(0).alias("turns_summarized"),
            F.lit(0).alias("cache_control_injected"),
        ),
        usage_from_object=lambda r: U.object_counts(
            V.has(r, "$.in") & V.has(r, "$.out"), V.whole_at(r, "$.in"), V.whole_at(r, "$.out"), ZERO(), ZERO(), ZERO()
        ),
        usage_from_stream=lambda events: U.stream_counts(
            F.size(events).cast("bigint"), F.size(events).cast("bigint"), ZERO(), ZERO(), ZERO(), ZERO(), ZERO()
        ),
        stream_text=lambda events: F.array_join(F.transform(events, lambda e: V.text_of(e, "$.say")), "+"),
        key_parts=lambda payload, recent: F.struct(
            V.text_of(payload, "$.ask").alias("user_text"), F.lit("").alias("system_text")
        ),
    )


@query(
    "provider_registry",
    """select event_id,
      case when event_id % 5 = 0 then '{"ask":"q' || event_id || '"}' when event_id % 5 = 1 then '{"ask":"' || event_type || '"}'
        else '{"n":1,"messages":[{"role":"user","content":"' || event_type || '"}]}' end as cleaned,
      case when event_id % 5 < 2 then 1 else 0 end as omitted,
      cast(case event_id % 5 when 1 then 2 when 4 then length(event_type) // 4 else event_id end as bigint) as input_tokens,
      cast(case event_id % 5 when 1 then 2 when 4 then 1 else 7 end as bigint) as output_tokens,
      case event_id % 5 when 1 then 'a+' || event_type when 4 then 'hey ' || event_type end as reply,
      case when event_id % 5 = 0 then 'q' || event_id else event_type end as user_text
    from events""",
)
def provider_registry(spark, folder):
    """Two registered providers beside built-in and unknown ones, through cleaning, usage, stream text and key parts."""
    i, kind = F.col("event_id"), F.col("event_type")
    k = i % 5
    provider = (
        F.when(k == 0, " Echo").when(k == 1, "echo").when(k == 2, "mirror").when(k == 3, "nobody").otherwise(F.lit("mirror "))
    )
    ask = F.when(k == 0, F.concat(F.lit("q"), i)).otherwise(kind)
    chat = F.concat(F.lit('{"messages":[{"role":"user","content":"'), kind, F.lit('"}],"n":1}'))
    request = F.when(k < 2, F.concat(F.lit('{"ask":"'), ask, F.lit('","more":[1,2]}'))).otherwise(chat)
    response = (
        F.when(k == 0, F.concat(F.lit('{"in":'), i, F.lit(',"out":7}')))
        .when(k == 2, F.concat(F.lit('{"usage":{"input_tokens":'), i, F.lit(',"output_tokens":7}}')))
        .when(k == 3, F.concat(F.lit('{"usage":{"prompt_tokens":'), i, F.lit(',"completion_tokens":7}}')))
    )
    body = (
        F.when(k == 1, F.concat(F.lit('data: {"say":"a"}\ndata: {"say":"'), kind, F.lit('"}')))
        .when(k == 4, F.concat(F.lit('data: {"type":"message_delta","usage":{"output_tokens":1}}\ndata: {"delta":{"text":"hey '), kind, F.lit('"}}')))
    )
    with formats.registered("echo", echo_format()), formats.registered("mirror", ProviderFormat(base="anthropic")):
        rows = table(spark, folder, "events").select(
            "event_id", provider.alias("provider"), request.alias("request"), response.alias("response"), body.alias("body")
        )
        rows = rows.withColumn("p", F.parse_json("request"))
        rows = C.clean_payload(rows, "p", "provider", CleanOptions(prompt_caching=False))
        rows = U.detailed_usage(rows, "provider", "request", "response", "body")
        return rows.select(
            "event_id",
            "clean.cleaned",
            F.col("clean.tool_outputs_omitted").cast("int").alias("omitted"),
            "usage.input_tokens",
            "usage.output_tokens",
            F.when(F.col("body").isNotNull(), U.reply_content(F.col("body"), F.col("response"), F.col("provider"))).alias("reply"),
            C.cache_key_parts(F.col("p"), F.col("provider"))["user_text"].alias("user_text"),
        )


@query(
    "pluggable_cleaner",
    """select event_id as position, greatest(length(repeat('word ', event_id % 17)), 0) as baseline_chars, 4 as optimized_chars, 3 as pruned from events""",
)
def pluggable_cleaner(spark, folder):
    """A cleaner given by hand takes the place of the built-in one in the scorecard's rows."""

    def one_word(df, payload, provider):
        zero = F.lit(0).cast("bigint")
        return df.withColumn(
            "clean",
            F.struct(
                F.lit('{"messages":[{"role":"user","content":"word"}]}').alias("cleaned"),
                F.lit(3).alias("tool_outputs_omitted"),
                zero.alias("turns_summarized"),
                zero.alias("cache_control_injected"),
                zero.alias("chars_saved"),
            ),
        )

    log = wire_transactions(spark, folder).select(F.col("ordinal").alias("position"), "tx")
    turns = A.offline_turns(log, cleaner=one_word)
    return turns.select("position", "baseline_chars", "optimized_chars", F.col("tool_calls_pruned").alias("pruned"))
