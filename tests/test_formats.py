"""Providers that are registered run through every operator that asks for a step of their format."""

import json

import pytest
from pyspark.sql import functions as F

from turnscope.functions import formats
from turnscope.functions import variants as V
from turnscope.functions.formats import ProviderFormat
from turnscope.operators import conversation as C
from turnscope.operators import usage as U

ZERO = lambda: F.lit(0).cast("bigint")


def echo():
    """A format with five steps of its own."""
    return ProviderFormat(
        clean=lambda payload, options: F.struct(
            F.to_json(F.struct(V.text_of(payload, "$.ask").alias("ask"))).alias("cleaned"),
            F.lit(options.keep_recent).alias("tool_outputs_omitted"),
            F.lit(None).cast("int").alias("turns_summarized"),
            F.lit(2).alias("cache_control_injected"),
        ),
        usage_from_object=lambda r: U.object_counts(
            V.has(r, "$.in"), V.whole_at(r, "$.in"), V.whole_at(r, "$.out"), ZERO(), ZERO(), ZERO()
        ),
        usage_from_stream=lambda events: U.stream_counts(
            F.lit(None).cast("bigint"), F.size(events).cast("bigint"), ZERO(), ZERO(), ZERO(), ZERO(), ZERO()
        ),
        stream_text=lambda events: F.array_join(F.transform(events, lambda e: V.text_of(e, "$.say")), "+"),
        key_parts=lambda payload, recent: F.struct(
            V.text_of(payload, "$.ask").alias("user_text"), F.lit(str(recent)).alias("system_text")
        ),
    )


@pytest.fixture
def providers():
    with formats.registered(" Echo ", echo()), formats.registered("mirror", ProviderFormat(base="anthropic")):
        with formats.registered("loud", ProviderFormat(base="echo", stream_text=lambda e: F.lit("LOUD"))):
            yield


def test_names(providers):
    assert formats.provider_format("ECHO").base == "openai"
    for step in ("usage_from_object", "usage_from_stream", "stream_text", "key_parts"):
        for known in ("anthropic", "openai", "gemini"):
            assert getattr(formats.provider_format(known), step) is not None
        assert getattr(formats.provider_format("nobody"), step) is getattr(formats.provider_format("openai"), step)
        assert getattr(formats.provider_format("mirror"), step) is getattr(formats.provider_format("anthropic"), step)
    assert formats.provider_format("") == formats.provider_format(None) == formats.provider_format("openai")
    assert formats.family("loud") == "openai" and formats.family("mirror") == "anthropic"
    assert sorted(formats.own_cleaners()) == ["echo", "loud"]


def test_wrong_registrations():
    for name, base in (("openai", "gemini"), ("self", "self"), ("x", "nobody")):
        with pytest.raises(ValueError):
            formats.register_provider(name, ProviderFormat(base=base))
    with pytest.raises(ValueError):
        formats.unregister_provider("gemini")
    formats.register_provider("gone", ProviderFormat())
    formats.unregister_provider("GONE ")
    assert "gone" not in formats._FORMATS


def test_steps_of_every_provider(spark, providers):
    chat = {"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "hello"}]}
    rows = [
        (0, "echo", {"ask": "why", "more": "x" * 50}, {"in": 7, "out": 3}, 'data: {"say":"a"}\ndata: {"say":"b"}'),
        (1, " ECHO ", {"ask": "q"}, {"out": 3}, 'data: {"say":"a"}'),
        (2, "loud", {"ask": "q"}, {"in": 1, "out": 1}, 'data: {"say":"a"}'),
        (3, "mirror", {"system": "top", **chat}, {"usage": {"input_tokens": 5, "output_tokens": 6}}, 'data: {"delta":{"text":"hi"}}'),
        (4, "nobody", chat, {"usage": {"prompt_tokens": 8, "completion_tokens": 9}}, 'data: {"choices":[{"delta":{"content":"x"}}]}'),
        (5, "openrouter", chat, {"usage": {"prompt_tokens": 8, "completion_tokens": 9}}, 'data: {"choices":[{"delta":{"content":"x"}}]}'),
        (6, None, chat, {}, 'data: {"choices":[{"delta":{"content":"x"}}]}'),
    ]
    df = spark.createDataFrame(
        [(i, p, json.dumps(q, separators=(",", ":")), json.dumps(r), b) for i, p, q, r, b in rows],
        "id int, provider string, request string, response string, stream string",
    ).withColumn("p", V.parse(F.col("request")))
    found = C.clean_payload(df, "p", "provider")
    found = U.detailed_usage(found.withColumn("none", F.lit(None).cast("string")), "provider", "request", "response", "none", "plain")
    found = U.detailed_usage(found, "provider", "request", "response", "stream", "flow")
    found = found.withColumn("text", U.reply_content(F.col("stream"), F.col("response"), F.col("provider")))
    found = {r.id: r for r in found.withColumn("key", C.cache_key_parts(F.col("p"), F.col("provider"))).collect()}
    assert json.loads(found[0].clean.cleaned) == {"ask": "why"}
    assert found[0].clean.chars_saved == len(json.dumps(rows[0][2])) - len('{"ask": "why"}')
    assert tuple(found[1].clean)[1:] == (10, 0, 2, 0)
    assert json.loads(found[3].clean.cleaned)["system"][0]["cache_control"] == {"type": "ephemeral"}
    assert found[4].clean.cleaned == found[5].clean.cleaned == found[6].clean.cleaned
    assert [found[i].plain.input_tokens for i in (0, 2, 3, 4, 5)] == [7, 1, 5, 8, 8]
    assert [found[i].flow.output_tokens for i in (0, 1, 2)] == [2, 1, 1]
    # What is not reported is estimated.
    assert found[1].plain.input_tokens == max(1, len("q") // 4) and found[0].flow.input_tokens >= 13
    assert [found[i].text for i in range(7)] == ["a+b", "a", "LOUD", "hi", "", "x", None] or found[6].text in (None, "")
    assert [tuple(found[i].key) for i in (0, 2, 3, 4, 6)] == [("why", "2"), ("q", "2"), ("hello", "top"), ("hello", "s"), ("hello", "s")]


def test_steps_by_name_leave_no_condition(spark, providers):
    df = spark.range(1).select(F.parse_json(F.lit('{"ask":"x"}')).alias("p"))
    plan = df.select(C.cache_key_parts(F.col("p"), "echo").alias("k"))._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE" not in plan.upper()
