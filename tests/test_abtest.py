"""Scorecards on small recorded runs."""

import json

import pytest
from pyspark.sql import functions as F

from turnscope.operators import abtest as A
from turnscope.operators.conversation import CleanOptions, clean_payload
from turnscope.operators.protocol import candidate_response
from turnscope.sources.traces import read_trace, write_report

DUMP = "line of a tool result. " * 180


def trace(spark, records):
    rows = [(i + 1, json.dumps(r)) for i, r in enumerate(records)]
    return spark.createDataFrame(rows, "position bigint, j string").withColumn("tx", F.parse_json("j")).drop("j")


def request(*contents):
    turns = [{"role": "user" if i % 2 == 0 else "assistant", "content": c} for i, c in enumerate(contents)]
    return {"request": {"messages": turns}}


def result(i):
    return [{"type": "tool_result", "tool_use_id": f"t{i}", "content": DUMP}]


OFFLINE = [
    {
        "turn_id": "a",
        "provider": "anthropic",
        "cache_action": "MISS",
        "raw_request": request(result(1), "read", result(2), "again", "go on"),
        "response": {"usage": {"input_tokens": 1800}},
        "timing": {"ttft_ms": 900},
    },
    {
        "turn_id": "b",
        "provider": "anthropic",
        "cache_action": "HIT",
        "raw_request": request(result(1), "read", result(2), "again", result(3), "ok", "done"),
        "response": {"usage": {"input_tokens": 1800}},
        "timing": {"ttft_ms": 1100},
    },
]


def test_offline_scorecard(spark):
    t = trace(spark, [*OFFLINE, {"turn_id": "no request"}, {"raw_request": {"request": {}}}])
    row = A.offline_scorecard(t, fail_under=15.0).first()
    assert (row.total_turns, row.baseline_input_tokens, row.cache_hits, row.cache_hit_rate) == (2, 3600, 1, 50.0)
    assert row.token_reduction_pct > 20 and row.tool_calls_pruned >= 2
    assert row.semantic_parity_verified and row.passed_threshold and row.optimized_ttft_ms is None
    assert row.baseline_ttft_ms == 1000.0
    assert not A.offline_scorecard(t, fail_under=99.0).first().passed_threshold
    triple = A.offline_scorecard(t, rounds=3).first()
    assert (triple.total_turns, triple.baseline_input_tokens) == (6, 10800)
    assert triple.token_reduction_pct == row.token_reduction_pct


def test_another_cleaner(spark):
    """Another cleaner takes the place of the built-in one."""

    def lose_everything(df, payload, provider):
        cleaned = clean_payload(df, payload, provider, CleanOptions())
        return cleaned.withColumn("clean", F.col("clean").withField("cleaned", F.lit('{"messages":[]}')))

    turns = A.offline_turns(trace(spark, OFFLINE), cleaner=lose_everything)
    assert [r.semantic_parity for r in turns.collect()] == [False, False]
    assert not A.gate(A.scorecard(turns)).first().gate_passed


def run(mode, tokens, ttft, decode, status=200, **more):
    usage = {"input_tokens": tokens, **more.pop("usage", {})}
    return {
        "mode": mode,
        "turn_id": 1,
        "raw_request": request("hello"),
        "response": {"status": status, "usage": usage},
        "timing": {"ttft_ms": ttft, "decode_tps": decode},
        **more,
    }


@pytest.mark.parametrize(
    "base, new, expected",
    [
        (
            run("baseline", 1500, 1100, 40),
            run("optimized", 1000, 750, 52, usage={"cache_read_input_tokens": 500}),
            {"tokens_reduced": 500, "ttft_delta_ms": 350.0, "semantic_parity_verified": True, "cache_hits": 1},
        ),
        (
            run("baseline", 2000, 1200, 45),
            run("optimized", 1500, 900, 55, cache_action="hit", delta={"tool_calls_pruned": 4}),
            {"token_reduction_pct": 25.0, "ttft_delta_ms": 300.0, "cache_hit_rate": 100.0, "tool_calls_pruned": 4},
        ),
        (run("baseline", 100, 1, 1, status=500), run("optimized", 80, 1, 1), {"semantic_parity_verified": False}),
    ],
)
def test_paired_scorecard(spark, base, new, expected):
    row = A.paired_scorecard(trace(spark, [base]), trace(spark, [new, new]), "position").first()
    assert row.total_turns == 1
    assert {k: row[k] for k in expected} == expected


def test_empty_run_is_an_error(spark):
    one = trace(spark, [run("baseline", 1, 1, 1)])
    with pytest.raises(ValueError):
        A.paired_scorecard(one, one.limit(0), "position")


def test_default_ids(spark):
    t = trace(spark, [{"turn_id": "no request"}, {**OFFLINE[0], "turn_id": ""}, OFFLINE[1]])
    assert sorted(r.turn_id for r in A.offline_turns(t, rounds=2).collect()) == ["b", "b", "r1-t2", "r2-t2"]
    one = {k: v for k, v in run("baseline", 1, 1, 1).items() if k != "turn_id"}
    turns = A.paired_turns(trace(spark, [one, one]), trace(spark, [one, {**one, "turn_id": 7}]), "position")
    assert sorted(r.turn_id for r in turns.collect()) == ["7", "r1-t1"]


def test_two_logs_from_files(spark, tmp_path):
    paths = []
    for mode, tokens in (("baseline", 100), ("optimized", 60)):
        path = tmp_path / f"{mode}.jsonl"
        path.write_text("\n".join(json.dumps(run(mode, tokens, 1, 1)) for _ in range(5)))
        paths.append(read_trace(spark, str(path)))
    row = A.paired_scorecard(*paths, "ordinal").first()
    assert (row.total_turns, row.baseline_input_tokens, row.optimized_input_tokens) == (5, 500, 300)


def test_report(spark, tmp_path):
    path = str(tmp_path / "card")
    write_report(A.offline_scorecard(trace(spark, OFFLINE)), path)
    saved = spark.read.json(path).first()
    assert saved.total_turns == 2 and saved.mode.startswith("Offline")


def test_converted_reply(spark):
    reply = {
        "choices": [
            {"message": {"content": "hi", "tool_calls": [{"function": {"name": "f", "arguments": '{"a": 1}'}}]}},
            "skipped",
            {"index": 7, "finish_reason": "length", "message": {}},
        ],
        "usage": {"prompt_tokens": 3, "completion_tokens": 4},
    }
    df = spark.createDataFrame([(json.dumps(reply),)], "j string")
    found = json.loads(df.select(candidate_response(F.parse_json("j")).alias("r")).first().r)
    call = {"functionCall": {"name": "f", "args": {"a": 1}}}
    assert found == {
        "candidates": [
            {"index": 0, "content": {"role": "model", "parts": [{"text": "hi"}, call]}, "finishReason": "STOP"},
            {"index": 7, "content": {"role": "model", "parts": [{"text": ""}]}, "finishReason": "MAX_TOKENS"},
        ],
        "usageMetadata": {"promptTokenCount": 3, "candidatesTokenCount": 4, "totalTokenCount": 7},
    }
