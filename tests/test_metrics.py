"""The telemetry row on the two-record example, and the rules for rates."""

import json

from pyspark.sql import functions as F

from turnscope.functions import numbers as N
from turnscope.operators import kpi
from turnscope.sources.traces import parse_lines

RECORDS = [
    {
        "turn_id": "turn-1",
        "cache_action": "HIT",
        "delta": {"tool_outputs_omitted": 2, "chars_saved": 400, "turns_summarized": 1, "cache_control_injected": 1},
        "response": {
            "usage": {
                "input_tokens": 1000,
                "output_tokens": 200,
                "cache_read_input_tokens": 600,
                "cache_creation_input_tokens": 100,
                "reasoning_tokens": 50,
            }
        },
        "timing": {"ttft_ms": 250, "total_ms": 1250, "prefill_tps": 4000, "tail_prefill_tps": 1600, "decode_tps": 200},
    },
    {
        "turn_id": "turn-2",
        "cache_action": "MISS",
        "delta": {"tool_outputs_omitted": 1, "chars_saved": 200, "turns_summarized": 0, "cache_control_injected": 0},
        "response": {"usage": {"input_tokens": 1500, "output_tokens": 300}},
        "timing": {"ttft_ms": 500, "total_ms": 2000, "decode_tps": 200},
    },
]


def log(spark, records, extra=()):
    rows = [(i, text) for i, text in enumerate([*extra, *map(json.dumps, records)])]
    return parse_lines(spark.createDataFrame(rows, "ordinal bigint, value string"))


def test_two_records(spark):
    row = kpi.kpi_summary(kpi.readings(log(spark, RECORDS, ["{broken", "", "[1]", "7"]))).first()
    expected = {
        "total_requests": 2,
        "total_turns": 2,
        "cache_hits": 1,
        "cache_misses": 1,
        "cache_hit_rate": 0.5,
        "tool_calls_pruned": 3,
        "chars_saved": 600,
        "tokens_reduced": 150,
        "turns_summarized": 1,
        "cache_control_injected": 1,
        "total_input_tokens": 2500,
        "total_output_tokens": 500,
        "total_cache_read_tokens": 600,
        "total_cache_creation_tokens": 100,
        "total_reasoning_tokens": 50,
        "provider_cache_hit_rate": 0.24,
        "avg_ttft_ms": 375.0,
        "avg_decode_throughput_tps": 200.0,
        "source": "offline_wire_log",
    }
    assert {k: row[k] for k in expected} == expected


def test_no_records_no_row(spark):
    assert kpi.kpi_summary(kpi.readings(log(spark, [], ["{x", "[]"]))).count() == 0


def test_absent_null_and_short_windows(spark):
    usage = {"usage": {"output_tokens": 100}}
    records = [
        {"response": usage, "timing": {"ttft_ms": 100, "total_ms": 600}},
        {"response": usage, "timing": {"ttft_ms": 100, "total_ms": 600, "decode_tps": None}},
        {"response": usage, "timing": {"ttft_ms": 100, "total_ms": 140}},
        {"response": usage, "timing": {"ttft_ms": True, "total_ms": "600", "decode_tps": "12.5"}},
        {"response": "gone", "timing": [], "delta": 4},
    ]
    rows = kpi.readings(log(spark, records)).orderBy("ordinal").collect()
    assert [r.decode_tps for r in rows] == [200.0, None, None, 12.5, None]
    assert rows[3].ttft_s is None and rows[3].total_s == 0.6


def test_ids_count_by_type(spark):
    records = [{"turn_id": 1}, {"turn_id": "1"}, {"turn_id": 1}, {"turn_id": None}, {}]
    assert kpi.kpi_summary(kpi.readings(log(spark, records))).first().total_turns == 2
    assert kpi.kpi_summary(kpi.readings(log(spark, [{}, {}, {}]))).first().total_turns == 3


def test_rollup_counts_an_id_of_several_groups_once(spark):
    modes = ["a", "a", "b", "b", None]
    records = [{"turn_id": t, "mode": m} for t, m in zip([1, 1, 1, 2, None], modes)]
    t = log(spark, records).withColumn("mode", F.try_variant_get("tx", "$.mode", "string"))
    found = kpi.kpi_summary(kpi.readings(t, keep=("mode",)), by=["mode"], rollup=True)
    rows = {(r["mode"], r.level): (r.total_turns, r.total_requests) for r in found.collect()}
    assert rows == {("a", 0): (1, 2), ("b", 0): (2, 2), (None, 0): (1, 1), (None, 1): (2, 5)}


def test_the_log_is_read_once(spark):
    plan = kpi.kpi_summary(kpi.readings(log(spark, RECORDS)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1


def test_stored_rates(spark):
    rows = [(45.5, 30.0, 45.5), (None, 30.0, 30.0), (0.0, 30.0, None)]
    df = spark.createDataFrame(rows, "stored double, derived double, expected double")
    found = df.select("expected", N.stored_or_derived(F.col("stored"), F.col("derived")).alias("r")).collect()
    assert all(r.expected == r.r for r in found)


def test_unusable_numbers(spark):
    texts = ["1.5", "0", "-3", "NaN", "Infinity", "-Infinity", "x", None, "1e400"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.v for r in df.select(N.finite_positive(F.col("t")).alias("v")).collect()] == [1.5] + [None] * 8
