"""Telemetry over the transaction log: one row of counters, averages and latest readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnscope.functions import numbers as N
from turnscope.functions import variants as V

USAGE = (
    "input_tokens",
    "output_tokens",
    "cache_read_input_tokens",
    "cache_creation_input_tokens",
    "reasoning_tokens",
)
DELTAS = ("tool_outputs_omitted", "chars_saved", "turns_summarized", "cache_control_injected")


def readings(transactions: DataFrame, tx: str = "tx", ordinal: str = "ordinal", keep: tuple[str, ...] = ()) -> DataFrame:
    """Typed readings of each transaction variant: identity, counters, times and rates, and the columns to ``keep``.

    ``decode_tps`` tells an absent key from a null one: absent means an old record, whose rate is
    derived from its times; null means the writer could not measure it.
    """
    t = F.col(tx)
    counters = ", ".join(f"{k}: bigint" for k in (*USAGE, "thinking_tokens"))
    rates = ("ttft_ms", "total_ms", "prefill_tps", "tail_prefill_tps", "decode_tps")
    # Each section is read in one pass over its object; fields that do not fit become NULL.
    sections = transactions.select(
        *keep,
        F.col(ordinal).alias("ordinal"),
        V.at(t, "$.turn_id").alias("_turn"),
        (V.text_of(t, "$.cache_action") == "HIT").alias("is_hit"),
        F.try_variant_get(t, "$.delta", f"struct<{', '.join(f'{k}: bigint' for k in DELTAS)}>").alias("_delta"),
        F.try_variant_get(t, "$.response.usage", f"struct<{counters}>").alias("_usage"),
        F.try_variant_get(t, "$.timing", f"struct<{', '.join(f'{k}: variant' for k in rates)}>").alias("_timing"),
    )
    count = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    usage = lambda k: count(F.col(f"_usage.{k}"))
    number = lambda k: V.number_at(F.col(f"_timing.{k}"), "$")
    base = sections.select(
        *keep,
        "ordinal",
        V.text_of(F.col("_turn"), "$").alias("turn_id"),
        V.kind(F.col("_turn")).alias("turn_id_type"),
        "is_hit",
        *[count(F.col(f"_delta.{k}")).alias(k) for k in DELTAS],
        usage("input_tokens").alias("input_tokens"),
        usage("output_tokens").alias("output_tokens"),
        usage("cache_read_input_tokens").alias("cache_read"),
        usage("cache_creation_input_tokens").alias("cache_creation"),
        F.coalesce(F.nullif(usage("reasoning_tokens"), F.lit(0)), usage("thinking_tokens")).alias("reasoning"),
        N.finite_positive(number("ttft_ms") / 1000.0).alias("ttft_s"),
        N.finite_positive(number("total_ms") / 1000.0).alias("total_s"),
        number("prefill_tps").alias("stored_prefill"),
        number("tail_prefill_tps").alias("stored_tail"),
        number("decode_tps").alias("stored_decode"),
        F.col("_timing.decode_tps").isNotNull().alias("has_decode"),
    )
    return with_rates(base)


def with_rates(base: DataFrame) -> DataFrame:
    """Add ``prefill_tps``, ``tail_prefill_tps`` and ``decode_tps`` to typed readings."""
    c = F.col
    legacy = N.decode_rate(c("output_tokens"), c("total_s") - c("ttft_s"), F.lit(True))
    return base.select(
        "*",
        N.stored_or_derived(c("stored_prefill"), N.prefill_rate(c("input_tokens"), c("ttft_s"))).alias("prefill_tps"),
        N.stored_or_derived(
            c("stored_tail"), N.tail_prefill_rate(c("input_tokens"), c("cache_read"), c("ttft_s"))
        ).alias("tail_prefill_tps"),
        F.when(c("has_decode"), N.finite_positive(c("stored_decode"))).otherwise(legacy).alias("decode_tps"),
    )


def latest(value: Column, ordinal: Column) -> Column:
    """Aggregate: the last measured reading in log order, 0.0 when there is none."""
    return F.coalesce(F.max_by(value, F.when(value.isNotNull(), ordinal)), F.lit(0.0))


def total_turns() -> Column:
    """Distinct turn ids (a number and its text are two ids), or the request count when no row has one."""
    ids = F.count_distinct(F.when(F.col("turn_id").isNotNull(), F.struct("turn_id", "turn_id_type")))
    return F.coalesce(F.nullif(ids, F.lit(0)), F.count(F.lit(1)))


# Sums of the telemetry row by the reading they add up, and its averages and latest readings with their scale.
SUMS = {
    "tool_calls_pruned": "tool_outputs_omitted",
    "chars_saved": "chars_saved",
    "turns_summarized": "turns_summarized",
    "cache_control_injected": "cache_control_injected",
    "total_input_tokens": "input_tokens",
    "total_output_tokens": "output_tokens",
    "total_cache_read_tokens": "cache_read",
    "total_cache_creation_tokens": "cache_creation",
    "total_reasoning_tokens": "reasoning",
}
MEANS = {
    "avg_ttft_ms": ("ttft_s", 1000.0),
    "avg_decode_throughput_tps": ("decode_tps", 1.0),
    "avg_prefill_throughput_tps": ("prefill_tps", 1.0),
    "avg_tail_prefill_tps": ("tail_prefill_tps", 1.0),
}
LATEST = {
    "latest_decode_throughput_tps": ("decode_tps", 1.0),
    "latest_prefill_tps": ("prefill_tps", 1.0),
    "latest_tail_prefill_tps": ("tail_prefill_tps", 1.0),
    "latest_ttft_ms": ("ttft_s", 1000.0),
    "latest_total_time_ms": ("total_s", 1000.0),
}


def _added() -> list[Column]:
    """Aggregates that add up rows of sums, counts and latest readings to one of the same shape."""
    sums = ("total_requests", "cache_hits", *SUMS, *MEANS, *[f"count_{name}" for name in MEANS])
    return [*[F.sum(name).alias(name) for name in sums], *[F.max(name).alias(name) for name in LATEST]]


def kpi_summary(
    rows: DataFrame,
    source: str = "offline_wire_log",
    by: list[str] | None = None,
    exact_turns: bool = True,
    rollup: bool = False,
) -> DataFrame:
    """Reduce readings to one row (or one per ``by``), in one pass over them.

    Two levels: first one row of sums, counts and latest readings per turn id (all rows without an id are one), then
    these are added up and the ids counted. So the log is read once, a task ships one row per id it has seen, and no
    counter travels more often than that. Without ``exact_turns`` ids are estimated and a task ships one row.

    With ``rollup`` there are also rows for each shorter list of ``by`` down to none; ``level`` is the number of columns
    left out as Spark's grouping id gives it. They are made from the rows per id, where an id that stands in several
    groups is added up before it is counted.
    """
    c = F.col
    by = by or []
    if rollup and not exact_turns:
        raise ValueError("a rollup counts its turns exactly")
    ids = ["turn_id", "turn_id_type"] if exact_turns else []
    estimate = F.approx_count_distinct(F.when(c("turn_id").isNotNull(), F.xxhash64("turn_id", "turn_id_type")))
    states = rows.groupBy(*by, *ids).agg(
        *([] if exact_turns else [estimate.alias("ids")]),
        F.count(F.lit(1)).alias("total_requests"),
        F.sum(F.coalesce(c("is_hit"), F.lit(False)).cast("bigint")).alias("cache_hits"),
        *[F.sum(reading).alias(name) for name, reading in SUMS.items()],
        *[F.sum(c(reading) * scale).alias(name) for name, (reading, scale) in MEANS.items()],
        *[F.count(reading).alias(f"count_{name}") for name, (reading, _) in MEANS.items()],
        *[
            F.max(F.when(c(reading).isNotNull(), F.struct("ordinal", (c(reading) * scale).alias("value")))).alias(name)
            for name, (reading, scale) in LATEST.items()
        ],
    )
    if rollup:
        sets = [[*by[:k], *ids] for k in range(len(by), -1, -1)]
        level = F.shiftright(F.grouping_id(), len(ids)).alias("level")
        states = states.groupingSets(sets, *by, *ids).agg(level, *_added())
        by = [*by, "level"]
    turns = F.count("turn_id") if exact_turns else F.max("ids")
    added = states.groupBy(*by).agg(turns.alias("distinct_turns"), *_added()).filter(c("total_requests") > 0)
    known = F.nullif(c("distinct_turns"), F.lit(0).cast("bigint"))
    reduced = added.select(
        *by,
        "total_requests",
        "cache_hits",
        *SUMS,
        *[F.coalesce(F.try_divide(c(name), c(f"count_{name}")), F.lit(0.0)).alias(name) for name in MEANS],
        c("count_avg_decode_throughput_tps").alias("decode_samples"),
        *[F.coalesce(c(name)["value"], F.lit(0.0)).alias(name) for name in LATEST],
        F.coalesce(known, c("total_requests")).alias("total_turns"),
    )
    rounded = [
        F.bround(c(f.name), 2).alias(f.name) if f.dataType.typeName() == "double" else c(f.name)
        for f in reduced.schema
    ]
    return reduced.select(
        *rounded,
        F.greatest(F.lit(0), c("total_requests") - c("cache_hits")).alias("cache_misses"),
        F.bround(N.ratio_or_zero(c("cache_hits"), c("total_requests")), 4).alias("cache_hit_rate"),
        F.bround(N.ratio_or_zero(c("total_cache_read_tokens"), c("total_input_tokens")), 4).alias(
            "provider_cache_hit_rate"
        ),
        F.floor(c("chars_saved") / 4).cast("bigint").alias("tokens_reduced"),
        F.lit(source).alias("source"),
    )


# Averaged and latest readings of the live view, and the scale of the value.
LIVE_READINGS = {"ttft_s": 1000.0, "decode_tps": 1.0, "prefill_tps": 1.0, "tail_prefill_tps": 1.0, "total_s": 1000.0}


def live_aggregates() -> list[Column]:
    """Counters of the live view, over rows with ``kind`` hit, response or failure.

    A hit counts as a request and a turn, and adds no tokens or times; a failure adds a turn with zeros.
    Tokens saved are rounded down per request, before the sum.
    """
    c = F.col
    answered = c("kind") == "response"
    only = lambda v: F.when(answered, v)
    tokens = lambda v: F.sum(F.coalesce(only(c(v)), F.lit(0)))
    readings = []
    for name, scale in LIVE_READINGS.items():
        value = only(c(name)) * scale
        readings += [
            F.sum(F.coalesce(value, F.lit(0.0))).alias(f"sum_{name}"),
            F.count(value).alias(f"count_{name}"),
            F.max_by(value, F.when(value.isNotNull(), c("ordinal"))).alias(f"latest_{name}"),
        ]
    return [
        F.count(F.lit(1)).alias("total_requests"),
        F.count(F.lit(1)).alias("total_turns"),
        F.sum((c("kind") == "hit").cast("bigint")).alias("cache_hits"),
        F.sum("chars_saved").alias("chars_saved"),
        F.sum(F.floor(c("chars_saved") / 4)).cast("bigint").alias("tokens_reduced"),
        F.sum("tool_outputs_omitted").alias("tool_calls_pruned"),
        F.sum("turns_summarized").alias("turns_summarized"),
        F.sum("cache_control_injected").alias("cache_control_injected"),
        tokens("input_tokens").alias("total_input_tokens"),
        tokens("output_tokens").alias("total_output_tokens"),
        tokens("cache_read").alias("total_cache_read_tokens"),
        tokens("cache_creation").alias("total_cache_creation_tokens"),
        tokens("reasoning").alias("total_reasoning_tokens"),
        *readings,
    ]


def live_snapshot(counted: DataFrame) -> DataFrame:
    """Rates of the live view from its counters, with all names each prefill rate goes by."""
    c = F.col
    mean = lambda n: F.bround(N.ratio_or_zero(c(f"sum_{n}"), c(f"count_{n}")), 2)
    last = lambda n: F.bround(F.coalesce(c(f"latest_{n}"), F.lit(0.0)), 2)
    named = {
        "avg_ttft_ms": mean("ttft_s"),
        "avg_decode_throughput_tps": mean("decode_tps"),
        "latest_decode_throughput_tps": last("decode_tps"),
        "decode_samples": c("count_decode_tps"),
        "avg_prefill_throughput_tps": mean("prefill_tps"),
        "avg_prompt_prefill_speed_tps": mean("prefill_tps"),
        "latest_prefill_tps": last("prefill_tps"),
        "latest_prefill_throughput_tps": last("prefill_tps"),
        "avg_tail_prefill_tps": mean("tail_prefill_tps"),
        "avg_tail_prefill_throughput_tps": mean("tail_prefill_tps"),
        "avg_tail_prefill_speed_tps": mean("tail_prefill_tps"),
        "latest_tail_prefill_tps": last("tail_prefill_tps"),
        "latest_tail_prefill_throughput_tps": last("tail_prefill_tps"),
        "latest_ttft_ms": last("ttft_s"),
        "latest_total_time_ms": last("total_s"),
    }
    return counted.select(
        "total_requests",
        "total_turns",
        "cache_hits",
        (c("total_requests") - c("cache_hits")).alias("cache_misses"),
        F.bround(N.ratio_or_zero(c("cache_hits"), c("total_requests")), 4).alias("cache_hit_rate"),
        F.bround(N.ratio_or_zero(c("total_cache_read_tokens"), c("total_input_tokens")), 4).alias(
            "provider_cache_hit_rate"
        ),
        "chars_saved",
        "tokens_reduced",
        "tool_calls_pruned",
        "turns_summarized",
        "cache_control_injected",
        "total_input_tokens",
        "total_output_tokens",
        "total_cache_read_tokens",
        "total_cache_creation_tokens",
        "total_reasoning_tokens",
        *[value.alias(name) for name, value in named.items()],
    )


def hit_rate(rows: DataFrame) -> DataFrame:
    """Hits per request, 0 before the first request."""
    hits = F.coalesce(F.sum(F.col("is_hit").cast("bigint")), F.lit(0))
    return rows.agg(hits.alias("cache_hits"), F.count(F.lit(1)).alias("total_requests")).withColumn(
        "hit_rate", N.ratio_or_zero(F.col("cache_hits"), F.col("total_requests"))
    )
