"""Telemetry queries (sources, numbers, KPI row, windows over the log)."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnscope.functions import numbers as N
from turnscope.operators import kpi
from turnscope.operators.ordered import running_sum
from turnscope.plans.registry import query, table
from turnscope.plans.views import PROVIDER_SQL, TX_SQL, provider_of, wire_lines, wire_transactions
from turnscope.session import work_dir
from turnscope.sources.traces import parse_arrays, parse_lines, read_trace, union_traces, with_file_names

KPI_COLUMNS = """
    coalesce(nullif(count(distinct case when turn_no is not null then turn_type || turn_no end), 0), count(*)) as total_turns,
    count(*) as total_requests,
    count(*) filter (where cache_action = 'HIT') as cache_hits,
    count(*) filter (where cache_action <> 'HIT') as cache_misses,
    round_even(count(*) filter (where cache_action = 'HIT') / count(*), 4) as cache_hit_rate,
    round_even(sum(cache_read) / sum(input_tokens), 4) as provider_cache_hit_rate,
    cast(sum(tool_outputs_omitted) as bigint) as tool_calls_pruned,
    cast(sum(chars_saved) // 4 as bigint) as tokens_reduced,
    cast(sum(chars_saved) as bigint) as chars_saved,
    cast(0 as bigint) as turns_summarized,
    cast(sum(ordinal % 2) as bigint) as cache_control_injected,
    round_even(avg(ttft_s * 1000.0), 2) as avg_ttft_ms,
    round_even(coalesce(avg(decode_tps), 0), 2) as avg_decode_throughput_tps,
    round_even(arg_max(decode_tps, ordinal) filter (where decode_tps is not null), 2) as latest_decode_throughput_tps,
    count(decode_tps) as decode_samples,
    round_even(avg(prefill_tps), 2) as avg_prefill_throughput_tps,
    round_even(arg_max(prefill_tps, ordinal) filter (where prefill_tps is not null), 2) as latest_prefill_tps,
    round_even(avg(tail_tps), 2) as avg_tail_prefill_tps,
    round_even(arg_max(tail_tps, ordinal) filter (where tail_tps is not null), 2) as latest_tail_prefill_tps,
    round_even(arg_max(ttft_s * 1000.0, ordinal) filter (where ttft_s is not null), 2) as latest_ttft_ms,
    round_even(arg_max(total_s * 1000.0, ordinal) filter (where total_s is not null), 2) as latest_total_time_ms,
    cast(sum(input_tokens) as bigint) as total_input_tokens,
    cast(sum(output_tokens) as bigint) as total_output_tokens,
    cast(sum(cache_read) as bigint) as total_cache_read_tokens,
    cast(0 as bigint) as total_cache_creation_tokens,
    cast(sum(ordinal % 5) as bigint) as total_reasoning_tokens,
    'offline_wire_log' as source"""


@query("kpi_summary", f"with {TX_SQL} select {KPI_COLUMNS} from tx")
def kpi_summary(spark, folder):
    return kpi.kpi_summary(kpi.readings(wire_transactions(spark, folder)))


@query(
    "kpi_rollup",
    f"with {TX_SQL} select provider, mode, cast(grouping(provider, mode) as bigint) as level, {KPI_COLUMNS} from tx group by rollup (provider, mode)",
)
def kpi_rollup(spark, folder):
    t = wire_transactions(spark, folder)
    text = lambda k: F.try_variant_get("tx", f"$.{k}", "string").alias(k)
    rows = kpi.readings(t.select("ordinal", "tx", text("provider"), text("mode")), keep=("provider", "mode"))
    return kpi.kpi_summary(rows, by=["provider", "mode"], rollup=True)


@query(
    "scan_trace",
    f"""with {TX_SQL} select ordinal, provider, mode, cache_action from tx where ordinal % 13 not in (1, 2, 3, 4)""",
)
def scan_trace(spark, folder):
    i, v = F.col("ordinal"), F.col("value")
    dirty = (
        F.when(i % 13 == 0, F.concat(F.lit("﻿  "), v))
        .when(i % 13 == 1, "   ")
        .when(i % 13 == 2, F.concat(v, F.lit("}")).substr(F.lit(2), F.length(v)))
        .when(i % 13 == 3, "[1, 2]")
        .when(i % 13 == 4, F.left(v, F.length(v) - 3))
        .otherwise(v)
    )
    lines = wire_lines(spark, folder).select("ordinal", dirty.alias("value"))
    t = parse_lines(lines)
    get = lambda k: F.try_variant_get("tx", f"$.{k}", "string").alias(k)
    return t.select("ordinal", get("provider"), get("mode"), get("cache_action"))


@query(
    "scan_trace_array",
    f"""with {TX_SQL} select ordinal, k as line_no, case when k = 0 then provider else 'copy' end as provider
    from tx, (values (0), (2)) as s(k)""",
)
def scan_trace_array(spark, folder):
    lines = wire_lines(spark, folder)
    arrays = lines.select(
        "ordinal", F.concat(F.lit("["), "value", F.lit(', 7, {"provider":"copy"}]')).alias("value")
    )
    rows = parse_arrays(arrays)
    return rows.select("ordinal", "line_no", F.try_variant_get("tx", "$.provider", "string").alias("provider"))


@query(
    "read_trace_files",
    f"""with {TX_SQL} select provider, mode, cache_action, input_tokens, output_tokens, cast(chars_saved as bigint) as chars_saved from tx""",
)
def read_trace_files(spark, folder):
    """The log in many files, each third one array of records, read back by one call."""
    root = work_dir(spark, "mixed-log")
    rows = wire_lines(spark, folder).select("ordinal", "value", F.expr("ordinal div 512").alias("batch"))
    listed = F.col("batch") % 3 == 0
    arrays = rows.filter(listed).groupBy("batch").agg(
        F.concat(F.lit("[\n"), F.listagg("value", F.lit(",\n")), F.lit("]")).alias("value")
    )
    lines = rows.filter(~listed).repartition("batch").sortWithinPartitions("batch", "ordinal").drop("ordinal")
    arrays.write.partitionBy("batch").mode("append").text(root)
    lines.write.partitionBy("batch").mode("append").text(root)
    t = read_trace(spark, root)
    text = lambda k: F.try_variant_get("tx", f"$.{k}", "string").alias(k)
    number = lambda path, k: F.try_variant_get("tx", f"$.{path}.{k}", "bigint").alias(k)
    return t.select(
        text("provider"), text("mode"), text("cache_action"),
        number("response.usage", "input_tokens"), number("response.usage", "output_tokens"), number("delta", "chars_saved"),
    )


@query(
    "union_traces",
    f"""with {TX_SQL} select mode, count(*) as records, cast(sum(input_tokens) as bigint) as input_tokens from tx group by mode""",
)
def union_traces_query(spark, folder):
    t = wire_transactions(spark, folder).withColumn("mode", F.try_variant_get("tx", "$.mode", "string"))
    both = union_traces(t.filter("mode = 'baseline'"), t.filter("mode = 'optimized'").withColumn("extra", F.lit(1)))
    tokens = F.try_variant_get("tx", "$.response.usage.input_tokens", "bigint")
    return both.groupBy("mode").agg(F.count(F.lit(1)).alias("records"), F.sum(tokens).alias("input_tokens"))


@query(
    "wire_file_names",
    """select event_id, 'turn_' || regexp_replace(event_type || '/' || event_id, '[^a-zA-Z0-9_\\-]', '_', 'g') || '_'
       || regexp_replace(props, '[^a-zA-Z0-9_\\-]', '_', 'g') || '.json' as file_name from events""",
)
def wire_file_names(spark, folder):
    e = table(spark, folder, "events")
    named = with_file_names(
        e.select("event_id", F.concat("event_type", F.lit("/"), "event_id").alias("turn_id"), F.col("props").alias("flow_id"))
    )
    return named.select("event_id", "file_name")


@query(
    "json_report",
    f"""with {TX_SQL} select count(*) as total_requests, round_even(avg(value), 2) as avg_value,
    count(*) filter (where cache_action = 'HIT') as cache_hits from tx""",
)
def json_report(spark, folder):
    from turnscope.session import work_dir
    from turnscope.sources.traces import write_report

    e = table(spark, folder, "events")
    row = e.agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.avg("value").alias("avg_value"),
        F.count_if(F.col("event_type") == "view").alias("cache_hits"),
    )
    path = work_dir(spark, "report")
    write_report(row, path)
    return spark.read.schema(row.schema).json(path)


@query(
    "sink_wire_log",
    f"""with {TX_SQL} select ordinal, mode, provider, cache_action, input_tokens from tx""",
)
def sink_wire_log(spark, folder):
    from turnscope.session import work_dir
    from turnscope.sources.traces import read_wire_log, write_wire_log

    t = wire_transactions(spark, folder)
    get = lambda k: F.try_variant_get("tx", f"$.{k}", "string").alias(k)
    records = t.select(
        "ordinal",
        get("mode"),
        get("provider"),
        get("cache_action"),
        get("mode").alias("run"),
        F.struct(F.try_variant_get("tx", "$.response.usage.input_tokens", "bigint").alias("input_tokens")).alias("usage"),
    )
    path = work_dir(spark, "log") + "/transactions.jsonl"
    write_wire_log(records, path, partition_by="run")
    log = read_wire_log(spark, path.rsplit("/", 2)[0] + "/none", path.rsplit("/", 1)[0])
    whole = lambda k, name: F.try_variant_get("tx", f"$.{k}", "bigint").alias(name)
    return log.select(
        whole("ordinal", "ordinal"),
        get("mode"),
        get("provider"),
        get("cache_action"),
        whole("usage.input_tokens", "input_tokens"),
    )


@query(
    "scan_trace_dir",
    f"""with {TX_SQL} select mode, provider, cache_action, input_tokens, output_tokens, chars_saved from tx""",
)
def scan_trace_dir(spark, folder):
    from turnscope.session import work_dir
    from turnscope.sources.traces import read_trace_dir

    # The CSV writer with separators that no line holds writes text with a file suffix of one's own.
    path = work_dir(spark, "traces")
    lines = wire_lines(spark, folder).select("value", (F.col("ordinal") % 3).alias("run"))
    raw = {"sep": "\x01", "quote": "\x00", "escape": "\x00", "extension": "jsonl"}
    lines.write.options(**raw).partitionBy("run").csv(path)
    t = read_trace_dir(spark, path)
    get = lambda k: F.try_variant_get("tx", f"$.{k}", "string").alias(k)
    whole = lambda k: F.try_variant_get("tx", f"$.{k}", "bigint").alias(k.rsplit(".", 1)[-1])
    counts = ("response.usage.input_tokens", "response.usage.output_tokens", "delta.chars_saved")
    return t.select(get("mode"), get("provider"), get("cache_action"), *[whole(k) for k in counts])


# --- numbers, row by row ------------------------------------------------------------------------------


@query(
    "positive_readings",
    """select event_id, case when value - 5 > 0 then value - 5 end as positive,
    case when event_id % 3 = 0 then null when value > 0 then value end as from_text,
    case when event_id % 3 = 0 then 0 else event_id - 50 end as whole,
    case when event_id % 3 = 0 then 0 else greatest(event_id - 50, 0) end as counter from events""",
)
def positive_readings(spark, folder):
    e = table(spark, folder, "events")
    i, v = F.col("event_id"), F.col("value")
    bad = lambda x: F.when(i % 6 == 0, "NaN").when(i % 6 == 3, "n/a").otherwise(x.cast("string"))
    return e.select(
        "event_id",
        N.finite_positive(v - 5).alias("positive"),
        N.finite_positive(bad(v)).alias("from_text"),
        N.whole(F.when(i % 3 == 0, "x").otherwise((i - 50).cast("string"))).alias("whole"),
        N.counter(F.when(i % 3 == 0, "x").otherwise((i - 50).cast("string"))).alias("counter"),
    )


@query(
    "throughput_rates",
    f"""with {TX_SQL} select ordinal, prefill_tps, tail_tps as tail_prefill_tps,
    case when ordinal % 2 = 0 and output_tokens > 0 and value / 100 >= 0.05 then output_tokens / (value / 100) end as decode_tps
    from tx""",
)
def throughput_rates(spark, folder):
    r = kpi.readings(wire_transactions(spark, folder))
    v = table(spark, folder, "events").select(F.col("event_id").alias("ordinal"), "value")
    # Both sides have a row for each event, and the size of a compressed file says little of the size of its rows.
    j = r.join(v.hint("merge"), "ordinal")
    return j.select(
        "ordinal",
        N.prefill_rate(F.col("input_tokens"), F.col("ttft_s")).alias("prefill_tps"),
        N.tail_prefill_rate(F.col("input_tokens"), F.col("cache_read"), F.col("ttft_s")).alias("tail_prefill_tps"),
        N.decode_rate(F.col("output_tokens"), F.col("value") / 100, F.col("ordinal") % 2 == 0).alias("decode_tps"),
    )


@query(
    "rate_average",
    """select event_type, round_even(coalesce(avg(case when value > 100 then value end), 0.0), 6) as mean,
    case when count(case when value > 100 then 1 end) = 0 then 'unmeasured'
         else printf('%.2f', avg(case when value > 100 then value end)) end as label
    from events group by event_type""",
)
def rate_average(spark, folder):
    e = table(spark, folder, "events")
    big = F.when(F.col("value") > 100, F.col("value"))
    return e.groupBy("event_type").agg(
        F.bround(N.mean_or_zero(big), 6).alias("mean"), N.rate_label(F.avg(big)).alias("label")
    )


@query(
    "rate_labels",
    """select event_id, case when event_id % 4 = 0 then 'unmeasured' else printf('%.2f', value) end as label,
    case when event_id % 4 = 0 then null else value / 1000.0 end as seconds,
    case when event_id % 4 = 0 then event_id / 2 when value - 1 > 0 then value - 1 end as resolved from events""",
)
def rate_labels(spark, folder):
    e = table(spark, folder, "events")
    stored = F.when(F.col("event_id") % 4 != 0, F.col("value"))
    return e.select(
        "event_id",
        N.rate_label(stored).alias("label"),
        N.seconds(stored.cast("string")).alias("seconds"),
        N.stored_or_derived(stored - 1, F.col("event_id") / 2).alias("resolved"),
    )


@query(
    "token_estimates",
    """select doc_id, case when n > 0 then greatest(1, n // 4) else 0 end as tokens, greatest(1, n // 4) as at_least_one,
    cast(case when n > 0 then round_even((100 + doc_id) * least(1.0, greatest(0.0, (n // 2) / n)), 0) else 100 + doc_id end as bigint) as optimized,
    round_even(case when n > 0 then greatest(0, n - n // 2) / n * 100.0 else 0.0 end, 6) as reduction_pct
    from (select doc_id, length(text) as n from documents)""",
)
def token_estimates(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", F.length("text").cast("bigint").alias("n"))
    half = F.floor(F.col("n") / 2)
    return d.select(
        "doc_id",
        N.tokens_from_chars(F.col("n")).alias("tokens"),
        N.tokens_from_chars(F.col("n"), floor_at_one=True).alias("at_least_one"),
        N.optimized_tokens(F.col("doc_id") + 100, F.col("n"), half).alias("optimized"),
        F.bround(N.reduction_pct(F.col("n"), half), 6).alias("reduction_pct"),
    )


@query(
    "flow_timing",
    """with f as (
      select event_id, value, event_id % 4 as k, event_id % 3 <> 0 as streaming,
        case when event_id % 2 = 0 then 10.0 end as started,
        10.0 + value / 10 as first_chunk, 10.0 + value / 5 as last_chunk, 10.0 + value / 4 as completed
      from events),
    g as (
      select event_id, value, k, streaming,
        case when started is not null then started else 1000.0 end as s,
        case when started is not null then case when k = 0 then null else first_chunk end else 1000.0 + value / 8 end as c,
        case when started is not null then 10.0 + value / 20 else 1000.0 + value / 8 end as h,
        case when started is not null then case when streaming then coalesce(case when k <> 2 then last_chunk end, completed) else completed end
             else case when k = 1 then null else 1000.0 + value / 2 end end as e
      from f),
    p as (
      select event_id, streaming, c, e,
        case when coalesce(c, h) - s > 0 then coalesce(c, h) - s end as ttft,
        case when e - s > 0 then e - s end as total
      from g),
    q as (
      select event_id, streaming, ttft, total,
        case when streaming then case when c is not null and e is not null then case when e - c > 0 then e - c end
             when total - ttft > 0 then total - ttft end end as gen
      from p)
    select event_id, round_even(ttft, 6) as ttft_s, round_even(total, 6) as total_s, round_even(gen, 6) as generation_s,
      case when not streaming then 'non-streaming' when gen is null then 'no chunk window' else 'stream window' end as reason
    from q""",
)
def flow_timing(spark, folder):
    e = table(spark, folder, "events")
    i, v = F.col("event_id"), F.col("value")
    k, streaming = i % 4, i % 3 != 0
    timed = e.select(
        "event_id",
        streaming.alias("streaming"),
        N.flow_timing(
            F.when(i % 2 == 0, F.lit(10.0)),
            F.lit(10.0) + v / 20,
            F.when(k != 0, F.lit(10.0) + v / 10),
            F.when(k != 2, F.lit(10.0) + v / 5),
            F.lit(10.0) + v / 4,
            F.lit(1000.0),
            F.lit(1000.0) + v / 8,
            F.when(k != 1, F.lit(1000.0) + v / 2),
            streaming,
        ).alias("t"),
    )
    six = lambda n: F.bround(F.col(f"t.{n}"), 6).alias(n)
    reason = N.decode_reason(F.col("streaming"), F.col("t.generation_s"))
    return timed.select(
        "event_id", six("ttft_s"), six("total_s"), six("generation_s"),
        F.regexp_replace(reason, " \\d+ms below floor", "").alias("reason"),
    )


@query(
    "first_usable_stamp",
    """select event_id, coalesce(case when value - 10 > 0 then value - 10 end,
       case when event_id % 2 = 0 and value > 0 then value end) as stamp from events""",
)
def first_usable_stamp(spark, folder):
    e = table(spark, folder, "events")
    text = F.when(F.col("event_id") % 2 == 0, F.col("value").cast("string")).otherwise("later")
    return e.select("event_id", N.first_stamp(F.col("value") - 10, text).alias("stamp"))


# --- log-level aggregates -----------------------------------------------------------------------------


@query(
    "total_turns",
    f"""with {TX_SQL} select provider, coalesce(nullif(count(distinct case when turn_no is not null then turn_type || turn_no end), 0), count(*))
    as total_turns from tx group by provider""",
)
def total_turns(spark, folder):
    r = kpi.readings(wire_transactions(spark, folder)).withColumn("provider", provider_of(F.col("ordinal")))
    return r.groupBy("provider").agg(kpi.total_turns().alias("total_turns"))


@query(
    "latest_value",
    f"""with {TX_SQL} select provider, arg_max(decode_tps, ordinal) filter (where decode_tps is not null) as latest_decode,
    arg_max(ttft_s, ordinal) filter (where ttft_s is not null) as latest_ttft from tx group by provider""",
)
def latest_value(spark, folder):
    r = kpi.readings(wire_transactions(spark, folder)).withColumn("provider", provider_of(F.col("ordinal")))
    return r.groupBy("provider").agg(
        kpi.latest(F.col("decode_tps"), F.col("ordinal")).alias("latest_decode"),
        kpi.latest(F.col("ttft_s"), F.col("ordinal")).alias("latest_ttft"),
    )


LIVE_SQL = f"""
live as (
  select *, case when cache_action = 'HIT' then 'hit' when ordinal % 50 = 49 then 'failure' else 'response' end as kind from tx)"""

LIVE_COLUMNS = """
    count(*) as total_requests, count(*) as total_turns,
    count(*) filter (where kind = 'hit') as cache_hits,
    count(*) filter (where kind <> 'hit') as cache_misses,
    round_even(count(*) filter (where kind = 'hit') / count(*), 4) as cache_hit_rate,
    round_even(coalesce(sum(case when kind = 'response' then cache_read end)
      / nullif(sum(case when kind = 'response' then input_tokens end), 0), 0), 4) as provider_cache_hit_rate,
    cast(sum(chars_saved) as bigint) as chars_saved, cast(sum(chars_saved // 4) as bigint) as tokens_reduced,
    cast(sum(tool_outputs_omitted) as bigint) as tool_calls_pruned,
    cast(sum(case when kind = 'response' then input_tokens else 0 end) as bigint) as total_input_tokens,
    cast(sum(case when kind = 'response' then output_tokens else 0 end) as bigint) as total_output_tokens,
    cast(sum(case when kind = 'response' then cache_read else 0 end) as bigint) as total_cache_read_tokens,
    cast(0 as bigint) as turns_summarized, cast(sum(ordinal % 2) as bigint) as cache_control_injected,
    cast(0 as bigint) as total_cache_creation_tokens,
    cast(sum(case when kind = 'response' then ordinal % 5 else 0 end) as bigint) as total_reasoning_tokens,
    round_even(avg(case when kind = 'response' then ttft_s * 1000.0 end), 2) as avg_ttft_ms,
    round_even(avg(case when kind = 'response' then decode_tps end), 2) as avg_decode_throughput_tps,
    round_even(arg_max(decode_tps, ordinal) filter (where kind = 'response' and decode_tps is not null), 2) as latest_decode_throughput_tps,
    count(case when kind = 'response' then decode_tps end) as decode_samples,
    round_even(avg(case when kind = 'response' then prefill_tps end), 2) as avg_prefill_throughput_tps,
    avg_prefill_throughput_tps as avg_prompt_prefill_speed_tps,
    round_even(arg_max(prefill_tps, ordinal) filter (where kind = 'response' and prefill_tps is not null), 2) as latest_prefill_tps,
    latest_prefill_tps as latest_prefill_throughput_tps,
    round_even(avg(case when kind = 'response' then tail_tps end), 2) as avg_tail_prefill_tps,
    avg_tail_prefill_tps as avg_tail_prefill_throughput_tps, avg_tail_prefill_tps as avg_tail_prefill_speed_tps,
    round_even(arg_max(tail_tps, ordinal) filter (where kind = 'response' and tail_tps is not null), 2) as latest_tail_prefill_tps,
    latest_tail_prefill_tps as latest_tail_prefill_throughput_tps,
    round_even(arg_max(ttft_s * 1000.0, ordinal) filter (where kind = 'response' and ttft_s is not null), 2) as latest_ttft_ms,
    round_even(arg_max(total_s * 1000.0, ordinal) filter (where kind = 'response' and total_s is not null), 2) as latest_total_time_ms"""


def live_rows(transactions):
    kind = (
        F.when(F.col("is_hit"), "hit").when(F.col("ordinal") % 50 == 49, "failure").otherwise("response")
    )
    return kpi.readings(transactions).withColumn("kind", kind)


@query("kpi_live", f"with {TX_SQL}, {LIVE_SQL} select {LIVE_COLUMNS} from live")
def kpi_live(spark, folder):
    return kpi.live_snapshot(live_rows(wire_transactions(spark, folder)).agg(*kpi.live_aggregates()))


@query(
    "hit_rate",
    f"""with {TX_SQL} select count(*) filter (where cache_action = 'HIT') as cache_hits, count(*) as total_requests,
    count(*) filter (where cache_action = 'HIT') / count(*) as hit_rate from tx""",
)
def hit_rate(spark, folder):
    return kpi.hit_rate(kpi.readings(wire_transactions(spark, folder)))


@query(
    "running_hit_rate",
    f"""select event_id, cast(sum(case when event_type = 'view' then 1 else 0 end) over (order by event_id) as bigint) as hits,
    round_even(sum(case when event_type = 'view' then 1 else 0 end) over (order by event_id) / (row_number() over (order by event_id)), 6)
    as hit_rate from events""",
)
def running_hit_rate(spark, folder):
    e = table(spark, folder, "events")
    hit = (F.col("event_type") == "view").cast("bigint")
    r = running_sum(e, [], "event_id", {"hits": hit, "requests": F.lit(1).cast("bigint")}, width=4096)
    return r.select("event_id", "hits", F.bround(F.col("hits") / F.col("requests"), 6).alias("hit_rate"))


@query(
    "running_hit_rate_by_provider",
    f"""select event_id, provider, cast(sum(hit) over w as bigint) as hits, cast(count(*) over w as bigint) as requests
    from (select event_id, {PROVIDER_SQL} as provider, case when event_type = 'view' then 1 else 0 end as hit from events)
    window w as (partition by provider order by event_id rows unbounded preceding)""",
)
def running_hit_rate_by_provider(spark, folder):
    e = table(spark, folder, "events").withColumn("provider", provider_of(F.col("event_id")))
    hit = (F.col("event_type") == "view").cast("bigint")
    r = running_sum(e, ["provider"], "event_id", {"hits": hit, "requests": F.lit(1).cast("bigint")}, width=1024)
    return r.select("event_id", "provider", "hits", "requests")
