"""Queries that run a stream over the test tables to its end and return what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnscope.functions import variants as V
from turnscope.operators.replay import replay
from turnscope.operators.usage import stream_rows
from turnscope.plans.kpi_queries import LIVE_COLUMNS, LIVE_SQL, live_rows
from turnscope.plans.registry import query, table
from turnscope.plans.usage_queries import tool_streams
from turnscope.plans.views import PROVIDER_SQL, TX_SQL, lines_of, provider_of
from turnscope.session import work_dir
from turnscope.sources.traces import parse_lines
from turnscope.streaming import live, stateful


def stream(spark, folder, name):
    """A table (one file, or a folder of files) as a file stream, event times as instants."""
    found = table(spark, folder, name)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    reader = spark.readStream.schema(found.schema)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        rows = reader.parquet(f"{folder}/{name}.parquet")
    else:
        rows = reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in found.columns else rows


def _append(df, spark, label):
    """Run an append stream to its end and read the table it wrote."""
    path = work_dir(spark, label)
    live.append_to(df, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/out")


def _in_batches(spark, rows, label, time, batches=4):
    """The rows as a stream of about so many micro-batches in order of time."""
    path = work_dir(spark, label)
    micros = F.unix_micros(time)
    # One row of a few numbers.
    cuts = rows.agg(F.percentile_approx(micros, [k / batches for k in range(1, batches)])).first()[0] or []
    part = sum(((micros > c).cast("int") for c in cuts), F.lit(0))
    for k in range(batches):
        # Each write is a little later than the one before, which is the order the stream reads the files in.
        rows.filter(part == k).write.mode("append").parquet(path)
    files = max(1, rows.sparkSession.sparkContext.defaultParallelism)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


FLOW_SQL = """
    gaps as (
      select user_id, ts, length(props) as bytes, ts > lag(ts) over (partition by user_id order by ts) + interval 6 hours as fresh from events),
    lives as (select *, count(*) filter (where fresh) over (partition by user_id order by ts) as life from gaps),
    flows as (
      select user_id as flow_id, min(ts) as first_chunk, max(ts) as last_chunk, cast(sum(bytes) as bigint) as bytes, count(*) as chunks
      from lives group by user_id, life)"""


def _chunks(e):
    return e.select(F.col("user_id").alias("flow_id"), F.col("ts").cast("timestamp").alias("ts"), F.length("props").alias("bytes"))


@query(
    "stream_flow_timing",
    f"with {FLOW_SQL} select * from flows where last_chunk + interval 6 hours <= (select max(ts) from events) - interval 10 minutes",
)
def stream_flow_timing(spark, folder):
    """Flows that have ended by the end of the stream, over several micro-batches."""
    chunks = _in_batches(spark, _chunks(table(spark, folder, "events")), "chunks", "ts")
    return _append(live.flows(chunks, "6 hours"), spark, "flows")


@query("flow_lives", f"with {FLOW_SQL} select * from flows")
def flow_lives(spark, folder):
    return live.flows(_chunks(table(spark, folder, "events")), "6 hours")


@query(
    "buffered_chunks",
    """select flow_id, count(*) as kept, cast(sum(bytes) as bigint) as bytes from (
      select user_id as flow_id, length(props) as bytes, sum(length(props)) over (partition by user_id order by event_id) as filled from events)
    where filled <= 400 group by flow_id""",
)
def buffered_chunks(spark, folder):
    e = table(spark, folder, "events")
    chunks = e.select("event_id", F.col("user_id").alias("flow_id"), F.length("props").alias("bytes"))
    kept = live.buffered_chunks(chunks, "event_id", 400)
    return kept.groupBy("flow_id").agg(F.count(F.lit(1)).alias("kept"), F.sum("bytes").alias("bytes"))


@query("stream_kpi", f"with {TX_SQL}, {LIVE_SQL} select {LIVE_COLUMNS} from live")
def stream_kpi(spark, folder):
    rows = live_rows(parse_lines(lines_of(stream(spark, folder, "events"))))
    path = work_dir(spark, "kpi")
    live.stream_kpi(rows, path, f"{path}-checkpoint").awaitTermination()
    return live.latest_snapshot(spark, path)


@query(
    "stream_exchange",
    f"""select event_id as flow_id, {PROVIDER_SQL} as provider, ts as asked_at, ts + to_milliseconds(event_id % 1000) as answered_at, event_id % 7 as status
    from events where event_id % 3 <> 2 and event_type not in ('view', 'error')""",
)
def stream_exchange(spark, folder):
    i = F.col("event_id")
    provider = F.when(i % 3 == 2, "unknown").otherwise(provider_of(i))
    requests = stream(spark, folder, "events").select(
        i.alias("flow_id"), provider.alias("provider"), F.col("ts").alias("asked_at"), (F.col("event_type") == "view").alias("cached")
    )
    later = F.timestamp_micros(F.unix_micros("ts") + (i % 1000) * 1000)
    replies = (
        stream(spark, folder, "events")
        .filter(F.col("event_type") != "error")
        .select(i.alias("flow_id"), later.alias("answered_at"), (i % 7).alias("status"))
    )
    return _append(live.correlate(requests, replies).drop("cached"), spark, "exchange")


ASKED_SQL = f"""
    asked as (
      select event_id as flow_id, {PROVIDER_SQL} as provider, ts as asked_at, event_id % 7 as status,
        case when event_type <> 'error' then ts + to_milliseconds(event_id % 1000) end as answered_at
      from events where event_id % 3 <> 2 and event_type <> 'view'),
    ended as (
      select * from asked where answered_at is not null or asked_at + interval 2 hours <
        least((select max(ts) from events), (select max(ts + to_milliseconds(event_id % 1000)) from events where event_type <> 'error')))"""


def _exchanges(spark, folder, unanswered):
    i = F.col("event_id")
    e = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    provider = F.when(i % 3 == 2, "unknown").otherwise(provider_of(i))
    requests = e.select(
        i.alias("flow_id"), provider.alias("provider"), F.col("ts").alias("asked_at"), (F.col("event_type") == "view").alias("cached")
    )
    later = F.timestamp_micros(F.unix_micros("ts") + (i % 1000) * 1000)
    replies = e.filter(F.col("event_type") != "error").select(i.alias("flow_id"), later.alias("answered_at"), (i % 7).alias("status"))
    asked = _in_batches(spark, requests, "asked", "asked_at")
    answered = _in_batches(spark, replies, "answered", "answered_at")
    return _append(live.correlate(asked, answered, unanswered=unanswered).drop("cached"), spark, "exchanges")


@query(
    "stream_unanswered",
    f"""with {ASKED_SQL} select flow_id, provider, asked_at, answered_at, case when answered_at is not null then status end as status from ended""",
)
def stream_unanswered(spark, folder):
    """Requests whose reply never comes are rows as soon as the watermark says so."""
    return _exchanges(spark, folder, True)


@query(
    "stream_kpi_failures",
    f"""with {ASKED_SQL}, kinds as (select *, answered_at is not null and status = 0 as ok from ended)
    select count(*) as total_requests, count(*) as total_turns, cast(0 as bigint) as cache_hits,
      cast(sum(case when ok then flow_id else 0 end) as bigint) as total_input_tokens,
      round_even(avg(case when ok then epoch_ms(answered_at) - epoch_ms(asked_at) end), 2) as avg_ttft_ms from kinds""",
)
def stream_kpi_failures(spark, folder):
    """Exchanges, failed and unanswered ones too, appended by one stream and counted by another."""
    done = _exchanges(spark, folder, True)
    path = work_dir(spark, "exchange-kpi")
    done.withColumn("status", F.when(F.col("status") == 0, 200).otherwise(F.col("status"))).withColumn(
        "ttft_s", (F.unix_millis("answered_at") - F.unix_millis("asked_at")) / 1000
    ).withColumn("input_tokens", F.col("flow_id")).write.parquet(f"{path}-in")
    rows = spark.readStream.schema(spark.read.parquet(f"{path}-in").schema).parquet(f"{path}-in")
    live.stream_kpi(live.exchange_readings(rows, "input_tokens", "ttft_s"), path, f"{path}-checkpoint").awaitTermination()
    return live.latest_snapshot(spark, path).select(
        "total_requests", "total_turns", "cache_hits", "total_input_tokens", "avg_ttft_ms"
    )


STORE_LIFE_SQL = """
    puts as (select cast(user_id % 97 as varchar) as key, event_type as provider, 'p' || event_id as prompt_normalized, 'r' || event_id as response_json, ts from events),
    gaps as (select *, ts > lag(ts) over (partition by key order by ts) + interval 20 minutes as fresh from puts),
    lives as (select *, count(*) filter (where fresh) over (partition by key order by ts) as life from gaps),
    entries as (
      select key, arg_min(provider, ts) as provider, arg_min(prompt_normalized, ts) as prompt_normalized,
        arg_max(response_json, ts) as response_json, max(ts) as created_at, count(*) as puts, max(ts) + interval 20 minutes as expires_at
      from lives group by key, life)"""


def _puts(e):
    i = F.col("event_id")
    return e.select(
        (F.col("user_id") % 97).cast("string").alias("key"),
        F.col("event_type").alias("provider"),
        F.concat(F.lit("p"), i).alias("prompt_normalized"),
        F.concat(F.lit("r"), i).alias("response_json"),
        F.col("ts").cast("timestamp").alias("put_at"),
    )


@query(
    "stream_store_expiry",
    f"with {STORE_LIFE_SQL} select * from entries where expires_at <= (select max(ts) from events) - interval 10 minutes",
)
def stream_store_expiry(spark, folder):
    """Store entries that have expired by the end of a stream of puts in several micro-batches."""
    puts = _in_batches(spark, _puts(table(spark, folder, "events")), "puts", "put_at")
    return _append(live.store_entries(puts, "20 minutes"), spark, "expired")


@query("store_entry_lives", f"with {STORE_LIFE_SQL} select * from entries")
def store_entry_lives(spark, folder):
    return live.store_entries(_puts(table(spark, folder, "events")), "20 minutes")


# --- cache replay -------------------------------------------------------------------------------------

TTL = 604_800.0
REPLAY_SQL = f"""
with recursive r as (
  select cast(user_id % 5 as varchar) as key, epoch(ts) as t, event_id, event_id % 4 <> 1 as cacheable from events),
w(key, t, event_id) as (
  select key, min(t), arg_min(event_id, row(t, event_id)) from r where cacheable group by key
  union all
  select n.key, n.t, n.event_id from (
    select w.key, r.t, r.event_id, row_number() over (partition by w.key order by r.t, r.event_id) as k
    from w join r on r.key = w.key and r.cacheable and r.t > w.t + {TTL}) n where n.k = 1)
select r.event_id, exists (select 1 from w where w.key = r.key and w.t >= r.t - {TTL}
  and (w.t < r.t or (w.t = r.t and w.event_id < r.event_id))) as hit from r"""


def cache_requests(events):
    """Events as cache requests; a few keys hold all of them."""
    return events.select(
        (F.col("user_id") % 5).cast("string").alias("key"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("at"),
        F.col("event_id").alias("ordinal"),
        (F.col("event_id") % 4 != 1).alias("cacheable"),
    )


@query("cache_replay", REPLAY_SQL)
def cache_replay(spark, folder):
    outcomes, _ = replay(cache_requests(table(spark, folder, "events")), TTL)
    return outcomes.select(F.col("ordinal").alias("event_id"), "hit")


@query("stream_cache_hits", REPLAY_SQL)
def stream_cache_hits(spark, folder):
    path = work_dir(spark, "hits")
    requests = cache_requests(stream(spark, folder, "events"))
    live.stream_cache_hits(requests, TTL, path, f"{path}-checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/outcomes").select(F.col("ordinal").alias("event_id"), "hit")


# --- tool calls and sink ------------------------------------------------------------------------------


@query(
    "stream_tool_reassembly",
    """with ls as (select doc_id as flow_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i from documents)
    select flow_id, i + 3 * (i // 3) + 3 as event_no, k as call_index, case when k = 0 then 'other' else 't' || i end as name,
    case when k = 0 then '{"raw":"[bad"}' else '{"n":' || i || '}' end as arguments
    from ls, (values (0), (1)) as c(k) where i % 3 = 2""",
)
def stream_tool_reassembly(spark, folder):
    d = stream(spark, folder, "documents")
    events = stream_rows(tool_streams(spark, folder, d), "body", "flow_id")
    call = V.at(F.col("event"), "$.choices[0].delta.tool_calls[0]")
    fragments = events.select(
        "flow_id",
        F.col("ordinal").alias("event_no"),
        F.when(call.isNotNull(), V.whole_at(call, "$.index")).otherwise(F.lit(-1)).cast("int").alias("call_index"),
        F.coalesce(V.text_of(call, "$.function.name"), F.lit("")).alias("name"),
        F.coalesce(V.text_of(call, "$.function.arguments"), F.lit("")).alias("fragment"),
        F.coalesce(V.text_of(F.col("event"), "$.choices[0].finish_reason") == "tool_calls", F.lit(False)).alias("finished"),
    )
    return _append(stateful.reassemble_tool_calls(fragments.filter("call_index >= 0 or finished")), spark, "tools")


@query(
    "stream_wire_sink",
    """select event_id, event_type, '[REDACTED]' as token, props as body from events""",
)
def stream_wire_sink(spark, folder):
    e = stream(spark, folder, "events")
    payload = F.to_json(F.struct(F.lit("t").alias("token"), F.col("props").alias("body")))
    records = e.select("event_id", "event_type", payload.alias("raw_request"))
    path = work_dir(spark, "sink")
    live.stream_wire_sink(records, path, f"{path}-checkpoint", ("raw_request",)).awaitTermination()
    log = spark.read.schema("event_id bigint, event_type string, raw_request string").json(path)
    v = F.parse_json("raw_request")
    return log.select("event_id", "event_type", V.text_of(v, "$.token").alias("token"), V.text_of(v, "$.body").alias("body"))
