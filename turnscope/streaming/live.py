"""Streams: flow timing, live telemetry, correlated exchanges, entries that expire, cache replay, log sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from turnscope.functions.kernels import redact_payload
from turnscope.operators import kpi
from turnscope.operators.ordered import running_sum
from turnscope.operators.replay import STATE_SCHEMA, replay
from turnscope.session import remove

BUFFER_LIMIT = 50 * 1024 * 1024


# --- flow timing --------------------------------------------------------------------------------------


def flows(chunks: DataFrame, idle: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """One row for each flow: first and last chunk, size and number of chunks.

    ``chunks``: ``flow_id, ts, bytes``. A flow ends when no chunk has come for ``idle``; a later chunk of the same id begins
    another flow. On a stream the row appears when the watermark, ``delay`` behind the newest chunk, passes the end, and the flow
    leaves the state then; however long a flow lasts, it is one row. Chunks that come later than ``delay`` are
    dropped if they are older than the watermark. Chunks are added up before they are shuffled, in any order.
    """
    if chunks.isStreaming:
        chunks = chunks.withWatermark("ts", delay)
    counted = chunks.groupBy("flow_id", F.session_window("ts", idle).alias("_life")).agg(
        F.min("ts").alias("first_chunk"),
        F.max("ts").alias("last_chunk"),
        F.sum("bytes").alias("bytes"),
        F.count(F.lit(1)).alias("chunks"),
    )
    return counted.drop("_life")


def append_to(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the finished rows of a stream to a table, each exactly once, until the input is read."""
    return (
        rows.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def buffered_chunks(chunks: DataFrame, position: str, limit: int = BUFFER_LIMIT) -> DataFrame:
    """The chunks a buffer of ``limit`` bytes keeps; later ones still count for the timing."""
    sized = running_sum(chunks, ["flow_id"], position, {"_filled": F.col("bytes")})
    return sized.filter(F.col("_filled") <= limit).drop("_filled")


# --- telemetry ----------------------------------------------------------------------------------------


def stream_kpi(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep one row of live counters in a table, replaced with every micro-batch.

    ``rows`` are readings with ``kind``. Each version has its own folder, so that a reader never sees a
    half-written one and a repeated batch replaces itself; all but the newest two are removed.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        kpi.live_snapshot(batch).write.mode("overwrite").parquet(f"{path}/version={batch_id}")
        remove(batch.sparkSession, f"{path}/version={batch_id - 2}")

    counted = rows.agg(*kpi.live_aggregates())
    return (
        counted.writeStream.outputMode("complete")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def latest_snapshot(spark: SparkSession, path: str) -> DataFrame:
    versions = spark.read.parquet(path)
    return versions.filter(F.col("version") == versions.agg(F.max("version")).scalar()).drop("version")


# --- exchanges ----------------------------------------------------------------------------------------


def correlate(requests: DataFrame, replies: DataFrame, delay: str = "1 hour", unanswered: bool = False) -> DataFrame:
    """Requests with their replies, by ``flow_id``; unknown providers and cached flows are left out.

    ``requests``: ``flow_id, asked_at, provider, cached``; ``replies``: ``flow_id, answered_at, status``.
    A reply comes at most ``delay`` after its request, which bounds the state of a stream. With ``unanswered``, a request without
    such a reply is a row too, with NULL for the reply's columns; on a stream it appears when the watermark says that
    no reply can come any more.
    """
    asked = requests.filter((F.col("provider") != "unknown") & ~F.col("cached"))
    if asked.isStreaming:
        asked, replies = asked.withWatermark("asked_at", delay), replies.withWatermark("answered_at", delay)
    r = replies.withColumnRenamed("flow_id", "_flow")
    in_time = F.expr(f"answered_at >= asked_at and answered_at <= asked_at + interval {delay}")
    return asked.join(r, (F.col("flow_id") == F.col("_flow")) & in_time, "left" if unanswered else "inner").drop("_flow")


def exchange_readings(exchanges: DataFrame, *measured: str) -> DataFrame:
    """Exchanges as rows of the live view: no reply or a status other than 200 is a failure, which counts as a turn with zeros.

    ``measured`` are columns of the exchange that are readings; every other reading is 0, or NULL for a time or rate.
    """
    ok = F.coalesce(F.col("status") == 200, F.lit(False))
    zero = F.lit(0).cast("bigint")
    counts = ("chars_saved", "tool_outputs_omitted", "turns_summarized", "cache_control_injected")
    tokens = ("input_tokens", "output_tokens", "cache_read", "cache_creation", "reasoning")
    value = lambda n, other: F.when(ok, F.col(n)).otherwise(other) if n in measured else other
    return exchanges.select(
        F.col("flow_id").alias("ordinal"),
        F.when(ok, "response").otherwise("failure").alias("kind"),
        *[value(n, zero).alias(n) for n in (*counts, *tokens)],
        *[value(n, F.lit(None).cast("double")).alias(n) for n in kpi.LIVE_READINGS],
    )


# --- prompt store -------------------------------------------------------------------------------------


def store_entries(puts: DataFrame, ttl: str = "7 days", delay: str = "10 minutes") -> DataFrame:
    """The lives of store entries: one row for each, with what the entry held when it expired.

    ``puts``: ``key, provider, prompt_normalized, response_json, put_at`` (a timestamp). A put within ``ttl`` of the last one
    refreshes the entry: it replaces the response, while provider and prompt stay those of the first, as in ``tables.upsert``. A put
    after that begins another life. On a stream an entry leaves the state when the watermark passes
    ``expires_at``, so the state holds live entries only, and its row is the output; puts that are older than the watermark, ``delay``
    behind the newest put, are dropped. A batch has all lives, over or not.
    """
    if puts.isStreaming:
        puts = puts.withWatermark("put_at", delay)
    lives = puts.groupBy("key", F.session_window("put_at", ttl).alias("_life")).agg(
        F.min_by(F.struct("provider", "prompt_normalized"), "put_at").alias("_first"),
        F.max_by("response_json", "put_at").alias("response_json"),
        F.max("put_at").alias("created_at"),
        F.count(F.lit(1)).alias("puts"),
    )
    return lives.select("key", "_first.*", "response_json", "created_at", "puts", F.col("_life.end").alias("expires_at"))


# --- cache replay -------------------------------------------------------------------------------------


def stream_cache_hits(requests: DataFrame, ttl_s: float, path: str, checkpoint: str) -> StreamingQuery:
    """Decide hit or miss for every request as it arrives; requests come in order of time.

    The last write of each key is a table with one version per micro-batch. A repeated batch starts from
    the version before it, so its outcome is the same.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        previous = f"{path}/state/{batch_id - 1}"
        state = spark.read.schema(STATE_SCHEMA).parquet(previous) if batch_id > 0 else None
        outcomes, after = replay(batch, ttl_s, state)
        outcomes.write.mode("overwrite").parquet(f"{path}/outcomes/batch={batch_id}")
        if ttl_s > 0:
            # Later requests are no older than the newest, so an entry dead by then answers nothing more.
            newest = batch.agg(F.max("at")).scalar()
            after = after.filter(F.col("last_write") >= F.coalesce(newest, F.col("last_write")) - ttl_s)
        after.write.mode("overwrite").parquet(f"{path}/state/{batch_id}")
        remove(spark, f"{path}/state/{batch_id - 2}")

    return (
        requests.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


# --- log sink -----------------------------------------------------------------------------------------


def stream_wire_sink(records: DataFrame, path: str, checkpoint: str, payloads: tuple[str, ...] = ()) -> StreamingQuery:
    """Append records to the log, the named JSON columns redacted; a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        clean = batch
        for name in payloads:
            clean = clean.withColumn(name, redact_payload(F.col(name)))
        clean.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/batch={batch_id}")

    return (
        records.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
