"""Views of the test tables in the shapes the operators read, in Spark and in SQL.

Transactions come from ``events``, requests and files from ``documents``, turns from ``conversations``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnscope.plans.registry import table
from turnscope.sources.traces import parse_lines

PROVIDER_SQL = "case event_id % 3 when 0 then 'anthropic' when 1 then 'openai' else 'gemini' end"


def provider_of(number: Column) -> Column:
    return F.when(number % 3 == 0, "anthropic").when(number % 3 == 1, "openai").otherwise("gemini")


# --- transactions -------------------------------------------------------------------------------------

TX_SQL = f"""
tx0 as (
  select event_id as ordinal, user_id, event_type, value,
    {PROVIDER_SQL} as provider,
    case when user_id % 2 = 0 then 'baseline' else 'optimized' end as mode,
    case when event_type = 'view' then 'HIT' else 'MISS' end as cache_action,
    cast(floor(value * 100) as bigint) as input_tokens,
    case when event_type = 'view' then cast(floor(value * 100) as bigint) // 3 else 0 end as cache_read,
    cast(floor(value * 10) as bigint) as output_tokens,
    case when event_type = 'error' then null else value * 20 end as ttft_ms,
    case when event_type = 'error' then null else value * 20 end + 50 + event_id % 400 as total_ms,
    event_id % 997 as chars_saved, event_id % 3 as tool_outputs_omitted
  from events),
tx1 as (
  select *,
    case when ordinal % 11 = 0 then null else ordinal // 2 end as turn_no,
    case when ordinal % 7 = 0 then 's' else 'i' end as turn_type,
    case when ttft_ms > 0 and ttft_ms is not null then ttft_ms / 1000.0 end as ttft_s,
    case when total_ms > 0 then total_ms / 1000.0 end as total_s
  from tx0),
tx as (
  select *,
    case when input_tokens > 0 then input_tokens / ttft_s end as prefill_tps,
    case when input_tokens - cache_read > 0 then (input_tokens - cache_read) / ttft_s end as tail_tps,
    case ordinal % 4
      when 0 then case when output_tokens > 0 and total_s - ttft_s >= 0.05 then output_tokens / (total_s - ttft_s) end
      when 1 then null
      when 2 then case when value > 0 then value * 3 end
      else null end as decode_tps
  from tx1)"""


def wire_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The log as JSON text: ``ordinal``, ``value``. Rates are absent, null, zero or positive by row."""
    return lines_of(table(spark, folder, "events", spread=True))


def lines_of(e: DataFrame) -> DataFrame:
    """``wire_lines`` of any events, also of a stream."""
    i, v, c = F.col("event_id"), F.col("value"), F.col
    number = lambda x: F.coalesce(x.cast("string"), F.lit("null"))
    tokens = F.floor(v * 100).cast("bigint")
    hit = c("event_type") == "view"
    ttft = F.when(c("event_type") != "error", v * 20)
    turn = F.when(i % 11 == 0, "").when(
        i % 7 == 0, F.concat(F.lit('"turn_id":"'), F.floor(i / 2), F.lit('",'))
    ).otherwise(F.concat(F.lit('"turn_id":'), F.floor(i / 2), F.lit(",")))
    decode = (
        F.when(i % 4 == 0, "")
        .when(i % 4 == 1, ',"decode_tps":null')
        .when(i % 4 == 2, F.concat(F.lit(',"decode_tps":'), number(v * 3)))
        .otherwise(',"decode_tps":0.0')
    )
    text = F.concat(
        F.lit("{"),
        turn,
        F.lit('"provider":"'), provider_of(i),
        F.lit('","mode":"'), F.when(c("user_id") % 2 == 0, "baseline").otherwise("optimized"),
        F.lit('","cache_action":"'), F.when(hit, "HIT").otherwise("MISS"),
        F.lit('","delta":{"tool_outputs_omitted":'), i % 3,
        F.lit(',"chars_saved":'), i % 997,
        F.lit(',"turns_summarized":0,"cache_control_injected":'), i % 2,
        F.lit('},"response":{"status":'), F.when(i % 50 == 49, "500").otherwise("200"),
        F.lit(',"usage":{"input_tokens":'), tokens,
        F.lit(',"output_tokens":'), F.floor(v * 10).cast("bigint"),
        F.lit(',"cache_read_input_tokens":'), F.when(hit, F.floor(tokens / 3)).otherwise(0).cast("bigint"),
        F.lit(',"thinking_tokens":'), i % 5,
        F.lit('}},"timing":{"ttft_ms":'), number(ttft),
        F.lit(',"total_ms":'), number(ttft + 50 + i % 400),
        decode,
        F.lit('},"raw_request":{"request":{"messages":[{"role":"user","content":"'),
        F.repeat(F.lit("word "), (i % 17).cast("int")),
        F.lit('"}]}}}'),
    )
    return e.select(i.alias("ordinal"), F.col("user_id"), text.alias("value"))


def wire_transactions(spark: SparkSession, folder: str) -> DataFrame:
    """The parsed log: ``ordinal``, ``value`` and the variant ``tx``."""
    return parse_lines(wire_lines(spark, folder))


# --- requests -----------------------------------------------------------------------------------------

# Lines of a document are the turns of a request; every fourth document is read twice.
TURNS_SQL = """
docs as (
  select doc_id as payload_id, lang,
    case when doc_id % 4 = 0 then list_concat(string_split(text, chr(10)), string_split(text, chr(10)))
         else string_split(text, chr(10)) end as ls
  from documents),
turns as (
  select payload_id, lang, unnest(ls) as line, generate_subscripts(ls, 1) - 1 as turn_idx, len(ls) as n from docs)"""


def _lines(text: Column, doc_id: Column) -> Column:
    rows = F.split(text, "\n")
    return F.when(doc_id % 4 == 0, F.concat(rows, rows)).otherwise(rows)


def _role(i: Column) -> Column:
    return F.when(i % 5 < 3, "user").otherwise("assistant")


ROLE_SQL = "case when turn_idx % 5 < 3 then 'user' else 'assistant' end"


def _anthropic_turn(line: Column, i: Column) -> Column:
    role = _role(i).alias("role")
    block = lambda **f: F.array(F.struct(*[v.alias(k) for k, v in f.items()])).alias("content")
    return (
        F.when(i % 3 == 0, F.to_json(F.struct(role, line.alias("content"))))
        .when(i % 3 == 1, F.to_json(F.struct(role, block(type=F.lit("text"), text=line))))
        .otherwise(
            F.to_json(
                F.struct(
                    role,
                    block(type=F.lit("tool_result"), tool_use_id=F.concat(F.lit("t"), i), content=line),
                )
            )
        )
    )


OPENAI_ROLE_SQL = (
    "case when turn_idx = 0 then 'system' when turn_idx % 4 = 2 then 'tool' "
    "when turn_idx % 4 = 1 or turn_idx % 6 = 0 then 'user' else 'assistant' end"
)


def _openai_turn(line: Column, i: Column) -> Column:
    role = (
        F.when(i == 0, "system")
        .when(i % 4 == 2, "tool")
        .when((i % 4 == 1) | (i % 6 == 0), "user")
        .otherwise("assistant")
    )
    return F.to_json(F.struct(role.alias("role"), line.alias("content")))


def _gemini_turn(line: Column, i: Column) -> Column:
    role = F.when(i % 2 == 0, "user").otherwise("model").alias("role")
    text = F.to_json(F.struct(role, F.array(F.struct(line.alias("text"))).alias("parts")))
    reply = F.struct(
        F.struct(
            F.concat(F.lit("f"), i % 3).alias("name"), F.struct(line.alias("output")).alias("response")
        ).alias("functionResponse")
    )
    return F.when(i % 4 < 2, text).otherwise(F.to_json(F.struct(role, F.array(reply).alias("parts"))))


def requests(spark: SparkSession, folder: str, provider: str) -> DataFrame:
    """One request per document: ``payload_id``, ``lang``, ``provider``, ``json`` and ``payload``."""
    turn = {"anthropic": _anthropic_turn, "openai": _openai_turn, "gemini": _gemini_turn}[provider]
    name = "contents" if provider == "gemini" else "messages"
    d = table(spark, folder, "documents", spread=True)
    turns = F.array_join(F.transform(_lines(F.col("text"), F.col("doc_id")), turn), ",")
    head = ""
    if provider == "anthropic":
        head = '"system":"Review the text.","tools":[{"name":"read"}],'
    text = F.concat(F.lit(f'{{{head}"model":"m","{name}":['), turns, F.lit("]}"))
    return d.select(
        F.col("doc_id").alias("payload_id"), "lang", F.lit(provider).alias("provider"), text.alias("json")
    ).withColumn("payload", F.parse_json("json"))


def conversation_turns(spark: SparkSession, folder: str) -> DataFrame:
    """``conversations`` as turn rows."""
    return table(spark, folder, "conversations").select(
        F.col("conv_id").alias("payload_id"), F.col("turn").alias("turn_idx"), "role", "text"
    )


def document_turns(spark: SparkSession, folder: str) -> DataFrame:
    """Document lines as turn rows, for steps that work on rows."""
    d = table(spark, folder, "documents", spread=True)
    rows = d.select(
        F.col("doc_id").alias("payload_id"),
        F.posexplode(_lines(F.col("text"), F.col("doc_id"))).alias("turn_idx", "text"),
    )
    return rows.select(
        "payload_id", F.col("turn_idx").cast("bigint").alias("turn_idx"), _role(F.col("turn_idx")).alias("role"), "text"
    )


# --- files --------------------------------------------------------------------------------------------


def files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as text files: ``path``, ``content``."""
    d = table(spark, folder, "documents", spread=True)
    return d.select(
        F.concat(F.col("source"), F.lit("/"), F.format_string("%09d", "doc_id"), F.lit(".md")).alias("path"),
        F.col("text").alias("content"),
    )


FILES_SQL = """
files as (select source || '/' || lpad(cast(doc_id as varchar), 9, '0') || '.md' as path, text as content from documents),
file_lines as (
  select path, unnest(string_split(content, chr(10))) as line, generate_subscripts(string_split(content, chr(10)), 1) as line_no
  from files)"""
