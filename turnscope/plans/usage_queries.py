"""Queries over replies: event streams, usage, reply text, protocol conversion."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnscope.functions import variants as V
from turnscope.operators import protocol as P
from turnscope.operators import usage as U
from turnscope.plans.registry import query, table
from turnscope.plans.views import PROVIDER_SQL, provider_of

JSON_LENGTH = (
    "(length(cast(to_json({0}) as varchar)) - 2 + 5 * length(regexp_replace({0}, '[\\x00-\\x7e]', '', 'g')))"
)

STREAM_SQL = """
ls as (
  select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i
  from documents)"""


def streams(spark, folder, provider):
    """Every document as the event stream of one reply, with noise lines between the events."""
    d = table(spark, folder, "documents", spread=True)
    doc = F.col("doc_id")
    js = lambda **f: F.to_json(F.struct(*[(v if not isinstance(v, str) else F.lit(v)).alias(k) for k, v in f.items()]))
    data = lambda text: F.concat(F.lit("data: "), text, F.lit("\n"))
    nest = lambda **f: F.struct(*[(v if not isinstance(v, str) else F.lit(v)).alias(k) for k, v in f.items()])

    def anthropic(line, i, n):
        delta = lambda **f: data(js(type="content_block_delta", delta=nest(**f)))
        tool = F.concat(
            data(js(type="content_block_start", content_block=nest(type="tool_use", name="f"))),
            delta(partial_json=line),
            F.when(i == n - 1, "").otherwise(data(js(type="content_block_stop"))),
        )
        return F.when(i % 4 < 2, delta(text=line)).when(i % 4 == 2, delta(thinking=line)).otherwise(tool)

    def openai(line, i, n):
        choice = lambda **f: data(js(choices=F.array(nest(delta=nest(**f)))))
        call = lambda name, args: choice(tool_calls=F.array(nest(function=nest(name=name, arguments=args))))
        return F.when(i % 3 < 2, choice(content=line)).otherwise(F.concat(call("g", ""), call("", line)))

    def gemini(line, i, n):
        part = lambda p: data(js(candidates=F.array(nest(content=nest(parts=F.array(p))))))
        return F.when(i % 2 == 0, part(nest(text=line))).otherwise(
            part(nest(functionCall=nest(name="h", args=nest(q=line))))
        )

    start = end = F.lit("")
    if provider == "anthropic":
        usage = F.format_string(
            '{"type":"message_start","message":{"usage":{"input_tokens":%d,"cache_read_input_tokens":%d,"cache_creation_input_tokens":%d}}}',
            doc, doc % 7, doc % 5,
        )
        start = F.when(doc % 10 == 9, "").otherwise(data(usage))
        out = F.concat(
            F.lit('{"type":"message_delta","usage":{"output_tokens":'),
            (doc + 1000).cast("string"),
            F.when(doc % 4 == 0, ',"thinking_tokens":5').otherwise(""),
            F.lit("}}"),
        )
        end = F.when(doc % 2 == 0, data(out)).otherwise("")
    elif provider == "openai":
        usage = F.format_string(
            '{"choices":[],"usage":{"prompt_tokens":%d,"completion_tokens":7,"prompt_tokens_details":{"cached_tokens":3},"completion_tokens_details":{"reasoning_tokens":2}}}',
            doc,
        )
        end = F.when(doc % 2 == 0, data(usage)).otherwise("")
    else:
        usage = F.format_string(
            '{"usageMetadata":{"promptTokenCount":%d,"candidatesTokenCount":9,"cachedContentTokenCount":4,"reasoningTokenCount":1}}', doc
        )
        end = F.when(doc % 2 == 0, data(usage)).otherwise("")
    make = {"anthropic": anthropic, "openai": openai, "gemini": gemini}[provider]
    rows = F.split("text", "\n")
    body = F.concat(
        F.lit(": comment\r\n\nevent: start\ndata: {broken\ndata: [1]\n"),
        start,
        F.array_join(F.transform(rows, lambda line, i: make(line, i, F.size(rows))), "\n"),
        end,
        F.lit("data: [DONE]\n"),
    )
    return d.select(
        "doc_id",
        F.lit(provider).alias("provider"),
        F.to_json(F.struct(F.col("lang").alias("prompt"))).alias("request_json"),
        body.alias("body"),
    )


@query(
    "scan_sse_text",
    f"""with {STREAM_SQL}, n as (select doc_id, sum(case when i % 3 = 2 then 2 else 1 end) as events from ls group by doc_id)
    select doc_id, cast(events + case when doc_id % 2 = 0 then 1 else 0 end as bigint) as events,
    cast(events - 1 + case when doc_id % 2 = 0 then 1 else 0 end as bigint) as last_ordinal from n""",
)
def scan_sse_text(spark, folder):
    rows = U.stream_rows(streams(spark, folder, "openai"), "body", "doc_id")
    return rows.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("events"), F.max("ordinal").cast("bigint").alias("last_ordinal")
    )


def _stream_usage(spark, folder, provider):
    rows = U.stream_usage(streams(spark, folder, provider), "body", "provider", "request_json")
    return rows.select("doc_id", *[f"usage.{n}" for n in U.FIELDS])


@query(
    "sse_usage_anthropic",
    f"""with {STREAM_SQL}, s as (select doc_id, sum(length(line)) as chars,
      coalesce(sum(length(line)) filter (where i % 4 = 2), 0) as thinking from ls group by doc_id)
    select doc_id, case when doc_id % 10 = 9 then 1 else doc_id + doc_id % 7 + doc_id % 5 end as input_tokens,
      cast(case when doc_id % 2 = 0 then doc_id + 1000 when chars > 0 then greatest(1, chars // 4) else 0 end as bigint) as output_tokens,
      case when doc_id % 10 = 9 then 0 else doc_id % 7 end as cache_read_input_tokens,
      case when doc_id % 10 = 9 then 0 else doc_id % 5 end as cache_creation_input_tokens,
      cast(case when doc_id % 4 = 0 then 5 when thinking > 0 then greatest(1, thinking // 4) else 0 end as bigint) as reasoning_tokens from s""",
)
def sse_usage_anthropic(spark, folder):
    return _stream_usage(spark, folder, "anthropic")


@query(
    "sse_usage_openai",
    f"""with {STREAM_SQL}, s as (select doc_id, sum(length(line) + case when i % 3 = 2 then 1 else 0 end) as chars from ls group by doc_id)
    select doc_id, case when doc_id % 2 = 0 then doc_id else 1 end as input_tokens,
      cast(case when doc_id % 2 = 0 then 7 when chars > 0 then greatest(1, chars // 4) else 0 end as bigint) as output_tokens,
      case when doc_id % 2 = 0 then 3 else 0 end as cache_read_input_tokens, 0 as cache_creation_input_tokens,
      case when doc_id % 2 = 0 then 2 else 0 end as reasoning_tokens from s""",
)
def sse_usage_openai(spark, folder):
    return _stream_usage(spark, folder, "openai")


@query(
    "sse_usage_gemini",
    f"""with {STREAM_SQL}, s as (select doc_id,
      sum(case when i % 2 = 0 then length(line) else 1 + 9 + {JSON_LENGTH.format("line")} end) as chars from ls group by doc_id)
    select doc_id, case when doc_id % 2 = 0 then doc_id else 1 end as input_tokens,
      cast(case when doc_id % 2 = 0 then 9 when chars > 0 then greatest(1, chars // 4) else 0 end as bigint) as output_tokens,
      case when doc_id % 2 = 0 then 4 else 0 end as cache_read_input_tokens, 0 as cache_creation_input_tokens,
      case when doc_id % 2 = 0 then 1 else 0 end as reasoning_tokens from s""",
)
def sse_usage_gemini(spark, folder):
    return _stream_usage(spark, folder, "gemini")


def _stream_text(spark, folder, provider):
    rows = streams(spark, folder, provider).withColumn("events", U.stream_events(F.col("body")))
    return rows.select("doc_id", U.stream_text(F.col("events"), F.col("provider")).alias("content"))


@query(
    "sse_text_anthropic",
    f"""with {STREAM_SQL} select doc_id, string_agg(case when i % 4 = 3 then 'f(' || line || ')' else line end, '' order by i) as content
    from ls group by doc_id""",
)
def sse_text_anthropic(spark, folder):
    return _stream_text(spark, folder, "anthropic")


@query(
    "sse_text_openai",
    f"""with {STREAM_SQL} select doc_id, string_agg(case when i % 3 = 2 then 'g(' || line || ')' else line end, '' order by i) as content
    from ls group by doc_id""",
)
def sse_text_openai(spark, folder):
    return _stream_text(spark, folder, "openai")


@query(
    "sse_text_gemini",
    f"""with {STREAM_SQL} select doc_id, string_agg(case when i % 2 = 0 then line
      else '{{"args":{{"q":' || cast(to_json(line) as varchar) || '}},"name":"h"}}' end, '' order by i) as content
    from ls group by doc_id""",
)
def sse_text_gemini(spark, folder):
    return _stream_text(spark, folder, "gemini")


# --- response objects ---------------------------------------------------------------------------------


def replies(spark, folder, only=None):
    """Every event as a response object of its provider (or of ``only``); some report no usage."""
    e = table(spark, folder, "events", spread=True)
    i = F.col("event_id")
    tokens = F.floor(F.col("value") * 100).cast("bigint")
    no_output = i % 4 == 3
    # i % 4 == 3 leaves the output count out, so both counts are estimated.
    anthropic = F.concat(
        F.format_string('{"content":[{"type":"text","text":"%s"}],"usage":{"input_tokens":%d', "props", tokens),
        F.when(no_output, "").otherwise(F.format_string(',"output_tokens":"%d"', i % 100)),
        F.format_string(',"cache_read_input_tokens":%d,"cache_creation_input_tokens":null,"thinking_tokens":%d}}', i % 9, i % 5),
    )
    openai = F.concat(
        F.format_string('{"choices":[{"message":{"content":"%s"}}],"usage":{"prompt_tokens":%d', "props", tokens),
        F.when(no_output, "").otherwise(F.format_string(',"completion_tokens":%d', i % 100)),
        F.when(i % 2 == 0, F.format_string(',"prompt_tokens_details":{"cached_tokens":%d}', i % 9)).otherwise(
            F.format_string(',"cached_tokens":%d', i % 8)
        ),
        F.format_string(',"completion_tokens_details":{"reasoning_tokens":%d}}}', i % 5),
    )
    gemini = F.concat(
        F.format_string('{"candidates":[{"content":{"parts":[{"text":"%s"}]}}],', "props"),
        F.when(i % 2 == 0, '"usageMetadata":{').otherwise('"usageMetadata":{},"usage":{'),
        F.format_string('"promptTokenCount":%d', tokens),
        F.when(no_output, "").otherwise(F.format_string(',"candidatesTokenCount":%d', i % 100)),
        F.format_string(',"cachedContentTokenCount":%d,"reasoningTokenCount":%d}}', i % 9, i % 5),
    )
    provider = F.lit(only) if only else provider_of(i)
    quoted = F.replace("props", F.lit('"'), F.lit("'"))
    rows = e.withColumn("props", quoted).withColumn("provider", provider)
    return rows.select(
        "event_id",
        "provider",
        F.to_json(F.struct(F.col("event_type").alias("prompt"))).alias("request_json"),
        F.when(provider == "anthropic", anthropic).when(provider == "openai", openai).otherwise(gemini).alias("response_json"),
    )


REPLY_SQL = f"""
r as (select event_id, {PROVIDER_SQL} as provider, cast(floor(value * 100) as bigint) as t, event_id % 4 = 3 as est,
    greatest(1, length(event_type) // 4) as in_est, greatest(1, length(props) // 4) as out_est, event_id as i from events)"""
REPLY_COLUMNS = """
    cast(case when est then in_est when provider = 'anthropic' then t + i % 9 else t end as bigint) as input_tokens,
    cast(case when est then out_est else i % 100 end as bigint) as output_tokens,
    cast(case when est then 0 when provider = 'openai' and i % 2 = 1 then i % 8 else i % 9 end as bigint) as cache_read_input_tokens,
    cast(0 as bigint) as cache_creation_input_tokens,
    cast(case when est then 0 else i % 5 end as bigint) as reasoning_tokens"""


def _object_usage(spark, folder, provider):
    rows = replies(spark, folder, provider).withColumn("response", F.parse_json("response_json"))
    rows = U.object_usage(rows, "response", "provider", "request_json", "response_json")
    return rows.select("event_id", *[f"usage.{n}" for n in U.FIELDS])


def _register_object_usage(provider):
    @query(
        f"usage_{provider}",
        f"with {REPLY_SQL}, one as (select * replace ('{provider}' as provider) from r) select event_id, {REPLY_COLUMNS} from one",
    )
    def run(spark, folder):
        return _object_usage(spark, folder, provider)

    return run


for _name in ("anthropic", "openai", "gemini"):
    _register_object_usage(_name)


@query(
    "detailed_usage",
    f"""with {REPLY_SQL} select event_id,
    cast(case when i % 3 = 1 and i % 2 = 0 then i else input_tokens end as bigint) as input_tokens,
    cast(case when i % 3 = 1 and i % 2 = 0 then 11 else output_tokens end as bigint) as output_tokens,
    cast(case when i % 3 = 1 and i % 2 = 0 then 0 else cache_read_input_tokens end as bigint) as cache_read_input_tokens,
    cache_creation_input_tokens,
    cast(case when i % 3 = 1 and i % 2 = 0 then 0 else reasoning_tokens end as bigint) as reasoning_tokens
    from (select *, {REPLY_COLUMNS} from r)""",
)
def detailed_usage(spark, folder):
    i = F.col("event_id")
    stream = F.format_string('data: {"usage":{"prompt_tokens":%d,"completion_tokens":11}}', i)
    rows = replies(spark, folder).withColumn("body", F.when((i % 3 == 1) & (i % 2 == 0), stream))
    rows = U.detailed_usage(rows, "provider", "request_json", "response_json", "body")
    return rows.select("event_id", *[f"usage.{n}" for n in U.FIELDS])


# --- protocol conversion ------------------------------------------------------------------------------


def gemini_requests(spark, folder):
    """Every document as a turn-and-part request with calls and replies, some of them with ids."""
    d = table(spark, folder, "documents", spread=True)

    def turn(line, i):
        fn = F.concat(F.lit("f"), (F.length(line) % 3).cast("string"))
        call = F.concat(
            F.lit('{"functionCall":{"name":"'), fn, F.lit('","args":{"n":'), i.cast("string"), F.lit("}"),
            F.when(F.length(line) % 7 == 0, F.concat(F.lit(',"id":"given'), i, F.lit('"'))).otherwise(""), F.lit("}}"),
        )
        reply = F.concat(
            F.lit('{"functionResponse":{"name":"'), fn, F.lit('","response":{"content":"r'), i.cast("string"), F.lit('"}'),
            F.when(F.length(line) % 11 == 0, F.concat(F.lit(',"id":"told'), i, F.lit('"'))).otherwise(""), F.lit("}}"),
        )
        text = F.to_json(F.struct(line.alias("text")))
        k = F.length(line) % 5
        parts = (
            F.when(k == 0, text)
            .when(k == 1, F.concat(text, F.lit(","), call))
            .when(k == 2, F.concat(call, F.lit(","), call))
            .when(k == 3, F.concat(reply, F.lit(","), call))
            .otherwise(reply)
        )
        role = F.when(k.isin(1, 2), "model").otherwise("user")
        return F.concat(F.lit('{"role":"'), role, F.lit('","parts":['), parts, F.lit("]}"))

    text = F.concat(
        F.lit('{"systemInstruction":{"parts":[{"text":"Be"},{"text":"brief"}]},"generationConfig":{"temperature":0.5,"maxOutputTokens":'),
        F.col("doc_id"),
        F.lit('},"tools":[{"functionDeclarations":[{"name":"f0","description":"d"},{"name":"f1"}]}],"contents":['),
        F.array_join(F.transform(F.split("text", "\n"), turn), ","),
        F.lit("]}"),
    )
    return d.select(F.col("doc_id").alias("payload_id"), F.parse_json(text).alias("payload"))


PARTS_SQL = """
ls as (
  select doc_id as payload_id, unnest(string_split(text, chr(10))) as line,
    generate_subscripts(string_split(text, chr(10)), 1) - 1 as turn_idx from documents),
lk as (select *, length(line) % 5 as k, 'f' || length(line) % 3 as fn,
    case when length(line) % 7 = 0 then 'given' || turn_idx end as call_given,
    case when length(line) % 11 = 0 then 'told' || turn_idx end as reply_given from ls),
parts as (
  select payload_id, turn_idx, 0 as part_idx, 'call' as kind, fn, call_given as given_id from lk where k = 2
  union all select payload_id, turn_idx, 1, 'call', fn, call_given from lk where k in (1, 2, 3)
  union all select payload_id, turn_idx, 0, 'reply', fn, reply_given from lk where k in (3, 4)),
c as (
  select *, sum(case when kind = 'call' then 1 else 0 end) over w as calls,
    sum(case when kind = 'call' and given_id is null then 1 else 0 end) over w as fresh,
    sum(case when kind = 'reply' and given_id is null then 1 else 0 end) over w as asks
  from parts window w as (partition by payload_id, fn order by turn_idx, kind, part_idx rows unbounded preceding)),
d as (
  select *, greatest(0, coalesce(max(case when kind = 'reply' and given_id is null then asks - calls end) over w, 0)) as lost,
    greatest(0, coalesce(max(case when kind = 'reply' and given_id is null then asks - calls end) over b, 0)) as lost_before
  from c window w as (partition by payload_id, fn order by turn_idx, kind, part_idx rows unbounded preceding),
    b as (partition by payload_id, fn order by turn_idx, kind, part_idx rows between unbounded preceding and 1 preceding)),
made as (select *, coalesce(given_id, 'call_' || fn || case when fresh > 1 then '_' || fresh else '' end) as own from d),
paired as (
  select m.payload_id, m.turn_idx, m.part_idx, m.kind, m.fn,
    case when m.kind = 'call' then m.own when m.given_id is not null then m.given_id
      else coalesce(q.own, 'call_' || m.fn) end as call_id
  from made m left join made q on m.kind = 'reply' and m.given_id is null and m.lost = m.lost_before and q.kind = 'call'
    and q.payload_id = m.payload_id and q.fn = m.fn and q.calls = m.asks - m.lost)"""


@query("tool_pairing", f"with {PARTS_SQL} select * from paired")
def tool_pairing(spark, folder):
    return P.pair_tool_replies(P.tool_parts(gemini_requests(spark, folder))).select("payload_id", "turn_idx", "part_idx", "kind", "fn", "call_id")


@query(
    "running_call_no",
    f"""with {PARTS_SQL} select payload_id, turn_idx, part_idx, fn,
    cast(row_number() over (partition by payload_id, fn order by turn_idx, part_idx) as bigint) as call_no
    from parts where kind = 'call' and given_id is null""",
)
def running_call_no(spark, folder):
    from turnscope.operators.ordered import dense_index

    parts = P.tool_parts(gemini_requests(spark, folder)).filter("kind = 'call' and given_id is null")
    # As a struct, a request without an id is a key like any other.
    placed = parts.select("*", F.struct("payload_id", "fn").alias("of"), F.expr("turn_idx * 1048576L + part_idx").alias("place"))
    numbered = dense_index(placed, ["of"], "place", "no")
    return numbered.select("payload_id", "turn_idx", "part_idx", "fn", (F.col("no") + 1).alias("call_no"))


@query(
    "gemini_to_chat",
    f"""with {PARTS_SQL},
    calls as (select payload_id, turn_idx, string_agg(call_id, ',' order by part_idx) as ids from paired where kind = 'call' group by all)
    select payload_id, -1 as turn_idx, 0 as part_idx, 'system' as role, 'Be' || chr(10) || chr(10) || 'brief' as content,
      cast(null as varchar) as tool_call_id, cast(null as varchar) as call_ids from (select distinct payload_id from ls)
    union all
    select lk.payload_id, lk.turn_idx, 0, case when k in (1, 2) then 'assistant' else 'user' end,
      case when k in (0, 1) then line end, null, ids
      from lk left join calls using (payload_id, turn_idx) where k in (0, 1, 2)
    union all
    select payload_id, turn_idx, part_idx, 'tool', 'r' || turn_idx, call_id, null from paired where kind = 'reply'""",
)
def gemini_to_chat(spark, folder):
    m = P.chat_messages(gemini_requests(spark, folder))
    ids = F.array_join(
        F.transform(V.items(F.try_parse_json("tool_calls")), lambda c: V.text_of(c, "$.id")), ","
    )
    return m.select(
        "payload_id",
        F.col("message_idx.turn_idx").alias("turn_idx"),
        F.col("message_idx.part_idx").alias("part_idx"),
        "role",
        "content",
        "tool_call_id",
        F.nullif(ids, F.lit("")).alias("call_ids"),
    )


@query(
    "gemini_options",
    """select doc_id as payload_id, 'default' as model, cast(0.5 as double) as temperature, doc_id as max_tokens,
    cast(null as double) as top_p, 2 as tools, 'f0' as first_tool from documents""",
)
def gemini_options(spark, folder):
    r = gemini_requests(spark, folder).select("payload_id", P.chat_options(F.col("payload")).alias("o"))
    number = lambda n, t: F.try_variant_get(f"o.{n}", "$", t).alias(n)
    return r.select(
        "payload_id",
        "o.model",
        number("temperature", "double"),
        number("max_tokens", "bigint"),
        number("top_p", "double"),
        F.size("o.tools").alias("tools"),
        F.get("o.tools", F.lit(0))["function"]["name"].alias("first_tool"),
    )


@query(
    "chat_to_gemini",
    """select doc_id, 'STOP' as first_finish, case when doc_id % 3 = 0 and doc_id % 4 <> 0 then 'MAX_TOKENS' else 'STOP' end as last_finish,
    case when doc_id % 4 = 0 then 1 else 2 end as candidates,
    case when doc_id % 4 = 0 then '' else text end as first_text,
    case when doc_id % 4 = 0 then null when doc_id % 2 = 0 then 'g' else 'f' end as call_name,
    case when doc_id % 4 = 0 then null when doc_id % 2 = 0 then '{"raw":"{oops"}' else '{"n":' || doc_id || '}' end as call_args,
    case when doc_id % 4 = 0 then 0 else doc_id end as prompt_tokens,
    case when doc_id % 4 = 0 then 0 else doc_id + 5 end as total_tokens
    from documents""",
)
def chat_to_gemini(spark, folder):
    d = table(spark, folder, "documents", spread=True)
    i = F.col("doc_id")
    args = F.when(i % 2 == 0, '"{oops"').otherwise(F.concat(F.lit('"{\\"n\\":'), i, F.lit('}"')))
    name = F.when(i % 2 == 0, "g").otherwise("f")
    text = F.to_json(F.struct(F.col("text").alias("content")))
    body = F.concat(
        F.lit('{"choices":[{"index":0,"finish_reason":"stop","message":'), text,
        F.lit('},{"finish_reason":'), F.when(i % 3 == 0, '"length"').otherwise("null"),
        F.lit(',"message":{"content":null,"tool_calls":[{"function":{"name":"'), name, F.lit('","arguments":'), args,
        F.lit('}}]}}],"usage":{"prompt_tokens":'), i, F.lit(',"completion_tokens":5}}'),
    )
    response = F.parse_json(F.when(i % 4 == 0, '{"choices":[]}').otherwise(body))
    r = d.select("doc_id", response.alias("r")).select(
        "doc_id", P.candidates(F.col("r")).alias("c"), P.candidate_usage(F.col("r")).alias("u")
    )
    last = F.element_at("c", F.size("c"))
    first_part = F.get(F.get("c", F.lit(0))["content"]["parts"], F.lit(0))
    call = F.get(last["content"]["parts"], F.lit(0))["functionCall"]
    return r.select(
        "doc_id",
        F.get("c", F.lit(0))["finishReason"].alias("first_finish"),
        last["finishReason"].alias("last_finish"),
        F.size("c").alias("candidates"),
        first_part["text"].alias("first_text"),
        call["name"].alias("call_name"),
        F.to_json(call["args"]).alias("call_args"),
        F.col("u.promptTokenCount").alias("prompt_tokens"),
        F.col("u.totalTokenCount").alias("total_tokens"),
    )


def tool_streams(spark, folder, documents=None):
    """Every document as a chat stream whose lines arrive as text or as fragments of two tool calls."""
    d = documents if documents is not None else table(spark, folder, "documents", spread=True)
    js = lambda s: F.concat(F.lit("data: "), s, F.lit("\n"))

    def event(line, i):
        text = F.to_json(F.struct(F.array(F.struct(F.struct(line.alias("content")).alias("delta"))).alias("choices")))
        piece = lambda name, args, index: F.concat(
            F.lit('{"choices":[{"delta":{"tool_calls":[{"index":'), index, F.lit(',"function":{"name":"'), name,
            F.lit('","arguments":"'), args, F.lit('"}}]}}]}'),
        )
        fn = F.concat(F.lit("t"), i)
        calls = F.concat(
            js(piece(fn, F.lit("{"), F.lit("1"))),
            js(piece(F.lit("other"), F.lit("[bad"), F.lit("0"))),
            js(piece(F.lit(""), F.concat(F.lit('\\"n\\":'), i, F.lit("}")), F.lit("1"))),
            js(F.lit('{"choices":[{"delta":{},"finish_reason":"tool_calls"}],"usage":{"prompt_tokens":3,"completion_tokens":4}}')),
        )
        return F.when(i % 3 == 2, calls).otherwise(js(text))

    body = F.concat(F.array_join(F.transform(F.split("text", "\n"), event), ""), F.lit('data: {"choices":[{"delta":{},"finish_reason":"length"}]}\n'))
    return d.select(F.col("doc_id").alias("flow_id"), body.alias("body"))


@query(
    "chat_stream_to_gemini",
    """with ls as (select doc_id as flow_id, unnest(string_split(text, chr(10))) as line,
        generate_subscripts(string_split(text, chr(10)), 1) - 1 as i, len(string_split(text, chr(10))) as n from documents),
    placed as (select *, i + 3 * (i // 3) + case when i % 3 = 2 then 3 else 0 end as event_no from ls)
    select flow_id, event_no, case when i % 3 < 2 then line end as text,
      case when i % 3 = 2 then '[{"name":"other","args":{"raw":"[bad"}},{"name":"t' || i || '","args":{"n":' || i || '}}]' end as function_calls,
      case when i % 3 = 2 then 'STOP' end as finish_reason, case when i % 3 = 2 then 3 end as prompt_token_count,
      case when i % 3 = 2 then 4 end as candidates_token_count from placed
    union all
    select flow_id, max(event_no) + 1, null, null, 'MAX_TOKENS', null, null from placed group by flow_id""",
)
def chat_stream_to_gemini(spark, folder):
    return P.stream_chunks(tool_streams(spark, folder)).select(
        "flow_id", "event_no", "text", "function_calls", "finish_reason", "prompt_token_count", "candidates_token_count"
    )
