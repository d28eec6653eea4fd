"""Queries over exchanges: providers, headers, redaction, log records."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnscope.functions import providers as PR
from turnscope.functions import text as X
from turnscope.functions import variants as V
from turnscope.functions.kernels import estimate_chars, find_key, redact_payload
from turnscope.operators import abtest as A
from turnscope.operators import records as R
from turnscope.operators.conversation import cache_key_parts
from turnscope.plans.registry import query, table

# --- providers ----------------------------------------------------------------------------------------

URLS_SQL = """
urls as (
  select page_id, case page_id % 8 when 0 then url when 1 then 'https://api.anthropic.com/v1/complete'
    when 2 then url || '/v1/messages' when 3 then 'https://generativelanguage.googleapis.com/v1beta'
    when 4 then 'eu.generativelanguage.googleapis.com:443/x' when 5 then 'http://127.0.0.1:11434/V1/Chat/Completions'
    when 6 then 'http://host/models/m-' || page_id || ':streamGenerateContent' else '' end as url,
    page_id // 8 % 7 as shape from pages)"""

SHAPES = (
    '{"messages":[],"system":"s"}',
    '{"anthropic_version":"x","contents":[]}',
    '{"model":"Claude-x","contents":[]}',
    '{"contents":[]}',
    '{"prompt":"p"}',
    '{"system":"s"}',
    '{"input":"none"}',
)


def _urls(spark, folder):
    p = table(spark, folder, "pages")
    i, url = F.col("page_id"), F.col("url")
    made = (
        F.when(i % 8 == 0, url)
        .when(i % 8 == 1, "https://api.anthropic.com/v1/complete")
        .when(i % 8 == 2, F.concat(url, F.lit("/v1/messages")))
        .when(i % 8 == 3, "https://generativelanguage.googleapis.com/v1beta")
        .when(i % 8 == 4, "eu.generativelanguage.googleapis.com:443/x")
        .when(i % 8 == 5, "http://127.0.0.1:11434/V1/Chat/Completions")
        .when(i % 8 == 6, F.concat(F.lit("http://host/models/m-"), i, F.lit(":streamGenerateContent")))
        .otherwise("")
    )
    shape = F.element_at(F.array(*[F.lit(s) for s in SHAPES]), (F.floor(i / 8) % 7 + 1).cast("int"))
    return p.select("page_id", made.alias("url"), F.parse_json(shape).alias("payload"))


URL_RULE = """case page_id % 8 when 1 then 'anthropic' when 2 then 'anthropic' when 3 then 'gemini' when 4 then 'gemini'
    when 5 then 'openai' when 6 then 'gemini' end"""


@query(
    "detect_provider",
    f"""with {URLS_SQL} select page_id, coalesce({URL_RULE}, case shape when 0 then 'anthropic' when 1 then 'anthropic'
    when 2 then 'anthropic' when 3 then 'gemini' when 4 then 'openai' when 5 then 'anthropic' else 'unknown' end) as provider from urls""",
)
def detect_provider(spark, folder):
    return _urls(spark, folder).select("page_id", PR.detect_provider(F.col("url"), F.col("payload")).alias("provider"))


@query(
    "detect_provider_gateway",
    f"""with {URLS_SQL} select page_id, coalesce({URL_RULE}, case shape when 0 then 'openai' when 1 then 'anthropic'
    when 2 then 'gemini' when 3 then 'gemini' when 4 then 'openai' when 5 then 'anthropic' else 'unknown' end) as provider from urls""",
)
def detect_provider_gateway(spark, folder):
    found = PR.detect_provider(F.col("url"), F.col("payload"), gateway=True)
    return _urls(spark, folder).select("page_id", found.alias("provider"))


@query(
    "provider_impl",
    """select event_id, case event_id % 4 when 0 then 'anthropic' when 1 then 'gemini' else 'openai' end as impl from events""",
)
def provider_impl(spark, folder):
    i = F.col("event_id")
    name = F.when(i % 4 == 0, " Anthropic ").when(i % 4 == 1, "GEMINI").when(i % 4 == 2, F.col("event_type"))
    return table(spark, folder, "events").select("event_id", PR.provider_impl(name).alias("impl"))


@query(
    "model_from_path",
    f"""with {URLS_SQL} select page_id, nullif(regexp_extract(url, '/models/([^/:]+)', 1), '') as model from urls""",
)
def model_from_path(spark, folder):
    return _urls(spark, folder).select("page_id", X.model_from_path(F.col("url")).alias("model"))


@query(
    "is_local_target",
    """select page_id, page_id % 6 in (0, 1, 2, 4) as is_local from pages""",
)
def is_local_target(spark, folder):
    p = table(spark, folder, "pages")
    i = F.col("page_id")
    host = (
        F.when(i % 6 == 0, "LocalHost")
        .when(i % 6 == 1, "gpu.lan")
        .when(i % 6 == 2, "10.0.0.9")
        .when(i % 6 == 3, "api.anthropic.com")
        .when(i % 6 == 4, PR.host_of(F.col("url")))
        .otherwise("eu.generativelanguage.googleapis.com")
    )
    provider = F.when(i % 6 == 3, "anthropic").when(i % 6 == 4, "anthropic").when(i % 6 == 5, "gemini").otherwise("openai")
    declared = F.array(
        F.struct(F.lit("gpu.lan").alias("host"), F.lit(None).cast("int").alias("port")),
        F.struct(F.lit("localhost").alias("host"), F.lit(8080).alias("port")),
    )
    port = F.when(i % 6 == 2, 8080).otherwise(443)
    return p.select("page_id", PR.is_local_target(host, port, provider, declared).alias("is_local"))


@query(
    "declared_targets",
    """select o_orderkey, o_custkey from orders where o_custkey in (select c_custkey from customer where c_nationkey = 3)""",
)
def declared_targets(spark, folder):
    # Endpoints (here: customers) of a declared list, by semi join; the optimiser picks the strategy by size.
    o = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    declared = table(spark, folder, "customer").filter("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    return o.join(declared, "o_custkey", "left_semi")


@query(
    "is_streaming_request",
    """select page_id, page_id % 5 in (0, 2, 3) as streaming,
    page_id % 5 not in (0, 2, 3) and page_id % 7 <> 0 and page_id % 3 not in (1, 2) as cacheable from pages""",
)
def is_streaming_request(spark, folder):
    p = table(spark, folder, "pages")
    i = F.col("page_id")
    payload = F.parse_json(F.when(i % 5 == 0, '{"stream":true}').when(i % 5 == 1, '{"stream":"yes"}').otherwise("{}"))
    url = F.when(i % 5 == 2, "http://x/?alt=SSE").when(i % 5 == 3, "http://x/a:streamGenerateContent").otherwise(F.col("url"))
    status = F.when(i % 7 == 0, 429).otherwise(200)
    response = F.parse_json(F.when(i % 3 == 1, '{"error":null}').when(i % 3 == 2, '{"type":"error"}').otherwise('{"id":1}'))
    rows = p.select("page_id", payload.alias("payload"), url.alias("u"), status.alias("status"), response.alias("r"))
    c = F.col
    return rows.select(
        "page_id",
        PR.is_streaming_request(c("payload"), c("u")).alias("streaming"),
        PR.is_cacheable(c("payload"), c("u"), c("status"), c("r"), F.lit("openai")).alias("cacheable"),
    )


# --- headers and identity -----------------------------------------------------------------------------


def _headers(spark, folder):
    e = table(spark, folder, "events", spread=True)
    i = F.col("event_id")
    headers = F.create_map(
        F.lit("X-Agent-Id"), F.when(i % 3 == 0, "").otherwise(F.concat(F.lit("agent-"), F.col("user_id"))),
        F.lit("X-Agent-Role"), F.when(i % 4 == 0, "planner").otherwise(""),
        F.lit("X-Mode"), F.when(i % 5 == 0, " Baseline ").when(i % 5 == 1, "active").otherwise("?"),
        F.lit("Authorization"), F.concat(F.lit("Bearer "), F.col("props")),
        F.lit("X-Custom-Token"), F.col("event_type"),
        F.lit("Accept"), F.concat(F.lit("https://h/?a=1&key="), i, F.lit("&b=2")),
    )
    return e.select("event_id", "user_id", "event_type", headers.alias("headers"))


@query(
    "header_lookup",
    """select event_id, case when event_id % 3 <> 0 then 'agent-' || user_id end as agent, cast(null as varchar) as missing from events""",
)
def header_lookup(spark, folder):
    h = F.col("headers")
    return _headers(spark, folder).select(
        "event_id", PR.header(h, "x-AGENT-id").alias("agent"), PR.header(h, "x-none").alias("missing")
    )


@query(
    "identity",
    """select event_id, 'flow-' || event_id as flow_id, case when event_id % 3 <> 0 then 'agent-' || user_id else 'agent' end as agent_id,
    case when event_id % 4 = 0 then 'planner' else 'executor' end as agent_role from events""",
)
def identity(spark, folder):
    rows = _headers(spark, folder)
    who = R.identity(F.col("headers"), F.concat(F.lit("flow-"), "event_id"))
    return rows.select("event_id", who.alias("w")).select("event_id", "w.flow_id", "w.agent_id", "w.agent_role")


@query(
    "mode_label",
    """select event_id, case event_id % 5 when 0 then 'baseline' when 1 then 'optimized' else 'optimized' end as mode,
    case event_id % 5 when 0 then 'baseline' when 1 then 'optimized' else 'baseline' end as mode_passive from events""",
)
def mode_label(spark, folder):
    h = F.col("headers")
    return _headers(spark, folder).select(
        "event_id", R.mode_label(h).alias("mode"), R.mode_label(h, default_passive=True).alias("mode_passive")
    )


@query(
    "scrub_headers",
    """select event_id, '[REDACTED]' as authorization, '[REDACTED]' as custom_token,
    'https://h/?a=1&key=[REDACTED]&b=2' as accept, 6 as headers from events""",
)
def scrub_headers(spark, folder):
    h = _headers(spark, folder).select("event_id", X.redact_headers(F.col("headers")).alias("h"))
    return h.select(
        "event_id",
        F.col("h")["authorization"].alias("authorization"),
        F.col("h")["x-custom-token"].alias("custom_token"),
        F.col("h")["accept"].alias("accept"),
        F.size("h").alias("headers"),
    )


# --- redaction ----------------------------------------------------------------------------------------

# Fake credentials are put together here, so that none stands in the repository.
FAKES = (
    ("sk-" + "ant-", 24, "a"),
    ("sk-" + "proj-", 24, "b"),
    ("AI" + "za", 35, "C"),
    ("gh" + "p_", 36, "d"),
    ("github" + "_pat_", 30, "e"),
    ("AK" + "IA", 16, "F"),
    ("h" + "f_", 34, "g"),
)
SECRETS_SQL = (
    "case doc_id % 9 "
    + " ".join(f"when {k} then '{p}' || repeat('{c}', {n})" for k, (p, n, c) in enumerate(FAKES))
    + " when 7 then 'http://h/p?user=1&api_key=' || doc_id || '#x' else 'nothing' end"
)


def _fake(i):
    expr = F.when(i % 9 == 7, F.concat(F.lit("http://h/p?user=1&api_key="), i, F.lit("#x")))
    for k, (prefix, count, char) in enumerate(FAKES):
        expr = expr.when(i % 9 == k, prefix + char * count)
    return expr.otherwise(F.lit("nothing"))


@query(
    "scrub_string",
    """select doc_id, text || chr(10) || case when doc_id % 9 < 7 then '[REDACTED_SECRET]'
    when doc_id % 9 = 7 then 'http://h/p?user=1&api_key=[REDACTED]#x' else 'nothing' end || chr(10) || text as clean from documents""",
)
def scrub_string(spark, folder):
    d = table(spark, folder, "documents", spread=True)
    mixed = F.concat("text", F.lit("\n"), _fake(F.col("doc_id")), F.lit("\n"), "text")
    return d.select("doc_id", X.redact_text(mixed).alias("clean"))


@query(
    "scrub_urls",
    """select page_id, url || case when contains(url, '?') then '&' else '?' end || 'token=[REDACTED]&z=1' as clean from pages""",
)
def scrub_urls(spark, folder):
    p = table(spark, folder, "pages")
    joint = F.when(F.contains("url", F.lit("?")), "&").otherwise("?")
    full = F.concat("url", joint, F.lit("token=s3cret"), "page_id", F.lit("&z=1"))
    # A fragment may come before the parameter: the rule looks for the parameter wherever it stands.
    return p.select("page_id", X.redact_text(full).alias("clean"))


@query(
    "scrub_payload",
    """select doc_id, '[REDACTED]' as password, text as body, '[REDACTED]' as nested_token,
    case when doc_id % 9 < 7 then '[REDACTED_SECRET]' when doc_id % 9 = 7 then 'http://h/p?user=1&api_key=[REDACTED]#x'
    else 'nothing' end as item from documents""",
)
def scrub_payload(spark, folder):
    d = table(spark, folder, "documents", spread=True)
    payload = F.to_json(
        F.struct(
            F.struct(F.lit("x").alias("deep")).alias("password"),
            F.col("text").alias("body"),
            F.array(F.struct(F.lit("t").alias("Access_Token"), _fake(F.col("doc_id")).alias("v"))).alias("list"),
        )
    )
    rows = d.select("doc_id", redact_payload(payload).alias("j")).withColumn("v", F.parse_json("j"))
    v = F.col("v")
    return rows.select(
        "doc_id",
        V.text_of(v, "$.password").alias("password"),
        V.text_of(v, "$.body").alias("body"),
        V.text_of(v, "$.list[0].Access_Token").alias("nested_token"),
        V.text_of(v, "$.list[0].v").alias("item"),
    )


_RESULTS = ",".join(['{"type":"tool_result","content":"r"}'] * 4)


@query(
    "json_kernels_bad_rows",
    f"""select doc_id,
    case doc_id % 6 when 1 then length(doc_id::varchar) + 2 when 2 then length(doc_id::varchar) + 1 when 3 then 0 else 0 end as chars,
    case when doc_id % 6 = 1 then '"\\ud800 ' || doc_id || '"' when doc_id % 6 = 2 then '"x' || doc_id || '"' end as found,
    case doc_id % 6
      when 0 then repeat('[', 20000) || repeat(']', 20000)
      when 1 then '{{"text": "\\ud800 ' || doc_id || '", "token": "[REDACTED]"}}'
      when 2 then '{{"prompt": "x' || doc_id || '", "items": [{", ".join(['{"type": "tool_result", "content": "r"}'] * 4)}]}}'
      when 3 then '{{"messages": null, "secret": "[REDACTED]"}}'
      when 4 then 'broken {{"password":"[REDACTED]", "n":' || doc_id
      else doc_id::varchar end as clean,
    case when doc_id % 6 = 2 then 'x' || doc_id else '' end as user_text
    from documents""",
)
def json_kernels_bad_rows(spark, folder):
    """Text that is nested too deep, cut inside a character, no JSON, or no request: every kernel answers for each row."""
    i = F.col("doc_id")
    text = (
        F.when(i % 6 == 0, F.concat(F.repeat(F.lit("["), 20_000), F.repeat(F.lit("]"), 20_000)))
        .when(i % 6 == 1, F.concat(F.lit('{"text":"\\ud800 '), i, F.lit('","token":"t"}')))
        .when(i % 6 == 2, F.concat(F.lit('{"prompt":"x'), i, F.lit(f'","items":[{_RESULTS}]}}')))
        .when(i % 6 == 3, F.lit('{"messages":null,"secret":[1]}'))
        .when(i % 6 == 4, F.concat(F.lit('broken {"password":"p", "n":'), i))
        .otherwise(i.cast("string"))
    )
    rows = table(spark, folder, "documents").select("doc_id", text.alias("j")).withColumn("p", F.try_parse_json("j"))
    return rows.select(
        "doc_id",
        estimate_chars(F.col("j")).alias("chars"),
        find_key(F.col("j"), "text", "prompt").alias("found"),
        redact_payload(F.col("j")).alias("clean"),
        cache_key_parts(F.col("p"), "openai")["user_text"].alias("user_text"),
    )


@query(
    "find_nested_key",
    """select event_id, case when event_id % 3 = 0 then '"' || event_type || '"' when event_id % 3 = 1 then cast(event_id as varchar) end as found
    from events""",
)
def find_nested_key(spark, folder):
    e = table(spark, folder, "events", spread=True)
    i = F.col("event_id")
    deep = F.format_string('{"a":[{"b":null},{"c":{"target":"%s"}}],"target":null}', "event_type")
    flat = F.format_string('{"x":{"other":%d},"y":{"target":"late"}}', i)
    text = F.when(i % 3 == 0, deep).when(i % 3 == 1, flat).otherwise('{"z":[1,2]}')
    return e.select("event_id", find_key(text, "target", "other").alias("found"))


# --- prompts ------------------------------------------------------------------------------------------


@query(
    "normalize_prompt",
    """select event_id, '{"at":"<TIMESTAMP>","id":"<UUID>","job":"task-<ID> task-<ID>","n":' || event_id || '}' as normalized,
    sha256('openai:{"at":"<TIMESTAMP>","id":"<UUID>","job":"task-<ID> task-<ID>","n":' || event_id || '}') as key from events""",
)
def normalize_prompt(spark, folder):
    e = table(spark, folder, "events", spread=True)
    uid = F.format_string("%08x-0000-4000-8000-%012x", "user_id", "event_id")
    raw = F.format_string(
        '{"n":%d,"job":"run_%d task-%d","id":"%s","at":"%sZ"}',
        "event_id", "event_id", "user_id", uid, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"),
    )
    text = X.mask_transients(F.to_json(F.parse_json(raw)))
    return e.select("event_id", text.alias("normalized"), X.prompt_key(F.lit("openai"), text).alias("key"))


@query(
    "tokenize_set",
    """select doc_id, len(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'))) as words from documents""",
)
def tokenize_set(spark, folder):
    d = table(spark, folder, "documents", spread=True)
    return d.select("doc_id", F.size(X.words(F.col("text"))).cast("bigint").alias("words"))


@query(
    "safe_id",
    """select page_id, regexp_replace(url, '[^a-zA-Z0-9_\\-]', '_', 'g') as safe from pages""",
)
def safe_id(spark, folder):
    return table(spark, folder, "pages").select("page_id", X.safe_id(F.col("url")).alias("safe"))


@query(
    "mask_secret",
    """select doc_id, case when length(source) <= 8 then '****' else left(source, 4) || '...' || right(source, 4) end as short,
    case when length(text) <= 8 then '****' else left(text, 4) || '...' || right(text, 4) end as long from documents""",
)
def mask_secret(spark, folder):
    d = table(spark, folder, "documents", spread=True)
    return d.select(
        "doc_id", X.mask_secret(F.col("source")).alias("short"), X.mask_secret(F.col("text")).alias("long")
    )


# --- log records --------------------------------------------------------------------------------------


@query(
    "request_payload",
    """select event_id, case event_id % 4 when 0 then '{"a":' || event_id || '}' when 1 then '{"b":' || event_id || '}' end as payload
    from events where event_id % 4 in (0, 1)""",
)
def request_payload(spark, folder):
    i = F.col("event_id")
    raw = (
        F.when(i % 4 == 0, F.format_string('{"request":{"a":%d},"url":"u"}', i))
        .when(i % 4 == 1, F.format_string('{"b":%d}', i))
        .when(i % 4 == 2, '{"request":{}}')
        .otherwise("[1]")
    )
    rows = table(spark, folder, "events").select(
        "event_id", F.to_json(A.request_payload(F.parse_json(raw))).alias("payload")
    )
    return rows.filter("payload is not null")


@query(
    "record_delta",
    """select doc_id, cast(length('{"a": [1, 2], "text": ""}') + n as bigint) as raw_chars, cast(length('{"text": ""}') + n as bigint) as cleaned_chars,
    cast(case when doc_id % 2 = 0 then 77 else length('"a": [1, 2], ') end as bigint) as chars_saved,
    cast(case when doc_id % 2 = 0 then 3 else 0 end as bigint) as tool_outputs_omitted
    from (select doc_id, length(cast(to_json(text) as varchar)) - 2 + 5 * length(regexp_replace(text, '[\\x00-\\x7e]', '', 'g')) as n from documents)""",
)
def record_delta(spark, folder):
    d = table(spark, folder, "documents", spread=True)
    raw = F.to_json(F.struct(F.array(F.lit(1), F.lit(2)).alias("a"), "text"))
    stats = F.when(
        F.col("doc_id") % 2 == 0,
        F.struct(
            F.lit(77).cast("bigint").alias("chars_saved"),
            F.lit(3).alias("tool_outputs_omitted"),
            F.lit(0).alias("turns_summarized"),
            F.lit(1).alias("cache_control_injected"),
        ),
    )
    rows = d.select("doc_id", R.delta(raw, F.to_json(F.struct("text")), stats).alias("x"))
    return rows.select("doc_id", "x.raw_chars", "x.cleaned_chars", "x.chars_saved", "x.tool_outputs_omitted")


@query(
    "timing_project",
    """select event_id, case when event_id % 4 = 0 then case when event_id % 2 = 0 then 0.0 end else round_even(value * 1000, 2) end as ttft_ms,
    case when event_id % 3 = 0 then 0.0 else round_even(value / 8 * 1000, 2) end as total_ms, event_id % 5 = 0 as streaming,
    round_even(value, 2) as prefill_tps from events""",
)
def timing_project(spark, folder):
    i, v = F.col("event_id"), F.col("value")
    none = F.lit(None).cast("double")
    t = R.timing(
        i % 2 == 0, i % 5 == 0, F.when(i % 4 != 0, v), F.when(i % 3 != 0, v / 8), none, v, none, none
    )
    rows = table(spark, folder, "events").select("event_id", t.alias("t"))
    return rows.select("event_id", "t.ttft_ms", "t.total_ms", "t.streaming", "t.prefill_tps")


@query(
    "strip_vendor_fields",
    """select doc_id, 3 as keys, false as any_marker, text as first_text, 'x' as system_text, 1 as headers from documents""",
)
def strip_vendor_fields(spark, folder):
    d = table(spark, folder, "documents", spread=True)
    mark = '"cache_control":{"type":"ephemeral"}'
    raw = F.concat(
        F.lit('{"thinking":{"x":1},"output_config":1,"context_management":[],"system":[{"type":"text","text":"x",' + mark),
        F.lit('}],"tools":[{"name":"t",' + mark + '}],"messages":[{"role":"user","content":[{"type":"text",' + mark + ',"text":'),
        F.regexp_extract(F.to_json(F.struct("text")), '(?s)^\\{"text":(.*)\\}$', 1),
        F.lit('}]},{"role":"user","content":{' + mark + "}}]}"),
    )
    rows = d.select("doc_id", R.strip_vendor_fields(F.parse_json(raw)).alias("j")).withColumn("v", F.parse_json("j"))
    v = F.col("v")
    return rows.select(
        "doc_id",
        F.size(V.fields(v)).alias("keys"),
        F.contains("j", F.lit('"cache_control"')).alias("any_marker"),
        V.text_of(v, "$.messages[0].content[0].text").alias("first_text"),
        V.text_of(v, "$.system[0].text").alias("system_text"),
        F.size(R.strip_vendor_headers(F.create_map(F.lit("Anthropic-Beta"), "j", F.lit("Accept"), "j"))).alias("headers"),
    )


@query(
    "clean_for_local_target",
    """select doc_id as payload_id, doc_id % 3 = 0 as is_local, cast(case when doc_id % 3 = 0 then 0
    when len(string_split(text, chr(10))) < 2 and doc_id % 4 <> 0 then 2 else 3 end as bigint) as cache_control_injected,
    doc_id % 3 <> 0 as any_marker from documents""",
)
def clean_for_local_target(spark, folder):
    from turnscope.operators.conversation import CleanOptions, clean_payload
    from turnscope.plans.views import requests

    r = clean_payload(requests(spark, folder, "anthropic"), "payload", "provider", CleanOptions(max_turns=1_000_000))
    local = F.col("payload_id") % 3 == 0
    sent = r.select("payload_id", local.alias("is_local"), R.for_local_target(F.col("clean"), local).alias("c"))
    return sent.select(
        "payload_id",
        "is_local",
        "c.cache_control_injected",
        F.contains("c.cleaned", F.lit('"cache_control":{"type":"ephemeral"}')).alias("any_marker"),
    )


@query(
    "require_payloads",
    """select event_id from events where event_id % 3 <> 0 and event_id % 4 <> 1""",
)
def require_payloads(spark, folder):
    i = F.col("event_id")
    rows = table(spark, folder, "events").select(
        "event_id",
        F.when(i % 3 != 0, F.col("props")).alias("request"),
        F.when(i % 4 == 1, "{}").otherwise(F.col("props")).alias("response"),
    )
    return R.require_payloads(rows, "request", "response").select("event_id")


def exchanges(spark, folder):
    """Every event as a captured exchange; every third one answered as a stream."""
    e = table(spark, folder, "events", spread=True)
    i, v = F.col("event_id"), F.col("value")
    text = F.concat(F.lit("hello "), "event_type", F.lit(" "), _fake(i))
    raw = F.concat(
        F.lit('{"messages":[{"role":"user","content":"'), text, F.lit('"},{"role":"assistant","content":"ok"},{"role":"user","content":"go"}],"api_key":"k"}')
    )
    usage = F.format_string('"usage":{"prompt_tokens":%d,"completion_tokens":%d}', i % 1000 + 1, i % 70)
    stream = F.concat(
        F.lit('data: {"choices":[{"delta":{"content":"a"}}]}\n\ndata: {"choices":[{"delta":{"content":"b"}}]}\n\ndata: {'), usage, F.lit("}\n")
    )
    plain = F.concat(F.lit('{"choices":[{"message":{"content":"ab"}}],'), usage, F.lit("}"))
    streamed = i % 3 == 0
    no_stats = F.lit(None).cast(
        "struct<chars_saved:bigint,tool_outputs_omitted:bigint,turns_summarized:bigint,cache_control_injected:bigint>"
    )
    return e.select(
        F.concat(F.lit("f"), i).alias("flow_id"),
        F.concat(F.lit("https://api.openai.com/v1/chat/completions?key="), i).alias("url"),
        F.lit("openai").alias("provider"),
        F.create_map(F.lit("X-Api-Key"), F.col("props"), F.lit("X-Mode"), F.when(i % 2 == 0, "baseline").otherwise("active")).alias("headers"),
        "ts",
        raw.alias("raw_json"),
        raw.alias("cleaned_json"),
        no_stats.alias("stats"),
        F.when(~streamed, plain).alias("response_json"),
        F.when(streamed, stream).alias("body"),
        F.lit(200).alias("status"),
        (F.col("event_type") == "view").alias("is_hit"),
        F.when(F.col("event_type") != "view", v / 100).alias("ttft_s"),
        F.when(F.col("event_type") != "view", v / 50).alias("total_s"),
        F.when(streamed, v / 100).alias("generation_s"),
        i.alias("fallback_turn"),
    )


@query(
    "wire_record",
    f"""with e as (select *, {SECRETS_SQL.replace("doc_id", "event_id")} as fake, event_id % 3 = 0 as streamed, event_type = 'view' as hit,
       event_id % 1000 + 1 as inp, event_id % 70 as outp from events)
    select 'f' || event_id as flow_id, '2' as turn_id, 'agent' as agent_id,
      'https://api.openai.com/v1/chat/completions?key=[REDACTED]' as endpoint, '[REDACTED]' as api_key_header,
      case when event_id % 2 = 0 then 'baseline' else 'optimized' end as mode, case when hit then 'HIT' else 'MISS' end as cache_action,
      'hello ' || event_type || ' ' || case when event_id % 9 < 7 then '[REDACTED_SECRET]'
        when event_id % 9 = 7 then 'http://h/p?user=1&api_key=[REDACTED]#x' else fake end as first_text, '[REDACTED]' as api_key,
      cast(inp as bigint) as input_tokens, cast(outp as bigint) as output_tokens, cast(case when hit then inp else 0 end as bigint) as cache_read,
      case when hit then 0.0 else round_even(value / 100 * 1000, 2) end as ttft_ms,
      case when not hit and value > 0 then round_even(inp / (value / 100), 2) end as prefill_tps,
      case when not hit and streamed and outp > 0 and value / 100 >= 0.05 then round_even(outp / (value / 100), 2) end as decode_tps,
      case when streamed then 'ab' end as stream_text
    from e""",
)
def wire_record(spark, folder):
    r = R.wire_record(exchanges(spark, folder))
    raw = F.parse_json("raw_request")
    return r.select(
        "flow_id",
        "turn_id",
        "agent_id",
        F.col("endpoint"),
        F.col("headers")["x-api-key"].alias("api_key_header"),
        "mode",
        "cache_action",
        V.text_of(raw, "$.messages[0].content").alias("first_text"),
        V.text_of(raw, "$.api_key").alias("api_key"),
        F.col("response.usage.input_tokens").alias("input_tokens"),
        F.col("response.usage.output_tokens").alias("output_tokens"),
        F.col("response.usage.cache_read_input_tokens").alias("cache_read"),
        F.col("timing.ttft_ms").alias("ttft_ms"),
        F.col("timing.prefill_tps").alias("prefill_tps"),
        F.col("timing.decode_tps").alias("decode_tps"),
        F.when(F.col("timing.streaming"), F.col("response.content")).alias("stream_text"),
    )


@query(
    "usage_normalise",
    """select 'f' || event_id as flow_id, cast(event_id % 1000 + 1 as bigint) as input_tokens,
    cast(case when event_type = 'view' then event_id % 1000 + 1 else 0 end as bigint) as cache_read_input_tokens,
    cast(event_id % 70 as bigint) as output_tokens from events""",
)
def usage_normalise(spark, folder):
    r = R.usage_for_record(
        exchanges(spark, folder), "is_hit", "provider", "raw_json", "cleaned_json", "response_json", "body"
    )
    return r.select("flow_id", "usage.input_tokens", "usage.cache_read_input_tokens", "usage.output_tokens")


@query(
    "content_extract",
    """select 'f' || event_id as flow_id, case when event_id % 3 = 0 then 'ab' end as stream_text, event_id % 3 <> 0 as is_object from events""",
)
def content_extract(spark, folder):
    from turnscope.operators.usage import reply_content

    c = F.col
    rows = exchanges(spark, folder).select(
        "flow_id", "body", reply_content(c("body"), c("response_json"), c("provider")).alias("content")
    )
    return rows.select(
        "flow_id",
        F.when(c("body").isNotNull(), c("content")).alias("stream_text"),
        F.coalesce(F.startswith("content", F.lit("{")), F.lit(False)).alias("is_object"),
    )
