"""Queries over requests and their turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnscope.functions import text as X
from turnscope.functions import variants as V
from turnscope.operators import conversation as C
from turnscope.operators import turns as T
from turnscope.operators.conversation import CleanOptions
from turnscope.operators.records import turn_id
from turnscope.plans.registry import query, table
from turnscope.plans.views import (
    OPENAI_ROLE_SQL,
    ROLE_SQL,
    TURNS_SQL,
    conversation_turns,
    document_turns,
    requests,
)

KEEP, LONG = 4, 10
NON_ASCII = "length(regexp_replace({0}, '[\\x00-\\x7e]', '', 'g'))"
JSON_LENGTH = "(length(cast(to_json({0}) as varchar)) - 2 + 5 * " + NON_ASCII + ")"


def _blocks(df, messages):
    turns = df.select("payload_id", F.posexplode(messages).alias("turn_idx", "m"))
    return turns.select("payload_id", "turn_idx", "m.role", F.posexplode("m.blocks").alias("block_idx", "b"))


@query(
    "to_messages",
    f"""with {TURNS_SQL} select payload_id, turn_idx, {ROLE_SQL} as role, 0 as block_idx,
    case turn_idx % 3 when 0 then 'string' when 1 then 'text' else 'tool_result' end as kind, line as text,
    case when turn_idx % 3 = 2 then 't' || turn_idx end as tool_id from turns""",
)
def to_messages(spark, folder):
    rows = C.to_blocks(requests(spark, folder, "anthropic"), "payload", "anthropic", "payload_id")
    return rows.select("payload_id", "turn_idx", "role", "block_idx", "kind", "text", "tool_id")


@query(
    "from_messages",
    f"""with {TURNS_SQL} select payload_id, count(*) as turns, cast(sum(length(line)) as bigint) as chars from turns group by payload_id""",
)
def from_messages(spark, folder):
    r = requests(spark, folder, "anthropic")
    off = F.struct(*[F.lit(False).alias(n) for n in ("system", "tools", "turn")])
    back = r.select(
        "payload_id",
        C.render(F.col("payload"), "anthropic", C.messages_of(F.col("payload"), "anthropic"), off).alias("json"),
    )
    again = back.withColumn("m", C.messages_of(F.parse_json("json"), "anthropic"))
    chars = F.aggregate(
        "m", F.lit(0).cast("bigint"), lambda a, m: a + F.length(F.get(m["blocks"], F.lit(0))["text"])
    )
    return again.select("payload_id", F.size("m").cast("bigint").alias("turns"), chars.alias("chars"))


# --- repeated content ---------------------------------------------------------------------------------

DEDUP_SQL = """
firsts as (
  select *, min(turn_idx) over (partition by payload_id, key) as first_turn,
    first_value(src) over (partition by payload_id, key order by turn_idx) as first_src from keyed),
marked as (select *, key is not null and first_turn < turn_idx and turn_idx < n - 2 as omitted from firsts)"""

ANTHROPIC_KEYS = """
keyed as (
  select *, case when length(line) > (case when turn_idx % 3 = 0 then 200 else 100 end) then line end as key,
    case when turn_idx % 3 = 2 then 't' || turn_idx else 'turn_' || turn_idx end as src from turns)"""

OPENAI_KEYS = f"""
roles as (select *, {OPENAI_ROLE_SQL} as role from turns),
keyed as (
  select *, case when length(line) > (case when role = 'tool' then 100 else 200 end) then line end as key, '' as src from roles)"""

GEMINI_KEYS = f"""
keyed as (
  select *, case when turn_idx % 4 < 2 then case when length(line) > 100 then line end
    when 14 + {JSON_LENGTH.format("line")} > 100 then 'reply:' || line end as key, '' as src from turns)"""


def _dedup(spark, folder, provider):
    r = requests(spark, folder, provider).withColumn("m", C.messages_of(F.col("payload"), provider))
    rows = _blocks(r, C.dedup(F.col("m"), provider))
    return rows.select(
        "payload_id", "turn_idx", "block_idx", "b.omitted", F.when(F.col("b.omitted"), F.col("b.text")).alias("text")
    )


def _dedup_sql(keys, text):
    return f"""with {TURNS_SQL}, {keys}, {DEDUP_SQL}
    select payload_id, turn_idx, 0 as block_idx, omitted, case when omitted then {text} end as text from marked"""


@query(
    "dedup_anthropic",
    _dedup_sql(
        ANTHROPIC_KEYS,
        "'[Tool output omitted: identical output matches Turn ' || first_turn || ' (' || first_src || ')]'",
    ),
)
def dedup_anthropic(spark, folder):
    return _dedup(spark, folder, "anthropic")


@query(
    "dedup_openai",
    _dedup_sql(
        OPENAI_KEYS,
        "case when role = 'tool' then '[Tool output' else '[Message content' end || "
        "' omitted: identical output matches Turn ' || first_turn || ']'",
    ),
)
def dedup_openai(spark, folder):
    return _dedup(spark, folder, "openai")


@query(
    "dedup_gemini",
    _dedup_sql(GEMINI_KEYS, "'[Tool output omitted: identical output matches Turn ' || first_turn || ']'"),
)
def dedup_gemini(spark, folder):
    return _dedup(spark, folder, "gemini")


# --- history summary ----------------------------------------------------------------------------------


def _summary_sql(role, clean_user, prefix, target, suffix, summary_role):
    return f"""with {TURNS_SQL},
    r as (select *, {role} as role from turns),
    u as (select *, {clean_user} as is_user from r),
    p as (select payload_id, max(n) as n, {prefix} as prefix from u group by payload_id),
    q as (select *, {target} as target from p),
    s as (select q.payload_id, max(q.n) as n, max(q.prefix) as prefix, {suffix} as suffix
          from u join q using (payload_id) group by q.payload_id),
    z as (select payload_id, prefix, case when n > {LONG} and suffix > prefix then suffix end as suffix from s)
    select payload_id, case when suffix is null or turn_idx < prefix then turn_idx else turn_idx - suffix + prefix + 1 end as pos,
      role, line as text from u join z using (payload_id) where suffix is null or turn_idx < prefix or turn_idx >= suffix
    union all
    select payload_id, prefix, '{summary_role}', '[Summary of omitted ' || (suffix - prefix) || ' intermediate conversation turns]'
      from z where suffix is not null"""


NEAREST = """coalesce(max(turn_idx) filter (where is_user and turn_idx >= 1 and turn_idx <= target),
    min(turn_idx) filter (where is_user and turn_idx > greatest(target, 0)))"""


def _summarized(spark, folder, provider):
    r = requests(spark, folder, provider).withColumn("m", C.messages_of(F.col("payload"), provider))
    short = F.when(F.size("m") > LONG, C.summarize(F.col("m"), provider, KEEP)).otherwise(F.col("m"))
    rows = r.select("payload_id", F.posexplode(short).alias("pos", "x"))
    text = F.get("x.blocks", F.lit(0))["text"]
    if provider == "gemini":
        text = F.coalesce(F.try_variant_get(F.try_parse_json(text), "$.output", "string"), text)
    return rows.select("payload_id", F.col("pos").cast("bigint").alias("pos"), "x.role", text.alias("text"))


@query(
    "summarize_anthropic",
    _summary_sql(ROLE_SQL, "role = 'user' and turn_idx % 3 <> 2", "1", f"n - {KEEP}", NEAREST, "assistant"),
)
def summarize_anthropic(spark, folder):
    return _summarized(spark, folder, "anthropic")


@query(
    "summarize_openai",
    _summary_sql(
        OPENAI_ROLE_SQL,
        "role = 'user'",
        "case when max(n) > 1 and bool_or(turn_idx = 0 and role = 'system') and bool_or(turn_idx = 1 and role = 'user') then 2 else 1 end",
        f"greatest(prefix + 1, n - {KEEP})",
        """coalesce(min(turn_idx) filter (where is_user and turn_idx >= target),
           max(turn_idx) filter (where is_user and turn_idx > prefix and turn_idx < target))""",
        "assistant",
    ),
)
def summarize_openai(spark, folder):
    return _summarized(spark, folder, "openai")


@query(
    "summarize_gemini",
    _summary_sql(
        "case when turn_idx % 2 = 0 then 'user' else 'model' end", "role = 'user'", "1", f"n - {KEEP}", NEAREST, "model"
    ),
)
def summarize_gemini(spark, folder):
    return _summarized(spark, folder, "gemini")


# --- adjacent roles -----------------------------------------------------------------------------------

ISLANDS_SQL = """
steps as (select *, case when role is distinct from lag(role) over w and turn_idx > 0 then 1 else 0 end as step
  from roles window w as (partition by payload_id order by turn_idx)),
islands as (select *, sum(step) over (partition by payload_id order by turn_idx) as island from steps)"""


@query(
    "merge_roles",
    f"""with {TURNS_SQL}, roles as (select *, {OPENAI_ROLE_SQL} as role from turns), {ISLANDS_SQL}
    select payload_id, cast(island as bigint) as pos, role, string_agg(line, chr(10) || chr(10) order by turn_idx) as text
    from islands group by payload_id, island, role""",
)
def merge_roles(spark, folder):
    r = requests(spark, folder, "openai").withColumn("m", C.messages_of(F.col("payload"), "openai"))
    rows = r.select("payload_id", F.posexplode(C.merge_roles(F.col("m"))).alias("pos", "x"))
    return rows.select(
        "payload_id",
        F.col("pos").cast("bigint").alias("pos"),
        "x.role",
        F.get("x.blocks", F.lit(0))["text"].alias("text"),
    )


@query(
    "merge_role_blocks",
    f"""with {TURNS_SQL}, roles as (select *, case when turn_idx % 2 = 0 then 'user' else 'model' end as r0,
      case when turn_idx % 6 < 3 then 'user' else 'model' end as role from turns), {ISLANDS_SQL}
    select payload_id, cast(island as bigint) as pos, role, count(*) as blocks, cast(sum(length(line)) as bigint) as chars
    from islands group by payload_id, island, role""",
)
def merge_role_blocks(spark, folder):
    r = requests(spark, folder, "gemini").withColumn("m", C.messages_of(F.col("payload"), "gemini"))
    role = lambda i: F.when(i % 6 < 3, "user").otherwise("model")
    r = r.withColumn("m", F.transform("m", lambda m, i: m.withField("role", role(i))))
    rows = r.select("payload_id", F.posexplode(C.merge_roles(F.col("m"))).alias("pos", "x"))
    size = lambda b: F.length(
        F.coalesce(F.try_variant_get(F.try_parse_json(F.when(b["kind"] == "functionResponse", b["text"])), "$.output", "string"), b["text"])
    )
    return rows.select(
        "payload_id",
        F.col("pos").cast("bigint").alias("pos"),
        "x.role",
        F.size("x.blocks").cast("bigint").alias("blocks"),
        F.aggregate("x.blocks", F.lit(0).cast("bigint"), lambda a, b: a + size(b)).alias("chars"),
    )


# --- cache breakpoints --------------------------------------------------------------------------------


def _marked_requests(spark, folder):
    """Requests with markers on some system texts, tools and blocks."""
    d = table(spark, folder, "documents", spread=True)
    i = F.col("doc_id")
    mark = ',"cache_control":{"type":"ephemeral"}'

    def turn(line, k):
        flag = F.when((k % 7 == 4) & (i % 2 == 0), mark).otherwise("")
        listed = F.concat(F.lit('[{"type":"text","text":"t"'), flag, F.lit("}]"))
        return F.concat(F.lit('{"role":"user","content":'), F.when(k % 2 == 0, listed).otherwise('"s"'), F.lit("}"))

    system = F.when(i % 5 == 0, '"Be brief."').when(i % 5 == 1, "[]").when(i % 5 == 2, "null").otherwise(
        F.concat(F.lit('[{"type":"text","text":"a"'), F.when(i % 5 == 3, mark).otherwise(""), F.lit("}]"))
    )
    tools = F.concat(F.lit('[{"name":"x"},{"name":"y"'), F.when(i % 3 == 0, mark).otherwise(""), F.lit("}]"))
    text = F.concat(
        F.lit('{"system":'), system, F.lit(',"tools":'), tools, F.lit(',"messages":['),
        F.array_join(F.transform(F.split("text", "\n"), turn), ","), F.lit("]}"),
    )
    return d.select(F.col("doc_id").alias("payload_id"), F.parse_json(text).alias("payload"))


POINTS_SQL = """
lines as (select doc_id as payload_id, doc_id % 5 as sys, doc_id % 3 = 0 as tool_marked, doc_id % 2 = 0 as blocks_marked,
    len(string_split(text, chr(10))) as n from documents),
points as (select *, case when sys = 3 then 1 else 0 end + case when tool_marked then 1 else 0 end
    + case when blocks_marked then (select count(*) from range(n) as g(k) where k % 7 = 4 and k % 2 = 0) else 0 end as existing,
    sys = 0 or sys = 4 as can_system, not tool_marked as can_tools,
    n >= 2 and not (blocks_marked and (n - 2) % 7 = 4 and (n - 2) % 2 = 0) as can_turn from lines),
plan1 as (select *, can_system and 4 - existing > 0 as p_system from points),
plan2 as (select *, can_tools and 4 - existing - cast(p_system as int) > 0 as p_tools from plan1),
plan3 as (select *, can_turn and 4 - existing - cast(p_system as int) - cast(p_tools as int) > 0 as p_turn from plan2)"""


@query(
    "count_cache_controls",
    f"with {POINTS_SQL} select payload_id, cast(existing as bigint) as markers from plan3",
)
def count_cache_controls(spark, folder):
    r = _marked_requests(spark, folder).withColumn("m", C.messages_of(F.col("payload"), "anthropic"))
    return r.select("payload_id", C.cache_points(F.col("payload"), F.col("m")).cast("bigint").alias("markers"))


@query(
    "inject_cache_controls",
    f"""with {POINTS_SQL} select payload_id, p_system, p_tools, p_turn,
    cast(cast(p_system as int) + cast(p_tools as int) + cast(p_turn as int) as bigint) as injected,
    cast(existing + cast(p_system as int) + cast(p_tools as int) + cast(p_turn as int) as bigint) as markers_after from plan3""",
)
def inject_cache_controls(spark, folder):
    r = _marked_requests(spark, folder).withColumn("m", C.messages_of(F.col("payload"), "anthropic"))
    r = r.withColumn("plan", C.injection_plan(F.col("payload"), F.col("m")))
    r = r.withColumn("after", F.parse_json(C.render(F.col("payload"), "anthropic", F.col("m"), F.col("plan"))))
    r = r.withColumn("m2", C.messages_of(F.col("after"), "anthropic"))
    return r.select(
        "payload_id",
        F.col("plan.system").alias("p_system"),
        F.col("plan.tools").alias("p_tools"),
        F.col("plan.turn").alias("p_turn"),
        C.plan_size(F.col("plan")).alias("injected"),
        C.cache_points(F.col("after"), F.col("m2")).cast("bigint").alias("markers_after"),
    )


# --- the pipeline -------------------------------------------------------------------------------------


def _clean(spark, folder, provider, options):
    r = C.clean_payload(requests(spark, folder, provider), "payload", "provider", options)
    return r.select(
        "payload_id",
        *[
            f"clean.{n}"
            for n in ("tool_outputs_omitted", "turns_summarized", "cache_control_injected", "chars_saved")
        ],
    )


# Sizes of the spaced ASCII form: a tombstone against the text, a marker and its list around a string turn.
MARKED = len(', "cache_control": {"type": "ephemeral"}')
AS_LIST = len('[{"type": "text", "text": }]')
STONE = "length('[Tool output omitted: identical output matches Turn ' || first_turn || ' (' || first_src || ')]')"
CLEAN_ANTHROPIC_SQL = f"""with {TURNS_SQL}, {ANTHROPIC_KEYS}, {DEDUP_SQL},
    saved as (
      select payload_id, max(n) as n, count(*) filter (where omitted) as omitted,
        coalesce(sum(case when omitted then {JSON_LENGTH.format("line")} - {STONE} end), 0) as saved
      from marked group by payload_id)
    select payload_id, omitted as tool_outputs_omitted, cast(0 as bigint) as turns_summarized,
      cast(2 + case when n >= 2 then 1 else 0 end as bigint) as cache_control_injected,
      cast(greatest(0, saved - {MARKED + AS_LIST} - {MARKED}
        - case when n < 2 then 0 when (n - 2) % 3 = 0 then {MARKED + AS_LIST} else {MARKED} end) as bigint) as chars_saved
    from saved"""


@query("clean_payload", CLEAN_ANTHROPIC_SQL)
def clean_payload(spark, folder):
    return _clean(spark, folder, "anthropic", CleanOptions(max_turns=1_000_000))


@query(
    "clean_payload_openai",
    f"""with {TURNS_SQL}, {OPENAI_KEYS}, {DEDUP_SQL}
    select payload_id, count(*) filter (where omitted) as tool_outputs_omitted, cast(0 as bigint) as turns_summarized,
      cast(0 as bigint) as cache_control_injected,
      cast(greatest(0, coalesce(sum(case when omitted then {JSON_LENGTH.format("line")} - length(case when role = 'tool' then
        '[Tool output' else '[Message content' end || ' omitted: identical output matches Turn ' || first_turn || ']') end), 0))
      as bigint) as chars_saved
    from marked group by payload_id""",
)
def clean_payload_openai(spark, folder):
    return _clean(spark, folder, "openai", CleanOptions(max_turns=1_000_000))


# The whole pipeline, summaries and merged turns included. Lengths are those of the spaced ASCII form of every
# turn as it was (``before``) and as it is left: one text, or blocks of which texts ahead of the first list are one.
TEXT_BLOCK = len('{"type": "text", "text": ""}')
TEXT_TURN = len('{"role": "", "content": ""}')
TOOL_BLOCK = len('{"type": "tool_result", "tool_use_id": "", "content": ""}')
PART = len('{"text": ""}')
REPLY = len('{"functionResponse": {"name": "f0", "response": {"output": ""}}}')


def _block_length(text):
    reply = f"{REPLY} + cast(said <> line as int)"  # The key of a replaced answer is one longer.
    return f"""(case kind when 'tool' then {TOOL_BLOCK} + length('t' || turn_idx) when 'part' then {PART}
      when 'reply' then {reply if text == "said" else REPLY} else {TEXT_BLOCK} end + {JSON_LENGTH.format(text)})"""


LIST_TURN = "(case when p = 'gemini' then length('{\"role\": \"\", \"parts\": []}') else length('{\"role\": \"\", \"content\": []}') end)"
MIXED_SQL = f"""with {TURNS_SQL},
    typed as (
      select payload_id, line, turn_idx, n, p,
        case p when 'anthropic' then {ROLE_SQL} when 'openai' then {OPENAI_ROLE_SQL}
          else case when turn_idx % 2 = 0 then 'user' else 'model' end end as role,
        case p when 'openai' then 'string' when 'gemini' then case when turn_idx % 4 < 2 then 'part' else 'reply' end
          else case turn_idx % 3 when 0 then 'string' when 1 then 'text' else 'tool' end end as kind
      from (select *, case when lang in ('en', 'de') then 'anthropic' when lang = 'fr' then 'openai'
        when lang = 'es' then 'gemini' end as p from turns) where p is not null),
    keyed as (
      select *, case when kind = 'tool' then 't' || turn_idx else 'turn_' || turn_idx end as src,
        case when kind = 'reply' then case when 14 + {JSON_LENGTH.format("line")} > 100 then 'reply:' || line end
          when length(line) > (case when kind = 'string' and role <> 'tool' then 200 else 100 end) then line end as key
      from typed),
    {DEDUP_SQL},
    told as (
      select *, case when not omitted then line
        else case when p = 'openai' and role <> 'tool' then '[Message content' else '[Tool output' end
          || ' omitted: identical output matches Turn ' || first_turn
          || case when p = 'anthropic' then ' (' || first_src || ')]' else ']' end end as said,
        role = 'user' and kind <> 'tool' as is_user,
        case when p = 'openai' and n > 1 then 2 else 1 end as prefix,
        case when p = 'openai' then greatest(case when n > 1 then 3 else 2 end, n - {KEEP}) else n - {KEEP} end as target
      from marked),
    spans as (
      select payload_id, p, max(n) as n, max(prefix) as prefix, count(*) filter (where omitted) as omitted,
        sum(case when kind = 'string' then {TEXT_TURN} + {JSON_LENGTH.format("line")} else {LIST_TURN} + {_block_length("line")} end
          + length(role) + 2) as before,
        case when p = 'openai' then coalesce(min(turn_idx) filter (where is_user and turn_idx >= target),
            max(turn_idx) filter (where is_user and turn_idx > prefix and turn_idx < target))
          else coalesce(max(turn_idx) filter (where is_user and turn_idx >= 1 and turn_idx <= target),
            min(turn_idx) filter (where is_user and turn_idx > greatest(target, 0))) end as spot
      from told group by payload_id, p),
    cuts as (select *, case when n > {LONG} and spot > prefix then spot end as suffix from spans),
    left_over as (
      select payload_id, p, case when suffix is null or turn_idx < prefix then turn_idx else turn_idx - suffix + prefix + 1 end as pos,
        role, kind, turn_idx, line, said, suffix is not null or (n > {LONG} and p = 'anthropic') as merges
      from told join (select payload_id, suffix from cuts) using (payload_id)
      where suffix is null or turn_idx < prefix or turn_idx >= suffix
      union all
      select payload_id, p, prefix, case when p = 'gemini' then 'model' else 'assistant' end,
        case when p = 'gemini' then 'part' else 'string' end, prefix, note, note, true
      from (select *, '[Summary of omitted ' || (suffix - prefix) || ' intermediate conversation turns]' as note from cuts)
      where suffix is not null),
    steps as (
      select *, case when not merges or role is distinct from lag(role) over (partition by payload_id order by pos) then 1 else 0 end as step
      from left_over),
    runs as (select *, sum(step) over (partition by payload_id order by pos) as run from steps),
    listed as (select *, min(case when kind <> 'string' then pos end) over (partition by payload_id, run) as first_list from runs),
    made as (
      select payload_id, run, max(length(role)) + 2 + case when max(first_list) is null
        then {TEXT_TURN} + sum({JSON_LENGTH.format("said")}) + 4 * (count(*) - 1)
        else max({LIST_TURN}) + coalesce(sum({_block_length("said")} + 2) filter (where pos >= first_list), 0) - 2
          + coalesce({TEXT_BLOCK} + 2 + sum({JSON_LENGTH.format("said")} + 4) filter (where pos < first_list) - 4, 0) end as chars,
        max(first_list) is null as is_text
      from listed group by payload_id, run),
    placed as (select *, row_number() over (partition by payload_id order by run desc) as back from made),
    after as (
      select payload_id, count(*) as turns, sum(chars) as chars, coalesce(bool_or(back = 2 and is_text), false) as wraps
      from placed group by payload_id)
    select payload_id, p as provider, cast(omitted as bigint) as tool_outputs_omitted,
      cast(coalesce(suffix - prefix, 0) as bigint) as turns_summarized,
      cast(case when p <> 'anthropic' then 0 when turns >= 2 then 3 else 2 end as bigint) as cache_control_injected,
      cast(greatest(0, before - chars - case when p <> 'anthropic' then 0 else {MARKED} * (case when turns >= 2 then 3 else 2 end)
        + {AS_LIST} * (1 + cast(wraps as int)) end) as bigint) as chars_saved
    from cuts join after using (payload_id)"""


@query("clean_payload_mixed", MIXED_SQL)
def clean_payload_mixed(spark, folder):
    both = requests(spark, folder, "anthropic").filter("lang in ('en', 'de')")
    for name, lang in (("openai", "fr"), ("gemini", "es")):
        both = both.unionByName(requests(spark, folder, name).filter(F.col("lang") == lang))
    r = C.clean_payload(both, "payload", "provider", CleanOptions(max_turns=LONG, keep_recent=KEEP))
    return r.select(
        "payload_id",
        "provider",
        "clean.tool_outputs_omitted",
        "clean.turns_summarized",
        "clean.cache_control_injected",
        "clean.chars_saved",
    )


@query(
    "estimate_chars",
    f"""with {TURNS_SQL} select payload_id, cast(17 - 1 + sum(length(line)) as bigint) as chars from turns group by payload_id""",
)
def estimate_chars(spark, folder):
    rows = C.with_chars(requests(spark, folder, "anthropic"), "payload", "json", "chars")
    return rows.select("payload_id", "chars")


@query(
    "estimate_chars_kernel",
    f"""with {TURNS_SQL} select payload_id,
    cast(sum(case when turn_idx % 4 < 2 then length(line) else length(line) + 2 end) as bigint) as chars from turns group by payload_id""",
)
def estimate_chars_kernel(spark, folder):
    # A function reply has no text key, so its name counts with its output.
    rows = C.with_chars(requests(spark, folder, "gemini"), "payload", "json", "chars")
    return rows.select("payload_id", "chars")


# --- turn rows ----------------------------------------------------------------------------------------

DOC_TURNS_SQL = f"{TURNS_SQL}, dt as (select payload_id, turn_idx, {ROLE_SQL} as role, line as text, n from turns)"


@query(
    "first_occurrence",
    f"""with {DOC_TURNS_SQL} select payload_id, turn_idx, case when length(text) > 100 then sha256(text) end as content_hash,
    case when length(text) > 100 then min(turn_idx) over (partition by payload_id, text) end as first_turn from dt""",
)
def first_occurrence(spark, folder):
    return T.first_occurrence(document_turns(spark, folder)).select(
        "payload_id", "turn_idx", "content_hash", "first_turn"
    )


@query(
    "first_occurrence_by_lang",
    """select lang as payload_id, doc_id as turn_idx,
    case when length(text) > 100 then min(doc_id) over (partition by lang, text) end as first_turn from documents""",
)
def first_occurrence_by_lang(spark, folder):
    # All documents of a language as one payload: a few keys hold the whole table.
    d = table(spark, folder, "documents", spread=True)
    turns = d.select(F.col("lang").alias("payload_id"), F.col("doc_id").alias("turn_idx"), "text")
    return T.first_occurrence(turns).select("payload_id", "turn_idx", "first_turn")


@query(
    "recent_guard",
    f"with {DOC_TURNS_SQL} select payload_id, turn_idx, turn_idx < n - 2 as is_older from dt",
)
def recent_guard(spark, folder):
    return T.recent_guard(document_turns(spark, folder)).select("payload_id", "turn_idx", "is_older")


@query(
    "dedup_turns",
    f"""with {DOC_TURNS_SQL},
    f as (select *, case when length(text) > 200 then min(turn_idx) over (partition by payload_id, text) end as ft from dt)
    select payload_id, turn_idx, role, coalesce(ft < turn_idx and turn_idx < n - 2, false) as omitted,
      case when ft < turn_idx and turn_idx < n - 2 then '[Tool output omitted: identical output matches Turn ' || ft || ' (turn_' || ft || ')]'
      else text end as text from f""",
)
def dedup_turns(spark, folder):
    return T.dedup_turns(document_turns(spark, folder))


@query(
    "suffix_start",
    f"""with {DOC_TURNS_SQL} select payload_id, max(n) as n_turns, coalesce(
      max(turn_idx) filter (where role = 'user' and turn_idx >= 1 and turn_idx <= n - {KEEP}),
      min(turn_idx) filter (where role = 'user' and turn_idx > greatest(n - {KEEP}, 0))) as suffix_start from dt group by payload_id""",
)
def suffix_start(spark, folder):
    return T.suffix_start(document_turns(spark, folder), KEEP)


@query(
    "summarize_turns",
    """with c as (select *, count(*) over (partition by conv_id) as n from conversations),
    s as (select conv_id, max(n) as n, coalesce(max(turn) filter (where role = 'user' and turn >= 1 and turn <= n - 2),
      min(turn) filter (where role = 'user' and turn > greatest(n - 2, 0))) as s from c group by conv_id),
    z as (select conv_id, s from s where n > 3 and s > 1)
    select conv_id as payload_id, turn as turn_idx, role, text from c left join z using (conv_id) where s is null or turn < 1 or turn >= s
    union all select conv_id, 1, 'assistant', '[Summary of omitted ' || (s - 1) || ' intermediate conversation turns]' from z""",
)
def summarize_turns(spark, folder):
    return T.summarize_turns(conversation_turns(spark, folder), 3, 2)


@query(
    "role_islands",
    f"""with {DOC_TURNS_SQL}, roles as (select * from dt), {ISLANDS_SQL}
    select payload_id, turn_idx, cast(island as bigint) as island from islands""",
)
def role_islands(spark, folder):
    return T.role_islands(document_turns(spark, folder)).select("payload_id", "turn_idx", "island")


@query(
    "merge_turns",
    f"""with {DOC_TURNS_SQL}, roles as (select * from dt), {ISLANDS_SQL}
    select payload_id, cast(island as bigint) as island, role, count(*) as merged_turns,
    string_agg(text, chr(10) || chr(10) order by turn_idx) as text from islands group by payload_id, island, role""",
)
def merge_turns(spark, folder):
    return T.merge_turns(document_turns(spark, folder))


@query(
    "recent_user_turns",
    """select conv_id as payload_id, turn as turn_idx, text from conversations where role = 'user'
    qualify row_number() over (partition by conv_id order by turn desc) <= 2""",
)
def recent_user_turns(spark, folder):
    return T.recent_user_turns(conversation_turns(spark, folder)).select("payload_id", "turn_idx", "text")


@query(
    "cache_key_parts",
    """with u as (select conv_id, turn, text from conversations where role = 'user'
      qualify row_number() over (partition by conv_id order by turn desc) <= 2),
    ut as (select conv_id, string_agg(text, ' ' order by turn) as user_text from u group by conv_id),
    st as (select conv_id, trim(string_agg(text, ' ' order by turn)) as system_text from conversations where role = 'system' group by conv_id)
    select c.conv_id as payload_id, coalesce(user_text, '') as user_text, coalesce(system_text, '') as system_text
    from (select distinct conv_id from conversations) c left join ut using (conv_id) left join st using (conv_id)""",
)
def cache_key_parts(spark, folder):
    return T.key_parts(conversation_turns(spark, folder))


@query(
    "derive_turn_id",
    f"""with {DOC_TURNS_SQL} select payload_id,
    case when payload_id % 5 = 0 then cast(payload_id as varchar) when payload_id % 5 = 1 then 'turn-x'
      when payload_id % 5 = 2 then '99' else cast(count(*) filter (where role = 'assistant') + 1 as varchar) end as turn_id,
    case when payload_id % 5 = 1 then 'string' else 'int' end as turn_id_type from dt group by payload_id""",
)
def derive_turn_id(spark, folder):
    r = requests(spark, folder, "anthropic")
    i = F.col("payload_id")
    value = F.when(i % 5 == 0, F.concat(F.lit(" "), i.cast("string"))).when(i % 5 == 1, "turn-x").otherwise("")
    headers = F.create_map(F.lit("X-Turn-Id"), value, F.lit("Accept"), F.lit("*/*"))
    payload = F.when(i % 5 != 2, F.col("payload"))
    t = turn_id(headers, payload, F.lit(99))
    return r.select("payload_id", t.alias("t")).select("payload_id", "t.turn_id", "t.turn_id_type")


@query(
    "content_hash",
    """select doc_id, case when length(text) > 100 then sha256(text) end as digest,
    substring(sha256(text), 1, 32) as system_hash, sha256('anthropic:' || text) as prompt_key from documents""",
)
def content_hash(spark, folder):
    d = table(spark, folder, "documents", spread=True)
    return d.select(
        "doc_id",
        X.content_digest(F.col("text")).alias("digest"),
        X.system_digest(F.col("text")).alias("system_hash"),
        X.prompt_key(F.lit("anthropic"), F.col("text")).alias("prompt_key"),
    )


@query(
    "json_length",
    f"""select doc_id, {JSON_LENGTH.format("text")} + length('{{"a": [1, 2], "text": ""}}') as chars from documents""",
)
def json_length(spark, folder):
    d = table(spark, folder, "documents", spread=True)
    text = F.to_json(F.struct(F.array(F.lit(1), F.lit(2)).alias("a"), "text"))
    return d.select("doc_id", V.dumps_length(text).alias("chars"))


# --- key parts of whole requests ------------------------------------------------------------------------


def _parts_sql(role, is_user, system, text="line"):
    return f"""with {TURNS_SQL}, r as (select *, {role} as role from turns),
    u as (select *, row_number() over (partition by payload_id order by turn_idx desc) as k from r where {is_user}),
    t as (select payload_id, string_agg({text}, ' ' order by turn_idx) as user_text from u where k <= 2 group by payload_id)
    select d.payload_id, coalesce(user_text, '') as user_text, {system} as system_text from docs d left join t using (payload_id)"""


def _key_parts(spark, folder, provider):
    r = requests(spark, folder, provider)
    k = C.cache_key_parts(F.col("payload"), provider)
    return r.select("payload_id", k.alias("k")).select("payload_id", "k.user_text", "k.system_text")


@query("cache_key_parts_anthropic", _parts_sql(ROLE_SQL, "role = 'user'", "'Review the text.'"))
def cache_key_parts_anthropic(spark, folder):
    return _key_parts(spark, folder, "anthropic")


@query("cache_key_parts_openai", _parts_sql(OPENAI_ROLE_SQL, "role = 'user'", "trim(d.ls[1])"))
def cache_key_parts_openai(spark, folder):
    return _key_parts(spark, folder, "openai")


@query(
    "cache_key_parts_gemini",
    f"""with {TURNS_SQL},
    u as (select *, row_number() over (partition by payload_id order by turn_idx desc) as k from turns where turn_idx % 2 = 0),
    t as (select payload_id, string_agg(line, ' ' order by turn_idx) as user_text from u where k <= 2 and turn_idx % 4 = 0 group by payload_id)
    select d.payload_id, coalesce(user_text, '') as user_text, '' as system_text from docs d left join t using (payload_id)""",
)
def cache_key_parts_gemini(spark, folder):
    return _key_parts(spark, folder, "gemini")
