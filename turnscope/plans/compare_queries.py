"""Queries that compare: baseline against optimised, prompts against the store."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnscope.functions import text as X
from turnscope.operators import abtest as A
from turnscope.operators import matching as M
from turnscope.operators.conversation import CleanOptions
from turnscope.plans.conversation_queries import ANTHROPIC_KEYS, DEDUP_SQL
from turnscope.plans.registry import query, table
from turnscope.plans.views import TURNS_SQL, TX_SQL, requests, wire_lines
from turnscope.session import work_dir
from turnscope.sources.tables import (
    BUCKETS,
    add_hits,
    append_memories,
    clear,
    create_store,
    merge_puts,
    read_buckets,
    sweep,
    upsert,
)
from turnscope.sources.traces import read_trace

# --- offline ------------------------------------------------------------------------------------------

EVERYTHING = CleanOptions(max_turns=1_000_000)


def traced(spark, folder):
    """Every document as a logged transaction of its request."""
    r = requests(spark, folder, "anthropic")
    i = F.col("payload_id")
    text = F.concat(
        F.lit("{"), F.when(i % 4 != 3, F.concat(F.lit('"turn_id":'), i, F.lit(","))).otherwise(""), F.lit('"provider":"Anthropic","cache_action":"'),
        F.when(i % 3 == 0, "hit").otherwise("MISS"),
        F.lit('","response":{"usage":{'),
        F.when(i % 2 == 0, F.format_string('"input_tokens":%d', i * 10 + 500)).otherwise(""),
        F.lit('}},"timing":{"ttft_ms":'), F.when(i % 5 == 0, "null").otherwise((i % 90 + 10).cast("string")),
        F.lit('},"raw_request":{"request":'), "json", F.lit("}}"),
    )
    return r.select(i.alias("position"), F.parse_json(text).alias("tx"))


STONE = "length('[Tool output omitted: identical output matches Turn ' || first_turn || ' (' || first_src || ')]')"
OFFLINE_SQL = f"""{TURNS_SQL}, {ANTHROPIC_KEYS}, {DEDUP_SQL},
chars as (
  select payload_id, max(n) as n, cast(16 + sum(length(line)) as bigint) as base_chars,
    cast(16 + sum(case when omitted then {STONE} else length(line) end) as bigint) as new_chars,
    count(*) filter (where omitted) as pruned from marked group by payload_id),
tokens as (select *, case when payload_id % 2 = 0 then payload_id * 10 + 500 else greatest(1, base_chars // 4) end as base_tokens from chars),
card as (
  select *, cast(round_even(base_tokens * least(1.0, greatest(0.0, new_chars / base_chars)), 0) as bigint) as new_tokens,
    2 + case when n >= 2 then 1 else 0 end as injected, payload_id % 3 = 0 as is_hit,
    cast(case when payload_id % 5 <> 0 then payload_id % 90 + 10 end as double) as ttft from tokens)"""


@query(
    "ab_turns_offline",
    f"""with {OFFLINE_SQL}, placed as (select *, row_number() over (order by payload_id) as place from card)
    select payload_id as position, r as round, 'anthropic' as provider, is_hit,
    case when payload_id % 4 <> 3 and payload_id > 0 then cast(payload_id as varchar) else 'r' || r || '-t' || place end as turn_id,
    base_tokens as baseline_input_tokens, new_tokens as optimized_input_tokens, greatest(0, base_tokens - new_tokens) as tokens_reduced,
    round_even(greatest(0, base_tokens - new_tokens) / base_tokens * 100.0, 6) as reduction_pct,
    base_chars as baseline_chars, new_chars as optimized_chars, greatest(0, base_chars - new_chars) as chars_saved,
    pruned as tool_calls_pruned, injected as cache_control_injected, true as semantic_parity, ttft as baseline_ttft_ms
    from placed, (values (1), (2), (3)) as v(r)""",
)
def ab_turns_offline(spark, folder):
    t = A.offline_turns(traced(spark, folder), EVERYTHING, rounds=3)
    return t.drop("optimized_ttft_ms", "baseline_decode_tps", "optimized_decode_tps").withColumn(
        "reduction_pct", F.bround("reduction_pct", 6)
    )


CARD_COLUMNS = """
    {label} as mode, cast({rounds} * count(*) as bigint) as total_turns, {rounds} as rounds,
    cast({rounds} * sum(base_tokens) as bigint) as baseline_input_tokens, cast({rounds} * sum(new_tokens) as bigint) as optimized_input_tokens,
    cast({rounds} * greatest(0, sum(base_tokens) - sum(new_tokens)) as bigint) as tokens_reduced,
    round_even(greatest(0, sum(base_tokens) - sum(new_tokens)) / sum(base_tokens) * 100.0, 2) as token_reduction_pct,
    cast({rounds} * sum(base_chars) as bigint) as baseline_chars, cast({rounds} * sum(new_chars) as bigint) as optimized_chars,
    cast({rounds} * greatest(0, sum(base_chars) - sum(new_chars)) as bigint) as chars_saved,
    round_even(greatest(0, sum(base_chars) - sum(new_chars)) / sum(base_chars) * 100.0, 2) as char_reduction_pct,
    cast({rounds} * sum(pruned) as bigint) as tool_calls_pruned, cast({rounds} * sum(injected) as bigint) as cache_control_injected,
    cast({rounds} * count(*) filter (where is_hit) as bigint) as cache_hits,
    round_even(count(*) filter (where is_hit) * 100.0 / count(*), 2) as cache_hit_rate"""


@query(
    "ab_scorecard_offline",
    f"""with {OFFLINE_SQL} select {CARD_COLUMNS.format(label="'Offline Differential Replay (Trace File)'", rounds=3)},
    round_even(avg(ttft), 2) as baseline_ttft_ms, true as semantic_parity_verified,
    greatest(0, sum(base_tokens) - sum(new_tokens)) / sum(base_tokens) * 100.0 >= 50 as passed_threshold,
    cast(50 as double) as threshold_min_reduction_pct from card""",
)
def ab_scorecard_offline(spark, folder):
    card = A.offline_scorecard(traced(spark, folder), EVERYTHING, rounds=3, fail_under=50)
    return card.drop("optimized_ttft_ms", "ttft_delta_ms", "baseline_decode_tps", "optimized_decode_tps")


@query(
    "rounds_cross",
    """select event_id, r as round, case when event_id % 4 = 0 then 'r' || r || '-t' || (event_id + 1) else cast(event_id as varchar) end as turn_id
    from events, (values (1), (2)) as v(r)""",
)
def rounds_cross(spark, folder):
    e = A.rounds_cross(table(spark, folder, "events").select("event_id"), 2)
    given = F.when(F.col("event_id") % 4 != 0, F.col("event_id").cast("string")).otherwise("")
    return e.select(
        "event_id", "round", A.default_turn_id(given, F.col("round"), F.col("event_id") + 1).alias("turn_id")
    )


@query(
    "semantic_parity",
    """select event_id, event_id % 6 in (0, 3, 5) as parity from events""",
)
def semantic_parity(spark, folder):
    i = F.col("event_id")
    turns = '{"messages":[{"role":"user"},{"role":"assistant"}]}'
    before = F.when(i % 6 < 4, turns).when(i % 6 == 4, '{"contents":[1]}').otherwise('{"prompt":"x"}')
    after = (
        F.when(i % 6 == 0, '{"messages":[{"role":"assistant"}]}')
        .when(i % 6 == 1, '{"messages":[{"role":"user"}]}')
        .when(i % 6 == 2, '{"messages":[]}')
        .when(i % 6 == 3, turns)
        .otherwise("{}")
    )
    return table(spark, folder, "events").select(
        "event_id", A.semantic_parity(F.parse_json(before), F.parse_json(after)).alias("parity")
    )


# --- paired -------------------------------------------------------------------------------------------

PAIRS_SQL = f"""{TX_SQL},
numbered as (select *, row_number() over (partition by mode order by ordinal) - 1 as pair_no from tx),
pairs as (
  select b.pair_no, b.turn_no as b_turn, o.turn_no as o_turn, b.ordinal as b_ord, o.ordinal as o_ord, b.input_tokens as base_tokens, o.input_tokens as new_tokens,
    5 * (b.ordinal % 17) as base_chars, 5 * (o.ordinal % 17) as new_chars, o.tool_outputs_omitted as pruned, o.ordinal % 2 as injected,
    o.cache_action = 'HIT' or o.cache_read > 0 as is_hit, b.ordinal % 50 <> 49 and o.ordinal % 50 <> 49 as parity,
    b.ttft_ms as b_ttft, o.ttft_ms as o_ttft, o.provider,
    case when b.ordinal % 4 = 2 then b.value * 3 when b.ordinal % 4 = 3 then 0.0 end as b_tps,
    case when o.ordinal % 4 = 2 then o.value * 3 when o.ordinal % 4 = 3 then 0.0 end as o_tps
  from numbered b join numbered o on b.pair_no = o.pair_no and b.mode = 'baseline' and o.mode = 'optimized')"""


def _log(spark, folder):
    """The log as a file, read back; some turns have no id."""
    path = work_dir(spark, "log")
    # Files in the order of their names, as a gateway that starts a new one now and then.
    wire_lines(spark, folder).orderBy("ordinal").select("value").write.text(path)
    return read_trace(spark, path)


def _runs(spark, folder):
    t = _log(spark, folder).withColumn("mode", F.try_variant_get("tx", "$.mode", "string"))
    return A.mode_filter(t, "optimized"), A.mode_filter(t, "baseline")


@query("ab_pair", f"with {PAIRS_SQL} select pair_no, base_tokens, new_tokens, b_turn, o_turn from pairs")
def ab_pair(spark, folder):
    tokens = F.try_variant_get("tx", "$.response.usage.input_tokens", "bigint").alias("tokens")
    turn = F.try_variant_get("tx", "$.turn_id", "bigint").alias("turn")
    base, opt = (run.select("ordinal", tokens, turn) for run in _runs(spark, folder))
    return A.pair_by_position(base, opt, "ordinal").select(
        "pair_no",
        F.col("base.tokens").alias("base_tokens"),
        F.col("opt.tokens").alias("new_tokens"),
        F.col("base.turn").alias("b_turn"),
        F.col("opt.turn").alias("o_turn"),
    )


@query(
    "mode_filter",
    f"""with {TX_SQL} select 'kept' as part, count(*) as records from tx where mode <> 'optimized'
    union all select 'fallback', count(*) from tx where mode = 'optimized'""",
)
def mode_filter(spark, folder):
    base, opt = _runs(spark, folder)
    count = lambda df, part: df.agg(F.lit(part).alias("part"), F.count(F.lit(1)).alias("records"))
    # Every row is of the other mode, so the filter keeps them all.
    return count(base, "kept").unionByName(count(A.mode_filter(opt, "optimized"), "fallback"))


@query(
    "ab_turns_paired",
    f"""with {PAIRS_SQL} select r as round, pair_no + 1 as position, provider, is_hit, base_tokens as baseline_input_tokens,
    coalesce(nullif(o_turn, 0)::varchar, nullif(b_turn, 0)::varchar, 'r' || r || '-t' || (pair_no + 1)) as turn_id,
    greatest(0, base_tokens - new_tokens) as tokens_reduced, greatest(0, base_chars - new_chars) as chars_saved,
    coalesce(round_even(greatest(0, base_tokens - new_tokens) / nullif(base_tokens, 0) * 100.0, 6), 0.0) as reduction_pct,
    new_tokens as optimized_input_tokens, base_chars as baseline_chars, new_chars as optimized_chars, pruned as tool_calls_pruned,
    injected as cache_control_injected, parity as semantic_parity, b_ttft as baseline_ttft_ms, o_ttft as optimized_ttft_ms,
    b_tps as baseline_decode_tps, o_tps as optimized_decode_tps from pairs, (values (1), (2)) as v(r)""",
)
def ab_turns_paired(spark, folder):
    base, opt = _runs(spark, folder)
    return A.paired_turns(base, opt, rounds=2).withColumn("reduction_pct", F.bround("reduction_pct", 6))


PAIRED_CARD = f"""with {PAIRS_SQL} select {CARD_COLUMNS.format(label="'Real Intercepted Traffic'", rounds=1)},
    round_even(avg(b_ttft), 2) as baseline_ttft_ms, round_even(avg(o_ttft), 2) as optimized_ttft_ms,
    round_even(avg(b_ttft) - avg(o_ttft), 2) as ttft_delta_ms, round_even(avg(b_tps), 2) as baseline_decode_tps,
    round_even(avg(o_tps), 2) as optimized_decode_tps, bool_and(parity) as semantic_parity_verified, true as passed_threshold from pairs"""


@query("ab_scorecard_paired", PAIRED_CARD)
def ab_scorecard_paired(spark, folder):
    base, opt = _runs(spark, folder)
    return A.paired_scorecard(base, opt, "ordinal").drop("threshold_min_reduction_pct")


@query(
    "ab_gate",
    f"""select token_reduction_pct, passed_threshold, semantic_parity_verified, passed_threshold and semantic_parity_verified as gate_passed
    from ({PAIRED_CARD})""",
)
def ab_gate(spark, folder):
    base, opt = _runs(spark, folder)
    return A.gate(A.paired_scorecard(base, opt, "ordinal"))


@query(
    "paired_parity",
    """select event_id, event_id % 5 in (0, 3, 4) as parity from events""",
)
def paired_parity(spark, folder):
    i = F.col("event_id")
    base = F.when(i % 5 == 1, '{"response":{"status":500}}').otherwise(
        '{"response":{"status":200},"raw_request":{"request":{"messages":[]}}}'
    )
    opt = (
        F.when(i % 5 == 2, '{"response":{},"raw_request":{"prompt":"x"}}')
        .when(i % 5 == 3, '{"response":{"status":null},"cleaned_request":{"messages":[1]}}')
        .when(i % 5 == 4, '{"cleaned_request":{},"raw_request":{"request":{"messages":[1]}}}')
        .otherwise('{"response":{"status":200},"raw_request":{"messages":[]}}')
    )
    return table(spark, folder, "events").select(
        "event_id", A.paired_parity(F.parse_json(base), F.parse_json(opt)).alias("parity")
    )


# --- the prompt store ---------------------------------------------------------------------------------

NOW, TTL = 10_000_000.0, 604_800.0
WORDS_SQL = "list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'))"

# Every document is stored and asked for; every second question has words of its own. The provider is
# the language. The age grows with the id and passes the time to live for every seventh document.
STORE_SQL = f"""
prompts as (
  select doc_id, lang as provider, text, {WORDS_SQL} as words, doc_id % 3 as sys,
    {NOW} - doc_id * 0.001 - case when doc_id % 7 = 0 then 700000 else 0 end as created_at from documents),
asked as (select doc_id, lang as provider, doc_id % 3 as sys, case when doc_id % 2 = 1 then text || ' again please' else text end as text from documents),
probes as (select *, {WORDS_SQL} as words from asked),
latest as (
  select provider, text, sys, max(created_at) as created_at, arg_max(doc_id, created_at) as doc_id from prompts group by provider, text, sys),
store as (select l.*, p.words from latest l join prompts p on p.doc_id = l.doc_id),
fresh as (select * from store where created_at >= {NOW - TTL})"""


def prompts(spark, folder, asked=False):
    """Documents as prompts: as they are stored, or as they are ``asked``."""
    d = table(spark, folder, "documents", spread=True)
    i = F.col("doc_id")
    old = F.when(i % 7 == 0, 700000).otherwise(0)
    text = F.when(F.lit(asked) & (i % 2 == 1), F.concat("text", F.lit(" again please"))).otherwise(F.col("text"))
    shaped = d.select(
        i.alias("probe_id"),
        F.col("lang").alias("provider"),
        text.alias("text"),
        F.concat(F.lit("system "), i % 3).alias("system"),
        F.to_json(F.struct(F.concat(F.lit("system "), i % 3).alias("a"), text.alias("b"))).alias("json"),
        (F.lit(NOW) - i * F.lit(0.001).cast("double") - old).alias("created_at"),
        F.format_string('{"answer":%d}', i).alias("response_json"),
    )
    return M.prompt_entries(shaped, "json", "provider", "text", "system", "probe_id", "created_at", "response_json")


def store(spark, folder):
    p = prompts(spark, folder).drop("probe_id")
    empty = p.limit(0).withColumn("hit_count", F.lit(0).cast("bigint"))
    return upsert(empty, p)


@query(
    "store_upsert",
    f"""with {STORE_SQL},
    rows as (
      select provider, sys, text, created_at, doc_id, case when doc_id % 4 = 0 then 0 else 1 end as is_new from prompts)
    select sha256(provider || ':' || sys || text) as id, case when min(is_new) = 0 then 5 else 0 end as hit_count,
      count(*) as puts, round_even(arg_max(created_at, row(is_new, created_at)), 3) as created_at,
      '{{"answer":' || arg_max(doc_id, row(is_new, created_at)) || '}}' as response_json
    from rows group by provider, sys, text""",
)
def store_upsert(spark, folder):
    p = prompts(spark, folder)
    # Every fourth document is in the store already (one row per key), the others are the puts.
    old = p.filter("probe_id % 4 = 0").drop("probe_id")
    base = upsert(old.limit(0).withColumn("hit_count", F.lit(0).cast("bigint")), old).withColumn(
        "hit_count", F.lit(5).cast("bigint")
    )
    merged = upsert(base, p.filter("probe_id % 4 <> 0").drop("probe_id"))
    counts = p.groupBy("key").agg(F.count(F.lit(1)).alias("puts"))
    parts = F.regexp_extract("prompt_normalized", '(?s)^\\{"a":"system (\\d)","b":', 1)
    text = F.try_variant_get(F.parse_json("prompt_normalized"), "$.b", "string")
    return merged.join(counts, "key").select(
        F.sha2(F.concat("provider", F.lit(":"), parts, text), 256).alias("id"),
        "hit_count",
        "puts",
        F.bround("created_at", 3).alias("created_at"),
        "response_json",
    )


@query(
    "store_merge",
    f"""with {STORE_SQL},
    rows as (
      select provider, sys, text, created_at, doc_id, case when doc_id % 50 = 1 then 1 else 0 end as is_new from prompts)
    select sha256(provider || ':' || sys || text) as id, case when min(is_new) = 0 then 5 else 0 end as hit_count,
      round_even(arg_max(created_at, row(is_new, created_at)), 3) as created_at,
      '{{"answer":' || arg_max(doc_id, row(is_new, created_at)) || '}}' as response_json
    from rows group by provider, sys, text having arg_max(created_at, row(is_new, created_at)) >= {NOW - TTL}""",
)
def store_merge(spark, folder):
    """A bucketed store after some puts and a sweep; only the buckets these touch are written again."""
    path = work_dir(spark, "buckets")
    p = prompts(spark, folder)
    none = p.limit(0).drop("probe_id").withColumn("hit_count", F.lit(0).cast("bigint"))
    old = upsert(none, p.filter("probe_id % 50 <> 1").drop("probe_id"), BUCKETS).withColumn("hit_count", F.lit(5).cast("bigint"))
    create_store(old, path)
    merge_puts(spark, path, p.filter("probe_id % 50 = 1").drop("probe_id"))
    sweep(spark, path, NOW - TTL)
    parts = F.regexp_extract("prompt_normalized", '(?s)^\\{"a":"system (\\d)","b":', 1)
    text = F.try_variant_get(F.parse_json("prompt_normalized"), "$.b", "string")
    return read_buckets(spark, path).select(
        F.sha2(F.concat("provider", F.lit(":"), parts, text), 256).alias("id"),
        "hit_count",
        F.bround("created_at", 3).alias("created_at"),
        "response_json",
    )


@query(
    "store_scan",
    f"""with {STORE_SQL} select provider, count(*) as entries, cast(sum(len(words)) as bigint) as words from store group by provider""",
)
def store_scan(spark, folder):
    from turnscope.sources.tables import read_store, write_table

    path = work_dir(spark, "store")
    write_table(store(spark, folder), path, partition_by="provider")
    back = read_store(spark, path)
    return back.groupBy("provider").agg(
        F.count(F.lit(1)).alias("entries"), F.sum(F.size("user_tokens").cast("bigint")).alias("words")
    )


@query("store_clear", f"with {STORE_SQL} select provider, created_at from store limit 0")
def store_clear(spark, folder):
    return clear(store(spark, folder)).select("provider", "created_at")


@query(
    "ttl_prune",
    f"with {STORE_SQL} select provider, count(*) as entries from fresh group by provider",
)
def ttl_prune(spark, folder):
    return M.prune(store(spark, folder), NOW, TTL).groupBy("provider").agg(F.count(F.lit(1)).alias("entries"))


@query(
    "cache_exact",
    f"""with {STORE_SQL} select p.doc_id as probe_id, '{{"answer":' || f.doc_id || '}}' as response
    from probes p left join fresh f on f.provider = p.provider and f.text = p.text and f.sys = p.sys""",
)
def cache_exact(spark, folder):
    found = M.exact_matches(prompts(spark, folder, asked=True), store(spark, folder), NOW, TTL)
    return found.select("probe_id", F.col("exact_response").alias("response"))


SIMILAR_SQL = f"""{STORE_SQL},
candidates as (select * from fresh qualify row_number() over (partition by provider order by created_at desc) <= $limit),
pairs as (
  select p.doc_id as probe_id, c.doc_id, c.created_at, len(list_intersect(p.words, c.words)) as common, len(p.words) as a, len(c.words) as b
  from probes p join candidates c on c.provider = p.provider and c.sys = p.sys
  where len(p.words) > 0 and least(len(p.words), len(c.words)) >= 0.85 * greatest(len(p.words), len(c.words))),
hits as (
  select probe_id, doc_id, common / (a + b - common) as similarity from pairs
  where common / (a + b - common) >= 0.85 qualify row_number() over (partition by probe_id order by created_at desc) = 1)"""


@query(
    "cache_semantic",
    f"""with {SIMILAR_SQL.replace('$limit', '100')} select p.doc_id as probe_id, '{{"answer":' || h.doc_id || '}}' as response, round_even(similarity, 6) as similarity
    from probes p left join hits h on h.probe_id = p.doc_id""",
)
def cache_semantic(spark, folder):
    found = M.similar_matches(prompts(spark, folder, asked=True), store(spark, folder), NOW, TTL)
    return found.select(
        "probe_id", F.col("similar_response").alias("response"), F.bround("similarity", 6).alias("similarity")
    )


@query(
    "cache_semantic_unbounded",
    f"""with {SIMILAR_SQL.replace('$limit', '1000000000')} select p.doc_id as probe_id, '{{"answer":' || h.doc_id || '}}' as response,
    round_even(similarity, 6) as similarity from probes p left join hits h on h.probe_id = p.doc_id""",
)
def cache_semantic_unbounded(spark, folder):
    found = M.similar_matches_unbounded(prompts(spark, folder, asked=True), store(spark, folder), NOW, TTL)
    return found.select(
        "probe_id", F.col("similar_response").alias("response"), F.bround("similarity", 6).alias("similarity")
    )


LOOKUP_SQL = f"""{SIMILAR_SQL.replace('$limit', '100')},
answers as (
  select p.doc_id as probe_id, case when f.doc_id is not null then 'EXACT' when h.doc_id is not null then 'SEMANTIC' else 'MISS' end as hit_type,
    coalesce(f.doc_id, h.doc_id) as answer
  from probes p left join fresh f on f.provider = p.provider and f.text = p.text and f.sys = p.sys left join hits h on h.probe_id = p.doc_id)"""


@query(
    "cache_lookup",
    f"""with {LOOKUP_SQL} select probe_id, hit_type, '{{"answer":' || answer || '}}' as answer_json from answers""",
)
def cache_lookup(spark, folder):
    found = M.cache_lookup(prompts(spark, folder, asked=True), store(spark, folder), NOW, TTL)
    return found.select("probe_id", "hit_type", "answer_json")


@query(
    "cache_hit_counts",
    f"""with {LOOKUP_SQL} select s.doc_id as entry, count(a.answer) as hit_count from store s left join answers a on a.answer = s.doc_id group by s.doc_id""",
)
def cache_hit_counts(spark, folder):
    entries = store(spark, folder)
    found = M.cache_lookup(prompts(spark, folder, asked=True), entries, NOW, TTL)
    counted = add_hits(entries, M.count_hits(found))
    entry = F.try_variant_get(F.parse_json("response_json"), "$.answer", "bigint")
    return counted.select(entry.alias("entry"), "hit_count")


@query(
    "newest_k_candidates",
    f"""with {STORE_SQL} select provider, doc_id from fresh qualify row_number() over (partition by provider order by created_at desc) <= 20""",
)
def newest_k_candidates(spark, folder):
    found = M.newest_candidates(M.prune(store(spark, folder), NOW, TTL), 20)
    return found.select("provider", F.try_variant_get(F.parse_json("response_json"), "$.answer", "bigint").alias("doc_id"))


@query(
    "jaccard",
    f"""with w as (select conv_id, turn, {WORDS_SQL} as words from conversations)
    select a.conv_id, a.turn, round_even(len(list_intersect(a.words, b.words)) /
      (len(a.words) + len(b.words) - len(list_intersect(a.words, b.words))), 6) as similarity
    from w a join w b on b.conv_id = a.conv_id and b.turn = a.turn + 1""",
)
def jaccard(spark, folder):
    w = table(spark, folder, "conversations").select("conv_id", "turn", X.words(F.col("text")).alias("words"))
    after = w.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("words").alias("next"))
    return w.join(after, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.bround(X.jaccard(F.col("words"), F.col("next")), 6).alias("similarity")
    )


# --- memories -----------------------------------------------------------------------------------------


def memories(spark, folder):
    o = table(spark, folder, "orders")
    return o.select(
        (F.col("o_orderkey") + 1).alias("id"),
        F.concat(F.lit("Topic "), "o_orderpriority").alias("topic"),
        F.when(F.col("o_orderstatus") == "O", "lesson_learned").otherwise("architecture_rule").alias("category"),
        F.concat(F.lit("order of "), "o_custkey").alias("content"),
        F.lit("{}").alias("metadata_json"),
        F.unix_timestamp("o_orderdate").cast("double").alias("created_at"),
    )


MEMORIES_SQL = """
memories as (
  select o_orderkey + 1 as id, 'Topic ' || o_orderpriority as topic,
    case when o_orderstatus = 'O' then 'lesson_learned' else 'architecture_rule' end as category,
    'order of ' || o_custkey as content, cast(epoch(o_orderdate) as double) as created_at from orders)"""


@query(
    "memory_append",
    f"""with {MEMORIES_SQL} select (select max(id) from memories) + event_id + 1 as id, 'event ' || event_type as topic,
    'lesson_learned' as category, props as content, '{{}}' as metadata_json, cast(1234.5 as double) as created_at from events""",
)
def memory_append(spark, folder):
    e = table(spark, folder, "events").select(
        "event_id", F.concat(F.lit("event "), "event_type").alias("topic"), F.col("props").alias("content")
    )
    return append_memories(memories(spark, folder), e, "event_id", F.lit(1234.5))


@query(
    "mem_filter",
    f"with {MEMORIES_SQL} select category, count(*) as memories from memories where topic ilike '%urgent%' group by category",
)
def mem_filter(spark, folder):
    from turnscope.operators.retrieval import memory_filter

    return memory_filter(memories(spark, folder), "URGENT").groupBy("category").agg(F.count(F.lit(1)).alias("memories"))


@query(
    "memory_recent",
    f"""with {MEMORIES_SQL} select id, topic, category, content, created_at from memories where topic ilike '%high%' and category = 'lesson_learned'
    order by created_at desc, id desc limit 10""",
)
def memory_recent(spark, folder):
    from turnscope.operators.retrieval import recent_memories

    return recent_memories(memories(spark, folder), "high", "lesson_learned").drop("metadata_json")


@query(
    "memory_context",
    f"""with {MEMORIES_SQL}, top as (select * from memories where topic ilike '%low%' order by created_at desc, id desc limit 5)
    select '### Memories' || chr(10) || chr(10) || string_agg('- **[' || upper(category) || '] (' || topic || ')**: ' || content, chr(10)
      order by created_at desc, id desc) as context from top""",
)
def memory_context(spark, folder):
    from turnscope.operators.retrieval import memory_context as render

    return render(memories(spark, folder), "Memories", "low")
