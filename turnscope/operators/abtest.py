"""Baseline against optimised: per-turn comparison, scorecard and gate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnscope.functions import numbers as N
from turnscope.functions import variants as V
from turnscope.operators.conversation import CleanOptions, clean_payload, with_chars
from turnscope.operators.ordered import WIDTH, dense_index


def request_payload(raw: Column) -> Column:
    """The request object: below ``request`` when it is wrapped; NULL when empty or not an object."""
    inner = F.when(V.has(raw, "$.request"), V.at(raw, "$.request")).otherwise(raw)
    return F.when(F.size(V.fields(inner)) > 0, inner)


def semantic_parity(original: Column, optimized: Column) -> Column:
    """Turns are still there, and the last one still has the same role."""
    before, after = V.at(original, "$.messages"), V.at(optimized, "$.messages")
    both = V.is_array(before) & V.is_array(after)
    last_before = F.try_element_at(V.items(before), F.lit(-1))
    last_after = F.try_element_at(V.items(after), F.lit(-1))
    same_role = V.text_of(last_before, "$.role").eqNullSafe(V.text_of(last_after, "$.role"))
    objects = V.is_object(last_before) & V.is_object(last_after)
    chat = (
        after.isNotNull()
        & (V.truthy(before) == V.truthy(after))
        & ~F.coalesce(both & V.truthy(before) & objects & ~same_role, F.lit(False))
    )
    return F.when(before.isNotNull(), F.coalesce(chat, F.lit(False))).otherwise(
        ~V.has(original, "$.contents") | V.has(optimized, "$.contents")
    )


def paired_parity(base: Column, optimized: Column) -> Column:
    """Both succeeded, and the optimised request still has the turns the baseline had."""
    ok = lambda t: F.coalesce(V.text_of(t, "$.response.status") == "200", F.lit(True))
    before, after = _inner(V.at(base, "$.raw_request")), _inner(_sent(optimized))
    kept = lambda k: ~V.has(before, k) | V.has(after, k)
    comparable = V.is_object(before) & V.is_object(after)
    return ok(base) & ok(optimized) & (~comparable | (kept("$.messages") & kept("$.contents")))


def _inner(raw: Column) -> Column:
    return F.when(V.has(raw, "$.request"), V.at(raw, "$.request")).otherwise(raw)


def _sent(tx: Column) -> Column:
    """The request as sent: the cleaned one, or the raw one when no cleaned one was logged."""
    cleaned = V.at(tx, "$.cleaned_request")
    return F.when(V.truthy(cleaned), cleaned).otherwise(V.at(tx, "$.raw_request"))


def _reported_tokens(tx: Column, chars: Column) -> Column:
    usage = V.at(tx, "$.response.usage")
    first = F.nullif(V.whole_or_null(usage, "$.input_tokens"), F.lit(0))
    reported = F.coalesce(first, V.whole_at(usage, "$.prompt_tokens"))
    has = V.has(usage, "$.input_tokens") | V.has(usage, "$.prompt_tokens")
    return F.when(has, reported).otherwise(N.tokens_from_chars(chars, floor_at_one=True))


def mode_filter(transactions: DataFrame, other: str, mode: str = "mode") -> DataFrame:
    """Drop the rows of the other mode; when that leaves nothing, keep everything."""
    keep = F.col(mode).isNull() | (F.col(mode) != other)
    flag = transactions.agg(F.coalesce(F.bool_or(keep), F.lit(False)).alias("any_kept"))
    return transactions.filter(keep | ~flag.scalar())


def rounds_cross(df: DataFrame, rounds: int) -> DataFrame:
    """Repeat every row once per round (1 … ``rounds``)."""
    return df.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))


def default_turn_id(turn_id: Column, round_no: Column, position: Column) -> Column:
    """The logged id, unless it is absent, empty or 0: then ``r<round>-t<position>``."""
    usable = ~F.coalesce(turn_id.isin("", "0"), F.lit(False))
    return F.coalesce(F.when(usable, turn_id), F.format_string("r%d-t%d", round_no, position))


def _named_rounds(turns: DataFrame, rounds: int) -> DataFrame:
    """One row per turn and round, ids filled in; ``_no`` is the place of the turn, from 0."""
    filled = default_turn_id(F.col("turn_id"), F.col("round"), F.col("_no") + 1)
    return rounds_cross(turns, rounds).withColumn("turn_id", filled).drop("_no")


# --- offline: clean a recorded trace again --------------------------------------------------------------


def offline_turns(
    transactions: DataFrame,
    options: CleanOptions = CleanOptions(),
    tx: str = "tx",
    position: str = "position",
    cleaner: Callable[[DataFrame, str, str], DataFrame] | None = None,
    rounds: int = 1,
) -> DataFrame:
    """One row per round and transaction with a request: tokens and characters before and after cleaning.

    ``cleaner`` replaces the built-in one: it gets the frame, the payload column and the provider column,
    and adds the struct ``clean`` that ``clean_payload`` adds. ``position`` is an integer in the order of the log; a
    turn without an id is named after its round and its place among all transactions.
    """
    metrics = _offline_metrics(transactions, options, tx, position, cleaner)
    places = dense_index(transactions.select(position), [], position, "_no").withColumnRenamed(position, "position")
    return _named_rounds(metrics.join(places, "position"), rounds)


def _offline_metrics(
    transactions: DataFrame,
    options: CleanOptions,
    tx: str,
    position: str,
    cleaner: Callable[[DataFrame, str, str], DataFrame] | None = None,
) -> DataFrame:
    """``offline_turns`` of one round with the ids as logged: a projection, without a shuffle."""
    t = F.col(tx)
    action = F.coalesce(
        F.nullif(V.text_of(t, "$.cache_action"), F.lit("")), V.text_of(t, "$.cache_status"), F.lit("")
    )
    requests = transactions.withColumn("_payload", request_payload(V.at(t, "$.raw_request"))).filter(
        F.col("_payload").isNotNull()
    )
    named = requests.select(
        F.col(position).alias("position"),
        t.alias("_tx"),
        "_payload",
        V.text_of(t, "$.turn_id").alias("turn_id"),
        F.lower(F.coalesce(F.nullif(V.text_of(t, "$.provider"), F.lit("")), F.lit("anthropic"))).alias("provider"),
        (F.upper(action) == "HIT").alias("is_hit"),
        V.number_at(t, "$.timing.ttft_ms").alias("baseline_ttft_ms"),
    )
    cleaned = cleaner(named, "_payload", "provider") if cleaner else clean_payload(named, "_payload", "provider", options)
    cleaned = cleaned.withColumn("_base_json", F.to_json("_payload")).withColumn("_new_json", F.col("clean.cleaned"))
    cleaned = cleaned.withColumn("_new", V.parse(F.col("_new_json")))
    counted = with_chars(cleaned, "_payload", "_base_json", "baseline_chars")
    counted = with_chars(counted, "_new", "_new_json", "optimized_chars")
    counted = counted.withColumn("baseline_input_tokens", _reported_tokens(F.col("_tx"), F.col("baseline_chars")))
    c = F.col
    new_tokens = N.optimized_tokens(c("baseline_input_tokens"), c("baseline_chars"), c("optimized_chars"))
    zero = F.lit(0).cast("bigint")
    return counted.withColumn("optimized_input_tokens", new_tokens).select(
        "position",
        "turn_id",
        "provider",
        "is_hit",
        "baseline_input_tokens",
        "optimized_input_tokens",
        F.greatest(zero, c("baseline_input_tokens") - c("optimized_input_tokens")).alias("tokens_reduced"),
        N.reduction_pct(c("baseline_input_tokens"), c("optimized_input_tokens")).alias("reduction_pct"),
        "baseline_chars",
        "optimized_chars",
        F.greatest(zero, c("baseline_chars") - c("optimized_chars")).alias("chars_saved"),
        c("clean.tool_outputs_omitted").alias("tool_calls_pruned"),
        c("clean.cache_control_injected").alias("cache_control_injected"),
        semantic_parity(c("_payload"), c("_new")).alias("semantic_parity"),
        "baseline_ttft_ms",
        F.lit(None).cast("double").alias("optimized_ttft_ms"),
        F.lit(None).cast("double").alias("baseline_decode_tps"),
        F.lit(None).cast("double").alias("optimized_decode_tps"),
    )


# --- paired: two recorded runs --------------------------------------------------------------------------


def _side(run: DataFrame, position: str, tx: str, sent: bool) -> DataFrame:
    """The few fields of a run that the comparison needs; whole transactions go no further."""
    t = F.col(tx)
    request = _sent(t) if sent else V.at(t, "$.raw_request")
    raw = run.select(
        F.col(position).alias("position"), t.alias("_tx"), request.alias("_request"), F.to_json(request).alias("_json")
    )
    counted = with_chars(raw, "_request", "_json", "chars")
    t, inner = F.col("_tx"), _inner(F.col("_request"))
    usage = V.at(t, "$.response.usage")
    text = lambda path: F.nullif(V.text_of(t, path), F.lit(""))
    return counted.select(
        "position",
        F.nullif(text("$.turn_id"), F.lit("0")).alias("turn_id"),
        text("$.provider").alias("provider"),
        "chars",
        _reported_tokens(t, F.col("chars")).alias("tokens"),
        (
            (F.upper(F.coalesce(V.text_of(t, "$.cache_action"), F.lit(""))) == "HIT")
            | (V.whole_at(usage, "$.cache_read_input_tokens") > 0)
        ).alias("is_hit"),
        F.coalesce(
            F.nullif(V.whole_or_null(t, "$.delta.tool_outputs_omitted"), F.lit(0)),
            V.whole_at(t, "$.delta.tool_calls_pruned"),
        ).alias("pruned"),
        V.whole_at(t, "$.delta.cache_control_injected").alias("injected"),
        F.coalesce(V.text_of(t, "$.response.status") == "200", F.lit(True)).alias("ok"),
        V.is_object(inner).alias("is_object"),
        V.has(inner, "$.messages").alias("messages"),
        V.has(inner, "$.contents").alias("contents"),
        V.number_at(t, "$.timing.ttft_ms").alias("ttft_ms"),
        V.number_at(t, "$.timing.decode_tps").alias("decode_tps"),
    )


def pair_by_position(baseline: DataFrame, optimized: DataFrame, position: str, width: int = WIDTH) -> DataFrame:
    """The i-th baseline row with the i-th optimised row, as ``pair_no``, ``base`` and ``opt``; a tail is lost.

    Rows are numbered and joined as they are given: pass narrow ones.
    """

    def numbered(run: DataFrame, name: str) -> DataFrame:
        rows = run.select(position, F.struct(*run.columns).alias(name))
        return dense_index(rows, [], position, "pair_no", width).drop(position)

    return numbered(baseline, "base").join(numbered(optimized, "opt"), "pair_no")


def paired_turns(
    baseline: DataFrame, optimized: DataFrame, position: str = "ordinal", tx: str = "tx", rounds: int = 1
) -> DataFrame:
    """Compare what two runs recorded, turn by turn in the order of the integer ``position``; one row per round."""
    return _named_rounds(_paired_metrics(baseline, optimized, position, tx), rounds)


def _paired_metrics(baseline: DataFrame, optimized: DataFrame, position: str, tx: str) -> DataFrame:
    pairs = pair_by_position(_side(baseline, position, tx, False), _side(optimized, position, tx, True), "position")
    b, o, c = (lambda n: F.col(f"base.{n}")), (lambda n: F.col(f"opt.{n}")), F.col
    zero = F.lit(0).cast("bigint")
    kept = lambda n: ~b(n) | o(n)
    comparable = F.coalesce(b("is_object") & o("is_object"), F.lit(False))
    less = lambda n: F.greatest(zero, b(n) - o(n))
    return pairs.select(
        c("pair_no").alias("_no"),
        (c("pair_no") + 1).alias("position"),
        F.coalesce(o("turn_id"), b("turn_id")).alias("turn_id"),
        F.lower(F.coalesce(o("provider"), b("provider"), F.lit("anthropic"))).alias("provider"),
        o("is_hit").alias("is_hit"),
        b("tokens").alias("baseline_input_tokens"),
        o("tokens").alias("optimized_input_tokens"),
        less("tokens").alias("tokens_reduced"),
        N.reduction_pct(b("tokens"), o("tokens")).alias("reduction_pct"),
        b("chars").alias("baseline_chars"),
        o("chars").alias("optimized_chars"),
        less("chars").alias("chars_saved"),
        o("pruned").alias("tool_calls_pruned"),
        o("injected").alias("cache_control_injected"),
        (b("ok") & o("ok") & (~comparable | (kept("messages") & kept("contents")))).alias("semantic_parity"),
        b("ttft_ms").alias("baseline_ttft_ms"),
        o("ttft_ms").alias("optimized_ttft_ms"),
        b("decode_tps").alias("baseline_decode_tps"),
        o("decode_tps").alias("optimized_decode_tps"),
    )


# --- scorecard ------------------------------------------------------------------------------------------


def scorecard(turns: DataFrame, rounds: int = 1, fail_under: float | None = None, label: str = "") -> DataFrame:
    """Reduce compared turns to one row. Rounds repeat the same turns, so their sums are multiples."""
    c = F.col
    times = F.lit(rounds).cast("bigint")
    add = lambda n: (F.coalesce(F.sum(n), F.lit(0)) * times).cast("bigint").alias(n)
    sums = turns.agg(
        (F.count(F.lit(1)) * times).alias("total_turns"),
        *[
            add(n)
            for n in (
                "baseline_input_tokens",
                "optimized_input_tokens",
                "baseline_chars",
                "optimized_chars",
                "tool_calls_pruned",
                "cache_control_injected",
            )
        ],
        (F.coalesce(F.sum(c("is_hit").cast("bigint")), F.lit(0)) * times).alias("cache_hits"),
        F.coalesce(F.every("semantic_parity"), F.lit(True)).alias("semantic_parity_verified"),
        *[
            F.avg(n).alias(n)
            for n in ("baseline_ttft_ms", "optimized_ttft_ms", "baseline_decode_tps", "optimized_decode_tps")
        ],
    )
    pct = N.reduction_pct(c("baseline_input_tokens"), c("optimized_input_tokens"))
    passed = F.lit(True) if fail_under is None else pct >= F.lit(float(fail_under))
    two = lambda v: F.bround(v, 2)
    zero = F.lit(0).cast("bigint")
    return sums.select(
        F.lit(label).alias("mode"),
        "total_turns",
        F.lit(rounds).alias("rounds"),
        "baseline_input_tokens",
        "optimized_input_tokens",
        F.greatest(zero, c("baseline_input_tokens") - c("optimized_input_tokens")).alias("tokens_reduced"),
        two(pct).alias("token_reduction_pct"),
        "baseline_chars",
        "optimized_chars",
        F.greatest(zero, c("baseline_chars") - c("optimized_chars")).alias("chars_saved"),
        two(N.reduction_pct(c("baseline_chars"), c("optimized_chars"))).alias("char_reduction_pct"),
        "tool_calls_pruned",
        "cache_control_injected",
        "cache_hits",
        two(N.ratio_or_zero(c("cache_hits") * 100.0, c("total_turns"))).alias("cache_hit_rate"),
        two(c("baseline_ttft_ms")).alias("baseline_ttft_ms"),
        two(c("optimized_ttft_ms")).alias("optimized_ttft_ms"),
        two(c("baseline_ttft_ms") - c("optimized_ttft_ms")).alias("ttft_delta_ms"),
        two(c("baseline_decode_tps")).alias("baseline_decode_tps"),
        two(c("optimized_decode_tps")).alias("optimized_decode_tps"),
        "semantic_parity_verified",
        passed.alias("passed_threshold"),
        F.lit(fail_under).cast("double").alias("threshold_min_reduction_pct"),
    )


def offline_scorecard(
    transactions: DataFrame,
    options: CleanOptions = CleanOptions(),
    rounds: int = 1,
    fail_under: float | None = None,
    position: str = "position",
) -> DataFrame:
    turns = _offline_metrics(transactions, options, "tx", position)
    return scorecard(turns, rounds, fail_under, "Offline Differential Replay (Trace File)")


def paired_scorecard(
    baseline: DataFrame, optimized: DataFrame, position: str, rounds: int = 1, fail_under: float | None = None
) -> DataFrame:
    """Score two recorded runs; a run without any turn is an error."""
    one = lambda run: run.limit(1).select(F.lit(1))
    if one(baseline).unionByName(one(optimized)).count() < 2:
        raise ValueError("both runs need at least one turn")
    turns = _paired_metrics(baseline, optimized, position, "tx")
    return scorecard(turns, rounds, fail_under, "Real Intercepted Traffic")


def gate(card: DataFrame) -> DataFrame:
    """Whether a scorecard passes: reduction reached and parity kept."""
    return card.select(
        "token_reduction_pct",
        "passed_threshold",
        "semantic_parity_verified",
        (F.col("passed_threshold") & F.col("semantic_parity_verified")).alias("gate_passed"),
    )
