"""Documented formulas over recorded figures: savings, costs, trends, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY = "decimal(18,6)"
# Weights of the expected value.
ENTROPY_WEIGHT, LEARNING_WEIGHT = 0.3, 0.5
# Square of the normal quantile of the 95 % interval.
Z = 1.96


def cleaning_ratio(raw: Column, cleaned: Column) -> Column:
    """Percent of characters removed, 0 for an empty request."""
    return F.coalesce(F.try_divide((raw - cleaned) * 100.0, F.nullif(raw, F.lit(0))), F.lit(0.0))


def tokens_avoided(is_hit: Column, prompt: Column, completion: Column) -> Column:
    """Aggregate: tokens that local hits did not send or generate."""
    return F.coalesce(F.sum(F.when(is_hit, prompt + completion)), F.lit(0))


def prompt_cache_savings(read: Column, created: Column, base: Column, read_price: Column, create_price: Column) -> Column:
    """Money saved by provider caching; prices are per million tokens."""
    gain = read * (base.cast(MONEY) - read_price.cast(MONEY))
    extra = created * (create_price.cast(MONEY) - base.cast(MONEY))
    return ((gain - extra) / 1_000_000).cast(MONEY)


def reduction_ratio(before: Column, after: Column) -> Column:
    """Percent saved of the first turn, or of a whole trajectory."""
    return F.coalesce(F.try_divide((before - after) * 100.0, F.nullif(before, F.lit(0))), F.lit(0.0))


def memory_roi(cold: Column, warm: Column, injected: Column) -> Column:
    """Aggregate: tokens saved per token of injected memory."""
    return F.coalesce(F.try_divide(F.sum(cold) - F.sum(warm), F.nullif(F.sum(injected), F.lit(0)).cast("double")), F.lit(0.0))


def tier_costs(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Tokens, share and cost per model tier. ``prices`` has one row per tier and is joined as such."""
    per_tier = usage.groupBy("tier").agg(F.sum("tokens").alias("tokens"))
    whole = per_tier.agg(F.sum("tokens").alias("t")).scalar()
    joined = per_tier.join(prices, "tier")
    return joined.select(
        "tier",
        "tokens",
        F.bround(F.col("tokens") / whole * 100, 2).alias("share_pct"),
        (F.col("tokens") * F.col("price").cast(MONEY) / 1_000_000).cast(MONEY).alias("cost"),
    )


def compression_ratio(raw: Column, summary: Column) -> Column:
    return F.try_divide(raw.cast("double"), F.nullif(summary, F.lit(0)))


def run_stats(value: Column) -> list[Column]:
    """Aggregates: mean and sample deviation over repeated runs; fewer than three runs say nothing."""
    n = F.count(value)
    return [
        n.alias("runs"),
        F.when(n >= 3, F.avg(value)).alias("mean"),
        F.when(n >= 3, F.stddev_samp(value)).alias("stddev"),
    ]


def context_slope(tokens: Column, turn: Column) -> Column:
    """Aggregate: growth of the context in tokens per turn."""
    return F.regr_slope(tokens, turn)


def overhead(sent: Column, stored: Column) -> list[Column]:
    """Bytes saved on the wire, compression factor, and overhead in percent."""
    return [
        (sent - stored).alias("bytes_saved"),
        F.try_divide(sent.cast("double"), F.nullif(stored, F.lit(0))).alias("compression"),
        F.coalesce(F.try_divide(stored * 100.0, F.nullif(sent, F.lit(0))), F.lit(0.0)).alias("overhead_pct"),
    ]


def expected_value(probability: Column, impact: Column, learning: Column, entropy: Column, cost: Column) -> Column:
    return probability * impact + LEARNING_WEIGHT * learning - ENTROPY_WEIGHT * entropy - cost


def calibration_error(forecasts: DataFrame, outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """Distance between forecast and outcome, and which way the forecast leaned."""
    error = F.col("predicted") - F.col("actual")
    bias = F.when(error > 0, "overestimated").when(error < 0, "underestimated").otherwise("calibrated")
    return forecasts.join(outcomes, keys).select(*keys, "predicted", "actual", F.abs(error).alias("error"), bias.alias("bias"))


def evidence_score(successes: Column, trials: Column) -> list[Column]:
    """Posterior mean with a uniform prior, and the lower end of the Wilson interval."""
    p = F.try_divide(successes.cast("double"), F.nullif(trials, F.lit(0)))
    z2 = Z * Z
    spread = Z * F.sqrt((p * (1 - p) + z2 / (4 * trials)) / trials)
    return [
        ((successes + 1) / (trials + 2)).alias("posterior_mean"),
        F.when(trials > 0, (p + z2 / (2 * trials) - spread) / (1 + z2 / trials)).alias("wilson_lower"),
    ]
