"""Ordered and keyed steps that stay whole when one key holds much of the table.

A window over ``partitionBy(key)`` sends all rows of a key to one task. The functions here cut each key
into buckets of the integer position, run the window inside a bucket, and carry only one summary row
per bucket across bucket borders.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Positions per bucket: the largest window a task sees, and the reduction from rows to summaries.
WIDTH = 1 << 16
# Buckets whose summaries one task carries on when there is no key.
BLOCK = 1 << 16
# Keys whose rows are dealt to SALTS parts. The rest hold at most 1/(HOT_KEYS + 1) of the rows each.
HOT_KEYS = 256
SALTS = 64


def _bucketed(df: DataFrame, position: str, width: int) -> DataFrame:
    return df.withColumn("_bucket", F.floor(F.col(position) / width).cast("bigint"))


def _totals_before(totals: DataFrame, keys: list[str], order: str, names: list[str], prefix: str) -> DataFrame:
    """Per row of ``totals``: the sums of ``_t_*`` over the rows before it, as ``<prefix>*``."""
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        *totals.columns, *[F.coalesce(F.sum(f"_t_{k}").over(earlier), F.lit(0)).alias(f"{prefix}{k}") for k in names]
    )


def _carry(df: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """Per (key, bucket): the totals of all earlier buckets of the key.

    Without keys all buckets are one sequence; it is carried in two levels, so that a task sees the buckets of
    one block, and the last step one row per block.
    """
    names = list(sums)
    per_bucket = df.groupBy(*keys, "_bucket").agg(*[v.alias(f"_t_{k}") for k, v in sums.items()])
    if keys:
        found = _totals_before(per_bucket, keys, "_bucket", names, "_c_")
        return found.select(*keys, "_bucket", *[f"_c_{k}" for k in names])
    blocked = per_bucket.withColumn("_block", F.floor(F.col("_bucket") / BLOCK).cast("bigint"))
    inside = _totals_before(blocked, ["_block"], "_bucket", names, "_i_")
    per_block = blocked.groupBy("_block").agg(*[F.sum(f"_t_{k}").alias(f"_t_{k}") for k in names])
    before = _totals_before(per_block, [], "_block", names, "_b_").drop(*[f"_t_{k}" for k in names])
    return inside.join(before, "_block").select(
        "_bucket", *[(F.col(f"_i_{k}") + F.col(f"_b_{k}")).alias(f"_c_{k}") for k in names]
    )


def running_sum(
    df: DataFrame, keys: list[str], position: str, sums: dict[str, Column], width: int = WIDTH
) -> DataFrame:
    """Add running totals (``name -> value``) in the order of an integer ``position``, unique per key."""
    parts = _bucketed(df, position, width)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    local = reduce(lambda d, kv: d.withColumn(f"_l_{kv[0]}", F.sum(kv[1]).over(inside)), sums.items(), parts)
    carry = _carry(parts, keys, {k: F.sum(v) for k, v in sums.items()})
    joined = local.join(carry, [*keys, "_bucket"])
    return joined.select(*df.columns, *[(F.col(f"_l_{k}") + F.col(f"_c_{k}")).alias(k) for k in sums])


def dense_index(df: DataFrame, keys: list[str], position: str, out: str, width: int = WIDTH) -> DataFrame:
    """Number the rows of each key 0, 1, 2, … in the order of an integer ``position``."""
    numbered = running_sum(df, keys, position, {out: F.lit(1)}, width)
    return numbered.withColumn(out, (F.col(out) - 1).cast("bigint"))


def hot_keys(per_key: DataFrame, keys: list[str], weight: str, count: int = HOT_KEYS) -> DataFrame:
    """Hashes of the ``count`` heaviest keys (``_hot``): at most ``count`` numbers, so they may be broadcast."""
    heaviest = per_key.orderBy(F.desc(weight), *keys).limit(count)
    return heaviest.select(F.xxhash64(*keys).alias("_hot")).distinct()


def lookup_join(
    left: DataFrame, per_key: DataFrame, keys: list[str], weight: str, spread: list[str], count: int = HOT_KEYS
) -> DataFrame:
    """Left join to a table with one row per key, where some keys may be very frequent on the left.

    The rows of the heaviest keys (by ``weight``) are dealt to ``SALTS`` parts by a hash of the ``spread`` columns,
    and the right row of such a key stands once in each part, so the salt is a key of the shuffle. Only hashes
    of keys are broadcast. Rows with a NULL in a key match nothing and are dealt to the parts too. A key that is not
    among the heaviest but has the same hash is dealt alike on both sides, which changes no result.
    """
    hot = hot_keys(per_key, keys, weight, count)
    values = [c for c in per_key.columns if c not in left.columns]
    part = F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("bigint")
    lost = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    zero = F.lit(0).cast("bigint")
    is_hot = F.col("_hot").isNotNull()
    dealt = left.join(F.broadcast(hot), F.xxhash64(*keys) == F.col("_hot"), "left").select(
        *left.columns, F.when(is_hot | lost, part).otherwise(zero).alias("_salt")
    )
    # SALTS rows for each hot key, so at most count * SALTS pairs of numbers.
    parts = hot.withColumn("_salt", F.explode(F.sequence(zero, F.lit(SALTS - 1).cast("bigint"))))
    offered = per_key.join(F.broadcast(parts), F.xxhash64(*keys) == F.col("_hot"), "left").select(
        *keys, *values, F.coalesce("_salt", zero).alias("_salt")
    )
    return dealt.join(offered, [*keys, "_salt"], "left").select(*left.columns, *values)
