"""Exact medians of groups of any size, by selection: only the range that holds the middle is looked at again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnscope.session import work_dir

# Ranges a group is cut into in each round, and distinct values that one task may order in the end.
BINS, HELD = 1024, 1 << 16


def _written(df: DataFrame, label: str) -> DataFrame:
    """Written and read again: each round starts from a table, not from the rounds before it."""
    path = work_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _inside(counted: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """The values of the ranges. There is one row for each group, and adaptive execution splits a group that is frequent."""
    return counted.join(ranges, keys).filter(F.col("_v").between(F.col("_low"), F.col("_high")))


def _bin(bins: int) -> Column:
    # Halves, since the width of the range may be no finite number.
    low, high, v = [F.col(c) / 2 for c in ("_low", "_high", "_v")]
    return F.when(high == low, 0).otherwise(F.least(F.floor((v - low) / (high - low) * bins), F.lit(bins - 1))).cast("int")


def exact_medians(rows: DataFrame, keys: list[str], value: str, bins: int = BINS, held: int = HELD) -> DataFrame:
    """``keys``, ``median`` and ``values`` (how many) of each group's finite values; groups without one have no row.

    Equal values of a group are counted first, in part before they are shuffled, so a value that fills the table is one row.
    A group with more than ``held`` distinct values is cut into ``bins`` ranges of equal width, which are
    counted; the range that holds the middle is cut again, until it has few values or one. The last step orders
    at most ``held`` values of a group. NULL keys are a group.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    # Groups are joined on one hash of NULL-safe keys; the keys themselves come along.
    found = rows.select(
        *[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(value).cast("double").alias("_v")
    ).filter(F.abs("_v") < float("inf"))
    group = F.struct(*names).alias("_g") if names else F.struct(F.lit(0).alias("_all")).alias("_g")
    # 0.0 and -0.0 are one value.
    counted = _written(
        found.select(group, (F.col("_v") + F.lit(0.0)).alias("_v")).groupBy("_g", "_v").agg(F.count(F.lit(1)).alias("_n")),
        "median-values",
    )
    counted = counted.withColumn("_key", F.to_json(F.struct("_g"), {"ignoreNullFields": "false"}))
    ranges = counted.groupBy("_key").agg(
        F.first("_g").alias("_g"),
        F.sum("_n").alias("_total"),
        F.min("_v").alias("_low"),
        F.max("_v").alias("_high"),
        F.lit(0).cast("bigint").alias("_below"),
        F.count(F.lit(1)).alias("_distinct"),
    )
    ranges = _written(ranges, "median-ranges")
    values, done = counted.select("_key", "_v", "_n"), None
    first, second = F.expr("(_total - 1) div 2"), F.expr("_total div 2")
    while True:
        wide = ranges.filter(F.col("_distinct") > held)
        if wide.isEmpty():
            break
        cut = (
            _inside(values, wide, ["_key"])
            .withColumn("_bin", _bin(bins))
            .groupBy("_key", "_bin")
            .agg(
                F.sum("_n").alias("_n"), F.min("_v").alias("_from"), F.max("_v").alias("_to"), F.count(F.lit(1)).alias("_distinct"),
                F.first("_below").alias("_below"), F.first("_total").alias("_total"), F.first("_g").alias("_g"),
            )
        )
        # At most ``bins`` rows of a group.
        so_far = F.col("_below") + F.sum("_n").over(Window.partitionBy("_key").orderBy("_bin"))
        placed = cut.withColumn("_after", so_far).withColumn("_before", F.col("_after") - F.col("_n"))
        has = lambda rank: (F.col("_before") <= rank) & (rank < F.col("_after"))
        middle = placed.filter(has(first) | has(second))
        # Middle values in two ranges are the last of one and the first of the other: a range of these two.
        narrowed = middle.groupBy("_key").agg(
            F.first("_g").alias("_g"),
            F.first("_total").alias("_total"),
            F.when(F.count(F.lit(1)) == 2, F.min("_to")).otherwise(F.min("_from")).alias("_low"),
            F.when(F.count(F.lit(1)) == 2, F.max("_from")).otherwise(F.max("_to")).alias("_high"),
            F.min("_before").alias("_before"),
            F.min_by(F.struct("_n", "_distinct"), "_bin").alias("_one"),
            F.count(F.lit(1)).alias("_bins"),
        )
        two = F.col("_bins") == 2
        narrowed = narrowed.select(
            "_key", "_g", "_total", "_low", "_high",
            # In a range of two the last value of the first bin is the first middle value.
            F.when(two, first).otherwise(F.col("_before")).alias("_below"),
            F.when(two, F.lit(2)).otherwise(F.col("_one._distinct")).cast("bigint").alias("_distinct"),
            two.alias("_two"),
        )
        narrowed = _written(narrowed, "median-ranges")
        solved = narrowed.filter("_two").select("_g", ((F.col("_low") + F.col("_high")) / 2).alias("median"), "_total")
        done = solved if done is None else done.unionByName(solved)
        ranges = ranges.filter(F.col("_distinct") <= held).unionByName(narrowed.filter("not _two").drop("_two"))
    # A group's values in the range, at most ``held`` rows.
    so_far = F.col("_below") + F.sum("_n").over(Window.partitionBy("_key").orderBy("_v"))
    placed = _inside(values, ranges, ["_key"]).withColumn("_after", so_far)
    before = F.col("_after") - F.col("_n")
    at = lambda rank: F.max(F.when((before <= rank) & (rank < F.col("_after")), F.col("_v")))
    picked = placed.groupBy("_key").agg(
        F.first("_g").alias("_g"), at(first).alias("_a"), at(second).alias("_b"), F.first("_total").alias("_total")
    )
    picked = picked.select("_g", (F.col("_a") / 2 + F.col("_b") / 2).alias("median"), "_total")
    everything = picked if done is None else picked.unionByName(done)
    return everything.select(
        *[F.col(f"_g.{n}").alias(k) for k, n in zip(keys, names)], "median", F.col("_total").alias("values")
    )
