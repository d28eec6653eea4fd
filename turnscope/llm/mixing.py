"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnscope.llm.support import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
# Documents rounded together. A source is dealt into groups of about so many.
GROUP = 2000


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def _numbered(sources: DataFrame) -> DataFrame:
    """Number the sources by code point, null last, without one task for all: ranges, then offsets."""
    sorted_ = stored(
        sources.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
        .withColumn("part", F.spark_partition_id()),
        "mix-sources",
    )
    local = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    sizes = sorted_.groupBy("part").agg(F.count("*").alias("n"))
    # One row per partition goes through the second window.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    return sorted_.withColumn("place", local).join(offsets, "part").select(
        "source", "source_size", (F.col("place") + F.col("offset")).alias("number")
    )


def targets(sources: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``(source, source_size)`` -> with ``target``: ``share`` of all sizes by weight, each at most ``most`` sizes.

    Weights repeat over the sources in code point order, null last. What a source cannot take is shared again by
    weight among the others: one aggregate over the sources per round, until no target is above its bound.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("number", F.lit(len(weights))) + 1).cast("int"))
    table = stored(_numbered(sources).withColumn("weight", weight).drop("number"), "mix-weights")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    rate = None
    while True:
        full = F.lit(False) if rate is None else F.col("weight") * rate >= most * F.col("source_size")
        open_weight, taken = table.agg(
            F.sum(F.when(~full, F.col("weight"))), F.sum(F.when(full, most * F.col("source_size")).otherwise(0.0))
        ).first()
        new = (share * total - (taken or 0)) / open_weight if open_weight else None
        if new is None or (rate is not None and new <= rate):
            break
        rate = new
    bound = most * F.col("source_size")
    target = bound if rate is None else F.least(F.col("weight") * rate, bound)
    return table.withColumn("target", target.cast("double"))


def _rate(slope: Column, size: Column, most: int) -> Column:
    """Expected copies: the base law Binomial(most, 1/most), tilted by exp(slope * size)."""
    odds = F.exp(-F.greatest(F.least(slope * size, F.lit(700.0)), F.lit(-700.0)))
    return most / (1 + (most - 1) * odds)


def balanced(sizes: DataFrame, wanted: DataFrame, most: int = MOST, close: float = 1e-9, rounds: int = 200) -> DataFrame:
    """The slope of every source: ``(source, source_size, target, slope, scale)``.

    Among all rates of 0 to ``most`` copies per document, the ones nearest to one copy of each (in relative entropy
    to the binomial law with that mean) whose words add up to the source's target are ``_rate(slope, size)``. The slope
    minimises the convex dual ``sum(log E[exp(slope * size * copies)]) - slope * target``. All sources take a
    Newton step per round: one aggregate over (source, size) counts gives gradient and curvature, a bracket
    of the root keeps each step safe. Sources at their bound or without words need no slope.
    """
    counts = stored(sizes.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n")), "mix-counts")
    scale = counts.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("scale"))
    edge = F.col("target") >= most * F.col("source_size")
    state = wanted.join(scale, F.equal_null(wanted["source"], scale["source"]), "left").drop(scale["source"]).select(
        "source", "source_size", "target", "scale", edge.alias("full"), F.lit(0.0).alias("slope"),
        F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"),
        (edge | (F.col("source_size") == 0)).alias("done"),
    )
    state = stored(state, "mix-state")
    for _ in range(rounds):
        if not state.where("NOT done").limit(1).count():
            break
        now = state.where("NOT done").select(F.col("source").alias("s"), "slope", "scale")
        x = F.col("size") / F.col("scale")
        rate = _rate(F.col("slope"), x, most)
        sums = counts.join(now, F.equal_null("source", "s")).groupBy("s").agg(
            F.sum(F.col("n") * F.col("size") * rate).alias("got"),
            F.sum(F.col("n") * F.col("size") * x * rate * (1 - rate / most)).alias("curve"),
        )
        joined = state.join(sums, F.equal_null("source", "s"), "left").drop("s")
        over = F.col("got") > F.col("target")
        low = F.when(~over, F.col("slope")).otherwise(F.col("low"))
        high = F.when(over, F.col("slope")).otherwise(F.col("high"))
        step = F.col("slope") - (F.col("got") - F.col("target")) / F.when(F.col("curve") > 0, F.col("curve"))
        joined = joined.withColumn("low", low).withColumn("high", high)
        # Where a step leaves the bracket: its middle, or twice as far out while one side is open.
        safe = F.when(F.col("low").isNull(), 2 * F.col("high") - 1).when(F.col("high").isNull(), 2 * F.col("low") + 1).otherwise((F.col("low") + F.col("high")) / 2)
        inside = (
            step.isNotNull()
            & (step > F.coalesce("low", F.col("high") - 8 - F.abs("high")))
            & (step < F.coalesce("high", F.col("low") + 8 + F.abs("low")))
        )
        reached = F.abs(F.col("got") - F.col("target")) <= close * F.col("target") + 1e-6
        stuck = F.col("high") - F.col("low") <= 1e-15 * F.abs("high")
        moved = joined.withColumn("next", F.when(inside, step).otherwise(safe)).withColumn(
            "ends", F.col("done") | F.coalesce(reached | stuck, F.lit(False))
        )
        state = stored(
            moved.withColumn("slope", F.when(F.col("ends"), F.col("slope")).otherwise(F.col("next")))
            .withColumn("done", F.col("ends")).select(*state.columns),
            "mix-state",
        )
    return state


def _round(most: int):
    """Whole copies of a group's documents, from the longest down: what a rate and the errors so far owe in words, rounded."""

    def rounded(table: pa.Table) -> pa.Table:
        size, rate = table.column("size").to_numpy(), table.column("rate").to_numpy()
        order = np.lexsort((table.column("pick").to_numpy(), -size))
        copies, owed = np.zeros(len(size), np.int64), 0.0
        for i in order.tolist():
            owed += rate[i] * size[i]
            n = int(size[i])
            wanted = owed / n if n else rate[i]
            copies[i] = min(max(math.ceil(wanted - 0.5), 0), most)
            owed -= copies[i] * n
        columns = {c: table.column(c) for c in table.column_names if c not in ("rate", "pick", "source", "group")}
        return pa.table(columns | {"copies": pa.array(copies, pa.int64())})

    return rounded


def mixed_copies(
    docs: DataFrame,
    weights: tuple = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    group: int = GROUP,
    extra: dict[str, Column] | None = None,
) -> DataFrame:
    """How many copies of each document a mix takes so that each source's words come near its target.

    ``docs(doc_id, text, source)`` -> ``(doc_id, size, source_size, target, rate, copies)``, one row per input
    row; ``size`` is the number of words (null text: 0). Null is a source of its own, the last. Rates come
    from entropy balancing (``balanced``). They are rounded in groups of about ``group`` documents of a source,
    dealt by hash, so that a large source is many groups; inside a group, from the longest document down, the words
    owed are carried on. A group's error is about half its smallest document. Documents without words, and
    those of a source without words, are taken at the rate that any slope gives them (one copy). Repeated rows count
    each; equal rows of a group may get different copies. The same input gives the same rows again. ``extra`` bigint
    columns of ``docs`` go along.
    """
    extra = extra or {}
    sizes = stored(
        docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"), "source", words_in(F.col("text")).alias("size"),
            F.xxhash64("doc_id", "text").alias("pick"), *[c.cast("bigint").alias(n) for n, c in extra.items()],
        ),
        "mix-sizes",
    )
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    wanted = targets(sources.select("source", "source_size"), weights, share, most)
    state = balanced(sizes, wanted, most)
    groups = sources.select("source", F.ceil(F.col("docs") / group).alias("groups"))
    state = state.join(groups, F.equal_null(state["source"], groups["source"])).drop(groups["source"])
    state = state.select(F.col("source").alias("s"), "source_size", "target", "slope", "scale", "full", "groups")
    rate = F.when(F.col("full"), F.lit(float(most))).when(F.col("target") <= 0, 0.0)
    rate = rate.otherwise(_rate(F.col("slope"), F.col("size") / F.coalesce("scale", F.lit(1.0)), most))
    rated = sizes.join(state, F.equal_null("source", "s")).select(
        "doc_id", "size", "source_size", "target", "pick", "source", *extra, rate.cast("double").alias("rate"),
        F.pmod(F.xxhash64("pick"), F.col("groups")).alias("group"),
    )
    kept = rated.withColumn("exact", F.col("rate"))
    along = "".join(f"`{n}` bigint, " for n in extra)
    return kept.groupBy("source", "group").applyInArrow(
        _round(most), f"doc_id bigint, size bigint, source_size bigint, target double, {along}exact double, copies bigint"
    ).withColumnRenamed("exact", "rate")
