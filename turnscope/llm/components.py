"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnscope.llm.support import released, stored


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of integer nodes -> ``(node, component)``, the smallest node that links reach.

    Alternating large-star and small-star rounds: each round hooks the neighbours of a node on the smallest of
    them, and the number of rounds grows with the logarithm of the longest chain. Every round is two
    aggregates (with a map-side part) and joins that adaptive skew handling can split, and ends in a written
    table, which replaces those of the round before; the driver sees one row of sums. Nodes without an edge are not returned. Self-loops and
    repeated edges do no harm.
    """
    now = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges",
    )
    before = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        # Larger neighbours of a node hook on the smallest node around it.
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = stored(large.where("a <> b").distinct(), "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = (
            large.join(least, "a")
            .select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .where("a <> b")
            .distinct()
        )
        last, now = now, stored(small, "small-star")
        released(last, large)
        after = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if after == before:
            break
        before = after
    # Every node but the roots now has one edge, to its root.
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
