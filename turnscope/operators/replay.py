"""Which requests of a log a cache with a time to live would have answered.

A miss that may be cached writes; a hit does not renew the entry. The outcome of a request depends on
all earlier ones of its key, yet two writes of a key are more than the time to live apart. So writes are
found in rounds, each round the next write of every key, as plain aggregates with a map-side part; there
are as many rounds as times to live in the log, however many requests a key has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnscope.operators.ordered import lookup_join
from turnscope.session import work_dir

# Seconds beyond any log: an entry that never expires.
FOREVER = 1e15
STATE_SCHEMA = "key string, last_write double"


def _save(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage by a table in the shared folder."""
    path = work_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def find_writes(requests: DataFrame, ttl_s: float, state: DataFrame | None = None) -> DataFrame:
    """Every write: ``key``, ``written_at`` and the ``ordinal`` of its request.

    ``requests``: ``key, at`` (seconds), ``ordinal`` and ``cacheable``. ``state`` holds the last write of
    keys seen before.
    """
    # Requests of one key at one time are one candidate.
    candidates = requests.filter("cacheable").groupBy("key", "at").agg(F.min("ordinal").alias("ordinal"))
    if state is not None:
        weights = candidates.groupBy("key").agg(F.count(F.lit(1)).alias("_rows"))
        candidates = _later(candidates, state.join(weights, "key"), ttl_s)
    candidates = _save(candidates, "replay-candidates")
    writes = None
    while True:
        first = F.min(F.struct("at", "ordinal")).alias("first")
        found = candidates.groupBy("key").agg(first, F.count(F.lit(1)).alias("_rows"))
        found = _save(
            found.select(
                "key", F.col("first.at").alias("written_at"), F.col("first.ordinal").alias("ordinal"), "_rows"
            ),
            "replay-writes",
        )
        if found.isEmpty():
            return writes if writes is not None else found.drop("_rows")
        writes = found.drop("_rows") if writes is None else writes.unionByName(found.drop("_rows"))
        # Candidates up to the end of the new write are settled; the next round reads what is left.
        known = found.select("key", F.col("written_at").alias("last_write"), "_rows")
        candidates = _save(_later(candidates, known, ttl_s), "replay-candidates")


def _later(candidates: DataFrame, known: DataFrame, ttl_s: float) -> DataFrame:
    """Candidates that the last write of their key does not answer."""
    joined = lookup_join(candidates, known, ["key"], "_rows", ["at"])
    open_ = F.col("last_write").isNull() | (F.col("at") > F.col("last_write") + ttl_s)
    return joined.filter(open_).select("key", "at", "ordinal")


def replay(requests: DataFrame, ttl_s: float, state: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(outcomes, new state)``: every request with ``hit``, and the last write of each key.

    A time to live of 0 or less never expires, as in the store.
    """
    if ttl_s <= 0:
        ttl_s = FOREVER
    writes = find_writes(requests, ttl_s, state)
    past = writes.select("key", F.col("written_at").alias("write_at"), F.col("ordinal").alias("writer"))
    if state is not None:
        past = past.unionByName(
            state.select("key", F.col("last_write").alias("write_at"), F.lit(None).cast("bigint").alias("writer"))
        )
    # Writes are more than one time to live apart, so an interval of that length holds at most one,
    # and the entry that answers a request stands in the interval of the request or the one before.
    slot = lambda c: F.floor(F.col(c) / ttl_s).cast("bigint")
    placed = past.withColumn("slot", slot("write_at"))
    near = placed.unionByName(placed.withColumn("slot", F.col("slot") + 1))
    offers = near.groupBy("key", "slot").agg(F.array_agg(F.struct("write_at", "writer")).alias("offers"))
    asked = requests.withColumn("slot", slot("at"))
    weights = asked.groupBy("key", "slot").agg(F.count(F.lit(1)).alias("_rows"))
    joined = lookup_join(asked, offers.join(weights, ["key", "slot"]), ["key", "slot"], "_rows", ["ordinal"])
    serves = lambda o: (
        (o["write_at"] >= F.col("at") - ttl_s)
        & (
            (o["write_at"] < F.col("at"))
            | ((o["write_at"] == F.col("at")) & (F.coalesce(o["writer"], F.lit(-1)) < F.col("ordinal")))
        )
    )
    hit = F.coalesce(F.exists("offers", serves), F.lit(False))
    outcomes = joined.select(*requests.columns, hit.alias("hit"))
    new_state = past.groupBy("key").agg(F.max("write_at").alias("last_write"))
    return outcomes, new_state
