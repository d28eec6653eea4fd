"""Turn-level steps over tables with one row per turn.

``payload_id``, ``turn_idx`` (0, 1, 2, …), ``role`` and ``text``. No step collects the turns of a
payload: what a turn needs to know about its payload is aggregated first and looked up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnscope.operators.ordered import lookup_join, running_sum

PAYLOAD, TURN = "payload_id", "turn_idx"


def turn_counts(turns: DataFrame) -> DataFrame:
    return turns.groupBy(PAYLOAD).agg(F.count(F.lit(1)).alias("n_turns"), F.max(TURN).alias("last_turn"))


def first_occurrence(turns: DataFrame, minimum: int = 100) -> DataFrame:
    """Add ``content_hash`` and the ``first_turn`` of the payload with the same content."""
    hashed = turns.withColumn(
        "content_hash", F.when(F.length("text") > minimum, F.sha2(F.col("text"), 256))
    )
    seen = (
        hashed.filter(F.col("content_hash").isNotNull())
        .groupBy(PAYLOAD, "content_hash")
        .agg(F.min(TURN).alias("first_turn"), F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1")
    )
    # Contents without a copy have no row on the right; they are their own first occurrence.
    found = lookup_join(hashed, seen, [PAYLOAD, "content_hash"], "copies", [TURN])
    first = F.coalesce("first_turn", F.when(F.col("content_hash").isNotNull(), F.col(TURN)))
    return found.select(*turns.columns, "content_hash", first.alias("first_turn"))


def recent_guard(turns: DataFrame, keep: int = 2) -> DataFrame:
    """Add ``is_older``: the turn is not among the last ``keep`` of its payload."""
    counted = lookup_join(turns, turn_counts(turns), [PAYLOAD], "n_turns", [TURN])
    return counted.select(*turns.columns, (F.col(TURN) < F.col("n_turns") - keep).alias("is_older"))


def dedup_turns(turns: DataFrame, minimum: int = 200) -> DataFrame:
    """Replace long turns whose text an earlier turn of the payload already had."""
    marked = recent_guard(first_occurrence(turns, minimum))
    gone = F.col("is_older") & (F.col("first_turn") < F.col(TURN))
    stone = F.concat(
        F.lit("[Tool output omitted: identical output matches Turn "),
        F.col("first_turn"),
        F.lit(" (turn_"),
        F.col("first_turn"),
        F.lit(")]"),
    )
    omitted = F.coalesce(gone, F.lit(False))
    return marked.select(
        *[c for c in turns.columns if c != "text"],
        F.when(omitted, stone).otherwise(F.col("text")).alias("text"),
        omitted.alias("omitted"),
    )


def suffix_start(turns: DataFrame, keep_recent: int) -> DataFrame:
    """Per payload: the turn the kept suffix starts at (the user turn at or before, else after the border)."""
    sized = lookup_join(turns, turn_counts(turns), [PAYLOAD], "n_turns", [TURN])
    target = F.col("n_turns") - keep_recent
    is_user = F.coalesce(F.col("role") == "user", F.lit(False))
    before = F.max(F.when(is_user & (F.col(TURN) >= 1) & (F.col(TURN) <= target), F.col(TURN)))
    after = F.min(F.when(is_user & (F.col(TURN) > F.greatest(target, F.lit(0))), F.col(TURN)))
    return sized.groupBy(PAYLOAD).agg(
        F.max("n_turns").alias("n_turns"), F.coalesce(before, after).alias("suffix_start")
    )


def summarize_turns(turns: DataFrame, max_turns: int, keep_recent: int) -> DataFrame:
    """Cut the middle of long payloads; the line that replaces it takes the place of turn 1."""
    spans = suffix_start(turns, keep_recent).filter((F.col("n_turns") > max_turns) & (F.col("suffix_start") > 1))
    joined = lookup_join(turns, spans, [PAYLOAD], "n_turns", [TURN])
    kept = joined.filter(
        F.col("suffix_start").isNull() | (F.col(TURN) < 1) | (F.col(TURN) >= F.col("suffix_start"))
    ).select(*turns.columns)
    note = spans.select(
        F.col(PAYLOAD),
        F.lit(1).cast(turns.schema[TURN].dataType).alias(TURN),
        F.lit("assistant").alias("role"),
        F.format_string("[Summary of omitted %d intermediate conversation turns]", F.col("suffix_start") - 1).alias(
            "text"
        ),
    )
    return kept.unionByName(note)


def role_islands(turns: DataFrame) -> DataFrame:
    """Add ``island``: the number of the run of equal roles the turn belongs to, from 0.

    The previous turn is found by position, so that neighbours never need to share a task.
    """
    previous = turns.select(
        PAYLOAD, (F.col(TURN) + 1).alias(TURN), F.col("role").alias("_previous"), F.lit(True).alias("_has")
    )
    joined = turns.join(previous, [PAYLOAD, TURN], "left")
    starts = (F.col("_has").isNotNull() & ~F.col("role").eqNullSafe(F.col("_previous"))).cast("bigint")
    marked = joined.select(*turns.columns, starts.alias("_starts"))
    return running_sum(marked, [PAYLOAD], TURN, {"island": F.col("_starts")}).drop("_starts")


def merge_turns(turns: DataFrame) -> DataFrame:
    """Join each run of equal roles into one message; its size is that of the message itself."""
    return (
        role_islands(turns)
        .groupBy(PAYLOAD, "island", "role")
        .agg(
            F.count(F.lit(1)).alias("merged_turns"),
            F.expr("listagg(text, '\n\n') within group (order by turn_idx)").alias("text"),
        )
    )


def recent_user_turns(turns: DataFrame, count: int = 2) -> DataFrame:
    """The last ``count`` user turns of each payload (0: all of them)."""
    users = turns.filter(F.col("role") == "user")
    if count <= 0:
        return users
    newest = Window.partitionBy(PAYLOAD).orderBy(F.desc(TURN))
    return users.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") <= count).drop("_rank")


def key_parts(turns: DataFrame, count: int = 2) -> DataFrame:
    """Per payload: text of the recent user turns, and the stripped system text."""
    in_order = lambda c: F.expr(f"listagg({c}, ' ') within group (order by turn_idx)")
    users = recent_user_turns(turns, count).groupBy(PAYLOAD).agg(in_order("text").alias("user_text"))
    system = (
        turns.filter(F.col("role") == "system")
        .groupBy(PAYLOAD)
        .agg(F.trim(in_order("text")).alias("system_text"))
    )
    ids = turns.select(PAYLOAD).distinct()
    return (
        ids.join(users, PAYLOAD, "left")
        .join(system, PAYLOAD, "left")
        .select(
            PAYLOAD,
            F.coalesce("user_text", F.lit("")).alias("user_text"),
            F.coalesce("system_text", F.lit("")).alias("system_text"),
        )
    )
