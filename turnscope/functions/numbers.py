"""Rates, counters and timings as Column expressions.

NULL always means "not measured"; it is never replaced by zero before an average.
"""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnscope.fixed import CHARS_PER_TOKEN, MIN_STREAM_WINDOW_S, UNMEASURED


LARGEST = sys.float_info.max


def finite_positive(value: Column) -> Column:
    """The number as DOUBLE when it is finite and above zero, else NULL."""
    number = value.try_cast("double")
    # NaN sorts above every number, so one upper bound rules out NaN and infinity.
    return F.when((number > 0) & (number <= LARGEST), number)


def whole(value: Column) -> Column:
    """A counter: unusable becomes 0."""
    return F.coalesce(value.try_cast("bigint"), F.lit(0).cast("bigint"))


def counter(value: Column) -> Column:
    """A counter that is never negative."""
    return F.greatest(whole(value), F.lit(0).cast("bigint"))


def prefill_rate(input_tokens: Column, ttft_s: Column) -> Column:
    tokens, ttft = counter(input_tokens), finite_positive(ttft_s)
    return F.when((tokens > 0) & ttft.isNotNull(), tokens / ttft)


def tail_prefill_rate(input_tokens: Column, cache_read: Column, ttft_s: Column) -> Column:
    return prefill_rate(F.greatest(F.lit(0).cast("bigint"), input_tokens - cache_read), ttft_s)


def decode_rate(output_tokens: Column, window_s: Column, streaming: Column) -> Column:
    tokens, window = counter(output_tokens), finite_positive(window_s)
    return F.when(streaming & (tokens > 0) & (window >= MIN_STREAM_WINDOW_S), tokens / window)


def mean_or_zero(value: Column) -> Column:
    """Aggregate: average of the measured samples, 0.0 when there are none."""
    return F.coalesce(F.avg(value), F.lit(0.0))


def ratio_or_zero(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def rate_label(value: Column, digits: int = 2) -> Column:
    return F.when(value.isNull(), F.lit(UNMEASURED)).otherwise(F.format_string(f"%.{digits}f", value))


def seconds(milliseconds: Column) -> Column:
    return milliseconds.try_cast("double") / 1000.0


def stored_or_derived(stored: Column, derived: Column) -> Column:
    """A stored reading wins, even one that turns out unusable; NULL falls back to the derived one."""
    return F.when(stored.isNotNull(), finite_positive(stored)).otherwise(derived)


def tokens_from_chars(chars: Column, floor_at_one: bool = False) -> Column:
    """Four characters per token; ``floor_at_one`` counts one token even for no characters."""
    estimate = F.greatest(F.lit(1).cast("bigint"), F.floor(chars / CHARS_PER_TOKEN).cast("bigint"))
    return estimate if floor_at_one else F.when(chars > 0, estimate).otherwise(F.lit(0).cast("bigint"))


def optimized_tokens(tokens: Column, base_chars: Column, new_chars: Column) -> Column:
    """Scale a token count by the share of characters kept."""
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), new_chars / base_chars))
    return F.when(base_chars > 0, F.bround(tokens * share, 0).cast("bigint")).otherwise(tokens)


def reduction_pct(base: Column, new: Column) -> Column:
    saved = F.greatest(F.lit(0).cast("bigint"), base - new)
    return F.when(base > 0, saved / base * 100.0).otherwise(F.lit(0.0))


def first_stamp(*stamps: Column) -> Column:
    """The first reading that is a number above zero."""
    numbers = [s.try_cast("double") for s in stamps]
    return F.coalesce(*[F.when(n > 0, n) for n in numbers])


def flow_timing(
    started: Column,
    headers_at: Column,
    first_chunk: Column,
    last_chunk: Column,
    completed: Column,
    wall_started: Column,
    wall_first_byte: Column,
    wall_ended: Column,
    streaming: Column,
) -> Column:
    """``struct(ttft_s, total_s, generation_s)`` of one exchange, in a single clock domain.

    The monotonic stamps are used when the exchange has a monotonic start, otherwise the wall-clock
    stamps; the two are never subtracted from one another.
    """
    monotonic = started.isNotNull()
    start = F.when(monotonic, started).otherwise(first_stamp(wall_started))
    wall_first = first_stamp(wall_first_byte)
    first = F.when(monotonic, first_chunk).otherwise(wall_first)
    header = F.when(monotonic, headers_at).otherwise(wall_first)
    end = F.when(monotonic, F.when(streaming, F.coalesce(last_chunk, completed)).otherwise(completed)).otherwise(
        first_stamp(wall_ended)
    )
    ttft = finite_positive(F.coalesce(first, header) - start)
    total = finite_positive(end - start)
    window = F.when(first.isNotNull() & end.isNotNull(), finite_positive(end - first)).otherwise(
        finite_positive(total - ttft)
    )
    return F.struct(ttft.alias("ttft_s"), total.alias("total_s"), F.when(streaming, window).alias("generation_s"))


def decode_reason(streaming: Column, generation_s: Column) -> Column:
    """Why an exchange has no decode rate."""
    return (
        F.when(~streaming, F.lit("non-streaming"))
        .when(generation_s.isNull(), F.lit("no chunk window"))
        .otherwise(F.format_string("stream window %.0fms below floor", F.bround(generation_s * 1000, 0)))
    )


def milliseconds(value_s: Column) -> Column:
    return F.bround(value_s * 1000, 2)
