"""Helpers for arrays that live inside one row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it by name in ``body``.

    A plain column reused inside a lambda may be inlined by the optimiser and then runs once per
    array element; a lambda variable is never inlined.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def indexes(array: Column) -> Column:
    """0 … size-1, empty for an empty array."""
    return F.when(F.size(array) > 0, F.sequence(F.lit(0), F.size(array) - 1)).otherwise(
        F.array().cast("array<int>")
    )


def part(array: Column, start: Column, stop: Column) -> Column:
    """Elements ``start`` (0-based) up to but without ``stop``."""
    return F.slice(array, start + 1, F.greatest(stop - start, F.lit(0)))


def total(array: Column) -> Column:
    """Sum of a numeric array as BIGINT."""
    return F.aggregate(array, F.lit(0).cast("bigint"), lambda acc, x: acc + x)


def last(array: Column) -> Column:
    """The last element; NULL for an empty array."""
    return F.try_element_at(array, F.lit(-1))
