"""Typed access to free-form JSON held as VARIANT.

A key that is absent reads as NULL; a key that holds JSON null reads as a variant null. Fields whose
type varies are read with the ``*_or_null`` helpers, which give NULL for any other type.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnscope.functions.nested import bind


def parse(text: Column) -> Column:
    return F.try_parse_json(text)


def at(value: Column, path: str) -> Column:
    """The variant below a path (``$.a.b``); NULL when the path is absent."""
    return F.try_variant_get(value, path, "variant")


def kind(value: Column) -> Column:
    """OBJECT, ARRAY, STRING, BIGINT, …; VOID for JSON null; NULL when absent."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def is_object(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>").isNotNull()


def is_array(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>").isNotNull()


def is_string(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value) == "STRING", F.lit(False))


def has(value: Column, path: str) -> Column:
    return at(value, path).isNotNull()


def string_or_null(value: Column, path: str = "$") -> Column:
    inner = at(value, path)
    return F.when(is_string(inner), F.try_variant_get(value, path, "string"))


def text_of(value: Column, path: str) -> Column:
    """The field as text whatever its scalar type."""
    return F.try_variant_get(value, path, "string")


def whole_or_null(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "bigint")


def whole_at(value: Column, path: str) -> Column:
    """A counter below a path; anything unusable is 0."""
    return F.coalesce(whole_or_null(value, path), F.lit(0).cast("bigint"))


def number_at(value: Column, path: str) -> Column:
    """A number or numeric string; booleans and other types are NULL."""
    truth = F.try_variant_get(value, path, "string").isin("true", "false")
    return F.when(~truth, F.try_variant_get(value, path, "double"))


def items(value: Column, path: str = "$") -> Column:
    """The elements of an array as ARRAY<VARIANT>; an empty array for anything else."""
    inner = F.try_variant_get(value, path, "array<variant>")
    return F.coalesce(inner, F.array().cast("array<variant>"))


def fields(value: Column) -> Column:
    """An object as MAP<STRING, VARIANT>; NULL for anything else."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def truthy(value: Column) -> Column:
    """Whether a dynamic language would call the value true."""
    text = F.to_json(value)
    return F.coalesce(~text.isin("null", "false", '""', "[]", "{}", "0", "0.0", "-0.0"), F.lit(False))


def dumps_length(json_text: Column) -> Column:
    """Characters of the value when written with ``", "`` / ``": "`` separators and ASCII escapes.

    ``json_text`` is compact JSON. Structural separators are counted after string contents are
    removed; every character outside printable ASCII counts as its ``\\uXXXX`` escape.
    """

    def measure(t: Column) -> Column:
        bare = F.replace(F.replace(t, F.lit("\\\\"), F.lit("")), F.lit('\\"'), F.lit(""))
        outside = F.array_join(F.filter(F.split(bare, '"'), lambda _, i: i % 2 == 0), "")
        separators = F.length(outside) - F.length(F.translate(outside, ",:", ""))
        exotic = F.when(
            (F.octet_length(t) == F.length(t)) & ~F.contains(t, F.lit("\x7f")), F.lit("")
        ).otherwise(F.regexp_replace(t, "[\\x00-\\x7e]+", ""))
        astral = F.when(exotic != "", F.length(F.regexp_replace(exotic, "[\\x{0}-\\x{ffff}]+", ""))).otherwise(0)
        return (F.length(t) + separators + F.length(exotic) * 5 + astral * 6).cast("bigint")

    return bind(json_text, measure)
