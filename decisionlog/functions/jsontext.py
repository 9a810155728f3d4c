"""Strict JSON text as VARIANT values.

Spark's JSON readers stop at the first complete value and ignore what follows it. Wrapping the text as one member of an
object with a sentinel behind it makes trailing text visible: only text that is exactly one JSON value passes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from decisionlog.functions.bind import let


def strict_json(text: Column) -> Column:
    """The VARIANT the text holds, or null unless the text is exactly one JSON value."""
    wrapped = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit(',"z":1}')))
    both = F.array(F.lit("v"), F.lit("z"))
    return let(wrapped, lambda w: F.when(F.map_keys(members(w)) == both, F.try_variant_get(w, "$.v", "variant")))


def members(value: Column) -> Column:
    """The members of a JSON object as ``map<string,variant>``; null for any other value."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def member(object_members: Column, name: str) -> Column:
    return F.try_element_at(object_members, F.lit(name))


def items(value: Column) -> Column:
    """The items of a JSON array; null for any other value."""
    return F.try_variant_get(value, "$", "array<variant>")


def is_text(value: Column) -> Column:
    """True when the value is a JSON string (false for null)."""
    return F.coalesce(F.schema_of_variant(value) == "STRING", F.lit(False))


def as_text(value: Column) -> Column:
    """Plain text of a scalar: ``True``/``False``/``None`` for literals, JSON text for nested values."""
    kind = F.schema_of_variant(value)
    return (
        F.when(value.isNull() | (kind == "VOID"), F.lit("None"))
        .when(kind == "BOOLEAN", F.initcap(F.try_variant_get(value, "$", "string")))
        .otherwise(F.try_variant_get(value, "$", "string"))
    )
