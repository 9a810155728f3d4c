"""Naming an intermediate value, inside one expression or in a table."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once.

    A value used many times over several projections is copied into every use when the optimiser merges them, and trees
    built on such values grow exponentially. A lambda variable is not copied.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(df: DataFrame, values: Mapping[str, Column]) -> DataFrame:
    """``df`` with ``values`` as its last columns, computed once per row; columns of these names are replaced.

    The optimiser copies the expression of a column that ``withColumn`` adds into every filter on it, below joins and into their conditions, and from
    there into each column it is made of. Columns of a generator are not copied.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c not in values]
    return df.select(*kept, F.inline_outer(F.array(F.struct(*[v.alias(n) for n, v in values.items()]))))
