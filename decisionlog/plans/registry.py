"""Registry of bound queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decisionlog.plans.views import Tables, with_views

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    """Register a query under its function's name, with oracle SQL over the named views if it has one."""

    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = with_views(sql, *views) if views else sql
        return fn

    return register


def unfold(df: DataFrame, column: str, name: str) -> DataFrame:
    """One row per array entry, column ``name`` alone.

    An inner ``explode`` makes the optimiser copy the array's whole expression into a filter below it.
    """
    return df.select(F.explode_outer(column).alias(name)).filter(F.col(name).isNotNull())


def checksum(column: str) -> Column:
    """Order-free sum over the rows' texts, to compare which rows were chosen."""
    return F.sum(F.conv(F.substring(F.md5(F.col(column).cast("string")), 1, 8), 16, 10).cast("bigint")).alias("checksum")


def sql_checksum(expression: str) -> str:
    return f"CAST(SUM(CAST('0x' || substr(md5(CAST({expression} AS VARCHAR)), 1, 8) AS BIGINT)) AS BIGINT) AS checksum"


def sql_draw(row_id: str, salt: str, seed: int) -> str:
    return f"md5('{salt}|{seed}|' || {row_id})"


def sql_uniform(token: str) -> str:
    return f"(CAST('0x' || substr({token}, 1, 8) AS BIGINT) / 4294967296.0)"


def sql_pick(token: str, n: str | int) -> str:
    return f"(CAST('0x' || substr({token}, 9, 6) AS BIGINT) % {n})"
