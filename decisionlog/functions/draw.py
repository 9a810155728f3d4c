"""Reproducible draws: md5 of (salt, seed, id).

A draw depends only on the row's id, so it is the same for any partitioning, on retries, and in batch and streams.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BUCKETS = 65_536


def draw(row_id: Column | str, salt: str, seed: int = 0) -> Column:
    """32 hex digits for this row, salt and seed."""
    return F.md5(F.concat_ws("|", F.lit(salt), F.lit(str(seed)), row_id))


def uniform(token: Column) -> Column:
    """A number in [0, 1) from a draw."""
    return F.conv(F.substring(token, 1, 8), 16, 10).cast("bigint").cast("double") / F.lit(4294967296.0)


def bucket(token: Column) -> Column:
    """The leading 16 bits of a draw; rises with the draw's text order."""
    return F.conv(F.substring(token, 1, 4), 16, 10).cast("int")


def pick(token: Column, n: Column | int) -> Column:
    """An index 0..n-1, from bits ``uniform`` does not use."""
    size = F.lit(n) if isinstance(n, int) else n
    return F.pmod(F.conv(F.substring(token, 9, 6), 16, 10).cast("int"), size)


def chance(row_id: Column | str, salt: str, seed: int, p: float | Column) -> Column:
    """True with probability ``p``."""
    return uniform(draw(row_id, salt, seed)) < (F.lit(float(p)) if isinstance(p, (int, float)) else p)
