"""Sharding by a permutation-filled lookup table.

Every shard prefers the slots of a prime-sized table in an order of its own (a start and a step drawn from its name). The shards take
turns; at its turn a shard claims the next free slot of its order. Shards so own nearly equal numbers of slots, and when one is added
or taken away few slots change hands. A key's slot is its hash modulo the table size; the table is broadcast (at most ``MAX_SLOTS``
rows, which depends on the number of shards and never on the data), so placing a row takes constant time and no shuffle.

Keys are single columns or several; nulls count as a key of their own, empty and long ones are keys like others, equal keys meet in one
shard. Place by a column of many values such as the id: a key is never split, so a key with a third of all rows fills a shard.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from decisionlog.llm.shared import free_name
from decisionlog.llm.textscan import mix

MAX_SLOTS = 4_194_301
SLOTS = 65_537


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def _hash(name: str, salt: int) -> int:
    value = np.array([salt], np.uint64)
    for byte in name.encode():
        value = mix(value + np.uint64(byte + 1))
    return int(value[0])


def lookup_table(shards: Sequence[str], slots: int = SLOTS) -> np.ndarray:
    """The index of the shard that owns each slot."""
    if not _is_prime(slots) or slots > MAX_SLOTS:
        raise ValueError(f"slots: a prime of at most {MAX_SLOTS}")
    if not shards or len(set(shards)) < len(shards) or len(shards) > slots // 100:
        raise ValueError("shards: distinct names, a hundredth of the slots at most")
    n = len(shards)
    at = [_hash(s, 11) % slots for s in shards]
    step = [_hash(s, 23) % (slots - 1) + 1 for s in shards]
    owner = [-1] * slots
    for turn in range(slots):
        shard = turn % n
        while owner[at[shard]] >= 0:
            at[shard] = (at[shard] + step[shard]) % slots
        owner[at[shard]] = shard
    return np.array(owner, np.int32)


def slot_of(keys: Sequence[Column], slots: int = SLOTS) -> Column:
    """The keys' slot; the type of a key doesn't matter, a null differs from any text."""
    text = F.concat_ws("\u0001", *(F.coalesce(F.concat(F.lit("="), k.cast("string")), F.lit("-")) for k in keys))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint"), F.lit(slots)).cast("int")


def table_rows(spark: SparkSession, shards: Sequence[str], slots: int = SLOTS, name: str = "shard") -> DataFrame:
    owner = lookup_table(shards, slots)
    return spark.createDataFrame(pa.table({"slot": pa.array(np.arange(slots, dtype=np.int32)), name: pa.array(list(shards)).take(pa.array(owner))}))


def place(df: DataFrame, keys: Sequence[str], shards: Sequence[str], slots: int = SLOTS, name: str = "shard") -> DataFrame:
    """``df`` with its shard in a column ``name``, which takes the place of one of that name."""
    rest = [c for c in df.columns if c.lower() != name.lower()]
    slot = free_name(df, f"{name}_slot")
    placed = df.select(*rest, slot_of([F.col(k) for k in keys], slots).alias(slot))
    table = table_rows(df.sparkSession, shards, slots, name).withColumnRenamed("slot", slot)
    return placed.join(F.broadcast(table), slot).select(*rest, name)


def write_shards(df: DataFrame, keys: Sequence[str], shards: Sequence[str], path: str, parts: int = 1, slots: int = SLOTS) -> None:
    """One folder per shard below ``path``; ``parts`` tasks write a shard, so its size is no bound."""
    placed = place(df, keys, shards, slots, "shard")
    part = F.pmod(F.xxhash64(*keys), F.lit(parts))
    name = free_name(placed, "part")
    placed.withColumn(name, part).repartition("shard", name).drop(name).write.partitionBy("shard").parquet(path)
