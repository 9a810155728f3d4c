"""Ordered work inside a key that stays distributed when one key is huge.

``lag``, running sums and run lengths over ``partitionBy(key)`` put every row of a key into one task. Here a key is cut
into *chunks*: ranges of the sort order. The large shuffle and sort happen per (key, chunk); what one chunk needs from
its predecessors is a single small row per (key, chunk), combined per key and joined back. A key holding a third of the
table is spread over as many tasks as it has chunks, and results equal the plain window. Where rows crowd inside a chunk, it
is cut again at their quantiles (:func:`balanced`).

A null key is a key of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = "_chunk"


#: parts that a crowded chunk is cut into
PARTS = 64


@dataclass(frozen=True)
class Order:
    """Sort columns, and a chunk expression that never decreases along them.

    ``at`` is the first sort column as a number. ``cuts`` holds the places at which crowded chunks are cut again (:func:`balanced`), by key columns named ``of_...``.
    """

    columns: tuple[str, ...]
    chunk: Column
    at: Column | None = None
    cuts: DataFrame | None = None

    @property
    def key(self) -> Column:
        return F.struct(*self.columns)


def by_time(ts: str, *ties: str, width_seconds: int = 86_400) -> Order:
    """Order by a timestamp column, cut into ``width_seconds`` ranges."""
    return Order((ts, *ties), F.floor(epoch_seconds(F.col(ts)) / F.lit(width_seconds)), F.unix_micros(F.col(ts).cast("timestamp")))


def by_number(column: str, *ties: str, size: int = 1_000_000) -> Order:
    """Order by a numeric column (a line number, a turn, seconds), cut into ranges of ``size``."""
    return Order((column, *ties), F.floor(F.col(column) / F.lit(size)), F.col(column).cast("double"))


def by_value(column: str, *ties: str) -> Order:
    """Order by a column of few values; every value is its own chunk."""
    return Order((column, *ties), F.col(column))


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970 as a double, for TIMESTAMP and TIMESTAMP_NTZ alike."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1_000_000.0)


def last_items(array: Column, n: int) -> Column:
    """The last ``n`` items of an array."""
    return F.slice(array, F.greatest(F.size(array) - F.lit(n - 1), F.lit(1)), n)


def balanced(df: DataFrame, keys: Sequence[str], order: Order, rows: int) -> Order:
    """``order`` with chunks that hold more than ``rows`` rows of a key cut again into ``PARTS`` parts of about equal size.

    The cuts are an equi-depth histogram of each crowded chunk: a quantile sketch that tasks build and merge, one small row per crowded chunk. They are
    computed once, here, and kept in the checkpoint folder, so that every use of the order sees the same. Rows with equal first sort columns stay
    together. The order then serves any keys that begin with ``keys`` and any rows, not only those of ``df``.
    """
    shares = [k / PARTS for k in range(1, PARTS)]
    cells = df.select(*keys, order.chunk.alias("of_chunk"), order.at.alias("_chunk_at")).groupBy(*keys, "of_chunk")
    crowded = cells.agg(F.count("*").alias("_n"), F.percentile_approx("_chunk_at", shares, 10_000).alias("_chunk_cuts")).filter(F.col("_n") > rows)
    cuts = crowded.select(*[F.col(k).alias(f"of_{k}") for k in keys], "of_chunk", F.array_distinct("_chunk_cuts").alias("_chunk_cuts"))
    return replace(order, cuts=cuts.checkpoint())


def in_chunks(df: DataFrame, order: Order) -> DataFrame:
    """``df`` with its chunk: the order's own, and where that is crowded, a part of it."""
    if order.cuts is None:
        return df.withColumn(CHUNK, order.chunk)
    rows = df.withColumns({CHUNK: order.chunk, "_chunk_at": order.at})
    same = [rows[c.removeprefix("of_") if c != "of_chunk" else CHUNK].eqNullSafe(order.cuts[c]) for c in order.cuts.columns if c != "_chunk_cuts"]
    part = F.coalesce(F.size(F.filter("_chunk_cuts", lambda b: b < F.col("_chunk_at"))), F.lit(0))
    found = rows.join(order.cuts, same, "left").withColumn(CHUNK, F.struct(F.col(CHUNK).alias("chunk"), part.alias("part")))
    return found.select(*df.columns, CHUNK)


def _inside(keys: Sequence[str], order: Order) -> Window:
    return Window.partitionBy(*keys, CHUNK).orderBy(*order.columns)


def _across(keys: Sequence[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(CHUNK)


def _join_chunks(rows: DataFrame, chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` with the columns of their chunk; null keys are keys like others."""
    names = [*keys, CHUNK]
    other = chunks.withColumnsRenamed({n: f"_of_{n}" for n in names})
    same = [F.col(n).eqNullSafe(F.col(f"_of_{n}")) for n in names]
    return rows.join(other, same, "left").drop(*[f"_of_{n}" for n in names])


def previous(
    df: DataFrame, keys: Sequence[str], order: Order, values: Mapping[str, Column | str], seen: str | None = None
) -> DataFrame:
    """Add the values the preceding row of the key holds (null on the first row).

    ``seen`` names an extra boolean column: true when a preceding row exists.
    """
    item = F.struct(*[_col(v).alias(n) for n, v in values.items()])
    cut = in_chunks(df, order)
    tails = (
        cut.groupBy(*keys, CHUNK)
        .agg(F.max_by(item, order.key).alias("_tail"))
        .select(*keys, CHUNK, F.lag("_tail").over(_across(keys)).alias("_carry"))
        .filter(F.col("_carry").isNotNull())
    )
    rows = cut.withColumn("_prev", F.lag(item).over(_inside(keys, order)))
    rows = _join_chunks(rows, tails, keys).withColumn("_prev", F.coalesce("_prev", "_carry"))
    added = [F.col(f"_prev.{n}").alias(n) for n in values]
    if seen:
        added.append(F.col("_prev").isNotNull().alias(seen))
    return rows.select(*df.columns, *added)


def trailing(
    df: DataFrame, keys: Sequence[str], order: Order, value: Column | str, n: int, name: str, *, include_current: bool = False
) -> DataFrame:
    """Add an array of the ``n`` values up to this row, oldest first (shorter at the start of a key).

    With ``include_current`` the row itself is the last of the ``n``.
    """
    before = n - 1 if include_current else n
    item = F.struct(_col(value).alias("v"))
    cut = in_chunks(df, order)
    latest = Window.partitionBy(*keys, CHUNK).orderBy(*[F.col(c).desc() for c in order.columns])
    tails = (
        cut.select(*keys, CHUNK, item.alias("_item"), *_missing(order.columns, keys))
        .withColumn("_rank", F.row_number().over(latest))
        .filter(F.col("_rank") <= max(before, 1))
        .groupBy(*keys, CHUNK)
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("_rank")).alias("r"), F.col("_item").alias("i")))).alias("_tail"))
        .withColumn("_tail", F.transform("_tail", lambda x: x["i"]))
    )
    # every chunk row holds at least one item, so `before` chunks are enough to find `before` items
    earlier = _across(keys).rowsBetween(-max(before, 1), -1)
    carried = (
        tails.withColumn("_carry", F.flatten(F.collect_list("_tail").over(earlier)))
        .filter(F.size("_carry") > 0)
        .select(*keys, CHUNK, "_carry")
    )
    frame = _inside(keys, order).rowsBetween(-before, 0 if include_current else -1)
    rows = cut.withColumn("_seen", F.collect_list(item).over(frame))
    joined = _join_chunks(rows, carried, keys)
    full = F.concat(F.coalesce("_carry", F.array().cast("array<struct<v:" + _type(df, value) + ">>")), F.col("_seen"))
    return joined.select(*df.columns, F.transform(last_items(full, n), lambda x: x["v"]).alias(name))


def running(df: DataFrame, keys: Sequence[str], order: Order, sums: Mapping[str, Column]) -> DataFrame:
    """Add running sums up to and including each row."""
    cut = in_chunks(df, order)
    before = _across(keys).rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(*keys, CHUNK).agg(*[F.sum(e).alias(f"_t_{n}") for n, e in sums.items()])
    offsets = totals.select(*keys, CHUNK, *[F.sum(f"_t_{n}").over(before).alias(f"_o_{n}") for n in sums])
    upto = _inside(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    rows = cut.select("*", *[F.sum(e).over(upto).alias(f"_r_{n}") for n, e in sums.items()])
    joined = _join_chunks(rows, offsets, keys)
    return joined.select(
        *df.columns, *[(F.col(f"_r_{n}") + F.coalesce(f"_o_{n}", F.lit(0))).alias(n) for n in sums]
    )


def position(df: DataFrame, keys: Sequence[str], order: Order, name: str = "pos") -> DataFrame:
    """Number the rows of each key from 1 (``row_number`` without one task per key)."""
    return running(df, keys, order, {name: F.lit(1).cast("bigint")})


def sum_adjacent(
    df: DataFrame,
    keys: Sequence[str],
    order: Order,
    values: Mapping[str, Column | str],
    measures: Mapping[str, Callable[[Column, Column], Column]],
) -> DataFrame:
    """Per key, sum ``measure(previous row, row)`` over all neighbouring rows.

    One large shuffle; each chunk leaves its first row, last row and partial sums. Keys with a single row get zeros.
    """
    item = F.struct(*[_col(v).alias(n) for n, v in values.items()])
    cut = in_chunks(df.select(*keys, item.alias("_item"), *_missing(order.columns, keys)), order)
    rows = cut.withColumn("_before", F.lag("_item").over(_inside(keys, order)))
    pair = F.col("_before").isNotNull()
    per_chunk = rows.groupBy(*keys, CHUNK).agg(
        F.min_by("_item", order.key).alias("_head"),
        F.max_by("_item", order.key).alias("_tail"),
        *[
            F.sum(F.when(pair, m(F.col("_before"), F.col("_item")))).alias(f"_s_{n}")
            for n, m in measures.items()
        ],
    )
    stitched = per_chunk.withColumn("_before", F.lag("_tail").over(_across(keys)))
    joint = [
        (F.coalesce(f"_s_{n}", F.lit(0)) + F.coalesce(F.when(pair, m(F.col("_before"), F.col("_head"))), F.lit(0))).alias(n)
        for n, m in measures.items()
    ]
    return stitched.select(*keys, *joint).groupBy(*keys).agg(*[F.sum(n).alias(n) for n in measures])


def repeats(df: DataFrame, keys: Sequence[str], order: Order, value: Column | str) -> DataFrame:
    """Per key: ``rows``, ``longest_run`` of equal neighbours and ``duplicate_transitions``.

    A null value always breaks a run; the longest run of a non-empty key is at least 1.
    """
    w = _inside(keys, order)
    cut = in_chunks(df.select(*keys, _col(value).alias("_v"), *_missing(order.columns, keys)), order)
    same = F.coalesce(F.lag("_v").over(w) == F.col("_v"), F.lit(False))
    rows = cut.withColumn("_new", F.when(same, 0).otherwise(1))
    rows = rows.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy(*keys, CHUNK, "_run").agg(F.first("_v").alias("_v"), F.count("*").alias("_len"))
    run = F.struct("_v", "_len")
    ends = runs.groupBy(*keys, CHUNK).agg(
        F.sum("_len").alias("_rows"),
        F.max("_len").alias("_longest"),
        F.sum(F.col("_len") - 1).alias("_dups"),
        F.min_by(run, "_run").alias("_head"),
        F.max_by(run, "_run").alias("_tail"),
        F.max("_run").alias("_runs"),
    )
    # Only the first and last run of a chunk can join a run of another chunk: one or two rows per chunk remain.
    edge = F.when(F.col("_runs") == 1, F.array("_head")).otherwise(F.array("_head", "_tail"))
    edges = ends.select(
        *keys,
        CHUNK,
        F.struct("_rows", "_longest", "_dups").alias("_sum"),
        F.posexplode(edge).alias("_side", "_edge"),
    )
    along = Window.partitionBy(*keys).orderBy(CHUNK, "_side")
    # within a chunk the two edges are different runs, or runs of nulls: only a chunk border can join
    joins = (F.col("_side") == 0) & F.coalesce(F.lag("_edge._v").over(along) == F.col("_edge._v"), F.lit(False))
    edges = edges.withColumn("_joined", joins)
    edges = edges.withColumn(
        "_group",
        F.sum(F.when(F.col("_joined"), 0).otherwise(1)).over(along.rowsBetween(Window.unboundedPreceding, 0)),
    )
    merged = edges.groupBy(*keys, "_group").agg(
        F.sum("_edge._len").alias("_len"),
        F.max("_sum._longest").alias("_longest"),
        F.sum(F.when(F.col("_side") == 0, F.col("_sum._rows"))).alias("_rows"),
        F.sum(F.when(F.col("_side") == 0, F.col("_sum._dups"))).alias("_dups"),
        F.sum(F.col("_joined").cast("int")).alias("_joins"),
    )
    return merged.groupBy(*keys).agg(
        F.sum(F.coalesce("_rows", F.lit(0))).alias("rows"),
        F.greatest(F.max("_len"), F.max("_longest")).alias("longest_run"),
        (F.sum(F.coalesce("_dups", F.lit(0))) + F.sum("_joins")).alias("duplicate_transitions"),
    )


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _missing(columns: Sequence[str], present: Sequence[str]) -> list[str]:
    return [c for c in columns if c not in present]


def _type(df: DataFrame, value: Column | str) -> str:
    return df.select(_col(value).alias("v")).schema[0].dataType.simpleString()
