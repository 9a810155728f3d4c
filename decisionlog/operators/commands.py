"""Command logs: switches, reversals, bursts and user priors.

Rows are ``trial keys, type, command_mode, axis, direction, active, reason, stamp`` in file order. Every figure is a sum over
neighbouring rows, so a trial of any length is worked on by many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decisionlog.functions.text import ratio
from decisionlog.operators.ordered import Order, previous, sum_adjacent

MAX_BURST = 30.0
_KEY = ("_key_mode", "_key_axis")


def _moves() -> Column:
    return F.coalesce((F.col("type") == "cartesian_velocity") & F.col("active"), F.lit(False))


def is_active() -> Column:
    """A velocity command under way, or any gripper command."""
    return _moves() | F.coalesce(F.col("type") == "gripper", F.lit(False))


def _releases() -> Column:
    return F.coalesce((F.col("type") == "stop") & (F.col("reason") == "release"), F.lit(False))


def effective_mode() -> Column:
    """``gripper`` for gripper commands, else the logged mode, else ``translation``."""
    return F.when(F.col("type") == "gripper", "gripper").when(F.col("command_mode").isin("translation", "rotation"), F.col("command_mode")).otherwise("translation")


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumns({"_key_mode": F.coalesce("command_mode", F.lit("")), "_key_axis": F.coalesce("axis", F.lit(""))})


def _stamp() -> Column:
    return F.coalesce(F.col("stamp"), F.lit(0.0))


def mode_switches(commands: DataFrame, trial: Sequence[str], order: Order) -> DataFrame:
    """Changes of mode between consecutive active commands."""
    rows = commands.filter(is_active()).withColumn("_mode", effective_mode())
    changed = {"mode_switches": lambda before, now: F.when(before["m"] != now["m"], 1).otherwise(0)}
    return sum_adjacent(rows, trial, order, {"m": "_mode"}, changed)


def direction_reversals(commands: DataFrame, trial: Sequence[str], order: Order) -> DataFrame:
    """Changes of direction per (mode, axis), zero directions skipped."""
    rows = _keyed(commands).filter(_moves() & (F.coalesce("direction", F.lit(0)) != 0))
    changed = {"direction_reversals": lambda before, now: F.when(before["d"] != now["d"], 1).otherwise(0)}
    per_key = sum_adjacent(rows, [*trial, *_KEY], order, {"d": "direction"}, changed)
    return per_key.groupBy(*trial).agg(F.sum("direction_reversals").alias("direction_reversals"))


def _starts_and_stops(commands: DataFrame) -> DataFrame:
    """A release closes the start just before it: any later start or release of the same key comes between."""
    rows = _keyed(commands).filter(_moves() | _releases())
    return rows.withColumns({"_start": _moves(), "_at": _stamp(), "_mode": effective_mode()})


def bursts(commands: DataFrame, trial: Sequence[str], order: Order, max_burst: float = MAX_BURST) -> DataFrame:
    """One row per burst (W7): trial, ``burst_mode, axis, start, stop, seconds`` with ``0 < seconds < max_burst``."""
    rows = previous(_starts_and_stops(commands), [*trial, *_KEY], order, {"_opened": "_start", "_since": "_at"})
    closed = rows.filter(~F.col("_start") & F.col("_opened"))
    seconds = F.col("_at") - F.col("_since")
    return closed.filter((seconds > 0) & (seconds < max_burst)).select(
        *trial,
        F.col("_mode").alias("burst_mode"),
        F.col("_key_axis").alias("axis"),
        F.col("_since").alias("start"),
        F.col("_at").alias("stop"),
        seconds.alias("seconds"),
    )


def burst_totals(commands: DataFrame, trial: Sequence[str], order: Order, max_burst: float = MAX_BURST) -> DataFrame:
    """Bursts and their seconds by mode, per trial, without listing them."""

    def seconds(before: Column, now: Column) -> Column:
        dt = now["t"] - before["t"]
        return F.when(before["s"] & ~now["s"] & (dt > 0) & (dt < max_burst), dt)

    def of(mode: str):
        return lambda before, now: F.when(now["m"] == mode, seconds(before, now)).otherwise(0.0)

    measures = {"bursts": lambda before, now: F.when(seconds(before, now).isNotNull(), 1).otherwise(0)}
    measures |= {f"{m}_seconds": of(m) for m in ("translation", "rotation", "gripper")}
    values = {"s": "_start", "t": "_at", "m": "_mode"}
    per_key = sum_adjacent(_starts_and_stops(commands), [*trial, *_KEY], order, values, measures)
    return per_key.groupBy(*trial).agg(*[F.sum(n).alias(n) for n in measures])


def active_span(commands: DataFrame, trial: Sequence[str], order: Order) -> DataFrame:
    """Number of active commands and the stamps of the first and last, in file order."""
    active = is_active()
    when = lambda c: F.when(active, c)
    return commands.groupBy(*trial).agg(
        F.sum(active.cast("bigint")).alias("total_commands"),
        F.min_by(when(_stamp()), when(order.key)).alias("first_stamp"),
        F.max_by(when(_stamp()), when(order.key)).alias("last_stamp"),
    )


def user_priors(commands: DataFrame, trial: Sequence[str], order: Order, max_burst: float = MAX_BURST) -> DataFrame:
    """Behaviour of a user per trial (A37): mode shares, mean burst, switches and reversals per second, totals."""
    parts = [
        active_span(commands, trial, order),
        mode_switches(commands, trial, order),
        direction_reversals(commands, trial, order),
        burst_totals(commands, trial, order, max_burst),
    ]
    return priors_from_totals(parts, trial)


def priors_from_totals(parts: Sequence[DataFrame], trial: Sequence[str]) -> DataFrame:
    """Priors from partial totals of each trial, however many rows they come in."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    sums = ("total_commands", "mode_switches", "direction_reversals", "bursts", "translation_seconds", "rotation_seconds", "gripper_seconds")
    t = rows.groupBy(*trial).agg(*[total(c) for c in sums], F.max("first_stamp").alias("_first"), F.max("last_stamp").alias("_last"))
    active = F.col("translation_seconds") + F.col("rotation_seconds") + F.col("gripper_seconds")
    window = F.col("_last") - F.col("_first")
    return t.select(
        *trial,
        *[F.round(ratio(F.col(f"{m}_seconds"), active), 4).alias(f"{m}_share") for m in ("translation", "rotation", "gripper")],
        F.round(ratio(active, F.col("bursts")), 4).alias("mean_active_burst_sec"),
        F.round(ratio(F.col("mode_switches"), window), 4).alias("mode_switches_per_sec"),
        F.round(ratio(F.col("direction_reversals"), window), 4).alias("direction_reversals_per_sec"),
        F.round(active, 3).alias("total_active_time_sec"),
        "total_commands",
    )
