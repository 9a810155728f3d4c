"""Pose histories and decision points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decisionlog.functions.draw import draw, uniform
from decisionlog.functions.geometry import CELLS, cell_distance, literal_array
from decisionlog.operators.ordered import Order, position, previous, trailing
from decisionlog.schemas import ACTION_TOOLS, HISTORY_LENGTH


def cells_within(cell: Column, radius: int) -> Column:
    """All cells at most ``radius`` grid steps away, the cell itself included."""

    def steps(a: str, b: str) -> int:
        (ra, ca), (rb, cb) = divmod(CELLS.index(a), 3), divmod(CELLS.index(b), 3)
        return abs(ra - rb) + abs(ca - cb)

    near = {c: [d for d in CELLS if steps(c, d) <= radius] for c in CELLS}
    pairs = [x for c, cells in near.items() for x in (F.lit(c), literal_array(cells))]
    return F.try_element_at(F.create_map(*pairs), cell)


def candidate_join(poses: DataFrame, objects: DataFrame, scene: Sequence[str], max_dist: int = 1, *, pose_cell: str = "cell", object_cell: str = "object_cell") -> DataFrame:
    """Poses with the objects of their scene that are near and not held (J5, cross-table form).

    The range condition becomes an equality: each pose looks up the at most nine cells in reach.
    """
    reach = poses.withColumn("_near", F.explode(cells_within(F.col(pose_cell), max_dist)))
    free = objects.filter(~F.coalesce("is_held", F.lit(False))).withColumn("_near", F.col(object_cell))
    return reach.join(free, [*scene, "_near"]).drop("_near")


def rank_candidates(df: DataFrame, k: int | None = None, obs: str = "obs", name: str = "ranked") -> DataFrame:
    """Add the candidate objects not held as ``[{dist, id}]``, nearest first, then by id, the best ``k`` (K2)."""
    hist = F.col(f"{obs}.gripper_hist")
    here = F.get(hist, F.size(hist) - 1)["cell"]
    free = F.filter(
        f"{obs}.objects", lambda o: F.array_contains(f"{obs}.memory.candidates", o["id"]) & ~F.coalesce(o["is_held"], F.lit(False))
    )
    ranked = F.array_sort(F.transform(free, lambda o: F.struct(cell_distance(here, o["cell"]).alias("dist"), o["id"].alias("id"))))
    return df.withColumn(name, F.slice(ranked, 1, k) if k else ranked)


def pose_history(poses: DataFrame, keys: Sequence[str], order: Order, n: int = HISTORY_LENGTH, name: str = "gripper_hist") -> DataFrame:
    """Add the last ``n`` poses up to this row, oldest first, from a long pose table."""
    return trailing(poses, keys, order, F.struct("cell", "yaw", "z"), n, name, include_current=True)


def _count_of(items: Column, x: Column) -> Column:
    return F.size(F.filter(items, lambda y: y == x))


def yaw_oscillation(history: Column, n: int = HISTORY_LENGTH) -> Column:
    """``{triggered, cell, yaw1, yaw2}``: mostly one cell, two yaws, at least three switches."""
    cells, yaws = F.transform(history, lambda p: p["cell"]), F.transform(history, lambda p: p["yaw"])
    common = F.array_max(F.transform(cells, lambda c, i: F.struct(_count_of(cells, c).alias("n"), (-i).alias("first"), c.alias("cell"))))
    distinct = F.array_distinct(yaws)
    last = F.size(yaws) - 1
    switches = F.size(F.filter(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.get(yaws, i) != F.get(yaws, i - 1)))
    hit = F.coalesce((F.size(history) >= n) & (common["n"] >= 4) & (F.size(distinct) == 2) & (switches >= 3), F.lit(False))
    shown = lambda c: F.when(hit, c)
    return F.struct(
        hit.alias("triggered"),
        shown(common["cell"]).alias("cell"),
        shown(F.get(distinct, F.lit(0))).alias("yaw1"),
        shown(F.get(distinct, F.lit(1))).alias("yaw2"),
    )


def cell_oscillation(history: Column, a: Column, b: Column, n: int = HISTORY_LENGTH) -> Column:
    """True when both cells occur at least twice with at least two direct moves between them."""
    cells = F.transform(history, lambda p: p["cell"])
    pair = F.array(a, b)
    moves = F.filter(
        F.sequence(F.lit(1), F.greatest(F.size(cells) - 1, F.lit(1))),
        lambda i: (F.get(cells, i) != F.get(cells, i - 1))
        & F.array_contains(pair, F.get(cells, i))
        & F.array_contains(pair, F.get(cells, i - 1)),
    )
    both = (_count_of(cells, a) >= 2) & (_count_of(cells, b) >= 2)
    return F.coalesce((F.size(history) >= n) & both & (F.size(moves) >= 2), F.lit(False))


def infer_mode(history: Column) -> Column:
    """The input mode the last step shows: cell moved, yaw turned, height changed; else translation."""
    n = F.size(history)
    before, now = F.get(history, n - 2), F.get(history, n - 1)
    differs = lambda f: ~before[f].eqNullSafe(now[f])
    return (
        F.when(F.coalesce(n, F.lit(0)) < 2, "translation")
        .when(differs("cell"), "translation")
        .when(differs("yaw"), "rotation")
        .when(differs("z"), "gripper")
        .otherwise("translation")
    )


def last_k(df: DataFrame, value: Column | str, keys: Sequence[str], order: Order, k: int = 3, name: str = "last_tool_calls") -> DataFrame:
    """Add the ``k`` values before this row."""
    return trailing(df, keys, order, value, k, name)


def alert_reason(seen: Column, tool_before: Column, cands_before: Column, cands: Column, token: Column, p: float) -> Column:
    """Why a tick is a decision point, or null (W13); the first reason that holds counts."""
    as_set = lambda c: F.array_sort(F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))))
    return (
        F.when(~seen, "episode_start")
        .when(tool_before.isin(*ACTION_TOOLS), "post_execution")
        .when(as_set(cands) != as_set(cands_before), "candidate_change")
        .when(uniform(token) < F.lit(float(p)), "stochastic")
    )


def decision_points(
    df: DataFrame, keys: Sequence[str], order: Order, p: float = 0.15, seed: int = 0, *, tool: str = "tool", candidates: str = "candidates", id_col: str = "id"
) -> DataFrame:
    """Add ``alert_reason`` to every tick (W13): first tick, just executed, changed candidate set, or a seeded chance."""
    rows = previous(df, keys, order, {"_tool_before": tool, "_cands_before": candidates}, seen="_seen")
    reason = alert_reason(
        F.col("_seen"), F.col("_tool_before"), F.col("_cands_before"), F.col(candidates), draw(F.col(id_col).cast("string"), "alert", seed), p
    )
    return rows.select(*df.columns, reason.alias("alert_reason"))


def renumber(df: DataFrame, keys: Sequence[str], order: Order, name: str = "tick_idx") -> DataFrame:
    """Number the rows of each key from 0."""
    return position(df, keys, order, name).withColumn(name, F.col(name) - 1)
