"""Seeded perturbations of inputs and of recorded commands."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decisionlog.functions.bind import let, once
from decisionlog.functions.draw import draw, pick, uniform
from decisionlog.functions.geometry import cell_distance, cell_neighbours, literal_array, yaw_neighbours
from decisionlog.schemas import OBJECT_LABELS

NOISE_LEVELS = (0.0, 0.1, 0.2, 0.3, 0.5)
Probability = float | Column


#: Rates of bent directions, of replaced replies and of lost commands; whether commands come late.
Noise = tuple[float, float, float, bool]

# The standard noise conditions.
PROFILES: Mapping[str, Noise] = {
    "clean": (0.0, 0.0, 0.0, False),
    "dir_low": (0.10, 0.0, 0.0, False),
    "dir_high": (0.20, 0.0, 0.0, False),
    "sel_low": (0.0, 0.10, 0.0, False),
    "sel_high": (0.0, 0.30, 0.0, False),
    "compound_mid": (0.10, 0.20, 0.05, True),
}


def noise_grid(spark, profiles: Mapping[str, Noise] = PROFILES) -> DataFrame:
    """The conditions as a table."""
    rows = [(name, *noise) for name, noise in profiles.items()]
    return spark.createDataFrame(rows, "condition string, p_dir double, p_sel double, p_drop double, latency boolean")


def at_levels(df: DataFrame, levels: Sequence[float] = NOISE_LEVELS, name: str = "noise_level") -> DataFrame:
    """Every row once per noise level."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(float(x)) for x in levels])))


def _hit(token: Column, p: Probability) -> Column:
    rate = p if isinstance(p, Column) else F.lit(float(p))
    return (rate > 0) & (uniform(token) < rate)  # no draw where nothing can happen


def _token(row_id: Column, salt: str, seed: int, index: Column) -> Column:
    return draw(F.concat_ws("#", row_id, index.cast("string")), salt, seed)


def _drawn(near: Column, token: Column) -> Column:
    return let(near, lambda n: F.get(n, pick(token, F.greatest(F.size(n), F.lit(1)))))


def _moved(value: Column, near: Column, token: Column, p: Probability) -> Column:
    return F.when(_hit(token, p), _drawn(near, token)).otherwise(value)


def near_candidates(objects: Column, cell: Column, radius: int | Column = 1) -> Column:
    """Ids of objects not held and within ``radius`` grid steps of ``cell`` (J5, in-row form)."""
    limit = F.lit(radius) if isinstance(radius, int) else radius

    def near(here: Column) -> Column:
        return F.filter(objects, lambda o: ~F.coalesce(o["is_held"], F.lit(False)) & (cell_distance(here, o["cell"]) <= limit))

    return F.transform(let(cell, near), lambda o: o["id"])  # the cell is looked up once, not per object


def _current_cell(history: Column) -> Column:
    return F.coalesce(F.get(history, F.size(history) - 1)["cell"], F.lit("B2"))


def _changed(df: DataFrame, obs: str, change: Callable[[Column], Column], radius: int) -> DataFrame:
    """Replace the observation by ``change`` of it, then look up the candidates in reach of its last pose."""

    def refreshed(o: Column) -> Column:
        near = near_candidates(o["objects"], _current_cell(o["gripper_hist"]), radius)
        return o.withField("memory", o["memory"].withField("candidates", near))

    return once(df, {obs: let(let(F.col(obs), change), refreshed)}).select(*df.columns)


def _jittered(history: Column, row_id: Column, p: Probability, seed: int, *, yaw: bool) -> Column:
    def pose(h: Column, i: Column) -> Column:
        out = h.withField("cell", _moved(h["cell"], cell_neighbours(h["cell"]), _token(row_id, "pose-cell", seed, i), p))
        if yaw:
            out = out.withField("yaw", _moved(h["yaw"], yaw_neighbours(h["yaw"]), _token(row_id, "pose-yaw", seed, i), p))
        return out

    return F.transform(history, pose)


def user_input_moves(
    df: DataFrame, seed: int = 0, name: str = "_moves", *, most: float = 1.0, obs: str = "obs", id_col: str = "id", radius: int = 1
) -> DataFrame:
    """``df`` with what :func:`perturb_user_input` may do at rates up to ``most``: a draw serves every rate, so one is made per pose, not per pose and rate.

    ``poses`` has, per pose, the draws (``cell_u``, ``yaw_u``; ``low`` is the lesser) and what the pose moves to, ``low`` the least of them all, ``near`` and
    ``near_to`` the candidates at the last pose as it is and as it moves.
    """
    history, row_id = F.col(f"{obs}.gripper_hist"), F.col(id_col)
    kinds = (("cell", "pose-cell", cell_neighbours), ("yaw", "pose-yaw", yaw_neighbours))
    tokens = F.transform(history, lambda h, i: F.struct(*[_token(row_id, salt, seed, i).alias(f) for f, salt, _ in kinds]))
    rows = once(df, {"_tokens": tokens})
    rows = once(rows, {"_us": F.transform("_tokens", lambda x: F.struct(*[uniform(x[f]).alias(f) for f, _, _ in kinds]))})

    def pose(u: Column, i: Column) -> Column:
        h, token = F.get(history, i), F.get("_tokens", i)
        to = [F.when(u[f] < most, _drawn(near(h[f]), token[f])).alias(f"{f}_to") for f, _, near in kinds]
        return F.struct(F.least(u["cell"], u["yaw"]).alias("low"), u["cell"].alias("cell_u"), u["yaw"].alias("yaw_u"), *to)

    rows = once(rows, {name: F.transform("_us", pose)}).drop("_tokens", "_us")
    poses, objects = F.col(name), F.col(f"{obs}.objects")
    last = F.get(poses, F.size(poses) - 1)
    moved = F.when(last["cell_u"] < most, near_candidates(objects, F.coalesce(last["cell_to"], F.lit("B2")), radius))
    low = F.array_min(F.transform(poses, lambda m: m["low"]))
    here = near_candidates(objects, _current_cell(F.col(f"{obs}.gripper_hist")), radius)
    return once(rows, {name: F.struct(poses.alias("poses"), low.alias("low"), last["cell_u"].alias("last_u"), here.alias("near"), moved.alias("near_to"))})


def _at_rate(df: DataFrame, rate: Column, obs: str, moves: str) -> DataFrame:
    """:func:`perturb_user_input` from its moves. Draws are 0 at least, so none is below a rate of 0."""
    o, m = F.col(obs), F.col(moves)

    def pose(h: Column, x: Column) -> Column:
        now = h
        for f in ("cell", "yaw"):
            now = now.withField(f, F.when(x[f"{f}_u"] < rate, x[f"{f}_to"]).otherwise(h[f]))
        return F.when(x["low"] < rate, now).otherwise(h)

    history = F.when(m["low"] < rate, F.zip_with(o["gripper_hist"], m["poses"], pose)).otherwise(o["gripper_hist"])
    near = F.when(m["last_u"] < rate, m["near_to"]).otherwise(m["near"])
    changed = o.withField("gripper_hist", history).withField("memory", o["memory"].withField("candidates", near))
    return once(df, {obs: changed}).select(*[c for c in df.columns if c != moves])


def perturb_user_input(
    df: DataFrame, p: Probability, seed: int = 0, *, obs: str = "obs", id_col: str = "id", radius: int = 1, moves: str | None = None
) -> DataFrame:
    """Noisy control signal: each pose moves to a neighbouring cell and an adjacent yaw bin with ``p``.

    ``moves`` names a column of :func:`user_input_moves` (same seed and radius), made before a row is taken at several rates; the result is without it.
    """
    if moves is not None:
        return _at_rate(df, p if isinstance(p, Column) else F.lit(float(p)), obs, moves)
    change = lambda o: o.withField("gripper_hist", _jittered(o["gripper_hist"], F.col(id_col), p, seed, yaw=True))
    return _changed(df, obs, change, radius)


def perturb_grid(df: DataFrame, p: Probability, seed: int = 0, *, obs: str = "obs", id_col: str = "id", radius: int = 1) -> DataFrame:
    """Noisy perception: object and pose cells move to neighbours with ``p``."""

    def moved(o: Column, i: Column) -> Column:
        return o.withField("cell", _moved(o["cell"], cell_neighbours(o["cell"]), _token(F.col(id_col), "object-cell", seed, i), p))

    def change(o: Column) -> Column:
        hist = _jittered(o["gripper_hist"], F.col(id_col), p, seed, yaw=False)
        return o.withField("objects", F.transform(o["objects"], moved)).withField("gripper_hist", hist)

    return _changed(df, obs, change, radius)


def perturb_candidates(df: DataFrame, p: Probability, seed: int = 0, *, obs: str = "obs", id_col: str = "id") -> DataFrame:
    """Drop each candidate with ``p``, add each other object with ``p``."""
    cands = F.coalesce(F.col(f"{obs}.memory.candidates"), F.array().cast("array<string>"))
    ids = F.transform(F.col(f"{obs}.objects"), lambda o: o["id"])

    def lucky(salt: str) -> Callable[[Column, Column], Column]:
        return lambda x, i: _hit(_token(F.col(id_col), salt, seed, i), p)

    kept = F.filter(cands, lambda c, i: ~lucky("candidate-drop")(c, i))
    added = F.filter(F.filter(ids, lambda x: ~F.array_contains(cands, x)), lucky("candidate-add"))
    memory = F.col(f"{obs}.memory").withField("candidates", F.concat(kept, added))
    return df.withColumn(obs, F.col(obs).withField("memory", memory))


def perturb_labels(
    df: DataFrame, p: Probability, seed: int = 0, *, vocabulary: Sequence[str] = OBJECT_LABELS, obs: str = "obs", id_col: str = "id"
) -> DataFrame:
    """Replace each object label with ``p`` by another word of the vocabulary."""
    words = literal_array(vocabulary)

    def renamed(o: Column, i: Column) -> Column:
        others = F.array_except(words, F.array(o["label"]))
        return o.withField("label", _moved(o["label"], others, _token(F.col(id_col), "label", seed, i), p))

    return df.withColumn(obs, F.col(obs).withField("objects", F.transform(F.col(f"{obs}.objects"), renamed)))


PERTURBATIONS: Mapping[str, Callable[..., DataFrame]] = {
    "user_input": perturb_user_input,
    "grid_jitter": perturb_grid,
    "candidate_perturb": perturb_candidates,
    "label_noise": perturb_labels,
}

#: Perturbations whose draws can be made ahead, and how.
MOVES: Mapping[Callable[..., DataFrame], Callable[..., DataFrame]] = {perturb_user_input: user_input_moves}


def perturb_at_levels(
    df: DataFrame, perturb: Callable[..., DataFrame], levels: Sequence[float] = NOISE_LEVELS, seed: int = 0, name: str = "noise_level"
) -> DataFrame:
    """Every row once per noise level, perturbed at that level (G12); draws do not depend on the level and are made once per row where possible."""
    if perturb not in MOVES:
        return perturb(at_levels(df, levels, name), F.col(name), seed)
    drawn = MOVES[perturb](df, seed, "_moves", most=max(levels, default=0.0))
    return perturb(at_levels(drawn, levels, name), F.col(name), seed, moves="_moves")


def corrupt_commands(df: DataFrame, noise: Noise, seed: int = 0, *, id_col: str = "event_id") -> DataFrame:
    """A recorded command and reply log under noise (G11); works on streams as well.

    Velocity commands (``command_mode, axis, direction``) get a confusable axis or the opposite direction, half each;
    axes without confusable ones always flip. Replies (``reply_idx, n_choices``, null elsewhere) move to another choice. Lost
    rows stay, flagged ``dropped``; ``latency_sec`` is 0.1 to 0.5 s when commands come late. Gripper commands
    keep axis and direction.
    """
    *rates, late = noise
    if not all(0 <= p <= 1 for p in rates):
        raise ValueError(f"rates between 0 and 1, not {rates}")
    bend_rate, reply_rate, loss_rate = rates
    # Axes a translation axis is confused with.
    confused = {"x": ("y",), "y": ("x",), "z": ("y", "x")}
    table = F.create_map(*[x for a, others in confused.items() for x in (F.lit(a), literal_array(others))])
    row = F.col(id_col).cast("string")
    bent = (F.coalesce(F.col("command_mode"), F.lit("")) != "gripper") & F.col("direction").isNotNull() & _hit(draw(row, "bend", seed), bend_rate)
    how = draw(row, "bend-how", seed)
    others = F.try_element_at(table, F.col("axis"))
    swap = bent & (uniform(how) < 0.5) & others.isNotNull()
    flip = bent & ~F.coalesce(swap, F.lit(False))
    choice = draw(row, "choose", seed)
    replaced = (F.col("n_choices") > 1) & _hit(choice, reply_rate)
    step = F.lit(1) + pick(choice, F.greatest(F.col("n_choices") - 1, F.lit(1)))
    out = {}
    if "reply_idx" in df.columns:
        out["reply_idx"] = F.when(replaced, F.pmod(F.col("reply_idx") + step, F.col("n_choices"))).otherwise(F.col("reply_idx"))
        out["selection_perturbed"] = F.coalesce(replaced, F.lit(False))
    delay = F.lit(0.1) + uniform(draw(row, "latency", seed)) * F.lit(0.4) if late else F.lit(0.0)
    return df.withColumns(
        {
            "axis": F.when(swap, F.get(others, pick(how, F.greatest(F.size(others), F.lit(1))))).otherwise(F.col("axis")),
            "direction": F.when(flip, -F.col("direction")).otherwise(F.col("direction")),
            "direction_perturbed": F.coalesce(bent, F.lit(False)),
            "dropped": _hit(draw(row, "drop", seed), loss_rate),
            "latency_sec": delay,
            **out,
        }
    )
