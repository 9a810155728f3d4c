"""Trials to scenarios: snapshots, deduplication, layout templates, labels, contract rows
(S5, S6, S15, W1, W9, W10, A32-A34, A38, J3, J4, J7, J8, V4, P7, X3-X5)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decisionlog.functions.geometry import CELLS, YAW_BINS, Z_BINS, cell_distance, height_bin, yaw_bin, yaw_steps
from decisionlog.functions.jsontext import members, strict_json
from decisionlog.functions.labels import canonical_label
from decisionlog.operators.ordered import Order, by_number, by_value, position
from decisionlog.operators.perturb import near_candidates
from decisionlog.schemas import DEFAULT_INSTRUCTION, HISTORY_LENGTH, MOTION_TOOLS, POSE, SCENARIO_OBJECT, TRIAL_KEYS, USER_PRIORS

# Where a target or a layout comes from.
TARGET_SOURCES = ("tool_call", "hand_label", "unlabeled")
LAYOUT_SOURCES = ("state_snapshot", "borrowed_template", "hand_label")
_SCENE = ("label", "cell")


def parse_snapshot(snapshot: Column) -> Column:
    """A logged snapshot with defaults for what it leaves out."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    whole = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    real = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))

    def item(o: Column) -> Column:
        return F.struct(
            text(o["id"]).alias("id"),
            text(o["label"]).alias("label"),
            whole(o["grid_cell"]).alias("grid_cell"),
            text(o["grid_label"]).alias("grid_label"),
            F.coalesce(o["is_held"], F.lit(False)).alias("is_held"),
            real(o["yaw"]).alias("yaw"),
        )

    g = snapshot["gripper"]
    kind = "array<struct<id:string,label:string,grid_cell:int,grid_label:string,is_held:boolean,yaw:double>>"
    parsed = F.struct(
        real(snapshot["stamp"]).alias("stamp"),
        F.coalesce(F.transform(snapshot["objects"], item), F.array().cast(kind)).alias("objects"),
        F.struct(
            whole(g["grid_cell"]).alias("grid_cell"),
            text(g["grid_label"]).alias("grid_label"),
            real(g["yaw"]).alias("yaw"),
            real(g["height"]).alias("height"),
        ).alias("gripper"),
    )
    return F.when(snapshot.isNotNull(), parsed)


def assemble_trials(summary: DataFrame, meta: DataFrame, calls: DataFrame, keys: Sequence[str] = TRIAL_KEYS) -> DataFrame:
    """One row per trial (S5): its keys from the directory, the logged id, whether it has calls, whether it has metadata.

    Mode, subject and difficulty of the directory win over what the files say; a missing metadata file is made up for by
    the summary.
    """
    told = meta.select(*keys, F.col("info.trial_id").alias("_meta_id"), F.lit(True).alias("has_meta"))
    has_calls = calls.select(*keys).distinct().withColumn("has_calls", F.lit(True))
    rows = summary.join(told, list(keys), "left").join(has_calls, list(keys), "left")
    # a metadata file without an id falls back on the directory, not on the summary
    logged = F.when(F.col("has_meta"), F.col("_meta_id")).otherwise(F.col("info.trial_id"))
    return rows.select(
        *keys,
        F.coalesce(F.nullif(logged, F.lit("")), F.col("trial_id")).alias("logged_id"),
        F.coalesce("has_meta", F.lit(False)).alias("has_meta"),
        F.coalesce("has_calls", F.lit(False)).alias("has_calls"),
    )


def first_snapshots(calls: DataFrame, order: Order, keys: Sequence[str] = TRIAL_KEYS) -> DataFrame:
    """Snapshot of each trial's first call."""
    return calls.groupBy(*keys).agg(F.min_by("state_snapshot", order.key).alias("snapshot"))


def snapshot_objects(snapshots: DataFrame, keys: Sequence[str] = TRIAL_KEYS) -> DataFrame:
    """Objects of first snapshots, one row each, labels canonical: ``keys, pos, id, label, raw_label, cell, yaw, is_held``."""
    rows = snapshots.select(*keys, F.posexplode("snapshot.objects").alias("pos", "_o"))
    return rows.select(
        *keys,
        "pos",
        F.col("_o.id").alias("id"),
        canonical_label(F.col("_o.label")).alias("label"),
        F.col("_o.grid_label").alias("cell"),
        F.col("_o.yaw").alias("yaw"),
        F.col("_o.is_held").alias("is_held"),
    )


def dedup_objects(objects: DataFrame, trial: Sequence[str], order: Order) -> DataFrame:
    """Collapse repeated (label, cell) detections of a trial.

    The first detection wins, held if any was; ids become ``obj_1..n`` in order of first detection. The order columns
    are those of the first detection.
    """
    merged = objects.groupBy(*trial, *_SCENE).agg(
        F.min(order.key).alias("_first"), F.min_by("yaw", order.key).alias("yaw"), F.bool_or("is_held").alias("is_held")
    ).select(*trial, *_SCENE, "yaw", "is_held", "_first.*")
    numbered = position(merged, trial, order, "_no")
    return numbered.select(*trial, F.concat(F.lit("obj_"), F.col("_no").cast("string")).alias("id"), *_SCENE, "yaw", "is_held", *order.columns)


def last_target(calls: DataFrame, order: Order, keys: Sequence[str] = TRIAL_KEYS, *, tool: str = "tool_name", target: str = "target_object_id") -> DataFrame:
    """The target of each trial's latest motion call that has one."""
    aimed = F.col(tool).isin(*MOTION_TOOLS) & (F.coalesce(target, F.lit("")) != "")
    return calls.filter(aimed).groupBy(*keys).agg(F.max_by(target, order.key).alias("target"))


def remap_targets(targets: DataFrame, objects: DataFrame, deduped: DataFrame, keys: Sequence[str] = TRIAL_KEYS, *, at: str = "pos") -> DataFrame:
    """Targets under their new ids (J8): old id to its (label, cell), that to the id after deduplication.

    Targets whose old id is no object of the trial are left out.
    """
    place = objects.groupBy(*keys, F.col("id").alias("target")).agg(F.min_by(F.struct(*_SCENE), at).alias("_p"))
    located = targets.join(place, [*keys, "target"]).select(*keys, F.col("_p.label").alias("label"), F.col("_p.cell").alias("cell"))
    return located.join(deduped.select(*keys, *_SCENE, "id"), [*keys, *_SCENE]).select(*keys, F.col("id").alias("target_obj_id"))


def _template_objects(deduped: DataFrame, group: Sequence[str], sizes: DataFrame, support: Column, trial_order: Column) -> DataFrame:
    votes = deduped.groupBy(*group, *_SCENE).agg(F.count("*").alias("support"), F.min_by("yaw", trial_order).alias("yaw"))
    kept = votes.join(sizes, list(group)).filter(F.col("support") >= support)
    return position(kept, group, by_value("cell", "label"), "_no").select(
        *group, F.concat(F.lit("obj_"), F.col("_no").cast("string")).alias("id"), *_SCENE, "yaw", "support", "n_trials", "_no"
    )


def template_objects(deduped: DataFrame, group: Sequence[str], trial_order: Sequence[str], *, min_support: int = 1, frac: float | None = None) -> DataFrame:
    """Objects of layout templates, one row each (A32, A33): ``group, id, label, cell, yaw, support, n_trials``.

    A (label, cell) counts once per trial and stays when at least ``min_support`` trials show it, or
    ``max(1, floor(n * frac))`` of the group's ``n``. Yaw comes from the first trial showing it; ids follow (cell, label).
    """
    trials = deduped.select(*group, F.struct(*trial_order).alias("_t")).distinct()
    sizes = trials.groupBy(*group).agg(F.count("*").alias("n_trials"))
    support = F.lit(min_support) if frac is None else F.greatest(F.lit(1), F.floor(F.col("n_trials") * F.lit(frac)))
    return _template_objects(deduped, group, sizes, support, F.struct(*trial_order)).drop("_no")


def template_poses(poses: DataFrame, group: Sequence[str], trial_order: Sequence[str]) -> DataFrame:
    """The most common start pose per group; of equal counts the one seen first."""
    votes = poses.groupBy(*group, "cell", "yaw", "z").agg(F.count("*").alias("_n"), F.min(F.struct(*trial_order)).alias("_first"))
    best = F.min_by(F.struct("cell", "yaw", "z"), F.struct((-F.col("_n")).alias("n"), "_first"))
    return votes.groupBy(*group).agg(best.alias("gripper_init"), F.sum("_n").alias("n_source_trials"))


def layout_templates(deduped: DataFrame, poses: DataFrame, group: Sequence[str], trial_order: Sequence[str], *, min_support: int = 1, frac: float | None = None) -> DataFrame:
    """One row per group: ``objects, gripper_init, n_source_trials``; groups without objects have none."""
    rows = template_objects(deduped, group, trial_order, min_support=min_support, frac=frac)
    item = F.struct(
        "id",
        "label",
        F.col("label").alias("raw_label"),
        "cell",
        yaw_bin(F.col("yaw")).alias("yaw"),
        F.lit(False).alias("is_held"),
    )
    # at most one entry per (label, cell): a scene
    scenes = rows.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("cell", "label", item.alias("o")))).alias("_o"))
    scenes = scenes.select(*group, F.transform("_o", lambda x: x["o"]).alias("objects"))
    return scenes.join(template_poses(poses, group, trial_order), list(group))


def pooled_templates(deduped: DataFrame, poses: DataFrame, trial_order: Sequence[str], frac: float = 0.5) -> DataFrame:
    """Fallback layouts per difficulty, over all subjects."""
    return layout_templates(deduped, poses, ["difficulty"], trial_order, frac=frac)


def inherit_layout(trials: DataFrame, templates: DataFrame, fallbacks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Layouts for trials without one (J7); returns (trials with ``objects, gripper_init, notes``, dropped with ``reason``).

    The subject's own template comes first, then the difficulty's.
    """
    own = templates.select("subject", "difficulty", F.struct("objects", "gripper_init", "n_source_trials").alias("_own"))
    pooled = fallbacks.select("difficulty", F.struct("objects", "gripper_init", "n_source_trials").alias("_pooled"))
    # found once per subject and difficulty: trials are joined a single time, as narrow as they come
    places = trials.select("subject", "difficulty").distinct().join(own, ["subject", "difficulty"], "left").join(pooled, "difficulty", "left")
    places = places.select(F.col("subject").alias("_subject"), F.col("difficulty").alias("_difficulty"), F.coalesce("_own", "_pooled").alias("_layout"), F.col("_own").isNotNull().alias("_has_own"))
    rows = trials.join(places, F.col("subject").eqNullSafe(F.col("_subject")) & F.col("difficulty").eqNullSafe(F.col("_difficulty")), "left")
    origin = F.when(F.col("_has_own"), F.lit("own")).otherwise(F.lit("pooled"))
    notes = F.format_string("template=%s, trials=%d", origin, F.col("_layout.n_source_trials"))
    found = rows.filter(F.col("_layout").isNotNull())
    placed = found.select(*trials.columns, "_layout.objects", "_layout.gripper_init", notes.alias("notes"))
    reason = F.format_string("no template: subject=%s, difficulty=%s", "subject", "difficulty")
    return placed, rows.filter(F.col("_layout").isNull()).select(*trials.columns, reason.alias("reason"))


def overlay_labels(scenarios: DataFrame, labels: DataFrame, row: str = "row") -> tuple[DataFrame, DataFrame]:
    """Hand labels on scenarios (J3, J4); returns (scenarios, skipped label rows with ``reason``).

    Rows are applied in ``row`` order, the last valid one winning. A ``layout_override`` in JSON replaces objects and
    start pose; targets are checked against the scenario's final layout. Notes are appended.
    """
    layout_type = f"STRUCT<objects ARRAY<{SCENARIO_OBJECT}>, gripper_init {POSE}>"
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    given = labels.filter(text("scenario_id") != "").select(
        text("scenario_id").alias("scenario_id"),
        F.col(row).alias("_row"),
        text("target_obj_id").alias("_target"),
        text("layout_override").alias("_override"),
        text("notes").alias("_note"),
    )
    parsed = F.from_json("_override", layout_type)
    whole = members(strict_json(F.col("_override"))).isNotNull() & parsed["objects"].isNotNull() & parsed["gripper_init"].isNotNull()
    given = given.withColumn("_layout", F.when((F.col("_override") != "") & whole, parsed))
    given = given.withColumn("_bad", (F.col("_override") != "") & F.col("_layout").isNull())
    layouts = given.filter(F.col("_layout").isNotNull()).groupBy("scenario_id").agg(F.max_by("_layout", "_row").alias("_new"))
    placed = scenarios.join(layouts, "scenario_id", "left")
    placed = placed.select(
        *[c for c in scenarios.columns if c not in ("objects", "gripper_init", "layout_source")],
        F.coalesce("_new.objects", "objects").alias("objects"),
        F.coalesce("_new.gripper_init", "gripper_init").alias("gripper_init"),
        F.when(F.col("_new").isNotNull(), "hand_label").otherwise(F.col("layout_source")).alias("layout_source"),
    )
    ids = placed.select("scenario_id", F.transform("objects", lambda o: o["id"]).alias("_ids"))
    checked = given.join(ids, "scenario_id", "left")
    reason = (
        F.when(F.col("_ids").isNull(), "unknown scenario")
        .when(F.col("_bad"), "layout not readable")
        .when((F.col("_target") != "") & ~F.array_contains("_ids", F.col("_target")), F.concat(F.lit("unknown target "), "_target"))
    )
    checked = checked.withColumn("reason", reason)
    good = checked.filter(F.col("reason").isNull())
    aimed = F.col("_target") != ""
    # notes of one scenario, as many as people wrote; rows without one are not gathered
    said = F.sort_array(F.collect_list(F.when(F.col("_note") != "", F.struct("_row", "_note"))))
    last = good.groupBy("scenario_id").agg(
        F.max_by(F.when(aimed, F.col("_target")), F.when(aimed, F.col("_row"))).alias("_target"),
        F.concat_ws(" | ", F.transform(said, lambda x: x["_note"])).alias("_said"),
    )
    out = placed.join(last, "scenario_id", "left")
    notes = F.concat_ws(" | ", F.nullif("notes", F.lit("")), F.nullif("_said", F.lit("")))
    changed = {
        "target_obj_id": F.coalesce("_target", "target_obj_id"),
        "target_label_source": F.when(F.col("_target").isNotNull(), "hand_label").otherwise(F.col("target_label_source")),
        "notes": notes,
    }
    merged = out.withColumns(changed).select(*scenarios.columns)
    skipped = checked.filter(F.col("reason").isNotNull()).select("scenario_id", F.col("_row").alias(row), "reason")
    return merged, skipped


def _known(value: Column, values: Sequence[str]) -> Column:
    return F.coalesce(value.isin(*values), F.lit(False))


def _scenario_rules() -> dict[str, Column]:
    """Rule code to the number of its violations in a scenario."""
    objects = F.coalesce("objects", F.array().cast(f"array<{SCENARIO_OBJECT}>"))
    ids = F.transform(objects, lambda o: o["id"])
    count = lambda test: F.when(test, 1).otherwise(0)
    off = lambda field, values: F.size(F.filter(objects, lambda o: ~_known(o[field], values)))
    target, labelled = F.col("target_obj_id"), F.coalesce(F.col("target_label_source") != "unlabeled", F.lit(True))
    plausible = F.coalesce("plausible_target_ids", F.array().cast("array<string>"))
    pose = {f"start.{f}": count(~_known(F.col(f"gripper_init.{f}"), v)) for f, v in (("cell", CELLS), ("yaw", YAW_BINS), ("z", Z_BINS))}
    return pose | {
        "layout.source": count(~_known(F.col("layout_source"), LAYOUT_SOURCES)),
        "objects.cell": off("cell", CELLS),
        "objects.few": count(F.size(objects) < 2),
        "objects.repeated_id": F.size(ids) - F.size(F.array_distinct(ids)),
        "objects.yaw": off("yaw", YAW_BINS),
        "plausible.absent": F.size(F.array_except(plausible, ids)),
        "target.absent": count(target.isNotNull() & ~F.coalesce(F.array_contains(ids, target), F.lit(False))),
        "target.label": count(target.isNotNull() != labelled),
        "target.source": count(~_known(F.col("target_label_source"), TARGET_SOURCES)),
    }


def scenario_violations(df: DataFrame) -> DataFrame:
    """Add ``violations`` to scenarios (V4): the codes of broken rules, with the number of faults; none in a valid scenario."""
    found = [F.when(n > 0, F.struct(F.lit(code).alias("rule"), n.cast("int").alias("faults"))) for code, n in _scenario_rules().items()]
    return df.withColumn("violations", F.filter(F.array(*found), lambda v: v.isNotNull()))


def scenarios_to_contract(df: DataFrame, user_mode: str = "translation", max_dist: int = 1, skip_unlabeled: bool = False, *, output: str | None = None, instruction: str = DEFAULT_INSTRUCTION) -> DataFrame:
    """Contract rows of scenarios at rest (P7): the start pose six times, candidates in reach, an empty memory.

    ``output`` names a column holding the true call as JSON text; without it the output is ``{}``.
    """
    rows = df.filter(F.col("target_obj_id").isNotNull()) if skip_unlabeled else df
    texts = F.array().cast("array<string>")
    memory = F.struct(
        F.lit(0).alias("n_interactions"),
        texts.alias("past_dialogs"),
        near_candidates(F.col("objects"), F.col("gripper_init.cell"), max_dist).alias("candidates"),
        texts.alias("last_tool_calls"),
        texts.alias("excluded_obj_ids"),
        F.create_map().cast("map<string,string>").alias("last_action"),
    )
    objects = F.transform("objects", lambda o: F.struct(*[o[k].alias(k) for k in ("id", "label", "cell", "yaw", "is_held")]))
    blob = F.struct(
        objects.alias("objects"),
        F.array_repeat("gripper_init", HISTORY_LENGTH).alias("gripper_hist"),
        memory.alias("memory"),
        F.struct(F.lit(user_mode).alias("mode")).alias("user_state"),
    )
    return rows.select(
        F.col("scenario_id").alias("id"),
        F.lit(instruction).alias("instruction"),
        F.to_json(blob, {"ignoreNullFields": "false"}).alias("input"),
        (F.coalesce(output, F.lit("{}")) if output else F.lit("{}")).alias("output"),
    )


def path_length(df: DataFrame, name: str = "path_length") -> DataFrame:
    """Add the fewest steps from the start pose to a closed gripper at the target, at least 1."""
    target = F.get(F.filter("objects", lambda o: o["id"] == F.col("target_obj_id")), F.lit(0))
    g = F.col("gripper_init")
    steps = lambda c: F.coalesce(c, F.lit(0))
    descent = F.when(g["z"] == "MID", 1).when(g["z"] == "LOW", 0).otherwise(2)
    length = steps(cell_distance(g["cell"], target["cell"])) + steps(yaw_steps(g["yaw"], target["yaw"])) + descent + 1
    return df.withColumn(name, F.when(target.isNull(), F.lit(1)).otherwise(F.greatest(F.lit(1), length)))


def label_stub(scenarios: DataFrame, only_unlabeled: bool = True) -> DataFrame:
    """Rows for people to label."""
    rows = scenarios.filter(F.col("target_label_source") == "unlabeled") if only_unlabeled else scenarios
    shown = F.transform("objects", lambda o: F.concat(o["id"], F.lit("="), o["label"], F.lit("@"), o["cell"], F.lit("("), o["yaw"], F.lit(")")))
    empty = F.lit("")
    return rows.select(
        "scenario_id",
        F.col("source.subject").alias("subject"),
        F.col("source.difficulty").alias("difficulty"),
        F.col("source.mode").alias("mode"),
        empty.alias("target_obj_id"),
        F.array_join("plausible_target_ids", "|").alias("plausible_targets"),
        F.array_join(shown, "|").alias("object_summary"),
        F.col("target_label_source").alias("current_target_source"),
        empty.alias("layout_override"),
        empty.alias("notes"),
    )


def extraction_report(scenarios: DataFrame, dropped: DataFrame) -> DataFrame:
    """Counts of an extraction (A34): ``dim, key, n`` for valid, invalid and dropped trials and valid ones by origin."""
    checked = scenario_violations(scenarios).withColumn("_valid", F.size("violations") == 0)
    entry = lambda d, k: F.struct(F.lit(d).alias("dim"), (k if isinstance(k, Column) else F.lit(k)).alias("key"))
    valid = F.array(
        entry("total", "valid"),
        entry("mode", F.col("source.mode")),
        entry("layout_source", F.col("layout_source")),
        entry("target_source", F.col("target_label_source")),
        entry("subject_difficulty", F.concat("source.subject", F.lit("/"), "source.difficulty")),
    )
    kept = checked.select(F.explode(F.when(F.col("_valid"), valid).otherwise(F.array(entry("total", "invalid")))).alias("_e"))
    lost = dropped.select(entry("total", "dropped").alias("_e"))
    rows = kept.unionByName(lost).select("_e.*")
    return rows.groupBy("dim", "key").agg(F.count("*").alias("n"))


def trial_heads(calls: DataFrame, order: Order, keys: Sequence[str] = TRIAL_KEYS) -> DataFrame:
    """What a trial's calls say about its scene, from one aggregate: first ``snapshot`` and last ``target``."""
    aimed = F.col("tool_name").isin(*MOTION_TOOLS) & (F.coalesce("target_object_id", F.lit("")) != "")
    return calls.groupBy(*keys).agg(
        F.min_by("state_snapshot", order.key).alias("snapshot"),
        F.max_by(F.when(aimed, F.col("target_object_id")), F.when(aimed, order.key)).alias("target"),
    )


def build_scenarios(
    trials: DataFrame, heads: DataFrame, priors: DataFrame, *, min_support: int = 1, frac: float = 0.5
) -> tuple[DataFrame, DataFrame]:
    """All trials as scenarios; returns (scenarios, dropped).

    ``heads`` is :func:`trial_heads`, one row per trial and used several times: store or checkpoint it first. Assistive
    trials with calls take layout, start pose and target from their own log; all others inherit a template.
    """
    keys = list(TRIAL_KEYS)
    heads = heads.filter(F.col("mode") == "assistive")
    objects = snapshot_objects(heads)
    deduped = dedup_objects(objects, keys, by_number("pos"))
    g = F.col("snapshot.gripper")
    poses = heads.select(*keys, g["grid_label"].alias("cell"), yaw_bin(g["yaw"]).alias("yaw"), height_bin(g["height"]).alias("z"))
    aims = remap_targets(heads.filter(F.col("target").isNotNull()).select(*keys, "target"), objects, deduped)
    item = F.struct("id", "label", F.col("label").alias("raw_label"), "cell", yaw_bin(F.col("yaw")).alias("yaw"), "is_held")
    # at most one entry per (label, cell): a scene
    scenes = deduped.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", item.alias("o")))).alias("_o"))
    scenes = scenes.select(*keys, F.transform("_o", lambda x: x["o"]).alias("objects"))
    gripper = poses.select(*keys, F.struct("cell", "yaw", "z").alias("gripper_init"))
    own = trials.join(gripper, keys).join(scenes, keys, "left").join(aims, keys, "left")
    own = own.withColumn("notes", F.lit("")).withColumn("layout_source", F.lit("state_snapshot"))
    rest = trials.join(gripper.select(*keys), keys, "left_anti")
    placed, dropped = inherit_layout(
        rest,
        layout_templates(deduped, poses, ["subject", "difficulty"], ["trial_id"], min_support=min_support),
        pooled_templates(deduped, poses, ["subject", "trial_id"], frac),
    )
    placed = placed.withColumn("target_obj_id", F.lit(None).cast("string")).withColumn("layout_source", F.lit("borrowed_template"))
    rows = own.unionByName(placed).join(priors.select(*keys, _priors_struct(priors).alias("user_priors")), keys, "left")
    free = F.transform(F.filter("objects", lambda o: ~o["is_held"]), lambda o: o["id"])
    scenarios = rows.select(
        F.concat_ws("_", "mode", "subject", "difficulty", "logged_id").alias("scenario_id"),
        F.struct("mode", "subject", "difficulty", F.col("logged_id").alias("trial_id"), F.concat_ws("/", *keys).alias("trial_dir")).alias("source"),
        F.coalesce("objects", F.array().cast(f"array<{SCENARIO_OBJECT}>")).alias("objects"),
        "gripper_init",
        "target_obj_id",
        F.when(F.col("target_obj_id").isNull(), "unlabeled").otherwise("tool_call").alias("target_label_source"),
        "layout_source",
        F.coalesce("user_priors", _no_priors()).alias("user_priors"),
        "difficulty",
        F.coalesce(free, F.array().cast("array<string>")).alias("plausible_target_ids"),
        "notes",
    )
    return scenarios, dropped


_PRIOR_FIELDS = (
    "translation_share",
    "rotation_share",
    "gripper_share",
    "mean_active_burst_sec",
    "mode_switches_per_sec",
    "direction_reversals_per_sec",
    "total_active_time_sec",
    "total_commands",
)


def _priors_struct(priors: DataFrame) -> Column:
    return F.struct(*_PRIOR_FIELDS).cast(USER_PRIORS)


def _no_priors() -> Column:
    return F.struct(*[F.lit(0).alias(f) for f in _PRIOR_FIELDS]).cast(USER_PRIORS)
