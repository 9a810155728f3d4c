"""Reports over rollouts and result cells."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decisionlog.functions.text import ratio

# Evaluation sets per flavour and environment, and the groups the ablation table compares.
ENVS = ("ycb", "stacking", "pouring")
EVAL_SETS = {
    "oracle": {"ycb": "oracle_valid_ycb", "stacking": "oracle_valid_stacking", "pouring": "oracle_valid_pouring"},
    "ambiguous": {"ycb": "ambiguous_ycb", "stacking": "ambiguous_stacking", "pouring": "ambiguous_pouring"},
}
PANELS = {
    "Warm-start (Phase-2 base)": ("woz_lora", "oracle_lora", "oracle_woz_lora"),
    "LoRA rank": ("oracle_woz_lora", "oracle_woz_r32"),
    "Per-env vs. unified": ("oracle_lora", "oracle_ycb", "oracle_stacking", "oracle_pouring"),
}


# ---- rollouts


def sweep_grid(scenarios: DataFrame, conditions: Sequence[str], modes: Sequence[str], seeds: int) -> DataFrame:
    """Every scenario under every condition, mode and seed (J10), unfolded inside the row."""
    out = scenarios
    for name, values in (("condition", conditions), ("mode", modes)):
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1)))) if seeds > 0 else out.limit(0).withColumn("seed", F.lit(0))


def pending(grid: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Grid rows without a recorded result."""
    return grid.join(done, list(keys), "left_anti")


def condition_summary(rollouts: DataFrame, keys: Sequence[str] = ("mode", "condition", "difficulty")) -> DataFrame:
    """Per condition (A23): success rate; time and inputs over successes only; everything else over all rollouts.

    Standard deviations are of the sample, 0 below two values.
    """
    won = F.col("success") == 1

    def mean(column: Column, digits: int, name: str) -> Column:
        return F.round(F.coalesce(F.avg(column), F.lit(0.0)), digits).alias(name)

    def spread(column: Column, digits: int, name: str) -> Column:
        return F.round(F.coalesce(F.stddev_samp(column), F.lit(0.0)), digits).alias(name)

    time, inputs = F.when(won, F.col("completion_time_sec")), F.when(won, F.col("total_inputs"))
    return rollouts.groupBy(*keys).agg(
        F.count("*").alias("n_rollouts"),
        mean(won.cast("int"), 4, "success_rate"),
        mean(time, 3, "mean_completion_time_sec"),
        spread(time, 3, "std_completion_time_sec"),
        mean(inputs, 2, "mean_total_inputs"),
        spread(inputs, 2, "std_total_inputs"),
        *[
            mean(F.col(c), 2, f"mean_{c}")
            for c in ("interactions", "dropped_inputs", "direction_reversals", "motion_tool_calls")
        ],
        mean(F.col("target_filtered_out"), 4, "target_filtered_out_rate"),
        mean(F.col("terminated_at_max_ticks"), 4, "max_ticks_rate"),
    )


def weighted_conditions(conditions: DataFrame, mode: str, difficulty: str | None = None, keys: Sequence[str] = ("condition",)) -> DataFrame:
    """Success and interactions of one mode per condition, weighted by rollouts."""
    rows = conditions.filter(F.col("mode") == mode)
    if difficulty is not None:
        rows = rows.filter(F.col("difficulty") == difficulty)
    n = F.sum("n_rollouts")
    weighted = lambda c: (F.sum(F.col(c) * F.col("n_rollouts")) / n).alias(c)
    return rows.groupBy(*keys).agg(weighted("success_rate"), weighted("mean_interactions"), n.alias("n")).filter(F.col("n") > 0)


def cell_means(conditions: DataFrame, mode: str, cell: str = "cell") -> DataFrame:
    """Plain means of a cell's condition rows in one mode (A25), whatever their rollout counts."""
    return conditions.filter(F.col("mode") == mode).groupBy(cell).agg(
        F.round(F.avg("success_rate"), 4).alias("success_rate"),
        F.round(F.avg("mean_interactions"), 3).alias("mean_interactions"),
        F.round(F.avg("mean_completion_time_sec"), 3).alias("mean_completion_sec"),
        F.sum("n_rollouts").alias("n_rollouts"),
    )


def cell_ig(per_question: DataFrame, cell: str = "cell", gate: float = 0.5) -> DataFrame:
    """Mean information gain of the chosen questions per cell (A26, for J14)."""
    chosen = per_question.filter((F.col("selector") == "chosen") & F.col("ig_bits").isNotNull())
    return chosen.groupBy(cell).agg(
        F.round(F.avg("ig_bits"), 3).alias("mean_ig"), F.round(F.avg((F.col("ig_bits") >= gate).cast("int")), 3).alias("frac_ge_0p5")
    )


def cell_name(name: Column) -> tuple[Column, Column]:
    """``model__mode`` into its parts at the last ``__`` (X13); the mode defaults to ``info_gain``."""
    model, mode = F.regexp_extract(name, r"^(.*)__(.*)$", 1), F.regexp_extract(name, r"^(.*)__(.*)$", 2)
    split = F.contains(name, F.lit("__"))
    return F.when(split, model).otherwise(name), F.when(split, mode).otherwise("info_gain")


def ablation_table(rollouts: DataFrame, ig: DataFrame, cell: str = "cell") -> DataFrame:
    """Rollout means per cell with the information gain of its questions, where known."""
    model, rerank = cell_name(F.col(cell))
    return rollouts.join(ig, cell, "left").select(
        model.alias("model"),
        rerank.alias("rerank"),
        F.round(F.col("success_rate") * 100, 1).alias("success_pct"),
        F.round("mean_interactions", 2).alias("mean_interactions"),
        F.round("mean_completion_sec", 2).alias("mean_completion_sec"),
        F.col("mean_ig").alias("mean_ig_bits"),
        F.col("frac_ge_0p5").alias("frac_ig_ge_0p5"),
        "n_rollouts",
    )


def join_trial_metrics(interactions: DataFrame, master: DataFrame, key: str = "trial_id") -> DataFrame:
    """Assistive trials present in both tables with a known number of plausible targets."""
    rows = master.filter((F.col("mode") == "assistive") & F.col("n_plausible_targets").isNotNull()).fillna(0, ["n_tool_failures"])
    return rows.join(interactions, key)


def correlate(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation (A30); null when either side does not vary."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.corr(x, y).alias("r"))


def trend(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Least-squares line ``y = slope * x + intercept``."""
    return df.groupBy(*keys).agg(
        F.regr_slope(F.col(y), F.col(x)).alias("slope"), F.regr_intercept(F.col(y), F.col(x)).alias("intercept")
    )


def baseline_disagreement(df: DataFrame, keys: Sequence[str] = ("ambiguity_category",), ours: str = "target_tool_call", theirs: str = "oracle_baseline_call") -> DataFrame:
    """How often an annotator's call differs from the stored baseline call, in tool and as a whole."""
    other_tool = ~F.col(f"{ours}.tool").eqNullSafe(F.col(f"{theirs}.tool"))
    other_call = ~F.col(ours).eqNullSafe(F.col(theirs))
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.sum(other_tool.cast("bigint")).alias("tool_differs"),
        F.sum(other_call.cast("bigint")).alias("call_differs"),
    )


# ---- result cells


def per_env(cells: DataFrame, flavor: str = "oracle", metric: str = "tool_accuracy") -> DataFrame:
    """One column per environment with a model's metric on that flavour's evaluation sets."""
    names = EVAL_SETS[flavor]
    value = lambda s: F.max(F.when(F.col("_eval_set") == s, F.col(metric)))
    return cells.groupBy("_model_safe").agg(*[value(s).alias(e) for e, s in names.items()])


def _average(columns: Sequence[str]) -> Column:
    present = F.filter(F.array(*[F.col(c) for c in columns]), lambda v: v.isNotNull())
    return F.when(F.size(present) > 0, F.aggregate(present, F.lit(0.0), lambda a, v: a + v) / F.size(present))


def macro_average(cells: DataFrame, flavor: str = "oracle") -> DataFrame:
    """Metric per environment and its mean over the environments present."""
    return per_env(cells, flavor).withColumn("avg3", _average(ENVS))


def clean_gap(cells: DataFrame) -> DataFrame:
    """Mean on the clean and on the ambiguous sets, and their difference."""
    clean = macro_average(cells, "oracle").select("_model_safe", F.col("avg3").alias("clean"))
    hard = macro_average(cells, "ambiguous").select("_model_safe", F.col("avg3").alias("ambiguous"))
    return clean.join(hard, "_model_safe").withColumn("gap", F.col("ambiguous") - F.col("clean"))


def ablation_panels(cells: DataFrame, panels: Mapping[str, Sequence[str]] = PANELS) -> DataFrame:
    """The models of each panel that have cells, in panel order."""
    members = [(i, p, j, m) for i, (p, models) in enumerate(panels.items()) for j, m in enumerate(models)]
    panel = cells.sparkSession.createDataFrame(members, "panel_no int, panel string, place int, _model_safe string")
    hard = macro_average(cells, "ambiguous").select("_model_safe", F.col("avg3").alias("ambiguous"))
    return panel.join(macro_average(cells), "_model_safe").join(hard, "_model_safe")


def flat_metrics(cells: DataFrame) -> DataFrame:
    """One flat row per cell."""
    names = {"_model_safe": "model_safe", "_display": "model_display", "_group": "group", "_eval_set": "eval_set", "_env": "env", "_flavor": "flavor"}
    rates = ("tool_accuracy", "schema_valid_rate", "strict_exact_rate", "motion_obj_accuracy", "interact_kind_accuracy")
    return cells.select(
        *[F.col(c).alias(n) for c, n in names.items()],
        "n",
        *[F.round(F.coalesce(c, F.lit(0.0)), 4).alias(c) for c in rates],
        F.round(F.coalesce("timing.examples_per_sec", F.lit(0.0)), 2).alias("examples_per_sec"),
    )


def throughput(cells: DataFrame, eval_set: str | None = None) -> DataFrame:
    """Accuracy in percent against examples per second, cells without a rate left out."""
    rows = cells.filter(F.col("timing.examples_per_sec") > 0)
    if eval_set is not None:
        rows = rows.filter(F.col("_eval_set") == eval_set)
    return rows.select(
        "_model_safe", "_eval_set", F.col("timing.examples_per_sec").alias("examples_per_sec"), (F.col("tool_accuracy") * 100).alias("accuracy_pct")
    )


def context_heat(cells: DataFrame, eval_set: str) -> DataFrame:
    """Accuracy and size per model and context, unreadable inputs left out."""
    rows = cells.filter(F.col("_eval_set") == eval_set).select("_model_safe", F.explode("by_context").alias("context", "_c"))
    n = F.coalesce(F.try_element_at("_c", F.lit("n")), F.lit(0))
    right = F.coalesce(F.try_element_at("_c", F.lit("tool_correct")), F.lit(0))
    return rows.filter((F.col("context") != "invalid_input_json") & (n > 0)).select(
        "_model_safe", "context", ratio(right, n).alias("accuracy"), n.alias("n")
    )


def cell_confusion(cells: DataFrame, keys: Sequence[str] = ("_model_safe", "_eval_set")) -> DataFrame:
    """Confusion maps of cells as a long table: ``keys, gt_tool, pred_tool, n``."""
    rows = cells.select(*keys, F.explode("tool_confusion").alias("gt_tool", "_row"))
    return rows.select(*keys, "gt_tool", F.explode("_row").alias("pred_tool", "n"))


def coverage_matrix(cells: DataFrame, eval_sets: Sequence[str]) -> DataFrame:
    """Which (model, evaluation set) cells exist."""
    return cells.groupBy("_model_safe").pivot("_eval_set", list(eval_sets)).agg(F.max(F.lit(True))).na.fill(False)


def resolve_registry(cells: DataFrame, models: DataFrame, eval_sets: DataFrame) -> DataFrame:
    """Cells with registry entries of their model and evaluation set; the cell's own metadata where none exists."""
    m = models.select(F.col("safe_name").alias("_model_safe"), *[F.col(c).alias(f"_m_{c}") for c in ("display", "kind", "model_path", "group")])
    e = eval_sets.select(F.col("name").alias("_eval_set"), *[F.col(c).alias(f"_e_{c}") for c in ("env", "flavor", "display")])
    both = cells.join(m, "_model_safe", "left").join(e, "_eval_set", "left")
    return both.select(
        *cells.columns,
        F.coalesce("_m_display", "_display", "model.name", "_model_safe").alias("model_display"),
        F.coalesce("_m_kind", "model.kind", F.lit("llm")).alias("model_kind"),
        F.coalesce("_m_model_path", "model.model_path").alias("model_path"),
        F.coalesce("_m_group", "_group", F.lit("trained")).alias("model_group"),
        F.coalesce("_e_env", "_env", F.lit("")).alias("eval_env"),
        F.coalesce("_e_flavor", "_flavor", F.lit("")).alias("eval_flavor"),
        F.coalesce("_e_display", "_eval_set").alias("eval_display"),
    )


def flag_best(df: DataFrame, metric: str, higher: bool = True, keys: Sequence[str] = (), ties: Sequence[str] = ()) -> DataFrame:
    """Add ``best``: true on the best row of each group, the first by ``ties`` (K6).

    The best row is found by an aggregate, so groups of any size are compared without being gathered.
    """
    value = F.col(metric).cast("double")
    usable = F.col(metric).isNotNull() & ~F.isnan(value)
    rank = F.struct((-value if higher else value).alias("v"), *ties)
    best = df.filter(usable).groupBy(*keys).agg(F.min(rank).alias("_best"))
    joined = df.join(best, list(keys), "left") if keys else df.join(best)
    return joined.withColumn("best", usable & rank.eqNullSafe(F.col("_best"))).drop("_best")


def ordered(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sorted output of a small report (K7)."""
    return df.orderBy(*keys)
