"""Scoring predictions against ground truth."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from decisionlog.functions.bind import let, once
from decisionlog.functions.jsontext import strict_json
from decisionlog.functions.text import ratio
from decisionlog.operators.perturb import NOISE_LEVELS, perturb_at_levels
from decisionlog.operators.toolcalls import call_violations, describe_call, describe_typed, same_call
from decisionlog.operators.triage import first_values
from decisionlog.schemas import ALL_TOOLS, MAX_CHOICES, MOTION_TOOLS

# The counters of a scored row; each is 0 or 1.
COUNTERS = (
    "n",
    "missing",
    "gt_invalid",
    "json_valid",
    "json_errors",
    "schema_valid",
    "schema_errors",
    "tool_correct",
    "tool_wrong",
    "motion_n",
    "motion_both_n",
    "motion_obj_correct",
    "motion_tool_correct",
    "interact_n",
    "interact_kind_correct",
    "interact_choices_valid",
    "interact_choices_count_correct",
    "strict_exact",
)


def join_predictions(contract: DataFrame, predictions: DataFrame, key: str = "id") -> DataFrame:
    """Ground truth with its predictions (J1); rows without one keep null and are counted as missing."""
    return contract.join(predictions, key, "left")


def score(
    df: DataFrame, *, truth: str = "output", raw: str = "raw", normalise: str = "offline", ignore_text: bool = True
) -> DataFrame:
    """Read both calls and add ``gt_tool``, ``pred_tool``, ``pred_labels``, ``error_type``, the calls ``gt`` / ``pred`` and the counters.

    Text that is not strict JSON is searched for its first balanced object. Rows whose ground truth is no JSON object
    count in ``n`` and nowhere else.
    """
    rows = first_values(df, raw, "_pred", "_cut")
    rows = once(
        rows,
        {
            "gt": describe_call(strict_json(F.col(truth)), normalise=normalise),
            "pred": describe_call(F.col("_pred"), normalise=normalise),
            "_missing": F.col(raw).isNull(),
        },
    )
    return _score_calls(rows, df.columns, ignore_text)


def score_counted(df: DataFrame, dims: Sequence[str] = (), *, truth: str = "output", raw: str = "raw", **how) -> DataFrame:
    """Like :func:`score`, with one row per distinct (``dims``, truth, answer): each pair of texts is read once, its counters times its rows.

    Sums over the counters are those of :func:`score`. Logs repeat few answers very often; a partial count runs before the shuffle.
    """
    counted = df.groupBy(*dims, truth, raw).agg(F.count("*").alias("_times"))
    # texts that depend on the count: a filter on the scores is not pushed below it, where it would read every row
    held = {c: F.when(F.col("_times") > 0, F.col(c)) for c in (truth, raw)}
    scored = score(counted.withColumns(held), truth=truth, raw=raw, **how)
    return scored.withColumns({c: F.col(c) * F.col("_times") for c in COUNTERS}).drop("_times")


def _score_calls(rows: DataFrame, columns: Sequence[str], ignore_text: bool) -> DataFrame:
    both = F.struct("gt", "pred", "_missing", (F.size(call_violations(F.col("pred"))) == 0).alias("valid"))
    rows = once(rows, {"_s": let(both, lambda x: _flags(x["gt"], x["pred"], x["_missing"], x["valid"], ignore_text))})
    return rows.select(*columns, "_s.gt_tool", "_s.pred_tool", "_s.pred_labels", "_s.error_type", "gt", "pred", *[f"_s.{c}" for c in COUNTERS])


def _flags(gt: Column, pred: Column, missing: Column, valid: Column, ignore_text: bool) -> Column:
    """Everything counted about one pair of calls. Unreadable ones count in no accuracy, not even in its denominator."""
    ok = gt["is_object"] & pred["is_object"]
    same_tool = ok & (gt["tool"] == pred["tool"])
    moved = ok & gt["tool"].isin(*MOTION_TOOLS)
    both = moved & pred["tool"].isin(*MOTION_TOOLS)
    asked = ok & (gt["tool"] == "INTERACT")
    text = lambda c, absent: F.coalesce(c, F.lit(absent))
    no_list = pred["choices"].isNull() & F.coalesce(F.array_contains(pred["arg_keys"], "choices"), F.lit(False))
    n_choices = F.coalesce(F.size(pred["choices"]), F.lit(0))
    flags: dict[str, Column] = {
        "n": F.lit(True),
        "missing": missing,
        "gt_invalid": ~gt["is_object"],
        "json_valid": ok,
        "json_errors": gt["is_object"] & ~pred["is_object"],
        "schema_valid": ok & valid,
        "schema_errors": ok & ~valid,
        "tool_correct": same_tool,
        "tool_wrong": ok & ~same_tool,
        "motion_n": moved,
        "motion_both_n": both,
        "motion_obj_correct": both & (text(gt["obj"], "null") == text(pred["obj"], "null")),
        "motion_tool_correct": both & same_tool,
        "interact_n": asked,
        "interact_kind_correct": asked & (text(gt["kind"], "None") == text(pred["kind"], "None")),
        "interact_choices_valid": asked & ~no_list & (n_choices <= MAX_CHOICES),
        "interact_choices_count_correct": asked & (F.coalesce(F.size(gt["choices"]), F.lit(0)) == n_choices),
        "strict_exact": ok & same_call(gt, pred, ignore_text=ignore_text),
    }
    labels = F.array(
        F.when(flags["json_errors"], F.lit("INVALID_JSON")), F.when(flags["schema_errors"], F.lit("INVALID_SCHEMA")), F.when(ok, pred["tool"])
    )
    error = F.when(missing, "missing").when(flags["json_errors"], "json_parse").when(flags["tool_wrong"], "tool_mismatch")
    return F.struct(
        F.when(gt["is_object"], gt["tool"]).alias("gt_tool"),
        F.when(ok, pred["tool"]).alias("pred_tool"),
        F.filter(labels, lambda x: x.isNotNull()).alias("pred_labels"),
        error.alias("error_type"),
        *[F.coalesce(test, F.lit(False)).cast("bigint").alias(name) for name, test in flags.items()],
    )


def score_typed(df: DataFrame, truth: str = "gt_call", pred: str = "pred") -> DataFrame:
    """The same for typed calls, such as a policy's answers."""
    return _score_described(_described(df, truth), pred)


def _described(df: DataFrame, call: str) -> DataFrame:
    """``df`` with the description of its true calls, ``_gt``."""
    return once(df, {"_gt": describe_typed(F.col(call), df.select(f"{call}.args.*").columns)})


def _score_described(df: DataFrame, pred: str) -> DataFrame:
    rows = once(df, {"_given": describe_typed(F.col(pred), df.select(f"{pred}.args.*").columns), "_missing": F.col(pred).isNull()})
    rows = rows.drop(*{"gt", "pred"} & set(df.columns)).withColumnsRenamed({"_gt": "gt", "_given": "pred"})
    return _score_calls(rows, [c for c in df.columns if c not in ("gt", "pred", "_gt")], True)


def count_scores(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """All counters per ``keys``, summed in one partial aggregate."""
    return scored.groupBy(*keys).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS])


def accuracy_report(scored: DataFrame, keys: Sequence[str] = (), motion_denominator: str = "all") -> DataFrame:
    """Validity and accuracy rates per ``keys`` (A12); a zero denominator gives 0.0.

    ``motion_denominator="both"`` counts motions only where both calls are motions (A12e).
    """
    if motion_denominator not in ("all", "both"):
        raise ValueError(f"unknown motion denominator {motion_denominator!r}")
    motions = F.col("motion_n" if motion_denominator == "all" else "motion_both_n")
    n, asked = F.col("n"), F.col("interact_n")
    rates = {
        "json_valid_rate": ratio(F.col("json_valid"), n),
        "schema_valid_rate": ratio(F.col("schema_valid"), n),
        "tool_accuracy": ratio(F.col("tool_correct"), n),
        "motion_obj_accuracy": ratio(F.col("motion_obj_correct"), motions),
        "motion_tool_accuracy": ratio(F.col("motion_tool_correct"), motions),
        "interact_kind_accuracy": ratio(F.col("interact_kind_correct"), asked),
        "interact_choices_valid_rate": ratio(F.col("interact_choices_valid"), asked),
        "strict_exact_rate": ratio(F.col("strict_exact"), n),
    }
    return count_scores(scored, keys).select(
        *keys, "n", *[r.alias(name) for name, r in rates.items()], "json_errors", "schema_errors", motions.alias("motion_n"), "interact_n", "missing"
    )


def tool_confusion(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Counts of (ground truth, predicted) tools (A13): ``keys, gt_tool, pred_tool, n``.

    A schema-invalid prediction counts twice: as its tool and as ``INVALID_SCHEMA``. An unreadable one is ``INVALID_JSON``.
    """
    # count the few distinct label sets first, then unfold them
    counted = scored.groupBy(*keys, "gt_tool", "pred_labels").agg(F.sum("n").alias("_n"))
    return (
        counted.select(*keys, "gt_tool", F.explode_outer("pred_labels").alias("pred_tool"), "_n")
        .filter(F.col("pred_tool").isNotNull())
        .groupBy(*keys, "gt_tool", "pred_tool")
        .agg(F.sum("_n").alias("n"))
    )


def normalise_confusion(confusion: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Row shares of a confusion table over the known tools."""
    known = confusion.filter(F.col("gt_tool").isin(*ALL_TOOLS) & F.col("pred_tool").isin(*ALL_TOOLS))
    row = Window.partitionBy(*keys, "gt_tool")  # a handful of tools
    return known.select(*keys, "gt_tool", "pred_tool", ratio(F.col("n"), F.sum("n").over(row)).alias("share"))


def candidate_bucket(n: Column) -> Column:
    """``cands_0`` to ``cands_5``, then ``cands_6+``."""
    return F.when(n <= 5, F.concat(F.lit("cands_"), n.cast("string"))).otherwise("cands_6+")


def breakdowns(scored: DataFrame, dims: Sequence[str] = ("context", "mode", "cands"), keys: Sequence[str] = ()) -> DataFrame:
    """Counters by context, by mode and by candidate bucket in one aggregate (A14): ``keys, dim, key, counters``."""
    rows = scored
    if "cands" in dims and "cands" not in scored.columns:
        rows = rows.withColumn("cands", candidate_bucket(F.col("n_cands")))
    sets = [[F.col(k) for k in keys] + [F.col(d)] for d in dims]
    found = rows.groupingSets(sets, *[F.col(k) for k in keys], *[F.col(d) for d in dims]).agg(
        *[F.sum(c).alias(c) for c in COUNTERS], *[F.grouping(d).alias(f"_g_{d}") for d in dims]
    )
    dim = F.coalesce(*[F.when(F.col(f"_g_{d}") == 0, F.lit(d)) for d in dims])
    key = F.coalesce(*[F.when(F.col(f"_g_{d}") == 0, F.col(d)) for d in dims])
    return found.select(*keys, dim.alias("dim"), key.alias("key"), *COUNTERS)


def error_decomposition(report: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Shares and counts of correct, wrong-tool, schema-invalid and JSON-invalid rows (A16); wrong is never below 0."""
    n = F.col("n")
    correct = F.col("tool_accuracy")
    schema, json = ratio(F.col("schema_errors"), n), ratio(F.col("json_errors"), n)
    right = F.round(correct * n).cast("bigint")
    wrong = n - right - F.col("json_errors") - F.col("schema_errors")
    return report.select(
        *keys,
        "n",
        correct.alias("correct"),
        F.greatest(F.lit(0.0), 1.0 - correct - json - schema).alias("wrong_tool"),
        schema.alias("schema_invalid"),
        json.alias("json_invalid"),
        right.alias("correct_n"),
        F.greatest(F.lit(0), wrong).alias("wrong_tool_n"),
        F.col("schema_errors").alias("schema_invalid_n"),
        F.col("json_errors").alias("json_invalid_n"),
    )


def cap_mistakes(scored: DataFrame, m: int = 200, position: str = "seq") -> DataFrame:
    """The first ``m`` wrong rows in file order (K5)."""
    return scored.filter(F.col("error_type").isNotNull()).orderBy(position).limit(m)


def robustness_curve(
    df: DataFrame,
    perturb: Callable[..., DataFrame],
    policy: Callable[[DataFrame], DataFrame],
    levels: Sequence[float] = NOISE_LEVELS,
    keys: Sequence[str] = ("env",),
    seed: int = 0,
) -> DataFrame:
    """Accuracy of a policy on perturbed inputs per noise level (A35), all levels in one job.

    ``df`` holds ``obs`` and the true call ``gt_call``; rows without either are skipped.
    """
    usable = df.filter(F.col("obs").isNotNull() & F.col("gt_call").isNotNull())
    # the truth is the same at all levels
    noisy = perturb_at_levels(_described(usable, "gt_call").drop("gt_call"), perturb, levels, seed)
    # each distinct pair of truth and answer is scored once, its counters times its rows
    pairs = policy(noisy).groupBy(*keys, "noise_level", "_gt", "pred").agg(F.count("*").alias("_times"))
    scored = _score_described(pairs, "pred").withColumns({c: F.col(c) * F.col("_times") for c in COUNTERS})
    totals = count_scores(scored, [*keys, "noise_level"])
    percent = lambda a, b: F.round(ratio(F.col(a), F.col(b)) * 100, 2)
    return totals.select(
        *keys,
        "noise_level",
        "n",
        percent("tool_correct", "n").alias("tool_acc"),
        percent("strict_exact", "n").alias("strict_match"),
        percent("motion_obj_correct", "motion_n").alias("motion_obj_acc"),
    )


def result_cells(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One result cell per ``keys``: rates, counts and the breakdown maps of the published JSON layout."""
    out = accuracy_report(scored, keys)
    confusion = tool_confusion(scored, keys).groupBy(*keys, "gt_tool").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("pred_tool", "n")))).alias("_row")
    )
    parts = [_entries(confusion, keys, "gt_tool", "_row", "tool_confusion")]
    broken = breakdowns(scored, keys=keys)
    kept = F.create_map(*[x for c in COUNTERS for x in (F.lit(c), F.col(c))])
    for dim, name in (("context", "by_context"), ("mode", "by_mode"), ("cands", "by_num_candidates")):
        rows = broken.filter(F.col("dim") == dim).withColumn("_row", F.map_filter(kept, lambda k, v: v > 0))
        parts.append(_entries(rows, keys, "key", "_row", name))
    for part in parts:
        out = out.join(part, list(keys), "left")
    return out


def _entries(rows: DataFrame, keys: Sequence[str], outer: str, inner: str, name: str) -> DataFrame:
    # one entry per tool, context, mode or bucket: small maps
    return rows.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(outer, inner))).alias(name))
