"""Rule baselines scoring a whole table of observations.

Input rows hold ``obs`` (objects, gripper_hist, memory, user_state); each policy adds the struct ``pred`` <tool, args>.
Scenes hold about ten objects, so all work stays inside the row.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decisionlog.functions.bind import let, once
from decisionlog.functions.geometry import cell_distance
from decisionlog.functions.text import strip

_TEXTS = "array<string>"
# The wording of the baseline questions.
_NOTHING_NEAR = "I don't see any nearby candidates. What do you want help with?"
_WHAT = "What do you want help with?"
_WHICH = "Which object do you want help with?"
_YES_NO = ("1) YES", "2) NO")


def _call(tool: Column | str, *, kind: str | None = None, text: Column | str | None = None, choices: Column | None = None, obj: Column | None = None) -> Column:
    args = F.struct(
        F.lit(kind).cast("string").alias("kind"),
        (text if isinstance(text, Column) else F.lit(text)).cast("string").alias("text"),
        (F.lit(None) if choices is None else choices).cast(_TEXTS).alias("choices"),
        (F.lit(None) if obj is None else obj).cast("string").alias("obj"),
    )
    return F.struct((tool if isinstance(tool, Column) else F.lit(tool)).alias("tool"), args.alias("args"))


def _ask(kind: str, text: Column | str, choices: Column) -> Column:
    return _call("INTERACT", kind=kind, text=text, choices=choices)


def _yes_no() -> Column:
    return F.array(*[F.lit(c) for c in _YES_NO])


def first_label(objects: Column, obj_id: Column) -> Column:
    """Label of the first object with this id (J6); empty labels count as none."""
    found = F.get(F.filter(objects, lambda o: o["id"] == obj_id), F.lit(0))["label"]
    return F.nullif(found, F.lit(""))


def candidate_labels(df: DataFrame, obs: str = "obs", name: str = "candidate_labels") -> DataFrame:
    """Add the candidates' labels in candidate order, unknown ones left out."""
    return df.withColumn(name, _labels(F.col(f"{obs}.objects"), F.col(f"{obs}.memory.candidates")))


def _labels(objects: Column, ids: Column) -> Column:
    return F.filter(F.transform(ids, lambda c: first_label(objects, c)), lambda x: x.isNotNull())


def _menu(labels: Column) -> Column:
    shown = F.transform(F.slice(labels, 1, 4), lambda x, i: F.concat((i + 1).cast("string"), F.lit(") "), x))
    return F.concat(shown, F.array(F.concat((F.size(shown) + 1).cast("string"), F.lit(") None of them"))))


def _prepared(df: DataFrame) -> DataFrame:
    mode = F.lower(strip(F.coalesce(F.nullif(F.col("obs.user_state.mode"), F.lit("")), F.lit("translation"))))
    approaches = mode.isin("translation", "gripper")
    objects = F.coalesce(F.col("obs.objects"), F.array().cast(df.select("obs.objects").schema[0].dataType))
    cands = F.coalesce(F.col("obs.memory.candidates"), F.array().cast(_TEXTS))
    rows = df.withColumns({"_objects": objects, "_cands": cands, "_near": approaches})
    rows = rows.withColumn("_tool", F.when(F.col("_near"), "APPROACH").otherwise("ALIGN_YAW"))
    rows = rows.withColumn("_verb", F.when(F.col("_near"), "approach").otherwise("align yaw to"))
    return rows.withColumn("_menu", _menu(_labels(F.col("_objects"), F.col("_cands"))))


def _confirm(obj_id: Column) -> Column:
    name = F.coalesce(first_label(F.col("_objects"), obj_id), obj_id)
    return _ask("CONFIRM", F.concat(F.lit("Do you want me to "), F.col("_verb"), F.lit(" the "), name, F.lit("?")), _yes_no())


def _answer(df: DataFrame, rows: DataFrame, pred: Column) -> DataFrame:
    return once(rows, {"pred": pred}).select(*[c for c in df.columns if c != "pred"], "pred")


def ask_if_ambiguous(df: DataFrame) -> DataFrame:
    """No candidate: ask openly. One: act. More: a menu of the first four labels and "None of them" (B1)."""
    rows = _prepared(df)
    n = F.size("_cands")
    pred = (
        F.when(n == 0, _ask("QUESTION", _NOTHING_NEAR, _yes_no()))
        .when(n == 1, _call(F.col("_tool"), obj=F.get("_cands", F.lit(0))))
        .otherwise(_ask("QUESTION", _WHICH, F.col("_menu")))
    )
    return _answer(df, rows, pred)


def always_ask(df: DataFrame) -> DataFrame:
    """As :func:`ask_if_ambiguous`, but a single candidate is confirmed first (B2)."""
    rows = _prepared(df)
    n = F.size("_cands")
    pred = (
        F.when(n == 0, _ask("QUESTION", _NOTHING_NEAR, _yes_no()))
        .when(n == 1, _confirm(F.get("_cands", F.lit(0))))
        .otherwise(_ask("QUESTION", _WHICH, F.col("_menu")))
    )
    return _answer(df, rows, pred)


def scored_candidates(ids: Column, objects: Column, value: Callable[[Column], Column]) -> Column:
    """``[{id, at, v}]`` for the distinct candidates whose object is known; ``value`` scores an object's cell."""

    def entry(c: Column, i: Column) -> Column:
        same = F.filter(objects, lambda o: o["id"] == c)
        cell = let(same, lambda s: F.get(s, F.size(s) - 1)["cell"])
        return F.struct(c.alias("id"), i.alias("at"), let(cell, value).cast("double").alias("v"))

    return F.filter(F.transform(F.array_distinct(ids), entry), lambda s: s["v"].isNotNull())


def softmax(scored: Column) -> Column:
    """``[{p, order, id}]`` from scored candidates; ``order`` makes the first of equal shares the greatest."""

    def weighed(s: Column) -> Column:
        top = F.array_max(F.transform(s, lambda x: x["v"]))
        return let(
            top, lambda m: F.transform(s, lambda x: F.struct(F.exp(x["v"] - m).alias("e"), (-x["at"]).alias("order"), x["id"].alias("id")))
        )

    def shared(ws: Column) -> Column:
        total = F.aggregate(ws, F.lit(0.0), lambda acc, w: acc + w["e"])
        return let(total, lambda z: F.transform(ws, lambda w: F.struct((w["e"] / z).alias("p"), w["order"].alias("order"), w["id"].alias("id"))))

    return let(let(scored, weighed), shared)


def _cell_at(history: Column, back: int) -> Column:
    return F.get(history, F.size(history) - back)["cell"]


def _with_shares(df: DataFrame, value: Callable[[Column], Column]) -> DataFrame:
    rows = _prepared(df)
    history = F.coalesce(F.size("obs.gripper_hist"), F.lit(0))
    rows = rows.withColumn("_scored", scored_candidates(F.col("_cands"), F.col("_objects"), value))
    rows = rows.withColumn("_shares", softmax(F.col("_scored")))
    return rows.withColumns({"_best": F.array_max("_shares"), "_blind": (F.size("_cands") == 0) | (history == 0)})


def predict_then_assist(df: DataFrame, beta: float = 1.5, dir_w: float = 0.5, tau: float = 0.6) -> DataFrame:
    """Act on the likeliest candidate when its share reaches ``tau``, else show the menu.

    Shares are a softmax of ``-beta * distance + dir_w * approach`` over the last step.
    """
    history = F.col("obs.gripper_hist")

    def value(cell: Column) -> Column:
        now = cell_distance(_cell_at(history, 1), cell)
        step = F.when(F.size(history) >= 2, cell_distance(_cell_at(history, 2), cell) - now).otherwise(0)
        return -F.lit(beta) * now + F.lit(dir_w) * step

    rows = _with_shares(df, value)
    pred = (
        F.when(F.col("_blind"), _ask("QUESTION", _WHAT, _yes_no()))
        .when(F.size("_cands") == 1, _call(F.col("_tool"), obj=F.get("_cands", F.lit(0))))
        .when(F.size("_scored") == 0, _ask("QUESTION", _WHICH, _yes_no()))
        .when(F.col("_best.p") >= tau, _call(F.col("_tool"), obj=F.col("_best.id")))
        .otherwise(_ask("QUESTION", _WHICH, F.col("_menu")))
    )
    return _answer(df, rows, pred)


def bayes_intent(df: DataFrame, low: float = 0.3, high: float = 0.7, dist_w: float = 1.0, motion_w: float = 1.5) -> DataFrame:
    """Posterior over candidates from distance and the whole pose history; its normalised entropy picks the answer.

    Below ``low`` act, below ``high`` confirm, else a menu ranked by share. Approach summed over all steps is the
    distance at the first pose minus that at the last.
    """
    history = F.col("obs.gripper_hist")

    def value(cell: Column) -> Column:
        now = cell_distance(_cell_at(history, 1), cell)
        return -F.lit(dist_w) * now + F.lit(motion_w) * (cell_distance(F.get(history, F.lit(0))["cell"], cell) - now)

    rows = _with_shares(df, value)
    n = F.size("_shares")
    entropy = -F.aggregate("_shares", F.lit(0.0), lambda acc, s: acc + s["p"] * F.log(s["p"] + F.lit(1e-10)))
    rows = rows.withColumn("_spread", F.when(n > 1, entropy / F.log(n.cast("double"))).otherwise(entropy))
    ranked = F.slice(F.reverse(F.array_sort("_shares")), 1, 4)
    labels = F.filter(F.transform(ranked, lambda s: first_label(F.col("_objects"), s["id"])), lambda x: x.isNotNull())
    pred = (
        F.when(F.col("_blind"), _ask("QUESTION", _WHAT, _yes_no()))
        .when(F.size("_cands") == 1, _call(F.col("_tool"), obj=F.get("_cands", F.lit(0))))
        .when(F.size("_scored") == 0, _ask("QUESTION", _WHAT, _yes_no()))
        .when(F.col("_spread") < low, _call(F.col("_tool"), obj=F.col("_best.id")))
        .when(F.col("_spread") < high, _confirm(F.col("_best.id")))
        .otherwise(_ask("QUESTION", _WHICH, _menu(labels)))
    )
    return _answer(df, rows, pred)


def motion_shares(ids: Column, objects: Column, history: Column, beta: float = 1.5, dir_w: float = 0.5) -> Column:
    """``[{p, order, id}]``: the motion-weighted prior over candidates (B8), uniform when nothing is known."""

    def value(cell: Column) -> Column:
        here, before = _cell_at(history, 1), _cell_at(history, 2)
        now = F.coalesce(cell_distance(here, cell), F.lit(0))
        step = F.when((before != here), cell_distance(before, cell) - now).otherwise(0)
        return -F.lit(beta) * now + F.lit(dir_w) * F.coalesce(step, F.lit(0))

    scored = F.when(F.size(history) > 0, scored_candidates(ids, objects, value))
    even = F.transform(
        ids, lambda c, i: F.struct((F.lit(1.0) / F.size(ids)).alias("p"), (-i).alias("order"), c.alias("id"))
    )
    return let(scored, lambda s: F.when(F.size(s) > 0, softmax(s)).otherwise(even))


def motion_prior(df: DataFrame, beta: float = 1.5, dir_w: float = 0.5, name: str = "prior") -> DataFrame:
    """Add the motion-weighted prior as ``[{id, p}]``."""
    shares = motion_shares(F.col("obs.memory.candidates"), F.col("obs.objects"), F.col("obs.gripper_hist"), beta, dir_w)
    found = once(df, {name: F.transform(shares, lambda s: F.struct(s["id"].alias("id"), s["p"].alias("p")))})
    return found.select(*[c for c in df.columns if c != name], name)


POLICIES: Mapping[str, Callable[[DataFrame], DataFrame]] = {
    "heuristic_ask_if_ambiguous": ask_if_ambiguous,
    "heuristic_always_ask": always_ask,
    "heuristic_predict_then_assist": predict_then_assist,
    "heuristic_bayesian_intent": bayes_intent,
}
