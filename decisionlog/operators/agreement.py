"""Annotator agreement."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ask_or_act(call: Column) -> Column:
    """``ASK`` for a question, ``ACT`` for any other tool."""
    return F.when(call["tool"] == "INTERACT", "ASK").otherwise("ACT")


def act_label(call: Column) -> Column:
    """``tool::object`` of an action; null for a question."""
    return F.when(call["tool"] != "INTERACT", F.concat(call["tool"], F.lit("::"), F.coalesce(call["args"]["obj"], F.lit(""))))


def align_raters(decisions: DataFrame, item: Sequence[str], rater: str, label: str, raters: Sequence[str], order: str) -> DataFrame:
    """One row per item that *every* rater judged, one label column per rater.

    Of several judgements of one rater on one item the last wins. One aggregate, no self-join; an item's labels may be
    null without the item being dropped.
    """
    own = [F.col(rater) == r for r in raters]
    last = [F.max_by(F.when(mine, F.struct(F.col(label).alias("l"))), F.when(mine, F.col(order))).alias(r) for mine, r in zip(own, raters)]
    wide = decisions.groupBy(*item).agg(*last)
    for r in raters:
        wide = wide.filter(F.col(f"`{r}`").isNotNull())
    return wide.select(*item, *[F.col(f"`{r}`.l").alias(r) for r in raters])


def contingency(aligned: DataFrame, raters: Sequence[str]) -> DataFrame:
    """``rater_a, rater_b, la, lb, n`` over items both labelled.

    Equal rows of labels are counted before they are unfolded into rater pairs.
    """
    counts = aligned.groupBy(*[F.col(f"`{r}`") for r in raters]).agg(F.count("*").alias("_n"))
    pairs = F.array(
        *[
            F.struct(
                F.lit(a).alias("rater_a"),
                F.lit(b).alias("rater_b"),
                F.col(f"`{a}`").cast("string").alias("la"),
                F.col(f"`{b}`").cast("string").alias("lb"),
            )
            for a, b in combinations(raters, 2)
        ]
    )
    rows = counts.select("_n", F.explode(pairs).alias("_p")).filter("_p.la is not null and _p.lb is not null")
    return rows.groupBy("_p.rater_a", "_p.rater_b", "_p.la", "_p.lb").agg(F.sum("_n").alias("n"))


def _kappa(observed: Column, expected: Column) -> Column:
    """(po - pe) / (1 - pe); 1 when both are 1, null when agreement by chance is certain but not observed."""
    return F.when(expected < 1.0, (observed - expected) / (1.0 - expected)).when(observed >= 1.0, F.lit(1.0))


def cohen_kappa(aligned: DataFrame, raters: Sequence[str]) -> DataFrame:
    """Cohen's kappa of every pair of raters (A28): ``rater_a, rater_b, n, kappa``.

    Pairs without a common labelled item have ``n`` 0 and a null kappa.
    """
    cells = contingency(aligned, raters)
    sides = F.array(
        F.struct(F.col("la").alias("label"), F.col("n").alias("a"), F.lit(0).cast("bigint").alias("b"), F.when(F.col("la") == F.col("lb"), F.col("n")).otherwise(0).alias("same")),
        F.struct(F.col("lb").alias("label"), F.lit(0).cast("bigint").alias("a"), F.col("n").alias("b"), F.lit(0).cast("bigint").alias("same")),
    )
    marginals = cells.select("rater_a", "rater_b", F.explode(sides).alias("_s")).groupBy("rater_a", "rater_b", "_s.label")
    marginals = marginals.agg(F.sum("_s.a").alias("a"), F.sum("_s.b").alias("b"), F.sum("_s.same").alias("same"))
    totals = marginals.groupBy("rater_a", "rater_b").agg(
        F.sum("a").alias("n"),
        F.sum("same").alias("_same"),
        F.sum(F.col("a").cast("double") * F.col("b").cast("double")).alias("_chance"),
    )
    n = F.col("n").cast("double")
    found = totals.select("rater_a", "rater_b", "n", _kappa(F.col("_same") / n, F.col("_chance") / (n * n)).alias("kappa"))
    every = aligned.sparkSession.createDataFrame(list(combinations(raters, 2)), "rater_a string, rater_b string")
    return every.join(found, ["rater_a", "rater_b"], "left").fillna(0, ["n"])


def fleiss_kappa(aligned: DataFrame, raters: Sequence[str]) -> DataFrame:
    """Fleiss' kappa over all raters (A29): one row ``items, raters, kappa``."""
    k = len(raters)
    labels = F.array(*[F.col(f"`{r}`").cast("string") for r in raters])
    counts = aligned.groupBy(*[F.col(f"`{r}`") for r in raters]).agg(F.count("*").alias("_n")).withColumn("_labels", labels)
    alike = F.aggregate(
        "_labels", F.lit(0), lambda acc, x: acc + F.size(F.filter("_labels", lambda y: y == x))
    )  # sum of squared category counts
    counts = counts.withColumn("_p", (alike - k) / F.lit(float(k * (k - 1))) if k > 1 else F.lit(None).cast("double"))
    shares = counts.select("_n", F.explode("_labels").alias("_label")).groupBy("_label").agg(F.sum("_n").alias("_c"))
    chance = shares.agg(F.sum(F.col("_c").cast("double") * F.col("_c")).alias("_sq"), F.sum("_c").alias("_all"))
    seen = counts.agg(F.sum("_n").alias("items"), (F.sum(F.col("_n") * F.col("_p")) / F.sum("_n")).alias("_observed"))
    both = seen.join(chance)  # two single-row aggregates
    expected = F.col("_sq") / (F.col("_all").cast("double") * F.col("_all"))
    return both.select(F.coalesce("items", F.lit(0)).alias("items"), F.lit(k).alias("raters"), _kappa(F.col("_observed"), expected).alias("kappa"))
