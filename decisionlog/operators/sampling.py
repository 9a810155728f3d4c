"""Rebalancing, exact splits and quotas, mixtures.

Draws are md5 tokens of the row id, so results do not depend on partitioning. Exact counts come from ranking tokens
inside a stratum, without sorting a stratum in one task: a histogram of the leading 16 bits finds the bucket a count is
reached in; whole buckets below it are kept as they are and only the rows of that one bucket are ranked.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from decisionlog.functions.draw import BUCKETS, bucket, draw, uniform
from decisionlog.operators.contracts import env_of
from decisionlog.schemas import ACTION_TOOLS

# Rows wanted per split, environment and tool.
TARGETS = {
    "train": {
        "reach_to_grasp_ycb": {"INTERACT": 140, "APPROACH": 40, "ALIGN_YAW": 20},
        "cube_stacking": {"INTERACT": 160, "STACK": 40},
        "pouring": {"INTERACT": 140, "GRAB": 40, "POUR": 20},
    },
    "valid": {
        "reach_to_grasp_ycb": {"INTERACT": 24, "APPROACH": 7, "ALIGN_YAW": 3},
        "cube_stacking": {"INTERACT": 26, "STACK": 7},
        "pouring": {"INTERACT": 23, "GRAB": 7, "POUR": 3},
    },
}


def rebalance(
    df: DataFrame, repeat: int = 10, keep_prob: float = 1.0, seed: int = 0, *, tool: str = "tool", id_col: str = "id"
) -> DataFrame:
    """Repeat action rows ``max(1, repeat)`` times with ids ``<id>_m<k>``; keep each question with ``keep_prob`` (G1).

    Rows of any other tool are dropped; :func:`rebalance_stats` counts them.
    """
    copies = F.sequence(F.lit(0), F.lit(max(1, int(repeat)) - 1))
    acts, asks = F.col(tool).isin(*ACTION_TOOLS), F.col(tool) == "INTERACT"
    keep = F.lit(True) if keep_prob >= 1.0 else uniform(draw(F.col(id_col), "rebalance", seed)) < keep_prob
    none = F.array().cast("array<int>")
    ks = F.when(acts, copies).when(asks & keep, F.array(F.lit(None).cast("int"))).otherwise(none)
    rows = df.withColumn("_k", F.explode(ks))
    new_id = F.when(F.col("_k").isNull(), F.col(id_col)).otherwise(F.concat(id_col, F.lit("_m"), F.col("_k").cast("string")))
    return rows.withColumn(id_col, new_id).drop("_k")


def rebalance_stats(
    df: DataFrame, repeat: int = 10, keep_prob: float = 1.0, seed: int = 0, *, tool: str = "tool", id_col: str = "id"
) -> DataFrame:
    """What :func:`rebalance` keeps, drops and writes, from one aggregate over its input."""
    acts = F.coalesce(F.col(tool).isin(*ACTION_TOOLS), F.lit(False))
    asks = F.coalesce(F.col(tool) == "INTERACT", F.lit(False))
    keep = F.lit(True) if keep_prob >= 1.0 else uniform(draw(F.col(id_col), "rebalance", seed)) < keep_prob

    def total(test: Column, name: str) -> Column:
        return F.coalesce(F.sum(test.cast("bigint")), F.lit(0)).alias(name)

    stats = df.agg(
        total(asks & keep, "kept_interact"),
        total(acts, "kept_motion"),
        total(asks & ~keep, "dropped_interact"),
        total(~acts & ~asks, "unknown"),
    )
    return stats.withColumn("written", F.col("kept_interact") + F.col("kept_motion") * F.lit(max(1, int(repeat))))


def _stratum(columns: Sequence[str]) -> Column:
    """One key for several columns, nulls apart from any value."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.concat_ws("\u0001", *parts)


def assign_by_rank(
    df: DataFrame, strata: Sequence[str], cuts: DataFrame, labels: Sequence[str], token: Column, name: str, ties: Sequence[str]
) -> DataFrame:
    """Label rows by their token rank inside a stratum.

    ``cuts`` has the strata columns and, per label, ``upto_<label>``: ranks above the previous label's bound and up to
    this one get the label. Rows beyond the last bound are left out. The number of strata is that of ``cuts``; a null
    stratum is one of them. The strata are joined as one text key, so that they never become a join without keys.
    """
    strata = list(strata)
    cuts = cuts.withColumn("_stratum", _stratum(strata)).drop(*strata)
    rows = df.withColumns({"_stratum": _stratum(strata), "_token": token}).withColumn("_bucket", bucket(F.col("_token")))
    strata = ["_stratum"]
    counts = rows.groupBy(*strata, "_bucket").agg(F.count("*").alias("_n"))
    along = Window.partitionBy(*strata).orderBy("_bucket")  # at most 65,536 rows per stratum
    counts = counts.withColumn("_end", F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    bounds = counts.join(cuts, strata)
    whole = Window.partitionBy(*strata)

    def reached(label: str) -> Column:
        bound = F.col(f"upto_{label}")
        inside = (bound > F.col("_end") - F.col("_n")) & (bound <= F.col("_end"))
        cut = F.min(F.when(inside, F.struct(F.col("_bucket").alias("bucket"), (F.col("_end") - F.col("_n")).alias("before")))).over(whole)
        # a bound of zero is reached before the first bucket, a bound beyond the stratum after the last
        nowhere = F.when(bound <= 0, F.lit(-1)).otherwise(F.lit(BUCKETS))
        return F.struct(
            F.lit(label).alias("label"),
            bound.alias("upto"),
            F.coalesce(cut["bucket"], nowhere).alias("bucket"),
            cut["before"].alias("before"),
        )

    # one row per stratum and bucket: joining on both spreads a large stratum over its buckets
    plan = bounds.select(*strata, "_bucket", F.array(*[reached(x) for x in labels]).alias("_cuts"))
    placed = rows.join(plan, [*strata, "_bucket"])
    on_edge = F.exists("_cuts", lambda c: c["bucket"] == F.col("_bucket"))
    inner = placed.filter(~on_edge).withColumn(
        name, F.get(F.filter("_cuts", lambda c: c["bucket"] > F.col("_bucket")), F.lit(0))["label"]
    )
    edge = placed.filter(on_edge)
    before = F.get(F.filter("_cuts", lambda c: c["bucket"] == F.col("_bucket")), F.lit(0))["before"]
    rank = before + F.row_number().over(Window.partitionBy(*strata, "_bucket").orderBy("_token", *ties))
    edge = edge.withColumn("_rank", rank)
    edge = edge.withColumn(name, F.get(F.filter("_cuts", lambda c: c["upto"] >= F.col("_rank")), F.lit(0))["label"])
    kept = [*df.columns, name]
    return inner.select(*kept).unionByName(edge.select(*kept)).filter(F.col(name).isNotNull())


def split_by_source(
    df: DataFrame, frac: float = 0.1, seed: int = 0, *, source: str = "source", id_col: str = "id", name: str = "split"
) -> DataFrame:
    """Add ``valid``/``train`` per source with ``min(max(1, round_half_even(n*frac)), n-1)`` validation rows.

    A source with fewer than two rows stops the job.
    """
    n = F.count("*")
    wanted = F.least(F.greatest(F.lit(1), F.bround(n * F.lit(float(frac)), 0).cast("bigint")), n - 1)
    few = F.raise_error(F.concat(F.lit("need at least two rows for source "), F.first(F.col(source).cast("string")))).cast("bigint")
    sizes = df.groupBy(source).agg(F.when(n < 2, few).otherwise(wanted).alias("upto_valid"), n.alias("upto_train"))
    return assign_by_rank(df, [source], sizes, ["valid", "train"], draw(F.col(id_col), "split", seed), name, [id_col])


def _one_stratum(df: DataFrame, id_col: str) -> DataFrame:
    """All rows in stratum 0. Not a literal: the optimiser would turn a join on it into a cross join."""
    return df.withColumn("_all", F.pmod(F.xxhash64(id_col), F.lit(1).cast("bigint")))


def auto_split(df: DataFrame, frac: float = 0.05, seed: int = 0, *, id_col: str = "id", name: str = "split") -> DataFrame:
    """A validation split of the whole table (G4); a table of one row is all training."""
    n = F.count("*")
    wanted = F.when(n >= 2, F.least(F.greatest(F.lit(1), F.bround(n * F.lit(float(frac)), 0).cast("bigint")), n - 1)).otherwise(0)
    rows = _one_stratum(df, id_col)
    sizes = rows.groupBy("_all").agg(wanted.alias("upto_valid"), n.alias("upto_train"))
    return assign_by_rank(rows, ["_all"], sizes, ["valid", "train"], draw(F.col(id_col), "split", seed), name, [id_col]).drop("_all")


def quotas(spark, targets: Mapping[str, Mapping[str, Mapping[str, int]]] = TARGETS, train_scale: int = 1, valid_scale: int = 1) -> DataFrame:
    """Quota table ``env, tool, train, valid`` from nested targets."""
    wanted: dict[tuple[str, str], dict[str, int]] = {}
    for split, scale in (("train", train_scale), ("valid", valid_scale)):
        for env, tools in targets.get(split, {}).items():
            for tool, count in tools.items():
                wanted.setdefault((env, tool), {"train": 0, "valid": 0})[split] = count * scale
    rows = [(env, tool, c["train"], c["valid"]) for (env, tool), c in wanted.items()]
    return spark.createDataFrame(rows, "env string, tool string, train bigint, valid bigint")


def quota_split(df: DataFrame, targets: DataFrame, seed: int = 0, *, id_col: str = "id", name: str = "split") -> DataFrame:
    """Draw exactly the wanted rows per (env, tool), training first, then validation.

    A bucket with too few rows stops the job, naming it.
    """
    keys = ["env", "tool"]
    needed = F.col("train") + F.col("valid")
    cuts = targets.select(*keys, F.col("train").alias("upto_train"), needed.alias("upto_valid"))
    out = assign_by_rank(df, keys, cuts, ["train", "valid"], draw(F.col(id_col), "quota", seed), name, [id_col])
    # Checked on the quota side, so that a bucket without any row is noticed; adds no rows.
    sizes = targets.join(df.groupBy(*keys).agg(F.count("*").alias("_n")), keys, "left").fillna(0, ["_n"])
    short = F.format_string("need %d rows for %s/%s; found %d", needed, F.col("env"), F.col("tool"), F.col("_n"))
    stop = sizes.filter(F.col("_n") < needed).filter(F.raise_error(short).cast("boolean"))
    return out.unionByName(stop.select(*[F.lit(None).cast(t).alias(c) for c, t in out.dtypes]))


def uniform_sample(df: DataFrame, n: int, seed: int = 0, *, id_col: str = "id") -> DataFrame:
    """Exactly ``n`` rows (or all) without replacement (K4)."""
    rows = _one_stratum(df, id_col)
    cuts = df.sparkSession.createDataFrame([(0, int(n))], "_all bigint, upto_kept bigint")
    return assign_by_rank(rows, ["_all"], cuts, ["kept"], draw(F.col(id_col), "sample", seed), "_label", [id_col]).drop("_all", "_label")


def head_sample(df: DataFrame, n: int, position: str = "seq") -> DataFrame:
    """The first ``n`` rows by line number; ``n <= 0`` keeps all (K3)."""
    return df.filter(F.col(position) <= n) if n > 0 else df


def split_by_env(df: DataFrame, id_col: str = "id") -> DataFrame:
    """Add ``env`` from the id, ready for one directory per environment and split."""
    wrong = F.raise_error(F.concat(F.lit("cannot infer the environment of id "), F.col(id_col))).cast("string")
    return df.withColumn("env", F.coalesce(env_of(F.col(id_col)), wrong))


def mix(sources: Mapping[str, tuple[DataFrame, int, float]], seed: int = 0) -> DataFrame:
    """Union of sources, each rebalanced with its own (repeat, keep probability).

    With a repeat of 1 rows keep their ids.
    """
    parts = []
    for name, (df, repeat, keep) in sources.items():
        known = df.filter(F.col("tool").isin("INTERACT", *ACTION_TOOLS))
        part = rebalance(known, repeat, keep, seed) if repeat > 1 or keep < 1.0 else known
        parts.append(part.withColumn("mixture_source", F.lit(name)))
    return union_sources(*parts)


def union_sources(*frames: DataFrame) -> DataFrame:
    """All rows of several sources, columns by name, absent ones null."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out
