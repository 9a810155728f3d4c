"""Dataset profiles: distributions, shapes, similarity, runs, flip-flops."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decisionlog.functions.jsontext import items, member, members, strict_json
from decisionlog.functions.text import ratio, strip
from decisionlog.operators.ordered import Order, repeats, trailing


def distribution(df: DataFrame, value: str, keys: Sequence[str] = (), *, absent: str | None = None) -> DataFrame:
    """Counts per value, per ``keys`` (A1, A2). Nulls count as ``absent``, or are left out when it is None."""
    rows = df.filter(F.col(value).isNotNull()) if absent is None else df.fillna(absent, [value])
    return rows.groupBy(*keys, value).agg(F.count("*").alias("n"))


def crosstab(df: DataFrame, rows: str, columns: str, keys: Sequence[str] = (), absent: str = "none") -> DataFrame:
    """Counts of two values together, an absent row value becoming ``absent`` (A2)."""
    return df.fillna(absent, [rows]).groupBy(*keys, rows, columns).agg(F.count("*").alias("n"))


def contract_facts(df: DataFrame) -> DataFrame:
    """Add the profiled facts of contract rows: ``tool, mode, interact_kind, object_shapes, dialog_shapes`` (A3).

    A shape is the sorted key list of a JSON object; the two shape columns are arrays, one entry per object or turn.
    """
    rows = df.withColumn("_in", members(strict_json(F.col("input")))).withColumn("_out", members(strict_json(F.col("output"))))
    tool = F.try_variant_get(member(F.col("_out"), "tool"), "$", "string")
    kind = F.try_variant_get(member(members(member(F.col("_out"), "args")), "kind"), "$", "string")
    mode = F.try_variant_get(member(members(member(F.col("_in"), "user_state")), "mode"), "$", "string")

    def shapes(values: Column) -> Column:
        return F.transform(values, lambda v: F.concat_ws(",", F.array_sort(F.map_keys(members(v)))))

    turns = items(member(members(member(F.col("_in"), "memory")), "past_dialogs"))
    return rows.select(
        *df.columns,
        tool.alias("tool"),
        mode.alias("mode"),
        F.when(tool == "INTERACT", kind).alias("interact_kind"),
        shapes(items(member(F.col("_in"), "objects"))).alias("object_shapes"),
        shapes(turns).alias("dialog_shapes"),
    )


def long_values(df: DataFrame, values: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """One row per (dim, value): scalar columns as they are, array columns one row per entry; nulls left out."""
    types = dict(df.dtypes)

    def entries(c: str) -> Column:
        column = F.col(c) if types[c].startswith("array") else F.array(c)
        return F.transform(column, lambda v: F.struct(F.lit(c).alias("dim"), v.cast("string").alias("value")))

    every = F.concat(*[F.coalesce(entries(c), F.array().cast("array<struct<dim:string,value:string>>")) for c in values])
    return df.select(*keys, F.explode(every).alias("_e")).select(*keys, "_e.*").filter(F.col("value").isNotNull())


def distributions(df: DataFrame, values: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Counts of several columns in one pass: ``keys, dim, value, n``."""
    return long_values(df, values, keys).groupBy(*keys, "dim", "value").agg(F.count("*").alias("n"))


def similarity(a: DataFrame, b: DataFrame, values: Sequence[str]) -> DataFrame:
    """Largest difference between the value shares of two datasets, per column (A4)."""
    both = long_values(a, values).withColumn("_a", F.lit(1)).withColumn("_b", F.lit(0))
    both = both.unionByName(long_values(b, values).withColumn("_a", F.lit(0)).withColumn("_b", F.lit(1)))
    counts = both.groupBy("dim", "value").agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    totals = counts.groupBy("dim").agg(F.sum("_a").alias("_ta"), F.sum("_b").alias("_tb"))
    share_a = F.round(ratio(F.col("_a"), F.col("_ta")), 6)
    share_b = F.round(ratio(F.col("_b"), F.col("_tb")), 6)
    found = counts.join(totals, "dim").groupBy("dim").agg(F.round(F.max(F.abs(share_a - share_b)), 6).alias("max_abs_prop_delta"))
    # a column without any value in either dataset differs by nothing
    every = a.sparkSession.createDataFrame([(v,) for v in values], "dim string")
    return every.join(found, "dim", "left").fillna(0.0, ["max_abs_prop_delta"])


def dataset_summary(df: DataFrame, split: str = "split", dims: Sequence[str] = ("tool", "env", "mode")) -> DataFrame:
    """Rows per split and its distributions: ``split, dim, value, n`` from one grouping-sets aggregate (A5)."""
    sets = [[F.col(split), F.col(d)] for d in dims] + [[F.col(split)]]
    counted = df.groupingSets(sets, F.col(split), *[F.col(d) for d in dims]).agg(
        F.count("*").alias("n"), *[F.grouping(d).alias(f"_g_{d}") for d in dims]
    )
    dim, value = F.lit("rows"), F.lit("all")
    for d in dims:
        dim = F.when(F.col(f"_g_{d}") == 0, F.lit(d)).otherwise(dim)
        value = F.when(F.col(f"_g_{d}") == 0, F.col(d)).otherwise(value)
    return counted.select(F.col(split), dim.alias("dim"), value.alias("value"), "n")


def reply_distribution(turns: DataFrame, *, by_context: bool = True, content: str = "content", role: str = "role", context: str = "context") -> DataFrame:
    """User replies in total and by kind, per prompt context or overall."""
    reply = F.upper(strip(F.col(content)))

    def counted(test: Column, name: str) -> Column:
        return F.sum(F.coalesce(test, F.lit(False)).cast("bigint")).alias(name)

    rows = turns.filter(F.col(role) == "user")
    if by_context:
        rows = rows.withColumn(context, F.coalesce(context, F.lit("unknown")))
    return rows.groupBy(*([context] if by_context else [])).agg(
        F.count("*").alias("replies"),
        counted(reply == "YES", "yes"),
        counted(reply == "NO", "no"),
        counted(reply == "NONE OF THEM", "none_of_them"),
        counted(reply == "APPROACH", "mode_approach"),
        counted(reply == "ALIGN_YAW", "mode_align_yaw"),
    )


def reply_keywords(df: DataFrame, reply: str = "reply", keys: Sequence[str] = ()) -> DataFrame:
    """Replies containing each key word; ``NONE`` contains ``NO`` and counts for both."""
    text = F.upper(F.col(reply))
    words = {"yes": "YES", "no": "NO", "none_of_them": "NONE", "ok": "OK"}
    return df.groupBy(*keys).agg(
        *[F.sum(F.coalesce(F.contains(text, F.lit(w)), F.lit(False)).cast("bigint")).alias(n) for n, w in words.items()]
    )


def episode_lengths(df: DataFrame, episode: str = "episode_id") -> DataFrame:
    """Rows, episodes and the shortest, longest and mean episode."""
    return df.groupBy(episode).agg(F.count("*").alias("_n")).agg(
        F.sum("_n").alias("rows"),
        F.count("*").alias("episodes"),
        F.min("_n").alias("min_len"),
        F.max("_n").alias("max_len"),
        F.avg("_n").alias("avg_len"),
    )


def first_row(df: DataFrame, keys: Sequence[str], order: Order, columns: Sequence[str] | None = None) -> DataFrame:
    """The first row of each key (W1), as a partial aggregate: nothing is sorted and no key is gathered."""
    kept = [c for c in (columns or df.columns) if c not in keys]
    head = F.min_by(F.struct(*kept), order.key).alias("_head")
    return df.groupBy(*keys).agg(head).select(*keys, "_head.*")


def object_overlap(df: DataFrame, order: Order, episode: str = "episode_id", objects: str = "objects") -> DataFrame:
    """How often objects share a cell in the first record of an episode."""
    heads = first_row(df, [episode], order, [objects])
    cells = heads.select(episode, F.explode_outer(objects).alias("_o")).groupBy(episode, "_o.cell").agg(F.count("*").alias("_n"))
    return cells.groupBy(episode).agg(F.max("_n").alias("_most")).agg(
        F.count("*").alias("episodes"),
        F.sum((F.col("_most") >= 2).cast("bigint")).alias("episodes_with_overlap"),
        F.avg((F.col("_most") >= 2).cast("double")).alias("overlap_rate"),
        F.min("_most").alias("min_sharing"),
        F.max("_most").alias("max_sharing"),
        F.avg("_most").alias("avg_sharing"),
    )


def label_coverage(df: DataFrame, order: Order, n: int = 10, episode: str = "episode_id", objects: str = "objects") -> DataFrame:
    """The most frequent object labels over first records, ties in order of appearance."""
    heads = df.groupBy(episode).agg(F.min_by(objects, order.key).alias("_objects"), F.min(order.key).alias("_first"))
    labels = heads.select("_first", F.posexplode("_objects").alias("_at", "_o")).select("_first", "_at", F.col("_o.label").alias("label"))
    return top_values(labels, "label", n, ("_first", "_at"))


def symbol_coverage(df: DataFrame, history: str = "gripper_hist", candidates: str | None = "memory.candidates") -> DataFrame:
    """Counts of pose symbols over all history entries and of candidate-set sizes: ``symbol, value, n`` (A10)."""
    parts = [
        F.flatten(F.transform(history, lambda p: F.array(*[F.struct(F.lit(s).alias("symbol"), p[s].alias("value")) for s in ("cell", "yaw", "z")])))
    ]
    if candidates:
        size = F.coalesce(F.size(candidates), F.lit(0)).cast("string")
        parts.append(F.array(F.struct(F.lit("candidates").alias("symbol"), size.alias("value"))))
    return (
        df.select(F.explode(F.concat(*parts)).alias("_s"))
        .filter(F.col("_s.value").isNotNull())
        .groupBy(F.col("_s.symbol").alias("symbol"), F.col("_s.value").alias("value"))
        .agg(F.count("*").alias("n"))
    )


def longest_run(df: DataFrame, value: Column | str, keys: Sequence[str], order: Order) -> DataFrame:
    """Longest run of equal neighbours per key."""
    return repeats(df, keys, order, value).select(*keys, "longest_run")


def duplicate_transitions(df: DataFrame, value: Column | str, keys: Sequence[str], order: Order) -> DataFrame:
    """Neighbouring rows with the same non-null value, per key."""
    return repeats(df, keys, order, value).select(*keys, "duplicate_transitions")


def worst_runs(df: DataFrame, order: Order, values: dict[str, Column | str], episode: str = "episode_id") -> DataFrame:
    """For each named value the episode with the longest run: ``what, episode, run``.

    Between equal runs the episode that appears first wins.
    """
    first = df.groupBy(episode).agg(F.min(order.key).alias("_first"))
    found = None
    for what, value in values.items():
        runs = repeats(df, [episode], order, value).join(first, episode)
        best = runs.orderBy(F.desc("longest_run"), "_first").limit(1)
        best = best.select(F.lit(what).alias("what"), F.col(episode).alias("episode"), F.col("longest_run").alias("run"))
        found = best if found is None else found.unionByName(best)
    return found


def _flips(last_four: Column) -> Column:
    """Last four turns ask the same thing twice and hear YES once and NO once."""
    roles = F.transform(last_four, lambda t: t["role"])
    said = F.transform(last_four, lambda t: strip(F.coalesce(t["content"], F.lit(""))))
    replies = F.array_sort(F.array(F.upper(F.get(said, F.lit(1))), F.upper(F.get(said, F.lit(3)))))
    pattern = roles == F.array(*[F.lit(r) for r in ("assistant", "user", "assistant", "user")])
    same = F.get(said, F.lit(0)) == F.get(said, F.lit(2))
    return F.coalesce(pattern & same & (replies == F.array(F.lit("NO"), F.lit("YES"))), F.lit(False))


def snapshot_flip_flops(df: DataFrame, episode: str = "episode_id", turns: str = "memory.past_dialogs") -> DataFrame:
    """Snapshots per episode whose dialogue ends in a YES/NO flip-flop."""
    last = F.slice(turns, F.greatest(F.size(turns) - 3, F.lit(1)), 4)
    flips = F.when(F.size(turns) >= 4, _flips(last)).otherwise(F.lit(False))
    return df.groupBy(episode).agg(F.sum(flips.cast("bigint")).alias("flip_flops"))


def flip_flops(turns: DataFrame, episode: str, order: Order, role: str = "role", content: str = "content") -> DataFrame:
    """The same on a turn log: places per episode where a flip-flop is completed."""
    said = F.struct(F.col(role).alias("role"), F.col(content).alias("content"))
    rows = trailing(turns.select(episode, role, content, *[c for c in order.columns if c not in (episode, role, content)]), [episode], order, said, 4, "_last", include_current=True)
    return rows.groupBy(episode).agg(F.sum(_flips(F.col("_last")).cast("bigint")).alias("flip_flops"))


def top_values(df: DataFrame, value: str, n: int, order: Sequence[str]) -> DataFrame:
    """The ``n`` most frequent values; equal counts keep first-seen order (K1)."""
    counts = df.groupBy(value).agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("_first"))
    return counts.orderBy(F.desc("n"), "_first").limit(n).drop("_first")
