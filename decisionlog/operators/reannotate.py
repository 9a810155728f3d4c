"""Re-annotation of recorded episodes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decisionlog.operators.ordered import Order, by_number, position, running


def episode_slice(
    df: DataFrame,
    order: Order,
    *,
    episode: str = "episode_id",
    skip_episodes: int = 0,
    max_episodes: int | None = None,
    skip_records: int = 0,
    max_records: int | None = None,
    chunk_size: int = 1_000_000,
) -> DataFrame:
    """Records in episode order, episodes by first appearance, cut by episode and then by record.

    Adds ``episode_no`` and ``record_no``, both from 0. The first order column must be numeric. Episodes are ranked and
    their sizes summed in ranges, so no task sees all of them.
    """
    first = order.columns[0]
    heads = df.groupBy(episode).agg(F.min(first).alias("_first"), F.count("*").alias("_n"))
    heads = position(heads, [], by_number("_first", episode, size=chunk_size), "_no").withColumn("episode_no", F.col("_no") - 1)
    heads = heads.filter(F.col("episode_no") >= skip_episodes)
    if max_episodes is not None:
        heads = heads.filter(F.col("episode_no") < skip_episodes + max_episodes)
    sized = running(heads, [], by_number("_no", size=chunk_size), {"_upto": F.col("_n")})
    starts = sized.select(episode, "episode_no", (F.col("_upto") - F.col("_n")).alias("_start"))
    rows = position(df.join(starts, episode), [episode], order, "_at")
    rows = rows.withColumn("record_no", F.col("_start") + F.col("_at") - 1 - F.lit(skip_records)).filter("record_no >= 0")
    if max_records is not None:
        rows = rows.filter(F.col("record_no") < max_records)
    return rows.select(*df.columns, "episode_no", "record_no")


def merge_reannotation(
    decisions: DataFrame,
    annotations: DataFrame,
    *,
    keys: Sequence[str] = ("episode_id", "tick_idx"),
    call: str = "target_tool_call",
    annotated: str = "tool_call",
    only_interact: bool = True,
) -> DataFrame:
    """Annotators' calls in place of the recorded questions (J12): adds ``tool_call`` and ``alert_reason``.

    Motions keep their recorded call (``auto_motion``) unless ``only_interact`` is off. A question nobody answered keeps
    its recorded call (``unanswered``).
    """
    given = annotations.select(*keys, F.struct(annotated).alias("_given"))
    rows = decisions.join(given, list(keys), "left")
    asked = (F.col(f"{call}.tool") == "INTERACT") if only_interact else F.lit(True)
    answered = asked & F.col("_given").isNotNull()
    return rows.select(
        *decisions.columns,
        F.when(answered, F.col(f"_given.{annotated}")).otherwise(F.col(call)).alias("tool_call"),
        F.when(~asked, "auto_motion").when(answered, "replay").otherwise("unanswered").alias("alert_reason"),
    )
