"""Stream jobs (R1-R8). Every job has a batch twin among the operators.

Windowed jobs run on Spark's own stateful operators; jobs that need the row before a row (R4, R5) on its keyed state (``keyed``). State is versioned and
replayed by Spark, so a lost executor or a restart changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from decisionlog.functions.draw import draw
from decisionlog.operators import commands as C
from decisionlog.operators.contracts import validate_contract
from decisionlog.operators.evaluate import COUNTERS
from decisionlog.operators.ordered import Order, by_time, previous, running
from decisionlog.operators.poses import alert_reason
from decisionlog.operators.questions import state_hash
from decisionlog.streaming.keyed import TOTALS, PreviousRow, Priors

#: buckets that keys with state are dealt to
KEY_BUCKETS = 128


def tail(spark: SparkSession, path: str, schema, fmt: str = "json", *, glob: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """A growing log directory as a stream (R1); ``files_per_batch`` bounds a micro-batch."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.format(fmt).load(path)


def command_rates(s: DataFrame, window: str = "1 hour", slide: str | None = None, watermark: str = "10 minutes", *, ts: str = "ts", keys: Sequence[str] = ("user_id",)) -> DataFrame:
    """Commands per key and event-time window (R2), tumbling or sliding; late rows fall to the watermark."""
    span = F.window(ts, window, slide) if slide else F.window(ts, window)
    counts = s.withWatermark(ts, watermark).groupBy(*keys, span.alias("_w")).agg(F.count("*").alias("commands"))
    return counts.select(*keys, F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), "commands")


def activity_sessions(s: DataFrame, gap: str = "30 seconds", watermark: str = "10 minutes", *, ts: str = "ts", keys: Sequence[str] = ("user_id",), chunk_seconds: int = 3600) -> DataFrame:
    """Bursts of activity (R3) as partial sessions: a key's rows of ``chunk_seconds``, cut where ``gap`` passes without a row.

    The state of a busy key is spread over its chunks. A session that goes on in the next chunk comes in parts that touch; :func:`whole_sessions` joins
    them in what the stream wrote.
    """
    part = F.floor(F.unix_seconds(F.col(ts)) / F.lit(chunk_seconds))
    rows = s.withWatermark(ts, watermark).withColumn("_part", part)
    found = rows.groupBy(*keys, "_part", F.session_window(ts, gap).alias("_w")).agg(F.count("*").alias("commands"))
    return found.select(*keys, F.col("_w.start").alias("session_start"), F.col("_w.end").alias("session_end"), "commands")


def whole_sessions(parts: DataFrame, keys: Sequence[str] = ("user_id",), chunk_seconds: int = 86_400) -> DataFrame:
    """Sessions from partial ones: intervals of a key that touch become one. Worked on in chunks, so a key may have any number of parts."""
    order = by_time("session_start", "session_end", width_seconds=chunk_seconds)
    rows = previous(parts, keys, order, {"_end": "session_end"})
    rows = rows.withColumn("_new", F.when(F.col("session_start") <= F.col("_end"), 0).otherwise(1).cast("bigint"))
    rows = running(rows, keys, order, {"_session": F.col("_new")})
    found = rows.groupBy(*keys, "_session").agg(F.min("session_start").alias("session_start"), F.max("session_end").alias("session_end"), F.sum("commands").alias("commands"))
    return found.drop("_session")


def _answered(truth: DataFrame, answers: DataFrame, key: str, ts: str, watermark: str) -> DataFrame:
    """Ground truth with its answer, null where none came in time."""
    a = truth.withWatermark(ts, watermark)
    b = answers.select(F.col(key).alias("_key"), F.col(ts).alias("_ts"), *[c for c in answers.columns if c not in (key, ts)]).withWatermark("_ts", watermark)
    near = (F.col("_ts") >= F.col(ts) - F.expr(f"interval {watermark}")) & (F.col("_ts") <= F.col(ts) + F.expr(f"interval {watermark}"))
    return a.join(b, (F.col(key) == F.col("_key")) & near, "left_outer").drop("_key", "_ts")


def running_accuracy(truth: DataFrame, answers: DataFrame, score: Callable[[DataFrame], DataFrame], *, key: str = "id", ts: str = "ts", watermark: str = "1 hour", window: str = "1 day", keys: Sequence[str] = ()) -> DataFrame:
    """Counters per event-time window of ground truth joined with predictions arriving on their own stream.

    A prediction may lie up to one watermark before or after its ground truth; both sides' state is dropped beyond. A ground
    truth that nobody answered in that time counts as missing.
    """
    both = _answered(truth, answers, key, ts, watermark)
    scored = score(both).groupBy(*keys, F.window(ts, window).alias("_w")).agg(*[F.sum(c).alias(c) for c in COUNTERS])
    return scored.select(*keys, F.col("_w.start").alias("window_start"), *COUNTERS)


def running_confusion(truth: DataFrame, answers: DataFrame, score: Callable[[DataFrame], DataFrame], *, key: str = "id", ts: str = "ts", watermark: str = "1 hour", window: str = "1 day", keys: Sequence[str] = ()) -> DataFrame:
    """Counts per event-time window of (true, predicted) tools (R6, second half): the outer join of the two streams, then a windowed grouping behind it.

    A ground truth that nobody answered in time counts under ``MISSING``; unreadable and invalid answers as in the batch twin. One small row per
    window and pair leaves the state.
    """
    scored = score(_answered(truth, answers, key, ts, watermark)).filter(F.col("gt_tool").isNotNull())
    labels = F.when(F.col("missing") == 1, F.array(F.lit("MISSING"))).otherwise(F.col("pred_labels"))
    counted = scored.select(*keys, ts, "gt_tool", F.explode(labels).alias("pred_tool")).filter(F.col("pred_tool").isNotNull())
    counts = counted.groupBy(*keys, F.window(ts, window).alias("_w"), "gt_tool", "pred_tool").agg(F.count("*").alias("n"))
    return counts.select(*keys, F.col("_w.start").alias("window_start"), "gt_tool", "pred_tool", "n")


def suppress_duplicates(s: DataFrame, watermark: str = "10 minutes", *, obs: str = "obs", ts: str = "ts") -> DataFrame:
    """One row per distinct state within the watermark."""
    return s.withColumn("state_hash", state_hash(obs)).withWatermark(ts, watermark).dropDuplicatesWithinWatermark(["state_hash"])


def validation_gate(s: DataFrame, good: str, bad: str, checkpoint: str, *, validate: Callable[[DataFrame], tuple[DataFrame, DataFrame]] = validate_contract, trigger: dict | None = None) -> StreamingQuery:
    """Valid rows to ``good``, violations to ``bad`` (R7), one directory per batch, overwritten on replay."""

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()  # read for both sides
        ok, rejected = validate(batch)
        ok.write.mode("overwrite").parquet(f"{good}/batch={number}")
        rejected.write.mode("overwrite").parquet(f"{bad}/batch={number}")
        batch.unpersist()

    return s.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _sortable(df: DataFrame, order: Order) -> tuple[DataFrame, list[str]]:
    """``df`` with the order columns as numbers or text that sort alike in a task."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    as_number = lambda c: F.unix_micros(F.col(c).cast("timestamp")) if kinds[c].startswith("timestamp") else F.col(c)
    names = {f"place{i}_": as_number(c) for i, c in enumerate(order.columns)}
    return df.withColumns(names), list(names)


def _ddl(df: DataFrame, columns: Sequence[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def live_previous(s: DataFrame, keys: Sequence[str], order: Order, values: dict[str, str], *, ttl: timedelta | None = None, buckets: int = KEY_BUCKETS) -> DataFrame:
    """A stream's rows with the values that the row before held (batch twin: ``ordered.previous``), ``_seen`` and ``_late``.

    Rows of a key come in order from batch to batch, in any order inside one; a row behind its key's last row is late and gets no values. After ``ttl``
    without a row a key's state ends, and its next row is a first one. A key with a null part is a key of its own. ``buckets`` stays as it is while a
    checkpoint is in use.
    """
    rows, places = _sortable(_dealt(s.select(_key(keys), "*"), buckets), order)
    named = {f"before{i}_": c for i, c in enumerate(values.values())}
    kinds = {n: rows.schema[c].dataType.simpleString() for n, c in named.items()}
    kept = ", ".join(f"{n} {kind}" for n, kind in kinds.items())
    out = ", ".join([_ddl(rows, rows.columns), kept, "seen_before boolean", "too_late boolean"])
    held = PreviousRow(places, _ddl(rows, places).replace("`", ""), named, kept, int(ttl.total_seconds() * 1000) if ttl else None)
    found = rows.groupBy("bucket_").transformWithStateInPandas(statefulProcessor=held, outputStructType=out, outputMode="Append", timeMode="ProcessingTime")
    return found.select(*s.columns, *[F.col(n).alias(v) for n, v in zip(named, values, strict=True)], F.col("seen_before").alias("_seen"), F.col("too_late").alias("_late"))


def _key(keys: Sequence[str]) -> Column:
    """The key columns as one text, nulls included."""
    return F.to_json(F.struct(*keys)).alias("of_key")


def _dealt(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.withColumn("bucket_", F.pmod(F.xxhash64("of_key"), F.lit(buckets)).cast("int"))


def live_decision_points(
    s: DataFrame, *, keys: Sequence[str], order: Order, p: float = 0.15, seed: int = 0, tool: str = "tool", candidates: str = "candidates", id_col: str = "id", ttl: timedelta | None = timedelta(days=30)
) -> DataFrame:
    """Decision points as rows arrive (R4): ``keys, id, alert_reason, late``. Start it inside ``keyed.keyed_state``, to read a log to its
    end with ``idle_batches=False``."""
    needed = [*keys, id_col, tool, candidates, *[c for c in order.columns if c not in (*keys, id_col, tool, candidates)]]
    rows = live_previous(s.select(*needed), keys, order, {"_tool": tool, "_cands": candidates}, ttl=ttl)
    token = draw(F.col(id_col).cast("string"), "alert", seed)
    reason = alert_reason(F.col("_seen"), F.col("_tool"), F.col("_cands"), F.col(candidates), token, p)
    return rows.select(*keys, id_col, F.when(~F.col("_late"), reason).alias("alert_reason"), F.col("_late").alias("late"))


def live_user_priors(
    s: DataFrame, *, trial: Sequence[str], order: Order, ts: str = "ts", watermark: str = "10 minutes", max_burst: float = C.MAX_BURST, buckets: int = KEY_BUCKETS
) -> DataFrame:
    """Totals of user priors so far, a row per trial whenever its rows fall behind the watermark (R5); read back with :func:`read_user_priors`.

    ``order`` begins with ``ts``. Rows may come in any order within the watermark; later ones are dropped and counted (:func:`dropped_rows`).
    Start it inside ``keyed.keyed_state``. ``buckets`` stays as it is while a checkpoint is in use.
    """
    if order.columns[0] != ts:
        raise ValueError("order: has to begin with the event time")
    rows, places = _sortable(s, order)
    numbers = [F.col("direction").cast("bigint").alias("direction"), F.col("stamp").cast("double").alias("stamp")]
    rows = rows.withWatermark(ts, watermark).select(_key(trial), ts, *places, "type", "command_mode", "axis", "active", "reason", *numbers)
    rows = _dealt(rows, buckets)
    waiting = _ddl(rows, [*places, "type", "command_mode", "axis", "active", "reason", "direction", "stamp"]).replace("`", "")
    found = rows.groupBy("bucket_").transformWithStateInPandas(
        statefulProcessor=Priors(places, waiting, max_burst), outputStructType=f"of_key string, {TOTALS}, rows long", outputMode="Append", timeMode="EventTime"
    )
    return found.withColumn("of_key", F.from_json("of_key", _ddl(s, trial))).select("of_key.*", *found.columns[1:])


def read_user_priors(totals: DataFrame, trial: Sequence[str]) -> DataFrame:
    """User priors from what :func:`live_user_priors` has written: each trial's newest totals."""
    kept = [c for c in totals.columns if c not in trial]
    newest = totals.groupBy(*trial).agg(F.max_by(F.struct(*kept), "rows").alias("_r")).select(*trial, "_r.*").drop("rows")
    return C.priors_from_totals([newest], trial)


def dropped_rows(query: StreamingQuery) -> int:
    """Rows that came too late for the state of a stream that has run, as its stateful operators count them; 0 only where none did."""
    return sum(o.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for o in p["stateOperators"])


def completed(written: DataFrame, log: DataFrame, job: Callable[[DataFrame], DataFrame], *, keys: Sequence[str] = ("user_id",), start: str = "window_start", ts: str = "ts") -> DataFrame:
    """What a windowed stream wrote, with the windows or sessions that were still open when it ended.

    ``job`` runs as its batch twin over the log's rows from each key's last written window on; a key without one is read whole.
    """
    last = written.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max(start).alias("_last"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] or [F.lit(True)]

    def after(rows: DataFrame, keep) -> DataFrame:
        return rows.join(last, same, "left").filter(F.col("_last").isNull() | keep).select(*rows.columns)

    rest = after(job(after(log, F.col(ts) >= F.col("_last"))), F.col(start) > F.col("_last"))
    return written.unionByName(rest.select(*written.columns))


def write_stream(s: DataFrame, out: str, checkpoint: str, *, trigger: dict | None = None) -> StreamingQuery:
    """A windowed stream to Parquet in append mode."""
    sink = s.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return sink.trigger(**(trigger or {"availableNow": True})).start()
