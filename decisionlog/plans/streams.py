"""Stream jobs over the benchmark events, read back as tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from decisionlog.operators.evaluate import score
from decisionlog.plans import views as V
from decisionlog.plans.evaluation import _ALERT, _MAX_BURST, CONFUSION_LABELS, PRIORS_SQL
from decisionlog.plans.registry import query
from decisionlog.plans.views import shared_folder
from decisionlog.streaming import jobs as J
from decisionlog.streaming.keyed import keyed_state


BATCHES = 12
_logs: dict[tuple[str, str], str] = {}


def _log_folder(spark, directory: str) -> str:
    """The events as a log of ``BATCHES`` files, each later than the one before; written once per session.

    A file source takes files by their time of writing, so the parts are appended one after another.
    """
    key = (spark.sparkContext.applicationId, directory)
    if key not in _logs:
        folder = shared_folder(spark)
        rows = spark.read.parquet(f"{directory}/events.parquet")
        rows.repartitionByRange(BATCHES, "ts").withColumn("_part", F.spark_partition_id()).write.partitionBy("_part").parquet(f"{folder}/parts")
        parts = spark.read.parquet(f"{folder}/parts")
        for i in range(BATCHES):
            parts.filter(F.col("_part") == i).drop("_part").coalesce(1).write.mode("append").parquet(f"{folder}/log")
        _logs[key] = f"{folder}/log"
    return _logs[key]


class _Stream(V.Tables):
    """The tables with ``events`` as a stream of one file a batch, its time as an event time."""

    @property
    def events(self):
        schema = self.spark.read.parquet(f"{self.directory}/events.parquet").schema
        rows = J.tail(self.spark, _log_folder(self.spark, self.directory), schema, "parquet", files_per_batch=1)
        return rows.withColumn("ts", F.col("ts").cast("timestamp"))


class _Log(V.Tables):
    """The tables with ``events`` as the stream has them, read at once."""

    @property
    def events(self):
        return self.spark.read.parquet(f"{self.directory}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def _finish(query) -> None:
    query.awaitTermination()


def _stored(t, s):
    """Run a stream to its end and read what it wrote."""
    folder = shared_folder(t.spark)
    _finish(J.write_stream(s, f"{folder}/out", f"{folder}/checkpoint"))
    return t.spark.read.parquet(f"{folder}/out")


def _closed(start: str, end: str, by: int) -> str:
    """Windows end before the watermark when the stream stops: the largest event time less the delay."""
    return f"SELECT * FROM ({start}) WHERE {end} <= (SELECT epoch_us(max(ts)) // 1000000 - {by} FROM events)"


@query(_closed("SELECT user_id, CAST(epoch_us(ts) // 1000000 // 86400 * 86400 AS BIGINT) AS starts, COUNT(*) AS commands FROM events GROUP BY 1, 2", "starts + 86400", 600))
def stream_windows(t):
    rows = _stored(t, J.command_rates(_Stream(t.spark, t.directory).events, "1 day"))
    return rows.select("user_id", F.unix_seconds("window_start").alias("starts"), "commands")


@query(
    _closed(
        """SELECT user_id, starts, COUNT(*) AS commands FROM (SELECT user_id, unnest([CAST(s AS BIGINT) // 43200 * 43200, CAST(s AS BIGINT) // 43200 * 43200 - 43200]) AS starts
        FROM (SELECT user_id, epoch_us(ts) // 1000000 AS s FROM events)) GROUP BY user_id, starts""",
        "starts + 86400",
        600,
    )
)
def stream_sliding_windows(t):
    rows = _stored(t, J.command_rates(_Stream(t.spark, t.directory).events, "1 day", "12 hours"))
    return rows.select("user_id", F.unix_seconds("window_start").alias("starts"), "commands")


@query(
    """SELECT user_id, MIN(us) AS starts, COUNT(*) AS commands FROM (SELECT *, SUM(brk) OVER (PARTITION BY user_id ORDER BY us, event_id) AS s FROM (
    SELECT user_id, event_id, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) < 21600000000 THEN 0 ELSE 1 END AS brk FROM events))
    GROUP BY user_id, s HAVING MAX(us) + 21600000000 <= (SELECT epoch_us(max(ts)) // 1000 * 1000 - 600000000 FROM events)"""
)
def stream_sessions(t):
    rows = J.whole_sessions(_completed(t, lambda s: J.activity_sessions(s, "6 hours"), start="session_start"))
    # a session that the watermark has passed when the stream stops
    end = _Log(t.spark, t.directory).events.agg((F.unix_millis(F.max("ts")) - 600_000).alias("ms")).first()["ms"]
    return rows.filter(F.unix_micros("session_end") <= F.lit(end) * 1000).select("user_id", F.unix_micros("session_start").alias("starts"), "commands")


@query(
    f"""SELECT event_id, {_ALERT} AS alert_reason FROM (SELECT *, lag(tool) OVER w AS tb, lag(c1) OVER w AS b1, lag(c2) OVER w AS b2 FROM ticks
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))""",
    "ticks",
)
def stream_decision_points(t):
    s = V.ticks(_Stream(t.spark, t.directory))
    points = J.live_decision_points(s, keys=V.USER, order=V.event_order(), id_col="event_id")
    with keyed_state(t.spark, idle_batches=False):
        return _stored(t, points).select("event_id", "alert_reason")


@query(PRIORS_SQL, "commands")
def stream_priors(t):
    # the log is in order: without a delay the last batch moves the watermark to its end, and every timer fires
    s = J.live_user_priors(V.commands(_Stream(t.spark, t.directory)), trial=V.USER, order=V.event_order(), watermark="0 seconds", max_burst=_MAX_BURST)
    with keyed_state(t.spark):
        return J.read_user_priors(_stored(t, s), V.USER)


@query(
    _closed("SELECT CAST(epoch_us(ts) // 1000000 // 86400 * 86400 AS BIGINT) AS starts, COUNT(*) AS n, CAST(SUM(tool_correct) AS BIGINT) AS tool_correct, CAST(SUM(json_errors) AS BIGINT) AS json_errors FROM scored GROUP BY 1", "starts + 86400", 3600),
    "scored",
)
def stream_accuracy(t):
    calls = V.logged_calls(_Stream(t.spark, t.directory))
    truth, answers = calls.select("id", "ts", "output"), V.logged_calls(_Stream(t.spark, t.directory)).select("id", "ts", "raw")
    rows = _stored(t, J.running_accuracy(truth, answers, score))
    return rows.select(F.unix_seconds("window_start").alias("starts"), "n", "tool_correct", "json_errors")


# ---- the same with what is open when the log ends


def _completed(t, job, **how):
    return J.completed(_stored(t, job(_Stream(t.spark, t.directory).events)), _Log(t.spark, t.directory).events, job, **how)


@query("SELECT user_id, CAST(epoch_us(ts) // 1000000 // 86400 * 86400 AS BIGINT) AS starts, COUNT(*) AS commands FROM events GROUP BY 1, 2")
def stream_windows_whole(t):
    rows = _completed(t, lambda s: J.command_rates(s, "1 day"))
    return rows.select("user_id", F.unix_seconds("window_start").alias("starts"), "commands")


@query(
    """SELECT user_id, starts, COUNT(*) AS commands FROM (SELECT user_id, unnest([CAST(s AS BIGINT) // 43200 * 43200, CAST(s AS BIGINT) // 43200 * 43200 - 43200]) AS starts
    FROM (SELECT user_id, epoch_us(ts) // 1000000 AS s FROM events)) GROUP BY user_id, starts"""
)
def stream_sliding_windows_whole(t):
    rows = _completed(t, lambda s: J.command_rates(s, "1 day", "12 hours"))
    return rows.select("user_id", F.unix_seconds("window_start").alias("starts"), "commands")


@query(
    """SELECT user_id, MIN(us) AS starts, COUNT(*) AS commands FROM (SELECT *, SUM(brk) OVER (PARTITION BY user_id ORDER BY us, event_id) AS s FROM (
    SELECT user_id, event_id, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) < 21600000000 THEN 0 ELSE 1 END AS brk FROM events))
    GROUP BY user_id, s"""
)
def stream_sessions_whole(t):
    rows = J.whole_sessions(_completed(t, lambda s: J.activity_sessions(s, "6 hours"), start="session_start"))
    return rows.select("user_id", F.unix_micros("session_start").alias("starts"), "commands")


@query(
    "SELECT CAST(epoch_us(ts) // 1000000 // 86400 * 86400 AS BIGINT) AS starts, COUNT(*) AS n, CAST(SUM(tool_correct) AS BIGINT) AS tool_correct, CAST(SUM(json_errors) AS BIGINT) AS json_errors FROM scored GROUP BY 1",
    "scored",
)
def stream_accuracy_whole(t):
    calls, log = V.logged_calls(_Stream(t.spark, t.directory)), V.logged_calls(_Log(t.spark, t.directory))
    again = V.logged_calls(_Stream(t.spark, t.directory)).select("id", "ts", "raw")
    rows = _stored(t, J.running_accuracy(calls.select("id", "ts", "output"), again, score))
    # only the ground truth is cut; answers may lie before the window
    rows = J.completed(rows, log.select("id", "ts", "output"), lambda s: J.running_accuracy(s, log.select("id", "ts", "raw"), score), keys=())
    return rows.select(F.unix_seconds("window_start").alias("starts"), "n", "tool_correct", "json_errors")


@query(
    f"""SELECT CAST(epoch_us(ts) // 1000000 // 86400 * 86400 AS BIGINT) AS starts, gt_tool, pred_tool, COUNT(*) AS n FROM (
    SELECT ts, gt_tool, unnest(CASE WHEN k % 11 = 0 THEN ['MISSING'] ELSE {CONFUSION_LABELS} END) AS pred_tool FROM scored WHERE gt_ok) GROUP BY 1, 2, 3""",
    "scored",
)
def stream_confusion(t):
    """Of every eleventh event the answer never comes."""

    def sides(tables):
        calls = V.logged_calls(tables)
        return calls.select("id", "ts", "output"), calls.filter(F.col("k") % 11 != 0).select("id", "ts", "raw")

    truth, _ = sides(_Stream(t.spark, t.directory))
    _, answers = sides(_Stream(t.spark, t.directory))
    rows = _stored(t, J.running_confusion(truth, answers, score))
    whole, given = sides(_Log(t.spark, t.directory))
    rows = J.completed(rows, whole, lambda s: J.running_confusion(s, given, score), keys=())
    return rows.select(F.unix_seconds("window_start").alias("starts"), "gt_tool", "pred_tool", "n")


@query("SELECT CASE WHEN event_type = 'error' AND k % 3 = 0 THEN 'bad' ELSE 'good' END AS gate, COUNT(*) AS n FROM ev GROUP BY 1", "ev")
def stream_gate(t):
    folder = shared_folder(t.spark)
    calls = V.logged_calls(_Stream(t.spark, t.directory))
    rows = calls.select(F.col("id").cast("string").alias("id"), F.lit("i").alias("instruction"), F.lit("").alias("input"), "output")
    _finish(J.validation_gate(rows, f"{folder}/good", f"{folder}/bad", f"{folder}/checkpoint"))
    found = [t.spark.read.parquet(f"{folder}/{g}").select(F.lit(g).alias("gate")) for g in ("good", "bad")]
    return found[0].unionByName(found[1]).groupBy("gate").agg(F.count("*").alias("n"))


@query("SELECT COUNT(*) AS states FROM (SELECT DISTINCT k % 4 = 0, k % 2 = 0 FROM ev)", "ev")
def stream_states(t):
    p = V.poses(_Stream(t.spark, t.directory))
    objects = F.array().cast("array<struct<id:string,cell:string,yaw:string>>")
    none = F.array().cast("array<string>")
    obs = F.struct(objects.alias("objects"), F.array(F.struct("cell", "yaw", "z")).alias("gripper_hist"), F.struct(none.alias("candidates"), none.alias("excluded_obj_ids")).alias("memory"))
    rows = _stored(t, J.suppress_duplicates(p.select("ts", obs.alias("obs")), "60 days").select("state_hash"))
    return rows.agg(F.count("*").alias("states"))
