"""Stream jobs over several micro-batches equal their batch twins."""

import random

import pytest
from pyspark.sql import functions as F

from decisionlog.operators import commands as C
from decisionlog.operators.evaluate import score
from decisionlog.operators.ordered import by_number, by_time
from decisionlog.operators.poses import decision_points
from decisionlog.streaming import jobs as J
from decisionlog.streaming.keyed import keyed_state
from tests.test_trials import COMMANDS


def random_events(rng, n):
    """Commands of all kinds, with small steps, long pauses and stamps that go back."""
    stamps, out = 0.0, []
    for _ in range(n):
        stamps += rng.choice([0.25, 0.5, 1.0, 20.0, -0.5])
        kind = rng.choice(["cartesian_velocity"] * 3 + ["stop"] * 2 + ["gripper", "mode_change"])
        mode, axis = rng.choice(["translation", "rotation", None, "x"]), rng.choice(["x", "y", None])
        out.append((kind, mode, axis, rng.choice([-1, 0, 1, None]), rng.choice([True, True, False]), rng.choice(["release", "other"]), stamps))
    return out


def in_files(spark, tmp_path, df, order, n=4):
    """Write a table as ``n`` files in order and stream them one per micro-batch."""
    folder = str(tmp_path / "log")
    rows = df.orderBy(order).collect()
    size = -(-len(rows) // n)
    for i in range(n):
        spark.createDataFrame(rows[i * size : (i + 1) * size], df.schema).coalesce(1).write.mode("append").parquet(folder)
    return J.tail(spark, folder, df.schema, "parquet", files_per_batch=1)


def run(spark, tmp_path, s, idle=True):
    with keyed_state(spark, idle):
        query = J.write_stream(s, str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination()
    return spark.read.parquet(str(tmp_path / "out")), query


def test_live_decision_points(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "b", None]), i, rng.choice(["INTERACT", "INTERACT", "GRAB"]), rng.choice([["x"], ["x", "y"], None])) for i in range(200)]
    df = spark.createDataFrame(rows, "ep string, id int, tool string, candidates array<string>")
    order = by_number("id", size=50)
    out, _ = run(spark, tmp_path, J.live_decision_points(in_files(spark, tmp_path, df, "id"), keys=["ep"], order=order), idle=False)
    got = {r.id: r.alert_reason for r in out.collect()}
    assert got == {r.id: r.alert_reason for r in decision_points(df, ["ep"], order).collect()}
    assert {r.ep for r in out.collect()} == {"a", "b", None} and not out.filter("late").count()


def test_late_ticks_leave_the_state(spark, tmp_path):
    rows = [("a", 5, "GRAB", ["x"]), ("a", 3, "INTERACT", ["z"]), ("a", 6, "INTERACT", ["x"])]
    folder = str(tmp_path / "log")
    schema = "ep string, id int, tool string, candidates array<string>"
    for r in rows:
        spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(folder)
    s = J.tail(spark, folder, schema, "parquet", files_per_batch=1)
    out, _ = run(spark, tmp_path, J.live_decision_points(s, keys=["ep"], order=by_number("id"), p=0.0), idle=False)
    assert {r.id: (r.alert_reason, r.late) for r in out.collect()} == {5: ("episode_start", False), 3: (None, True), 6: ("post_execution", False)}


def test_live_user_priors(spark, tmp_path):
    rng = random.Random(8)
    rows = [(k, i * 10 + k, *e) for k in range(3) for i, e in enumerate(random_events(rng, 120))]
    df = spark.createDataFrame(rows, COMMANDS).withColumn("ts", F.timestamp_seconds("seq"))
    order = by_time("ts", "seq", width_seconds=100)
    # neighbouring files overlap: rows come up to ten seconds late
    mixed = df.withColumn("at", F.col("seq") + F.pmod(F.xxhash64("seq"), F.lit(10)))
    late = spark.createDataFrame([(99, 5000, "gripper", "x", "x", 1, True, "", 1.0), (99, 1, "gripper", "x", "x", 1, True, "", 1.0)], COMMANDS)
    late = late.withColumn("ts", F.timestamp_seconds("seq")).withColumn("at", F.lit(10**6) - F.col("seq"))  # the row of second 1 comes last
    s = in_files(spark, tmp_path, mixed.unionByName(late), "at", 6)
    out, query = run(spark, tmp_path, J.live_user_priors(s, trial=["trial"], order=order, watermark="20 seconds"))
    got = {r[0]: tuple(r[1:]) for r in J.read_user_priors(out, ["trial"]).collect()}
    want = {r[0]: tuple(r[1:]) for r in C.user_priors(df, ["trial"], order).collect()}
    assert {k: v for k, v in got.items() if k != 99} == {k: pytest.approx(v, abs=2e-4) for k, v in want.items()}
    assert J.dropped_rows(query) >= 1 and out.groupBy("trial").count().filter("count > 1").count()


def test_sessions_of_a_hot_key(spark, tmp_path):
    rng = random.Random(5)
    times, now = [], 0
    for _ in range(400):
        now += rng.choice([1, 5, 20, 29, 30, 31, 100])
        times.append((rng.choice(["hot", "hot", "b", None]), now))
    df = spark.createDataFrame(times, "user_id string, t long").select("user_id", F.timestamp_seconds("t").alias("ts"))
    want, last = [], {}
    for user, t in times:
        if user in last and t - last[user][1] <= 30:
            last[user][1:] = [t, last[user][2] + 1]
        else:
            last[user] = [t, t, 1]
            want.append((user, last[user]))
    parts = J.activity_sessions(df, chunk_seconds=100)
    got = J.whole_sessions(parts, chunk_seconds=500).selectExpr("user_id", "unix_seconds(session_start)", "unix_seconds(session_end) - 30", "commands").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((u, *s) for u, s in want), key=repr)
    hot = parts.filter("user_id = 'hot'")
    assert hot.count() > sum(u == "hot" for u, _ in want) and hot.agg(F.max("commands")).first()[0] <= 100
    s = J.activity_sessions(in_files(spark, tmp_path, df, "ts", 3), watermark="10 seconds", chunk_seconds=100)
    written, _ = run(spark, tmp_path, s)
    whole = J.completed(written, df, lambda x: J.activity_sessions(x, chunk_seconds=100), start="session_start")
    assert sorted(map(tuple, whole.collect()), key=repr) == sorted(map(tuple, parts.collect()), key=repr)


def test_running_confusion(spark, tmp_path):
    call = '{{"tool":"{}","args":{{"obj":"o1"}}}}'
    rows = [(i, 3600 + i * 60, call.format(["APPROACH", "ALIGN_YAW"][i % 2]), [call.format("APPROACH"), "no call", None][i % 3]) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, s long, output string, raw string").withColumn("ts", F.timestamp_seconds("s"))
    s = in_files(spark, tmp_path, df, "s", 3)
    truth, answers = s.select("id", "ts", "output"), s.filter("raw is not null").select("id", "ts", "raw")
    out, _ = run(spark, tmp_path, J.running_confusion(truth, answers, score, watermark="1 minute", window="10 minutes"))
    got = {(r.gt_tool, r.pred_tool): r.n for r in out.filter("unix_seconds(window_start) = 3600").collect()}
    assert got == {("APPROACH", "APPROACH"): 2, ("APPROACH", "INVALID_JSON"): 1, ("APPROACH", "MISSING"): 2, ("ALIGN_YAW", "APPROACH"): 2, ("ALIGN_YAW", "INVALID_JSON"): 2, ("ALIGN_YAW", "MISSING"): 1}


def test_gate_replays(spark, tmp_path):
    rows = [(str(i), "i", "", "{}" if i % 3 else "{") for i in range(30)]
    df = spark.createDataFrame(rows, "id string, instruction string, input string, output string")
    s = in_files(spark, tmp_path, df, "id", 3)
    paths = [str(tmp_path / p) for p in ("good", "bad", "cp")]
    J.validation_gate(s, *paths).awaitTermination()
    J.validation_gate(s, paths[0], paths[1], str(tmp_path / "cp2")).awaitTermination()  # the same batches again
    assert spark.read.parquet(paths[0]).count() == 20 and spark.read.parquet(paths[1]).count() == 10


def test_rates_drop_late_rows(spark, tmp_path):
    rows = [(1, f"2024-01-01 0{h}:10:00") for h in (0, 1, 2, 5)] + [(1, "2024-01-01 00:20:00"), (1, "2024-01-01 09:00:00")]
    folder = str(tmp_path / "log")
    for r in rows:
        spark.createDataFrame([r], "user_id int, t string").select("user_id", F.to_timestamp("t").alias("ts")).coalesce(1).write.mode("append").parquet(folder)
    s = J.tail(spark, folder, "user_id int, ts timestamp", "parquet", files_per_batch=1)
    J.write_stream(J.command_rates(s), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = sorted((r.window_start.hour, r.commands) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(0, 1), (1, 1), (2, 1), (5, 1)]


def test_state_is_read_by_bucket(spark, tmp_path):
    rows = [(f"user {i % 50}", i, ["INTERACT", "GRAB"][i % 2], ["x"]) for i in range(400)]
    df = spark.createDataFrame(rows, "ep string, id int, tool string, candidates array<string>")
    s = J.live_previous(in_files(spark, tmp_path, df, "id"), ["ep"], by_number("id"), {"_tool": "tool"}, buckets=3)
    out, query = run(spark, tmp_path, s.select("ep", "id", "_tool", "_late"), idle=False)
    assert {r.id: r._tool for r in out.collect()} == {i: rows[i - 50][2] if i >= 50 else None for i in range(400)}
    assert not out.filter("_late").count() and query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3


def test_rows_without_a_time_come_first(spark, tmp_path):
    rows = [(k, s, "gripper", "x", "x", 1, True, "", float(s or 0)) for k in (1, 2) for s in (None, 5, 9, 40)]
    df = spark.createDataFrame(rows, COMMANDS).withColumn("ts", F.timestamp_seconds("seq"))
    order = by_time("ts", "seq", width_seconds=100)
    s = J.live_user_priors(in_files(spark, tmp_path, df, "ts", 2), trial=["trial"], order=order, watermark="0 seconds", buckets=1)
    out, _ = run(spark, tmp_path, s)
    assert {r.trial: r.total_commands for r in J.read_user_priors(out, ["trial"]).collect()} == {1: 4, 2: 4}
