import json
import math
import os

import pytest
from pyspark.sql import functions as F

from decisionlog import schemas as S
from decisionlog.functions import geometry as G
from decisionlog.functions.labels import canonical_label, catalogue_label
from decisionlog.operators import commands as C
from decisionlog.operators import poses as P
from decisionlog.operators import reannotate as R
from decisionlog.operators import trials as T
from decisionlog.operators.ordered import by_number
from decisionlog.operators.perturb import PROFILES, corrupt_commands, noise_grid
from decisionlog.sources import tables, trials as src, trialsource
from decisionlog.sources.jsonl import read_scenarios, write_scenarios


def test_geometry_goldens(spark):
    angles = [0, math.pi / 2, math.pi, -math.pi, -math.pi / 2, math.pi / 4, -3 * math.pi / 4, -0.26, -0.49, 0.21, 9 * math.pi / 4]
    df = spark.createDataFrame([(i, float(a)) for i, a in enumerate(angles)], "i int, a double")
    assert [r.b for r in df.select("i", G.yaw_bin(F.col("a")).alias("b")).orderBy("i").collect()] == "E N W W S NE SW E SE E NE".split()
    row = spark.range(1).select(
        G.height_bin(F.lit(0.41)).alias("h"),
        G.cell_distance(F.lit("A1"), F.lit("C3")).alias("d"),
        G.cell_neighbours(F.lit("A1")).alias("n"),
        G.yaw_steps(F.lit("N"), F.lit("S")).alias("ns"),
        G.yaw_steps(F.lit("NW"), F.lit("N")).alias("nw"),
        G.yaw_neighbours(F.lit("N")).alias("yn"),
        G.cell_label(F.lit(5)).alias("c"),
        canonical_label(F.lit(" Tuna_Can")).alias("l"),
        catalogue_label(F.lit("meat_can")).alias("k"),
        P.cells_within(F.lit("B2"), 1).alias("w"),
    ).first()
    assert (row.h, row.d, set(row.n), row.ns, row.nw, row.yn, row.c) == ("HIGH", 4, {"A2", "B1"}, 4, 1, ["NW", "NE"], "B3")
    assert (row.l, row.k, row.w) == ("meat_can", "potted_meat_can", ["A2", "B1", "B2", "B3", "C2"])


COMMANDS = "trial int, seq int, type string, command_mode string, axis string, direction int, active boolean, reason string, stamp double"


def press(stamp, axis="x", direction=1, mode="translation"):
    return ("cartesian_velocity", mode, axis, direction, True, None, stamp)


def release(stamp, axis="x", mode="translation", reason="release"):
    return ("stop", mode, axis, 0, None, reason, stamp)


def grip(stamp):
    return ("gripper", None, None, None, None, None, stamp)


#: logs, worked by hand: shares of translation, rotation, gripper; mean burst; switches and reversals per second; seconds; commands
LOGS = {
    "two bursts": ([press(0.0), release(0.5), press(1.0), release(1.4)], (1.0, 0.0, 0.0, 0.45, 0.0, 0.0, 0.9, 2)),
    "modes": ([press(0.0), release(1.0), press(2.0, "z", 1, "rotation"), release(5.0, "z", "rotation"), grip(10.0)], (0.25, 0.75, 0.0, 2.0, 0.2, 0.0, 4.0, 3)),
    "reversal": ([press(0.0), press(1.0, direction=-1), press(2.0, "y", -1), press(4.0, direction=1), release(5.0)], (1.0, 0.0, 0.0, 1.0, 0.0, 0.5, 1.0, 4)),
    "too long, too short, other stop": ([press(0.0), release(40.0), press(50.0), release(50.0), press(60.0), release(61.0, reason="x"), release(62.0)], (1.0, 0.0, 0.0, 2.0, 0.0, 0.0, 2.0, 3)),
    "released once": ([press(0.0), release(1.0), release(2.0), release(3.0, "y")], (1.0, 0.0, 0.0, 1.0, 0.0, 0.0, 1.0, 1)),
    "nothing": ([release(1.0)], (0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0)),
}


@pytest.mark.parametrize("size", [2, 1000])
def test_user_priors(spark, size):
    rows = [(k, i, *e) for k, (events, _) in enumerate(LOGS.values()) for i, e in enumerate(events)]
    df = spark.createDataFrame(rows, COMMANDS).repartition(6)
    order = by_number("seq", size=size)
    got = {r[0]: tuple(r[1:]) for r in C.user_priors(df, ["trial"], order).collect()}
    for k, (name, (_, want)) in enumerate(LOGS.items()):
        assert got[k] == pytest.approx(want, abs=2e-4), name
    listed = C.bursts(df, ["trial"], order).groupBy("trial").agg(F.round(F.sum("seconds"), 3).alias("s")).collect()
    assert all(abs(r.s - got[r.trial][6]) < 1e-3 for r in listed)


def test_corrupted_commands(spark):
    rows = [(i, "gripper" if i % 4 == 0 else "translation", "xyzq"[i % 4], 1, i % 3, 3) for i in range(400)]
    df = spark.createDataFrame(rows, "event_id int, command_mode string, axis string, direction int, reply_idx int, n_choices int")
    assert corrupt_commands(df, PROFILES["clean"]).filter("direction_perturbed or dropped or selection_perturbed or latency_sec > 0").count() == 0
    out = corrupt_commands(df, (1.0, 1.0, 1.0, True), 5).join(df.selectExpr("event_id", "axis was_axis", "direction was_dir", "reply_idx was_reply"), "event_id").collect()
    for r in out:
        bent = r.axis != r.was_axis or r.direction != r.was_dir
        assert bent == (r.command_mode != "gripper") and not (r.axis != r.was_axis and r.direction != r.was_dir)
        assert r.reply_idx != r.was_reply and 0 <= r.reply_idx < 3 and r.dropped and 0.1 <= r.latency_sec <= 0.5
    swapped = sum(r.axis != r.was_axis for r in out)
    assert 60 < swapped < 140  # half of the rows whose axis can be confused
    assert noise_grid(spark).count() == 6
    with pytest.raises(ValueError):
        corrupt_commands(df, (2.0, 0.0, 0.0, False))


def snapshot(objects, cell="B2", yaw=0.0, height=0.41):
    keys = ("id", "label", "grid_label", "is_held", "yaw")
    return {"stamp": 1.0, "objects": [dict(zip(keys, o)) for o in objects], "gripper": {"grid_label": cell, "yaw": yaw, "height": height}}


def call(objects, tool="INTERACT", target=None, **kw):
    return {"tool_name": tool, "target_object_id": target, "state_snapshot": snapshot(objects, **kw)}


@pytest.fixture(scope="module")
def logs(tmp_path_factory):
    root = tmp_path_factory.mktemp("study logs") / "LOGS"

    def trial(path, calls=None, events=None, meta=True, summary=True):
        d = root / path
        d.mkdir(parents=True)
        if summary:
            (d / "trial_summary.json").write_text(json.dumps({"trial_id": d.name, "mode": "assisitive"}))
        if meta:
            (d / "trial_meta.json").write_text(json.dumps({"trial_id": d.name, "mode": "typo"}, indent=1))
        (d / "gui_events.jsonl").write_text("".join(json.dumps(e) + "\n" for e in events or []))
        (d / "tool_calls.jsonl").write_text("".join(json.dumps(c) + "\n" for c in calls or []))
        (d / "llm_events.jsonl").write_text("noise\nn_interactions = 7\nn_interactions = 9\n")

    two = [("9", "Master_Chef_Can", "A1", False, 0.0), ("8", "coffee_can", "A1", True, 1.6), ("7", "mug", "C3", False, 3.1)]
    move = {"type": "cartesian_velocity", "mode": "translation", "axis": "x", "direction": 1, "active": True, "stamp": 1.0}
    stop = {"type": "stop", "mode": "translation", "axis": "x", "reason": "release", "stamp": 1.5}
    trial("assistive/s1/easy/trial_1", [{"tool_name": "APPROACH"}, call(two), call(two, "APPROACH", "7"), call(two, "GRAB", "9"), call(two, "ALIGN_YAW", "")], [{"parsed": move, "raw": "x"}, stop, {"parsed": 5}])
    trial("assistive/s1/easy/trial_2", [call([("1", "mug", "C3", False, 0.0), ("2", "box", "B1", False, 0.0)], yaw=1.6)], meta=False)
    trial("manual/s1/easy/trial_3")
    trial("manual/s2/easy/trial_4", events=[move])
    trial("manual/s2/hard/trial_5")
    trial("manual/s2/hard/trial_6", summary=False)
    trial("old/assistive/s1/easy/trial_7", [call(two)])
    return str(root)


def test_scenarios_from_logs(spark, logs):
    trials = T.assemble_trials(src.discover_trials(spark, logs), src.read_meta(spark, logs), src.read_calls(spark, logs))
    got = {r.trial_id: (r.mode, r.subject, r.difficulty, r.has_meta, r.has_calls) for r in trials.collect()}
    assert got == {
        "trial_1": ("assistive", "s1", "easy", True, True),
        "trial_2": ("assistive", "s1", "easy", False, True),
        "trial_3": ("manual", "s1", "easy", True, False),
        "trial_4": ("manual", "s2", "easy", True, False),
        "trial_5": ("manual", "s2", "hard", True, False),
    }
    order = by_number("seq", size=2)
    commands = src.read_commands(spark, logs)
    assert commands.count() == 3
    priors = C.user_priors(commands, list(S.TRIAL_KEYS), order)
    scenarios, dropped = T.build_scenarios(trials, T.trial_heads(src.read_calls(spark, logs), order).checkpoint(), priors)
    rows = {r.source.trial_id: r for r in scenarios.collect()}
    assert [(r.trial_id, r.reason) for r in dropped.collect()] == [("trial_5", "no template: subject=s2, difficulty=hard")]
    one = rows["trial_1"]
    assert one.scenario_id == "assistive_s1_easy_trial_1" and one.layout_source == "state_snapshot"
    assert [(o.id, o.label, o.cell, o.yaw, o.is_held) for o in one.objects] == [("obj_1", "coffee_can", "A1", "E", True), ("obj_2", "mug", "C3", "W", False)]
    assert (one.target_obj_id, one.target_label_source, one.plausible_target_ids) == ("obj_2", "tool_call", ["obj_2"])
    assert tuple(one.gripper_init) == ("B2", "E", "HIGH") and one.user_priors.mean_active_burst_sec == 0.5
    three = rows["trial_3"]
    assert [(o.id, o.label, o.cell) for o in three.objects] == [("obj_1", "coffee_can", "A1"), ("obj_2", "box", "B1"), ("obj_3", "mug", "C3")]
    assert three.layout_source == "borrowed_template" and three.notes == "template=own, trials=2"
    assert not any(o.is_held for o in three.objects) and three.objects[2].yaw == "W"  # yaw of the first trial showing it
    assert rows["trial_4"].notes == "template=pooled, trials=2" and rows["trial_4"].user_priors.total_commands == 1
    assert T.scenario_violations(scenarios).filter("size(violations) > 0").count() == 0
    report = {(r.dim, r.key): r.n for r in T.extraction_report(scenarios, dropped).collect()}
    assert report[("total", "valid")] == 4 and report[("total", "dropped")] == 1 and report[("subject_difficulty", "s1/easy")] == 3
    assert {r.trial_id: r.value for r in src.scrape_metric(spark, logs, glob="llm_events.jsonl").collect()}["trial_1"] == 7


def _listed(df):
    return sorted(df.select(*sorted(df.columns)).collect(), key=repr)


def test_trial_folders_as_a_source(spark, logs, tmp_path):
    """Lines read by the data source, by a stream, and written and read again give what the text readers give."""
    records = src.trial_records(spark, logs, slices=3, tasks=4)
    for got, want in (
        (src.documents_of(records, "summary"), src.discover_trials(spark, logs)),
        (src.calls_of(records), src.read_calls(spark, logs).join(src.discover_trials(spark, logs).select(*S.TRIAL_KEYS), list(S.TRIAL_KEYS))),
        (src.commands_of(records), src.read_commands(spark, logs)),
    ):
        assert _listed(got) == _listed(want) and got.count() > 0
    trials = T.assemble_trials(src.documents_of(records, "summary"), src.documents_of(records, "meta"), src.calls_of(records))
    assert trials.filter("has_meta").count() == 4 and trials.count() == 5

    copy = str(tmp_path / "a b+c")
    src.write_trials(records, copy)
    kinds = lambda df: {(r.kind, r["count"]) for r in df.groupBy("kind").count().collect()}
    assert kinds(src.trial_records(spark, copy)) == kinds(records)
    assert _listed(src.calls_of(src.trial_records(spark, copy))) == _listed(src.calls_of(records))
    assert src.trial_records(spark, str(tmp_path / "none")).count() == 0


def test_shares_cover_each_trial_once(tmp_path):
    from decisionlog.sources.trialsource import _Reader

    for k in range(60):
        d = tmp_path / "manual" / ("s1" if k < 40 else f"s{k % 3 + 2}") / "easy" / f"trial_{k}"
        d.mkdir(parents=True)
        (d / "trial_summary.json").write_text("{}")
    for slices, tasks in ((16, 8), (4, 64), (1, 1)):
        reader = _Reader(str(tmp_path), slices, tasks)
        sizes = [sum(b.num_rows for b in reader.read(p)) for p in reader.partitions()]
        assert sum(sizes) == 60 and (slices == 1 or max(sizes) < 20)  # two thirds are one subject's


def test_trial_stream(spark, tmp_path):
    """Each trial comes once, whole, in the batch after its summary was written; a restart goes on from the last offset."""
    root, out, state = str(tmp_path / "logs"), str(tmp_path / "out"), str(tmp_path / "state")

    def rows(trial, summary):
        lines = [("call", i, json.dumps(call([("1", "mug", "A1", False, 0.0)]))) for i in range(3)] + ([("summary", 1, "{}")] if summary else [])
        return spark.createDataFrame([("manual", "s1", "easy", trial, k, i, x) for k, i, x in lines], "mode string, subject string, difficulty string, trial_id string, kind string, seq bigint, text string")

    def go():
        query = src.tail_trials(spark, root, settle_seconds=0).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
        return {(r.trial_id, r.kind): r["count"] for r in spark.read.parquet(out).groupBy("trial_id", "kind").count().collect()}

    src.write_trials(rows("trial_1", True), root)
    src.write_trials(rows("trial_2", False), root)
    one = {("trial_1", "call"): 3, ("trial_1", "summary"): 1}
    assert go() == one
    src.write_trials(rows("trial_2", True), root)
    both = one | {("trial_2", "call"): 3, ("trial_2", "summary"): 1}
    assert go() == both
    assert go() == both


def test_templates_vote(spark):
    rows = [("s1", "easy", f"t{t}", p, "x", c, 0.0, False) for t, cells in enumerate([["A1", "B1"], ["A1"], ["A1", "C1"], ["C1"]]) for p, c in enumerate(cells)]
    objs = spark.createDataFrame(rows, "subject string, difficulty string, trial_id string, pos int, label string, cell string, yaw double, is_held boolean")
    cells = lambda **k: [(r.id, r.cell, r.support) for r in T.template_objects(objs, ["subject", "difficulty"], ["trial_id"], **k).orderBy("id").collect()]
    assert cells() == [("obj_1", "A1", 3), ("obj_2", "B1", 1), ("obj_3", "C1", 2)]
    assert cells(min_support=2) == [("obj_1", "A1", 3), ("obj_2", "C1", 2)]
    assert cells(frac=0.5) == [("obj_1", "A1", 3), ("obj_2", "C1", 2)]
    poses = spark.createDataFrame([("s1", "easy", "t1", "B2", "E", "LOW"), ("s1", "easy", "t0", "A1", "N", "LOW"), ("s1", "easy", "t3", "B2", "E", "LOW"), ("s1", "easy", "t2", "A1", "N", "LOW")], "subject string, difficulty string, trial_id string, cell string, yaw string, z string")
    assert T.template_poses(poses, ["subject", "difficulty"], ["trial_id"]).first().gripper_init.cell == "A1"


def test_dedup_golden(spark):
    schema = "trial int, pos int, label string, cell string, yaw double, is_held boolean"
    df = spark.createDataFrame([(1, 0, "can", "A1", 0.1, False), (1, 1, "can", "A1", 0.2, True), (1, 2, "mug", "B1", 0.0, False), (2, 0, "mug", "B1", 0.0, False), (2, 1, "mug", "B2", 0.0, False)], schema)
    got = sorted((r.trial, r.id, r.label, r.cell, r.yaw, r.is_held) for r in T.dedup_objects(df, ["trial"], by_number("pos", size=1)).collect())
    assert got == [(1, "obj_1", "can", "A1", 0.1, True), (1, "obj_2", "mug", "B1", 0.0, False), (2, "obj_1", "mug", "B1", 0.0, False), (2, "obj_2", "mug", "B2", 0.0, False)]


def scenario(sid="s", target=None, source="unlabeled", **kw):
    base = {
        "scenario_id": sid,
        "source": {"mode": "manual", "subject": "s1", "difficulty": "easy", "trial_id": sid, "trial_dir": "d"},
        "objects": [{"id": "obj_1", "label": "mug", "raw_label": "mug", "cell": "B3", "yaw": "N", "is_held": False}, {"id": "obj_2", "label": "box", "raw_label": "box", "cell": "C3", "yaw": "E", "is_held": False}, {"id": "obj_3", "label": "can", "raw_label": "can", "cell": "B2", "yaw": "E", "is_held": True}],
        "gripper_init": {"cell": "B2", "yaw": "E", "z": "HIGH"},
        "target_obj_id": target,
        "target_label_source": source,
        "layout_source": "state_snapshot",
        "user_priors": {"total_commands": 1},
        "difficulty": "easy",
        "plausible_target_ids": ["obj_1", "obj_2"],
        "notes": "",
    }
    return {**base, **kw}


def table(spark, *rows):
    df = spark.createDataFrame([(json.dumps(r),) for r in rows], "v string")
    return df.select(F.from_json("v", S.SCENARIOS).alias("s")).select("s.*")


def test_scenario_rules(spark, tmp_path):
    bad = scenario("b", "obj_9", "hand_label", objects=[{"id": "o", "cell": "D4", "yaw": "N", "label": "x"}, {"id": "o", "cell": "A1", "yaw": "UP", "label": "x"}], gripper_init={"cell": "A1", "yaw": "N", "z": "TOP"})
    odd = scenario("c", "obj_1", "unlabeled", layout_source="guess", objects=[])
    got = {r.scenario_id: {v.rule: v.faults for v in r.violations} for r in T.scenario_violations(table(spark, scenario(), bad, odd)).collect()}
    assert got["s"] == {}
    assert got["b"] == {"start.z": 1, "objects.cell": 1, "objects.repeated_id": 1, "objects.yaw": 1, "plausible.absent": 2, "target.absent": 1}
    assert got["c"] == {"layout.source": 1, "objects.few": 1, "plausible.absent": 2, "target.absent": 1, "target.label": 1}
    write_scenarios(table(spark, scenario(), bad), str(tmp_path / "s"))
    assert sorted(read_scenarios(spark, str(tmp_path / "s")).collect()) == sorted(table(spark, scenario(), bad).collect())
    stub = T.label_stub(table(spark, scenario(), scenario("t", "obj_1", "hand_label"))).collect()
    assert [(r.scenario_id, r.plausible_targets) for r in stub] == [("s", "obj_1|obj_2")]
    assert stub[0].object_summary.startswith("obj_1=mug@B3(N)|")


def test_contract_of_scenarios(spark):
    df = table(spark, scenario(), scenario("t", "obj_1", "hand_label"))
    row = T.scenarios_to_contract(df).filter("id = 's'").first()
    blob = json.loads(row.input)
    assert blob["gripper_hist"] == [{"cell": "B2", "yaw": "E", "z": "HIGH"}] * 6 and blob["memory"]["candidates"] == ["obj_1"]
    assert list(blob) == ["objects", "gripper_hist", "memory", "user_state"] and row.output == "{}"
    assert list(blob["objects"][0]) == ["id", "label", "cell", "yaw", "is_held"] and blob["memory"]["last_action"] == {}
    far = json.loads(T.scenarios_to_contract(df, max_dist=2, skip_unlabeled=True).first().input)
    assert far["memory"]["candidates"] == ["obj_1", "obj_2"]
    assert T.scenarios_to_contract(df, skip_unlabeled=True).count() == 1


def test_path_length(spark):
    near = scenario("n", "obj_1", "tool_call", gripper_init={"cell": "B3", "yaw": "N", "z": "HIGH"})
    far = scenario("f", "obj_2", "tool_call", gripper_init={"cell": "A1", "yaw": "NW", "z": "HIGH"})
    got = {r.scenario_id: r.path_length for r in T.path_length(table(spark, near, far, scenario("u"))).collect()}
    assert got == {"n": 3, "f": 10, "u": 1}


def test_hand_labels(spark, tmp_path):
    layout = json.dumps({"objects": [{"id": "obj_8", "label": "x", "raw_label": "x", "cell": "A1", "yaw": "N", "is_held": False}], "gripper_init": {"cell": "A1", "yaw": "N", "z": "LOW"}}).replace('"', '""')
    lines = [",".join(c.split()[0] for c in S.HAND_LABELS.split(", ")), "s,,,,obj_1,,,,,first", "s,,,, obj_2 ,,,,,second", "s,,,,obj_9,,,,,", "nope,,,,obj_1,,,,,", f't,,,,obj_8,,,,"{layout}",', "u,,,,,,,,{bad,", ",,,,obj_1,,,,,"]
    (tmp_path / "l.csv").write_text("\n".join(lines) + "\n")
    df = spark.read.option("header", "true").option("escape", '"').schema(S.HAND_LABELS).csv(str(tmp_path / "l.csv")).withColumn("row", F.monotonically_increasing_id())
    out, skipped = T.overlay_labels(table(spark, scenario(), scenario("t"), scenario("u", "obj_1", "tool_call")), df)
    got = {r.scenario_id: (r.target_obj_id, r.target_label_source, r.layout_source, r.notes) for r in out.collect()}
    assert got == {"s": ("obj_2", "hand_label", "state_snapshot", "first | second"), "t": ("obj_8", "hand_label", "hand_label", ""), "u": ("obj_1", "tool_call", "state_snapshot", "")}
    assert sorted((r.scenario_id, r.reason) for r in skipped.collect()) == [("nope", "unknown scenario"), ("s", "unknown target obj_9"), ("u", "layout not readable")]


HIST = "array<struct<cell:string,yaw:string,z:string>>"


def test_oscillation_and_mode(spark):
    cases = [
        ([("A1", y, "H") for y in "NENENE".replace("E", "e").upper()], (True, "A1", "N", "E"), False, "rotation"),
        ([(c, "N", "H") for c in ("A1", "A2", "A1", "A2", "A1", "A2")], (False, None, None, None), True, "translation"),
        ([("A1", "N", "H")] * 5 + [("A1", "N", "L")], (False, None, None, None), False, "gripper"),
        ([("A1", y, "H") for y in ("N", "E", "S", "E", "N", "E")], (False, None, None, None), False, "rotation"),
        ([("A1", "N", "H")], (False, None, None, None), False, "translation"),
    ]
    df = spark.createDataFrame([(i, h) for i, (h, *_) in enumerate(cases)], f"i int, h {HIST}")
    out = df.select("i", P.yaw_oscillation(F.col("h")).alias("y"), P.cell_oscillation(F.col("h"), F.lit("A1"), F.lit("A2")).alias("c"), P.infer_mode(F.col("h")).alias("m")).orderBy("i").collect()
    assert [(tuple(r.y), r.c, r.m) for r in out] == [c[1:] for c in cases]


def test_history_candidates_and_decisions(spark):
    poses = spark.createDataFrame([(1, i, "ABC"[i % 3] + "1", "N", "LOW") for i in range(9)], "k int, seq int, cell string, yaw string, z string")
    got = P.pose_history(poses, ["k"], by_number("seq", size=4)).orderBy("seq").collect()
    assert [p.cell for p in got[8].gripper_hist] == ["A1", "B1", "C1"] * 2 and len(got[0].gripper_hist) == 1
    objects = spark.createDataFrame([(1, "o1", "A1", False), (1, "o2", "C1", False), (1, "o3", "A1", True), (2, "o4", "A1", None)], "k int, id string, object_cell string, is_held boolean")
    pairs = sorted((r.seq, r.id) for r in P.candidate_join(poses.filter("seq < 3"), objects, ["k"]).collect())
    assert pairs == [(0, "o1"), (1, "o1"), (1, "o2"), (2, "o2")]
    ticks = [("e", 0, "INTERACT", ["a"]), ("e", 1, "GRAB", ["a"]), ("e", 2, "INTERACT", ["b"]), ("e", 3, "INTERACT", ["b", "c"]), ("e", 4, "INTERACT", ["c", "b", "c"]), ("f", 9, "GRAB", None)]
    df = spark.createDataFrame([(*t, f"{t[0]}{t[1]}") for t in ticks], "ep string, seq int, tool string, candidates array<string>, id string")
    order = by_number("seq", size=2)
    reasons = lambda p: [r.alert_reason for r in P.decision_points(df, ["ep"], order, p).orderBy("ep", "seq").collect()]
    assert reasons(0.0) == ["episode_start", None, "post_execution", "candidate_change", None, "episode_start"]
    assert reasons(1.0) == ["episode_start", "stochastic", "post_execution", "candidate_change", "stochastic", "episode_start"]
    assert [r.last_tool_calls for r in P.last_k(df, "tool", ["ep"], order).orderBy("ep", "seq").collect()][4] == ["GRAB", "INTERACT", "INTERACT"]
    assert [r.tick_idx for r in P.renumber(df, ["ep"], order).orderBy("ep", "seq").collect()] == [0, 1, 2, 3, 4, 0]


def test_reannotation(spark):
    eps = [3, 3, 1, 3, 2, 1, 2, 2]
    df = spark.createDataFrame([(e, i) for i, e in enumerate(eps)], "episode_id int, seq int")
    order = by_number("seq", size=3)
    cut = lambda **k: [(r.episode_id, r.seq, r.episode_no, r.record_no) for r in R.episode_slice(df, order, chunk_size=2, **k).orderBy("record_no").collect()]
    assert [x[:2] for x in cut()] == [(3, 0), (3, 1), (3, 3), (1, 2), (1, 5), (2, 4), (2, 6), (2, 7)]
    assert cut(skip_episodes=1, skip_records=1, max_records=2) == [(1, 5, 1, 0), (2, 4, 2, 1)]
    assert [x[0] for x in cut(max_episodes=1)] == [3, 3, 3]
    call = "struct<tool:string,args:struct<obj:string>>"
    rec = spark.createDataFrame([(1, 0, ("INTERACT", None)), (1, 1, ("GRAB", ("o",))), (1, 2, ("INTERACT", None))], f"episode_id int, tick_idx int, target_tool_call {call}")
    ann = spark.createDataFrame([(1, 0, ("POUR", ("p",))), (1, 1, ("POUR", ("p",)))], f"episode_id int, tick_idx int, tool_call {call}")
    got = [(r.tool_call.tool, r.alert_reason) for r in R.merge_reannotation(rec, ann).orderBy("tick_idx").collect()]
    assert got == [("POUR", "replay"), ("GRAB", "auto_motion"), ("INTERACT", "unanswered")]
    assert R.merge_reannotation(rec, ann, only_interact=False).filter("tool_call.tool = 'POUR'").count() == 2


def test_table_sources(spark, tmp_path):
    cell = {"model": {"name": "m"}, "n": 3, "tool_accuracy": 0.5, "by_context": {"x": {"n": 2}}, "_eval_set": "e", "_model_safe": "m"}
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.json").write_text(json.dumps(cell, indent=2))
    for name, text in {"b": "{broken", "c": "", "d": "[1]", "e": '{"n": 1} {"n": 2}', "f": "5"}.items():
        (tmp_path / "r" / f"{name}.json").write_text(text)
    rows = tables.read_cells(spark, str(tmp_path / "r")).collect()
    assert len(rows) == 1 and rows[0].by_context == {"x": {"n": 2}}
    (tmp_path / "r" / "g.json").write_text('{"n": 4, "tool_accuracy": NaN}')
    good, bad = tables.split_cells(spark, str(tmp_path / "r"))
    assert sorted(r.n for r in good.collect()) == [3, 4]
    assert sorted(r.file[-6:] for r in bad.collect()) == ["b.json", "d.json", "e.json", "f.json"]  # Spark reads an empty file as no row
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    path = str(tmp_path / "t")
    tables.append_new(df.filter("k = 1"), path, ["k"])
    tables.append_new(df, path, ["k"])
    tables.append_new(df, path, ["k"])
    assert sorted(r.k for r in spark.read.parquet(path).collect()) == [1, 2]
    tables.write_report(df, str(tmp_path / "csv"))
    assert tables.read_csv(spark, str(tmp_path / "csv"), "k INT, v STRING", row="row").count() == 2
    long = spark.createDataFrame([("m", "context", "x", 4, 3)], "model string, dim string, key string, n bigint, tool_correct bigint")
    assert tables.context_table(long, ["x", "y"]).first().asDict() == {"model": "m", "x_acc": 0.75, "y_acc": 0.0, "x_n": 4, "y_n": 0}
    conf = spark.createDataFrame([("m", "A", "A", 2), ("m", "A", "INVALID_JSON", 1)], "model string, gt_tool string, pred_tool string, n bigint")
    assert tuple(tables.confusion_table(conf, ["A", "B"]).first()) == ("m", "A", 2, 0, 1, 0)


def test_a_trial_folder_is_made_once(tmp_path, monkeypatch):
    made = []

    class Counting:
        def create_dir(self, path):
            made.append(path)
            store.create_dir(path)

        def open_output_stream(self, path, **how):
            return store.open_output_stream(path, **how)

    store, _ = trialsource.fs.FileSystem.from_uri(str(tmp_path))
    monkeypatch.setattr(trialsource.fs, "FileSystem", type("FileSystem", (), {"from_uri": staticmethod(lambda uri: (Counting(), uri))}))
    rows = [("manual", "s1", "easy", trial, kind, seq, f"{kind} {seq}") for trial in ("trial_1", "trial_2") for kind in ("call", "event", "summary") for seq in (1, 2)]
    trialsource._Writer(str(tmp_path)).write(iter([trialsource._batch(rows[:5]), trialsource._batch(rows[5:])]))
    folder = tmp_path / "manual" / "s1" / "easy"
    assert made == [str(folder / t) for t in ("trial_1", "trial_2")]
    assert (folder / "trial_1" / "gui_events.jsonl").read_text() == "event 1\nevent 2\n" and (folder / "trial_2" / "trial_summary.json").exists()


def test_trial_folders_are_there_for_some_trials_at_a_time(spark, tmp_path, monkeypatch):
    """Parts hold each trial once and whole, nothing of a part is left after it, and the rows are those of one part."""
    from decisionlog.plans import storage, views

    spark.createDataFrame([(c, c % 3) for c in range(40)], "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(o, o % 40, "F") for o in range(200)], "o_orderkey long, o_custkey long, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    lines = [(o, n, o + n, o * n, "R" if n == 1 else "N") for o in range(200) for n in range(o % 4)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    t = views.Tables(spark, str(tmp_path))
    roots, most, write, drop = [], [], src.write_trials, src.drop_trials

    def written(records, root):
        write(records, root)
        roots.append(root)
        most.append(sum(name.startswith("trial_") for r in roots for _, names, _ in os.walk(r) for name in names))

    monkeypatch.setattr(src, "write_trials", written)
    whole = _listed(storage.trial_round_trip(t))
    monkeypatch.setattr(src, "TRIALS_AT_ONCE", 10)
    assert _listed(storage.trial_round_trip(t)) == whole and len(whole) == 36
    assert most[0] == 40 and len(most) == 5 and sum(most[1:]) == 40 and max(most[1:]) < 20
    assert not any(os.path.exists(r) for r in roots)
    drop(spark, roots[0])  # once more: nothing to remove


def test_long_files_and_long_lines_pass_whole(tmp_path, monkeypatch):
    """Texts beyond the sizes that are written and read at once come back as they were."""
    monkeypatch.setattr(trialsource, "_WRITE_CHARS", 10)
    texts = ["a" * 25, "é" * 7, "", "b", "c" * 9]
    rows = [("manual", "s1", "easy", "trial_1", "call", n, x) for n, x in enumerate(texts)] + [("manual", "s1", "easy", "trial_1", "summary", 1, "{}")]
    trialsource._Writer(str(tmp_path)).write(iter([trialsource._batch(rows[:2]), trialsource._batch(rows[2:])]))
    for size in (4 << 20, 5):
        monkeypatch.setattr(trialsource, "_READ_BYTES", size)
        reader = trialsource._Reader(str(tmp_path), 2, 2)
        got = [tuple(r.values()) for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
        calls = [(r[5], r[6]) for r in got if r[4] == "call"]
        assert calls == [(n, x) for n, x in enumerate(texts, 1) if x] and [r[6] for r in got if r[4] == "summary"] == ["{}\n"]
