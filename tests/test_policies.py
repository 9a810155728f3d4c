"""Rule baselines against a plain Python reading of their rules."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from decisionlog import schemas as S
from decisionlog.functions.geometry import CELLS, cell_distance
from decisionlog.operators.evaluate import accuracy_report, robustness_curve, score_typed
from decisionlog.operators.perturb import PERTURBATIONS, perturb_at_levels, perturb_user_input
from decisionlog.operators.policies import POLICIES, candidate_labels, motion_prior

LABELS = ["mug", "box", "can", "", "mug"]


def dist(a, b):
    return abs(ord(a[0]) - ord(b[0])) + abs(int(a[1]) - int(b[1]))


def observation(rng):
    n = rng.randint(0, 6)
    objects = [{"id": f"o{i}", "label": rng.choice(LABELS), "cell": rng.choice(CELLS), "yaw": "N", "is_held": False} for i in range(n)]
    ids = [o["id"] for o in objects] + ["ghost", "ghost2"]
    cands = rng.sample(ids, rng.randint(0, min(5, len(ids))))
    hist = [{"cell": rng.choice(CELLS), "yaw": "N", "z": "HIGH"} for _ in range(rng.choice([0, 1, 6, 6, 6]))]
    return {"objects": objects, "gripper_hist": hist, "memory": {"candidates": cands}, "user_state": {"mode": rng.choice(["translation", "rotation", " Gripper", ""])}}


def label(obs, oid):
    return next((o["label"] for o in obs["objects"] if o["id"] == oid), "") or None


def menu(labels):
    shown = [f"{i + 1}) {x}" for i, x in enumerate(labels[:4])]
    return ("INTERACT", "QUESTION", "Which object do you want help with?", shown + [f"{len(shown) + 1}) None of them"], None)


def expected(policy, obs):
    cands, hist = obs["memory"]["candidates"], obs["gripper_hist"]
    near = (obs["user_state"]["mode"] or "translation").strip().lower() in ("translation", "gripper")
    tool, verb = ("APPROACH", "approach") if near else ("ALIGN_YAW", "align yaw to")
    ask = lambda text: ("INTERACT", "QUESTION", text, ["1) YES", "2) NO"], None)
    confirm = lambda c: ("INTERACT", "CONFIRM", f"Do you want me to {verb} the {label(obs, c) or c}?", ["1) YES", "2) NO"], None)
    act = lambda c: (tool, None, None, None, c)
    full = menu([x for x in (label(obs, c) for c in cands) if x])
    rules = policy in ("heuristic_ask_if_ambiguous", "heuristic_always_ask")
    if not cands or (not rules and not hist):
        return ask("I don't see any nearby candidates. What do you want help with?" if rules else "What do you want help with?")
    if len(cands) == 1:
        return confirm(cands[0]) if policy == "heuristic_always_ask" else act(cands[0])
    if rules:
        return full
    cell = {o["id"]: o["cell"] for o in obs["objects"]}
    known = [c for c in cands if c in cell]
    bayes = policy == "heuristic_bayesian_intent"
    if not known:
        return ask("What do you want help with?" if bayes else "Which object do you want help with?")
    score = {}
    for c in known:
        now = dist(hist[-1]["cell"], cell[c])
        steps = [dist(a["cell"], cell[c]) - dist(b["cell"], cell[c]) for a, b in zip(hist, hist[1:])]
        score[c] = -now + 1.5 * sum(steps) if bayes else -1.5 * now + 0.5 * (steps[-1] if steps else 0)
    top = max(score.values())
    share = {c: math.exp(v - top) for c, v in score.items()}
    total = sum(share.values())
    share = {c: v / total for c, v in share.items()}
    best = max(share, key=share.get)
    if not bayes:
        return act(best) if share[best] >= 0.6 else full
    h = -sum(p * math.log(p + 1e-10) for p in share.values()) / (math.log(len(share)) if len(share) > 1 else 1.0)
    if h < 0.3:
        return act(best)
    if h < 0.7:
        return confirm(best)
    ranked = sorted(share, key=lambda c: -share[c])[:4]
    return menu([x for x in (label(obs, c) for c in ranked) if x])


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(5)
    obs = [observation(rng) for _ in range(300)]
    df = spark.createDataFrame([(i, json.dumps(o)) for i, o in enumerate(obs)], "id int, input string")
    return obs, df.select("id", F.from_json("input", S.OBSERVATION).alias("obs")).cache()


@pytest.mark.parametrize("policy", list(POLICIES))
def test_policy(table, policy):
    obs, df = table
    kinds = set()
    for r in POLICIES[policy](df).collect():
        got = (r.pred.tool, r.pred.args.kind, r.pred.args.text, r.pred.args.choices, r.pred.args.obj)
        assert got == expected(policy, obs[r.id]), obs[r.id]
        kinds.add(got[0:2])
    assert len(kinds) >= 2


def test_motion_prior(table):
    obs, df = table
    for r in motion_prior(df).collect():
        cands = obs[r.id]["memory"]["candidates"]
        assert not cands or abs(sum(x.p for x in r.prior) - 1) < 1e-9
    assert candidate_labels(df).filter("id = 0").first().candidate_labels == [x for x in (label(obs[0], c) for c in obs[0]["memory"]["candidates"]) if x]


def test_perturbations(table):
    _, df = table
    for name, perturb in PERTURBATIONS.items():
        same = perturb(df, 0.0, 1).join(df.withColumnRenamed("obs", "was"), "id")
        if name in ("candidate_perturb", "label_noise"):
            assert same.filter(~F.col("obs").eqNullSafe(F.col("was"))).count() == 0
        once, again = (perturb(df.repartition(p), 0.5, 3).orderBy("id").collect() for p in (1, 17))
        assert once == again
    for r in PERTURBATIONS["user_input"](df, 1.0, 1).join(df.withColumnRenamed("obs", "was"), "id").collect():
        for now, was in zip(r.obs.gripper_hist, r.was.gripper_hist):
            assert dist(now.cell, was.cell) == 1 and now.yaw in ("NW", "NE") and now.z == was.z
    for r in PERTURBATIONS["grid_jitter"](df, 0.7, 1).collect():
        here = r.obs.gripper_hist[-1].cell if r.obs.gripper_hist else "B2"
        assert r.obs.memory.candidates == [o.id for o in r.obs.objects if dist(here, o.cell) <= 1]
    renamed = PERTURBATIONS["label_noise"](df, 1.0, 1).collect()
    assert all(o.label in S.OBJECT_LABELS for r in renamed for o in r.obs.objects)


def test_policy_scores_itself(table):
    _, df = table
    truth = POLICIES["heuristic_ask_if_ambiguous"](df).withColumnRenamed("pred", "gt_call").withColumn("env", F.lit("e"))
    curve = robustness_curve(truth, PERTURBATIONS["candidate_perturb"], POLICIES["heuristic_ask_if_ambiguous"], (0.0, 0.5)).orderBy("noise_level").collect()
    assert [c.n for c in curve] == [300, 300]
    assert (curve[0].tool_acc, curve[0].strict_match) == (100.0, 100.0) and curve[1].strict_match < 80
    report = accuracy_report(score_typed(POLICIES["heuristic_always_ask"](truth))).first()
    assert report.json_valid_rate == 1.0 and report.motion_n > 0 and report.motion_obj_accuracy == 0.0


def test_draws_made_ahead_move_the_same_poses(spark):
    """Levels from one draw per pose give what a perturbation at each rate gives, on odd cells, poses and objects too."""
    hists = [[("A1", "N", "LOW"), ("c3", "w", None)], [], None, [("B2", None, "LOW"), (None, "E", "LOW")], [("Z9", "up", "LOW")], [("B2", "N", "LOW"), None], [("", "N", "LOW")]]
    things = [[("obj_0", "mug", "B2", False), ("obj_1", "box", "a1", None), ("obj_2", "box", "C3", True), ("obj_3", "box", "c2", False)], []]
    rows = [(None if i == 41 else f"r{i}", (None if i % 13 == 5 else things[0 if i % 5 else 1] if h != [("", "N", "LOW")] else [], h, (["obj_9"], []) if i % 7 else None), i) for i, h in enumerate(hists * 12)]
    shape = "id string, obs struct<objects: array<struct<id: string, label: string, cell: string, is_held: boolean>>, gripper_hist: array<struct<cell: string, yaw: string, z: string>>, memory: struct<candidates: array<string>, excluded_obj_ids: array<string>>>, k int"
    df = spark.createDataFrame([*rows, ("none", None, 999)], shape)
    levels = (0.0, 0.1, 0.5, 1.0)
    got = perturb_at_levels(df, perturb_user_input, levels, 3)
    assert got.columns == ["id", "obs", "k", "noise_level"] and got.schema["obs"].dataType == df.schema["obs"].dataType
    listed = lambda d: {r.k: (r.id, r.obs) for r in d.collect()}
    moved = set()
    for p in levels:
        want = listed(perturb_user_input(df, p, 3))
        assert listed(got.filter(F.col("noise_level") == p)) == want and len(want) == len(rows) + 1
        moved.add(str(sorted(want.items())))
    assert len(moved) == 4


def test_distance_of_cells_in_either_case(spark):
    cells = ["A1", "a1", "C3", "c2", "b1", "é2", "É2", "ß1", None]
    df = spark.createDataFrame([(a, b) for a in cells for b in cells], "a string, b string")
    old = F.abs(F.ascii(F.upper("a")) - F.ascii(F.upper("b"))) + F.abs(F.substring("a", 2, 1).cast("int") - F.substring("b", 2, 1).cast("int"))
    assert df.filter(~cell_distance(F.col("a"), F.col("b")).eqNullSafe(old)).count() == 0
