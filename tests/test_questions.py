import json
import math
import random

import pytest
from pyspark.sql import functions as F

from decisionlog import schemas as S
from decisionlog.operators import questions as Q
from decisionlog.operators.ordered import by_number


def table(spark, cases):
    rows = []
    for i, (labels, cands, excluded, text, choices, *hist) in enumerate(cases):
        obs = {
            "objects": [{"id": f"o{k}", "label": x, "cell": "ABC"[k % 3] + "1"} for k, x in enumerate(labels)],
            "gripper_hist": [{"cell": c} for c in (hist[0] if hist else [])],
            "memory": {"candidates": cands, "excluded_obj_ids": excluded},
        }
        call = {"tool": "INTERACT", "args": {"kind": "QUESTION", "text": text, "choices": choices}}
        rows.append((i, json.dumps(obs), json.dumps(call)))
    df = spark.createDataFrame(rows, "id int, input string, output string")
    return df.select("id", F.from_json("input", S.OBSERVATION).alias("obs"), F.from_json("output", S.TOOL_CALL).alias("gt_call"))


def scored(spark, cases, prior="uniform"):
    df = table(spark, cases).withColumn("question", F.col("gt_call.args"))
    df = Q.simulate_replies(Q.classify_questions(Q.live_candidates(df)))
    return Q.information_gain(df, prior).orderBy("id").collect()


THREE = ["mug", "box", "can"]
MENU = ["1) mug", "2) box", "3) can", "4) None of them"]


def test_golden_gains(spark):
    got = scored(
        spark,
        [
            (["mug", "box"], ["o0", "o1"], [], "the mug?", ["1) YES", "2) NO"]),
            (THREE, ["o0", "o1", "o2"], [], "which?", MENU),
            (THREE, ["o0", "o1", "o2"], [], "anything else?", ["1) YES", "2) NO"]),
            (THREE, ["o0", "o1", "o2"], ["o2"], "", []),
        ],
    )
    assert [r.intent.kind for r in got] == ["binary_confirm", "candidate_choice", "noop", "noop"]
    assert [round(r.ig_bits, 6) for r in got] == [1.0, round(math.log2(3), 6), 0.0, 0.0]
    assert (got[0].intent.yes_idx, got[0].intent.no_idx, got[0].intent.targets) == (0, 1, ["o0"])
    assert got[1].intent.none_idx == 3 and got[1].intent.targets == ["o0", "o1", "o2"]
    assert got[0].replies[0].candidates == ["o0"] and got[0].replies[1].candidates == ["o1"]
    assert got[0].replies[1].excluded == ["o0"] and got[1].replies[3].candidates == []
    assert got[3].h_before_bits == 1.0 and got[3].live == ["o0", "o1"]


@pytest.mark.parametrize("prior", ["uniform", "motion_weighted"])
def test_gain_against_enumeration(spark, prior):
    rng = random.Random(3)
    cases = []
    for _ in range(120):
        labels = rng.sample(["mug", "box", "can", "cup", "jar"], rng.randint(1, 5))
        ids = [f"o{i}" for i in range(len(labels))]
        cands = rng.sample(ids, rng.randint(0, len(ids)))
        choices = rng.choice([["1) YES", "2) NO"], ["1) no", "2) yes", "3) maybe"], [f"{i + 1}) {x}" for i, x in enumerate(rng.sample(labels, rng.randint(1, len(labels))))] + ["9) None of them"][: rng.randint(0, 1)]])
        hist = rng.choice([[], ["A1"], ["C1", "A1"], ["A1", "B1"]])
        cases.append((labels, cands, [], f"the {rng.choice(labels)}?", choices, hist))
    for case, row in zip(cases, scored(spark, cases, prior)):
        labels, cands, _, text, choices, hist = case
        by_label = {x: f"o{k}" for k, x in enumerate(labels) if f"o{k}" in cands}
        plain = [c.split(") ", 1)[1].upper() for c in choices]
        picks = {i: by_label[p.lower()] for i, p in enumerate(plain) if p.lower() in by_label}
        none = next((i for i, p in enumerate(plain) if p == "NONE OF THEM"), None)
        told = [o for x, o in by_label.items() if x in text]
        n = len(choices)
        after = [set(cands)] * n
        weights = [1 / n] * n
        share = {c: 1 / len(cands) for c in cands}
        if hist and cands:
            cell = {c: "ABC"[int(c[1]) % 3] for c in cands}
            value = {}
            for c in cands:
                now = abs(ord(hist[-1][0]) - ord(cell[c]))
                value[c] = -1.5 * now
                if len(hist) > 1 and hist[-2] != hist[-1]:
                    value[c] += 0.5 * (abs(ord(hist[-2][0]) - ord(cell[c])) - now)
            z = sum(math.exp(v) for v in value.values())
            share = {c: math.exp(v) / z for c, v in value.items()}
        if len(picks) >= 2:
            kind = "candidate_choice"
            after = [{picks[i]} if i in picks else set(cands) - set(picks.values()) if i == none else set(cands) for i in range(n)]
            mass = sum(share[o] for o in picks.values())
            moved = [share[picks[i]] if i in picks else max(1 - mass, 0) if i == none else 0 for i in range(n)]
        elif "YES" in plain and "NO" in plain and len(told) == 1:
            kind = "binary_confirm"
            after = [{told[0]} if p == "YES" else set(cands) - {told[0]} if p == "NO" else set(cands) for p in plain]
            moved = [share[told[0]] if p == "YES" else 1 - share[told[0]] if p == "NO" else 0 for p in plain]
        else:
            kind, moved = "noop", weights
        assert row.intent.kind == kind
        if prior == "motion_weighted":
            weights = [m / (sum(moved) or 1) for m in moved]
        bits = lambda k: math.log2(k) if k > 1 else 0.0
        want = max(bits(len(cands)) - sum(w * bits(len(a)) for w, a in zip(weights, after)), 0)
        assert abs(row.ig_bits - want) < 1e-9, case
        assert [set(r.candidates) for r in row.replies] == after


def test_closed_form_gain(spark):
    """Gains from profiles equal those summed over replies, for repeated candidates, foreign targets, and questions without choices too."""
    rng = random.Random(8)
    cases = []
    for _ in range(150):
        labels = rng.sample(["mug", "box", "can", "cup", "jar"], rng.randint(1, 5))
        cands = [rng.choice([f"o{i}" for i in range(len(labels))]) for _ in range(rng.randint(0, 6))]
        listed = [f"{i + 1}) {x}" for i, x in enumerate(rng.sample(labels, rng.randint(1, len(labels))) + ["None of them", "?"][: rng.randint(0, 2)])]
        choices = rng.choice([[], ["1) YES", "2) NO"], ["1) no", "2) maybe", "3) yes"], listed, listed])
        cases.append((labels, cands, rng.sample(cands, min(1, len(cands))) if rng.random() < 0.3 else [], f"the {rng.choice(labels)}?", choices))
    df = Q.classify_questions(Q.live_candidates(table(spark, cases).withColumn("question", F.col("gt_call.args"))))
    columns = ["id", "intent.kind", "h_before_bits", "h_after_expected_bits", "ig_bits"]
    want = Q.information_gain(df).select(*columns).orderBy("id").collect()
    got = Q.profile_gain(Q.reply_profile(df)).select(*columns).orderBy("id").collect()
    assert {r.kind for r in want} == {"candidate_choice", "binary_confirm", "noop"}
    for a, b in zip(got, want, strict=True):
        assert tuple(a)[:2] == tuple(b)[:2] and tuple(a)[2:] == pytest.approx(tuple(b)[2:], abs=1e-12), cases[a.id]


def test_entropy(spark):
    row = spark.range(1).select(
        *[Q.entropy_bits(F.lit(n)).alias(f"n{n}") for n in (0, 1, 2, 4)],
        Q.weighted_entropy_bits(F.array(F.lit("a"), F.lit("b")), F.create_map(F.lit("a"), F.lit(0.9), F.lit("b"), F.lit(0.1))).alias("w"),
        Q.weighted_entropy_bits(F.array(F.lit("a"), F.lit("b")), F.create_map(F.lit("z"), F.lit(1.0))).alias("u"),
    ).first()
    assert (row.n0, row.n1, row.n2, row.n4, row.u) == (0.0, 0.0, 1.0, 2.0, 1.0) and abs(row.w - 0.468996) < 1e-6


def log(spark):
    def call(choices, kind="QUESTION"):
        return {"tool": "INTERACT", "args": {"kind": kind, "text": "t", "choices": choices}}

    rows = [
        {"scenario_id": "s", "tick": 0, "interact_kind": "confirm", "ig_bits": 0.4, "chosen": call(["1"]), "candidates": [{"ig_bits": 0.2, "tool_call": call(["1", "2"])}, {"ig_bits": 0.9, "tool_call": call(["1", "2", "3"])}, {"ig_bits": 0.9, "tool_call": call(["1", "4"])}]},
        {"scenario_id": "s", "tick": 1, "interact_kind": "?", "ig_bits": 0.0, "chosen": call(["1", "4"]), "candidates": [{"ig_bits": 0.0, "tool_call": call(["9"])}, {"ig_bits": 0.0, "tool_call": call(["4"])}]},
        {"scenario_id": "s", "tick": 2, "candidates": []},
    ]
    df = spark.createDataFrame([(json.dumps(r),) for r in rows], "v string")
    return df.select(F.from_json("v", S.QUESTIONS).alias("q")).select("q.*")


def test_selectors(spark):
    q = log(spark)
    got = {(r.tick, r.selector): r.ig_bits for r in Q.selector_scores(q).collect()}
    assert got == {(0, "chosen"): 0.4, (0, "no_rerank"): 0.2, (0, "random"): 0.666667, (0, "info_gain"): 0.9, (1, "chosen"): 0.0, (1, "no_rerank"): 0.0, (1, "random"): 0.0, (1, "info_gain"): 0.0}
    assert {r.interact_kind for r in Q.selector_scores(q).collect()} == {"CONFIRM", "OTHER"}
    picked = lambda s, **k: [r.picked for r in Q.select_question(q, s, **k).orderBy("tick").collect()]
    assert picked("info_gain") == [2, 0, 0] and picked("none") == [0, 0, 0]
    assert picked("oracle", reference="chosen") == [0, 1, 0]
    assert picked("random", seed=4) == picked("random", seed=4)
    with pytest.raises(ValueError):
        Q.select_question(q, "best")


def test_stats_and_histogram(spark):
    q = spark.createDataFrame([("A", 0.0, 1), ("A", 0.5, 2), ("A", 2.7, 2), ("B", 0.15, 3), ("B", 0.3, 1)], "interact_kind string, ig_bits double, n_candidates_before int")
    s = Q.ig_stats(q).first()
    assert (s.n, s.mean, s.median, s.frac_ge_gate) == (5, 0.73, 0.3, 0.4)
    h = {(r.interact_kind, r.bin): r.n for r in Q.ig_histogram(q).collect()}
    assert h == {("A", 0): 1, ("A", 10): 1, ("A", 39): 1, ("B", 3): 1, ("B", 6): 1}
    assert Q.ig_histogram(q, multi_candidate_only=True).agg(F.sum("n")).first()[0] == 3
    d = Q.ig_histogram(q, ("interact_kind",), 0.25, 4.0, density=True)
    assert all(abs(r[1] - 1) < 1e-9 for r in d.groupBy("interact_kind").agg(F.sum(F.col("density") * 0.25)).collect())
    assert Q.ig_overview(q).first().frac_gt_0 == 0.8


def test_dedup_and_log(spark):
    df = table(spark, [(THREE, ["o0", "o1"], [], "", []), (THREE, ["o1", "o0"], [], "x", []), (THREE, ["o1"], ["o0"], "", [])])
    kept = Q.dedup_states(df, by_number("id")).orderBy("id").collect()
    assert [r.id for r in kept] == [0, 2] and len(kept[0].state_hash) == 64
    cands = spark.createDataFrame([(1, 0, ("QUESTION", "a", ["x", "y"])), (1, 1, ("question", "b", ["y", "x"])), (1, 2, ("CONFIRM", "b", ["y", "x"]))], "k int, sample_idx int, question struct<kind:string,text:string,choices:array<string>>")
    assert sorted(r.sample_idx for r in Q.distinct_questions(cands, ["k"]).collect()) == [0, 2]
    contract = Q.score_contract_ig(table(spark, [(THREE, ["o0", "o1", "o2"], [], "which?", MENU)])).first()
    assert (contract.interact_kind, contract.context_type_hint, contract.n_candidates_before, contract.ig_bits) == ("QUESTION", "candidate_choice", 3, 1.584963)
    one = Q.live_candidates(table(spark, [(THREE, ["o0", "o1"], [], "the mug?", ["1) YES", "2) NO"])])).withColumn("question", F.col("gt_call.args"))
    one = Q.information_gain(Q.classify_questions(one))
    one = one.withColumn("candidates", F.array(F.struct(F.lit(0).alias("sample_idx"), F.col("gt_call").alias("tool_call"), "ig_bits", F.col("h_after_expected_bits").alias("h_after"), "per_reply")))
    row = Q.question_log(one.withColumn("scenario_id", F.lit("s")), ["scenario_id"], by_number("id")).first()
    assert (row.tick, row.ig_bits, row.h_before_bits, row.k_candidates, row.interact_kind) == (0, 1.0, 1.0, 1, "QUESTION")
    assert row.candidates[0].per_reply == [[0.0, 0.5, 0.0], [1.0, 0.5, 0.0]]


def test_first_states_with_wanted_columns_only(spark):
    df = table(spark, [(["cup"], ["o0"], [], "?", []), (["cup"], ["o0"], [], "!", []), (["pot"], ["o0"], ["o0"], "?", [])])
    whole = Q.dedup_states(df, by_number("id"))
    only = Q.dedup_states(df, by_number("id"), columns=["id"])
    assert only.columns == ["id", "state_hash"]
    assert sorted(map(tuple, only.collect())) == sorted(map(tuple, whole.select("id", "state_hash").collect()))
