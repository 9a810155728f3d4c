"""Steps that a plan holds once, wherever their results are filtered or joined."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from decisionlog.functions.bind import once
from decisionlog.operators import contracts as C
from decisionlog.operators import evaluate as E
from decisionlog.operators import perturb as N
from decisionlog.operators import policies as B
from decisionlog.operators import trials as T
from decisionlog.plans import evaluation, scenes
from decisionlog.plans import views as V

LINES = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string"
ORDERS = "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan()


def _tables(spark, folder):
    lines = [(o, n, o * 7 + n * 2, o + n, "R" if n == 1 else "N") for o in range(1, 9) for n in range(o % 4)]
    spark.createDataFrame(lines, LINES).write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(o, o * 3, "FOP"[o % 3], "1-URGENT") for o in range(1, 9)], ORDERS).write.parquet(f"{folder}/orders.parquet")
    events = [(k, datetime(2024, 1, 1, 0, k), k % 2, "view", 1.0, f'{{"k": {k}}}') for k in range(30)]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{folder}/events.parquet")
    return V.Tables(spark, str(folder))


def test_values_replace_columns_of_their_name_and_keep_nulls(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, x string")
    out = once(df, {"x": F.upper("x"), "y": F.struct(F.length("x").alias("n"))})
    assert out.columns == ["id", "x", "y"]
    assert sorted((r.id, r.x, r.y.n) for r in out.collect()) == [(1, "A", 1), (2, None, None)]


def test_a_filter_on_what_a_policy_says_holds_no_copy_of_the_policy(spark, tmp_path):
    t = _tables(spark, tmp_path)
    asked = B.ask_if_ambiguous(V.scenes(t)).filter("pred.tool = 'INTERACT' and size(obs.memory.candidates) <> 1")
    plan = _plan(asked).toString()
    assert plan.count("None of them") == 1 and plan.count("inline") == 3
    joins = [x for x in plan.splitlines() if "Join " in x]
    assert len(joins) == 1 and "filter(" not in joins[0]


def test_a_prior_is_weighed_once_below_a_filter(spark, tmp_path):
    assert _plan(scenes.motion_prior(_tables(spark, tmp_path))).toString().count("EXP(") == 1


def test_valid_rows_are_turned_into_json_once(spark):
    df = spark.range(3).select(F.col("id").cast("string").alias("id"), F.lit("i").alias("instruction"), F.lit("").alias("input"), F.to_json(F.struct("id")).alias("output"))
    ok, bad = C.validate_contract(df)
    assert _plan(ok).toString().count("StructsToJson") == 1
    assert ok.count() == 3 and bad.count() == 0


def test_mistakes_are_scored_once_and_by_more_tasks_than_a_file_has(spark, tmp_path):
    rows = evaluation.scored(_tables(spark, tmp_path))
    plan = _plan(E.cap_mistakes(rows, 5, "event_id")).toString()
    assert plan.count("INVALID_JSON") == 1 and plan.count("RepartitionByExpression") == 1
    assert [r.id for r in E.cap_mistakes(rows, 5, "event_id").collect()] == sorted(r.id for r in rows.filter("error_type is not null").collect())[:5]


def test_the_true_call_is_described_before_the_levels(spark, tmp_path):
    truth = B.ask_if_ambiguous(V.scenes(_tables(spark, tmp_path))).withColumnRenamed("pred", "gt_call")
    plan = _plan(E.robustness_curve(truth, N.perturb_user_input, B.ask_if_ambiguous, keys=["status"])).toString().splitlines()
    levels = next(i for i, x in enumerate(plan) if "explode([0.0" in x)
    assert any("[_gt#" in x for x in plan[levels:]) and not any("[_gt#" in x for x in plan[:levels] if "Generate" in x)


def test_trials_meet_their_layouts_in_one_join(spark):
    trials = spark.createDataFrame([(1, "a", "F"), (2, "b", "F"), (3, None, "F"), (4, "b", "P"), (4, "b", "P"), (5, "a", None)], "trial long, subject string, difficulty string")
    shape = "array<struct<id:string>>, gripper_init struct<cell:string>, n_source_trials long"
    own = spark.createDataFrame([("a", "F", [("x",)], ("A1",), 2)], f"subject string, difficulty string, objects {shape}")
    pooled = spark.createDataFrame([("F", [("x",), ("y",)], ("A2",), 5)], f"difficulty string, objects {shape}")
    placed, dropped = T.inherit_layout(trials, own, pooled)
    assert sorted((r.trial, len(r.objects), r.notes) for r in placed.collect()) == [(1, 1, "template=own, trials=2"), (2, 2, "template=pooled, trials=5"), (3, 2, "template=pooled, trials=5")]
    assert sorted(r.trial for r in dropped.collect()) == [4, 4, 5]
    node = _plan(placed)
    while node.nodeName() != "Join":
        node = node.children().apply(0)
    assert "Join" not in node.children().apply(0).toString()


def test_draws_are_made_before_the_levels_and_pairs_scored_once(spark, tmp_path):
    truth = B.ask_if_ambiguous(V.scenes(_tables(spark, tmp_path))).withColumnRenamed("pred", "gt_call")
    plan = _plan(E.robustness_curve(truth, N.perturb_user_input, B.ask_if_ambiguous, keys=["status"])).toString().splitlines()
    at = lambda text: [i for i, x in enumerate(plan) if text in x]
    levels, pairs = at("explode([0.0"), at("count(1) AS _times")
    assert len(levels) == 1 and at("md5(") and min(at("md5(")) > levels[0]
    assert pairs and max(at("INVALID_JSON")) < min(pairs) < levels[0]
