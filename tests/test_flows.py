import json

from pyspark.sql import functions as F

from decisionlog import schemas as S
from decisionlog.plans import flows
from tests.test_contracts import record
from tests.test_questions import log
from tests.test_trials import logs  # noqa: F401


def test_prepare_and_benchmark(spark, tmp_path):
    for source, n in (("woz_kitchen", 30), ("lab", 10)):
        d = tmp_path / source
        d.mkdir()
        (d / "log.jsonl").write_text("".join(json.dumps(record(i, 2, "GRAB" if i % 2 else "APPROACH")) + "\n" for i in range(n)))
    out = flows.prepare(spark, [str(tmp_path / "woz_kitchen"), str(tmp_path / "lab")], "be brief", repeat=3)
    got = {(r.source, r.split): r["count"] for r in out["contract"].groupBy("source", "split").count().collect()}
    assert got == {("kitchen", "valid"): 3, ("kitchen", "train"): 27, ("lab", "valid"): 1, ("lab", "train"): 9}
    assert out["train"].count() == 108 and out["chat"].count() == 112 and out["rejected"].count() == 0
    assert out["stats"].first().written == 108
    contract = out["contract"]
    answers = contract.select("id", F.when(F.col("tool") == "GRAB", F.lit("no")).otherwise(F.col("output")).alias("raw"))
    result = flows.benchmark(contract, answers)
    report = result["report"].first()
    assert (report.n, report.json_errors, report.tool_accuracy, report.motion_n, report.strict_exact_rate) == (40, 20, 0.5, 20, 0.5)
    assert {(r.gt_tool, r.pred_tool, r.n) for r in result["confusion"].collect()} == {("APPROACH", "APPROACH", 20), ("GRAB", "INVALID_JSON", 20)}
    assert {(r.dim, r.key): r.n for r in result["breakdowns"].collect()} == {("context", "confirm"): 40, ("mode", "rotation"): 40, ("cands", "cands_1"): 40}


def test_extract(spark, logs):  # noqa: F811
    labels = spark.createDataFrame([("manual_s2_easy_trial_4", "obj_1", "", "", 1)], "scenario_id string, target_obj_id string, layout_override string, notes string, row int")
    out = flows.extract(spark, logs, labels=labels)
    rows = {r.scenario_id: r for r in out["scenarios"].collect()}
    assert len(rows) == 4 and rows["manual_s2_easy_trial_4"].target_label_source == "hand_label"
    assert out["contract"].count() == 4 and out["skipped"].count() == 0
    assert {(r.dim, r.key): r.n for r in out["report"].collect()}[("total", "dropped")] == 1


def test_question_report(spark):
    out = flows.question_report(log(spark))
    assert {r.selector: r.n for r in out["selectors"].collect()} == {s: 2 for s in ("chosen", "no_rerank", "random", "info_gain")}
    assert out["by_kind"].count() == 8 and "ig_bits" in out["per_question"].columns and S.MAX_CHOICES == 5
