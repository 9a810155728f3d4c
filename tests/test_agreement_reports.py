import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from decisionlog import schemas as S
from decisionlog.operators import agreement as A
from decisionlog.operators import reports as R


def kappa(la, lb):
    n = len(la)
    if not n:
        return None
    po = sum(x == y for x, y in zip(la, lb)) / n
    ca, cb = Counter(la), Counter(lb)
    pe = sum(ca[c] * cb[c] for c in set(la) | set(lb)) / n / n
    return (po - pe) / (1 - pe) if pe < 1 else (1.0 if po == 1 else None)


def fleiss(rows):
    k, n = len(rows[0]), len(rows)
    cats = sorted({x for r in rows for x in r})
    m = [[r.count(c) for c in cats] for r in rows]
    pe = sum((sum(r[j] for r in m) / n / k) ** 2 for j in range(len(cats)))
    pbar = sum((sum(x * x for x in r) - k) / (k * (k - 1)) for r in m) / n
    return (pbar - pe) / (1 - pe) if pe < 1 else (1.0 if pbar == 1 else None)


def test_kappas(spark):
    rng = random.Random(1)
    raters = ["ali", "bo", "c d"]
    rows, last = [], {}
    for seq in range(400):
        item, rater, label = rng.randrange(60), rng.choice(raters), rng.choice("xxyz")
        rows.append((item, rater, label, seq))
        last[item, rater] = label
    df = spark.createDataFrame(rows, "item int, rater string, label string, seq int").repartition(7)
    aligned = A.align_raters(df, ["item"], "rater", "label", raters, "seq")
    items = [i for i in range(60) if all((i, r) in last for r in raters)]
    assert {tuple(r) for r in aligned.collect()} == {(i, *[last[i, r] for r in raters]) for i in items}
    got = {(r.rater_a, r.rater_b): (r.n, r.kappa) for r in A.cohen_kappa(aligned, raters).collect()}
    for a, b in itertools.combinations(raters, 2):
        assert got[a, b][0] == len(items)
        assert abs(got[a, b][1] - kappa([last[i, a] for i in items], [last[i, b] for i in items])) < 1e-12
    f = A.fleiss_kappa(aligned, raters).first()
    assert f.items == len(items) and abs(f.kappa - fleiss([[last[i, r] for r in raters] for i in items])) < 1e-12


def test_kappa_fixture(spark):
    calls = [(i, r, ("INTERACT" if r == "ali" and i >= 4 or r == "ali_v2" else "GRAB", ("o1",)), i) for i in range(13) for r in ("ali", "ali_v2")]
    df = spark.createDataFrame(calls, "item int, rater string, call struct<tool:string,args:struct<obj:string>>, seq int")
    raters = ["ali", "ali_v2"]
    ask = A.align_raters(df.withColumn("l", A.ask_or_act(F.col("call"))), ["item"], "rater", "l", raters, "seq")
    row = A.cohen_kappa(ask, raters).first()
    assert (row.n, row.kappa) == (13, 0.0)
    act = A.align_raters(df.withColumn("l", A.act_label(F.col("call"))), ["item"], "rater", "l", raters, "seq")
    row = A.cohen_kappa(act, raters).first()
    assert (row.n, row.kappa) == (0, None)
    same = spark.createDataFrame([(1, "a", "a"), (2, "a", "a")], "item int, p string, q string")
    assert A.cohen_kappa(same, ["p", "q"]).first().kappa == 1.0
    assert A.fleiss_kappa(same, ["p", "q"]).first().kappa == 1.0


def rollouts(spark):
    rows = [("assisted", "clean", "easy", 1, 10.0, 4), ("assisted", "clean", "easy", 1, 13.0, 8), ("assisted", "clean", "easy", 0, 99.0, 50), ("manual", "clean", "hard", 0, 1.0, 1)]
    df = spark.createDataFrame(rows, "mode string, condition string, difficulty string, success int, completion_time_sec double, total_inputs int")
    more = ("interactions", "dropped_inputs", "direction_reversals", "motion_tool_calls", "target_filtered_out", "terminated_at_max_ticks")
    return df.withColumns({c: F.when(F.col("success") == 1, 1).otherwise(4) for c in more})


def test_conditions(spark):
    got = {r.mode: r for r in R.condition_summary(rollouts(spark)).collect()}
    p = got["assisted"]
    assert (p.n_rollouts, p.success_rate, p.mean_completion_time_sec, p.std_completion_time_sec) == (3, 0.6667, 11.5, 2.121)
    assert (p.mean_total_inputs, p.std_total_inputs, p.mean_interactions, p.max_ticks_rate) == (6.0, 2.83, 2.0, 2.0)
    assert (got["manual"].mean_completion_time_sec, got["manual"].std_total_inputs) == (0.0, 0.0)


def test_weighted_golden(spark):
    rows = [("assisted", "clean", "easy", 128, 1.0, 1.0, 5.0), ("assisted", "clean", "hard", 154, 0.7013, 2.0, 6.0), ("manual", "clean", "hard", 5, 0.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "mode string, condition string, difficulty string, n_rollouts bigint, success_rate double, mean_interactions double, mean_completion_time_sec double")
    row = R.weighted_conditions(df, "assisted").first()
    assert row.n == 282 and round(row.success_rate, 4) == 0.8369
    assert R.weighted_conditions(df, "assisted", "easy").first().success_rate == 1.0
    cells = R.cell_means(df.withColumn("cell", F.lit("m__x__random")), "assisted").first()
    assert (cells.success_rate, cells.n_rollouts) == (0.8506, 282) or (cells.success_rate, cells.n_rollouts) == (0.8507, 282)
    ig = spark.createDataFrame([("m__x__random", "chosen", 0.6), ("m__x__random", "chosen", 0.1), ("z", "random", 1.0)], "cell string, selector string, ig_bits double")
    table = R.ablation_table(R.cell_means(df.withColumn("cell", F.lit("m__x__random")), "assisted"), R.cell_ig(ig)).first()
    assert (table.model, table.rerank, table.mean_ig_bits, table.frac_ig_ge_0p5) == ("m__x", "random", 0.35, 0.5)
    model, mode = R.cell_name(F.lit("plain"))
    assert tuple(spark.range(1).select(model, mode).first()) == ("plain", "info_gain")


@pytest.fixture
def cells(spark):
    rows = [("a", "oracle_valid_ycb", 0.9, 100.0), ("a", "oracle_valid_pouring", 0.7, 0.0), ("a", "ambiguous_ycb", 0.5, None), ("oracle_lora", "woz_valid", 0.4, 2.0)]
    df = spark.createDataFrame(rows, "_model_safe string, _eval_set string, tool_accuracy double, eps double")
    counts = "map('x', map('n', 4L, 'tool_correct', 3L), 'invalid_input_json', map('n', 1L))"
    confusion = "map('INTERACT', map('INTERACT', 47L, 'APPROACH', 3L, 'INVALID_JSON', 9L), 'APPROACH', map('APPROACH', 17L))"
    df = df.withColumns({"by_context": F.expr(counts), "tool_confusion": F.expr(confusion), "timing": F.struct(F.col("eps").alias("examples_per_sec")), "n": F.lit(150).cast("bigint")})
    return df.withColumns({c: F.lit(None).cast("string") for c in ("_display", "_group", "_env", "_flavor")}).withColumns({c: F.lit(0.5) for c in ("schema_valid_rate", "strict_exact_rate", "motion_obj_accuracy", "interact_kind_accuracy")}).withColumn("model", F.struct(F.lit("nm").alias("name"), F.lit("llm").alias("kind"), F.lit("p").alias("model_path")))


def test_cell_tables(spark, cells):
    avg = {r._model_safe: r for r in R.macro_average(cells).collect()}
    assert abs(avg["a"].avg3 - 0.8) < 1e-12 and avg["a"].stacking is None and avg["oracle_lora"].avg3 is None
    gap = {r._model_safe: r.gap for r in R.clean_gap(cells).collect()}
    assert abs(gap["a"] + 0.3) < 1e-12 and gap["oracle_lora"] is None
    assert {r.panel_no for r in R.ablation_panels(cells).collect()} == {0, 2}
    assert sorted(r.examples_per_sec for r in R.throughput(cells).collect()) == [2.0, 100.0]
    heat = R.context_heat(cells, "woz_valid").collect()
    assert [(r.context, r.accuracy, r.n) for r in heat] == [("x", 0.75, 4)]
    row = R.coverage_matrix(cells, ["woz_valid", "ambiguous_ycb"]).filter("_model_safe = 'a'").first()
    assert (row.woz_valid, row.ambiguous_ycb) == (False, True)
    assert R.flat_metrics(cells).filter("eval_set = 'ambiguous_ycb'").first().examples_per_sec == 0.0
    models = spark.createDataFrame([("a", "Model A", "heuristic", None, "baseline")], "safe_name string, display string, kind string, model_path string, `group` string")
    sets = spark.createDataFrame([("woz_valid", "all", "woz", "Annotators")], "name string, env string, flavor string, display string")
    got = {(r._model_safe, r._eval_set): r for r in R.resolve_registry(cells, models, sets).collect()}
    assert got["a", "ambiguous_ycb"].model_display == "Model A" and got["oracle_lora", "woz_valid"].model_display == "nm"
    assert got["oracle_lora", "woz_valid"].eval_display == "Annotators" and got["a", "ambiguous_ycb"].model_path == "p"
    long = R.cell_confusion(cells.filter("_eval_set = 'woz_valid'"))
    right = long.filter("gt_tool = pred_tool").agg(F.sum("n")).first()[0]
    assert round(right / 150, 5) == 0.42667  # the published confusion of this cell


def test_small_reports(spark):
    df = spark.createDataFrame([("a", 0.5, 1), ("b", 0.9, 3), ("c", 0.9, 2), ("d", None, 0)], "m string, v double, o int")
    assert [r.m for r in R.flag_best(df, "v", ties=["o"]).filter("best").collect()] == ["c"]
    assert [r.m for r in R.flag_best(df, "v", higher=False, ties=["o"]).filter("best").collect()] == ["a"]
    grid = R.sweep_grid(spark.createDataFrame([("s1",), ("s2",)], "scenario_id string"), ["clean", "noisy"], ["assisted"], 3)
    assert grid.count() == 12
    assert R.pending(grid, grid.filter("seed < 2"), ["scenario_id", "condition", "mode", "seed"]).count() == 4
    xy = spark.createDataFrame([(1, 2.0), (2, 4.1), (3, 5.9), (4, 8.0)], "x int, y double")
    assert abs(R.correlate(xy, "x", "y").first().r - 0.99957) < 1e-4
    line = R.trend(xy, "x", "y").first()
    assert abs(line.slope - 1.98) < 1e-9 and abs(line.intercept - 0.05) < 1e-9
    master = spark.createDataFrame([("t1", "assistive", 3, None), ("t2", "manual", 3, 1), ("t3", "assistive", None, 1)], "trial_id string, mode string, n_plausible_targets int, n_tool_failures int")
    assert [tuple(r) for r in R.join_trial_metrics(spark.createDataFrame([("t1", 5), ("t2", 5), ("t3", 5)], "trial_id string, n_int int"), master).collect()] == [("t1", "assistive", 3, 0, 5)]
    call = "struct<tool:string,args:struct<obj:string>>"
    pairs = spark.createDataFrame([("k", ("A", ("o",)), ("A", ("o",))), ("k", ("A", ("o",)), ("A", ("p",))), ("k", ("A", None), ("B", None))], f"ambiguity_category string, target_tool_call {call}, oracle_baseline_call {call}")
    assert R.baseline_disagreement(pairs).first().asDict() == {"ambiguity_category": "k", "n": 3, "tool_differs": 1, "call_differs": 2}
