import json

from pyspark.sql import functions as F

from decisionlog.operators import profile as P
from decisionlog.operators.ordered import by_number


def test_distributions_and_similarity(spark):
    a = spark.createDataFrame([("x", ["p", "q"])] * 3 + [("y", [])], "tool string, shapes array<string>")
    b = spark.createDataFrame([("x", ["p"])] + [(None, None)], "tool string, shapes array<string>")
    got = {(r.dim, r.value): r.n for r in P.distributions(a, ["tool", "shapes"]).collect()}
    assert got == {("tool", "x"): 3, ("tool", "y"): 1, ("shapes", "p"): 3, ("shapes", "q"): 3}
    out = {r.dim: r.max_abs_prop_delta for r in P.similarity(a.withColumn("z", F.lit(None).cast("string")), b.withColumn("z", F.lit(None).cast("string")), ["tool", "shapes", "z"]).collect()}
    assert out == {"tool": 0.25, "shapes": 0.5, "z": 0.0}
    assert {(r.tool, r.n) for r in P.distribution(b, "tool", absent="none").collect()} == {("x", 1), ("none", 1)}


def test_summary_and_facts(spark):
    rows = [("train", "A", "e1", "t"), ("train", "B", "e1", "t"), ("valid", "A", "e2", None)]
    df = spark.createDataFrame(rows, "split string, tool string, env string, mode string")
    got = {(r.split, r.dim, r.value): r.n for r in P.dataset_summary(df).collect()}
    assert got[("train", "rows", "all")] == 2 and got[("train", "env", "e1")] == 2 and got[("valid", "mode", None)] == 1
    blob = {"objects": [{"id": 1, "a": 2}], "memory": {"past_dialogs": [{"role": "user", "content": ""}]}, "user_state": {"mode": "translation"}}
    call = {"tool": "INTERACT", "args": {"kind": "CONFIRM"}}
    fact = P.contract_facts(spark.createDataFrame([(json.dumps(blob), json.dumps(call))], "input string, output string")).first()
    assert (fact.tool, fact.mode, fact.interact_kind, fact.object_shapes, fact.dialog_shapes) == ("INTERACT", "translation", "CONFIRM", ["a,id"], ["content,role"])


def test_replies(spark):
    turns = spark.createDataFrame(
        [("user", " yes ", "confirm"), ("user", "NO", "confirm"), ("assistant", "YES", "confirm"), ("user", "None of them", None), ("user", "align_yaw", "mode_select")],
        "role string, content string, context string",
    )
    got = {r.context: (r.replies, r.yes, r.no, r.none_of_them, r.mode_align_yaw) for r in P.reply_distribution(turns).collect()}
    assert got == {"confirm": (2, 1, 1, 0, 0), "unknown": (1, 0, 0, 1, 0), "mode_select": (1, 0, 0, 0, 1)}
    words = P.reply_keywords(turns.withColumnRenamed("content", "reply")).first()
    assert (words.yes, words.no, words.none_of_them) == (2, 2, 1)


def episodes(spark):
    rows = [
        (2, 10, "A", None), (2, 11, "A", None), (2, 12, "INTERACT", "q"),
        (1, 20, "B", None), (1, 21, "INTERACT", "q"), (1, 22, "INTERACT", "q"), (1, 23, "INTERACT", "r"),
    ]
    return spark.createDataFrame(rows, "episode_id int, seq int, tool string, prompt string")


def test_runs_and_lengths(spark):
    order = by_number("seq", size=2)
    df = episodes(spark)
    worst = {r.what: (r.episode, r.run) for r in P.worst_runs(df, order, {"tool": "tool", "prompt": "prompt"}).collect()}
    assert worst == {"tool": (1, 3), "prompt": (1, 2)}
    tie = P.worst_runs(df.filter("seq < 22"), order, {"prompt": "prompt"}).first()
    assert (tie.episode, tie.run) == (2, 1)  # the earlier episode wins a tie
    assert P.episode_lengths(df).first().asDict() == {"rows": 7, "episodes": 2, "min_len": 3, "max_len": 4, "avg_len": 3.5}
    assert [tuple(r) for r in P.top_values(df, "tool", 2, ("seq",)).collect()] == [("INTERACT", 4), ("A", 2)]


def test_flip_flops(spark):
    talk = [("assistant", "this one?"), ("user", "yes"), ("assistant", "this one? "), ("user", " NO"), ("assistant", "this one?"), ("user", "yes"), ("user", "no")]
    rows = [(1, i, r, c) for i, (r, c) in enumerate(talk)]
    turns = spark.createDataFrame(rows, "conv int, turn int, role string, content string")
    assert P.flip_flops(turns, "conv", by_number("turn", size=2)).first().flip_flops == 2
    snaps = turns.groupBy("conv").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "content"))), lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("d"))
    snaps = snaps.select("conv", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("n"), "d").withColumn("d", F.slice("d", F.lit(1), F.col("n")))
    assert P.snapshot_flip_flops(snaps, "conv", "d").first().flip_flops == 2


def test_objects_and_symbols(spark):
    obj = "objects array<struct<label:string,cell:string>>"
    df = spark.createDataFrame(
        [(1, 5, [("mug", "A1"), ("box", "A1")]), (1, 6, [("can", "C3")]), (2, 1, [("box", "B1"), ("mug", "B2")]), (3, 9, [])], f"episode_id int, seq int, {obj}"
    )
    order = by_number("seq", size=3)
    assert P.object_overlap(df, order).first().asDict() == {
        "episodes": 3, "episodes_with_overlap": 1, "overlap_rate": 1 / 3, "min_sharing": 1, "max_sharing": 2, "avg_sharing": 4 / 3
    }
    assert [tuple(r) for r in P.label_coverage(df, order).collect()] == [("box", 2), ("mug", 2)]
    hist = spark.createDataFrame([([("A1", "N", None)] * 2, ["o"]), ([("A1", "E", "LOW")], None)], "gripper_hist array<struct<cell:string,yaw:string,z:string>>, cands array<string>")
    got = {(r.symbol, r.value): r.n for r in P.symbol_coverage(hist, candidates="cands").collect()}
    assert got == {("cell", "A1"): 3, ("yaw", "N"): 2, ("yaw", "E"): 1, ("z", "LOW"): 1, ("candidates", "1"): 1, ("candidates", "0"): 1}
