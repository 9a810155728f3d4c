import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from decisionlog.operators import sampling as G


@pytest.fixture(scope="module")
def table(spark):
    tools = F.element_at(F.array(*[F.lit(t) for t in ("INTERACT", "INTERACT", "INTERACT", "INTERACT", "APPROACH", "ALIGN_YAW", "STACK", "X")]), (F.col("i") % 8 + 1).cast("int"))
    source = F.when(F.col("i") < 1500, "big").when(F.col("i") < 1525, "mid").otherwise("two")
    return spark.range(1527).withColumnRenamed("id", "i").select(F.concat(F.lit("r"), F.col("i")).alias("id"), tools.alias("tool"), source.alias("source"))


def test_rebalance_golden(spark):
    rows = [("s", "STACK"), ("i", "INTERACT"), ("g", "GRAB"), ("p", "POUR")]
    df = spark.createDataFrame(rows, "id string, tool string")
    ids = sorted(r.id for r in G.rebalance(df, 3).collect())
    assert ids == sorted(["i"] + [f"{x}_m{k}" for x in "sgp" for k in range(3)])
    assert G.rebalance_stats(df, 3).first().asDict() == {"kept_interact": 1, "kept_motion": 3, "dropped_interact": 0, "unknown": 0, "written": 10}


def test_rebalance_counts_and_partitions(table):
    stats = G.rebalance_stats(table, 2, 0.4, 9).first()
    one = sorted(r.id for r in G.rebalance(table.repartition(1), 2, 0.4, 9).collect())
    many = sorted(r.id for r in G.rebalance(table.repartition(64), 2, 0.4, 9).collect())
    assert one == many and len(one) == stats.written
    assert stats.kept_interact + stats.dropped_interact + stats.kept_motion + stats.unknown == 1527
    assert 0.3 < stats.kept_interact / (stats.kept_interact + stats.dropped_interact) < 0.5


@pytest.mark.parametrize("parts", [1, 64])
def test_split_by_source(table, parts):
    out = G.split_by_source(table.repartition(parts), 0.1, 4)
    got = {(r.source, r.split): r["count"] for r in out.groupBy("source", "split").count().collect()}
    assert got == {("big", "valid"): 150, ("big", "train"): 1350, ("mid", "valid"): 2, ("mid", "train"): 23, ("two", "valid"): 1, ("two", "train"): 1}
    tokens = [(r.t, r.id, r.split) for r in out.filter("source = 'big'").withColumn("t", G.draw(F.col("id"), "split", 4)).collect()]
    assert [s for *_, s in sorted(tokens)] == ["valid"] * 150 + ["train"] * 1350


def test_split_needs_two_rows(table):
    with pytest.raises(Exception, match="need at least two rows for source two"):
        G.split_by_source(table.filter("id != 'r1526'"), 0.1).count()


def test_auto_split_and_sample(table):
    assert Counter(r.split for r in G.auto_split(table).collect()) == {"valid": 76, "train": 1451}
    assert [r.split for r in G.auto_split(table.filter("id = 'r1'")).collect()] == ["train"]
    for n, want in ((0, 0), (1, 1), (700, 700), (9999, 1527)):
        rows = [r.id for r in G.uniform_sample(table, n, 2).collect()]
        assert len(rows) == len(set(rows)) == want


@pytest.mark.parametrize("train,valid", [(1, 1), (5, 3)])
def test_quota_golden(spark, train, valid):
    quotas = G.quotas(spark, train_scale=train, valid_scale=valid)
    pool = quotas.select("env", "tool", F.explode(F.sequence(F.lit(1), (F.col("train") + F.col("valid") + 11).cast("int"))).alias("k"))
    pool = pool.withColumn("id", F.concat_ws("-", "env", "tool", "k"))
    out = G.quota_split(pool, quotas, 7)
    got = {(r.split, r.env, r.tool): r["count"] for r in out.groupBy("split", "env", "tool").count().collect()}
    want = {(s, e, t): n * (train if s == "train" else valid) for s, envs in G.TARGETS.items() for e, tools in envs.items() for t, n in tools.items()}
    assert got == want
    totals = Counter()
    for (split, *_), n in got.items():
        totals[split] += n
    assert totals == {"train": 600 * train, "valid": 100 * valid}


@pytest.mark.parametrize("left", [10, 0])
def test_quota_short_bucket(spark, left):
    quotas = G.quotas(spark, {"train": {"e": {"A": 8, "B": 1}}, "valid": {"e": {"A": 4}}})
    pool = spark.createDataFrame([("e", "A", f"a{i}") for i in range(left)] + [("e", "B", "b")], "env string, tool string, id string")
    with pytest.raises(Exception, match=f"need 12 rows for e/A; found {left}"):
        G.quota_split(pool, quotas).collect()


def test_mixture_golden(spark):
    def source(name, counts):
        rows = [(f"{name}_{t}_{i}", t) for t, n in counts.items() for i in range(n)]
        return spark.createDataFrame(rows, "id string, tool string")

    base = source("a", {"INTERACT": 2200, "APPROACH": 200, "ALIGN_YAW": 100, "STACK": 200, "GRAB": 200, "POUR": 100})
    asked = source("b", {"INTERACT": 440, "APPROACH": 40, "ALIGN_YAW": 20, "STACK": 40, "GRAB": 40, "POUR": 20})
    out = G.mix({"a": (base, 1, 1.0), "b": (asked, 3, 1.0)}, 23)
    got = {r.tool: r["count"] for r in out.groupBy("tool").count().collect()}
    assert got == {"INTERACT": 2640, "APPROACH": 320, "ALIGN_YAW": 160, "STACK": 320, "GRAB": 320, "POUR": 160}
    assert sum(got.values()) == 3920 and out.select("id").distinct().count() == 3920


def test_null_strata_keep_their_rows(spark):
    rows = [(f"r{i}", None if i % 10 == 0 else "a") for i in range(100)]
    out = G.split_by_source(spark.createDataFrame(rows, "id string, source string"), 0.2, 1)
    got = {(r.source, r.split): r["count"] for r in out.groupBy("source", "split").count().collect()}
    assert got == {("a", "valid"): 18, ("a", "train"): 72, (None, "valid"): 2, (None, "train"): 8}


def test_whole_table_splits_have_no_cross_join(spark, table):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for out in (G.auto_split(table), G.uniform_sample(table, 50)):
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
