"""Bound queries: all of them build, and a spread of them equals DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from check import rows_of

DATA = "/root/testdata/sf0.001"
SPREAD = [
    "accuracy_report", "tool_confusion", "breakdown_sets", "generation_triage", "longest_runs", "decision_points", "episode_slice", "user_priors",
    "oscillation_flags", "distribution_similarity", "rebalance", "stratified_split", "quota_split", "cohen_kappa", "condition_summary", "policy_bayes",
    "question_ig", "layout_templates", "label_overlay", "path_lengths", "perturb_poses", "dialog_flipflops", "stream_decision_points",
    "jsonl_lenient", "contract_source", "scenario_round_trip", "csv_source", "append_twice", "metric_scrape", "contract_formats", "quantised_poses",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="benchmark tables are absent")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return con


def test_every_query_builds(spark):
    queries = entry.queries()
    assert set(entry.oracle_sql()) <= set(queries)
    for name, build in queries.items():
        if not name.startswith("stream_"):
            assert build(spark, DATA).columns, name
    assert entry.entry(spark).count() == 3


@pytest.mark.parametrize("name", SPREAD)
def test_against_oracle(spark, db, name):
    df = entry.queries()[name](spark, DATA)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = db.execute(entry.oracle_sql()[name])
    assert got == rows_of([d[0] for d in cursor.description], cursor.fetchall())


def test_scenes_hold_every_line_item(spark):
    from pyspark.sql import functions as F

    from decisionlog.plans import views as V

    t = V.Tables(spark, DATA)
    assert V.scenes(t).agg(F.sum(F.size("obs.objects"))).first()[0] == t.lineitem.count()
