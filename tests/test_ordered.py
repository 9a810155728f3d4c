"""Chunked ordered operators against a plain Python loop, with one key holding half the rows."""

import random

import pytest
from pyspark.sql import functions as F

from decisionlog.operators.ordered import CHUNK, balanced, by_number, by_time, in_chunks, position, previous, repeats, running, sum_adjacent, trailing


def log(seed, n=120):
    rng = random.Random(seed)
    rows = []
    for seq in rng.sample(range(1000), n):
        rows.append((rng.choice(["hot", "hot", "hot", "a", "b", "c"]), seq, rng.choice(["x", "x", "y", None])))
    return rows


def by_key(rows):
    groups = {}
    for key, seq, value in sorted(rows, key=lambda r: r[1]):
        groups.setdefault(key, []).append((seq, value))
    return groups


@pytest.fixture(params=[(1, 7, None), (2, 50, None), (3, 5000, None), (4, 5000, 10), (5, 100, 3)])
def case(request, spark):
    seed, size, crowd = request.param
    rows = log(seed)
    df, order = spark.createDataFrame(rows, "key string, seq int, value string").repartition(5), by_number("seq", size=size)
    return df, by_key(rows), balanced(df, ["key"], order, crowd) if crowd else order


def test_previous(case):
    df, groups, order = case
    got = {(r.key, r.seq): (r.before, r.seen) for r in previous(df, ["key"], order, {"before": "value"}, seen="seen").collect()}
    want = {}
    for key, items in groups.items():
        for i, (seq, _) in enumerate(items):
            want[key, seq] = (items[i - 1][1] if i else None, i > 0)
    assert got == want


@pytest.mark.parametrize("n,current", [(1, False), (3, False), (4, True)])
def test_trailing(case, n, current):
    df, groups, order = case
    got = {(r.key, r.seq): r.w for r in trailing(df, ["key"], order, "value", n, "w", include_current=current).collect()}
    want = {}
    for key, items in groups.items():
        values = [v for _, v in items]
        for i, (seq, _) in enumerate(items):
            stop = i + 1 if current else i
            want[key, seq] = values[max(0, stop - n) : stop]
    assert got == want


def test_running_and_position(case):
    df, groups, order = case
    out = position(running(df, ["key"], order, {"total": F.col("seq")}), ["key"], order)
    got = {(r.key, r.seq): (r.total, r.pos) for r in out.collect()}
    want = {}
    for key, items in groups.items():
        total = 0
        for i, (seq, _) in enumerate(items):
            total += seq
            want[key, seq] = (total, i + 1)
    assert got == want


def test_position_without_keys(case):
    df, groups, order = case
    order = by_number("seq", size=50) if order.cuts is not None else order
    seqs = sorted(s for items in groups.values() for s, _ in items)
    got = {r.seq: r.pos for r in position(df, [], order).collect()}
    assert got == {s: i + 1 for i, s in enumerate(seqs)}


def test_sum_adjacent(case):
    df, groups, order = case
    changed = {"n": lambda p, c: F.when(p["v"] != c["v"], 1).otherwise(0), "gap": lambda p, c: c["s"] - p["s"]}
    out = sum_adjacent(df, ["key"], order, {"v": "value", "s": "seq"}, changed)
    got = {r.key: (r.n, r.gap) for r in out.collect()}
    want = {}
    for key, items in groups.items():
        pairs = list(zip(items, items[1:]))
        n = sum(1 for a, b in pairs if a[1] and b[1] and a[1] != b[1])
        want[key] = (n, sum(b[0] - a[0] for a, b in pairs))
    assert got == want


def test_repeats(case):
    df, groups, order = case
    got = {r.key: (r.rows, r.longest_run, r.duplicate_transitions) for r in repeats(df, ["key"], order, "value").collect()}
    want = {}
    for key, items in groups.items():
        values = [v for _, v in items]
        best = run = 1
        dups = 0
        for a, b in zip(values, values[1:]):
            run = run + 1 if a == b and b is not None else 1
            dups += a == b and b is not None
            best = max(best, run)
        want[key] = (len(values), best, dups)
    assert got == want


def test_null_keys(spark):
    from decisionlog.operators.ordered import CHUNK, balanced, by_number, by_time, in_chunks, position, previous

    df = spark.createDataFrame([(None if i < 20 else "k", i) for i in range(30)], "key string, seq int")
    order = by_number("seq", size=5)
    assert sorted(r.at for r in position(df, ["key"], order, "at").filter("key is null").collect()) == list(range(1, 21))
    back = {r.seq: r.old for r in previous(df, ["key"], order, {"old": "seq"}).collect()}
    assert back == {i: None if i in (0, 20) else i - 1 for i in range(30)}


def test_a_crowded_hour_is_cut(spark):
    """One user with 20,000 rows in one hour, most of them in a minute of it: no part has much more than its share."""
    ts = F.timestamp_seconds(F.when(F.col("id") % 4 == 0, F.col("id") % 3600).otherwise(1800 + (F.col("id") % 60000) / 1000))
    df = spark.range(20_000).select((F.col("id") % 50 == 0).cast("int").alias("user"), ts.alias("ts"), "id")
    order = balanced(df, ["user"], by_time("ts", "id"), 1000)
    sizes = [r["count"] for r in in_chunks(df, order).groupBy("user", CHUNK).count().collect()]
    assert order.cuts.count() == 1 and sum(sizes) == 20_000 and max(sizes) < 3 * 20_000 / 64
    named = df.withColumns({"_at": F.col("id"), "cuts": F.col("id")})  # columns of such names stay as they are
    assert in_chunks(named, order).filter("_at <> id or cuts <> id").count() == 0 and in_chunks(named, order).columns == [*named.columns, CHUNK]
    numbered = position(df, ["user"], order)
    plain = position(df, ["user"], by_time("ts", "id"))
    assert numbered.join(plain.withColumnRenamed("pos", "p"), "id").filter("pos <> p").count() == 0
