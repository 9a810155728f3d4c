"""Clustering and search of vectors, and Merkle manifests, against plain versions."""

import hashlib
import math
import random
import time
import zlib
from collections import defaultdict

import pytest

from decisionlog.llm import centroids, merkle, queries, topk  # noqa: F401
from decisionlog.llm.shared import stored

SCHEMA = "vec_id long, embedding array<float>, cluster int, v string, row long"


def vectors(n=300, dim=6, seed=1):
    draw = random.Random(seed)
    rows = [(i, [draw.choice([-0.5, 0.0, 0.25, draw.uniform(-1, 1)]) for _ in range(dim)]) for i in range(n)]
    rows[7:9] = [(7, rows[3][1]), (8, rows[3][1])]
    rows += [rows[5], rows[20], (None, rows[6][1]), (None, [0.1] * dim)]
    rows += [(n, None), (n + 1, []), (n + 2, [None] * dim), (n + 3, [math.nan] + [0.0] * (dim - 1)), (n + 4, [math.inf] * dim), (n + 5, [0.5] * (dim + 1)), (n + 10, [])]
    rows += [(n + 6, [1e30] + [0.0] * (dim - 1)), (20 * n, [0.5] * (dim + 1))]
    return [(i, v, 1, "x", 2) for i, v in rows]


def ints(v, scale):
    """Components as integers, or None where the row takes no part."""
    import numpy as np

    if v is None or any(x is None or not math.isfinite(x) for x in v):
        return None
    out = [math.floor(scale * float(np.float32(x))) for x in v]
    return out if all(abs(x) <= 1 << 27 for x in out) else None


def plain_clusters(rows, k, rounds, dim, scale, salt):
    kept = [(i, v) for i, v in ((r[0], ints(r[1], scale)) for r in rows) if v is not None and len(v) == dim]
    draw = lambda r: (r[0] is None, hashlib.sha256(f"{salt}{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    middle = [v for _, v in sorted(kept, key=draw)[:k]]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min((distance(v, c), j) for j, c in enumerate(middle))
    for _ in range(rounds):
        held = defaultdict(list)
        for _, v in kept:
            held[nearest(v)[1]].append(v)
        middle = [[sum(x) // len(held[j]) for x in zip(*held[j], strict=True)] if j in held else c for j, c in enumerate(middle)]
    found = [(i, *nearest(v)) for i, v in kept]
    inertia = defaultdict(int)
    for _, d, j in found:
        inertia[j] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in middle]
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), digest[j]) for i, d, j in found), key=repr)


@pytest.mark.parametrize(("k", "rounds", "scale"), [(1, 2, 256), (2, 1, 256), (7, 4, 256), (40, 5, 256), (9, 3, 1 << 20), (1000, 2, 4)])
def test_centroids(spark, k, rounds, scale):
    rows = vectors()
    got = centroids.cluster(spark.createDataFrame(rows, SCHEMA).repartition(3), k=k, rounds=rounds, dim=6, scale=scale)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_clusters(rows, k, rounds, 6, scale, "2:")


def test_centroids_ties_go_to_the_smaller_number(spark):
    # starts 0 and 4 (in the order of their hashes); 2 lies between them
    rows = [(i, [float(x)]) for i, x in enumerate([0, 4, 2, 2, -2, 6])]
    got = {r.vec_id: (r.cluster, r.distance) for r in centroids.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=6, rounds=0, dim=1, scale=1).collect()}
    want = {r[0]: (r[1], r[2]) for r in plain_clusters([(*r, 1, "", 2) for r in rows], 6, 0, 1, 1, "2:")}
    assert got == want and got[2] == got[3]


def test_centroids_of_nothing(spark):
    none = centroids.cluster(spark.createDataFrame([(1, None, 1, "", 2), (2, [1.0], 1, "", 2)], SCHEMA))
    assert none.count() == 0
    assert none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def plain_search(rows, k, scale, every):
    kept = [(i, v) for i, v in ((r[0], ints(r[1], scale)) for r in rows) if v is not None]
    out = []
    for a, (q, x) in enumerate(kept):
        if q is None or q % every:
            continue
        found = [(-sum(s * t for s, t in zip(x, y, strict=True)), c is None, c or 0) for b, (c, y) in enumerate(kept) if b != a and len(x) == len(y)]
        out += [(q, rank + 1, None if none else c, -s) for rank, (s, none, c) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("k", "every", "scale", "block"), [(20, 20, 64, 2048), (3, 1, 64, 16), (400, 5, 64, 32), (5, 2, 1 << 22, 64), (5, 20, 4, 8)])
def test_search(spark, monkeypatch, k, every, scale, block):
    monkeypatch.setattr(topk, "BLOCK_ROWS", block)
    monkeypatch.setattr(topk, "TILE_VALUES", 1 << 9)
    monkeypatch.setattr(topk, "GROUP", 7)
    monkeypatch.setattr(topk, "FAN", 2)
    rows = vectors()
    got = topk.search(spark.createDataFrame(rows, SCHEMA).repartition(5), k=k, scale=scale, every=every)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_search(rows, k, scale, every)


def test_search_of_nothing(spark):
    none = topk.search(spark.createDataFrame([(20, None, 1, "", 2), (None, [1.0], 1, "", 2)], SCHEMA))
    assert none.count() == 0 and none.columns == ["query_id", "rank", "vec_id", "score"]
    alone = topk.search(spark.createDataFrame([(20, [1.0], 1, "", 2), (40, [1.0, 2.0], 1, "", 2)], SCHEMA))
    assert alone.count() == 0


DOCS = "doc_id long, source string, lang string, n_chars long, text string, tree string, part int, leaf string"


def plain_manifest(rows, fanout):
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    form = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda r, text: h("".join(form(x) for x in (*r[:4], text)))

    def tree(leaves):
        levels = [leaves]
        while len(levels[-1]) > 1:
            last = levels[-1]
            levels.append([h("".join(last[i : i + fanout])) for i in range(0, len(last), fanout)])
        return levels

    def mates(levels, place):
        out = []
        for nodes in levels[:-1]:
            a = place - place % fanout
            out.append((nodes[a:place], nodes[place + 1 : a + fanout]))
            place //= fanout
        return out

    held = defaultdict(list)
    for r in rows:
        now = r[4].replace("\n", "") if r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[4]
        held[r[1]].append((r[0] is not None, r[0] or 0, leaf(r, r[4]), leaf(r, now)))
    names = sorted(held, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(held[s])]) for s in names}
    top = tree([trees[s][-1][0] for s in names])
    out = []
    for at, s in enumerate(names):
        for place, (there, i, one, other) in enumerate(sorted(held[s])):
            steps, now = mates(trees[s], place) + mates(top, at), other
            for left, right in steps:
                now = h("".join(left) + now + "".join(right))
            out.append((i if there else None, one, trees[s][-1][0], top[-1][0], h("".join("".join(a + b) for a, b in steps)), now, now == top[-1][0]))
    return sorted(out, key=repr)


def documents():
    draw = random.Random(3)
    sizes = {"a": 1, "b": 3, "B": 4, "hot": 121, "é": 28, None: 13, "": 2, "z": 10, "y": 9, "x": 27, "w": 82}
    rows, i = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            rows.append((i, s, draw.choice(["en", None]), draw.choice([5, None]), draw.choice(["one\ntwo", "", None, "ü\n" * 40, "plain"])))
            i += draw.randint(1, 3)
    rows += [rows[10], rows[10], (rows[20][0], *rows[20][1:4], "other\n"), (None, "hot", "en", 1, "x\n"), (None, "hot", None, None, None), (i + 1, "hot", "en", 1, "long\n" * 50000)]
    draw.shuffle(rows)
    return [(*r, "t", 9, "l") for r in rows]


@pytest.mark.parametrize(("fanout", "levels"), [(3, 1), (3, 2), (3, 7), (2, 1), (4, 1)])
def test_merkle(spark, fanout, levels):
    from pyspark.sql import functions as F

    rows = documents()
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    cut = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    got = merkle.verify(docs, cut, fanout, levels).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_manifest(rows, fanout)
    assert {r.verified for r in got} == {True, False}


def test_merkle_small(spark):
    from pyspark.sql import functions as F

    one = spark.createDataFrame([(1, None, "en", 1, "x", "", 1, "")], DOCS)
    row = merkle.verify(one, F.col("text")).collect()[0]
    assert row.leaf == row.subroot == row.root == row.folded_root and row.verified
    assert row.proof_sha256 == hashlib.sha256(b"").hexdigest()
    assert merkle.verify(one.limit(0), F.col("text")).count() == 0


def test_stored_gives_up_its_shuffle_files(spark):
    files = lambda: [f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles())]
    before = {f for f in files() if f.startswith("shuffle_")}
    rows = stored(spark.range(1000).repartition(7, "id"))
    for _ in range(50):
        left = {f for f in files() if f.startswith("shuffle_")} - before
        if not left:
            break
        time.sleep(0.1)
    assert not left and rows.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"
