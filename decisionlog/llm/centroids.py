"""Exact integer clustering of vectors around centroids, by a tournament over bisecting planes.

For two centroids i < j the points that are as near to i as to j form a plane with the integer normal ``2 (c_j - c_i)`` and the integer
threshold ``|c_j|^2 - |c_i|^2``: a vector x is nearer to j where ``normal . x > threshold``, and zero difference favours i. Each task
computes the planes of all pairs once a round. A vector then runs a knock-out: neighbouring ranges of centroid numbers send one survivor each against each other,
so k - 1 sign tests leave one, always the smaller number where distances are equal. The first level of the knock-out meets the same pairs for
every vector and is one matrix product; later levels pick each vector's plane. Only the survivor's distance is computed, exactly.

Rows that take part have exactly ``dim`` components, none of them null or non-finite, none beyond ``LIMIT`` as an integer (there a squared distance would
not fit a long); other rows are not in the result. Each row counts, also repeated ones and rows with a null id; a null id comes last among the starts.
Ties among the hashes of the starts are settled by the components. With fewer than k rows each is a start; without rows the result is empty. A
cluster's or the total inertia beyond a long is null. Other columns of the input are not read.

What reaches the driver: k rows at the start, and k * dim sums per round. Vectors stay where they are: a round is a scan and one partial sum per
cluster and task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decisionlog.llm.shared import stored

LIMIT = 1 << 27
DIM, K, ROUNDS, SCALE, SALT = 64, 40, 5, 256, "2:"
_EXACT = 1 << 53  # a float64 holds every integer up to here


def integers(vector: str | Column, scale: int, limit: int = LIMIT) -> Column:
    """``floor(scale * x)`` of each component; null where a component is null, not finite or beyond ``limit``."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    scaled = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * F.when(F.abs(x) <= limit / scale, x.cast("double"))).cast("int"))
    return F.when(F.forall(scaled, lambda x: x.isNotNull() & (F.abs(x) <= limit)), scaled)


class Planes:
    """The bisecting planes of all centroid pairs, ready for vectors up to a size."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        k, dim = centroids.shape
        self.normals = 2 * (centroids[None, :, :] - centroids[:, None, :])
        norms = (centroids * centroids).sum(axis=1)
        self.thresholds = norms[None, :] - norms[:, None]
        self.first = np.arange(0, k - 1, 2)
        self.largest = int(np.abs(centroids).max(initial=0))
        self.floats = self.normals.astype(np.float64), self.thresholds.astype(np.float64)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's centroid number and squared distance."""
        k, dim = self.centroids.shape
        largest = max(self.largest, int(np.abs(x).max(initial=0)))
        small = 4 * largest * largest * dim < _EXACT
        normals, thresholds = self.floats if small else (self.normals, self.thresholds)
        y = x.astype(normals.dtype)
        left = self.first
        beyond = y @ normals[left, left + 1].T > thresholds[left, left + 1]
        alive = [left[i] + beyond[:, i] for i in range(len(left))]
        if k % 2:
            alive.append(np.full(len(x), k - 1))
        while len(alive) > 1:
            met = [self._duel(y, normals, thresholds, a, b) for a, b in zip(alive[::2], alive[1::2], strict=False)]
            alive = met + alive[2 * len(met) :]
        gap = x - self.centroids[alive[0]]
        return alive[0].astype(np.int32), np.einsum("ij,ij->i", gap, gap)

    @staticmethod
    def _duel(y: np.ndarray, normals: np.ndarray, thresholds: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        beyond = np.einsum("ij,ij->i", y, normals[a, b]) > thresholds[a, b]
        return np.where(beyond, b, a)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.int64).reshape(-1, dim)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 4096) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def partial_sums(centroids: np.ndarray):
    """Per task and cluster: how many vectors, and their sums."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes, (k, dim) = Planes(centroids), centroids.shape
        count, total = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for batch in _slices(batches):
            x = _matrix(batch.column("v"), dim)
            cluster, _ = planes.nearest(x)
            order = np.argsort(cluster, kind="stable")
            found, first, n = np.unique(cluster[order], return_index=True, return_counts=True)
            total[found] += np.add.reduceat(x[order], first, axis=0)
            count[found] += n
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), pa.array(count[some]), pa.array(list(total[some]), pa.list_(pa.int64()))], ["cluster", "n", "total"]
        )

    return sums


def assigned(centroids: np.ndarray):
    """Per vector: its cluster and squared distance."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = Planes(centroids)
        for batch in _slices(batches):
            cluster, distance = planes.nearest(_matrix(batch.column("v"), centroids.shape[1]))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return assign


def _moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: exact floors of the means; empty clusters stay."""
    parts = vectors.select("v").mapInArrow(partial_sums(centroids), "cluster int, n long, total array<long>")
    each = parts.select("cluster", "n", F.posexplode("total").alias("d", "x"))
    out = centroids.copy()
    for r in each.groupBy("cluster", "d").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect():  # at most k * dim rows
        out[r["cluster"], r["d"]] = int(r["x"]) // r["n"]
    return out


def cluster(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, salt: str = SALT
) -> DataFrame:
    """Per vector: ``vec_id``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia`` and the digest of its final centroid."""
    session = vectors.sparkSession
    out = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    fitting = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).alias("v")).filter(F.size("v") == dim)
    kept = stored(fitting.select("vec_id", integers("v", scale).alias("v")).filter("v is not null"))
    draw = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    starts = kept.select("v", draw.alias("draw")).orderBy(F.col("draw").asc_nulls_last(), "v").limit(k).collect()
    if not starts:
        return session.createDataFrame([], out)
    centroids = np.array([r["v"] for r in starts], np.int64)
    for _ in range(rounds):
        centroids = _moved(kept, centroids)
    found = stored(kept.mapInArrow(assigned(centroids), "vec_id long, cluster int, distance long"))
    digests = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    inertia = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    fits = lambda n: n if n < 1 << 63 else None
    ends = [(i, fits(inertia.get(i, 0)), fits(sum(inertia.values())), digest) for i, digest in digests]
    known = session.createDataFrame(ends, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows
