"""Exact search of the k vectors with the highest inner product, by tiled matrix products.

All rows are packed into blocks (an integer matrix, ids and row numbers as binary): the shards of the search. Queries are packed likewise and taken
about ``TILE_VALUES`` components at a time, a tile of checked size that Spark broadcasts to the shards. Each pair of a shard's block and a query block is one matrix
product; what reaches the k-th score known so far is selected and merged into the running list of each query. A task so gives k entries per
query of the tile, however many rows it read. The lists of all shards are merged as a tree: ``FAN`` shards' lists of a group of queries become
one, level by level, until one is left.

All arithmetic is on integers: in float32 or float64 where every partial sum is small enough to be exact there, else in int64. Order: higher
score, then smaller id, then (repeated ids) the row as it was stored.

Rows whose vector is null, or holds a null, non-finite or too large component (beyond ``LIMIT`` as an integer, where a score would not fit a long) take no
part. A query meets only vectors of its own length (an empty vector scores 0 with another). Every row but the query's own is a candidate, also
a repeated row with the same id; a row without an id is no query and, as a candidate, ties last. With fewer candidates than k all are
listed; a query without any has no row. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decisionlog.llm.centroids import integers
from decisionlog.llm.shared import shared_folder, stored

LIMIT = 1 << 27
TOP, SCALE, EVERY = 20, 64, 20
BLOCK_VALUES, BLOCK_ROWS, TILE_VALUES, GROUP, FAN = 1 << 17, 2048, 1 << 21, 256, 8
BLOCK = "dim int, n int, largest long, ids binary, nulls binary, rows binary, matrix binary"
_NAMES = [c.split()[0] for c in BLOCK.split(", ")]
_NO_ID = np.iinfo(np.int64).max
_LEAST = np.iinfo(np.int64).min


def _values() -> Column:
    return F.col("n") * F.greatest("dim", F.lit(1)).cast("long")


class Rows:
    """Vectors of equal length with their ids and row numbers, in the order of the row numbers."""

    def __init__(self, dim: int, ids: np.ndarray, nulls: np.ndarray, rows: np.ndarray, matrix: np.ndarray, largest: int | None = None):
        self.dim, self.ids, self.nulls, self.rows, self.matrix = dim, ids, nulls, rows, matrix
        self.largest = int(np.abs(matrix).max(initial=0)) if largest is None else largest

    @classmethod
    def unpacked(cls, row: dict) -> Rows:
        matrix = np.frombuffer(row["matrix"], np.int32).reshape(row["n"], row["dim"])
        ids, nulls, rows = (np.frombuffer(row[c], t) for c, t in (("ids", np.int64), ("nulls", np.bool_), ("rows", np.int64)))
        return cls(row["dim"], ids, nulls, rows, matrix, row["largest"])

    def packed(self) -> dict:
        blobs = (self.ids, self.nulls, self.rows, self.matrix.astype(np.int32))
        return dict(zip(_NAMES, (self.dim, len(self.ids), self.largest, *(x.tobytes() for x in blobs)), strict=True))

    def some(self, use: np.ndarray) -> Rows:
        return Rows(self.dim, self.ids[use], self.nulls[use], self.rows[use], self.matrix[use])

    @staticmethod
    def joined(parts: list[Rows]) -> Rows:
        ids, nulls, rows, matrix = (np.concatenate([getattr(p, c) for p in parts]) for c in ("ids", "nulls", "rows", "matrix"))
        order = np.argsort(rows)
        return Rows(parts[0].dim, ids[order], nulls[order], rows[order], matrix[order])

    def scores(self, other: Rows) -> np.ndarray:
        """The exact inner products with all rows of ``other``."""
        bound = max(1, self.dim) * max(1, self.largest) * max(1, other.largest)
        kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64
        return self.matrix.astype(kind) @ other.matrix.astype(kind).T


def _in_blocks(parts: Iterator[Rows]) -> Iterator[dict]:
    """The rows as packed blocks of at most BLOCK_ROWS rows and about BLOCK_VALUES values."""
    held: dict[int, list[Rows]] = {}
    for part in parts:
        most = max(1, min(BLOCK_ROWS, BLOCK_VALUES // max(part.dim, 1)))
        for at in range(0, len(part.ids), most):
            kept = held.setdefault(part.dim, [])
            piece = part.some(np.arange(at, min(at + most, len(part.ids))))
            if sum(len(p.ids) for p in kept) + len(piece.ids) > most:
                yield Rows.joined(kept).packed()
                kept.clear()
            kept.append(piece)
    for kept in held.values():
        yield Rows.joined(kept).packed()


def _batches(rows: Iterator[dict], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    for row in rows:
        yield pa.RecordBatch.from_arrays([pa.array([row[n]], t) for n, t in zip(names, types, strict=True)], names)


_BLOCK_TYPES = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4]


def packed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, row, v) as blocks, one vector length each."""

    def parts() -> Iterator[Rows]:
        for batch in batches:
            size = np.asarray(pc.list_value_length(batch.column("v")))
            flat, offset = np.asarray(batch.column("v").flatten()), np.r_[0, np.cumsum(size)]
            ids, rows = batch.column("id"), np.asarray(batch.column("row"))
            nulls, ids = np.asarray(ids.is_null()), np.asarray(ids.fill_null(_NO_ID))
            for dim in np.unique(size).tolist():
                use = np.flatnonzero(size == dim)
                yield Rows(dim, ids[use], nulls[use], rows[use], flat[offset[use][:, None] + np.arange(dim)])

    yield from _batches(_in_blocks(parts()), _NAMES, _BLOCK_TYPES)


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Rows]:
    for batch in batches:
        for i in range(len(batch)):
            yield Rows.unpacked(batch.slice(i, 1).to_pylist()[0])


def taken_queries(every: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (r.some(np.flatnonzero(~r.nulls & (r.ids % every == 0))) for r in _rows_of(batches))
        yield from _batches((p.packed() for p in parts if len(p.ids)), _NAMES, _BLOCK_TYPES)

    return take


def packed_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _batches(_in_blocks(_rows_of(batches)), _NAMES, _BLOCK_TYPES)


#: an entry of a list; one without a row number is empty
_ENTRY = np.dtype([("score", np.int64), ("id", np.int64), ("null", np.bool_), ("row", np.int64)])


def _empty(queries: int, k: int) -> np.ndarray:
    out = np.zeros((queries, k), _ENTRY)
    out["score"], out["row"] = _LEAST, -1
    return out


def _listed(line: np.ndarray, entries: np.ndarray, queries: int, k: int) -> np.ndarray:
    """The first k entries of each line: higher score, smaller id, no id last, smaller row."""
    order = np.lexsort((entries["row"], entries["id"], entries["null"], -entries["score"], line))
    line, entries = line[order], entries[order]
    place = np.arange(len(line)) - np.searchsorted(line, line)
    out = _empty(queries, k)
    use = place < k
    out[line[use], place[use]] = entries[use]
    return out


def best(lists: list[np.ndarray]) -> np.ndarray:
    """Lists of the same queries as one."""
    whole = np.concatenate(lists, axis=1)
    line, column = np.nonzero(whole["row"] >= 0)
    return _listed(line, whole[line, column], len(whole), lists[0].shape[1])


def improved(known: np.ndarray, queries: Rows, block: Rows) -> np.ndarray:
    """``known`` lists of the queries with the rows of one more block."""
    n, k = known.shape
    scores = queries.scores(block)
    low = -np.inf if scores.dtype != np.int64 else _LEAST
    own = np.minimum(np.searchsorted(block.rows, queries.rows), len(block.rows) - 1)
    mine = np.flatnonzero(block.rows[own] == queries.rows)
    scores[mine, own[mine]] = low
    least = np.where(known["row"][:, -1] >= 0, known["score"][:, -1], low).astype(scores.dtype)
    fresh = np.flatnonzero(known["row"][:, -1] < 0)
    if len(fresh) and scores.shape[1] > k:
        least[fresh] = np.partition(scores[fresh], -k, axis=1)[:, -k]
    line, column = np.nonzero((scores >= least[:, None]) & (scores > low))
    new = np.empty(len(line), _ENTRY)
    new["score"], new["id"], new["null"], new["row"] = scores[line, column].astype(np.int64), block.ids[column], block.nulls[column], block.rows[column]
    old, place = np.nonzero(known["row"] >= 0)
    return _listed(np.r_[old, line], np.concatenate([known[old, place], new]), n, k)


LISTS = "block long, part int, shard int, ids binary, lists binary"
_LIST_NAMES, _LIST_TYPES = ["block", "part", "shard", "ids", "lists"], [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]


def searched(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs of a shard's block and a query block; at the end the shard's lists, ``GROUP`` queries a row."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile: dict[int, tuple[Rows, np.ndarray]] = {}
        shard, last, block = 0, None, None
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1).to_pylist()[0]
                queries, known = tile.get(row["q_block"]) or (Rows.unpacked({n: row[f"q_{n}"] if n != "dim" else row["dim"] for n in _NAMES}), None)
                if row["place"] != last:
                    last, block = row["place"], Rows.unpacked(row)
                known = _empty(len(queries.ids), k) if known is None else known
                tile[row["q_block"]], shard = (queries, improved(known, queries, block)), row["shard"]
        for number, (queries, lists) in tile.items():
            for a in range(0, len(lists), GROUP):
                blobs = queries.ids[a : a + GROUP].tobytes(), lists[a : a + GROUP].tobytes()
                yield from _batches(iter([dict(zip(_LIST_NAMES, (number, a // GROUP, shard, *blobs), strict=True))]), _LIST_NAMES, _LIST_TYPES)

    return search


def merged(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Consecutive rows of one (block, part, shard) as one."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, lists = None, None, []

        def made() -> Iterator[pa.RecordBatch]:
            if first is not None:
                yield from _batches(iter([first | {"lists": best(lists).tobytes()}]), _LIST_NAMES, _LIST_TYPES)

        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1).to_pylist()[0]
                if (row["block"], row["part"], row["shard"]) != key:
                    yield from made()
                    key, first, lists = (row["block"], row["part"], row["shard"]), row, []
                lists.append(np.frombuffer(row["lists"], _ENTRY).reshape(-1, k))
        yield from made()

    return merge


def unpacked_lists(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, blob in zip(batch.column("ids"), batch.column("lists"), strict=True):
                ids, lists = np.frombuffer(ids.as_py(), np.int64), np.frombuffer(blob.as_py(), _ENTRY).reshape(-1, k)
                line, place = np.nonzero(lists["row"] >= 0)
                found = lists[line, place]
                columns = [pa.array(ids[line]), pa.array((place + 1).astype(np.int32)), pa.array(found["id"], mask=found["null"]), pa.array(found["score"])]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", "rank", "vec_id", "score"])

    return unpack


def search(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = TOP, scale: int = SCALE, every: int = EVERY) -> DataFrame:
    """For each row whose id ``every`` divides: ``query_id``, ``rank`` from 1, ``vec_id`` and ``score`` of its best k."""
    session = vectors.sparkSession
    ints = vectors.select(F.col(id_col).cast("bigint").alias("id"), integers(vector_col, scale, LIMIT).alias("v")).filter("v is not null")
    shards = stored(ints.withColumn("row", F.monotonically_increasing_id()).mapInArrow(packed_rows, BLOCK).withColumn("place", F.monotonically_increasing_id()))
    few = shards.drop("place").mapInArrow(taken_queries(every), BLOCK)
    values = few.agg(F.sum(_values()).alias("v")).first()["v"] or 0
    dealt = few.repartition(max(1, -(-values // TILE_VALUES))).mapInArrow(packed_again, BLOCK)
    names = [F.col(c).alias(f"q_{c}") for c in _NAMES if c != "dim"]
    queries = stored(dealt.select("dim", *names, _values().alias("values"), F.spark_partition_id().alias("tile"), F.monotonically_increasing_id().alias("q_block")))
    out, path = "query_id long, rank int, vec_id long, score long", shared_folder(session)
    tiles = sorted((r["tile"], r["v"]) for r in queries.groupBy("tile").agg(F.sum("values").alias("v")).collect())  # one row per tile
    if not tiles:
        return session.createDataFrame([], out)
    for tile, size in tiles:
        these = queries.filter(F.col("tile") == tile).drop("tile", "values")
        these = F.broadcast(these) if size <= 2 * TILE_VALUES else these
        lists = stored(shards.withColumn("shard", F.spark_partition_id()).join(these, "dim").mapInArrow(searched(k), LISTS))
        left = (lists.agg(F.max("shard")).first()[0] or 0) + 1
        while left > 1:
            lists = lists.withColumn("shard", F.floor(F.col("shard") / FAN).cast("int"))
            lists = lists.repartition("block", "part", "shard").sortWithinPartitions("block", "part", "shard").mapInArrow(merged(k), LISTS)
            left = -(-left // FAN)
        lists.mapInArrow(unpacked_lists(k), out).write.parquet(f"{path}/tile={tile}")
    return session.read.schema(out).parquet(*[f"{path}/tile={tile}" for tile, _ in tiles])
