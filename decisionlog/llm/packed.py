"""Shuffles of hashed keys as packed arrays.

Tasks that make many small (key, reference) entries deal them out by key range: one row per range, with the entries as binary arrays.
Reducing tasks see the rows of a range in a fixed order, so a retried task gives the same output.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from decisionlog.llm.shared import partitions

_U = np.uint64


def ranges(df: DataFrame) -> int:
    """Key ranges; a task that reports sends at most a row to each."""
    return partitions(df.sparkSession)


def planes(x: np.ndarray) -> bytes:
    """Fixed-width numbers byte by byte, the equal leading bytes of sorted keys side by side, which shuffles compress."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes() if len(x) else b""


def unplanes(raw: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).reshape(-1).view(kind)


def dealt(keys: np.ndarray, n: int, *columns: np.ndarray) -> Iterator[tuple[int, list[bytes]]]:
    """The range of each group of keys, and their sorted keys and columns as planes."""
    order = np.argsort(keys)
    keys = keys[order]
    part = ((keys >> _U(32)) * _U(n)) >> _U(32)
    cut = np.flatnonzero(np.diff(part)) + 1
    columns = [c[order] for c in columns]
    for a, b in zip(np.r_[0, cut], np.r_[cut, len(keys)], strict=True):
        if b > a:
            yield int(part[a]), [planes(keys[a:b]), *(planes(c[a:b]) for c in columns)]


def dealt_table(keys: np.ndarray, n: int, origin: int, names: list[str], *columns: np.ndarray) -> pa.Table:
    """``dealt`` as rows (part, origin, keys, columns)."""
    out = list(dealt(keys, n, *columns))
    blobs = [pa.array([x[k] for _, x in out], pa.binary()) for k in range(1 + len(columns))]
    return pa.table([pa.array([p for p, _ in out], pa.int32()), pa.array([origin] * len(out), pa.int64()), *blobs], ["part", "origin", *names])


def by_range(df: DataFrame) -> DataFrame:
    """Rows of one range in one task, in the order of their origin."""
    return df.repartition("part").sortWithinPartitions("part", "origin")


def runs(keys: np.ndarray) -> np.ndarray:
    """For sorted keys, where each run of equal keys begins."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.flatnonzero(new)


def ends(first: np.ndarray, n: int) -> np.ndarray:
    """Where the runs that begin at ``first`` end, among ``n`` entries."""
    return np.r_[first[1:], n] if len(first) else first


def grouped(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[tuple[object, pa.Table]]:
    """Consecutive rows with equal values in a column, over the bounds of batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        values = batch.column(column).to_pylist()
        a = 0
        for b in [*(k for k in range(1, len(values)) if values[k] != values[k - 1]), len(values)]:
            if held and held[0].column(column)[0].as_py() != values[a]:
                yield held[0].column(column)[0].as_py(), pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            a = b
    if held:
        yield held[0].column(column)[0].as_py(), pa.Table.from_batches(held)
