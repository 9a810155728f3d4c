"""Words, hashes and windows of Arrow text columns, computed on the column's bytes with numpy.

A batch is taken in pieces of bounded bytes, so the arrays of one step stay small; only a single text longer than the bound makes a
piece of its own. Hashes are functions of the bytes alone, thus equal on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 4 << 20
_U = np.uint64
_SPACES = bytes([0x20, 9, 10, 11, 12, 13])
NOT_SPACE = np.array([b not in _SPACES for b in range(256)])
#: ASCII digits and letters and all bytes of other characters
ALPHANUMERIC = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def weights(n: int, salt: int = 0) -> np.ndarray:
    """``n`` odd pseudo-random multipliers."""
    return mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(salt * 7919 + 1)) | _U(1)


_table = {0: weights(256), 1: weights(256, 1)}


def _weights(n: int, salt: int) -> np.ndarray:
    if len(_table[salt]) < n:
        _table[salt] = weights(2 * n, salt)
    return _table[salt]


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of a text or binary column, with each row's first and end offset; a null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    column = column.cast(kind) if column.type != kind else column
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, offsets, data = column.buffers()
    width = np.int64 if kind == pa.large_binary() else np.int32
    at = np.frombuffer(offsets, width)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first, end = at[:-1], at[1:]
    if column.null_count:
        end = np.where(np.asarray(column.is_valid()), end, first)
    return data, first, end


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Row ranges of at most ``limit`` bytes (or one row): from, to, the bytes, each row's first and end offset in them."""
    data, first, end = column_bytes(column)
    size = np.cumsum(end - first)
    i = 0
    while i < len(first):
        j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + limit, "right")))
        yield i, j, data[first[i] : end[j - 1]] if end[j - 1] > first[i] else data[:0], first[i:j] - first[i], end[i:j] - first[i]
        i = j


def sliced(batch: pa.RecordBatch, column: int, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in slices of whole rows that hold at most ``limit`` bytes of text (or one row)."""
    for i, j, *_ in pieces(batch.column(column), limit):
        yield batch.slice(i, j - i)


class Words:
    """The words of some texts that lie one after another in ``data``."""

    def __init__(self, data: np.ndarray, first: np.ndarray, end: np.ndarray, kind: np.ndarray = NOT_SPACE):
        end = np.maximum(first, end)
        inside = kind[data]
        before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        full = end > first
        before[first[full]] = False
        after[end[full] - 1] = False
        self.data, self.inside, self.first, self.stop = data, inside, first, end
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        #: words [low, high) belong to a row
        self.low, self.high = np.searchsorted(self.start, first), np.searchsorted(self.start, end)
        self.high = np.maximum(self.low, self.high)

    def hashes(self, salt: int = 0) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        n = self.end - self.start
        if not len(n):
            return np.zeros(0, _U)
        at = np.cumsum(n) - n
        place = np.arange(int(n.sum())) - np.repeat(at, n)
        value = (self.data[self.inside].astype(_U) + _U(1)) * _weights(int(n.max()), salt)[place]
        return mix(np.add.reduceat(value, at) + n.astype(_U))

    def joined(self, i: int, j: int) -> bytes:
        """Words i to j, one space between them."""
        raw = self.data[self.start[i] : self.end[j - 1]].tobytes()
        return b" ".join(raw[a:b] for a, b in zip(self.start[i:j] - self.start[i], self.end[i:j] - self.start[i], strict=True))


def rolled(hashes: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """The hash of every ``width`` consecutive entries; rows are not respected, so take those starts that fit into one row."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = np.zeros(n, _U)
    for j, w in enumerate(weights(width, salt + 2)):
        out += hashes[j : j + n] * w
    return mix(out + _U(width))


def starts_that_fit(low: np.ndarray, high: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """All window starts of the rows, and the row of each."""
    n = np.maximum(0, high - low - width + 1)
    row = np.repeat(np.arange(len(n)), n)
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n), row


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of ``n`` places lie in [s, s + width) of some start."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(np.asarray(starts) + width, n), -1)
    return np.cumsum(edge[:n]) > 0


def without(words: Words, row: int, gone: np.ndarray, data: np.ndarray | None = None) -> tuple[str, bool]:
    """A row's text without its words that are gone, and whether a word is left. ``data``: the bytes to cut, if other than those scanned."""
    data = words.data if data is None else data
    low, high = int(words.low[row]), int(words.high[row])
    mask = np.r_[False, gone[low:high], False]
    begin, end = np.flatnonzero(mask[1:] & ~mask[:-1]), np.flatnonzero(mask[:-1] & ~mask[1:])
    raw, done = [], int(words.first[row])
    for a, b in zip(begin, end, strict=True):
        raw.append(data[done : words.start[low + a]].tobytes())
        done = int(words.end[low + b - 1])
    raw.append(data[done : int(words.stop[row])].tobytes())
    return b"".join(raw).decode(), bool((~gone[low:high]).any())
