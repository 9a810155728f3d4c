"""Token ids packed into fixed-length sequences, with everything a trainer's attention needs.

Texts become ids of a byte-level BPE vocabulary. Documents are dealt into buckets by id; each bucket cuts documents longer than a sequence
into full pieces and a rest, sorts the pieces by length and puts each into the open sequence with the least room that still takes it
(best fit decreasing). The search runs on a segment tree over room values. A bucket is a matrix: rows of ids, padded, with the
cumulative segment lengths and positions that restart at every segment.

Nothing is lost: the pieces of a document, in the order of their offsets, are its ids. Null and empty texts have no ids and take no room;
repeated rows are packed each for itself; the id of a document may be null.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decisionlog.llm.substrings import BUCKET, bucketed

LENGTH = 2048
CACHE_BYTES, LONG_CHUNK = 40 << 20, 64
DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: fixed value: the word pattern that belongs to this vocabulary
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: white space as the vocabulary's pattern has it
_BLANK = "\t-\r \x85\xa0  -     　"
_CHUNK = re.compile(f" ?[^{_BLANK}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+")
PACKED = "matrix int, row int, ids binary, positions binary, cu_seqlens array<int>, doc_ids array<long>, offsets array<long>, n_tokens int"


def load_ranks(path: str = DEFAULT_RANKS) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Tokenizer:
    """Ids of texts. Chunks of one word are encoded once and, unless very long, kept in a cache of bounded bytes; no match of the pattern reaches over a chunk."""

    def __init__(self, ranks: dict[bytes, int]):
        from tiktoken import Encoding

        self.encoding = Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.cache: dict[str, bytes] = {}
        self.bytes = 0

    def _chunk(self, chunk: str) -> bytes:
        got = np.array(self.encoding.encode_ordinary(chunk), np.int32).tobytes()
        if len(chunk) <= LONG_CHUNK:
            if self.bytes > CACHE_BYTES:
                self.cache.clear()
                self.bytes = 0
            self.cache[chunk] = got
            self.bytes += 200 + 2 * len(chunk) + len(got)
        return got

    def ids(self, text: str | None) -> np.ndarray:
        get, make = self.cache.get, self._chunk
        return np.frombuffer(b"".join([get(c) or make(c) for c in _CHUNK.findall(text or "")]), np.int32)


_made: list[tuple[dict[bytes, int], Tokenizer]] = []


def tokenizer_of(ranks: dict[bytes, int]) -> Tokenizer:
    """A worker's tokenizer of a vocabulary, kept from bucket to bucket and from task to task with the chunks that it knows."""
    if not _made or _made[0][0] is not ranks:
        _made[:] = [(ranks, Tokenizer(ranks))]
    return _made[0][1]


class Rooms:
    """A segment tree over room values 0..length: how many open sequences have that room."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(length + 1)]

    def put(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """The sequence with the least room of at least ``need``, and its room."""
        node = need + self.size
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.size
        self._add(room, -1)
        return self.open[room].pop(), room

    def _add(self, room: int, n: int) -> None:
        node = room + self.size
        while node:
            self.count[node] += n
            node >>= 1


def best_fit(lengths: np.ndarray, length: int) -> list[list[int]]:
    """Sequences as lists of piece numbers; ``lengths`` are at most ``length``."""
    rooms, out = Rooms(length), []
    for k in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[k])
        got = rooms.take(size)
        if got is None:
            out.append([])
            got = len(out) - 1, length
        out[got[0]].append(k)
        rooms.put(got[1] - size, got[0])
    return out


def cut(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of at most ``length`` ids: document number, offset, size."""
    n = -(-sizes // length)
    doc = np.repeat(np.arange(len(sizes)), n)
    offset = (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)) * length
    return doc, offset, np.minimum(length, sizes[doc] - offset)


def _packer(held, length: int, pad: int) -> Callable[[tuple, pa.Table], pa.Table]:
    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        tokenizer = tokenizer_of(held.value)
        rows = rows.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        docs, ids = rows.column("doc_id").to_pylist(), []
        for chunk in rows.column("text").chunks:
            ids += [tokenizer.ids(t.as_py()) for t in chunk]
        doc, offset, size = cut(np.array([len(x) for x in ids], np.int64), length)
        width = np.uint16 if max(tokenizer.encoding.n_vocab, pad) < 1 << 16 else np.int32
        out = []
        for row, pieces in enumerate(best_fit(size, length)):
            line, places, ends = np.full(length, pad, width), np.zeros(length, np.uint16 if length <= 1 << 16 else np.int32), [0]
            for p in pieces:
                a, b = ends[-1], ends[-1] + int(size[p])
                line[a:b] = ids[doc[p]][offset[p] : offset[p] + size[p]]
                places[a:b] = np.arange(b - a)
                ends.append(b)
            out.append((key[0].as_py(), row, line.tobytes(), places.tobytes(), ends, [docs[doc[p]] for p in pieces], [int(offset[p]) for p in pieces], ends[-1]))
        columns = [list(c) for c in zip(*out, strict=True)] or [[]] * len(_TYPES)
        return pa.table([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], [x.split()[0] for x in PACKED.split(", ")])

    return pack


_TYPES = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32()]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, ranks: str = DEFAULT_RANKS, pad: int = 50_256) -> DataFrame:
    """One row per packed sequence: ids and positions (little-endian, two bytes where they fit), segment ends, documents and offsets."""
    held = docs.sparkSession.sparkContext.broadcast(load_ranks(ranks))
    rows = bucketed(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text")
    return rows.groupBy(BUCKET).applyInArrow(_packer(held, length, pad), PACKED)


def write_matrices(packed: DataFrame, path: str, rows: int = 256) -> None:
    """Matrices of up to ``rows`` sequences as Parquet rows: ids and positions one line after another, segment ends per line."""
    block = F.floor(F.col("row") / rows).cast("int").alias("block")
    line = F.struct("row", "ids", "positions", "cu_seqlens", "doc_ids", "offsets")
    lines = packed.groupBy("matrix", block).agg(F.sort_array(F.collect_list(line)).alias("lines"))  # at most ``rows`` entries
    joined = lambda name: F.aggregate(F.col("lines"), F.lit(b""), lambda all_, x: F.concat(all_, x[name]))
    lines.select(
        "matrix", "block", F.size("lines").alias("n_rows"), joined("ids").alias("ids"), joined("positions").alias("positions"),
        *(F.col("lines")[c].alias(c) for c in ("cu_seqlens", "doc_ids", "offsets")),
    ).write.parquet(path)
