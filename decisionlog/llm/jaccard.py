"""Near-duplicate groups by an exact Jaccard self-join over word shingles, with adaptive multi-match prefixes.

A document's set is its distinct shingles (64-bit hashes of ``width`` words). All sets are put in one order, frequent shingles last; the
frequencies come from a count sketch of fixed size over all rows. With k required matches, a prefix of ``n - ceil(t n) + k`` shingles is
enough: two sets that link share at least k shingles of these prefixes. Each document picks its own k, the one with the least estimated
cost of reading postings and verifying candidates; a pair must share min(k, k') prefix shingles before it is verified exactly.

Documents with equal sets are one node (they link, and to the same others). Prefix shingles are dealt out by hash; each shared shingle
names a hub, and whoever shares it joins the hub's group. A large group is split into blocks and tiles of two blocks, so a task never
holds more than two blocks, and a tile returns a spanning forest of its links, not all pairs.

Null and empty texts have an empty set and link with nothing. Fewer words than ``width`` make one shingle of all words. Rows that share
a doc_id are one document and stay or go together; a null doc_id belongs to no group and stays.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decisionlog.llm.components import components
from decisionlog.llm.packed import by_range, dealt_table, ranges, runs, unplanes
from decisionlog.llm.shared import stored
from decisionlog.llm.textscan import LOWER, Words, mix, pieces, rolled

WIDTH, PERCENT = 4, 85
CELLS, SLICES = 1 << 20, 64
MOST_MATCHES = 4
VERIFY_COST, TOKEN_COST = 4.0, 2.0
BLOCK = 256
FLUSH, HEAVY = 4_000_000, 1000
_U = np.uint64
_MASK = _U(CELLS - 1)


def _sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    for _, _, data, first, end in pieces(column):
        words = Words(LOWER[data], first, end)
        hashes = words.hashes()
        roll = rolled(hashes, width)
        for low, high in zip(words.low, words.high, strict=True):
            if high - low >= width:
                yield np.unique(roll[low : high - width + 1])
            else:
                yield rolled(hashes[low:high], int(high - low)) if high > low else roll[:0]


def _set_key(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for the whole set."""
    return int(mix(tokens).sum().astype(np.int64)), int(mix(tokens * _U(0xD6E8FEB86659FD93) + _U(len(tokens))).sum().astype(np.int64))


def _need(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def _prefix(tokens: np.ndarray, counts: np.ndarray, usual: float, percent: int) -> tuple[np.ndarray, int]:
    """The document's prefix in the common order, and the number of matches it asks for."""
    n = len(tokens)
    seen = counts[tokens & _MASK]
    need = _need(n, percent)
    longest = n - need + min(MOST_MATCHES, need)
    if longest < n:  # only the front has to be in order
        near = np.partition(seen, longest - 1)[longest - 1]
        front = seen <= near
        tokens, seen = tokens[front], seen[front]
    order = np.lexsort((tokens, seen))[:longest]
    cost = np.cumsum(np.maximum(0.0, seen[order] - usual))
    best, matches = None, 1
    for k in range(1, min(MOST_MATCHES, need) + 1):
        length = n - need + k
        price = TOKEN_COST * length + cost[length - 1] * (1 + VERIFY_COST / k)
        if best is None or price < best:
            best, matches = price, k
    return tokens[order[: n - need + matches]], matches


_SCAN = "doc_id long, n_shingles long, key1 long, key2 long, slice int, counts binary"
_SCAN_TYPES = [pa.int64()] * 4 + [pa.int32(), pa.binary()]
_SCAN_NAMES = [x.split()[0] for x in _SCAN.split(", ")]


def _scan(docs: DataFrame, width: int) -> DataFrame:
    """A row per document with its set's size and key, and per task the slices of its shingle counts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, np.uint32)
        for batch in batches:
            found, cells = [], []
            for tokens in _sets(batch.column(1), width):
                found.append((len(tokens), *_set_key(tokens)))
                cells.append(tokens & _MASK)
            if cells:
                np.add(counts, np.bincount(np.concatenate(cells).astype(np.int64), minlength=CELLS), out=counts, casting="unsafe")
                n, one, two = (pa.array(c, pa.int64()) for c in zip(*found, strict=True))
                rest = [pa.nulls(len(batch), t) for t in _SCAN_TYPES[4:]]
                yield pa.RecordBatch.from_arrays([batch.column(0), n, one, two, *rest], _SCAN_NAMES)
        if counts.any():
            blobs = [zlib.compress(part.tobytes(), 1) for part in np.split(counts, SLICES)]
            none = [pa.nulls(SLICES, pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([*none, pa.array(range(SLICES), pa.int32()), pa.array(blobs, pa.binary())], _SCAN_NAMES)

    return docs.mapInArrow(scan, _SCAN)


def _sketch(scanned: DataFrame) -> tuple[np.ndarray, float]:
    """Counts of all rows per cell (CELLS x 4 bytes, whatever the input), and the median."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts = np.frombuffer(zlib.decompress(blob), np.uint32).astype(_U)
                total[part] = total[part] + counts if part in total else counts
        if total:
            blobs = [np.minimum(c, 0xFFFFFFFF).astype(np.uint32).tobytes() for c in total.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(blobs, pa.binary())], ["slice", "counts"])

    rows = scanned.filter("slice is not null").select("slice", "counts").repartition("slice").mapInArrow(add, "slice int, counts binary").collect()
    counts = np.zeros(CELLS, np.uint32)
    for row in rows:
        counts[row.slice * (CELLS // SLICES) : (row.slice + 1) * (CELLS // SLICES)] = np.frombuffer(row.counts, np.uint32)
    return counts, float(np.median(counts))


_POST = "part int, origin long, tokens binary, refs binary, sizes binary"


def _postings(docs: DataFrame, held: Broadcast, width: int, percent: int) -> DataFrame:
    """Prefix shingles with the key of their set, packed by range; copies inside a batch count once."""
    n_ranges = ranges(docs)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, usual = held.value
        for batch in batches:
            tokens, refs, sizes, seen = [], [], [], set()
            for row in _sets(batch.column(1), width):
                key = _set_key(row)
                if len(row) and key not in seen:
                    seen.add(key)
                    prefix, _ = _prefix(row, counts, usual, percent)
                    tokens.append(prefix)
                    refs.append(np.full(len(prefix), key[0], np.int64))
                    sizes.append(np.full(len(prefix), len(row), np.uint32))
            if tokens:
                origin = int(np.bitwise_xor.reduce([r[0] for r in refs]))
                yield from dealt_table(np.concatenate(tokens), n_ranges, origin, ["tokens", "refs", "sizes"], np.concatenate(refs), np.concatenate(sizes)).to_batches()

    return docs.mapInArrow(post, _POST)


def _hubs(percent: int):
    """(hub, member) of every shingle that two sets share whose sizes may link.

    A shingle's sets are sorted by size and cut where the next is too large to link with the last. Memory: the entries of a range; beyond
    FLUSH of them, shingles with very many sets are sent off around one hub, whatever the sizes (size 0 stands for such a hub).
    """

    def edges(hub: np.ndarray, member: np.ndarray) -> pa.RecordBatch:
        pairs = np.unique(np.stack([hub, member], 1)[hub != member], axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["hub", "member"])

    def ordered(held: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t, r, n = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.argsort(t, kind="stable")
        first = runs(t[order])
        shared = order[np.repeat(np.diff(np.r_[first, len(t)]) > 1, np.diff(np.r_[first, len(t)]))]
        shared = shared[np.lexsort((r[shared], n[shared], t[shared]))]
        return t[shared], r[shared], n[shared]

    def chains(held: list[tuple]) -> pa.RecordBatch:
        t, r, n = ordered(held)
        new = np.ones(len(t), bool)
        far = (100 * n[:-1].astype(np.int64) < percent * n[1:].astype(np.int64)) & ~np.repeat(*_per_run(t, n == 0))[1:]
        new[1:] = (t[1:] != t[:-1]) | far
        first = np.flatnonzero(new)
        return edges(np.repeat(r[first], np.diff(np.r_[first, len(t)])), r)

    def lighter(held: list[tuple]) -> tuple[tuple, pa.RecordBatch]:
        t, r, n = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((r, n, t))
        t, r, n = t[order], r[order], n[order]
        first = runs(t)
        size = np.diff(np.r_[first, len(t)])
        heavy = np.repeat(size > HEAVY, size)
        hub = np.repeat(r[first], size)
        head = np.zeros(len(t), bool)
        head[first] = True
        keep = ~heavy | head
        return (t[keep], r[keep], np.where(heavy, 0, n)[keep].astype(np.uint32)), edges(hub[heavy], r[heavy])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, size = None, [], 0
        for batch in batches:
            for p, *blobs in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True):
                if p != part and held:
                    yield chains(held)
                    held, size = [], 0
                elif size > FLUSH:
                    kept, out = lighter(held)
                    yield out
                    held, size = [kept], 0
                part = p
                held.append(tuple(unplanes(x, kind) for x, kind in zip(blobs, (_U, np.int64, np.uint32), strict=True)))
                size += len(held[-1][0])
        if held:
            yield chains(held)

    return run


def _per_run(keys: np.ndarray, flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a run of equal keys begins with a flag, and the lengths of the runs."""
    first = runs(keys)
    return flag[first], np.diff(np.r_[first, len(keys)])


def _forest(docs: list, cross: bool, percent: int) -> list[tuple[int, int]]:
    """Links of a tile that join what isn't joined yet. docs: (id, block, set, prefix, matches)."""
    n = np.array([len(d[2]) for d in docs])
    block = np.array([d[1] for d in docs])

    def shared(sets: list[np.ndarray]) -> np.ndarray:
        """The number of common entries of every two sets."""
        values, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        values, inverse, count = np.unique(values, return_inverse=True, return_counts=True)
        twice = np.cumsum(count > 1) - 1
        here = (count > 1)[inverse]
        column, of = twice[inverse[here]], of[here]
        out = np.zeros((len(sets), len(sets)), np.float32)
        order = np.argsort(column, kind="stable")
        column, of = column[order], of[order]
        for a in range(0, int(column[-1]) + 1 if len(column) else 0, 8192):
            x, y = np.searchsorted(column, [a, a + 8192])
            there = np.zeros((len(sets), 8192), np.float32)
            there[of[x:y], column[x:y] - a] = 1
            out += there @ there.T
        return out

    ask = np.array([d[4] for d in docs])
    maybe = shared([d[3] for d in docs]) >= np.minimum.outer(ask, ask)
    maybe &= 100 * np.minimum.outer(n, n) >= percent * np.maximum.outer(n, n)
    if cross:
        maybe &= block[:, None] != block[None, :]
    a, b = np.nonzero(np.triu(maybe, 1))
    if not len(a):
        return []
    if len(a) > 2 * len(docs):
        common = shared([d[2] for d in docs])[a, b].astype(np.int64)
    else:
        common = np.array([len(np.intersect1d(docs[i][2], docs[j][2], assume_unique=True)) for i, j in zip(a, b, strict=True)])
    link = 100 * common >= percent * (n[a] + n[b] - common)
    root, out = list(range(len(docs))), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in zip(a[link].tolist(), b[link].tolist(), strict=True):
        x, y = find(i), find(j)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((docs[i][0], docs[j][0]))
    return out


def _links(tiles: DataFrame, held: Broadcast, width: int, percent: int) -> DataFrame:
    """Verified links (a, b) of tiles: rows (hub, i, j, block, doc_id, text)."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, usual = held.value
        key, group, out = None, [], []

        def close():
            if len(group) > 1:
                out.extend(_forest(group, key[1] != key[2], percent))

        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
            rows = zip(keys, batch.column(3).to_pylist(), batch.column(4).to_pylist(), _sets(batch.column(5), width), strict=True)
            for now, block, doc, tokens in rows:
                if now != key:
                    close()
                    key, group = now, []
                if len(tokens):
                    group.append((doc, block, tokens, *_prefix(tokens, counts, usual, percent)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])
                out = []
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])

    return tiles.mapInArrow(verify, "a long, b long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest doc_id reachable by links; null for a null id)."""
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    scanned = stored(_scan(texts, width))
    held = docs.sparkSession.sparkContext.broadcast(_sketch(scanned))
    facts = scanned.filter("n_shingles is not null").select("doc_id", "n_shingles", "key1", "key2")
    nodes = stored(facts.filter("doc_id is not null and n_shingles > 0").groupBy("key1", "key2").agg(F.min("doc_id").alias("node")))
    edges = by_range(_postings(texts.filter("doc_id is not null"), held, width, percent)).mapInArrow(_hubs(percent), "hub long, member long").distinct()
    edges = stored(edges.unionAll(edges.select("hub", F.col("hub").alias("member")).distinct()))
    member = edges.join(nodes.select(F.col("key1").alias("member"), F.col("node").alias("doc_id")), "member").select("hub", "doc_id")
    blocks = edges.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    block = member.join(blocks, "hub").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    tile = block.withColumn("other", other).select("hub", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "doc_id")
    full = tile.join(texts, "doc_id").select("hub", "i", "j", "block", "doc_id", "text")
    full = full.repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j", "doc_id")
    roots = components(_links(full, held, width, percent))
    label = nodes.join(roots, "node", "left").select("key1", "key2", F.coalesce("root", "node").alias("component"))
    out = facts.join(label, ["key1", "key2"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with the document of the smallest id of each group, all columns as they are."""
    groups = near_groups(docs, id_col, text_col, width, percent)
    gone = groups.filter("component_id != doc_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")
