"""Long repeated byte strings, found through a logarithmic family of anchor indexes and removed exactly.

Index. Of every ``width``-byte window the suffix at its smallest hashed ``GRAM``-byte gram is indexed; equal windows choose the same place,
so every repeat of ``width`` bytes is found through a place both copies index, at about one in 170 bytes. These are no suffix arrays: an
entry is the hash of the gram, its four leading bytes, a bucket and a flag, without a text position; it is dealt to a range by the
hash, and beyond four bytes the order is that of hashes. An exact repeat needs equal anchors only, not their neighbours in suffix order, and
hashes spread a much repeated beginning over the ranges, which a cut by prefix cannot. A new batch is looked up in each existing level
(stored tables) by hash; no common-prefix lengths are found. Then levels of equal size merge, as in a binary counter, so an entry is
rewritten a logarithmic number of times.

Check. Only windows at shared suffixes are compared, by hashes of 128 bits of all their bytes: first in slices of up to ``SLICE`` windows
that share a core, and window by window only where slices have equal cores but differ at their edges. Entries are made unique per bucket,
so a string in a third of all documents costs an entry per bucket.

Null and empty texts have no bytes; repeated rows count as different places. Long texts are worked on in segments.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decisionlog.llm.packed import by_range, dealt_table, ends, grouped, planes, ranges, runs, unplanes
from decisionlog.llm.shared import stored
from decisionlog.llm.substrings import BUCKET, bucketed
from decisionlog.llm.textscan import column_bytes, covered, mix

WIDTH, GRAM, SLICE, BATCHES = 400, 64, 32, 4
UNIT_BYTES = 1 << 20
_PLACE_BITS = 22  # a unit is shorter than 2**22 bytes
_U = np.uint64
_RATIOS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class _Powers:
    """Powers of an odd ratio and of its inverse modulo 2**64."""

    def __init__(self, ratio: int):
        self.ratio, self.inverse, self.up, self.down = ratio, pow(ratio, -1, 1 << 64), np.ones(1, _U), np.ones(1, _U)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, UNIT_BYTES + 2 * WIDTH)
            self.up, self.down = (np.cumprod(np.r_[_U(1), np.full(n, r, _U)], dtype=_U) for r in (self.ratio, self.inverse))
        return self.up, self.down


_powers = [_Powers(r) for r in _RATIOS]


class Unit:
    """Some stretches of texts, one after another: (row, offset in the row's text) of each, and sums to hash any range of them."""

    def __init__(self, data: np.ndarray, row: np.ndarray, offset: np.ndarray, begin: np.ndarray, end: np.ndarray, sums: int):
        self.data, self.row, self.offset, self.begin, self.end, self.sums = data, row, offset, begin, end, []
        for powers in _powers[:sums]:
            up, _ = powers.of(len(data) + 1)
            total = np.zeros(len(data) + 1, _U)
            np.cumsum((data.astype(_U) + _U(1)) * up[: len(data)], out=total[1:])
            self.sums.append(total)

    def hashes(self, begin: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
        total, (_, down) = self.sums[which], _powers[which].of(len(self.data) + 1)
        return mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(_U))


def units(column: pa.ChunkedArray, width: int, sums: int) -> Iterator[Unit]:
    """The texts in units of about UNIT_BYTES. A long text's stretches overlap, so each window start is in one stretch."""
    held: list[tuple[np.ndarray, int, int]] = []
    size, row = 0, 0

    def made() -> Unit:
        ends = np.cumsum([len(h[0]) for h in held])
        begins = ends - [len(h[0]) for h in held]
        return Unit(np.concatenate([h[0] for h in held]), np.array([h[1] for h in held]), np.array([h[2] for h in held]), begins, ends, sums)

    for chunk in column.chunks:
        data, first, end = column_bytes(chunk)
        for a, b in zip(first.tolist(), end.tolist(), strict=True):
            for at in range(a, max(a, b - width) + 1, UNIT_BYTES):
                text = data[at : min(b, at + UNIT_BYTES + width - 1)]
                if len(text) >= width:
                    held.append((text, row, at - a))
                    size += len(text)
                    if size >= UNIT_BYTES:
                        yield made()
                        held, size = [], 0
            row += 1
    if held:
        yield made()


def _starts(u: Unit, width: int) -> np.ndarray:
    """All window starts of a unit."""
    n = u.end - u.begin - width + 1
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(u.begin, n)


def _anchored(u: Unit, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window starts, the place of each one's suffix, and the gram hash of every place."""
    n = len(u.data) - GRAM + 1
    gram = u.hashes(np.arange(n), np.arange(n) + GRAM, 0)
    mask = _U((1 << _PLACE_BITS) - 1)
    key = (gram & ~mask) | np.arange(n, dtype=_U)
    span = width - GRAM + 1
    padded = np.full(-(-n // span) * span, np.iinfo(_U).max, _U)
    padded[:n] = key
    blocks = padded.reshape(-1, span)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    starts = _starts(u, width)
    least = np.minimum(behind[starts], ahead[starts + span - 1])
    return starts, (least & mask).astype(np.int64), gram


def suffix_entries(width: int, n_ranges: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """A bucket's indexed suffixes: gram hash, leading bytes, and whether it has several."""

    def entries(key: tuple, rows: pa.Table) -> pa.Table:
        grams, leads = [np.zeros(0, _U)], [np.zeros(0, np.uint32)]
        for u in units(rows.column("text"), width, 1):
            _, place, gram = _anchored(u, width)
            place = place[runs(place)]
            grams.append(gram[place])
            leads.append(sum(u.data[place + k].astype(np.uint32) << np.uint32(24 - 8 * k) for k in range(4)))
        gram, lead = np.concatenate(grams), np.concatenate(leads)
        gram, first, count = np.unique(gram, return_index=True, return_counts=True)
        out = dealt_table(gram, n_ranges, key[0].as_py(), ["keys", "leads", "several"], lead[first], (count > 1).astype(np.uint8))
        return out.append_column("batch", pa.array([key[0].as_py() % BATCHES] * len(out), pa.int32()))

    return entries


LEVEL = "part int, leads binary, keys binary, buckets binary, several binary"
_LEVEL_NAMES = [x.split()[0] for x in LEVEL.split(", ")]
_KINDS = {"leads": np.uint32, "keys": _U, "buckets": np.int32, "several": np.uint8}


def _suffix_order(part: int, columns: dict[str, np.ndarray]) -> pa.Table:
    order = np.lexsort((columns["buckets"], columns["keys"], columns["leads"]))
    return pa.table([pa.array([part], pa.int32()), *(pa.array([planes(columns[n][order])], pa.binary()) for n in _KINDS)], _LEVEL_NAMES)


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One suffix array per range of a new batch."""
    for part, rows in grouped(batches):
        keys, leads, several = ([unplanes(x, _KINDS[n]) for x in rows.column(n).to_pylist()] for n in ("keys", "leads", "several"))
        buckets = np.repeat(np.array(rows.column("origin").to_pylist(), np.int32), [len(k) for k in keys])
        columns = {"leads": np.concatenate(leads), "keys": np.concatenate(keys), "buckets": buckets, "several": np.concatenate(several)}
        yield from _suffix_order(part, columns).to_batches()


def _columns(*tables: pa.Table) -> dict[str, np.ndarray]:
    return {n: np.concatenate([np.zeros(0, kind), *(unplanes(x, kind) for t in tables for x in t.column(n).to_pylist())]) for n, kind in _KINDS.items()}


def _merged(key: tuple, one: pa.Table, two: pa.Table) -> pa.Table:
    return _suffix_order(key[0].as_py(), _columns(one, two))


HITS = f"{BUCKET} int, keys binary"


def _hit_rows(buckets: np.ndarray, keys: np.ndarray) -> pa.Table:
    order = np.argsort(buckets, kind="stable")
    buckets, keys = buckets[order], keys[order]
    first = runs(buckets)
    blobs = [planes(np.sort(keys[a:b])) for a, b in zip(first, ends(first, len(keys)), strict=True)]
    return pa.table([pa.array(buckets[first], pa.int32()), pa.array(blobs, pa.binary())], [BUCKET, "keys"])


def _scan_self(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffixes of a batch that have an equal neighbour in it."""
    for batch in batches:
        for k in range(len(batch)):
            c = _columns(pa.Table.from_batches([batch.slice(k, 1)]))
            first = runs(c["keys"])
            size = np.diff(np.r_[first, len(c["keys"])])
            hit = np.repeat(size > 1, size) | (c["several"] > 0)
            yield from _hit_rows(c["buckets"][hit], c["keys"][hit]).to_batches()


def _scan_level(key: tuple, new: pa.Table, level: pa.Table) -> pa.Table:
    """Suffixes of a batch and of a level that are equal."""
    a, b = _columns(new), _columns(level)
    hit_a, hit_b = np.isin(a["keys"], b["keys"]), np.isin(b["keys"], a["keys"])
    return _hit_rows(np.r_[a["buckets"][hit_a], b["buckets"][hit_b]], np.r_[a["keys"][hit_a], b["keys"][hit_b]])


class IndexFamily:
    """Levels of anchors; ``add`` takes a new batch and returns the shared suffixes that it brings, by bucket."""

    def __init__(self) -> None:
        self.levels: list[tuple[int, DataFrame]] = []

    def add(self, entries: DataFrame) -> DataFrame:
        new = stored(by_range(entries.select("part", "origin", "keys", "leads", "several")).mapInArrow(_arrays, LEVEL))
        hits = new.mapInArrow(_scan_self, HITS)
        for _, level in self.levels:
            hits = hits.unionAll(new.groupBy("part").cogroup(level.groupBy("part")).applyInArrow(_scan_level, HITS))
        hits, size = stored(hits), 1
        while self.levels and self.levels[-1][0] == size:
            _, level = self.levels.pop()
            new, size = stored(new.groupBy("part").cogroup(level.groupBy("part")).applyInArrow(_merged, LEVEL)), 2 * size
        self.levels.append((size, new))
        return hits


class Slices:
    """Neighbouring windows that hang on one shared suffix, at most SLICE of them: first and last start, core, and all their bytes."""

    def __init__(self, u: Unit, shared: np.ndarray, width: int):
        starts, place, gram = _anchored(u, width)
        use = _among(gram[place], shared) >= 0
        starts, place = starts[use], place[use]
        part = (place - starts) // SLICE
        new = np.ones(len(starts), bool)
        new[1:] = (place[1:] != place[:-1]) | (part[1:] != part[:-1]) | (starts[1:] != starts[:-1] + 1)
        at = np.flatnonzero(new)
        self.first, self.last = starts[at], starts[ends(at, len(starts)) - 1]
        place, part = place[at], part[at]
        core, stop = place - SLICE * part, place - SLICE * part - (SLICE - 1) + width
        self.core = u.hashes(core, stop, 0) + part.astype(_U), u.hashes(core, stop, 1)
        low, high = (place - self.last).astype(_U), (place - self.first).astype(_U)
        self.whole = mix(u.hashes(self.first, self.last + width, 0) + mix(low * _U(width + 1) + high)) ^ u.hashes(self.first, self.last + width, 1)


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return np.where(known[at] == values, at, -1)


def _group(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows by ``keys``, and where each group begins in it."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    return order, np.flatnonzero(new)


def _unique(keys: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows, and which of them came several times."""
    order, first = _group(*keys)
    count = np.diff(np.r_[first, len(order)])
    return [k[order][first] for k in keys], (count > 1).astype(np.uint8)


def _parts_of(answer: pa.Table, kind: str, columns: list[tuple[str, type]]) -> list[np.ndarray]:
    """The arrays of the answer rows of one kind."""
    rows = answer.filter(pa.array([k == kind for k in answer.column("kind").to_pylist()], pa.bool_()))
    return [np.concatenate([np.zeros(0, t), *(unplanes(x, t) for x in rows.column(n).to_pylist())]) for n, t in columns]


ANSWER = f"{BUCKET} int, kind string, keys binary, more binary, whole binary, state binary"
_EMPTY = np.zeros(0, _U)


def report_slices(width: int, n_ranges: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    def report(key: tuple, rows: pa.Table, answer: pa.Table) -> pa.Table:
        (shared,) = _parts_of(answer, "suffix", [("keys", _U)])
        shared = np.unique(shared)
        found = [[_EMPTY], [_EMPTY], [_EMPTY]]
        for u in units(rows.column("text"), width, 2) if len(shared) else []:
            s = Slices(u, shared, width)
            for into, x in zip(found, (*s.core, s.whole), strict=True):
                into.append(x)
        (one, two, whole), several = _unique([np.concatenate(x) for x in found])
        return dealt_table(one, n_ranges, key[0].as_py(), ["keys", "more", "whole", "several"], two, whole, several)

    return report


def _slice_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each bucket's slices that share their core: bit 1, all bytes are the same somewhere; bit 2, the core has other edges too."""
    for _, rows in grouped(batches):
        origins = rows.column("origin").to_pylist()
        sets = [[unplanes(x, t) for x in rows.column(n).to_pylist()] for n, t in (("keys", _U), ("more", _U), ("whole", _U), ("several", np.uint8))]
        one, two, whole, several = (np.concatenate(s) for s in sets)
        of = np.repeat(np.arange(len(origins)), [len(k) for k in sets[0]])
        state = np.zeros(len(one), np.uint8)
        order, first = _group(one, two, whole)
        size = np.diff(np.r_[first, len(order)])
        twice = (size > 1) | (np.maximum.reduceat(several[order], first) > 0)
        state[order] |= np.repeat(twice, size).astype(np.uint8)
        outer = np.flatnonzero(np.r_[True, (one[order][first][1:] != one[order][first][:-1]) | (two[order][first][1:] != two[order][first][:-1])])
        kinds = np.diff(np.r_[outer, len(first)])
        state[order] |= np.repeat(np.repeat(kinds > 1, kinds), size).astype(np.uint8) * np.uint8(2)
        yield _answer(origins, of, state > 0, "slice", one, two, whole, state)


def _answer(origins: list[int], of: np.ndarray, send: np.ndarray, kind: str, *columns: np.ndarray) -> pa.RecordBatch:
    of, columns = of[send], [c[send] for c in columns]
    cut = np.searchsorted(of, np.arange(len(origins) + 1))
    blobs = [pa.array([planes(c[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()) for c in columns]
    blobs += [pa.nulls(len(origins), pa.binary())] * (4 - len(blobs))
    return pa.RecordBatch.from_arrays([pa.array(origins, pa.int32()), pa.array([kind] * len(origins)), *blobs], [BUCKET, "kind", "keys", "more", "whole", "state"])


class _Known:
    """What a bucket knows of its slices."""

    def __init__(self, answer: pa.Table):
        (shared,) = _parts_of(answer, "suffix", [("keys", _U)])
        self.shared = np.unique(shared)
        one, two, whole, state = _parts_of(answer, "slice", [("keys", _U), ("more", _U), ("whole", _U), ("state", np.uint8)])
        label = mix(one) + mix(two + _U(1)) + mix(whole + _U(2))
        order = np.argsort(label)
        self.label, self.state = label[order], state[order]

    def states(self, s: Slices) -> np.ndarray:
        at = _among(mix(s.core[0]) + mix(s.core[1] + _U(1)) + mix(s.whole + _U(2)), self.label)
        return np.where(at >= 0, self.state[at] if len(self.state) else 0, 0)


def _spread(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    n = last - first + 1
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def report_windows(width: int, n_ranges: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """The windows, one by one, of slices whose core has several edges."""

    def report(key: tuple, rows: pa.Table, answer: pa.Table) -> pa.Table:
        known, found = _Known(answer), [[_EMPTY], [_EMPTY]]
        for u in units(rows.column("text"), width, 2) if len(known.label) else []:
            s = Slices(u, known.shared, width)
            fine = known.states(s) > 1
            at = _spread(s.first[fine], s.last[fine])
            for k in (0, 1):
                found[k].append(u.hashes(at, at + width, k))
        (one, two), several = _unique([np.concatenate(x) for x in found])
        return dealt_table(one, n_ranges, key[0].as_py(), ["keys", "more", "several"], two, several)

    return report


def _window_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, rows in grouped(batches):
        origins = rows.column("origin").to_pylist()
        sets = [[unplanes(x, t) for x in rows.column(n).to_pylist()] for n, t in (("keys", _U), ("more", _U), ("several", np.uint8))]
        one, two, several = (np.concatenate(s) for s in sets)
        of = np.repeat(np.arange(len(origins)), [len(k) for k in sets[0]])
        order, first = _group(one, two)
        size = np.diff(np.r_[first, len(order)])
        twice = np.zeros(len(one), bool)
        twice[order] = np.repeat((size > 1) | (np.maximum.reduceat(several[order], first) > 0), size)
        yield _answer(origins, of, twice, "window", one, two)


OUT = "doc_id long, n_bytes long, spans array<struct<first:long,last:long>>, kept binary"


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """Per document: its bytes, the removed spans (maximal byte ranges) and what is left of it."""
    if width < GRAM + SLICE:
        raise ValueError(f"width: at least {GRAM + SLICE} bytes")
    texts = bucketed(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text")
    n = ranges(docs)
    entries = stored(texts.groupBy(BUCKET).applyInArrow(suffix_entries(width, n), "part int, origin long, keys binary, leads binary, several binary, batch int"), "batch")
    family, hits = IndexFamily(), None
    for batch in range(BATCHES):
        found = family.add(entries.filter(F.col("batch") == batch))
        hits = found if hits is None else hits.unionAll(found)
    none = F.lit(None).cast("binary")
    known = hits.select(BUCKET, F.lit("suffix").alias("kind"), "keys", none.alias("more"), none.alias("whole"), none.alias("state"))
    for step, states in ((report_slices, _slice_states), (report_windows, _window_states)):
        up = "part int, origin long, keys binary, more binary, whole binary, several binary" if step is report_slices else "part int, origin long, keys binary, more binary, several binary"
        asked = texts.groupBy(BUCKET).cogroup(known.groupBy(BUCKET)).applyInArrow(step(width, n), up)
        known = known.unionAll(stored(by_range(asked).mapInArrow(states, ANSWER)))

    def cut(key: tuple, rows: pa.Table, answer: pa.Table) -> pa.Table:
        known = _Known(answer)
        one, two = _parts_of(answer, "window", [("keys", _U), ("more", _U)])
        fine = np.sort(mix(one) + mix(two + _U(1)))
        starts: dict[int, list[np.ndarray]] = {}
        for u in units(rows.column("text"), width, 2) if len(known.label) else []:
            s = Slices(u, known.shared, width)
            state = known.states(s)
            whole, parts = (state & 1) > 0, state == 2
            at = _spread(s.first[parts], s.last[parts])
            at = at[_among(mix(u.hashes(at, at + width, 0)) + mix(u.hashes(at, at + width, 1) + _U(1)), fine) >= 0]
            at = np.sort(np.r_[_spread(s.first[whole], s.last[whole]), at])
            stretch = np.searchsorted(u.end, at, "right")
            for k in np.unique(stretch).tolist():
                starts.setdefault(int(u.row[k]), []).append(at[stretch == k] - u.begin[k] + u.offset[k])
        spans, kept, sizes, row = [], [], [], 0
        for chunk in rows.column("text").chunks:
            data, first, end = column_bytes(chunk)
            for a, b in zip(first.tolist(), end.tolist(), strict=True):
                text, found = data[a:b], []
                if row in starts:
                    gone = covered(np.concatenate(starts[row]), width, b - a)
                    mask = np.r_[False, gone, False]
                    found = list(zip(np.flatnonzero(mask[1:] & ~mask[:-1]).tolist(), np.flatnonzero(mask[:-1] & ~mask[1:]).tolist(), strict=True))
                    text = text[~gone]
                spans.append([{"first": x, "last": y} for x, y in found])
                kept.append(text.tobytes())
                sizes.append(b - a)
                row += 1
        kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
        return pa.table([rows.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return texts.groupBy(BUCKET).cogroup(known.groupBy(BUCKET)).applyInArrow(cut, OUT)


def dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """Per document: bytes, removed bytes and spans, and the digest of what is left."""
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["last"] - s["first"])
    return dedup(docs, id_col, text_col, width).select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
