"""Repeated word passages across documents, found by recompression and removed exactly.

Documents are dealt into buckets by id. Each bucket names its runs and pairs of words for a few rounds (``recompress``) and reports the
symbols whose context fits into a window of ``width`` words. A symbol that stands in one document only rules out every window around its
context: those words stand nowhere else. Only windows without such a symbol are looked at one by one, by a hash of 128 bits with the
smallest doc_id of each bucket; the smallest of all comes back to the buckets, which then know the windows that an earlier document has.

What goes up and down is one entry per bucket and distinct key, so a passage in a third of all documents costs an entry per bucket.

Null and empty texts have no words. Rows that share a doc_id are no earlier documents to each other; a null doc_id is neither cut nor
counted as an earlier document. Texts are taken whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decisionlog.llm.packed import by_range, dealt_table, ends, grouped, planes, ranges, runs, unplanes
from decisionlog.llm.recompress import recompressed
from decisionlog.llm.shared import partitions
from decisionlog.llm.textscan import Words, covered, pieces, rolled, starts_that_fit, without

WIDTH = 13
ROUNDS, LEAST_WORDS = 3, 2
_U = np.uint64
BUCKET, BUCKETS_PER_PARTITION = "__bucket", 2


def bucketed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with the bucket of each id; rows without an id are spread by their text."""
    key = F.coalesce(F.when(F.col(id_col).isNotNull(), F.xxhash64(id_col)), F.xxhash64(text_col))
    return docs.withColumn(BUCKET, F.pmod(key, F.lit(BUCKETS_PER_PARTITION * partitions(docs.sparkSession))).cast("int"))


def _texts(rows: pa.Table, text_col: str) -> Iterator[tuple[int, Words]]:
    """(first row, words) piece by piece."""
    column = rows.column(text_col)
    at = 0
    for chunk in column.chunks:
        for i, _, data, first, end in pieces(chunk):
            yield at + i, Words(data, first, end)
        at += len(chunk)


def _ids(rows: pa.Table, id_col: str) -> tuple[np.ndarray, np.ndarray]:
    """doc ids and which rows have one."""
    column = rows.column(id_col).combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.cast(pa.int64()).fill_null(0)), np.asarray(column.is_valid())


def _symbols(words: Words, hashes: np.ndarray, width: int):
    """Symbols to report: long enough to say something, with a context that fits into a window."""
    s = recompressed(words, hashes, ROUNDS)
    use = (s.high - s.low <= width) & (s.last - s.first >= LEAST_WORDS)
    return s.name[use], s.row[use], s.low[use], s.high[use]


def _window_keys(hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    return rolled(hashes, width), rolled(hashes, width, salt=5)


def report_symbols(id_col: str, text_col: str, width: int, n_ranges: int) -> Callable[[tuple, pa.Table], pa.Table]:
    def report(key: tuple, rows: pa.Table) -> pa.Table:
        ids, valid = _ids(rows, id_col)
        names, docs = [np.zeros(0, _U)], [np.zeros(0, np.int64)]
        for at, words in _texts(rows, text_col):
            name, row, _, _ = _symbols(words, words.hashes(), width)
            use = valid[row + at]
            names.append(name[use])
            docs.append(ids[row[use] + at])
        name, doc = np.concatenate(names), np.concatenate(docs)
        order = np.argsort(name, kind="stable")
        name, doc = name[order], doc[order]
        first = runs(name)
        low, high = (np.minimum.reduceat(doc, first), np.maximum.reduceat(doc, first)) if len(first) else (doc, doc)
        return dealt_table(name[first], n_ranges, key[0].as_py(), ["keys", "several"], (low != high).astype(np.uint8))

    return report


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which of a bucket's symbols stand in more than one document."""
    for _, rows in grouped(batches):
        origins = rows.column("origin").to_pylist()
        keys = [unplanes(x, _U) for x in rows.column("keys").to_pylist()]
        several = np.concatenate([unplanes(x, np.uint8) for x in rows.column("several").to_pylist()])
        values, inverse, count = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        shared = count > 1
        shared[inverse[several > 0]] = True
        there = shared[inverse]
        at, blobs = 0, []
        for k in keys:
            blobs.append(planes(k[there[at : at + len(k)]]))
            at += len(k)
        yield pa.RecordBatch.from_arrays([pa.array(origins, pa.int32()), pa.array(blobs, pa.binary())], [BUCKET, "keys"])


def _sorted_union(rows: pa.Table, column: str, kind) -> np.ndarray:
    blobs = [unplanes(x, kind) for x in rows.column(column).to_pylist()]
    return np.concatenate(blobs) if blobs else np.zeros(0, kind)


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Where each value stands in sorted ``known``, -1 if it doesn't."""
    if not len(known):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return np.where(known[at] == values, at, -1)


def report_windows(id_col: str, text_col: str, width: int, n_ranges: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    def report(key: tuple, rows: pa.Table, symbols: pa.Table) -> pa.Table:
        ids, valid = _ids(rows, id_col)
        shared = np.sort(_sorted_union(symbols, "keys", _U))
        ones, twos, docs = [np.zeros(0, _U)], [np.zeros(0, _U)], [np.zeros(0, np.int64)]
        for at, words in _texts(rows, text_col):
            hashes = words.hashes()
            name, _, low, high = _symbols(words, hashes, width)
            alone = _among(name, shared) < 0
            edge = np.zeros(len(hashes) + 2, np.int32)
            np.add.at(edge, np.maximum(high[alone] - width, 0), 1)
            np.add.at(edge, np.maximum(low[alone] + 1, 0), -1)
            starts, row = starts_that_fit(words.low, words.high, width)
            maybe = (np.cumsum(edge)[starts] == 0) & valid[row + at] if len(starts) else np.zeros(0, bool)
            starts, row = starts[maybe], row[maybe]
            one, two = _window_keys(hashes, width)
            ones.append(one[starts])
            twos.append(two[starts])
            docs.append(ids[row + at])
        one, two, doc = np.concatenate(ones), np.concatenate(twos), np.concatenate(docs)
        order = np.lexsort((doc, two, one))
        one, two, doc = one[order], two[order], doc[order]
        new = np.ones(len(one), bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        first = np.flatnonzero(new)
        last = doc[ends(first, len(doc)) - 1]
        columns = two[first], doc[first], (last != doc[first]).astype(np.uint8)
        return dealt_table(one[first], n_ranges, key[0].as_py(), ["keys", "more", "docs", "several"], *columns)

    return report


def _earliest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each bucket the windows that an earlier document has too, with the smallest id."""
    for _, rows in grouped(batches):
        origins = rows.column("origin").to_pylist()
        sets = [[unplanes(x, kind) for x in rows.column(name).to_pylist()] for name, kind in (("keys", _U), ("more", _U), ("docs", np.int64), ("several", np.uint8))]
        one, two, doc, several = (np.concatenate(s) for s in sets)
        of = np.repeat(np.arange(len(origins)), [len(k) for k in sets[0]])
        order = np.lexsort((doc, two, one))
        new = np.ones(len(order), bool)
        new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
        least = np.empty(len(order), np.int64)
        least[order] = doc[order][np.flatnonzero(new)][np.cumsum(new) - 1]
        send = (least < doc) | (several > 0)
        one, two, least, of = one[send], two[send], least[send], of[send]
        cut = np.searchsorted(of, np.arange(len(origins) + 1))
        blobs = [[planes(x[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)] for x in (one, two, least)]
        yield pa.RecordBatch.from_arrays([pa.array(origins, pa.int32()), *(pa.array(b, pa.binary()) for b in blobs)], [BUCKET, "keys", "more", "docs"])


def removed_words(words: Words, ids: np.ndarray, valid: np.ndarray, known: tuple[np.ndarray, np.ndarray, np.ndarray], width: int) -> np.ndarray:
    """Which words of a piece are covered by windows of an earlier document. ``known``: sorted windows and their smallest ids."""
    hashes = words.hashes()
    starts, row = starts_that_fit(words.low, words.high, width)
    if not len(starts) or not len(known[0]):
        return np.zeros(len(hashes), bool)
    one, two = _window_keys(hashes, width)
    at = _among(one[starts], known[0])
    gone = (at >= 0) & valid[row]
    gone &= (known[1][at] == two[starts]) & (known[2][at] < ids[row])
    for k in np.flatnonzero((at >= 0) & ~gone & valid[row]):  # equal first halves of different windows
        j = at[k]
        while j < len(known[0]) and known[0][j] == one[starts[k]]:
            gone[k] |= known[1][j] == two[starts[k]] and known[2][j] < ids[row[k]]
            j += 1
    return covered(starts[gone], width, len(hashes))


def _known(answer: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    one, two, doc = (_sorted_union(answer, name, kind) for name, kind in (("keys", _U), ("more", _U), ("docs", np.int64)))
    order = np.lexsort((two, one))
    return one[order], two[order], doc[order]


def repeats(dealt: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """Per bucket of ``dealt`` the windows that an earlier document has."""
    n = ranges(dealt)
    up = "part int, origin long, keys binary, several binary"
    symbols = by_range(dealt.groupBy(BUCKET).applyInArrow(report_symbols(id_col, text_col, width, n), up))
    shared = symbols.mapInArrow(_shared, f"{BUCKET} int, keys binary")
    up = "part int, origin long, keys binary, more binary, docs binary, several binary"
    windows = dealt.groupBy(BUCKET).cogroup(shared.groupBy(BUCKET)).applyInArrow(report_windows(id_col, text_col, width, n), up)
    return by_range(windows).mapInArrow(_earliest, f"{BUCKET} int, keys binary, more binary, docs binary")


def dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """Per document: its words, the removed ones, and the digest of what is left."""
    dealt = bucketed(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text")

    def report(key: tuple, rows: pa.Table, answer: pa.Table) -> pa.Table:
        ids, valid = _ids(rows, "doc_id")
        known, n, removed, digests = _known(answer), [], [], []
        for at, words in _texts(rows, "text"):
            size = len(words.low)
            gone = removed_words(words, ids[at : at + size], valid[at : at + size], known, width)
            total = np.r_[0, np.cumsum(gone)]
            n.append(words.high - words.low)
            removed.append(total[words.high] - total[words.low])
            raw = words.data.tobytes()
            for low, high in zip(words.low.tolist(), words.high.tolist(), strict=True):
                kept = low + np.flatnonzero(~gone[low:high])
                digests.append(hashlib.sha256(b" ".join([raw[a:b] for a, b in zip(words.start[kept].tolist(), words.end[kept].tolist(), strict=True)])).hexdigest())
        empty = np.zeros(0, np.int64)
        return pa.table([rows.column("doc_id"), pa.array(np.concatenate([empty, *n])), pa.array(np.concatenate([empty, *removed])), pa.array(digests, pa.string())], names)

    names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    answers = repeats(dealt, "doc_id", "text", width)
    return dealt.groupBy(BUCKET).cogroup(answers.groupBy(BUCKET)).applyInArrow(report, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """``docs`` without the words that earlier documents have in the same passage; documents left without a word go.

    Each removed range goes from its first word to its last; documents without repeats stay as they are.
    """
    dealt = bucketed(docs, id_col, text_col)
    names = docs.columns

    def cut(key: tuple, rows: pa.Table, answer: pa.Table) -> pa.Table:
        ids, valid = _ids(rows, id_col)
        known, keep, texts = _known(answer), np.ones(len(rows), bool), {}
        for at, words in _texts(rows, text_col):
            size = len(words.low)
            gone = removed_words(words, ids[at : at + size], valid[at : at + size], known, width)
            total = np.r_[0, np.cumsum(gone)]
            for row in np.flatnonzero(total[words.high] > total[words.low]).tolist():
                texts[at + row], keep[at + row] = without(words, row, gone)
        rows = rows.select(names)
        if texts:
            column = rows.column(text_col).to_pylist()
            for row, text in texts.items():
                column[row] = text
            rows = rows.set_column(names.index(text_col), rows.schema.field(text_col), pa.array(column, rows.schema.field(text_col).type))
        return rows.filter(pa.array(keep))

    answers = repeats(dealt, id_col, text_col, width)
    return dealt.groupBy(BUCKET).cogroup(answers.groupBy(BUCKET)).applyInArrow(cut, docs.schema)
