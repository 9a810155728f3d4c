"""Benchmark decontamination: a broadcast hash set of the test items' word windows, scanned over whole training texts.

A text is lower-cased (A-Z) and cut into words of ASCII letters and digits and all other non-ASCII characters. A window is ``width``
consecutive words of an item; a shorter item is one window. Document windows are hashed in numpy and looked up in the broadcast set;
each hit is then verified word by word. The set is broadcast in slices of at most ``SLICE_WINDOWS`` windows; a test set of any size is
scanned slice by slice, so what is broadcast has a bound and nothing is left out.

Null and empty texts have no words and no hits; items without words match nothing; repeated items and documents count each for itself.
Items without an id hit words like any other: together they are one more item in a document's ``n_items``, without a name in ``items_sha256``.
Texts of any length are scanned whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decisionlog.llm.shared import free_name, stored
from decisionlog.llm.textscan import ALPHANUMERIC, LOWER, Words, pieces, rolled, sliced, starts_that_fit, without

WIDTH = 10
SLICE_WINDOWS = 500_000
_FILTER = 1 << 20
_GRAM = "item string, words int, gram binary, hash long"
_SPANS = "array<struct<first:int,last:int>>"


def _normalised(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> Words:
    return Words(LOWER[data], first, end, ALPHANUMERIC)


def test_grams(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """Every window of every item: item id as text, number of words, the words, their hash."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            for i, j, data, first, end in pieces(batch.column(1)):
                words = _normalised(data, first, end)
                hashes = words.hashes()
                out = []
                for row, (low, high) in enumerate(zip(words.low, words.high, strict=True)):
                    size = min(width, int(high - low))
                    if size:
                        roll = rolled(hashes[low:high], size)
                        out += [(names[i + row], size, words.joined(s, s + size), int(roll[s - low].astype(np.int64))) for s in range(low, high - size + 1)]
                columns = [list(c) for c in zip(*out, strict=True)] if out else [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.binary(), pa.int64()), strict=True)], ["item", "words", "gram", "hash"])

    return benchmark.select(F.col(id_col).cast("string"), F.col(text_col)).mapInArrow(cut, _GRAM).distinct()


Grams = tuple[dict[bytes, list[str | None]], dict[int, tuple[np.ndarray, np.ndarray]]]


def _lookup(rows) -> Grams:
    """A slice of the test windows: items by window, and by number of words the sorted hashes with a bit table before them."""
    items: dict[bytes, list[str | None]] = {}
    by_size: dict[int, set[int]] = {}
    for row in rows:
        items.setdefault(bytes(row.gram), []).append(row.item)
        by_size.setdefault(row.words, set()).add(row.hash)
    sizes = {}
    for size, hashes in by_size.items():
        known = np.sort(np.array(list(hashes), np.int64).astype(np.uint64))
        seen = np.zeros(_FILTER, bool)
        seen[known & np.uint64(_FILTER - 1)] = True
        sizes[size] = (known, seen)
    return items, sizes


def _hits(words: Words, grams: Grams) -> list[tuple[int, int, int, list[str | None]]]:
    """Verified (row, first word, number of words, items)."""
    (texts, sizes), hashes, out = grams, words.hashes(), []
    for size, (known, seen) in sizes.items():
        starts, rows = starts_that_fit(words.low, words.high, size)
        roll = rolled(hashes, size)
        if not len(starts):
            continue
        maybe = seen[roll[starts] & np.uint64(_FILTER - 1)]
        starts, rows = starts[maybe], rows[maybe]
        at = np.minimum(np.searchsorted(known, roll[starts]), len(known) - 1)
        same = known[at] == roll[starts]
        for s, row in zip(starts[same], rows[same], strict=True):
            items = texts.get(words.joined(s, s + size))
            if items:
                out.append((int(row), int(s - words.low[row]), size, items))
    return out


def _scan(df: DataFrame, text_col: str, added: list[str], held: Broadcast, cut: bool = False) -> DataFrame:
    """``df`` with its hits added to the columns ``added``: number of words, hit word ranges (sorted and merged), items. ``cut``: without the hit
    words, in the same pass."""
    names = df.columns
    at, (words_at, spans_at, items_at) = names.index(text_col), map(names.index, added)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = held.value
        for whole in batches:
            for batch in sliced(whole, at):
                spans, items, counts, texts, keep = batch.column(spans_at).to_pylist(), batch.column(items_at).to_pylist(), [], {}, np.ones(len(batch), bool)
                for i, _, data, first, end in pieces(batch.column(at)):
                    words = _normalised(data, first, end)
                    counts.append(words.high - words.low)
                    for row, start, size, found in _hits(words, grams):
                        spans[i + row].append({"first": start, "last": start + size})
                        items[i + row].extend(found)
                    for row in range(len(first)) if cut else ():
                        if spans[i + row]:
                            texts[i + row], keep[i + row] = _without(words, row, spans[i + row], data)
                columns = list(batch.columns)
                columns[spans_at] = pa.array([_merged(s) for s in spans], batch.column(spans_at).type)
                columns[items_at] = pa.array([sorted(set(x), key=_by_name) for x in items], batch.column(items_at).type)
                columns[words_at] = pa.array(np.concatenate(counts) if counts else [], pa.int64())
                if texts:
                    columns[at] = pa.array([texts.get(k, t) for k, t in enumerate(batch.column(at).to_pylist())], batch.column(at).type)
                out = pa.RecordBatch.from_arrays(columns, names)
                yield out.filter(pa.array(keep)) if cut else out

    return df.mapInArrow(scan, df.schema)


def _without(words: Words, row: int, spans: list[dict], data: np.ndarray) -> tuple[str, bool]:
    gone = np.zeros(len(words.start), bool)
    for s in spans:
        gone[words.low[row] + s["first"] : words.low[row] + s["last"]] = True
    return without(words, row, gone, data)


def _by_name(item: str | None) -> tuple[bool, str]:
    return item is None, item or ""


def _merged(spans: list[dict]) -> list[dict]:
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: s["first"]):
        if out and s["first"] <= out[-1]["last"]:
            out[-1]["last"] = max(out[-1]["last"], s["last"])
        else:
            out.append(dict(s))
    return out


def _found(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text_col: str, width: int, cut: bool) -> tuple[DataFrame, list[str]]:
    grams = stored(test_grams(benchmark, item_col, item_text_col, width))
    slices = max(1, -(-grams.count() // SLICE_WINDOWS))
    added = [free_name(docs, c) for c in ("__words", "__spans", "__items")]
    out = docs.withColumns(dict(zip(added, (F.lit(0).cast("bigint"), F.array().cast(_SPANS), F.array().cast("array<string>")), strict=True)))
    context = docs.sparkSession.sparkContext
    for k in range(slices):
        # at most about SLICE_WINDOWS rows, also where many items share a window
        rows = grams.filter(F.pmod(F.xxhash64("hash", "item"), F.lit(slices)) == k).collect()
        out = _scan(out, text_col, added, context.broadcast(_lookup(rows)), cut and k + 1 == slices)
        out = stored(out) if k + 1 < slices else out
    return out, added


def find_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """``docs`` with ``__words`` (number of words), ``__spans`` (hit ranges of words) and ``__items`` (items with a window in the text).

    Where ``docs`` has such a column, the new one has an underscore more.
    """
    return _found(docs, benchmark, text_col, item_col, item_text_col, width, cut=False)[0]


def leak_report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """Per document: words, hit words, items and their digest, and whether it is contaminated."""
    found = find_leaks(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), benchmark, width=width)
    hit = F.aggregate("__spans", F.lit(0).cast("bigint"), lambda n, s: n + s["last"] - s["first"])
    return found.select(
        "doc_id", F.col("__words").alias("n_words"), hit.alias("n_hit"), F.size("__items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("__items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def remove_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", width: int = WIDTH, remove: str = "spans") -> DataFrame:
    """``docs`` without leaked words (``spans``) or without leaking documents (``documents``).

    A removed range goes from its first to its last word; documents left without any word go too. Clean documents stay as they are.
    """
    if remove not in ("spans", "documents"):
        raise ValueError("remove: spans or documents")
    out, (_, spans, _) = _found(docs, benchmark, text_col, "item_id", "text", width, cut=remove == "spans")
    return (out if remove == "spans" else out.filter(F.size(spans) == 0)).select(*docs.columns)
