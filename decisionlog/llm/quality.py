"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Every rule is a condition that rejects a document, with its own expression over the text. On a bounded sample of documents each rule's
cost (seconds to evaluate it alone) and selectivity (share it rejects) are measured; the cascade then asks the rules in order of
rejection per cost and stops at the first that rejects. The order changes the time, never the verdict, because one rejection is enough.

Null texts have no words and are rejected as too short, like empty ones. Repeated rows are judged each for itself, texts of any length
whole. Nothing is shuffled.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decisionlog.functions.bind import let
from decisionlog.llm.shared import stored

SAMPLE_ROWS = 1000
_SPACE = r"[\x20\x09-\x0D]+"
_SPACES = " \t\n\u000b\u000c\r"
_SYMBOLS = "#*$%&|<>"


def words(text: Column) -> Column:
    """The words of a text; a null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), _SPACE), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Runs of other characters than white space, counted without building them."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "w")
    return F.length(F.translate(bare, _SPACES, "")).cast("bigint")


def word_chars(text: Column) -> Column:
    return F.coalesce(F.length(F.translate(text, _SPACES, "")), F.lit(0)).cast("bigint")


def n_symbols(text: Column) -> Column:
    return F.coalesce(F.length(text) - F.length(F.translate(text, _SYMBOLS, "")), F.lit(0)).cast("bigint")


def _lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.translate(x, _SPACES, "") != "")


def n_lines(text: Column) -> Column:
    """Lines with a word."""
    return F.size(_lines(text)).cast("bigint")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint")


def n_repeat_words(text: Column, width: int = 5) -> Column:
    """Words inside windows of ``width`` words that the text holds twice or more.

    Windows are 64-bit hashes. Only where two are equal are they sorted with their places; the places of equal neighbours give the words.
    """
    one = F.lit(1)

    def places(windows: Column) -> Column:
        def twins(order: Column) -> Column:
            same = lambda s, k: (s["h"] == F.get(order, k - one)["h"]) | (s["h"] == F.get(order, k + one)["h"])
            return F.sort_array(F.filter(F.transform(order, lambda s, k: F.when(F.coalesce(same(s, k), F.lit(False)), s["i"])), lambda p: p.isNotNull()))

        return let(F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), twins)

    def reach(at: Column) -> Column:
        steps = F.transform(at, lambda p, k: F.least(F.lit(width), F.coalesce(F.get(at, k + one) - p, F.lit(width))))
        return F.aggregate(steps, F.lit(0).cast("bigint"), lambda n, x: n + x)

    def of_windows(windows: Column) -> Column:
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("bigint")).otherwise(let(places(windows), reach))

    def of_hashes(hashes: Column) -> Column:
        starts = F.slice(hashes, 1, F.greatest(F.size(hashes) - (width - 1), F.lit(0)))
        window = F.transform(starts, lambda h, i: F.xxhash64(h, *(F.get(hashes, i + j) for j in range(1, width))))
        return let(window, of_windows)

    return let(F.transform(words(text), lambda w: F.xxhash64(w)), of_hashes)


@dataclass(frozen=True)
class Rule:
    """A document is rejected where ``rejects(text)`` is true."""

    name: str
    rejects: Callable[[Column], Column]


def base_rules() -> list[Rule]:
    return [
        Rule("too_short", lambda t: n_words(t) < 10),
        Rule("repeats", lambda t: 100 * n_repeat_words(t) > 20 * n_words(t)),
    ]


def more_rules() -> list[Rule]:
    """Layout rules: loose enough for any prose with white space between words; a repeated head or foot line is no fault."""
    return [
        Rule("symbols", lambda t: 10 * n_symbols(t) > n_words(t)),
        Rule("short_words", lambda t: word_chars(t) < 2 * n_words(t)),
        Rule("long_words", lambda t: word_chars(t) > 15 * n_words(t)),
        Rule("dup_lines", lambda t: (n_dup_lines(t) > 2) & (100 * n_dup_lines(t) > 30 * n_lines(t))),
    ]


@dataclass(frozen=True)
class Measured:
    rule: Rule
    seconds: float
    share: float


def measure(docs: DataFrame, rules: Sequence[Rule], text_col: str = "text", rows: int = SAMPLE_ROWS) -> list[Measured]:
    """Cost and selectivity of each rule on about ``rows`` documents drawn from all of ``docs``, best first."""
    total = docs.count()
    if not total:
        return [Measured(r, 0.0, 0.0) for r in rules]
    sample = stored(docs.select(F.col(text_col).alias("text")).sample(fraction=min(1.0, rows / total), seed=7))
    found = []
    for rule in [Rule("nothing", lambda t: F.length(t) < 0), *rules]:
        began = time.perf_counter()
        share = sample.agg(F.avg(F.coalesce(rule.rejects(F.col("text")), F.lit(False)).cast("double"))).first()[0] or 0.0
        found.append(Measured(rule, time.perf_counter() - began, share))
    idle = found[0].seconds
    costs = [Measured(m.rule, max(1e-3, m.seconds - idle), m.share) for m in found[1:]]
    return sorted(costs, key=lambda m: (-(m.share + 1 / (rows + 1)) / m.seconds, m.rule.name))


def rejected_by(text: Column, order: Sequence[Measured]) -> Column:
    """The first rule of the cascade that rejects the text, null where none does; later rules are not evaluated."""
    out = F.lit(None).cast("string")
    for m in reversed(order):
        out = F.when(F.coalesce(m.rule.rejects(text), F.lit(False)), F.lit(m.rule.name)).otherwise(out)
    return out


def keep_good(docs: DataFrame, rules: Sequence[Rule] | None = None, text_col: str = "text") -> DataFrame:
    """The documents that no rule rejects, all columns as they are."""
    order = measure(docs, rules if rules is not None else base_rules() + more_rules(), text_col)
    return docs.filter(rejected_by(F.col(text_col), order).isNull())


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: the base figures, ``base_failed``, and ``kept`` (no base rule and no rule of the cascade rejects it)."""
    order = measure(docs, more_rules(), text_col)
    text = F.col("text")
    out = docs.select(F.col(id_col).alias("doc_id"), text if text_col == "text" else F.col(text_col).alias("text"))
    out = out.select(
        "doc_id", n_words(text).alias("n_words"), word_chars(text).alias("word_chars"), n_symbols(text).alias("n_symbols"),
        n_dup_lines(text).alias("n_dup_lines"), n_repeat_words(text).alias("n_repeat_words"), rejected_by(text, order).isNull().alias("passed"),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & F.col("passed")).drop("passed")
