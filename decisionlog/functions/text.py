"""Choice and reply text, ratios, short forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that make a reply a yes, a no, or "none of them".
YES_WORDS = ("YES", "OK", "OKAY", "CONFIRM", "SURE", "YEAH", "YEP")
NO_WORDS = ("NO", "NOPE", "NAH")
NONE_WORDS = ("NONE OF THEM", "NONE OF THE ABOVE", "NONE")

_DIGITS = r"^\p{Nd}+\z"


def strip(text: Column) -> Column:
    """Trim any white space at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def is_digits(text: Column) -> Column:
    return text.rlike(_DIGITS)


def choice_number(choice: Column) -> Column:
    """The number in front of ``)``, or null."""
    head = strip(F.get(F.split(choice, r"\)", 2), F.lit(0)))
    return F.when(is_digits(head), head.try_cast("int"))


def choice_label(choice: Column) -> Column:
    """The text behind the first ``)``, or the whole text."""
    parts = F.split(choice, r"\)", 2)
    return strip(F.coalesce(F.get(parts, F.lit(1)), F.get(parts, F.lit(0))))


def resolve_reply(reply: Column, choices: Column) -> Column:
    """The label a numeric reply points at (null when it is no number or no choice has it)."""
    number = strip(reply)
    hit = F.filter(choices, lambda c: choice_number(c) == number.try_cast("int"))
    return F.when(is_digits(number), choice_label(F.get(hit, F.lit(0))))


def plain_choice(choice: Column) -> Column:
    """Upper case, without a leading ``1)``, ``1.``, ``1:`` or ``1-``."""
    bare = F.regexp_replace(F.coalesce(choice, F.lit("")), r"^\s*\p{Nd}+\s*[\)\.:\-]\s*", "")
    return F.upper(strip(bare))


def _has_word(plain: Column, words) -> Column:
    found = F.regexp_extract_all(plain, F.lit("([A-Z]+)"), F.lit(1))
    return F.arrays_overlap(found, F.array(*[F.lit(w) for w in words]))


def is_yes(plain: Column) -> Column:
    return _has_word(plain, YES_WORDS) & ~_has_word(plain, NO_WORDS)


def is_no(plain: Column) -> Column:
    return _has_word(plain, NO_WORDS) & ~_has_word(plain, YES_WORDS)


def is_none_of_them(plain: Column) -> Column:
    hit = F.lit(False)
    for words in NONE_WORDS:
        hit = hit | F.contains(plain, F.lit(words))
    return hit


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole``, 0.0 when ``whole`` is zero or null."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(F.lit(0.0))


def percent(share: Column, missing: str = "--") -> Column:
    """A share as text with one decimal."""
    return F.when(share.isNull() | F.isnan(share), F.lit(missing)).otherwise(F.format_string("%.1f", share * 100))


def short(text: Column, length: int) -> Column:
    """One line of at most ``length`` characters, ending in an ellipsis when cut."""
    line = strip(F.regexp_replace(text, r"\s+", " "))
    if length <= 0:
        return line
    return F.when(F.length(line) <= length, line).otherwise(F.concat(F.substring(line, 1, length - 1), F.lit("…")))
