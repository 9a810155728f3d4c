"""Recompression of word sequences: runs and pairs of symbols get names, round by round, the same wherever the words are the same.

A name is a hash of what it stands for, so every task gives equal pairs equal names without asking another. A round names a run of equal
symbols, or a pair whose left symbol is in the round's left half of the alphabet and whose right one is in the right half; the halves are
a bit of the name, so pairs never overlap and depend on nothing outside them. Each symbol carries its context: the range of words that
fixes it. Wherever the words of that range stand again, the same symbol stands again.
"""

from __future__ import annotations

import numpy as np

from decisionlog.llm.textscan import Words, mix

_U = np.uint64


class Symbols:
    """Symbols of several rows: name, row, words [first, last) that it covers, context [low, high)."""

    def __init__(self, name, row, first, last, low, high):
        self.name, self.row, self.first, self.last, self.low, self.high = name, row, first, last, low, high

    def _pick(self, at: np.ndarray, name: np.ndarray, last: np.ndarray, low: np.ndarray, high: np.ndarray) -> Symbols:
        return Symbols(name, self.row[at], self.first[at], last, low, high)


def runs_of_words(words: Words, hashes: np.ndarray) -> Symbols:
    """The first round: maximal runs of one word. Their context takes in the words before and after, at a row's edge beyond it."""
    n = words.high - words.low
    row = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(words.low, n)
    name = hashes[at]
    new = np.ones(len(at), bool)
    new[1:] = (name[1:] != name[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(new)
    size = np.diff(np.r_[begin, len(at)])
    first = at[begin]
    named = np.where(size > 1, mix(name[begin] + size.astype(_U) * _U(0x9E3779B97F4A7C15)), name[begin])
    return Symbols(named, row[begin], first, first + size, first - 1, first + size + 1)


def pair_round(s: Symbols, level: int) -> Symbols:
    """The next round. A symbol that stays alone needs the neighbour that might have paired with it in its context."""
    n = len(s.name)
    if not n:
        return s
    left = (mix(s.name + _U(level)) >> _U(63)).astype(bool)
    pair = np.zeros(n, bool)
    pair[:-1] = left[:-1] & ~left[1:] & (s.row[1:] == s.row[:-1])
    second = np.zeros(n, bool)
    second[1:] = pair[:-1]
    after, before = np.minimum(np.arange(n) + 1, n - 1), np.maximum(np.arange(n) - 1, 0)
    same_after, same_before = (s.row[after] == s.row) & (after > np.arange(n)), (s.row[before] == s.row) & (before < np.arange(n))
    high = np.where(pair, s.high[after], np.where(left, np.where(same_after, np.maximum(s.high, s.high[after]), s.high + 1), s.high))
    low = np.where(~pair & ~left, np.where(same_before, np.minimum(s.low, s.low[before]), s.low - 1), s.low)
    high, low = np.maximum(high, s.high), np.where(pair, np.minimum(low, s.low[after]), low)
    name = np.where(pair, mix(s.name * _U(3) + mix(s.name[after] + _U(1)) + _U(level)), s.name)
    last = np.where(pair, s.last[after], s.last)
    at = np.flatnonzero(~second)
    return s._pick(at, name[at], last[at], low[at], high[at])


def recompressed(words: Words, hashes: np.ndarray, rounds: int) -> Symbols:
    """The symbols after the round of runs and ``rounds`` rounds of pairs."""
    s = runs_of_words(words, hashes)
    for level in range(1, rounds + 1):
        s = pair_round(s, level)
    return s
