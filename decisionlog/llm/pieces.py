"""N-best SentencePiece segmentation and decoding.

The lattice of a text has an edge for every vocabulary piece that stands in it, scored as in the model file. A forward Viterbi pass gives
each place its best score from the left; these are exact estimates for an A* search that walks backward from the end, so complete paths
come out in order of their score.

No piece reaches over the begin of a word (``_``, the piece mark, after another character), so the lattice is a chain of word lattices.
Each distinct word gets one forward pass, kept in a cache of bounded bytes, with the score its second-best path loses. A path among the n best can
only leave the best one at the n-1 words that lose least, so the A* search of a text runs over those words' lattices alone and is exact.

Text the vocabulary lacks becomes byte pieces, or the unknown piece where the model has none; such a step costs as much as the worst piece
and 10 more. Ties in score come in an order that the text fixes. A null text is like an empty one: no pieces, score 0, no alternatives.
Decoding gives the text back unless it holds the piece mark itself.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decisionlog.llm.textscan import sliced

BEST = 4
CACHE_BYTES, TEXT_BYTES = 64 << 20, 2 << 20
MARK = "▁"
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_WORD = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")


@dataclass(frozen=True)
class Vocabulary:
    """What tasks need of a model: plain data, as large as the vocabulary and no larger."""

    ids: dict[str, int]
    scores: list[float]
    text: list[bytes]
    bytes_: list[int]  # ids of the 256 byte pieces, empty where there are none
    unknown: int
    worst: float
    longest: int
    splits: bool


def load_vocabulary(path: str = DEFAULT_MODEL) -> Vocabulary:
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    names = [model.id_to_piece(i) for i in range(size)]
    usual = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    scores = [model.get_score(i) for i in range(size)]
    known = set(usual)
    text = [names[i].replace(MARK, " ").encode() if i in known else bytes([int(names[i][3:5], 16)]) if model.is_byte(i) else b"" for i in range(size)]
    bytes_ = sorted((i for i in range(size) if model.is_byte(i)), key=lambda i: names[i])
    worst = min(scores[i] for i in usual if scores[i] > -1e8)
    scores = [max(x, worst - 1) for x in scores]  # runs of marks and the like have a nominal score
    usable = usual
    splits = not any(re.search(f"[^{MARK}]{MARK}|\n.|.\n", names[i]) for i in usable)
    return Vocabulary(
        {names[i]: i for i in usable}, scores, text, bytes_ if len(bytes_) == 256 else [], model.unk_id(), worst, max(len(names[i]) for i in usable), splits
    )


def _edges(text: str, v: Vocabulary) -> list[list[tuple[int, float, int]]]:
    """For every end place the edges (begin, score, piece id or -1 for a character that is no piece)."""
    n, out = len(text), [[] for _ in range(len(text) + 1)]
    ids, scores = v.ids, v.scores
    for a in range(n):
        single = False
        for b in range(a + 1, min(n, a + v.longest) + 1):
            piece = ids.get(text[a:b])
            if piece is not None:
                out[b].append((a, scores[piece], piece))
                single |= b == a + 1
        if not single:
            out[a + 1].append((a, v.worst - 10, -1))
    return out


def _spell(text: str, a: int, b: int, piece: int, v: Vocabulary) -> list[int]:
    if piece >= 0:
        return [piece]
    return [v.bytes_[x] for x in text[a:b].encode()] if v.bytes_ else [v.unknown]


def forward(text: str, v: Vocabulary) -> tuple[list[float], list[float], list[tuple[int, int]]]:
    """Best and second-best score from the left at every place, and the best edge into it (begin, piece)."""
    low = float("-inf")
    n = len(text)
    best, second, edge = [0.0] + [low] * n, [low] * (n + 1), [(0, -1)] * (n + 1)
    ids, scores, longest, rare = v.ids, v.scores, v.longest, v.worst - 10
    get = ids.get
    for a in range(n):
        here, next_ = best[a], second[a]
        single = False
        for b in range(a + 1, min(n, a + longest) + 1):
            piece = get(text[a:b])
            if piece is None:
                if b > a + 1 or single:
                    continue
            if b == a + 1:
                single = piece is not None
                score = scores[piece] if single else rare
                piece = piece if single else -1
            else:
                score = scores[piece]
            total = here + score
            if total > best[b]:
                second[b] = max(best[b], next_ + score)
                best[b], edge[b] = total, (a, piece)
            elif total > second[b]:
                second[b] = total
    return best, second, edge


def best_path(text: str, v: Vocabulary) -> tuple[list[int], float, float]:
    """The best ids of a word, their score, and what the second-best path loses."""
    best, second, edge = forward(text, v)
    at, found = len(text), []
    while at:
        a, piece = edge[at]
        found.append(_spell(text, a, at, piece, v))
        at = a
    return list(chain.from_iterable(reversed(found))), best[-1], best[-1] - second[-1]


def backward(words: Sequence[str], lattice: Callable, v: Vocabulary, n: int) -> list[tuple[float, list[list[int]]]]:
    """The n best paths through a chain of word lattices: score, and the ids of each word. A* from the end.

    ``lattice`` gives a word's edges and its best scores from the left, which are exact estimates.
    """
    held = [lattice(w) for w in words]
    lattices = [edges for edges, _ in held]
    estimates, sum_ = [], 0.0
    for _, best in held:
        estimates.append([sum_ + x for x in best])
        sum_ += best[-1]
    if not words:
        return [(0.0, [])]
    # a state: minus the score of the best complete path through it, tie, word, place, score behind, path behind
    heap, tie, out = [(-sum_, 0, len(words) - 1, len(words[-1]), 0.0, None)], 0, []
    while heap and len(out) < n:
        _, _, k, at, behind, path = heapq.heappop(heap)
        while at == 0 and k > 0:
            k -= 1
            at = len(words[k])
        if at == 0:
            ids: list[list[int]] = [[] for _ in words]
            while path is not None:
                (w, a, b, piece), path = path
                ids[w] += _spell(words[w], a, b, piece, v)
            out.append((behind, ids))
            continue
        for a, score, piece in lattices[k][at]:
            tie += 1
            heapq.heappush(heap, (-(estimates[k][a] + score + behind), tie, k, a, behind + score, ((k, a, at, piece), path)))
    return out


OUT = "ids array<int>, score double, alternatives array<struct<score:double,edits:array<struct<at:int,drop:int,ids:array<int>>>>>, lossless boolean"
_EDITS = pa.list_(pa.struct([("at", pa.int32()), ("drop", pa.int32()), ("ids", pa.list_(pa.int32()))]))
_ALTERNATIVES = pa.list_(pa.struct([("score", pa.float64()), ("edits", _EDITS)]))


def words_of(text: str, v: Vocabulary) -> list[str]:
    """The text with piece marks, cut where no piece reaches over."""
    if not text:
        return []
    marked = MARK + text.replace(" ", MARK)
    return _WORD.findall(marked) if v.splits else [marked]


class _Table:
    """Hashes of the pieces and of their beginnings in two open tables, so that a look-up is one or two gathers."""

    def __init__(self, v: Vocabulary):
        self.ratio = np.uint64(0x9E3779B97F4A7C15)
        self.scores = np.array(v.scores)
        self.keys, self.ids = [np.zeros(1 << b, np.uint64) for b in (18, 20)], [np.full(1 << b, -1, np.int32) for b in (18, 20)]
        known: dict[int, int] = {}
        for name, piece in v.ids.items():
            h = 0
            for c in name:
                h = (h * int(self.ratio) + ord(c) + 1) % (1 << 64)  # the same hash as in ``best_paths``
                known.setdefault(h, -2)
            known[h] = piece
        keys, ids = np.array(list(known), np.uint64), np.array(list(known.values()), np.int32)
        for t in (0, 1):
            slot = self._slot(keys, t)
            _, first = np.unique(slot, return_index=True)
            self.keys[t][slot[first]], self.ids[t][slot[first]] = keys[first], ids[first]
            keys, ids = np.delete(keys, first), np.delete(ids, first)
        self.rest = {int(k): int(i) for k, i in zip(keys, ids, strict=True)}

    @staticmethod
    def _slot(key, t: int):
        return (key * np.uint64((0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)[t])) >> np.uint64((46, 44)[t])

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece ids, -2 for the beginning of one, -1 for neither."""
        slot = self._slot(hashes, 0)
        ids = np.where(self.keys[0][slot] == hashes, self.ids[0][slot], -1)
        rest = np.flatnonzero(ids == -1)
        slot = self._slot(hashes[rest], 1)
        ids[rest] = np.where(self.keys[1][slot] == hashes[rest], self.ids[1][slot], -1)
        for key, piece in self.rest.items():
            ids[hashes == np.uint64(key)] = piece
        return ids


def best_paths(words: list[str], v: Vocabulary, table: _Table) -> list[tuple[bytes, float, float] | None]:
    """``best_path`` of words of one length at once (ids as bytes); None where a character is no piece."""
    n, size = len(words), len(words[0])
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, size).astype(np.uint64) + np.uint64(1)
    low = float("-inf")
    best, second = np.full((size + 1, n), low), np.full((size + 1, n), low)
    begin, piece = np.zeros((size + 1, n), np.int32), np.full((size + 1, n), -1, np.int32)
    best[0] = 0
    for a in range(size):
        rows, hashes = np.arange(n), np.zeros(n, np.uint64)
        for b in range(a + 1, min(size, a + v.longest) + 1):
            hashes = hashes * table.ratio + codes[rows, b - 1]
            ids = table.find(hashes)
            if b == a + 1:  # any character is a step
                on, piece_ids, score = rows, np.maximum(ids, -1), np.where(ids >= 0, table.scores[ids], v.worst - 10)
            else:
                there = ids >= 0
                on, piece_ids = rows[there], ids[there]
                score = table.scores[piece_ids]
            old, total, next_ = best[b, on], best[a, on] + score, second[a, on] + score
            better = total > old
            second[b, on] = np.maximum(np.where(better, np.maximum(old, next_), total), second[b, on])
            win = on[better]
            best[b, win], begin[b, win], piece[b, win] = total[better], a, piece_ids[better]
            going = ids != -1
            rows, hashes = rows[going], hashes[going]
            if not len(rows):
                break
    at, every, steps = np.full(n, size), np.arange(n), []
    while at.any():
        steps.append(np.where(at > 0, piece[at, every], -2))
        at = np.where(at > 0, begin[at, every], 0)
    path = np.stack(steps[::-1], 1)
    used = path > -2
    raw, cuts = path[used].astype(np.int32).tobytes(), (4 * np.r_[0, np.cumsum(used.sum(1))]).tolist()
    rare = (path == -1).any(1).tolist()
    scores, losses = best[size].tolist(), (best[size] - second[size]).tolist()
    return [None if rare[k] else (raw[cuts[k] : cuts[k + 1]], scores[k], losses[k]) for k in range(n)]


#: words beyond it are worked on one by one and not kept beyond their texts
LONG_WORD = 40
#: bytes of a cache entry besides its word and its pieces
_ENTRY_BYTES = 330


class _Encoder:
    def __init__(self, v: Vocabulary, n: int):
        self.v, self.n, self.cache, self.table, self.lattices = v, n, {}, _Table(v), {}
        self.bytes, self.lattice_bytes, self.long = 0, 0, []

    def _lattice(self, word: str) -> tuple[list, list[float]]:
        got = self.lattices.get(word)
        if got is None:
            got = _edges(word, self.v), forward(word, self.v)[0]
            if len(word) <= LONG_WORD:
                size = 500 + 100 * sum(map(len, got[0]))
                if self.lattice_bytes + size > CACHE_BYTES // 2:
                    self.lattices.clear()
                    self.lattice_bytes = 0
                self.lattices[word] = got
                self.lattice_bytes += size
        return got

    def learn(self, words: set[str]) -> None:
        """Put the best paths of words into the cache: words of one length together, very long ones alone and only for now."""
        by_size: dict[int, list[str]] = {}
        for w in words:
            by_size.setdefault(len(w), []).append(w)
        for size, all_ in by_size.items():
            for at in range(0, len(all_), 20_000):
                some = all_[at : at + 20_000]
                found = best_paths(some, self.v, self.table) if size <= LONG_WORD else [None] * len(some)
                for w, got in zip(some, found, strict=True):
                    if got is None:
                        ids, score, loss = best_path(w, self.v)
                        got = np.array(ids, np.int32).tobytes(), score, loss
                    self.cache[w] = got
                    if size <= LONG_WORD:
                        self.bytes += _ENTRY_BYTES + 2 * len(w) + len(got[0])
                    else:
                        self.long.append(w)

    def encode_all(self, texts: list[str | None]) -> list[tuple[bytes, float, list[dict], bool]]:
        """Per text: best ids, their score, the next paths as edits of the best, and whether decoding gives the text back."""
        words = [words_of(t or "", self.v) for t in texts]
        if self.bytes > CACHE_BYTES:
            self.cache.clear()
            self.bytes = 0
        self.learn(set(chain.from_iterable(words)) - self.cache.keys())
        out = [self._encode(t or "", w) for t, w in zip(texts, words, strict=True)]
        for w in self.long:
            del self.cache[w]
        self.long.clear()
        return out

    def _encode(self, text: str, words: list[str]) -> tuple[bytes, float, list[dict], bool]:
        if not words:
            return b"", 0.0, [], True
        raws, scores, losses = zip(*map(self.cache.__getitem__, words), strict=True)
        raw, score, losses = b"".join(raws), sum(scores), np.array(losses)
        few = min(self.n - 1, len(words))
        at = np.sort(_smallest(losses, few)).tolist() if few else []
        alternatives = []
        for part, path in backward([words[k] for k in at], self._lattice, self.v, self.n)[1:]:
            edits = []
            for k, ids in zip(at, path, strict=True):
                if np.array(ids, np.int32).tobytes() != raws[k]:
                    edits.append({"at": sum(map(len, raws[:k])) // 4, "drop": len(raws[k]) // 4, "ids": ids})
            alternatives.append({"score": score - sum(scores[k] for k in at) + part, "edits": edits})
        return raw, score, alternatives, decode_ids(np.frombuffer(raw, np.int32).tolist(), self.v) == text


def _smallest(x: np.ndarray, n: int) -> np.ndarray:
    """Places of the n smallest, of equal ones the first."""
    bound = np.partition(x, n - 1)[n - 1]
    near = np.flatnonzero(x <= bound)
    return near[np.argsort(x[near], kind="stable")[:n]]


def decode_ids(ids: list[int], v: Vocabulary) -> str:
    return b"".join([v.text[i] for i in ids])[1:].decode(errors="replace") if ids else ""


def apply_edits(ids: list[int], edits: list) -> list[int]:
    """An alternative's ids, from the best ids and its edits."""
    out, done = [], 0
    for e in edits:
        out += [*ids[done : e["at"]], *e["ids"]]
        done = e["at"] + e["drop"]
    return out + ids[done:]


def _held(df: DataFrame, model: str) -> Broadcast:
    return df.sparkSession.sparkContext.broadcast(tuple(vars(load_vocabulary(model)).values()))


def encode(df: DataFrame, text_col: str = "text", model: str = DEFAULT_MODEL, n: int = BEST) -> DataFrame:
    """``df`` with ids, score, alternatives (the next n-1 paths) and lossless; columns of these names are replaced, the text goes."""
    held = _held(df, model)
    new = ["ids", "score", "alternatives", "lossless"]
    rest = [c for c in df.columns if c != text_col and c.lower() not in new]
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest), OUT])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _Encoder(Vocabulary(*held.value), n)
        for whole in batches:
            for batch in sliced(whole, 0, TEXT_BYTES):
                found = encoder.encode_all(batch.column(0).to_pylist())
                offsets = np.cumsum([0, *(len(f[0]) // 4 for f in found)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join([f[0] for f in found]), np.int32)))
                columns = [ids, pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], _ALTERNATIVES), pa.array([f[3] for f in found], pa.bool_())]
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], *columns], [*rest, *new])

    return df.select(F.col(text_col), *rest).mapInArrow(run, schema)


def decode(df: DataFrame, ids_col: str = "ids", model: str = DEFAULT_MODEL, name: str = "decoded") -> DataFrame:
    """``df`` with the text of its ids in a column ``name``; null ids give a null."""
    held = _held(df, model)
    rest = [c for c in df.columns if c.lower() != name.lower()]
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest), f"`{name}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(*held.value)
        at = rest.index(ids_col)
        for whole in batches:
            for k in range(0, len(whole), 500):
                batch = whole.slice(k, 500)
                texts = [None if ids is None else decode_ids(ids, v) for ids in batch.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*rest, name])

    return df.select(*rest).mapInArrow(run, schema)
