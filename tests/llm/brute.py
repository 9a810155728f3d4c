"""Plain versions of the operators, to compare with."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def words(text):
    return WORD.findall(text or "")


def near_groups(docs, width, percent):
    """docs: {id: text}. {id: (set size, smallest id reachable)}"""
    sets = {}
    for i, t in docs.items():
        w = words((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    label = {i: i for i in docs}
    changed = True
    links = [(a, b) for a in docs for b in docs if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return {i: (len(sets[i]), label[i]) for i in docs}


def repeated_words(docs, width):
    """docs: {id: text}. {id: mask of words in windows that a smaller id has}"""
    first = {}
    for i in sorted(docs):
        w = words(docs[i])
        for k in range(len(w) - width + 1):
            first.setdefault(tuple(w[k : k + width]), i)
    out = {}
    for i, t in docs.items():
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        out[i] = gone
    return out


def without_words(text, gone):
    """The text without the ranges of words that are gone."""
    spans = [m.span() for m in WORD.finditer(text)]
    out, done, k = [], 0, 0
    while k < len(spans):
        if gone[k]:
            j = k
            while j + 1 < len(spans) and gone[j + 1]:
                j += 1
            out.append(text[done : spans[k][0]])
            done, k = spans[j][1], j
        k += 1
    return "".join(out) + text[done:]


def repeated_bytes(rows, width):
    """rows: [text]. [(bytes, removed, spans, kept digest)]"""
    raw = [(t or "").encode() for t in rows]
    seen = Counter(r[k : k + width] for r in raw for k in range(len(r) - width + 1))
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for k in range(len(r) - width + 1):
            if seen[r[k : k + width]] > 1:
                gone[k : k + width] = b"\1" * width
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def leaks(text, items, width):
    """(words, mask of hit words, items that occur)"""
    cut = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER)) if w]
    w, found = cut(text), set()
    hit = [False] * len(w)
    for name, item in items:
        x = cut(item)
        size = min(width, len(x))
        grams = {tuple(x[k : k + size]) for k in range(len(x) - size + 1)} if size else set()
        for k in range(len(w) - size + 1) if size else ():
            if tuple(w[k : k + size]) in grams:
                hit[k : k + size] = [True] * size
                found.add(str(name))
    return w, hit, found


def quality(text):
    """words, characters in words, symbols, repeated lines, repeated words, kept"""
    t = text or ""
    w = words(t)
    lines = [x for x in t.split("\n") if words(x)]
    at = defaultdict(list)
    for k in range(len(w) - 4):
        at[tuple(w[k : k + 5])].append(k)
    repeat = {k + j for ks in at.values() if len(ks) > 1 for k in ks for j in range(5)}
    chars, symbols, dup = sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines))
    bad = len(w) < 10 or 100 * len(repeat) > 20 * len(w)
    more = 10 * symbols > len(w) or chars < 2 * len(w) or chars > 15 * len(w) or (dup > 2 and 100 * dup > 30 * len(lines))
    return len(w), chars, symbols, dup, len(repeat), not (bad or more)
