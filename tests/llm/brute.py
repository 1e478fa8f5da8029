"""Plain versions of the operators, row by row."""

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall(text or "")


def shingles(text, width=5):
    w = words((text or "").translate(LOWER))
    if len(w) >= width:
        return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}
    return {tuple(w)} if w else set()


def components(items, linked):
    """Smallest key reachable, for {key: set}."""
    up = {k: k for k in items}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    keys = sorted(items)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if linked(items[a], items[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {k: root(k) for k in items}


def near(a, b, percent=85):
    both = len(a & b)
    return bool(a) and bool(b) and 100 * both >= percent * (len(a) + len(b) - both)


def kept_words(rows, window=13):
    """{row position: kept words} when windows that start in a smaller id go."""
    first = {}
    for i, t in rows:
        if i is not None:
            w = words(t)
            for k in range(len(w) - window + 1):
                g = tuple(w[k : k + window])
                first[g] = min(first.get(g, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        keep = [True] * len(w)
        if i is not None:
            for k in range(len(w) - window + 1):
                if first[tuple(w[k : k + window])] < i:
                    keep[k : k + window] = [False] * window
        out.append([x for x, y in zip(w, keep) if y])
    return out


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    t = text or ""
    w = words(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    cover = {p for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover)
