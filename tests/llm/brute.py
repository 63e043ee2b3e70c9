"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import re
from itertools import combinations

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(text):
    return (text or "").translate(FOLD)


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", fold(text))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1)))


def near_groups(rows, n, percent):
    """{doc_id: (number of shingles, smallest linked doc_id)} of (doc_id, text) rows."""
    sets = {d: shingles(t, n) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    holders = {}
    for d, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(d)
    pairs = {p for ds in holders.values() for p in combinations(sorted(ds), 2)}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}
