"""Slow and plain versions of the operators."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return WORD.findall(text or "")


def counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    w, text = words(text), text or ""
    triples = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    seen = Counter(triples)
    covered = {k + i for k, t in enumerate(triples) if seen[t] > 1 for i in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def without_repeats(rows):
    """For each row: words, removed words, digest of the kept ones."""
    first = {}
    order = lambda key, start: (key is not None, key or 0, start)
    texts = [words(t) for _, t in rows]
    for (key, _), w in zip(rows, texts):
        for p in range(len(w) - 19):
            window = tuple(w[p : p + 20])
            first[window] = min(first.get(window, order(key, p)), order(key, p))
    out = []
    for (key, _), w in zip(rows, texts):
        gone = set()
        for p in range(len(w) - 19):
            if first[tuple(w[p : p + 20])] < order(key, p):
                gone.update(range(p, p + 20))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((key, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def shingles(text):
    w = words((text or "").translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def classes(rows):
    """For each row: shingles, smallest key of its class; and the class numbers."""
    sets = [shingles(t) for _, t in rows]
    where = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        both = Counter(j for x in s for j in where[x] if j > i)
        for j, n in both.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                parent[max(top(i), top(j))] = min(top(i), top(j))
    groups = [top(i) for i in range(len(rows))]
    least = {}
    for (key, _), g in zip(rows, groups):
        if key is not None:
            least[g] = min(least.get(g, key), key)
    return [(key, len(s), least.get(g)) for (key, _), s, g in zip(rows, sets, groups)], groups


def copies(rows):
    groups = defaultdict(list)
    for i, (_, t) in enumerate(rows):
        groups[(t or "").translate(LOWER)].append(i)
    out = [None] * len(rows)
    for text, members in groups.items():
        largest = max((rows[i][0] for i in members if rows[i][0] is not None), default=None)
        for i in members:
            out[i] = (rows[i][0], largest, len(members), hashlib.sha256(text.encode()).hexdigest())
    return out
