"""Plain versions of the operators, a text at a time."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def repeats(texts, window=35):
    """[(words, flags of the words that stay)]"""
    own = [words(t) for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in own for i in range(len(w) - window + 1))
    out = []
    for w in own:
        keep = [True] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                keep[i : i + window] = [False] * window
        out.append((w, keep))
    return out


def shingles(text):
    w = words((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def groups(rows):
    """Each row's group, an index of one of its rows, over rows of (doc_id, text)."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    return [top(i) for i in range(len(rows))]


def components(rows):
    """{index: smallest doc_id of its component} over rows of (doc_id, text); None where no row of it has an id."""
    of, low = groups(rows), defaultdict(list)
    for g, (d, _) in zip(of, rows):
        if d is not None:
            low[g].append(d)
    return {i: min(low[g], default=None) for i, g in enumerate(of)}


def quality(text):
    w = words(text)
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = set()
    for i in range(len(w) - 7):
        if seen[tuple(w[i : i + 8])] > 1:
            inside.update(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(w) < 20 or 100 * len(inside) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside), failed


def fill(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Targets by source, raising the level until no target is above its cap."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, capped = share * sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in capped]
        left = total - sum(capped.values())
        over = {s: most * sizes[s] for s in rest if left * w[s] / sum(w[x] for x in rest) > most * sizes[s]}
        if not over:
            return capped | {s: left * w[s] / sum(w[x] for x in rest) for s in rest}
        capped |= over


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
