"""Near copies in plain Python: fingerprints bit by bit, clusters by links of 3 bits, every pair of a cluster compared."""

import re
from collections import defaultdict

import xxhash

FULL = (1 << 64) - 1


def mixed(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & FULL
    x = (x ^ x >> 27) * 0x94D049BB133111EB & FULL
    return x ^ x >> 31


def majority(h):
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def shingles(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])


def brute_prints(text, bands=8, rows=4):
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles(text)]
    if not h:
        return (0,) * (1 + bands)
    factors = [mixed(k * 0x9E3779B97F4A7C15 & FULL) | 1 for k in range(1, bands * rows + 1)]
    least = [mixed(min(x * f & FULL for x in h)) for f in factors]
    return (majority(h), *(majority(least[b * rows : b * rows + rows]) for b in range(bands)))


class Sets:
    def __init__(self, items):
        self.root = {i: i for i in items}

    def top(self, i):
        while self.root[i] != i:
            i = self.root[i]
        return i

    def join(self, a, b):
        self.root[self.top(a)] = self.top(b)


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute_near(rows, bands=8):
    """rows (id, text) that stay, one of each group."""
    prints = {t: brute_prints(t, bands) for _, t in rows}
    sets = {t: set(shingles(t)) for t in prints}
    groups = Sets(prints)
    for k in range(1 + bands):
        values = sorted({p[k] for p in prints.values()})
        clusters = Sets(values)
        for i, x in enumerate(values):
            for y in values[:i]:
                if (x ^ y).bit_count() <= 3:
                    clusters.join(x, y)
        of = defaultdict(list)
        for t, p in prints.items():
            of[clusters.top(p[k])].append(t)
        for texts in of.values():
            for i, a in enumerate(texts):
                for b in texts[:i]:
                    if similarity(sets[a], sets[b]) >= 0.8 - 1e-9:
                        groups.join(a, b)
    best = {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        best.setdefault(groups.top(t), (i, t))
    return list(best.values())
