"""Plain versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0d]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall(text or "")


def kept_words(rows, size=35):
    """(id, number of words, kept words) for each (id, text)."""
    each = [(i, words(t)) for i, t in rows]
    count = Counter(tuple(w[k : k + size]) for _, w in each for k in range(len(w) - size + 1))
    for i, w in each:
        gone = set()
        for k in range(len(w) - size + 1):
            if count[tuple(w[k : k + size])] > 1:
                gone.update(range(k, k + size))
        yield i, len(w), [x for k, x in enumerate(w) if k not in gone]


def substring_dedup(rows, size=35):
    return sorted((i, n, n - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()) for i, n, kept in kept_words(rows, size))


def shingle_set(text, size=4):
    w = words((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)])


def ngram_join(rows, share=85, of=100):
    """(id, size of the set, least id reachable, number of links) for each (id, text)."""
    sets, holders = [shingle_set(t) for _, t in rows], defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    root, n_links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        common = Counter(j for x in s for j in holders[x] if j != i)
        for j, o in common.items():
            if of * o >= share * (len(s) + len(sets[j]) - o):
                n_links[i] += 1
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((rows[i][0], len(sets[i]), least[find(i)], n_links[i]) for i in range(len(rows)))


def plain_words(text):
    return [w for w in re.split(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOWER)) if w]


def shingle_counts(w):
    k = min(5, len(w))
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def contaminated(rows, items, least=0.8):
    """id: {item: best similarity} for each (id, text)."""
    items = [(i, plain_words(t)) for i, t in items]
    items = [(i, w, shingle_counts(w)) for i, w in items if w]
    out = {}
    for d, t in rows:
        w, hits = plain_words(t), {}
        for i, own, counts in items:
            n, k = len(own), min(5, len(own))
            for s in range(max(1, len(w) - n + 1)):
                x = w[s : s + n]
                if len(x) < k or not any(tuple(x[j : j + k]) in counts for j in range(len(x) - k + 1)):
                    continue
                here = Counter(tuple(x[j : j + k]) for j in range(len(x) - k + 1))
                similarity = sum((here & counts).values()) / sum((here | counts).values())
                if similarity >= least - 1e-12:
                    hits[i] = max(hits.get(i, 0), similarity)
        out[d] = hits
    return out
