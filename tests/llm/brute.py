"""Plain forms of the operators, for small inputs."""

import hashlib
import re
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def word_list(text):
    return WORD.findall(text or "")


def least_reachable(keys, linked):
    """Smallest key that each can reach over links."""
    up = {k: k for k in keys}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    return {k: find(k) for k in keys}


def simhash(text):
    w = word_list(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(x >> i & 1 for x in h) > len(h)) << i for i in range(64))


def classes(prints):
    """Component of each fingerprint, named by the smallest."""
    p = sorted(set(prints))
    return least_reachable(p, [(a, b) for i, a in enumerate(p) for b in p[i + 1 :] if (a ^ b).bit_count() <= 3])


def removed(rows):
    """(doc_id, n_words, n_removed, digest of the kept words) of (doc_id, text) rows."""
    first, lists = {}, [(i, word_list(t)) for i, t in rows]
    for i, w in lists:
        for k in range(len(w) - 12):
            if i is not None:
                first[tuple(w[k : k + 13])] = min(first.get(tuple(w[k : k + 13]), i), i)
    out = []
    for i, w in lists:
        gone = set()
        for k in range(len(w) - 12):
            if i is not None and first[tuple(w[k : k + 13])] < i:
                gone.update(range(k, k + 13))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def statistics(text):
    w, t = word_list(text), text or ""
    grams = list(zip(w, w[1:], w[2:]))
    twice = {g for g, n in Counter(grams).items() if n > 1}
    covered = {k + j for k, g in enumerate(grams) if g in twice for j in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed


def shingles(text):
    w = word_list(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def similar_classes(rows, num=4, den=5):
    """For each class under the Jaccard similarity of all pairs of five-word shingle sets: its smallest id, or None."""
    sets = {}
    for i, t in rows:
        sets.setdefault(shingles(t), []).append(i)
    nodes = list(sets)
    links = [(i, j) for i, a in enumerate(nodes) for j, b in enumerate(nodes[:i]) if a and b and den * len(a & b) >= num * len(a | b)]
    least = {}
    for k, root in least_reachable(range(len(nodes)), links).items():
        least.setdefault(root, []).extend(i for i in sets[nodes[k]] if i is not None)
    return sorted((min(x) if x else None for x in least.values()), key=lambda i: (i is None, i or 0))
