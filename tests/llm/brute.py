"""Plain versions of the operators, for small tables."""

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def repeated_windows(docs, window=35):
    """doc_id -> (words, removed words, SHA-256 of the rest)."""
    words = {d: WORD.findall(t or "") for d, t in docs}
    seen = collections.Counter(tuple(w[i : i + window]) for w in words.values() for i in range(len(w) - window + 1))
    out = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        out[d] = (len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())
    return out


def shingles(text, k=3):
    w = WORD.findall(lower(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def linked(docs, num=85, den=100):
    """doc_id -> (shingles, least doc_id reachable)."""
    sets = {d: shingles(t) for d, t in docs}
    top = {d: d for d in sets}

    def root(d):
        while top[d] != d:
            d = top[d]
        return d

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and den * both >= num * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                top[y] = x
    return {d: (len(s), root(d)) for d, s in sets.items()}


def leaks(docs, items, t=0.8, k=5):
    """(doc_id, item_id) -> similarity of the best window of the item's number of words."""
    split = lambda x: re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", lower(x))
    out = {}
    for i, text in items:
        item = split(text)
        if not item:
            continue
        size = min(k, len(item))
        grams = lambda w, size=size: collections.Counter(tuple(w[j : j + size]) for j in range(len(w) - size + 1))
        want = grams(item)
        for d, doc in docs:
            w = split(doc)
            for a in range(max(1, len(w) - len(item) + 1)):
                has = grams(w[a : a + len(item)])
                whole = sum((want | has).values())
                share = sum((want & has).values()) / whole if whole else 0
                if share >= t and share > out.get((d, i), 0):
                    out[d, i] = share
    return out
