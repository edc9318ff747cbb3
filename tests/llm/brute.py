"""Plain restatements of what the text operators should return."""

import hashlib
import re
from collections import Counter

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words(text):
    return WORD.findall((text or "").encode().translate(LOWER))


def removals(texts, length):
    """(n_bytes, n_removed, n_spans, kept_sha256) of each text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(hash(d[i : i + length]) for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[hash(d[i : i + length])] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(d, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def contamination(texts, items, width=10):
    """(n_words, n_hit, n_items, items_sha256) of each text; items are (id, text)."""
    windows = {}
    for item, text in items:
        w = words(text)
        for k in range(max(len(w) - width + 1, min(len(w), 1))):
            windows.setdefault(tuple(w[k : k + width]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for text in texts:
        w = words(text)
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (ids := windows.get(tuple(w[k : k + n]))) is not None:
                    found |= ids
                    hit |= set(range(k, k + n))
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()))
    return out


def shingles(text, run=5):
    w = words(text)
    return {tuple(w[k : k + run]) for k in range(len(w) - run + 1)} if len(w) >= run else ({tuple(w)} if w else set())


def near_classes(ids, texts, least=0.8):
    """Class of each text: the lowest id among texts that chains of copies and near copies lead to."""
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    by_word = {}
    for i, s in enumerate(sets):
        for x in s:
            by_word.setdefault(x, []).append(i)
    by_text = {}
    for i, t in enumerate(texts):
        parent[root(i)] = root(by_text.setdefault(t or "", i))
    pairs = Counter()
    for group in by_word.values():
        for k, a in enumerate(group):
            for b in group[k + 1 :]:
                pairs[a, b] += 1
    for (a, b), n in pairs.items():
        if n >= least * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
            parent[root(a)] = root(b)
    lowest = {}
    for i, d in enumerate(ids):
        lowest[root(i)] = min(lowest.get(root(i), d), d)
    return [lowest[root(i)] for i in range(len(texts))]
