"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter

import xxhash

LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def kept_words(texts, window=35):
    """Of each text all words, and those that no recurring window covers."""
    every = [words(t) for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in every for i in range(len(w) - window + 1))
    out = []
    for w in every:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((w, [x for k, x in enumerate(w) if k not in gone]))
    return out


def fingerprint(text):
    w = [x.translate(LOWER) for x in words(text)]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(prints, radius=3):
    """For each place the places that links reach."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def components(rows):
    """(id, fingerprint, least id of the component) of (id, text)."""
    prints = [fingerprint(t) for _, t in rows]
    group = groups(prints)
    least = {}
    for (i, _), g in zip(rows, group, strict=True):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    return [(i, f"{p:016x}", least.get(g)) for (i, _), p, g in zip(rows, prints, group, strict=True)]


def item_words(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().translate(LOWER))


def decontaminated(rows, items):
    """doc_id, n_words, n_hit, items found, contaminated."""
    patterns = {}
    for item, text in items:
        w = item_words(text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            patterns.setdefault(tuple(w[i : i + n]), set()).add(item)
    lengths, out = {len(p) for p in patterns}, []
    for doc, text in rows:
        w, hit, found = item_words(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (p := tuple(w[i : i + n])) in patterns:
                    hit.update(range(i, i + n))
                    found |= patterns[p]
        out.append((doc, len(w), len(hit), found, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out
