"""Plain versions of the operators, for comparison on small tables."""

import hashlib
import re

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def lettered(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def near_duplicates(rows, percent=85):
    """doc_id -> (set size, component)."""
    sets = {}
    for i, text in rows:
        w = spaced(text)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def contamination(rows, items):
    """doc_id -> (words, hit words, items, digest of items, contaminated)."""
    windows = {}
    for item, text in items:
        w = lettered(text)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(item))
    out = {}
    for i, text in rows:
        w, hit, found = lettered(text), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


def repeats(rows, length=50):
    """doc_id -> (bytes, removed, runs, digest of what is left)."""
    seen, out = {}, {}
    for i, text in sorted(rows):
        t = (text or "").encode()
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if seen.setdefault(t[k : k + length], i) < i:
                gone[k : k + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        runs = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out
