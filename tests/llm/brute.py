"""Plain versions of the operators, for small tables."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {i: i + 32 for i in range(65, 91)}


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def substring_dedup(rows, size=20):
    """rows: (doc_id, text) with distinct ids; doc_id to (n_words, n_removed, digest of kept words)."""
    seen, out = {}, {}
    for doc, text in sorted(rows):
        words = WORD.findall(text or "")
        gone = set()
        for i in range(len(words) - size + 1):
            key = tuple(words[i : i + size])
            if key in seen:
                gone |= set(range(i, i + size))
            else:
                seen[key] = (doc, i)
        out[doc] = (len(words), len(gone), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))
    return out


def shingles(text):
    words = WORD.findall((text or "").translate(UPPER))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard_components(rows):
    """doc_id to (n_shingles, component)."""
    sets = {d: shingles(t) for d, t in rows}
    parent = {d: d for d in sets}

    def top(d):
        while parent[d] != d:
            d = parent[d]
        return d

    docs = sorted(sets)
    for i, a in enumerate(docs):
        for b in docs[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {d: (len(sets[d]), top(d)) for d in docs}


def decontamination(rows, items, size=10):
    """doc_id to (n_words, n_hit, n_items, digest, contaminated)."""
    windows = {}
    for item, text in items:
        words = TERM.findall((text or "").translate(UPPER))
        for i in range(max(1, len(words) - size + 1) if words else 0):
            windows.setdefault(tuple(words[i : i + size]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = {}
    for doc, text in rows:
        words = TERM.findall((text or "").translate(UPPER))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(words) - n + 1):
                if (key := tuple(words[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[key]
        names = sorted(str(x) for x in found if x is not None)
        out[doc] = (len(words), len(hit), len(names), sha(",".join(names)), bool(hit))
    return out
