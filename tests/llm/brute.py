"""Plain versions of the contracts, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def decontaminate(docs, items, window=10):
    windows = defaultdict(set)
    for item, text in items:
        w = ALNUM.findall(lower(text))
        for k in range(max(1, len(w) - window + 1) if w else 0):
            windows[tuple(w[k : k + window])].add(item)
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w = ALNUM.findall(lower(text))
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (key := tuple(w[k : k + n])) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[key]
        out.append((doc, len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit)))
    return out


def substring_dedup(docs, window=50):
    rows = [(doc, SPACED.findall(text or "")) for doc, text in docs]
    first = {}
    for doc, w in rows:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, w in rows:
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < doc:
                gone.update(range(k, k + window))
        out.append((doc, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def suffix_dedup(docs, size=200):
    count = defaultdict(int)
    rows = [(doc, (text or "").encode()) for doc, text in docs]
    for _, b in rows:
        for k in range(len(b) - size + 1):
            count[b[k : k + size]] += 1
    out = []
    for doc, b in rows:
        gone = [False] * len(b)
        end = 0
        for k in range(len(b) - size + 1):
            if count[b[k : k + size]] > 1:
                for i in range(max(end, k), k + size):
                    gone[i] = True
                end = k + size
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


def shingle_components(docs, size=5, percent=75):
    sets = {}
    for doc, text in docs:
        w = SPACED.findall(lower(text))
        sets[doc] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    root = {d: d for d in sets}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    by = defaultdict(set)
    for d in ids:
        for s in sets[d]:
            by[s].add(d)
    done = set()
    for s in by.values():
        for a in s:
            for b in s:
                if a < b and (a, b) not in done:
                    done.add((a, b))
                    if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                        x, y = top(a), top(b)
                        root[max(x, y)] = min(x, y)
    return [(d, len(sets[d]), top(d)) for d in ids]
