"""Plain Python versions of the operators that SQL cannot express, for small tables."""

import hashlib
import re
from collections import defaultdict

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text, width=5):
    found = [w.lower() for w in WORD.findall((text or "").encode())]
    if not found:
        return set()
    if len(found) < width:
        return {tuple(found)}
    return {tuple(found[i:i + width]) for i in range(len(found) - width + 1)}


def groups(rows):
    """{doc_id: (n_shingles, component_id)} of (doc_id, text) rows by comparing all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    holders = defaultdict(list)
    for at, (_, s) in enumerate(sets):
        for g in s:
            holders[g].append(at)
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for at, (_, s) in enumerate(sets):
        common = defaultdict(int)
        for g in s:
            for other in holders[g]:
                if other < at:
                    common[other] += 1
        for other, both in common.items():
            if 100 * both >= 75 * (len(s) + len(sets[other][1]) - both):
                root[find(at)] = find(other)
    low = defaultdict(list)
    for at, (i, _) in enumerate(sets):
        low[find(at)].append(i)
    return sorted((i, len(s), min(low[find(at)])) for at, (i, s) in enumerate(sets))


def repeats(rows, length=400):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of (doc_id, text) rows."""
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = defaultdict(list)
    for at, (_, b) in enumerate(data):
        for p in range(len(b) - length + 1):
            seen[hashlib.blake2b(b[p:p + length], digest_size=16).digest()].append((at, p))
    gone = [bytearray(len(b)) for _, b in data]
    for places in seen.values():
        if len(places) > 1:
            for at, p in places:
                gone[at][p:p + length] = b"\1" * length
    out = []
    for (i, b), g in zip(data, gone):
        kept = bytes(x for x, r in zip(b, g) if not r)
        out.append((i, len(b), sum(g), len(re.findall(rb"\x01+", bytes(g))), hashlib.sha256(kept).hexdigest()))
    return sorted(out)
