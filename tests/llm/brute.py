"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def components(ids, linked):
    """Smallest id reachable from each id; ``linked(i, j)`` on positions."""
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(ids)):
        least.setdefault(find(i), []).append(ids[i])
    known = {r: min((x for x in v if x is not None), default=None) for r, v in least.items()}
    return [known[find(i)] for i in range(len(ids))]


def simhash(text):
    import xxhash

    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def quality_base(text):
    w = words(text)
    grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    counts, covered = Counter(grams), set()
    for k, g in enumerate(grams):
        if counts[g] > 1:
            covered |= {k, k + 1, k + 2}
    lines = [x for x in (text or "").split("\n") if words(x)]
    repeated = len(covered)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), repeated,
            len(w) < 50 or 100 * repeated > 50 * len(w))


def repeats_removed(docs):
    """{row: (words, removed, kept words)} for (id, text) rows."""
    first = {}
    for id, text in docs:
        w = words(text)
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            if id is not None and (key not in first or id < first[key]):
                first[key] = id
    out = []
    for id, text in docs:
        w = words(text)
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if id is not None and first[tuple(w[k : k + 50])] < id:
                gone[k : k + 50] = [True] * 50
        out.append((id, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def base_secrets(text):
    text = text or ""
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(("assign", "access", "hex")[k], a, b) for a, k, b in sorted(found)]


def cosine_links(vectors, threshold=0.95):
    """Links of each vector and a function of linked positions."""
    def unit(v):
        a = None if v is None or any(x is None for x in v) else np.array(v, float)
        if a is None or not len(a) or not np.isfinite(a).all() or not a.any():
            return None
        a = a / np.abs(a).max()  # so that no square overflows or vanishes
        return a / np.linalg.norm(a)

    units = [unit(v) for v in vectors]

    def linked(i, j):
        a, b = units[i], units[j]
        return a is not None and b is not None and len(a) == len(b) and float(a @ b) >= threshold

    n = len(vectors)
    return [sum(linked(i, j) for j in range(n) if j != i) for i in range(n)], linked


def mix_targets(sizes, weights=(5, 2, 1)):
    """Targets by handing out again what capped sources cannot take."""
    total, fixed = 1.5 * sum(sizes), {}
    w = [weights[k % 3] for k in range(len(sizes))]
    while True:
        free = [k for k in range(len(sizes)) if k not in fixed]
        left = total - sum(fixed.values())
        share = {k: left * w[k] / sum(w[i] for i in free) for k in free}
        over = [k for k in free if share[k] > 2 * sizes[k]]
        if not over:
            return [fixed.get(k, share.get(k)) for k in range(len(sizes))]
        fixed |= {k: 2.0 * sizes[k] for k in over}
