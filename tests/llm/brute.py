"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(t: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def groups(rows, k=5, pct=75):
    """(doc_id, set size, component) per row."""
    sets = []
    for _, t in rows:
        w = SPACED.findall(lower(t))
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= pct * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    members = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            members[find(i)].append(d)
    return [(d, len(sets[i]), min(members[find(i)], default=None)) for i, (d, _) in enumerate(rows)]


def contamination(rows, items, length=13):
    windows = defaultdict(set)
    for name, t in items:
        w = ALNUM.findall(lower(t))
        for i in range(max(1, len(w) - length + 1) if w else 0):
            windows[tuple(w[i:i + length])].add(str(name))
    out = []
    for d, t in rows:
        w = ALNUM.findall(lower(t))
        hit, found = set(), set()
        for size in {len(k) for k in windows}:
            for i in range(len(w) - size + 1):
                if (k := tuple(w[i:i + size])) in windows:
                    hit |= set(range(i, i + size))
                    found |= windows[k]
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def counts(t: str | None):
    t = t or ""
    w = SPACED.findall(t)
    c = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if c[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if SPACED.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), dup, len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)


def secrets(t: str | None):
    t = t or ""
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[1]) >= 8]
    n = [len(found)]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    n.append(len(found) - n[0])
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    n.append(len(found) - sum(n))
    text = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(found))
    return (*n, hashlib.sha256(text.encode()).hexdigest())
