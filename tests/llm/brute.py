"""Plain models of the operators, for small inputs."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def ordered(docs):
    """(doc_id, text) rows in the order that counts as earlier: nulls first, then by id, then by text."""
    return sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, (d[1] or "").encode()))


def suffix(docs, length):
    """Rows that share an id are one document; null is an id of its own, before all others."""
    rows = [(i, (t or "").encode()) for i, t in ordered(docs)]
    rank = lambda i: (i is not None, i or 0)
    first = {}
    for i, b in rows:
        for j in range(len(b) - length + 1):
            first.setdefault(b[j : j + length], rank(i))
    out = []
    for i, b in rows:
        gone = [False] * len(b)
        for j in range(len(b) - length + 1):
            if first[b[j : j + length]] < rank(i):
                gone[j : j + length] = [True] * length
        spans = sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return out


def substring(docs, window):
    rows = [(i, WORD.findall(t or "")) for i, t in ordered(docs)]
    seen, out = set(), []
    for i, w in rows:
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            t = tuple(w[j : j + window])
            if t in seen:
                gone[j : j + window] = [True] * window
            seen.add(t)
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def shingle_set(t, size=5):
    w = WORD.findall(lower(t or ""))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def near(docs, size=5, percent=75):
    """(doc_id, n_shingles, component_id, kept), by comparing all pairs that share a shingle."""
    sets = [shingle_set(t, size) for _, t in docs]
    up = list(range(len(docs)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    seen = set()
    for h in holders.values():
        for i in h:
            for j in h:
                if i < j and (i, j) not in seen:
                    seen.add((i, j))
                    n = len(sets[i] & sets[j])
                    if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                        up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return [(d, len(s), least.get(top(i)) if s else d, d == (least.get(top(i)) if s else d)) for i, ((d, _), s) in enumerate(zip(docs, sets))]


def nulls_first(rows):
    return sorted(rows, key=lambda r: [(v is not None, v) for v in r])


def line_dedup(docs, min_docs, min_chars=1):
    blank = " \t\n\x0b\x0c\r"
    keys = [[lower(x.strip(blank)) for x in (t or "").split("\n")] for _, t in docs]
    holders = {}  # rows that share an id are one document
    for (i, _), k in zip(docs, keys):
        for x in k:
            holders.setdefault(x, set()).add(i)
    count = {x: len(ids) for x, ids in holders.items()}
    out = []
    for (i, t), k in zip(docs, keys):
        lines = (t or "").split("\n")
        gone = [len(x) >= min_chars and count[x] >= min_docs for x in k]
        out.append((i, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    return out


def rule_counts(text):
    w = WORD.findall(text or "")
    tri = {}
    for i in range(len(w) - 2):
        tri.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {i + k for at in tri.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def contained(docs, items, percent=75):
    out = {}
    for d, t in docs:
        own = shingle_set(t)
        for i, x in items:
            s = shingle_set(x)
            n = len(s & own)
            if s and 100 * n >= percent * len(s):
                out[d, i] = max(out.get((d, i), (0, 0)), (n, len(s)))
    return [(d, i, *v) for (d, i), v in out.items()]


def pagerank(edges, seeds, kind, damping, iterations):
    """edges: {(src, dst): n}; kind distrust walks against them."""
    ways = {}
    for (a, b), n in edges.items():
        a, b = (a, b) if kind == "trust" else (b, a)
        ways.setdefault(a, []).append((b, n))
    s = {h: 1.0 for h, k in seeds if k == kind}
    start = dict(s)
    for _ in range(iterations):
        new = {h: (1 - damping) for h in start}
        for a, x in s.items():
            total = sum(n for _, n in ways.get(a, []))
            for b, n in ways.get(a, []):
                new[b] = new.get(b, 0.0) + damping * x * n / total
        s = new
    return s
