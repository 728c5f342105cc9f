"""Plain versions of the prefix trie and the filter audit, for small tables."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from itertools import permutations

from brute import words


def rebuilt(rows):
    """{conv_id: [(role, text), ...]} from (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), (role or "", text or "")))
    own = {c: [x for _, x in sorted(v, key=lambda p: p[0])] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rest = c - (abs(c) // 5 * 5) * (1 if c >= 0 else -1)  # truncated, as in SQL
        out[c] = own.get(c - rest, [])[:h] + turns[h:]
    return out


def prefix_trie(rows):
    """Set of result rows, in column order."""
    convs = rebuilt(rows)
    members, kids, ends = defaultdict(list), defaultdict(set), defaultdict(list)
    for c in sorted(convs):
        seq = tuple(convs[c])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
            if d:
                kids[seq[:d - 1]].add(seq[:d])
        ends[seq].append(c)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        saved[node] = own + sum(saved[k] for k in kids[node])
    return {(m[0], len(node), members[node[:-1]][0] if node else None, len(m), len(kids[node]), leaves[node], saved[node],
             hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest()) for node, m in list(members.items())}


def masks(docs):
    """[(part, failed filters as a string, doc_id)] from (doc_id, text, source)."""
    first = {}
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    out = []
    for d, t, s in docs:
        t = t or ""
        w = words(t)
        fails = [len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t),
                 any(c in "#$%&*|" for c in t), d is not None and first[t] < d]
        out.append((s or "", "".join(f for f, x in zip("ABCDE", fails, strict=True) if x), d))
    return out


def filter_audit(docs, labels):
    """Set of result rows, in column order."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    rows, out = masks(docs), set()
    for part in {p for p, _, _ in rows}:
        mine = [(f, d) for p, f, d in rows if p == part]
        removed = defaultdict(int)
        found = []
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                gone, here = set(order[:step - 1]), [(x, d) for x, d in mine if f in x and not set(order[:step - 1]) & set(x)]
                removed[f] += len(here)
                found.append((f, (part, order, step, sum(not set(order[:step]) & set(x) for x, _ in mine), len(here),
                                  sum(f in x and bool(gone & set(x)) for x, _ in mine), sum(x == f for x, _ in mine),
                                  sum(d in good for _, d in here), sum(d in toxic for _, d in here))))
        out |= {(*row, removed[f]) for f, row in found}
    return out
