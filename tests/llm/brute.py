"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


class Groups:
    def __init__(self, nodes):
        self.up = {n: n for n in nodes}

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def shingles(text, k=5):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = words(low)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def near_duplicates(rows, k=5, percent=75):
    """{doc_id: (n_shingles, component_id, kept)} for unique ids."""
    sets = {d: shingles(t, k) for d, t in rows}
    inside = defaultdict(list)
    groups = Groups(sets)
    for d in sorted(sets):
        seen = Counter()
        for s in sets[d]:
            seen.update(inside[s])
            inside[s].append(d)
        for o, n in seen.items():
            if 100 * n >= percent * (len(sets[d]) + len(sets[o]) - n):
                groups.join(o, d)
    return {d: (len(sets[d]), groups.find(d), groups.find(d) == d) for d in sets}


def without_repeats(rows, window=20):
    """{doc_id: (n_words, n_removed, kept_sha256)} for unique ids."""
    first, out = {}, {}
    for d, t in sorted(rows):
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first.setdefault(tuple(w[i:i + window]), (d, i)) != (d, i):
                gone[i:i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[d] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _luhn(digits):
    odd = sum(int(x) for x in digits[::-1][::2])
    even = sum(sum(divmod(2 * int(x), 10)) for x in digits[::-1][1::2])
    return (odd + even) % 10 == 0


def personal(text):
    """Base spans by kind, then start."""
    text = text or ""
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m.group())
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return out


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def secrets(text):
    """Base spans by start, then kind."""
    text = text or ""
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    return [(k, s, e) for s, _, e, k in sorted(out)]


def joined(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def contexts(texts, seeds=5, least=0.5, trust=0.75):
    """Spans (text number, start, end) that the graph of patterns and instances adds, over the whole corpus in one place."""
    def like(w):
        return "@" in w or any(c in "0123456789" for c in w)

    def near(w):
        return "".join("0" if c in "0123456789" else c for c in w.lower()).strip(".,;:!?\"'()")

    def around(before, after):
        keys = []
        if before:
            keys.append((before[-1], None, None))
        if len(before) == 2:
            keys.append((before[-1], before[0], None))
        if before and after:
            keys.append((before[-1], None, after[0]))
        return keys

    mentions, plain = [], Counter()
    for i, t in enumerate(texts):
        t = t or ""
        w = [(m.start(), m.end(), m.group()) for m in WORD.finditer(t)]
        base = [(s, e) for _, s, e in personal(t)]
        slots = []
        for j, (s, e, x) in enumerate(w):
            over = [b for b in base if b[0] < e and s < b[1]]
            inner = x.strip(".,;:!?\"'()")
            if like(inner) and not over:
                at = t.index(inner, s)
                slots.append((j, j, at, at + len(inner), False))
            if not like(x):
                before = [near(y[2]) for y in w[max(0, j - 2):j]]
                plain.update(around(before, [near(y[2]) for y in w[j + 1:j + 2]]))
        for s, e in base:
            inside = [j for j, (a, b, _) in enumerate(w) if a < e and s < b]
            slots.append((inside[0], inside[-1], s, e, True))
        for a, b, s, e, seed in slots:
            keys = around([near(y[2]) for y in w[max(0, a - 2):a]], [near(y[2]) for y in w[b + 1:b + 2]])
            mentions.append((i, s, e, t[s:e].lower(), seed, tuple(keys)))
    good = {m[3] for m in mentions if m[4]}
    while True:
        score = {}
        for p in {k for m in mentions for k in m[5]}:
            # a value is a seed in a slot where it was one
            values = defaultdict(lambda: [False, 0])
            for m in mentions:
                if p in m[5]:
                    values[m[3]][0] |= m[4] or m[3] in good and not any(x[4] for x in mentions if x[3] == m[3])
                    values[m[3]][1] += 1
            if sum(v[0] for v in values.values()) >= seeds:
                x = sum(v[1] for v in values.values() if v[0]) / (sum(v[1] for v in values.values()) + plain[p] + 1)
                if x >= least:
                    score[p] = x
        doubt = defaultdict(lambda: 1.0)
        for value, keys in {(m[3], m[5]) for m in mentions if not m[4]}:
            best = max((score[k] for k in keys if k in score), default=0.0)
            doubt[value] *= 1 - best
        now = {m[3] for m in mentions if m[4]} | {v for v, x in doubt.items() if x <= 1 - trust}
        if now == good:
            return sorted((m[0], m[1], m[2]) for m in mentions if not m[4] and m[3] in good and any(k in score for k in m[5]))
        good = now
