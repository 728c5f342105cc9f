import struct

import pytest
import xxhash
from brute import sha, words

from flowlens.llm.syncmers import edited_fingerprints, fingerprint_digest


def test_edited_texts_and_likeness(docs, rows):
    got = {r.doc_id: r for r in fingerprint_digest(docs).collect()}
    by_text = {}
    for i, (d, t) in enumerate(rows):
        t, following = t or "", rows[(i + 1) % len(rows)][1] or ""
        q = len(t) // 4
        r = got[d]
        assert r.n_chars == len(t) and r.edited_sha256 == sha(t[:len(t) - q] + following[:q])
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if t == following:
            assert r.near_next == 1
    long = [got[d] for d, t in rows if len(words(t)) > 60]
    assert sum(r.near_edited for r in long) / len(long) > 0.6 > 0.3 > sum(r.near_next for r in long) / len(long)


def plain_anchors(text, k=6):
    """Anchors as word tuples, in text order."""
    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    def pair(a, b):
        first = xxhash.xxh64_intdigest(struct.pack("<q", a), seed=42)
        return signed(xxhash.xxh64_intdigest(struct.pack("<q", b), seed=first))

    w = words(text)
    if len(w) < k:
        return [tuple(w)] if w else []
    h = [signed(xxhash.xxh64_intdigest(x.encode(), seed=42)) for x in w]
    pairs = [pair(a, b) for a, b in zip(h, h[1:])]
    inner = [pairs[i:i + k - 1] for i in range(len(w) - k + 1)]
    return [tuple(w[i:i + k]) for i, p in enumerate(inner) if min(p[0], p[-1]) <= min(p)]


def plain_likeness(a, b, drift=16):
    first = [{x: i for i, x in reversed(list(enumerate(y)))} for y in (a, b)]
    every = set(a) | set(b)
    if not every:
        return 1.0
    moves = sorted(first[1][x] - first[0][x] for x in set(a) & set(b))
    shared = sum(abs(m - moves[len(moves) // 2]) <= drift for m in moves) / len(every)
    return 2 * shared / (1 + shared)


def test_all_anchors_and_both_likenesses_against_plain_code(docs, rows):
    got = {r.doc_id: r for r in fingerprint_digest(docs).collect()}
    for i, (d, t) in enumerate(rows):
        t, following = t or "", rows[(i + 1) % len(rows)][1] or ""
        q = len(t) // 4
        own, edited = plain_anchors(t), plain_anchors(t[:len(t) - q] + following[:q])
        r = got[d]
        assert len(r.fingerprint) == 8 * len(own) and len(r.edited_fingerprint) == 8 * len(edited)
        assert r.near_edited == pytest.approx(plain_likeness(own, edited))
        assert r.near_next == pytest.approx(plain_likeness(own, plain_anchors(following)))


def test_anchors_do_not_depend_on_context(spark):
    """All anchors of a passage follow each other in any text that holds it, however long."""
    passage = " ".join(f"p{i * 7919 % 1000}" for i in range(60))
    filler = [" ".join(f"{side}{i * 31 % 977}" for i in range(4000)) for side in "xy"]
    df = spark.createDataFrame([(0, passage), (1, f"{filler[0]} {passage} {filler[1]}")], "doc_id long, text string")
    a, b = [list(r.own) for r in edited_fingerprints(df).orderBy("doc_id").collect()]
    places = [b.index(h) for h in a]
    assert len(a) > 10 and places == list(range(places[0], places[0] + len(a)))


def test_odd_rows(odd, nothing, spark):
    got = fingerprint_digest(odd).collect()
    assert len(got) == 9 and fingerprint_digest(nothing).count() == 0
    assert len({r.fingerprint for r in got if r.doc_id == 7}) == 1
    one = fingerprint_digest(spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")).first()
    assert one.edited_sha256 == sha("abcdefab")
