import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from flowlens.llm.packing import MODEL, Encoder, first_fit_decreasing, pack_documents, pack_rests


def test_encoder_equals_the_tokenizer():
    own, model = Encoder(public_tokenizers.path(MODEL)), Tokenizer.from_file(public_tokenizers.path(MODEL))
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "\t", "'s", "'ll", "don't", "Ünï", "straße", "x²", "½", "12", "3.14", "ª", "—", "漢字", "\xa0", "\x1c", "\x0b", "...", "a",
             "B.", " é", "\r\n", "!!", "@#", "<|endoftext|>", "İ", "\x02", "_", "a_b", "(x)", "word,", "***"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    got = own.encode(texts)
    for text, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, dtype="<u4").tolist() == model.encode(text, add_special_tokens=False).ids, text


def test_words_of_letters_go_to_the_merges_at_once():
    own, model = Encoder(public_tokenizers.path(MODEL)), Tokenizer.from_file(public_tokenizers.path(MODEL))
    letters = [c for c in map(chr, range(0x250)) if c.isalpha()]
    rng = random.Random(4)
    asked, whole = [], own.seen.whole
    own.seen.whole = lambda text: asked.append(text) or whole(text)
    word = lambda: "".join(rng.choices(letters, k=rng.randint(1, 9)))
    texts = [" ".join(word() for _ in range(40)) + f",\n{word()}'s {word()}._ \"{word()}?!\"" for _ in range(200)]
    texts += ["a " * 5, "", "\n", " ", "a\n", "x  y", "\n'll we", "_a, b_, c", "tail."]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(ids, dtype="<u4").tolist() == model.encode(text, add_special_tokens=False).ids, text
    assert len(asked) < 1000  # of some 9,000 different parts


def test_tournament_finds_the_first_fit():
    rng = random.Random(2)
    for n in (1, 2, 7, 100):
        sizes = [rng.randint(1, 30) for _ in range(n)]
        rooms, want = [30] * n, [0] * n
        for i in sorted(range(n), key=lambda i: -sizes[i]):
            want[i] = next(b for b in range(n) if rooms[b] >= sizes[i])
            rooms[want[i]] -= sizes[i]
        assert first_fit_decreasing(sizes, 30) == want


def test_rests_fill_all_but_one_bin():
    rng = random.Random(3)
    sizes = [rng.randint(1, 1023) for _ in range(500)]
    pieces = pack_rests(sizes, 1024)
    fill, got = {}, [0] * 500
    for item, _, size, b in pieces:
        fill[b] = fill.get(b, 0) + size
        got[item] += size
    assert got == sizes and sum(f < 1024 for f in fill.values()) <= 1 and max(fill.values()) <= 1024


def check(df, rows, group_size=4096):
    model = Tokenizer.from_file(public_tokenizers.path(MODEL))
    pieces = pack_documents(df, group_size=group_size).collect()
    ids = {d: model.encode(t or "", add_special_tokens=False).ids + [0] for d, t in rows}
    at, fill = {}, {}
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        own = ids[p.doc_id]
        assert p.start == at.get(p.doc_id, 0) and p.length > 0 and p.doc_tokens == len(own)
        at[p.doc_id] = p.start + p.length
        assert p.ids_crc32 == zlib.crc32(np.array(own[p.start:p.start + p.length], dtype="<u4").tobytes())
    assert at == {d: len(i) for d, i in ids.items()}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == fill.get(p.sequence_id, 0)
        fill[p.sequence_id] = p.offset + p.length
    assert max(fill.values()) <= 1024
    return sum(1024 - f for f in fill.values()), sum(fill.values())


def test_pieces(docs, rows):
    padding, _ = check(docs, rows)
    assert padding < 1024
    padding, total = check(docs, rows, group_size=30)
    assert padding < 0.2 * total


def test_odd_rows(odd, nothing):
    got = pack_documents(odd).collect()
    assert sum(p.start == 0 for p in got) == 9 and pack_documents(nothing).count() == 0
    assert [p.length for p in got if p.doc_id == 9] == [1]


def test_equal_rows_are_spread_over_the_groups(spark):
    same = spark.range(3000).selectExpr("1L AS doc_id", "'the same row' AS text")
    groups = {r.sequence_id >> 32 for r in pack_documents(same, group_size=400).collect()}
    assert len(groups) == 8
