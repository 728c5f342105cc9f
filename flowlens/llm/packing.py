"""Packing documents into sequences of a fixed length: first-fit decreasing over a tournament tree.

Every text is tokenised whole and gets an end id. Full lengths are cut off its front as sequences of their
own; the rests of a randomly dealt group of documents are packed together, largest first, each into the
first sequence with room. The tournament tree holds the largest room of each half of the sequences, so that
sequence is found in log2(n) steps. At last the emptiest sequences are taken apart to fill the room left
in the others, cutting pieces where needed, so that a group ends with one partly filled sequence.

Groups are dealt by a hash and hold about ``group_size`` documents at any size of the table.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

LENGTH = 1024
END_ID = 0
GROUP_SIZE = 4096
MODEL = "byte_bpe_50k.json"
CACHE = 600_000

#: Texts within these characters split into independent pieces before every single space and line end.
_OTHER = re.compile(r"[^\n -~¡-ɏ]")
_GAPS = ("  ", " \n", "\n ", "\n\n")
#: Signs that close a word; they are a part of their own, marked so that no space is put before it.
_CLOSING = re.compile(r"[!-&(-/:-@\[-`{-~](?<=[^\W_].)[!-&(-/:-@\[-`{-~]*(?=[ \n]|$)")
_MARK = "\x02"


#: The sign that stands for each byte in a byte-level vocabulary, where it is not the byte's own.
_BYTES = dict(zip([b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)], range(256, 512)))  # noqa: B905


class _Ids(dict):
    """Ids of parts as bytes; a part that is not there yet is tokenised when asked for.

    A run of letters is one piece to the tokenizer, so it goes to the merges at once, without the search for pieces.
    """

    def __init__(self, model: Tokenizer):
        super().__init__()
        self.model, self.merges = model, model.model
        self.line_end = self.whole("\n")
        pieces = model.pre_tokenizer.pre_tokenize_str(" ab\n é's") if model.pre_tokenizer and not model.normalizer else []
        self.plain = [p for p, _ in pieces] == ["Ġab", "Ċ", "ĠÃ©", "'s"]

    def whole(self, text: str) -> bytes:
        return np.asarray(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4").tobytes()

    def __missing__(self, part: str) -> bytes:
        # a part starting with a line end or a mark stands for itself, any other for a space and itself
        first = part[:1]
        word = part[1:] if first in ("\n", _MARK) else part
        if self.plain and first != _MARK and word.isalpha():
            signs = word if word.isascii() else word.encode().decode("latin-1").translate(_BYTES)
            ids = [t.id for t in self.merges.tokenize(signs if first == "\n" else "Ġ" + signs)]
            found = struct.pack(f"<{len(ids)}I", *ids)
            if first == "\n":
                found = self.line_end + found
        else:
            found = self.whole(word if first == _MARK else part if first == "\n" else " " + part)
        self[part] = found
        return found


class Encoder:
    """Ids of whole texts as little-endian 32-bit numbers.

    The byte-level model never merges across the start of " word" or of a line, nor into the signs that close a word.
    So a text in which spaces and line ends stand alone is the sequence of such parts, and the ids of parts seen before come from a bounded cache. All
    other texts go to the tokenizer whole, as do those with the name of a special token.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.model = Tokenizer.from_file(path)
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.seen = _Ids(self.model)

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.seen) > CACHE:
            self.seen.clear()
        ids, line_end = self.seen.__getitem__, len(self.seen.line_end)
        out = []
        for text in texts:
            if text and not (_OTHER.search(text) or any(g in text for g in _GAPS) or any(t in text for t in self.special)):
                parts = _CLOSING.sub(rf" {_MARK}\g<0>", "\n" + text).replace("\n", " \n")[1:].split(" ")
                # the line end put before the first part is taken off again
                out.append(b"".join(map(ids, parts))[line_end:])
            else:
                out.append(self.seen.whole(text))
        return out


@lru_cache(maxsize=4)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


class Tournament:
    """Rooms of numbered bins; finds the first bin with enough room and opens new ones at the end."""

    def __init__(self, most: int, room: int):
        self.leaves = 1 << max(0, most - 1).bit_length()
        self.best = [0] * self.leaves + [room] * self.leaves
        for i in range(self.leaves - 1, 0, -1):
            self.best[i] = max(self.best[2 * i], self.best[2 * i + 1])

    def take(self, size: int) -> int:
        """The first bin with room for ``size``, which is taken from it."""
        best, at = self.best, 1
        while at < self.leaves:
            at *= 2
            if best[at] < size:
                at += 1
        best[at] -= size
        found = at - self.leaves
        at //= 2
        while at:
            top = max(best[2 * at], best[2 * at + 1])
            if best[at] == top:
                break
            best[at] = top
            at //= 2
        return found


def first_fit_decreasing(sizes: list[int], length: int) -> list[int]:
    """The bin of each item; items are taken by falling size, ties in the order given."""
    tree, bins = Tournament(len(sizes), length), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        bins[i] = tree.take(sizes[i])
    return bins


def pack_rests(sizes: list[int], length: int) -> list[tuple[int, int, int, int]]:
    """Pieces ``(item, start, size, bin)`` of all items: first-fit decreasing, then the emptiest bins fill the others."""
    bins = first_fit_decreasing(sizes, length)
    inside: dict[int, list[tuple[int, int, int]]] = {}
    for i, b in enumerate(bins):
        inside.setdefault(b, []).append((i, 0, sizes[i]))
    fill = {b: sum(p[2] for p in ps) for b, ps in inside.items()}
    by_fill = sorted(fill, key=lambda b: (fill[b], -b))
    low, high = 0, len(by_fill) - 1
    while low < high:
        room = length - fill[by_fill[high]]
        if not room:
            high -= 1
            continue
        if not inside[by_fill[low]]:
            low += 1
            continue
        source, goal = by_fill[low], by_fill[high]
        item, start, size = inside[source].pop()
        part = min(size, room)
        inside[goal].append((item, start, part))
        fill[goal] += part
        fill[source] -= part
        if part < size:
            inside[source].append((item, start + part, size - part))
    return [(*piece, b) for b, ps in inside.items() for piece in ps]


def tokenised(docs: DataFrame, model: str = MODEL, length: int = LENGTH) -> DataFrame:
    """Per document: its id, token count with the end id, checksums of its full lengths, and the ids of the rest."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoder(public_tokenizers.path(model))
        end = np.asarray([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                counts, sums, rests = [], [], []
                for ids in own.encode([t or "" for t in part.column("text").to_pylist()]):
                    ids += end
                    whole = len(ids) // (4 * length) * 4 * length
                    counts.append(len(ids) // 4)
                    sums.append([zlib.crc32(ids[i:i + 4 * length]) for i in range(0, whole, 4 * length)])
                    rests.append(ids[whole:])
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(sums, pa.list_(pa.int64())),
                    pa.array(rests, pa.binary()), part.column("_group")],
                    names=["doc_id", "doc_tokens", "full", "rest", "group"])

    return docs.mapInArrow(encode, "doc_id long, doc_tokens long, full array<long>, rest binary, group long")


def pack_documents(docs: DataFrame, length: int = LENGTH, group_size: int = GROUP_SIZE, model: str = MODEL) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Null and empty texts are one token, the end id. Rows are packed as documents of their own, with equal or null
    ids too, and equal rows are spread over the groups by their row number; an empty table gives no pieces; columns besides ``doc_id`` and ``text`` are ignored. Sequence ids are
    unique, not consecutive.
    """
    groups = max(1, -(-docs.count() // group_size))
    rows = docs.select("doc_id", "text", F.pmod(F.xxhash64(F.lit(29), "doc_id", F.monotonically_increasing_id()), F.lit(groups)).alias("_group"))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "doc_tokens", "rest"], kind="stable", na_position="first")
        out, sequence = [], int(group["group"].iloc[0]) << 32
        ids, tokens, rests = list(group["doc_id"]), list(group["doc_tokens"]), list(group["rest"])
        for doc, n, full in zip(ids, tokens, group["full"], strict=True):
            for k, crc in enumerate(full):
                out.append((doc, k * length, length, int(crc), n, sequence, 0))
                sequence += 1
        items = [i for i, r in enumerate(rests) if len(r)]
        places: dict[int, int] = {}
        for item, start, size, b in pack_rests([len(rests[i]) // 4 for i in items], length):
            i = items[item]
            at = places.get(b, 0)
            places[b] = at + size
            before = tokens[i] - len(rests[i]) // 4
            out.append((ids[i], before + start, size, zlib.crc32(rests[i][4 * start:4 * (start + size)]), tokens[i], sequence + b, at))
        frame = pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
        return frame.astype({"doc_id": "Int64"})

    return tokenised(rows, model, length).groupBy("group").applyInPandas(
        pack, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
