"""Words, word hashes and shingles of many texts at once, on the bytes of an Arrow column.

Words are maximal runs of bytes other than space and 0x09 to 0x0D. Every word gets a 64-bit hash: a
polynomial over its bytes, found from running sums, and mixed. Texts are taken whole; work is done
in pieces of a few MB, and a text longer than that is a piece of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 2 << 20
BLOCK_BYTES = 1 << 20
_U = np.uint64
_ODD = 0x9E3779B97F4A7C15
_BASE = 0xD6E8FEB86659FD93
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every input bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=_U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            have = len(self.up)
            self.up = np.concatenate([self.up, self.up * _U(pow(self.base, have, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * _U(pow(self.inverse, have, 1 << 64))])
        return self.up, self.down


_BYTES = Powers(_BASE)
_WORDS = Powers(0xA0761D6478BD642F)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Every ASCII sign that is no letter or digit separates.
SIGNS = np.ones(256, dtype=bool)
SIGNS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_EXACT = mix(np.arange(1, 257, dtype=_U) * _U(_ODD))
_LOWER = _EXACT.copy()
_LOWER[65:91] = _EXACT[97:123]


@dataclass
class Words:
    """Words of the texts ``first`` to ``first + len(offsets) - 1`` of a batch.

    Word i spans ``data[starts[i]:ends[i]]``; text j has the words ``offsets[j]`` to ``offsets[j + 1]``.
    """

    first: int
    data: np.ndarray
    text_offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    if len(texts) == 0 or offsets is None:
        return np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1]
    data = np.zeros(0, dtype=np.uint8) if data is None else np.frombuffer(data, dtype=np.uint8)
    return at.astype(np.int64), data


def _hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    table = _LOWER if lower else _EXACT
    out = np.empty(len(starts), dtype=_U)
    lo = 0
    while lo < len(starts):
        base = starts[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, base + BLOCK_BYTES, side="right")))
        part = data[base:ends[hi - 1]]
        up, down = _BYTES.get(len(part) + 1)
        run = np.empty(len(part) + 1, dtype=_U)
        run[0] = 0
        np.cumsum(table[part] * up[:len(part)], out=run[1:])
        s, e = starts[lo:hi] - base, ends[lo:hi] - base
        out[lo:hi] = mix((run[e] - run[s]) * down[s] + (e - s).astype(_U) * _U(_ODD))
        lo = hi
    return out


def words_of(texts: pa.Array, lower: bool = False, piece: int = PIECE_BYTES, gaps: np.ndarray = _SPACE) -> Iterator[Words]:
    """Words of a string column, piece by piece; null texts have none. ``gaps`` tells for each byte if it separates words."""
    at, data = _buffers(texts)
    n, first = len(at) - 1, 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + piece, side="right")) - 1)
        own = data[at[first]:at[last]]
        offsets = at[first:last + 1] - at[first]
        inside = ~gaps[own]
        begins, closes = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        edge = offsets[1:-1]
        edge = edge[(edge > 0) & (edge < len(own))]
        begins[edge] = inside[edge]
        closes[edge - 1] = inside[edge - 1]
        starts, ends = np.flatnonzero(begins), np.flatnonzero(closes) + 1
        yield Words(first, own, offsets, starts, ends, np.searchsorted(starts, offsets), _hash(own, starts, ends, lower))
        first = last


def grams(hashes: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each k consecutive words; ``len(hashes) - k + 1`` of them, crossing texts too."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=_U)
    h = mix(hashes ^ _U(salt & _MASK)) if salt else hashes
    if k <= 8:
        out = h[:n].copy()
        for j in range(1, k):
            out = out * _U(_WORDS.base) + h[j:n + j]
    else:
        out = np.empty(n, dtype=_U)
        for lo in range(0, n, 1 << 17):
            hi = min(n, lo + (1 << 17))
            up, down = _WORDS.get(hi - lo + k)
            run = np.empty(hi - lo + k, dtype=_U)
            run[0] = 0
            np.cumsum(h[lo:hi + k - 1] * up[:hi - lo + k - 1], out=run[1:])
            out[lo:hi] = (run[k:] - run[:-k]) * down[:hi - lo]
    return mix(out ^ _U((k * _ODD) & _MASK))


def distinct_shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-word shingles per text: hashes, and offsets per text.

    A text with fewer than k words (but at least one) has its whole sequence as its only shingle.
    """
    texts = len(w.offsets) - 1
    counts = w.counts
    g = grams(w.hashes, k)
    owner = w.text_of_word()
    inside = np.zeros(len(owner), dtype=bool)
    if len(g):
        inside[:len(g)] = owner[:len(g)] == owner[k - 1:]
    value, text = g[inside[:len(g)]], owner[inside]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        whole = np.zeros(len(short), dtype=_U)
        for j in range(k - 1):
            here = counts[short] > j
            at = w.offsets[short[here]] + j
            whole[here] = mix(whole[here] * _U(_WORDS.base) + w.hashes[at])
        value = np.concatenate([value, mix(whole + counts[short].astype(_U))])
        text = np.concatenate([text, short])
    order = np.argsort(text, kind="stable") if len(short) else slice(None)
    value, text = value[order], text[order]
    at = np.searchsorted(text, np.arange(texts + 1))
    for j in np.flatnonzero(np.diff(at) > 1):
        value[at[j]:at[j + 1]].sort()
    keep = np.ones(len(value), dtype=bool)
    keep[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    return value[keep], np.concatenate([[0], np.cumsum(keep)])[at]
