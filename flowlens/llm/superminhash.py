"""SuperMinHash signatures.

Each element draws, one after the other, a random place and a random fraction: step i puts the value
i + fraction at the i-th place of the element's own random permutation of the m slots. A slot keeps the
smallest value. As values of step i are below those of step i + 1, a slot is final once it has been hit
in the smallest step, and a set is done as soon as all slots are hit (early stopping): a set of n
elements takes about m ln(m) / n steps. All sets of a piece take a step together.
"""

from __future__ import annotations

import numpy as np

from flowlens.llm.words import mix

_U = np.uint64
EMPTY = np.uint32(0xFFFFFFFF)
_STEP = 0xD1342543DE82EF95


def signatures(elements: np.ndarray, offsets: np.ndarray, m: int) -> np.ndarray:
    """One row of m values (step in the top 8 bits, fraction below) per set; empty sets keep EMPTY.

    ``elements`` are distinct 64-bit hashes within a set; set j is ``offsets[j]:offsets[j + 1]``. m is at most 254.
    """
    sets = len(offsets) - 1
    out = np.full(sets * m, EMPTY, dtype=np.uint32)
    sizes = np.diff(offsets)
    e, owner = elements, np.repeat(np.arange(sets, dtype=np.int64), sizes)
    drawn: list[np.ndarray] = []
    left = sizes > 0
    for step in range(m):
        if not len(e):
            break
        r = mix(e + _U((step + 1) * _STEP & 0xFFFFFFFFFFFFFFFF))
        draw = (step + (((r >> _U(32)) * _U(m - step)) >> _U(32))).astype(np.int16)
        place = draw.copy()
        for t in range(step - 1, -1, -1):
            place[drawn[t] == place] = t
        slot = owner * m + place
        free = out[slot] >= np.uint32(step << 24)
        value = np.uint32(step << 24) | (r[free] & _U(0xFFFFFF)).astype(np.uint32)
        np.minimum.at(out, slot[free], value)
        open_now = left & (out.reshape(sets, m) == EMPTY).any(axis=1)
        if (open_now != left).any():
            left = open_now
            keep = left[owner]
            e, owner = e[keep], owner[keep]
            drawn = [d[keep] for d in drawn]
            draw = draw[keep]
        drawn.append(draw)
    return out.reshape(sets, m)


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key per set and band; bands never share keys but by chance."""
    sets, m = signature.shape
    rows = m // bands
    parts = signature[:, :bands * rows].reshape(sets, bands, rows).astype(_U)
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=_U))[None, :], (sets, bands)).copy()
    for j in range(rows):
        key = mix(key * _U(0x9E3779B97F4A7C15) + parts[:, :, j])
    return key
