"""Sets of word shingles as sorted 64-bit hashes, many texts at a time, over the bytes of an Arrow column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_rng = np.random.Generator(np.random.PCG64(20240229))
_WORD = np.ones(256, bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False
_LETTER = _rng.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_LETTER[65:91] = _LETTER[97:123]  # A-Z lower-cased
_LETTER[~_WORD] = 0
_place = _rng.integers(1, 1 << 63, 1024, np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = _rng.integers(1, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _places(n: int) -> np.ndarray:
    global _place
    while len(_place) < n:
        _place = np.concatenate((_place, mix(_place + np.uint64(len(_place))) | np.uint64(1)))
    return _place


def sets(texts: pa.StringArray, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: of ``k`` words, or of all words where there are fewer; none without words."""
    n = len(texts)
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    empty = np.zeros(0, np.uint64)
    if not n or at[-1] == at[0]:
        return [empty] * n
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    word = _WORD[raw]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    inner = at[1:-1]
    begins[inner[inner < len(raw)]] = word[inner[inner < len(raw)]]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return [empty] * n
    place = np.arange(len(raw), dtype=np.int64)
    place -= starts[np.maximum(np.cumsum(begins) - 1, 0)]
    place[~word] = 0  # blanks count nothing
    place = np.maximum(place, 0)
    value = _LETTER[raw] * _places(int(place.max()) + 1)[place]
    hashes = mix(np.add.reduceat(value, starts))
    first = np.searchsorted(starts, at)  # the first word of each text
    out = []
    long = len(hashes) - k + 1
    rolled = empty
    if long > 0:
        rolled = hashes[:long] * _STEP[0]
        for j in range(1, k):
            rolled = rolled + hashes[j : j + long] * _STEP[j]
        rolled = mix(rolled)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            s = np.sort(rolled[a : b - k + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            out.append(mix((hashes[a:b] * _STEP[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a)))
        else:
            out.append(empty)
    return out
