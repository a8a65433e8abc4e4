"""The perfect binary Golay code [23, 12, 7], for fuzzy hash keys.

Every 23-bit word lies within three bits of exactly one codeword. near_codewords() decodes all words within one bit of a given word: that
gives one codeword where the word is at most two bits off, six where it is three bits off. A word one bit away decodes to one of them,
and two words at most two bits apart share one of them.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, fixed by the code
LENGTH, CHECK = 23, 11


def _remainder(word: int) -> int:
    for bit in range(LENGTH - 1, CHECK - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - CHECK)
    return word


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the bytes of a word; for each syndrome the nearest error pattern, and the patterns of up to six near codewords."""
    unit = [_remainder(1 << b) for b in range(LENGTH)]
    by_byte = np.zeros((3, 256), np.int64)
    for k in range(3):
        for x in range(256):
            s = 0
            for b in range(8):
                if x >> b & 1 and 8 * k + b < LENGTH:
                    s ^= unit[8 * k + b]
            by_byte[k, x] = s
    nearest = np.zeros(1 << CHECK, np.int64)
    for weight in range(1, 4):
        for bits in combinations(range(LENGTH), weight):
            s = 0
            for b in bits:
                s ^= unit[b]
            nearest[s] = sum(1 << b for b in bits)
    near = np.full((1 << CHECK, 6), -1, np.int64)
    for s in range(1 << CHECK):
        found = {int(nearest[s])} | {int(nearest[s ^ unit[b]]) ^ (1 << b) for b in range(LENGTH)}
        near[s, : len(found)] = sorted(found)
    return by_byte, nearest, near


def _syndrome(words: np.ndarray) -> np.ndarray:
    t = _tables()[0]
    return t[0, words & 255] ^ t[1, words >> 8 & 255] ^ t[2, words >> 16 & 127]


def codeword_index(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword nearest to each word."""
    words = words.astype(np.int64)
    return (words ^ _tables()[1][_syndrome(words)]) >> CHECK


def near_codewords(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices [n, 6] of the codewords near each word, and which of them count."""
    words = words.astype(np.int64)
    patterns = _tables()[2][_syndrome(words)]
    return (words[:, None] ^ np.where(patterns < 0, 0, patterns)) >> CHECK, patterns >= 0


@lru_cache(maxsize=1)
def _codewords() -> np.ndarray:
    words = np.arange(1 << (LENGTH - CHECK)) << CHECK
    return words | _syndrome(words)


def codeword(index: np.ndarray) -> np.ndarray:
    """The 23-bit codewords of 12-bit indices."""
    return _codewords()[index]
