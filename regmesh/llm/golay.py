"""The perfect binary Golay code [23, 12, 7]: nearest codewords of 23-bit words, by table.

The syndrome (11 bits) of a word names its coset; the code is perfect, so every
coset has one leader of weight 3 or less. All tables come from the generator
polynomial.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

N, K = 23, 12
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1


def _remainder(word: int) -> int:
    for at in range(N - 1, N - K - 1, -1):
        if word >> at & 1:
            word ^= GENERATOR << (at - (N - K))
    return word


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the high and low halves of a word; by syndrome the coset leader, and the five or fewer error patterns of weight 4."""
    bit = np.array([_remainder(1 << i) for i in range(N)], np.int32)

    def of(width: int, shift: int) -> np.ndarray:
        out = np.zeros(1 << width, np.int32)
        for i in range(width):
            out[1 << i : 2 << i] = out[: 1 << i] ^ bit[i + shift]
        return out

    low, high = of(12, 0), of(11, 12)
    leader = np.zeros(1 << 11, np.int32)
    four: list[list[int]] = [[] for _ in range(1 << 11)]
    for weight in (1, 2, 3, 4):
        for at in combinations(range(N), weight):
            syndrome, pattern = 0, 0
            for i in at:
                syndrome ^= int(bit[i])
                pattern |= 1 << i
            if weight < 4:
                leader[syndrome] = pattern
            else:
                four[syndrome].append(pattern)
    most = max(map(len, four))
    more = np.full((1 << 11, most), -1, np.int32)
    for s, patterns in enumerate(four):
        more[s, : len(patterns)] = patterns
    return low, high, leader, more


def syndrome(words: np.ndarray) -> np.ndarray:
    low, high, _, _ = _tables()
    return low[words & 0xFFF] ^ high[words >> 12]


def nearest(words: np.ndarray) -> np.ndarray:
    """The index (its 12 message bits) of the one codeword within distance 3."""
    return (words ^ _tables()[2][syndrome(words)]) >> (N - K)


def nearby(words: np.ndarray) -> np.ndarray:
    """(n, m) indices of all codewords that a word one bit away may decode to; -1 where there are fewer.

    A word at distance 2 or less from its codeword keeps it under one error. One at
    distance 3 may pass to a codeword at distance 4, so those come too.
    """
    _, _, leader, more = _tables()
    s = syndrome(words)
    out = np.full((len(words), 1 + more.shape[1]), -1, np.int64)
    out[:, 0] = (words ^ leader[s]) >> (N - K)
    edge = np.bitwise_count(leader[s]) == 3
    extra = more[s]
    out[:, 1:] = np.where(edge[:, None] & (extra >= 0), (words[:, None] ^ extra) >> (N - K), -1)
    return out
