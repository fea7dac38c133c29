"""The binary Golay code [23, 12, 7]: decoding of 23-bit words to nearby codewords.

Every 23-bit word is within 3 bits of exactly one codeword. Its *keys* are that
codeword and, where the distance is 3, the five codewords at distance 4 besides.
Two words that differ in at most 2 bits always share a key. Let c be the nearest codeword
of one of them. The other is within 5 bits of c:

* within 3, c is its nearest codeword too;
* at 4, its own nearest one is at distance 3 (each 4 errors lie in exactly one block of the
  code's Steiner system), so its keys hold all codewords at distance 4, c among them;
* at 5, the first word is at distance 3 and both errors point away from c: the block through
  the 3 errors and one of the new ones is at distance 4 from both.

The tests check this over all error patterns.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

#: Fixed value: generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
POLYNOMIAL = 0b101011100011
WORD_BITS, CHECK_BITS = 23, 11


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of each word by the generator polynomial."""
    rest = words.astype(np.int64)
    for bit in range(WORD_BITS - 1, CHECK_BITS - 1, -1):
        rest = np.where(rest >> bit & 1, rest ^ (POLYNOMIAL << (bit - CHECK_BITS)), rest)
    return rest


@lru_cache(maxsize=1)
def errors() -> np.ndarray:
    """For each of 2048 syndromes the error patterns of weight up to 4 that lead to a key; -1 fills."""
    found: list[list[int]] = [[] for _ in range(1 << CHECK_BITS)]
    weight: dict[int, int] = {}
    for w in range(5):
        patterns = np.array([sum(1 << b for b in bits) for bits in combinations(range(WORD_BITS), w)])
        for s, e in zip(syndrome(patterns).tolist(), patterns.tolist(), strict=True):
            if w < 4:
                weight[s] = w
                found[s].append(e)
            elif weight[s] == 3:
                found[s].append(e)
    return np.array([[*e, *[-1] * (6 - len(e))] for e in found], dtype=np.int64)


def keys(words: np.ndarray) -> np.ndarray:
    """(n, 6) indices of the nearby codewords of each 23-bit word, -1 where there are fewer."""
    near = errors()[syndrome(words)]
    return np.where(near < 0, -1, (words[:, None] ^ near) >> CHECK_BITS)
