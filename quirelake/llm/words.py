r"""Words of whole texts and 64-bit numbers for them and for runs of them.

Words are ``[^\x20\x09-\x0D]+``: splitting the UTF-8 bytes on ASCII white space gives just these.
"""

from __future__ import annotations

import numpy as np
import xxhash

#: Words that a worker remembers the numbers of.
MEMORY = 250_000
BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


def split_words(raw: bytes | None, lower: bool = False) -> list[bytes]:
    """``lower`` turns A-Z, and no other letters, into a-z."""
    if not raw:
        return []
    return raw.lower().split() if lower else raw.split()


class WordNumbers(dict):
    """Words to 64-bit numbers, the same everywhere; a bounded memory saves hashing the frequent ones again."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY:
            self.clear()
        number = self[word] = xxhash.xxh64_intdigest(word)
        return number

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def window_hashes(numbers: np.ndarray, width: int) -> np.ndarray:
    """For every run of ``width`` numbers its Rabin-Karp polynomial modulo 2**64, mixed.

    Computed for all positions at once: hashes of runs of 1, 2, 4, ... numbers are joined as the bits of ``width`` say.
    """
    n = len(numbers) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, runs, length, scale, rest = None, 0, numbers, 1, BASE, width
    with np.errstate(over="ignore"):
        while rest:
            if rest & 1:
                part = runs[done : done + n]
                out = part if out is None else out * np.uint64(scale) + part
                done += length
            rest >>= 1
            if rest:
                runs = runs[: len(runs) - length] * np.uint64(scale) + runs[length:]
                length, scale = 2 * length, scale * scale & MASK
    return mix64(out)
