"""Short pieces of texts as 64-bit hashes, made and sifted in NumPy inside Arrow tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

GRAM = 6  # letters of a piece; a shorter string is a piece by itself
_ODD = np.array([0x9E3779B97F4A7C15 * (2 * k + 1) ** 5 % 2**64 for k in range(GRAM)], np.uint64)  # a multiplier for each place


def hashes(text: str, n: int) -> np.ndarray:
    """Hash of every piece of n letters of a text, in order."""
    letters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if len(letters) < n:
        return np.empty(0, np.int64)
    h = np.full(len(letters) - n + 1, n, np.uint64)
    for k in range(n):
        h += (letters[k:len(letters) - n + 1 + k] + np.uint64(1)) * _ODD[k]
    h ^= h >> np.uint64(32)
    h *= _ODD[0]
    return (h ^ (h >> np.uint64(29))).view(np.int64)


def pieces(texts: pa.Array) -> pa.Array:
    """The different pieces of each string: array of hashes; none for an empty one."""
    out = [np.unique(hashes(t, min(len(t), GRAM))) if t else np.empty(0, np.int64) for t in texts.to_pylist()]
    return pa.array(out, pa.list_(pa.int64()))


class Sieve:
    """A set of hashes as bits by their upper part: no member is missed, others pass by chance."""

    def __init__(self, power: int, words: dict[int, int]):
        self.shift = np.uint64(64 - power)
        self.bits = np.zeros((1 << power) // 64, np.uint64)
        for at, word in words.items():
            self.bits[at] = word & 0xFFFFFFFFFFFFFFFF

    def slots(self, h: np.ndarray) -> np.ndarray:
        return (h.view(np.uint64) >> self.shift).astype(np.int64)

    def passing(self, h: np.ndarray) -> np.ndarray:
        slot = self.slots(h)
        return h[(self.bits[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) == 1]

    def of(self, text: str, lengths: list[int]) -> np.ndarray:
        """Different hashes of a text's pieces that pass."""
        found = [self.passing(hashes(text, n)) for n in lengths]
        return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
