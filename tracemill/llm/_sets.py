"""Word sets, MinHash minima and sketches of whole Arrow batches, as flat numpy arrays.

The words of a text are its maximal runs of letters and digits, lower-cased. A word is held as a
64-bit hash; a text as the sorted distinct hashes of its words. All functions work on one batch at
once: a flat array of vocabulary positions and the offset at which each text begins.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\W_]+")
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


class Vocabulary(dict):
    """Word to position in the batch; ``hashes`` gives the words' 64-bit hashes by position."""

    def __init__(self):
        super().__init__()
        self.order: list[int] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self.order)
        self.order.append(xxhash.xxh3_64_intdigest(word))
        return n

    def hashes(self) -> np.ndarray:
        return np.array(self.order, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + _GOLD
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class WordSets:
    """Distinct words of each text of a batch. Texts without a word are left out; ``rows`` has the others' positions."""

    def __init__(self, texts: list[str | None]):
        vocabulary = Vocabulary()
        flat: list[int] = []
        lengths = np.zeros(len(texts), np.int64)
        get = vocabulary.__getitem__
        for i, text in enumerate(texts):
            if text:
                found = WORD.findall(text.lower())
                lengths[i] = len(found)
                flat.extend(map(get, found))
        self.hashes = vocabulary.hashes()
        size = max(1, len(self.hashes))
        key = np.unique(np.repeat(np.arange(len(texts)), lengths) * size + np.array(flat, np.int64))
        doc, self.index = key // size, key % size
        counts = np.bincount(doc, minlength=len(texts)) if len(texts) else np.zeros(0, np.int64)
        self.rows = np.flatnonzero(counts)
        self.counts = counts[self.rows]
        self.starts = np.concatenate([[0], np.cumsum(self.counts)[:-1]]).astype(np.int64) if len(self.rows) else np.zeros(0, np.int64)

    def ids(self) -> np.ndarray:
        """One 64-bit number for each distinct set of words, whatever their order."""
        if not len(self.rows):
            return np.zeros(0, np.int64)
        with np.errstate(over="ignore"):
            total = np.add.reduceat(mix(self.hashes)[self.index], self.starts)
        return mix(total ^ self.counts.astype(np.uint64)).view(np.int64)

    def minima(self, functions: int, seed: int = 7) -> np.ndarray:
        """uint32 [functions, texts]: MinHash minima."""
        return minima_of(self.hashes, self.index, self.starts, functions, seed)

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, 32-bit hashes) of each text's words; two words of one text share a hash once in some million texts."""
        return np.append(self.starts, len(self.index)).astype(np.int32), mix(self.hashes).astype(np.uint32).view(np.int32)[self.index]


def minima_of(hashes: np.ndarray, index: np.ndarray, starts: np.ndarray, functions: int, seed: int = 7, some: range | None = None) -> np.ndarray:
    """uint32 [functions, texts]: MinHash minima of texts given as positions in a vocabulary of hashes; of some of
    the functions where they are named."""
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 2**63, functions, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, functions, dtype=np.uint64)
    some = range(functions) if some is None else some
    out = np.empty((len(some), len(starts)), np.uint32)
    if len(starts):
        with np.errstate(over="ignore"):
            for i, f in enumerate(some):
                h = mix(hashes * a[f] + b[f])
                out[i] = np.minimum.reduceat((h >> np.uint64(32)).astype(np.uint32)[index], starts)
    return out


#: Bits of the packed sketch of a text.
BITS = 128


def low_bits(minima: np.ndarray) -> np.ndarray:
    """b-bit MinHash with b = 1: the low bits of the first 128 minima, packed in two uint64 a text."""
    out = np.zeros((minima.shape[1], BITS // 64), np.uint64)
    for f in range(BITS):
        out[:, f // 64] |= (minima[f] & np.uint32(1)).astype(np.uint64) << np.uint64(f % 64)
    return out


def agreeing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return BITS - np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)


def least_agreeing(threshold: float, sigmas: float = 3.1) -> int:
    """Fewest of the bits that two texts of similarity ``threshold`` agree in, but for one case in a thousand.

    Bits of different minima agree half of the time, so the share of agreeing bits is (1 + J) / 2 and
    the collision-corrected estimate is J = 2 * agreeing / BITS - 1.
    """
    p = (1 + threshold) / 2
    return int(np.floor(BITS * p - sigmas * np.sqrt(BITS * p * (1 - p))))
