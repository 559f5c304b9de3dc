"""Word shingles of whole texts as sorted arrays of 64-bit hashes, and their MinHash signatures (numpy, inside tasks)."""

from __future__ import annotations

import numpy as np
import xxhash

WORDS = 5
LANES = 360
CACHED_WORDS = 300_000
LONG = 512  # shingles hashed at once: their values stay in the processor's cache, however long a text is


class WordHashes(dict):
    """64-bit hashes of words; emptied when full, so a task's memory stays bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: str | None, hashes: WordHashes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``words`` words; of the whole text where it has fewer; none without words.

    Words are split at the six ASCII blanks and A-Z is lower-cased, both by what ``bytes`` does.
    """
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    own = np.fromiter(map(hashes.__getitem__, tokens), np.uint64, len(tokens))
    width = min(words, len(tokens))
    run = np.full(len(tokens) - width + 1, width, np.uint64)
    for k in range(width):
        run ^= run >> np.uint64(29)
        run *= np.uint64(0xBF58476D1CE4E5B9)
        run += own[k:k + len(run)]
    run ^= run >> np.uint64(32)
    run *= np.uint64(0x94D049BB133111EB)
    run ^= run >> np.uint64(29)
    run.sort()
    first = np.ones(len(run), bool)
    np.not_equal(run[1:], run[:-1], out=first[1:])
    return run[first]


class MinHasher:
    """Lanes are permutations of 32-bit numbers, the upper halves of the shingles' hashes: two shingles with one number make sets
    look more alike, never less, and the sets themselves keep all 64 bits."""

    def __init__(self, lanes: int = LANES, seed: int = 8):
        rng = np.random.default_rng(seed)
        self.scale = rng.integers(0, 2 ** 31, (lanes, 1), np.uint32) * np.uint32(2) + np.uint32(1)
        self.shift = rng.integers(0, 2 ** 32, (lanes, 1), np.uint32)
        self.room = np.empty(lanes * LONG, np.uint32)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """Sixteen bits of the smallest hash of each lane: two sets agree in a lane with their similarity as probability."""
        numbers = (shingles >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self.scale), 2 ** 32 - 1, np.uint32)
        for at in range(0, len(numbers), LONG):
            part = numbers[at:at + LONG]
            values = self.room[:len(least) * len(part)].reshape(len(least), len(part))
            np.multiply(self.scale, part, out=values)
            values += self.shift
            np.minimum(least, values.min(axis=1), out=least)
        return (least * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.uint16)


def common(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sorted distinct arrays share."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())
