"""Words of texts inside tasks, as byte strings, and their 64-bit hashes as arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

#: Maps all that parts words of letters, digits and characters beyond ASCII to a space, and A-Z to a-z; bytes of characters beyond ASCII stay.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))
#: Hashes that a task remembers at most, before it starts anew: bounds memory, changes no result.
REMEMBERED = 400_000


def raw(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column as UTF-8 bytes."""
    return batch.column(name).cast(pa.binary()).to_pylist()


def spaced(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return (text or b"").lower().split()


def plain(text: bytes | None) -> list[bytes]:
    """Runs of a-z, 0-9 and all beyond ASCII, A-Z lower-cased first."""
    return (text or b"").translate(_PLAIN).split()


class WordHashes(dict):
    """xxh3 of a word; known words cost one look-up."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result hangs on every bit of the input."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(hashes: np.ndarray, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of ``size`` consecutive words; of the whole sequence, if it is shorter; none without words."""
    n = len(hashes)
    if not n:
        return hashes
    size = min(size, n)
    total = np.zeros(n - size + 1, np.uint64)
    for i in range(size):
        total = total * np.uint64(0x9E3779B97F4A7C15) + hashes[i : n - size + 1 + i]
    return np.unique(mixed(total + np.uint64(size)))
