"""Words and five-word shingles of texts as 64-bit numbers.

A word is a chunk between white space, lower-cased, without punctuation at its
ends; a chunk of punctuation alone is no word. A shingle is five words in a row.
A text of one to four words has one shingle, of all its words; a text without
words has none.
"""

from __future__ import annotations

import string
from hashlib import blake2b

import numpy as np

from .common import LONG, held

SHINGLE = 5
CACHE = 400_000
MARKS = string.punctuation + "¡¿«»„“”‘’…–—"
U64 = np.uint64


class WordNumbers(dict):
    """chunk -> 64-bit number of its word, 0 for none; starts anew when full; long chunks aren't kept."""

    def __missing__(self, chunk: str) -> int:
        word = chunk.strip(MARKS).lower()
        n = int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") or 1
        n = n if word else 0
        if len(chunk) <= LONG:
            if len(self) >= CACHE:
                self.clear()
            self[chunk] = n
        return n


def numbers() -> WordNumbers:
    return held("words", "numbers", None, WordNumbers)


def words(text: str) -> np.ndarray:
    chunks = text.split()
    out = np.fromiter(map(numbers().__getitem__, chunks), U64, len(chunks))
    return out[out != 0]


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def shingles(w: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Numbers of the shingles in order, one per start."""
    if len(w) == 0:
        return w
    size = min(size, len(w))
    n = len(w) - size + 1
    out = np.full(n, size, dtype=U64)
    for k in range(size):
        out = mix(out * U64(0x9E3779B97F4A7C15) + w[k : k + n])
    return out


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, ascending, and how often each occurs."""
    return np.unique(shingles(words(text)), return_counts=True)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags; two empty bags have 1."""
    total = int(a[1].sum() + b[1].sum())
    if total == 0:
        return 1.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / (total - both)


def to_blob(b: tuple[np.ndarray, np.ndarray]) -> bytes:
    """Shingles, then counts, as bytes."""
    return b[0].astype("<u8").tobytes() + b[1].astype("<u4").tobytes()


def from_blob(x: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(x) // 12
    return np.frombuffer(x, "<u8", n), np.frombuffer(x, "<u4", n, 8 * n).astype(np.int64)
