"""Vectorised hashing of the words and word shingles of a batch of texts.

The bytes of a batch lie in one array.  A word's hash is a polynomial over
random byte values, summed with ``reduceat``; a shingle's hash is a polynomial
over word hashes.  All arithmetic is modulo 2**64, finished by a mixer.
"""
from __future__ import annotations

import numpy as np

U64 = np.uint64
_rng = np.random.default_rng(20240229)
BYTE_VALUE = _rng.integers(1, 1 << 63, size=256, dtype=np.uint64) * U64(2) + U64(1)
BASE, SHINGLE_BASE = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93)

#: ASCII letters and digits and every non-ASCII byte
ALNUM = np.array([chr(b).isalnum() or b >= 128 for b in range(256)]) & np.array([b < 128 and chr(b).isalnum() or b >= 128 for b in range(256)])
#: everything but space, tab, LF, VT, FF and CR
NON_SPACE = np.array([not (b == 0x20 or 0x09 <= b <= 0x0D) for b in range(256)])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(max(n, 1), base, dtype=np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


class Words:
    """Words of a batch: ``hash``, ``doc`` (index of the text), ``start`` and
    ``end`` (byte offsets into ``data``, the joined texts), ``first`` (index
    of each text's first word, and the number of words at the end)."""

    def __init__(self, texts: list[bytes], word_byte: np.ndarray = ALNUM):
        sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
        self.data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        self.offset = np.concatenate([[0], np.cumsum(sizes)])
        inside = np.zeros(len(self.data) + 2, dtype=np.int8)
        inside[1:-1] = word_byte[self.data]
        edge = np.diff(inside)
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        size = self.end - self.start
        of_word = np.flatnonzero(inside[1:-1])
        at = np.cumsum(size) - size
        if len(size):
            rel = np.arange(len(of_word), dtype=np.int32) - np.repeat(at.astype(np.int32), size)
            value = BYTE_VALUE[self.data[of_word]] * powers(BASE, int(size.max()))[rel]
            self.hash = mixed(np.add.reduceat(value, at) + size.astype(np.uint64) * BASE)
        else:
            self.hash = np.zeros(0, dtype=np.uint64)
        self.first = np.searchsorted(self.start, self.offset)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word and hash of every window of ``k`` words of
        one text."""
        n = len(self.hash)
        if n < k:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        p, total = powers(SHINGLE_BASE, k), np.zeros(n - k + 1, dtype=np.uint64)
        for j in range(k):
            total += self.hash[j:n - k + 1 + j] * p[j]
        at = np.flatnonzero(self.doc[:n - k + 1] == self.doc[k - 1:])
        return at, mixed(total[at])

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Text index and hash of every shingle; a text of 1 to k-1 words has
        one, of all its words."""
        at, h = self.windows(k)
        count = np.diff(self.first)
        short = np.flatnonzero((count > 0) & (count < k))
        p = powers(SHINGLE_BASE, k)
        extra = np.array([np.add.reduce(self.hash[self.first[i]:self.first[i + 1]] * p[:count[i]]) for i in short], dtype=np.uint64)
        return np.concatenate([self.doc[at], short]), np.concatenate([h, mixed(extra + U64(1))])


def encoded(text: str | None, lower: bool = True) -> bytes:
    if not text:
        return b""
    return (text.lower() if lower else text).encode("utf-8", "replace")


def chunks(texts: list[bytes], size: int = 2_000_000, most: int = 4096):
    """Slices of a batch: about ``size`` bytes, at most ``most`` texts."""
    at = 0
    while at < len(texts):
        end, total = at, 0
        while end < len(texts) and end - at < most and (end == at or total + len(texts[end]) <= size):
            total += len(texts[end])
            end += 1
        yield at, end
        at = end
