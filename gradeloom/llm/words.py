"""Words and their hashes for whole batches of texts, as NumPy arrays.

A batch is cut into slices of at most ``SLICE_CHARS`` characters (a longer text is a slice of its own), so
memory follows the slice, not the batch. Hashes are 64 bits: a polynomial of the characters, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SLICE_CHARS = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a 64-bit value over all its bits."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def slices(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of consecutive slices; null counts as empty."""
    first, size, part = 0, 0, []
    for i, t in enumerate(texts):
        t = t or ""
        if part and size + len(t) > SLICE_CHARS:
            yield first, part
            first, size, part = i, 0, []
        part.append(t)
        size += len(t) + 1
    if part:
        yield first, part


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts joined by line feeds, and where each text starts."""
    joined = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return joined, np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(texts) else np.zeros(0, np.int64)


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of True."""
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _powers(base: int, n: int) -> np.ndarray:
    factors = np.full(n + 1, base, np.uint64)
    factors[0] = 1
    return np.multiply.accumulate(factors)


class Powers:
    """Powers of the base and of its inverse modulo 2^64, grown as needed."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            n = max(n, SLICE_CHARS + 2)
            cls.up, cls.down = _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)
        return cls.up, cls.down


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each run values[start:end]."""
    up, down = Powers.of(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[:len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


# Space and the control characters 9 to 13.
SPACES = np.zeros(128, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
WORD_CHARS = np.array([chr(c).isalnum() for c in range(128)])


def not_space(cp: np.ndarray) -> np.ndarray:
    """Characters of words ``[^\\x20\\x09-\\x0D]+``."""
    return ~SPACES[np.minimum(cp, 127)]


def alphanumeric(cp: np.ndarray) -> np.ndarray:
    """ASCII letters and digits, and every other character but spaces, punctuation and symbols at 128 and above."""
    other = (cp >= 0xAA) & ~((cp >= 0x2000) & (cp < 0x2C00)) & ~((cp >= 0x3000) & (cp < 0x3040))
    return np.where(cp < 128, WORD_CHARS[np.minimum(cp, 127)], other)


def ascii_lower(cp: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all else as it is."""
    return np.where((cp >= 65) & (cp <= 90), cp + np.uint32(32), cp)


def shingles(words: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every run of k words that lies in one text, in order."""
    if len(words) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = len(words) - k + 1
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = mix(h * np.uint64(_BASE) + words[j:j + n])
    same = doc[:n] == doc[k - 1:]
    return h[same], doc[:n][same]
