"""Texts as arrays of lower-case characters: letters, words of letters, hashed character n-grams."""

from __future__ import annotations

import numpy as np

from .common import U, mix64

_known = np.zeros(0x110000, np.uint8)  # 1 letter, 2 other; filled as characters come


def is_letter(codes: np.ndarray) -> np.ndarray:
    kind = _known[codes]
    if not kind.all():
        for c in np.unique(codes[kind == 0]).tolist():
            _known[c] = 1 if chr(c).isalpha() else 2
        kind = _known[codes]
    return kind == 1


def lower_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in lower case, each followed by a line feed, and where each begins."""
    low = [t.lower() for t in texts]
    codes = np.frombuffer(("\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, np.cumsum([0, *(len(t) + 1 for t in low)])


def letter_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points, starts and ends of the runs of letters, and where each text's words begin."""
    codes, begins = lower_codes(texts)
    flips = np.flatnonzero(np.diff(np.concatenate(([False], is_letter(codes))).astype(np.int8)))
    starts, ends = flips[::2], flips[1::2]
    return codes, starts, ends, np.searchsorted(starts, begins)


def gram_buckets(codes: np.ndarray, size: int, bits: int) -> np.ndarray:
    """Buckets of all runs of ``size`` codes, by where they begin."""
    n = max(0, len(codes) - size + 1)
    h = np.full(n, U(size))
    for k in range(size):
        h = (h ^ codes[k : k + n]) * U(0x9FB21C651E98DF25)
        h ^= h >> U(29)
    return (mix64(h) >> U(64 - bits)).astype(np.int64)
