"""Sets of hashed word shingles for every text of an Arrow batch, computed over arrays of bytes."""

from __future__ import annotations

import numpy as np
import xxhash

from .flat import SPACE, U64, hashes, mix, names, words

SIZE = 5
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
_WEIGHTS = [U64(w) for w in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def word_hashes(buf: np.ndarray, offsets: np.ndarray, fold: np.ndarray | None = LOWER, inside: np.ndarray | None = None):
    """(hashes of the words, words before each text)."""
    starts, ends, before = words(buf, offsets, ~SPACE if inside is None else inside)
    return hashes(*names(buf if fold is None else fold[buf], starts, ends)), before


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each window of ``size`` words, given by their hashes; windows may cross texts."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = words[:n] * _WEIGHTS[0]
    for k in range(1, size):
        h += words[k : n + k] * _WEIGHTS[k]
    return mix(h)


def sets(buf: np.ndarray, offsets: np.ndarray, size: int = SIZE) -> list[np.ndarray]:
    """Each text's sorted distinct shingles; fewer words than ``size`` are one shingle, none an empty set."""
    own, before = word_hashes(buf, offsets)
    all_windows = windows(own, size)
    out = []
    for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
        if b - a >= size:
            h = all_windows[a : b - size + 1].copy()
            h.sort()
            if len(h) > 1:
                fresh = np.empty(len(h), bool)
                fresh[0] = True
                np.not_equal(h[1:], h[:-1], out=fresh[1:])
                h = h[fresh]
            out.append(h)
        elif b > a:
            out.append(np.array([xxhash.xxh3_64_intdigest(own[a:b].tobytes(), seed=b - a)], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_id(h: np.ndarray) -> bytes:
    """128 bits of a set's content."""
    return xxhash.xxh3_128_digest(h.tobytes())


def bitmaps(found: list[np.ndarray], most: int) -> np.ndarray:
    """A row of bits for each set, as words: 8 to 16 bits for each of ``most`` shingles (64 to 16,384)."""
    width = min(1 << 14, max(64, 1 << (8 * most - 1).bit_length()))
    bits = np.zeros((len(found), width), bool)
    row = np.repeat(np.arange(len(found)), [len(h) for h in found])
    bits[row, (np.concatenate(found) & U64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
