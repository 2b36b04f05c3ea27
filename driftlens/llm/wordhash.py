"""64-bit hashes of stretches of a byte array, without a loop over the stretches."""

from __future__ import annotations

import numpy as np

SPAN = 4096
_WEIGHTS = np.random.default_rng(0x5EED).integers(1, 1 << 63, SPAN, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPANS = np.random.default_rng(0x5EED + 1).integers(1, 1 << 63, 1 << 12, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
# The first span has no factor, so a stretch has the same hash whatever other stretches lie beside it.
_SPANS[0] = np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit values over all bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def stretch_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A hash for each stretch of ``data``; the stretches follow each other and cover all of it.

    Weighted sums modulo 2^64 with a fixed random weight for each position, then mixed with the length.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    place = np.arange(len(data), dtype=np.int32)
    place -= np.repeat(starts.astype(np.int32), lengths)
    if int(lengths.max()) <= SPAN:
        terms = _WEIGHTS[place]
    else:
        terms = _WEIGHTS[place & (SPAN - 1)] * _SPANS[(place // SPAN) & ((1 << 12) - 1)]
    terms *= data.astype(np.uint64) + np.uint64(1)
    sums = np.add.reduceat(terms, starts)
    return mix(sums + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and hash of each run of bytes that are not white space."""
    space = _SPACE[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts = np.concatenate([np.zeros(1, np.int64), edges])
    lengths = np.diff(np.append(starts, len(data)))
    hashes = stretch_hashes(data, starts, lengths)
    words = ~space[starts]
    return starts[words], lengths[words], hashes[words]
