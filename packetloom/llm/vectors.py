"""NumPy on the bytes of many texts at once: words, their hashes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np

_MUL1, _MUL2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)

#: True for space, and tab to carriage return
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_LOWER = np.arange(256)
_LOWER[65:91] += 32
# a random number per byte; A-Z as a-z
_BYTE = np.random.default_rng(20240601).integers(0, 2**64, 256, np.uint64)[_LOWER]
_BASE = 0x5851F42D4C957F2D  # odd, so it has an inverse
_SEGMENT = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers in which each bit moves half of the others."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MUL1
    x = x ^ (x >> np.uint64(27))
    x = x * _MUL2
    return x ^ (x >> np.uint64(31))


def fold(hashes: Sequence[np.ndarray]) -> np.ndarray:
    """One hash of several, in order."""
    total = np.zeros_like(hashes[0])
    for h in hashes:
        total = mix(total * _STEP + h + _STEP)
    return total


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def row(base: int) -> np.ndarray:
        x = np.full(n, base, np.uint64)
        x[0] = 1
        return np.cumprod(x)

    return row(_BASE), row(pow(_BASE, -1, 2**64))


def _segments(raw: np.ndarray, space: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of about ``_SEGMENT`` bytes that end after white space."""
    at = 0
    while at < len(raw):
        end = min(at + _SEGMENT, len(raw))
        if end < len(raw):
            back = np.flatnonzero(space[at:end])
            if len(back):
                end = at + int(back[-1]) + 1
            else:
                ahead = np.flatnonzero(space[end:])
                end = end + int(ahead[0]) + 1 if len(ahead) else len(raw)
        yield at, end
        at = end


def word_hashes(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of UTF-8 ``texts`` (A-Z as a-z), and where each text's words begin and end.

    Words are maximal runs without ASCII white space. Text ``i`` has the hashes
    ``[bounds[i], bounds[i + 1])``. Memory beyond the result is some 40 bytes per
    byte of a half-megabyte stretch (or of the longest word).
    """
    raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    space = SPACE[raw]
    hashes, starts = [], []
    for at, end in _segments(raw, space):
        gap = space[at:end]
        edges = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).view(np.int8)))
        first, past = edges[::2], edges[1::2]
        power, inverse = _powers(max(_SEGMENT, 1 << (end - at - 1).bit_length()))
        summed = np.zeros(end - at + 1, np.uint64)
        np.cumsum(_BYTE[raw[at:end]] * power[: end - at], out=summed[1:])
        word = (summed[past] - summed[first]) * inverse[first]
        hashes.append(mix(word + (past - first).astype(np.uint64) * _STEP))
        starts.append(first + at)
    begin = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts]))).astype(np.int64)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), begin)


def shingle_sets(texts: Sequence[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's runs of ``size`` words; fewer words make one shingle, none make none."""
    hashes, bounds = word_hashes(texts)
    sets = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        words = hashes[a:b]
        if len(words) >= size:
            sets.append(np.unique(fold([words[i : len(words) - size + 1 + i] for i in range(size)])))
        elif len(words):
            sets.append(fold([words[i : i + 1] for i in range(len(words))]))
        else:
            sets.append(words)
    return sets
