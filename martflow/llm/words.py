"""Words of whole texts as numbers, without a Python object for each word.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed
and carriage return.  Every word gets two independent 64-bit hashes, computed for all
words of a batch at once: the bytes' random values times powers of an odd number,
summed and mixed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_SLICE = 1 << 21
_LONGEST = 1 << 12
_RNG = np.random.Generator(np.random.PCG64(20240101))
_VALUES = _RNG.integers(1, 1 << 63, size=(2, 256), dtype=np.uint64)


def _powers(base: int) -> np.ndarray:
    out = np.empty(_LONGEST, dtype=np.uint64)
    out[0] = 1
    out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


_POWERS = (_powers(0x9E3779B97F4A7C15), _powers(0xD6E8FEB86659FD93))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers over the whole range (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bounds(blob: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word in an array of bytes."""
    edge = np.ones(len(blob) + 2, dtype=np.int8)
    edge[1:-1] = SPACE[blob]
    step = np.diff(edge)
    return np.flatnonzero(step == -1), np.flatnonzero(step == 1)


def _hashes(blob: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    length = end - start
    chars = blob[~SPACE[blob]]
    first = np.cumsum(length) - length
    at = np.arange(len(chars)) - np.repeat(first, length)
    long = np.flatnonzero(length > _LONGEST)
    if len(long):
        at %= _LONGEST
    out = np.empty((2, len(start)), dtype=np.uint64)
    for k in range(2):
        out[k] = mix(np.add.reduceat(_VALUES[k][chars] * _POWERS[k][at], first) + length.astype(np.uint64))
    for i in long:  # too long for the powers: hash the bytes themselves
        d = xxhash.xxh3_128_intdigest(blob[start[i] : end[i]].tobytes())
        out[0, i], out[1, i] = d & (2**64 - 1), d >> 64
    return out


@dataclass
class Words:
    """Hashes of the words of several texts, one after another."""

    hashes: np.ndarray  # (2, words)
    counts: np.ndarray  # words of each text

    @property
    def offsets(self) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(self.counts)))


def words_of(texts: list[str | None]) -> Words:
    """Words of each text; a null text has none."""
    blobs = [(t or "").encode() for t in texts]
    sizes = np.array([len(b) + 1 for b in blobs], dtype=np.int64)
    blob = np.frombuffer(b" ".join([*blobs, b""]), dtype=np.uint8)
    found, starts, at = [], [], 0
    while at < len(blob):
        stop = at + _SLICE
        while stop < len(blob):  # cut at a space only
            gap = np.flatnonzero(SPACE[blob[stop : stop + 65536]])
            if len(gap):
                stop += int(gap[0])
                break
            stop += 65536
        part = blob[at:stop]
        s, e = bounds(part)
        if len(s):
            found.append(_hashes(part, s, e))
            starts.append(s + at)
        at = stop
    if not found:
        return Words(np.empty((2, 0), dtype=np.uint64), np.zeros(len(texts), dtype=np.int64))
    edges = np.concatenate(([0], np.cumsum(sizes)))
    return Words(np.concatenate(found, axis=1), np.diff(np.searchsorted(np.concatenate(starts), edges)))


_STEP = (np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def runs(hashes: np.ndarray, width: int, k: int = 0) -> np.ndarray:
    """Hash of each run of ``width`` consecutive words (by the ``k``-th word hash);
    empty if there are fewer words.  Runs over the border of two texts are included:
    leave them out with ``within``."""
    n = hashes.shape[1] - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = hashes[k, :n].copy()
    for i in range(1, width):
        out *= _STEP[k]
        out += hashes[k, i : n + i]
    return mix(out)


def within(counts: np.ndarray, width: int) -> np.ndarray:
    """Positions (over all texts) at which a run of ``width`` words starts and ends
    in the same text."""
    offsets = np.cumsum(counts) - counts
    n = np.maximum(counts - width + 1, 0)
    return np.repeat(offsets - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
