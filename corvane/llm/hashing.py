"""64-bit hashes of words and shingles, for whole blocks of texts at once.

Edge cases: a null or empty text has no words and no shingles; one with fewer words than a
shingle has its whole sequence as one; texts of any length are hashed in slices that end
with a word; bytes that aren't UTF-8 are hashed as they are.
"""

from __future__ import annotations

import numpy as np

_CODE = np.random.default_rng(19990701).integers(0, 2**64, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_FACTORS = np.random.default_rng(7).integers(0, 2**64, 16, dtype=np.uint64) | np.uint64(1)
SLICE = 1 << 18
_power: list[np.ndarray] = []


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def _powers(n: int) -> list[np.ndarray]:
    if not _power or len(_power[0]) < n:
        _power.clear()
        for x in (_BASE, pow(_BASE, -1, 2**64)):
            p = np.full(max(n, SLICE + 4096), x, np.uint64)
            p[0] = 1
            _power.append(np.cumprod(p))
    return _power


def _words_of(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    solid = ~_SPACE[data]
    before = np.zeros(len(data), bool)
    before[1:] = solid[:-1]
    before[breaks[breaks < len(data)]] = False
    start = np.flatnonzero(solid & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = solid[1:]
    inner = breaks[(breaks > 0) & (breaks <= len(data))]
    after[inner - 1] = False
    end = np.flatnonzero(solid & ~after) + 1
    ahead, back = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_CODE[_LOWER[data]] * ahead[: len(data)], out=sums[1:])
    return start, mixed((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the words (runs without space, tab to carriage return; A-Z lower-cased) of texts end to end."""
    starts, hashes, at = [], [], 0
    while at < len(data):
        to = min(len(data), at + SLICE)
        while to < len(data):  # cut where a word ends
            gaps = np.flatnonzero(_SPACE[data[max(at, to - 4096) : to]])
            if len(gaps):
                to = max(at, to - 4096) + int(gaps[-1]) + 1
                break
            to = min(len(data), to + SLICE)
        inside = offsets[(offsets >= at) & (offsets <= to)] - at
        s, h = _words_of(data[at:to], inside)
        starts.append(s + at)
        hashes.append(h)
        at = to
    if not starts:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    start = np.concatenate(starts)
    return np.searchsorted(offsets, start, side="right") - 1, np.concatenate(hashes)


class Recent:
    """Which fingerprints came lately: a table of fixed size, in which a later one takes the place of an earlier one.

    It may forget, so it only spares work; what must be distinct is made so elsewhere.
    """

    def __init__(self, bits: int = 18) -> None:
        self.table, self.mask = np.zeros(1 << bits, np.uint64), (1 << bits) - 1

    def holds(self, f: int) -> bool:
        """Whether f is in the table; it is from now on."""
        at = f & self.mask
        if int(self.table[at]) == f:
            return True
        self.table[at] = f
        return False


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its word shingles; of fewer words, one for the whole sequence."""
    row, h = word_hashes(data, offsets)
    bounds = np.searchsorted(row, np.arange(len(offsets)))
    total = np.zeros(max(0, len(h) - width + 1), np.uint64)
    for k in range(width):
        total += h[k : k + len(total)] * _FACTORS[k]
    total = mixed(total)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= width:
            s = np.sort(total[a : b - width + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            whole = (h[a:b] * _FACTORS[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mixed(np.array([whole], np.uint64) ^ np.uint64(0x5851F42D4C957F2D)))
        else:
            out.append(np.empty(0, np.uint64))
    return out
