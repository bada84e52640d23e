"""Words of many texts at once, as 64-bit hashes in NumPy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import ragged, string_bytes

#: Fixed values of the splitmix64 generator.
_GOLDEN, _MIX1, _MIX2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_MASK = (1 << 64) - 1
#: White space of the contracts: the blank and the codes 9 to 13.
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: For tokens of letters and digits: all other ASCII codes separate.
NOT_ALNUM = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
LOWER = np.array([i + 32 if 65 <= i <= 90 else i for i in range(256)], np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x + _GOLDEN).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(256, dtype=np.uint64))
_P = 0xD6E8FEB86659FD93  # an odd multiplier and its inverse modulo 2**64
_P_INVERSE = pow(_P, -1, 1 << 64)
#: Bytes, or words, whose running sums are held at a time; a longer single word is a step of its own.
STEP = 1 << 17
_POWERS: dict[int, np.ndarray] = {}


def _geometric(base: int, n: int) -> np.ndarray:
    out = np.ones(1 << max(0, n - 1).bit_length(), np.uint64)
    size = 1
    while size < len(out):
        out[size : 2 * size] = out[:size] * np.uint64(pow(base, size, 1 << 64))
        size *= 2
    return out


def powers(base: int, n: int) -> np.ndarray:
    """base**0, base**1, ... modulo 2**64, at least n of them; what is kept for the next call is 2 * STEP of them."""
    if n > 2 * STEP:
        return _geometric(base, n)[:n]
    if base not in _POWERS:
        _POWERS[base] = _geometric(base, 2 * STEP)
    return _POWERS[base][:n]


def _runs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The polynomial hash of values[start:end] for each run, from one running sum."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(_P, len(values)), out=total[1:])
    return mix((total[ends] - total[starts]) * powers(_P_INVERSE, len(values) + 1)[starts] + (ends - starts).astype(np.uint64))


class Words:
    """The words of a string array: hashes, byte places, and the first word of each text (firsts has one more)."""

    def __init__(self, text: pa.Array, lower: bool = False, separators: np.ndarray = SPACE):
        self.data, offsets = string_bytes(text)
        data = LOWER[self.data] if lower else self.data
        n = len(data)
        inside = np.zeros(n + 1, bool)
        inside[:n] = ~separators[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.concatenate([[False], inside[:-1]])
        self.starts = np.flatnonzero(inside & (~before | edge))
        self.ends = np.flatnonzero((before & (~inside | edge)))
        self._lower = data
        self.hashes = self.prefixes(1 << 62)
        self.firsts = np.searchsorted(self.starts, offsets)

    def prefixes(self, size: int) -> np.ndarray:
        """The hash of the first `size` bytes of each word; of a shorter word its own."""
        out = np.empty(len(self.starts), np.uint64)
        a = 0
        while a < len(out):
            low = int(self.starts[a])
            b = max(a + 1, int(np.searchsorted(self.ends, low + STEP, side="right")))
            values = _BYTE[self._lower[low : int(self.ends[b - 1])]]
            out[a:b] = _runs(values, self.starts[a:b] - low, np.minimum(self.ends[a:b], self.starts[a:b] + size) - low)
            a = b
        return out

    def lowered(self, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The bytes of some ranges, as words are hashed, one range after the other."""
        return self._lower[ragged(starts, lengths)]

    def text_of(self) -> np.ndarray:
        """The number of the text of each word."""
        return np.repeat(np.arange(len(self.firsts) - 1), np.diff(self.firsts))

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The first words of all windows of so many words inside one text, and the hashes of the windows."""
        n = len(self.hashes)
        room = np.repeat(self.firsts[1:], np.diff(self.firsts)) - np.arange(n)
        starts = np.flatnonzero(room >= size)
        out = np.empty(len(starts), np.uint64)
        for low in range(0, n, STEP):
            a, b = np.searchsorted(starts, [low, low + STEP])
            if a < b:
                out[a:b] = _runs(self.hashes[low : low + STEP + size], starts[a:b] - low, starts[a:b] - low + size)
        return starts, out
