"""Vectorised 64-bit hashing over numpy arrays (wrap-around arithmetic on uint64)."""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Entries of power tables that stay in memory, for each base.
KEPT_POWERS = 2_500_000
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser that spreads every input bit over the word."""
    x = np.asarray(x, dtype=U)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE_VALUES = mix((np.arange(1, 257, dtype=U)) * U(0x9E3779B97F4A7C15))


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    held = _POWERS.get(base)
    if held is None or len(held[0]) < n:
        size = max(n, 1 << 12)
        inverse = pow(base, -1, 1 << 64)
        up, down = np.full(size, base, dtype=U), np.full(size, inverse, dtype=U)
        up[0] = down[0] = 1
        held = (np.multiply.accumulate(up), np.multiply.accumulate(down))
        if size <= KEPT_POWERS:  # tables for longer inputs are not kept
            _POWERS[base] = held
    return held


class Rolling:
    """Hashes of any span of a sequence in constant time, from one prefix sum."""

    def __init__(self, values: np.ndarray, which: int = 0):
        base = _BASES[which]
        n = len(values)
        up, self.down = _powers(base, n + 1)
        self.prefix = np.empty(n + 1, dtype=U)
        self.prefix[0] = 0
        np.cumsum(values * up[:n], out=self.prefix[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of values[start:end] for each pair; position-independent."""
        return mix((self.prefix[end] - self.prefix[start]) * self.down[start])

    def grams(self, k: int) -> np.ndarray:
        """Hash of every window of k values, by start."""
        n = len(self.prefix) - k
        if n <= 0:
            return np.empty(0, dtype=U)
        return mix((self.prefix[k:] - self.prefix[:n]) * self.down[:n])


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE_VALUES[data]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, by doubling."""
    if len(x) < w:
        return np.empty(0, dtype=x.dtype)
    span, m = 1, x
    while span * 2 <= w:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    rest = w - span
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def least_grams(data: np.ndarray, k: int, width: int, block: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
    """Even hashes of all grams of k bytes, and the smallest of the `width` grams from each place on.

    Works block by block, so that all intermediate arrays stay in the processor's cache.
    """
    n = max(len(data) - k + 1, 0)
    grams, least = np.empty(n, dtype=U), np.empty(max(n - width + 1, 0), dtype=U)
    for a in range(0, len(least), block):
        z = min(len(least), a + block)
        own = Rolling(byte_values(data[a : z + k + width - 2])).grams(k) & ~U(1)
        grams[a : a + len(own)] = own
        least[a:z] = sliding_min(own, width)
    return grams, least


def words_of(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of word bytes: start, end and document number of each; runs stop at document ends."""
    flags = is_word[data]
    n = len(data)
    if not n:
        e = np.empty(0, dtype=np.int64)
        return e, e, e
    first = flags.copy()
    first[1:] &= ~flags[:-1]
    cut = offsets[(offsets > 0) & (offsets < n)]
    first[cut] = flags[cut]
    last = flags.copy()
    last[:-1] &= ~flags[1:]
    last[cut - 1] = flags[cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def class_table(*ranges: tuple[int, int]) -> np.ndarray:
    """Boolean table over byte values, true outside the given inclusive ranges."""
    t = np.ones(256, dtype=bool)
    for a, b in ranges:
        t[a : b + 1] = False
    return t


#: Word bytes of [^\x20\x09-\x0D]+ and of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+.
NOT_SPACE = class_table((0x20, 0x20), (0x09, 0x0D))
ALNUM_OR_HIGH = class_table((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
_lower = np.arange(256, dtype=np.uint8)
_lower[0x41:0x5B] += 0x20
#: A-Z to a-z, other bytes unchanged.
LOWER = _lower
