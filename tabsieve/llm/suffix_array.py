"""Suffix arrays by Larsson-Sadakane refinement and common prefixes by Kasai's recurrence, in numpy."""

from __future__ import annotations

import numpy as np


#: A difference of two packed numbers is under the k-th of these if their first k + 1 bytes agree.
_BELOW = np.array([1 << (56 - 8 * k) for k in range(8)], dtype=np.uint64)


def packed(data: np.ndarray) -> np.ndarray:
    """The next eight bytes from each position as one big-endian number, zero-padded at the end; by doubling."""
    n, out = len(data), data.astype(np.uint64)
    for k in (1, 2, 4):
        wide = out << np.uint64(8 * k)
        wide[: max(n - k, 0)] |= out[k:]
        out = wide
    return out


#: Tied suffixes that are sorted at a time; a larger group is sorted whole.
SLICE = 1 << 18


def _first_order(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Suffixes by as many bytes as fit into a word beside their place; where a new value begins; that number of bytes."""
    n = len(data)
    held = np.zeros(256, dtype=np.uint64)
    used = np.flatnonzero(np.bincount(data, minlength=256))
    held[used] = np.arange(1, len(used) + 1)  # 0: past the end
    wide, place = len(used).bit_length(), max(1, (n - 1).bit_length())
    k = (64 - place) // wide
    code = held[data]
    key = code.copy()
    for j in range(1, k):
        key <<= np.uint64(wide)
        key[: max(n - j, 0)] |= code[j:]
    key <<= np.uint64(place)
    key |= np.arange(n, dtype=np.uint64)
    key.sort()
    sa = (key & np.uint64((1 << place) - 1)).astype(np.int64)
    key >>= np.uint64(place)
    return sa, np.append(True, key[1:] != key[:-1]), k


def suffix_array(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order and ranks of a byte array.

    Suffixes are sorted by their first bytes; then, as in Larsson and Sadakane, only groups that are still tied are
    refined, by the rank of the suffix h places on, with h doubling.  Groups are independent of one another and are
    sorted some at a time, as words that hold a group, a rank and a place.
    """
    n = len(data)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    sa, head, h = _first_order(data)
    kind = np.int32 if n < 1 << 31 else np.int64
    rank = np.empty(n, dtype=kind)
    rank[sa] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    many = ~(head & np.append(head[1:], True))  # places in sa whose group has several members
    tied, lead = np.flatnonzero(many), head[many]
    ranks = np.uint64(n.bit_length())
    while len(tied):
        begins = np.flatnonzero(lead)
        cuts = np.unique(np.append(begins[np.searchsorted(begins, np.arange(0, len(tied), SLICE))[: -(-len(tied) // SLICE)].clip(max=len(begins) - 1)], len(tied)))
        left, fresh = [], []
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            where, at = tied[a:z], sa[tied[a:z]]
            ahead = at + h
            nxt = rank[np.minimum(ahead, n - 1)].astype(np.uint64) + np.uint64(1)
            nxt[ahead >= n] = 0  # a suffix that ends within h bytes is shorter than any it ties with
            bits = np.uint64(max(1, int(z - a - 1).bit_length()))
            key = ((np.cumsum(lead[a:z]) - 1).astype(np.uint64) << ranks) | nxt
            if int(key[-1]).bit_length() + int(bits) <= 64:
                key = (key << bits) | np.arange(z - a, dtype=np.uint64)
                key.sort()
                at = at[(key & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)]
                key >>= bits
            else:  # hundreds of megabytes in one array
                order = np.argsort(key)
                at, key = at[order], key[order]
            sa[where] = at
            new = np.append(True, key[1:] != key[:-1])
            rank[at] = np.maximum.accumulate(np.where(new, where, 0))
            stay = ~(new & np.append(new[1:], True))
            left.append(where[stay])
            fresh.append(new[stay])
        tied, lead = np.concatenate(left), np.concatenate(fresh)
        h *= 2
    return sa, rank


def common_prefixes(data: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Longest common prefix of each suffix with the one before it in order (0 for the first).

    Kasai's recurrence in text order is PLCP[i] >= PLCP[i-1] - 1, with equality wherever the characters before
    suffix i and before its predecessor agree.  Only the other places are compared, eight bytes a step and all at
    once; the rest follow from the nearest compared place on their left.
    """
    n = len(data)
    if n == 0:
        return np.empty(0, np.int64)
    kind = np.int32 if n < 1 << 31 else np.int64
    before = np.full(n, -1, dtype=kind)
    before[sa[1:]] = sa[:-1]
    reducible = np.zeros(n, dtype=bool)
    reducible[1:] = (data[np.maximum(before[1:] - 1, 0)] == data[:-1]) & (before[1:] > 0)
    start = np.flatnonzero(~reducible & (before >= 0))
    words = packed(data)
    length = np.zeros(n, dtype=kind)
    a, b, who = start, before[start].astype(np.int64), start
    done = 0
    while len(who):
        inside = n - np.maximum(a, b)
        differ = words[np.minimum(a, n - 1)] ^ words[np.minimum(b, n - 1)]
        same = (differ == 0) & (inside >= 8)
        stop = ~same
        more = np.zeros(np.count_nonzero(stop), dtype=kind)
        for k in range(8):  # equal leading bytes
            more += differ[stop] < _BELOW[k]
        length[who[stop]] = done + np.minimum(more, inside[stop])
        done += 8
        a, b, who = a[same] + 8, b[same] + 8, who[same]
    place = np.arange(n, dtype=kind)
    source = np.maximum.accumulate(np.where(reducible, 0, place))
    plcp = np.maximum(length[source] - (place - source), 0)
    lcp = plcp[sa]
    lcp[0] = 0
    return lcp
