"""Suffix arrays of many short byte strings, in numpy."""

from __future__ import annotations

import numpy as np

BITS = 21
LIMIT = (1 << BITS) - 1
U = np.uint64
STRIDE = 64


def suffix_array(data: np.ndarray, owner: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Start positions in suffix order.  `owner` and `end` give the string of each position and where it ends.

    Larsson-Sadakane refinement: groups of suffixes that agree on their first h bytes are split by the rank of what
    follows those bytes; groups of one are left alone.  A string ends in a sign of its own, below all bytes.
    """
    n = len(data)
    if n > LIMIT:
        raise ValueError("too many bytes for one suffix array")
    at = np.arange(n)
    codes = np.append(data.astype(U) + U(1), np.zeros(4, U))
    key = np.zeros(n, U)
    for k in range(4):
        key = key << U(9) | np.where(at + k < end, codes[k : n + k], U(0))
    packed = np.sort(key << U(BITS) | at.astype(U))
    sa = (packed & U(LIMIT)).astype(np.int64)
    head = np.ones(n + 1, bool)
    head[1:n] = packed[1:] >> U(BITS) != packed[:-1] >> U(BITS)
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(head[:n], at, 0))
    strings, h = int(owner.max(initial=0)) + 1, 4
    if strings + n > 1 << (BITS + 1):
        raise ValueError("too many strings for one suffix array")
    while len(slots := np.flatnonzero(~(head[:-1] & head[1:]))):
        s = sa[slots]
        then = s + h
        follow = np.where(then >= end[s], owner[s], strings + rank[np.minimum(then, n - 1)])
        packed = np.sort(rank[s].astype(U) << U(2 * BITS + 1) | follow.astype(U) << U(BITS) | s.astype(U))
        s = (packed & U(LIMIT)).astype(np.int64)
        new = np.ones(len(slots), bool)
        new[1:] = packed[1:] >> U(BITS) != packed[:-1] >> U(BITS)
        sa[slots], head[slots] = s, new
        rank[s] = np.maximum.accumulate(np.where(new, slots, 0))
        h *= 2
    return sa


def common_prefixes(data: np.ndarray, end: np.ndarray, sa: np.ndarray, cap: int) -> np.ndarray:
    """For each slot of `sa`, the bytes its suffix shares with the one before, `cap` at most.

    Kasai's order: position i shares at least what i - 1 shares, less one.  Lanes STRIDE apart go side by side.
    """
    n = len(data)
    before = np.full(n, -1)
    before[sa[1:]] = sa[:-1]
    wide = np.append(data.astype(U), np.zeros(cap + 16, U))
    eight = np.zeros(n + cap + 8, U)
    for k in range(8):
        eight = eight << U(8) | wide[k : k + len(eight)]
    shared = np.zeros(n, np.int64)
    lanes = np.arange(0, n, STRIDE)
    carry = np.zeros(len(lanes), np.int64)
    for offset in range(STRIDE):
        i = lanes + offset
        i = i[i < n]
        j = before[i]
        length = np.maximum(carry[: len(i)] - 1, 0)
        room = np.where(j < 0, 0, np.minimum(end[i] - i, end[j] - j))
        length = np.minimum(length, room)
        open_ = np.flatnonzero((length < room) & (length < cap))
        while len(open_):
            a, b, l = i[open_], j[open_], length[open_]
            differ = eight[a + l] ^ eight[b + l]
            zero = np.zeros(len(open_), np.int64)
            for k in range(1, 9):
                zero += differ >> U(64 - 8 * k) == 0
            length[open_] = np.minimum(l + zero, room[open_])
            open_ = open_[(zero == 8) & (length[open_] < room[open_]) & (length[open_] < cap)]
        shared[i] = length
        carry[: len(i)] = length
    return np.minimum(shared[sa], cap)
