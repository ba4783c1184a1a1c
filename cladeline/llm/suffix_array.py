"""Suffix arrays in numpy: Larsson-Sadakane refinement, Kasai's common prefixes, merging by binary search."""

from __future__ import annotations

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions of ``text`` (bytes) in the order of what starts there.

    The first 8 bytes are sorted as one number; then every group that is still tied is sorted by the rank of what follows
    at twice the distance each time, and groups of one are left alone.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    key = np.ascontiguousarray(sliding_window_view(np.r_[text, np.zeros(8, np.uint8)], 8)[:n]).view(">u8").reshape(-1).astype(np.uint64)
    sa = np.argsort(key)
    key = key[sa]
    differs = np.r_[key[1:] != key[:-1], True]
    rank = np.empty(n, np.int64)
    ends = np.flatnonzero(differs)
    sizes = np.diff(np.r_[-1, ends])
    rank[sa] = np.repeat(ends, sizes)  # a group's rank is its last slot
    slots = np.flatnonzero(np.repeat(sizes, sizes) > 1)
    h = 8
    while len(slots):
        at = sa[slots]
        after = at + h
        follow = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        both = rank[at] * (n + 1) + follow
        order = np.argsort(both)
        at, both = at[order], both[order]
        sa[slots] = at
        ends = np.flatnonzero(np.r_[both[1:] != both[:-1], True])
        sizes = np.diff(np.r_[-1, ends])
        rank[at] = np.repeat(slots[ends], sizes)
        slots = slots[np.repeat(sizes, sizes) > 1]
        h *= 2
    return sa


def common_prefixes(text: np.ndarray, sa: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int) -> np.ndarray:
    """For each slot, how many bytes (``most`` at most) its suffix shares with the one before it.

    ``text`` is made of pieces [starts, ends), and a prefix stops at the end of its piece.  This is
    Kasai's walk, in which the shared length falls by one at most from a position to the next, taken
    through all pieces in step.
    """
    n = len(text)
    lcp = np.zeros(n, np.int64)
    if n == 0:
        return lcp
    slot = np.empty(n, np.int64)
    slot[sa] = np.arange(n)
    stop = np.zeros(n, np.int64)
    lengths = ends - starts
    inside = np.repeat(starts - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(lengths.sum())
    stop[inside] = np.repeat(ends, lengths)
    shared = np.zeros(len(starts), np.int64)
    for step in range(int(lengths.max(initial=0))):
        piece = np.flatnonzero(lengths > step)
        i = starts[piece] + step
        k = np.maximum(shared[piece] - 1, 0)
        own = slot[i]
        j = np.where(own > 0, sa[own - 1], -1)
        room = np.where(j >= 0, np.minimum(np.minimum(ends[piece] - i, stop[j] - j), most), 0)
        k = np.minimum(k, np.maximum(room, 0))
        live = np.flatnonzero(k < room)
        while len(live):
            live = live[text[i[live] + k[live]] == text[j[live] + k[live]]]
            k[live] += 1
            live = live[k[live] < room[live]]
        lcp[own] = k
        shared[piece] = k
    return lcp


def window_groups(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Start positions of all ``width``-byte strings inside pieces, sorted by string, and each one's group number.

    Pieces are followed by a byte that occurs in none of them.
    """
    sa = suffix_array(text)
    lcp = common_prefixes(text, sa, starts, ends, width)
    whole = np.zeros(len(text), bool)
    for_sure = np.maximum(ends - starts - width + 1, 0)
    inside = np.repeat(starts - np.r_[0, np.cumsum(for_sure)[:-1]], for_sure) + np.arange(for_sure.sum())
    whole[inside] = True
    group = np.cumsum(lcp < width)
    keep = whole[sa]
    return sa[keep], group[keep]


def windows_at(text: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """The strings that start at the positions, as fixed-width byte strings."""
    if not len(at):
        return np.zeros(0, f"S{width}")
    return np.ascontiguousarray(sliding_window_view(text, width)[at]).view(f"S{width}").reshape(-1)


def merge_minima(parts: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """parts: (sorted distinct strings, value of each) -> per part, the least value over all parts.

    Each part's strings are found in the others by binary search.
    """
    out = [values.copy() for _, values in parts]
    for p, (left, lv) in enumerate(parts):
        for q, (right, rv) in enumerate(parts):
            if p < q and len(left) and len(right):
                at = np.minimum(np.searchsorted(left, right), len(left) - 1)
                hit = np.flatnonzero(left[at] == right)
                np.minimum.at(out[p], at[hit], rv[hit])
                out[q][hit] = np.minimum(out[q][hit], lv[at[hit]])
    return out
