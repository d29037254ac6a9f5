"""Repeated strings of a minimum length by threshold-bounded interval expansion.

Intervals of the suffix array are expanded breadth first by backward steps on the
Burrows-Wheeler transform: from the interval of a string to those of the string with
one more byte in front.  The end of an interval met at length n for the first time
has a longest common prefix of n - 1 with its successor, so prefixes come out by
increasing value, and the expansion stops at the minimum length.  Neighbours whose
prefix is unknown by then share at least that much.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray, least: int | None = None) -> np.ndarray:
    """Suffix array by prefix doubling from packed symbols; by the first ``least`` symbols if given, ties in any order.

    All separators, symbols from 256 on, count as one symbol.  Intervals of strings of
    up to ``least`` symbols are the same whichever way ties fall.
    """
    n, h = len(text), 7
    symbol = np.minimum(text, 256).astype(np.int64) + 1
    key = np.zeros(n, dtype=np.int64)
    for d in range(h):  # seven symbols of nine bits
        key[: max(n - d, 0)] |= symbol[d:] << (9 * (h - 1 - d))
    while True:
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        if rank[order[-1]] == n - 1 or (least is not None and h >= least):
            return order
        key = rank * (n + 1)
        key[: max(n - h, 0)] += rank[h:] + 1
        h *= 2


def short_prefix_ends(text: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """For each suffix in order: whether it shares fewer than ``least`` bytes with the one before.

    Symbols from 256 on are separators; strings that hold one are not expanded, and their marks say nothing.
    """
    n = len(text)
    last = text[order - 1]  # the transform; order 0 wraps around
    keys = last.astype(np.int64) * (n + 1) + np.arange(n)
    by_symbol = np.argsort(keys)
    keys = keys[by_symbol]  # place of the key: C[c] + rank(c, i)
    step = np.empty(n, dtype=np.int64)  # one backward step of each place
    step[by_symbol] = np.arange(n)
    present = np.unique(text)
    present = present[present < 256].astype(np.int64)
    marked = np.zeros(n + 1, dtype=bool)
    low = np.searchsorted(keys, present * (n + 1))
    high = np.searchsorted(keys, (present + 1) * (n + 1))
    marked[high] = True
    for _ in range(1, least):
        if not len(low):
            break
        width = high - low
        # Single places take one step, narrow intervals step from each of their places, wide ones are asked for every symbol.
        single = low[width == 1]
        single = step[single[last[single] < 256]]
        narrow = (width > 1) & (width <= len(present))
        owner = np.repeat(np.flatnonzero(narrow), width[narrow])
        ends = np.cumsum(width[narrow])
        place = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - width[narrow], width[narrow]) + low[owner]
        symbol = last[place].astype(np.int64)
        inner = symbol < 256
        met = np.sort((owner[inner] * 256 + symbol[inner]) * (n + 1) + step[place[inner]])
        pair = met // (n + 1)
        cut = np.flatnonzero(pair[1:] != pair[:-1]) + 1
        heads = np.concatenate(([0], cut)) if len(met) else cut
        tails = np.concatenate((cut - 1, [len(met) - 1])) if len(met) else cut
        wide = np.flatnonzero(width > len(present))
        base = np.tile(present * (n + 1), len(wide))
        wide = np.repeat(wide, len(present))
        new_low = np.concatenate((single, met[heads] % (n + 1), np.searchsorted(keys, base + low[wide])))
        new_high = np.concatenate((single + 1, met[tails] % (n + 1) + 1, np.searchsorted(keys, base + high[wide])))
        fresh = (new_high > new_low) & ~marked[new_high]
        low, high = new_low[fresh], new_high[fresh]
        marked[high] = True
    marked[0] = True
    return marked[:n]


def repeated_windows(pieces: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, offset, group) of the ``least``-byte strings that occur twice or more, equal ones in one group."""
    lengths = np.array([len(p) for p in pieces])
    text = np.empty(int(lengths.sum()) + len(pieces), dtype=np.int32)
    starts = np.cumsum(lengths + 1) - (lengths + 1)
    for i, p in enumerate(pieces):
        text[starts[i] : starts[i] + len(p)] = np.frombuffer(p, dtype=np.uint8)
        text[starts[i] + len(p)] = 256 + i
    order = suffix_array(text, least)
    piece = np.repeat(np.arange(len(pieces)), lengths + 1)[order]
    offset = order - starts[piece]
    valid = offset + least <= lengths[piece]
    breaks = short_prefix_ends(text, order, least) | ~valid | ~np.concatenate(([False], valid[:-1]))
    group = np.cumsum(breaks)
    sizes = np.bincount(group)
    keep = np.flatnonzero(valid & (sizes[group] > 1))
    return piece[keep], offset[keep], group[keep]
