"""Two-stage suffix sorting of many short segments, with adjacent common prefixes.

A position is small if the suffix that starts there is less than the one that starts after it. Small suffixes are
sorted directly. The rest is induced: buckets by first byte are scanned in order, and each suffix that is met puts the
one before it, if that isn't small, at the end of what its bucket has so far; in a bucket these come before the small
ones. No comparison of the rest is made. Suffixes are compared over DEPTH bytes.
"""

from __future__ import annotations

import numpy as np


def big_endian(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as one number that sorts as they do."""
    padded = np.concatenate([text, np.zeros(264, np.uint8)]).astype(np.uint64)
    n = len(text) + 256
    out = np.zeros(n, np.uint64)
    for i in range(8):
        out |= padded[i : i + n] << np.uint64(56 - 8 * i)
    return out


def direct_sort(at: np.ndarray, key8: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their next depth bytes."""
    if not len(at):
        return at
    keys = key8[at]
    order = np.argsort(keys, kind="stable")
    at, keys = at[order], keys[order]
    for done in range(8, depth, 8):
        same = keys[1:] == keys[:-1]
        if done == 8:
            tied = np.concatenate([same, [False]]) | np.concatenate([[False], same])
            where = np.flatnonzero(tied)
            group = np.cumsum(np.concatenate([[True], ~same]))[where]
        else:
            edge = np.concatenate([[True], (group[1:] != group[:-1]) | ~same])
            group_new = np.cumsum(edge)
            single = np.concatenate([edge[1:], [True]]) & edge
            where, group = where[~single], group_new[~single]
        if not len(where):
            break
        own = at[where]
        keys = key8[own + done]
        order = np.lexsort((keys, group))
        at[where] = own[order]
        keys, group = keys[order], group[order]
    return at


def sort_suffixes(text: np.ndarray, ends: np.ndarray, count: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, key8) of the first count[i] positions of each segment; segment i ends at ends[i].

    Each of these positions has depth bytes of its segment from there on.
    """
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    n = len(text)
    key8 = big_endian(text)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1].astype(np.int16))
    step[ends - 1] = -1
    known = np.where(step != 0, np.arange(n), n)
    following = np.minimum.accumulate(known[::-1])[::-1]
    small = step[np.minimum(following, n - 1)] > 0
    # Wanted positions, and after the last of a segment those on to the next small one, from which it is induced.
    next_small = np.minimum.accumulate(np.where(small, np.arange(n), n)[::-1])[::-1]
    last = begins + count - 1
    stop = np.where(small[last], last, np.minimum(next_small[last], ends - 1))
    flags = np.zeros(n + 1, np.int32)
    np.add.at(flags, begins, 1)
    np.add.at(flags, stop + 1, -1)
    used = np.cumsum(flags[:-1]) > 0
    first = np.zeros(n, bool)
    first[begins] = True
    direct = direct_sort(np.flatnonzero(used & small), key8, depth)
    head = text[direct]
    cuts = np.searchsorted(head, np.arange(257))
    queues: list[list[np.ndarray]] = [[] for _ in range(256)]
    tail = ends - 1
    tail = tail[used[tail] & ~small[tail]]
    for c in np.unique(text[tail]).tolist():
        queues[c].append(tail[text[tail] == c])
    out: list[np.ndarray] = []

    def induce(found: np.ndarray) -> None:
        before = found[~first[found]] - 1
        before = before[used[before] & ~small[before]]
        chars = text[before]
        for c in np.unique(chars).tolist():
            queues[c].append(before[chars == c])

    for c in range(256):
        i = 0
        while i < len(queues[c]):
            out.append(queues[c][i])
            induce(queues[c][i])
            i += 1
        queues[c] = []
        own = direct[cuts[c] : cuts[c + 1]]
        if len(own):
            out.append(own)
            induce(own)
    order = np.concatenate(out) if out else np.zeros(0, np.int64)
    wanted = np.zeros(n + 1, np.int32)
    np.add.at(wanted, begins, 1)
    np.add.at(wanted, begins + count, -1)
    return order[np.cumsum(wanted[:-1])[order] > 0], key8


def common_prefixes(order: np.ndarray, key8: np.ndarray, depth: int) -> np.ndarray:
    """Bytes, depth at most, that each suffix has in common with the one before it in the order (the first: 0)."""
    out = np.zeros(len(order), np.int64)
    if len(order) < 2:
        return out
    a, b = order[:-1], order[1:]
    open_ = np.arange(len(a))
    for done in range(0, depth, 8):
        differ = key8[a[open_] + done] ^ key8[b[open_] + done]
        hit = differ != 0
        bits = np.zeros(int(hit.sum()), np.int64)
        rest = differ[hit]
        for shift in (32, 16, 8):
            high = rest >> np.uint64(shift)
            larger = high != 0
            bits += np.where(larger, shift, 0)
            rest = np.where(larger, high, rest)
        out[open_[hit] + 1] = done + 7 - bits // 8
        open_ = open_[~hit]
        out[open_ + 1] = done + 8
        if not len(open_):
            break
    return np.minimum(out, depth)
