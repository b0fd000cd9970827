"""Vectorised pre-tokenisation: the split that byte-level BPE makes before any merge.

The split is that of the pattern  's|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?other+|S+(?!non-S)|S+  where L, N and S are
letters, numbers and white space. As the alternatives only look at runs of one class, at one preceding blank
and at contractions, piece borders follow from run borders by array operations.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from . import _text as tx

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4


class Splitter:
    """Splits slices of UTF-8 text into pieces. classify gives the class of one character that isn't known yet."""

    def __init__(self, classify: Callable[[str], int]):
        self.classify = classify
        self.known = np.zeros(0x110000, np.uint8)
        for cp in range(0x180):
            self.known[cp] = classify(chr(cp))
        self.ascii = self.known[:256].copy()
        self.ascii[128:] = 0

    def classes(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class, byte position) of every character of the buffer."""
        cls = self.ascii[buf]
        lead = (buf & 0xC0) != 0x80
        if cls.all():
            return cls, np.arange(len(buf))
        at = np.flatnonzero(lead)
        cls = cls[at]
        odd = np.flatnonzero(cls == 0)
        pos = at[odd]
        b0 = buf[pos].astype(np.int64)
        wide = np.zeros(4 + len(buf), np.int64)
        wide[: len(buf)] = buf & 0x3F
        c1, c2, c3 = wide[pos + 1], wide[pos + 2], wide[pos + 3]
        cp = np.where(b0 < 0xE0, (b0 & 0x1F) << 6 | c1, np.where(b0 < 0xF0, (b0 & 0x0F) << 12 | c1 << 6 | c2, (b0 & 0x07) << 18 | c1 << 12 | c2 << 6 | c3))
        kinds = self.known[cp]
        if not kinds.all():
            for new in np.unique(cp[kinds == 0]):
                self.known[new] = self.classify(chr(int(new)))
            kinds = self.known[cp]
        cls[odd] = kinds
        return cls, at

    def starts(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Byte positions at which pieces start, in order; each document starts one (if not empty)."""
        if not len(buf):
            return np.zeros(0, np.int64)
        cls, at = self.classes(buf)
        n = len(cls)
        doc = np.zeros(n + 1, bool)
        doc[np.searchsorted(at, offsets[:-1][offsets[:-1] < len(buf)])] = True
        doc[n] = True
        edge = doc[:-1].copy()
        edge[1:] |= cls[1:] != cls[:-1]
        run_starts = np.flatnonzero(edge)
        run_ends = np.append(run_starts[1:], n)
        start = edge
        # White space: all but its last character is one piece; the last one joins what follows if it is a blank.
        ws = cls[run_starts] == SPACE
        last = run_ends[ws] - 1
        followed = ~doc[run_ends[ws]]
        last, nxt = last[followed], run_ends[ws][followed]
        start[last] = True
        blank = buf[at[last]] == 0x20
        start[nxt[blank]] = False
        # Contractions: a lone apostrophe that starts a piece takes s, t, m, d, re, ve or ll from the letters after it.
        apos = np.flatnonzero((cls == OTHER) & start & (buf[at] == 0x27))
        apos = apos[apos + 1 < n]
        apos = apos[(cls[apos + 1] == LETTER) & ~doc[apos + 1]]
        if len(apos):
            safe = np.append(at, [len(buf)] * 4)
            ch = np.append(buf, [0, 0, 0, 0])
            one, two = ch[safe[apos + 1]], ch[safe[apos + 2]]
            inside = ~np.append(doc, [True] * 4)[apos + 2]
            single = np.isin(one, np.frombuffer(b"stmd", np.uint8))
            double = inside & (((one == 0x72) & (two == 0x65)) | ((one == 0x76) & (two == 0x65)) | ((one == 0x6C) & (two == 0x6C)))
            taken = np.where(single, 1, np.where(double, 2, 0))
            hit = taken > 0
            start[apos[hit] + 1] = False
            then = apos[hit] + 1 + taken[hit]
            ok = then < n
            then = then[ok]
            start[then[~doc[then]]] = True
        return at[np.flatnonzero(start)]


def unique_pieces(buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first start, end, inverse) of the distinct pieces of a slice."""
    ends = np.append(starts[1:], len(buf))
    hashes = tx.span_hash(tx.prefix_hash(buf), starts, ends)
    values, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    return values, starts[first], ends[first], inverse
