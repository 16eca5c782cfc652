"""Suffixes of a sequence in lexicographic order, equal ones found by comparing their symbols.

A suffix is told by the `width` symbols that begin at its position.  Fingerprints bring equal
suffixes together, and their symbols are then compared, so that a fingerprint alone never makes
two suffixes equal; distinct ones are sorted by their symbols.
"""

from __future__ import annotations

import numpy as np

U = np.uint64


def byte_loads(buf: np.ndarray, width: int) -> tuple[np.ndarray, list[int]]:
    """(codes, offsets): eight bytes in order as one number at every position, and the offsets that cover `width` bytes."""
    if width < 8:
        return buf.astype(U), list(range(width))
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    loads = np.ndarray((len(buf),), np.dtype(">u8"), padded, strides=(1,)).astype(U)
    return loads, [*range(0, width - 7, 8), *([width - 8] if width % 8 else [])]


def ordered(keys: np.ndarray) -> np.ndarray:
    """argsort of 64-bit keys, stable: the high bits with the place below them are sorted as plain numbers, ties of these by the rest."""
    bits = max(1, int(len(keys)).bit_length())
    order = np.sort((keys >> U(bits)) << U(bits) | np.arange(len(keys), dtype=U)) & U((1 << bits) - 1)
    order = order.astype(np.int64)
    k = keys[order]
    high = k >> U(bits)
    tied = np.flatnonzero((high[1:] == high[:-1]) & (k[1:] != k[:-1]))
    if len(tied):
        new = np.concatenate([[True], high[1:] != high[:-1]])
        group = np.cumsum(new)
        mixed = np.zeros(len(k) + 2, bool)
        mixed[group[tied]] = True
        some = np.flatnonzero(mixed[group])
        order[some] = order[some][np.lexsort((order[some], k[some], group[some]))]
    return order


class Suffixes:
    """codes: a number at each position; a suffix is codes[p + o] for o in offsets.  prints: equal for equal suffixes."""

    def __init__(self, codes: np.ndarray, offsets: list[int], prints: np.ndarray):
        self.codes, self.offsets, self.prints = codes, offsets, prints

    def groups(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the positions with equal suffixes next to each other, ascending; whether each begins a group)."""
        at = np.sort(at)
        p = self.prints[at]
        order = ordered(p)
        at, p = at[order], p[order]
        new = np.ones(len(at), bool)
        new[1:] = p[1:] != p[:-1]
        if self.equal(at, new):
            return at, new
        # equal fingerprints of unlike suffixes: all symbols decide
        at = at[np.lexsort((at, *(self.codes[at + o] for o in reversed(self.offsets))))]
        new[:] = True
        if len(at):
            new[1:] = False
            for o in self.offsets:
                new[1:] |= self.codes[at[1:] + o] != self.codes[at[:-1] + o]
        return at, new

    def equal(self, at: np.ndarray, new: np.ndarray) -> bool:
        """Is each suffix that begins no group equal to the one before it?  Where a pair follows another by one position, only
        its last symbols are compared: the pair before has the others."""
        i = np.flatnonzero(~new)
        if not len(i):
            return True
        before = np.full(len(self.codes) + 1, -1, np.int64)
        before[at[i]] = at[i - 1]
        b = np.flatnonzero(before >= 0)
        a = before[b]
        if not (self.codes[a + self.offsets[-1]] == self.codes[b + self.offsets[-1]]).all():
            return False
        head = (b == 0) | (before[b - 1] < 0) | (before[b - 1] != a - 1)
        a, b = a[head], b[head]
        return all((self.codes[a + o] == self.codes[b + o]).all() for o in self.offsets[:-1])

    def lexicographic(self, at: np.ndarray) -> np.ndarray:
        """Positions of distinct suffixes in the order of their symbols."""
        first = self.codes[at + self.offsets[0]]
        order = np.argsort(first)
        at, first = at[order], first[order]
        group = np.cumsum(np.concatenate([[True], first[1:] != first[:-1]])[: len(at)])
        live = np.arange(len(at))
        for o in self.offsets[1:]:
            alone = np.ones(len(live), bool)
            alone[1:] = group[1:] != group[:-1]
            alone[:-1] &= group[1:] != group[:-1]
            live, group = live[~alone], group[~alone]
            if not len(live):
                break
            code = self.codes[at[live] + o]
            order = np.lexsort((code, group))
            at[live], code = at[live[order]], code[order]
            group = np.cumsum(np.concatenate([[True], (group[1:] != group[:-1]) | (code[1:] != code[:-1])]))
        return at


class IndexFamily:
    """Levels of suffix arrays; add() marks what a new batch shares with itself or any earlier one.

    Of a batch, as of a merger of two levels, equal suffixes come together by their fingerprints and are compared
    symbol by symbol; the distinct ones are put in lexicographic order.  Every level is scanned for each batch.
    Levels of like size are replaced by their merger, so that there are only logarithmically many and a suffix is
    moved logarithmically often."""

    def __init__(self, suffixes: Suffixes):
        self.suffixes = suffixes
        self.levels: list[np.ndarray] = []
        self.shared = np.zeros(len(suffixes.codes), bool)

    def distinct(self, at: np.ndarray) -> np.ndarray:
        """One position for each suffix; all positions of a suffix that is there twice are marked."""
        at, new = self.suffixes.groups(at)
        self.shared[at[~new]] = True
        self.shared[at[:-1][~new[1:]]] = True
        return at[new]

    def add(self, at: np.ndarray) -> None:
        """at: the positions of a batch's suffixes."""
        level, kept = self.distinct(at), []
        for old in reversed(self.levels):
            both = self.distinct(np.concatenate([old, level]))
            if not kept and len(old) < 2 * len(level):
                level = both
            else:
                kept.append(old)
        self.levels = [*reversed(kept), self.suffixes.lexicographic(level)]
