"""An FM-index over a shard of texts held as word numbers.

The text is an array of symbols; 0 ends a run and is never searched. Suffixes
are compared up to the end of their run, runs in order of their place. The
index answers batches of patterns at once, each step one vectorised operation.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit array with the number of set bits before any place."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        packed = np.append(packed, np.zeros(8 + -len(packed) % 8, np.uint8))
        self.words = packed.view(np.uint64)
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.append(0, np.cumsum(counts)[:-1])
        self.ones = int(counts.sum())

    def rank(self, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        mask = (np.uint64(1) << bit) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


class WaveletTree:
    """Ranks of symbols by the bits of their numbers, highest bit first (a wavelet matrix)."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.size, self.levels, self.shifts = len(symbols), [], []
        for shift in reversed(range(max(1, int(sigma - 1).bit_length()))):
            bit = (symbols >> shift) & 1 == 1
            self.levels.append(Bits(bit))
            self.shifts.append(shift)
            symbols = np.concatenate([symbols[~bit], symbols[bit]])
        # Where the block of each symbol begins below the last level.
        self.first = self._descend(np.arange(sigma), np.zeros(sigma, np.int64))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, shift in zip(self.levels, self.shifts, strict=True):
            ones = level.rank(at)
            up = (symbol >> shift) & 1 == 1
            at = np.where(up, self.size - level.ones + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        return self._descend(symbol, at) - self.first[symbol]

    def get(self, at: np.ndarray) -> np.ndarray:
        symbol = np.zeros(len(at), np.int64)
        for level, shift in zip(self.levels, self.shifts, strict=True):
            up, ones = level.get(at), level.rank(at)
            symbol |= up.astype(np.int64) << shift
            at = np.where(up, self.size - level.ones + ones, at - ones)
        return symbol


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes of ``text``, which ends with 0; each 0 is a letter of its own.

    Prefixes of doubling length are ranked; only suffixes that still share
    their rank are sorted again.
    """
    n = len(text)
    ends = text == 0
    letter = np.where(ends, np.cumsum(ends) - 1, text.astype(np.int64) + int(ends.sum()))
    order = np.argsort(letter, kind="stable")
    new_rank = np.append(True, letter[order][1:] != letter[order][:-1])
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(new_rank)[np.cumsum(new_rank) - 1]
    length = 1
    while True:
        alone = new_rank & np.append(new_rank[1:], True)
        slots = np.flatnonzero(~alone)  # places in the order that are not settled
        if not len(slots):
            return order
        part = order[slots]
        key = rank[part] * np.int64(n) + rank[np.minimum(part + length, n - 1)]
        by = np.argsort(key, kind="stable")
        part, key = part[by], key[by]
        order[slots] = part
        changed = np.append(True, key[1:] != key[:-1])
        new_rank[slots] = changed
        rank[part] = slots[np.flatnonzero(changed)[np.cumsum(changed) - 1]]
        length *= 2


class FMIndex:
    """Finds all places of word sequences in a text of runs."""

    def __init__(self, text: np.ndarray, sigma: int, sample: int = 16):
        order = suffix_array(text)
        before = text[order - 1]  # the text is a ring: its last symbol is 0
        self.tree = WaveletTree(before.astype(np.int64), sigma)
        counts = np.bincount(text, minlength=sigma)
        self.smaller = np.cumsum(counts) - counts
        # Places that are multiples of the sample, and those where a run begins.
        kept = (order % sample == 0) | (before == 0)
        self.kept, self.places, self.size = Bits(kept), order[kept], len(text)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last + 1 row of each pattern (rows of equal length) by backward search."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.size, np.int64)
        alive = np.arange(len(patterns))
        for column in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[alive, column]
            base = self.smaller[symbol]
            low[alive] = base + self.tree.rank(symbol, low[alive])
            high[alive] = base + self.tree.rank(symbol, high[alive])
            alive = alive[low[alive] < high[alive]]
        low[low > high] = high[low > high]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Place in the text of each row, walking back to the nearest sampled place."""
        found, steps = np.empty(len(rows), np.int64), 0
        open_, row = np.arange(len(rows)), rows.astype(np.int64)
        while len(open_):
            here = self.kept.get(row)
            found[open_[here]] = self.places[self.kept.rank(row[here])] + steps
            open_, row = open_[~here], row[~here]
            if len(open_):
                symbol = self.tree.get(row)
                row = self.smaller[symbol] + self.tree.rank(symbol, row)
            steps += 1
        return found
