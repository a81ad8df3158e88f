"""An FM-index over a sequence of small integers, with all operations vectorised over many queries."""

from __future__ import annotations

import numpy as np

U64 = np.uint64


class Bits:
    """A bit vector with constant-time rank: packed words and a running count before each."""

    def __init__(self, flags: np.ndarray):
        padded = np.zeros((len(flags) // 64 + 1) * 64, np.uint8)
        padded[: len(flags)] = flags
        self.words = np.packbits(padded, bitorder="little").view(U64)
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """The ones before each position."""
        low = (U64(1) << (at & 63).astype(U64)) - U64(1)
        return self.before[at >> 6] + np.bitwise_count(self.words[at >> 6] & low)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(U64)) & U64(1) == 1


class Wavelet:
    """A wavelet tree laid out level by level: rank and access in one step for each bit of a symbol."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels = []
        for shift in range(max(1, int(size - 1).bit_length()) - 1, -1, -1):
            flags = (symbols >> shift) & 1 == 1
            self.levels.append((shift, Bits(flags), len(symbols) - int(flags.sum())))
            symbols = np.concatenate([symbols[~flags], symbols[flags]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its position."""
        begin = np.zeros_like(at)
        for shift, bits, zeros in self.levels:
            one = (symbol >> shift) & 1 == 1
            a, b = bits.rank(begin), bits.rank(at)
            begin, at = np.where(one, zeros + a, begin - a), np.where(one, zeros + b, at - b)
        return at - begin

    def access(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for shift, bits, zeros in self.levels:
            one, a = bits.get(at), bits.rank(at)
            out |= one.astype(at.dtype) << shift
            at = np.where(one, zeros + a, at - a)
        return out


def suffix_array(symbols: np.ndarray, separator: int = 0) -> np.ndarray:
    """Suffixes in order, by doubling; each separator counts as a symbol of its own, so comparisons end there."""
    n = len(symbols)
    apart = symbols == separator
    rank = symbols.astype(np.int64) + n
    rank[apart] = np.arange(n)[apart]
    rank = np.unique(rank, return_inverse=True)[1].astype(np.int64)
    step = 1
    while n and rank.max() < n - 1:
        after = np.zeros(n, np.int64)
        after[:-step] = rank[step:] + 1
        rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1].astype(np.int64)
        step *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


class FMIndex:
    """symbols: integers from 0 to size - 1; 0 separates texts, stands at the end and is in no pattern."""

    def __init__(self, symbols: np.ndarray, size: int, sample: int = 8):
        order = suffix_array(symbols)
        last = symbols[order - 1].astype(np.int64)
        self.n = len(symbols)
        self.tree = Wavelet(last, size)
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=size))])
        # the first position after each separator is sampled too: stepping back never crosses a separator
        at = (order % sample == 0) | (last == 0)
        self.marked, self.samples = Bits(at), order[at]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that begin with each pattern (right-aligned in its row)."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for k in range(patterns.shape[1]):
            live = live[(low[live] < high[live]) & (lengths[live] > k)]
            if not len(live):
                break
            symbol = patterns[live, patterns.shape[1] - 1 - k]
            low[live] = self.smaller[symbol] + self.tree.rank(symbol, low[live])
            high[live] = self.smaller[symbol] + self.tree.rank(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: step back to a sampled position, count the steps."""
        out = np.empty(len(rows), np.int64)
        todo, steps, rows = np.arange(len(rows)), 0, rows.copy()
        while len(todo):
            found = self.marked.get(rows)
            out[todo[found]] = self.samples[self.marked.rank(rows[found])] + steps
            todo, rows = todo[~found], rows[~found]
            symbol = self.tree.access(rows)
            rows = self.smaller[symbol] + self.tree.rank(symbol, rows)
            steps += 1
        return out
