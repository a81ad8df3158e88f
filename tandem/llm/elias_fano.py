"""Elias-Fano sequences in flat arrays that can be memory-mapped, with vectorised access and search."""

from __future__ import annotations

import numpy as np

U64 = np.uint64

EACH, TOP = U64(0x0101010101010101), U64(0x8080808080808080)

#: SELECT[b, k]: the place of the k-th set bit of the byte b.
SELECT = np.array([([i for i in range(8) if b >> i & 1] + [8] * 8)[:8] for b in range(256)], np.int64)


def encode(values: np.ndarray, name: str) -> dict[str, np.ndarray]:
    """A non-decreasing sequence of unsigned integers, as arrays whose names begin with ``name``.

    low: the lower bits of each value, packed; high: for each value a one, and
    a zero after all values of each upper part; zeros: the zeros before each
    word of high; head: number of values, lower bits of each, first value of
    the universe not reached; ones: as zeros, of the ones.
    """
    values = values.astype(U64)
    n, top = len(values), int(values[-1]) if len(values) else 0
    bits = max(0, (top // max(n, 1)).bit_length() - 1)
    upper = (values >> U64(bits)).astype(np.int64)
    places = upper + np.arange(n)
    size = n + (top >> bits) + 2
    flags = np.zeros(-(-size // 64) * 64, np.uint8)
    flags[places] = 1
    high = np.packbits(flags, bitorder="little").view(U64)
    zeros = np.zeros(len(high) + 1, np.int64)
    np.cumsum(64 - np.bitwise_count(high).astype(np.int64), out=zeros[1:])
    ones = np.arange(0, 64 * len(zeros), 64) - zeros
    low = np.zeros(n * bits // 64 + 2, U64)
    if bits and n:
        part = values & U64((1 << bits) - 1)
        at = np.arange(n) * bits
        word, shift = at >> 6, (at & 63).astype(U64)
        starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        low[word[starts]] |= np.bitwise_or.reduceat(part << shift, starts)
        over = np.flatnonzero((at & 63) + bits > 64)
        low[word[over] + 1] |= part[over] >> (U64(64) - shift[over])  # one value at most runs over into each word
    return {f"{name}.low": low, f"{name}.high": high, f"{name}.zeros": zeros, f"{name}.ones": ones, f"{name}.head": np.array([n, bits, top], np.int64)}


class EliasFano:
    def __init__(self, arrays: dict[str, np.ndarray], name: str):
        self.low, self.high, self.zeros, self.ones = (arrays[f"{name}.{x}"] for x in ("low", "high", "zeros", "ones"))
        self.n, self.bits, self.top = (int(x) for x in arrays[f"{name}.head"])

    def _lower(self, at: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(at), U64)
        place = at * self.bits
        word, shift = place >> 6, (place & 63).astype(U64)
        out = self.low[word] >> shift
        out |= (self.low[word + 1] << U64(1)) << (U64(63) - shift)  # the word after the last is there
        out &= U64((1 << self.bits) - 1)
        return out

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """The place of the k-th one or zero of high."""
        before = self.ones if ones else self.zeros
        word = np.searchsorted(before, k, "right") - 1
        rest = (k - before[word]).astype(U64)
        bits = self.high[word] if ones else ~self.high[word]
        sums = bits - ((bits >> U64(1)) & U64(0x5555555555555555))
        sums = (sums & U64(0x3333333333333333)) + ((sums >> U64(2)) & U64(0x3333333333333333))
        sums = ((sums + (sums >> U64(4))) & U64(0x0F0F0F0F0F0F0F0F)) * EACH  # each byte: the set bits up to its end
        byte = np.bitwise_count(((rest * EACH | TOP) - sums) & TOP).astype(np.int64)  # the bytes whose sum is at most rest
        shift = (byte * 8).astype(U64)
        rest -= ((sums << U64(8)) >> shift) & U64(255)
        return word * 64 + byte * 8 + SELECT[((bits >> shift) & U64(255)).astype(np.int64), rest.astype(np.int64)]

    def _next(self, place: np.ndarray, k: np.ndarray, ones: bool) -> np.ndarray:
        """The place of the k-th one or zero, from that of the one before: looked for in the bits up to 64 places on."""
        place = place + 1
        word, shift = place >> 6, (place & 63).astype(U64)
        after = self.high[np.minimum(word + 1, len(self.high) - 1)]
        bits = self.high[np.minimum(word, len(self.high) - 1)] >> shift
        bits |= (after << U64(1)) << (U64(63) - shift)
        if not ones:
            bits = ~bits
        gap = np.bitwise_count(~bits & (bits - U64(1))).astype(np.int64)
        out = place + gap
        far = np.flatnonzero((gap == 64) | (out >= 64 * len(self.high)))
        if len(far):
            out[far] = self._select(k[far], ones)
        return out

    def get(self, at: np.ndarray) -> np.ndarray:
        """Values by index."""
        upper = self._select(at, True) - at
        return (upper.astype(U64) << U64(self.bits)) | self._lower(at)

    def pair(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values by index, and the values after them."""
        place = self._select(at, True)
        out = []
        for i, where in ((at, place), (at + 1, self._next(place, at + 1, True))):
            out.append(((where - i).astype(U64) << U64(self.bits)) | self._lower(i))
        return out[0], out[1]

    def all(self) -> np.ndarray:
        flags = np.unpackbits(np.ascontiguousarray(self.high).view(np.uint8), bitorder="little")
        at = np.arange(self.n)
        return ((np.flatnonzero(flags)[: self.n] - at).astype(U64) << U64(self.bits)) | self._lower(at)

    def find(self, value: np.ndarray) -> np.ndarray:
        """The index of the first element that is not less than each value (n if there is none). Sorted values cost less."""
        return self._search(value)[0]

    def index(self, value: np.ndarray) -> np.ndarray:
        """The index of the first element that equals each value, -1 if there is none."""
        at, equal = self._search(value)
        return np.where(equal, at, -1)

    def _search(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        value = value.astype(U64)
        out, equal = np.full(len(value), self.n, np.int64), np.zeros(len(value), bool)
        if (value[1:] < value[:-1]).any():
            order = np.argsort(value)
            out[order], equal[order] = self._search(value[order])
            return out, equal
        live = int(np.searchsorted(value, U64(self.top), "right")) if self.n else 0
        if not live:
            return out, equal
        value = value[:live]
        upper = (value >> U64(self.bits)).astype(np.int64)
        fresh = np.concatenate([[True], upper[1:] != upper[:-1]])
        part = upper[fresh]
        at, last = np.zeros(len(part), np.int64), np.empty(len(part), np.int64)
        inner = slice(int(part[0] == 0), None)  # the first upper part begins at 0
        if part[0] == 0:
            last[:1] = self._select(part[:1], False)
        before = self._select(part[inner] - 1, False)
        at[inner] = before - part[inner] + 1
        last[inner] = self._next(before, part[inner], False) - part[inner]
        which = np.cumsum(fresh) - 1
        at, last = at[which], last[which]
        want = value & U64((1 << self.bits) - 1)
        at = self._bound(at, last, want)
        out[:live] = at
        inside = np.flatnonzero(at < last)
        equal[inside] = self._lower(at[inside]) == want[inside]
        return out, equal

    def _bound(self, at: np.ndarray, end: np.ndarray, want: np.ndarray) -> np.ndarray:
        """The first index from at on, before end, whose lower bits are not less than want (end if there is none).

        Steps that halve, from the power of two in the longest range down (few as a rule, many where a frequent context
        has many words). The rows go by the length of their ranges, so those that a step concerns come first.
        """
        rounds = np.frexp((end - at).astype(float))[1].astype(np.uint8)
        rows = np.argsort(~rounds, kind="stable")
        rows = rows[: np.count_nonzero(rounds)]
        many = np.cumsum(np.bincount(rounds, minlength=1)[::-1])[::-1].tolist()
        found, to, goal = at[rows], end[rows], want[rows]
        for k in range(len(many) - 1, 0, -1):
            m, step = many[k], 1 << (k - 1)
            probe = found[:m] + (step - 1)
            less = self._lower(np.minimum(probe, to[:m] - 1)) < goal[:m]
            less &= probe < to[:m]
            found[:m] += less * step
        out = at.copy()
        out[rows] = found
        return out
