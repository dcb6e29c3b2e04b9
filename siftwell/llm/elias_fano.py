"""Elias-Fano coding of sorted numbers as numpy arrays: about two bits more than log(universe / n) for each, with access and search."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
#: Numbers that are encoded at once.
AT_ONCE = 1 << 18


#: The place of the bit with a rank (second index) among the set bits of a byte (first index).
_SELECT = np.zeros((256, 8), np.int64)
for _byte in range(256):
    _set = [k for k in range(8) if _byte >> k & 1]
    _SELECT[_byte, : len(_set)] = _set


_ONES, _TOPS = U64(0x0101010101010101), U64(0x8080808080808080)


def select_in_word(word: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The place of the bit with a rank (from 0) among the set bits of each 64-bit word (any place if there are too few).

    The bytes' counts are summed inside the word; the sums that don't exceed the rank are counted, which gives the byte.
    """
    counts = word - ((word >> U64(1)) & U64(0x5555555555555555))
    counts = (counts & U64(0x3333333333333333)) + ((counts >> U64(2)) & U64(0x3333333333333333))
    sums = ((counts + (counts >> U64(4))) & U64(0x0F0F0F0F0F0F0F0F)) * _ONES
    rank = rank.astype(U64) & U64(63)
    byte = np.bitwise_count((((rank * _ONES) | _TOPS) - sums) & _TOPS)
    shift = np.minimum(byte, 7).astype(U64) << U64(3)
    before = ((sums << U64(8)) >> shift) & U64(255)
    return shift.astype(np.int64) + _SELECT[((word >> shift) & U64(255)).astype(np.int64), np.minimum(rank - before, U64(7)).astype(np.int64)]


class EliasFano:
    """Reads what ``encode`` made; all methods work on arrays of queries."""

    @staticmethod
    def encode(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
        """``values``: sorted uint64 below ``universe``."""
        n = len(values)
        width = max(0, (universe // max(n, 1)).bit_length() - 1)
        low = np.zeros(n * width // 64 + 2, U64)
        size = n + (universe >> width) + 1
        high = np.zeros(size // 64 + 1, U64)
        for a in range(0, n, AT_ONCE):
            some, index = values[a : a + AT_ONCE], np.arange(a, min(a + AT_ONCE, n), dtype=U64)
            if width:
                part, at = some & U64((1 << width) - 1), index * U64(width)
                word, shift = (at >> U64(6)).astype(np.int64), at & U64(63)
                np.bitwise_or.at(low, word, part << shift)
                over = shift.astype(np.int64) + width > 64
                np.bitwise_or.at(low, word[over] + 1, part[over] >> (U64(64) - shift[over]))
            at = (some >> U64(width)) + index
            np.bitwise_or.at(high, (at >> U64(6)).astype(np.int64), U64(1) << (at & U64(63)))
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)])
        zeros = np.arange(len(ones), dtype=np.int64) * 64 - ones
        return {"low": low, "high": high, "ones": ones, "zeros": zeros, "shape": np.array([n, width], np.int64)}

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.low, self.high, self.ones, self.zeros = (arrays[k] for k in ("low", "high", "ones", "zeros"))
        self.n, self.width = (int(x) for x in arrays["shape"])

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), U64)
        at = i.astype(U64) * U64(self.width)
        word, shift = (at >> U64(6)).astype(np.int64), at & U64(63)
        first = self.low[word] >> shift
        second = np.where(shift > 0, self.low[word + 1] << ((U64(64) - shift) & U64(63)), U64(0))
        return (first | second) & U64((1 << self.width) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values of numbers ``i``."""
        word = np.searchsorted(self.ones, i, "right") - 1
        at = word * 64 + select_in_word(self.high[word], i - self.ones[word])
        return ((at - i).astype(U64) << U64(self.width)) | self._low(i)

    def _between(self, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many values have a smaller high part, and how many have a smaller one or this."""
        j = np.clip(high - 1, 0, int(self.zeros[-1]) - 1)
        word = np.searchsorted(self.zeros, j, "right") - 1
        bits = self.high[word]
        place = select_in_word(~bits, j - self.zeros[word])
        first = high < 1  # its values are all those before zero number 0, which may be any number of words on
        begin = np.where(first, 0, np.where(high > j + 1, self.n, word * 64 + place - j))
        # the values with this high part are the ones up to the next zero: mostly in the same word
        after = place + 1
        rest = bits >> np.minimum(after, 63).astype(U64)
        run = np.bitwise_count(rest ^ (rest + U64(1))).astype(np.int64) - 1
        end = np.where(first, word * 64 + place, begin + run)
        over = np.flatnonzero(~first & (after + run >= 64) & (begin < self.n))
        if len(over):
            j = np.minimum(high[over], int(self.zeros[-1]) - 1)
            word = np.searchsorted(self.zeros, j, "right") - 1
            end[over] = np.where(high[over] > j, self.n, word * 64 + select_in_word(~self.high[word], j - self.zeros[word]) - j)
        return begin, np.minimum(end, self.n)

    def find(self, values: np.ndarray, low: np.ndarray | None = None, high: np.ndarray | None = None) -> np.ndarray:
        """The number of each value, -1 where it is absent; looked for between numbers ``low`` and ``high`` only, if given.

        Between near bounds the low parts are compared one by one, and only then the high part. Else the high part leads to a
        few neighbours, among which the low part is looked for by halving.
        """
        part = (values >> U64(self.width)).astype(np.int64)
        wanted = values & U64((1 << self.width) - 1)
        found = np.full(len(values), -1, np.int64)
        if low is None:
            low, high = np.zeros(len(values), np.int64), np.full(len(values), self.n, np.int64)
        near = high - low <= 3
        left = np.flatnonzero(near & (low < high))
        for step in range(3):
            left = left[low[left] + step < high[left]]
            at = low[left] + step
            same = self._low(at) == wanted[left]
            of, at = left[same], at[same]
            exact = self.get(at) == values[of] if len(at) else np.zeros(0, bool)
            found[of[exact]] = at[exact]
        far = np.flatnonzero(~near)
        if not len(far):
            return found
        a, b = self._between(part[far])
        a, b = np.maximum(a, low[far]), np.minimum(b, high[far])
        wanted, end = wanted[far], b.copy()
        left = np.flatnonzero(a < b)
        while len(left):
            middle = (a[left] + b[left]) // 2
            less = self._low(middle) < wanted[left]
            a[left[less]], b[left[~less]] = middle[less] + 1, middle[~less]
            left = left[a[left] < b[left]]
        sure = np.flatnonzero(a < end)
        same = self._low(a[sure]) == wanted[sure]
        found[far[sure[same]]] = a[sure[same]]
        return found
