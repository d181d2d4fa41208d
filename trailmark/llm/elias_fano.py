"""Elias-Fano sequences: monotone 64-bit numbers in about 2 + log2(universe / n) bits each.

Numbers are split: low bits are packed one after another; high parts stand in a bit vector, where
number i with high part h sets bit h + i. A count of ones before each 64-bit word is the directory
for select. All queries take arrays. A sequence is a run of 64-bit words and can be used from a
memory map without being copied.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
#: PLACE[byte, j]: place of the j-th set bit of a byte.
PLACE = np.zeros((256, 8), np.uint8)
for _b in range(256):
    for _j, _p in enumerate(p for p in range(8) if _b >> p & 1):
        PLACE[_b, _j] = _p
HEAD = 4
EACH, TOPS = U(0x0101010101010101), U(0x8080808080808080)  # a one, and the top bit, in every byte


def pack(values: np.ndarray, top: int) -> np.ndarray:
    """The sequence of sorted values, all at most top, as 64-bit words."""
    values = values.astype(U)
    n = len(values)
    low = max(0, int(top // max(n, 1)).bit_length() - 1)
    high = np.zeros(-(-(n + (top >> low) + 2) // 64) * 64, bool)
    high[(values >> U(low)).astype(np.int64) + np.arange(n)] = True
    bits = np.packbits(high, bitorder="little").view(U)
    before = np.zeros(len(bits) + 1, np.int64)
    np.cumsum(np.bitwise_count(bits), out=before[1:])
    parts = []
    for at in range(0, n, 1 << 16):
        part = values[at : at + (1 << 16)]
        parts.append(np.packbits(((part[:, None] >> np.arange(low, dtype=U)) & U(1)).astype(bool).reshape(-1), bitorder="little") if low else np.zeros(0, np.uint8))
    raw = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
    lows = np.zeros(len(raw) // 8 + 2, U)
    lows.view(np.uint8)[: len(raw)] = raw
    return np.concatenate([np.array([n, low, len(bits), len(lows)], U), bits, before.astype(U), lows])


class Sequence:
    """A packed sequence that begins at words[at]; `end` is where it ends."""

    def __init__(self, words: np.ndarray, at: int = 0) -> None:
        self.n, self.low, bits, lows = (int(x) for x in words[at : at + HEAD])
        at += HEAD
        self.bits = words[at : at + bits]
        self.before = words[at + bits : at + 2 * bits + 1].view(np.int64)
        self.zeros = np.arange(bits + 1) * 64 - self.before
        self.lows = words[at + 2 * bits + 1 : at + 2 * bits + 1 + lows]
        self.end = at + 2 * bits + 1 + lows
        self.mask = U((1 << self.low) - 1)

    @staticmethod
    def _in_word(words: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Place of the j-th set bit of each word: its byte by the bytes' running counts, side by side in one word; then by table."""
        x = words - ((words >> U(1)) & U(0x5555555555555555))
        x = (x & U(0x3333333333333333)) + ((x >> U(2)) & U(0x3333333333333333))
        sums = ((x + (x >> U(4))) & U(0x0F0F0F0F0F0F0F0F)) * EACH  # byte k: ones in bytes 0 to k
        j = j.astype(U)
        k = np.bitwise_count(((j * EACH | TOPS) - sums) & TOPS).astype(U) << U(3)  # bytes whose running count is j or less
        j -= (sums << U(8)) >> k & U(0xFF)
        return (k + PLACE[words >> k & U(0xFF), j]).astype(np.int64)

    def _select1(self, i: np.ndarray) -> np.ndarray:
        w = np.searchsorted(self.before, i, side="right") - 1
        return w * 64 + self._in_word(self.bits[w], i - self.before[w])

    def _select0(self, i: np.ndarray) -> np.ndarray:
        w = np.searchsorted(self.zeros, i, side="right") - 1
        return w * 64 + self._in_word(~self.bits[w], i - self.zeros[w])

    def _low(self, i: np.ndarray) -> np.ndarray:
        bit = i * self.low
        w, s = bit >> 6, (bit & 63).astype(U)
        return ((self.lows[w] >> s) | np.where(s > 0, self.lows[w + 1] << ((U(64) - s) & U(63)), U(0))) & self.mask

    def get(self, i: np.ndarray) -> np.ndarray:
        """Numbers at i (0 <= i < n)."""
        return ((self._select1(i) - i).astype(U) << U(self.low)) | self._low(i)

    def _bucket(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first index, end) of the numbers that share x's high part."""
        h = (x >> U(self.low)).astype(np.int64)
        most = int(self.zeros[-1]) - 1
        past = h > most
        h = np.minimum(h, most)
        at = np.where(h > 0, self._select0(np.maximum(h - 1, 0)) + 1, 0)  # where the high part's ones begin
        w, s = at >> 6, at & 63
        w = np.minimum(w, len(self.bits) - 1)
        rest = self.bits[w] >> s.astype(U)
        ones = np.bitwise_count((rest ^ (rest + U(1))) >> U(1)).astype(np.int64)
        begin = at - h
        end = begin + ones
        over = np.flatnonzero((s + ones >= 63) | (at >> 6 > w))  # the run goes on in the next word
        if len(over):
            end[over] = self._select0(h[over]) - h[over]
        begin[past] = end[past] = self.n
        return begin, end

    def _within(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin, end = self._bucket(x)
        low, last = x & self.mask, end.copy()
        live = np.flatnonzero(begin < end)
        while len(live):
            lo, hi = begin[live], end[live]
            mid = (lo + hi) >> 1
            less = self._low(mid) < low[live]
            lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, mid)
            begin[live], end[live] = lo, hi
            live = live[lo < hi]
        return begin, last

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Index of the first number that is x or more, as far as it shares x's high part; else of the next one."""
        return self._within(x)[0]

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of x, or -1: its successor, if that is x itself."""
        if not self.n or not len(x):
            return np.full(len(x), -1, np.int64)
        at, last = self._within(x)
        found = np.full(len(x), -1, np.int64)
        live = np.flatnonzero(at < last)
        same = live[self._low(at[live]) == x[live] & self.mask]
        found[same] = at[same]
        return found
