"""Adaptive context-mixing range coder for token ids, in independent, checksummed blocks.

A block's ids are dealt to L lanes of S consecutive ids each. All lanes are coded in lockstep with
one model, which learns from every lane after each step; so the work is done on arrays.

Model. Order 0: counts of ids seen so far. Order 1: for the id before, the id that last followed it,
with a confidence. Order 2: the same for the two ids before (hashed). The three predictions are
mixed: an id's frequency is w0 * (its share by count) + w1 * [the order-1 prediction] + w2 * [the
order-2 prediction]. The weights, of WEIGHTS in all, depend on the two confidences and on whether
the predictions agree, and follow how often such predictions were right so far in the block.

Coder. A carry-less range coder with a 64-bit low and range that puts out 32-bit words: at most one
word a lane and step. Decoder and encoder make the same integer operations.

Block: MAGIC, version, alphabet, ids, lanes, crc32 of the ids (as little-endian unsigned 32-bit
integers), crc32 of all that follows the header, words of each lane, words.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC, VERSION = b"TMRC", 2
HEADER = struct.Struct("<4sHIQIII")
SCALE_BITS, WEIGHT_BITS = 20, 6
SCALE, WEIGHTS = 1 << SCALE_BITS, 1 << WEIGHT_BITS
TOTAL_BITS = SCALE_BITS + WEIGHT_BITS
LANES, LEAST_STEPS = 8192, 128
SURE_BITS, SLOTS = 3, 1 << 18
SURE = (1 << SURE_BITS) - 1
#: How the confidence changes after a wrong prediction, then after a right one, by the confidence before.
SURER = np.concatenate([-np.minimum(np.arange(SURE + 1), 2), np.minimum(SURE - np.arange(SURE + 1), 1)])
LOW32, U = np.uint64(0xFFFFFFFF), np.uint64
W32, SHIFT, EDGE = U(32), U(TOTAL_BITS), U(1 << 32)


class CorruptBlock(ValueError):
    """A block that fails a checksum or isn't one."""


def at(values: np.ndarray, index: np.ndarray) -> np.ndarray:
    """values[index] of indexes known to be inside."""
    return values.take(index, mode="clip")


class Model:
    """What both sides know before coding a step."""

    def __init__(self, alphabet: int, lanes: int, reads: bool = False) -> None:
        self.alphabet, self.reads = alphabet, reads
        self.counts = np.zeros(alphabet, np.int32)
        self.seen = 0
        self.step = 0
        # by context: (prediction, or -1) * (SURE + 1) + its confidence
        self.next1 = np.full(alphabet + 1, -SURE - 1, np.int32)
        self.next2 = np.full(SLOTS, -SURE - 1, np.int32)
        states = 2 * (SURE + 1) ** 2
        self.tries = np.full(states, 2, np.int64)
        self.right1 = np.ones(states, np.int64)
        self.right2 = np.ones(states, np.int64)
        self.differ = np.arange(states) % 2 == 0  # states of predictions that differ: of two that agree the first has all the weight
        self.before1 = np.full(lanes, alphabet, np.int64)
        self.before2 = np.full(lanes, alphabet, np.int64)
        self._spread()

    def _spread(self) -> None:
        """Order-0 frequencies: one each at least, SCALE in all."""
        free = SCALE - self.alphabet
        f = 1 + self.counts.astype(np.int64) * free // max(self.seen, 1)
        self.sums = np.zeros(self.alphabet + 1, np.int64)
        np.cumsum(f, out=self.sums[1:])
        self.sums[-1] = SCALE  # the last id gets what rounding leaves
        if self.reads:
            kind = np.uint16 if self.alphabet <= 1 << 16 else np.int32
            self.owner = np.repeat(np.arange(self.alphabet, dtype=kind), np.diff(self.sums))  # of each step of SCALE

    def mix(self, n: int) -> tuple[np.ndarray, ...]:
        """Predictions (order 1, order 2) and weights (0, 1, 2) of the first n lanes."""
        b1, b2 = self.before1[:n], self.before2[:n]
        self.slot = (b1 * 0x9E3779B1 + b2 * 0x85EBCA6B >> 7) & (SLOTS - 1)
        self.was1, self.was2 = at(self.next1, b1).astype(np.int64), at(self.next2, self.slot).astype(np.int64)
        c1, c2 = self.was1 >> SURE_BITS, self.was2 >> SURE_BITS
        self.state = ((self.was1 & SURE) << SURE_BITS | self.was2 & SURE) * 2 + (c1 == c2)
        share = WEIGHTS - 4
        w1 = at(self.right1 * share // self.tries, self.state) * (c1 >= 0)
        w2 = np.minimum(at(self.right2 * share // self.tries * self.differ, self.state) * (c2 >= 0), share - w1)
        return c1, c2, WEIGHTS - w1 - w2, w1, w2

    def learn(self, ids: np.ndarray, hit1: np.ndarray, hit2: np.ndarray) -> None:
        n = len(ids)
        b1, size = self.before1[:n], len(self.tries)
        neither, only1, only2, both = np.bincount(self.state + size * (hit1 + 2 * hit2), minlength=4 * size).reshape(4, size)
        self.tries += neither + only1 + only2 + both
        self.right1 += only1 + both
        self.right2 += only2 + both
        for nxt, key, was, hit in ((self.next1, b1, self.was1, hit1), (self.next2, self.slot, self.was2, hit2)):
            sure = was & SURE
            held = was + at(SURER, sure + (SURE + 1) * hit)
            now = np.where(~hit & (sure == 0), ids << SURE_BITS, held)
            nxt[key] = now.astype(np.int32)  # of lanes with one context the last counts
        np.add.at(self.counts, ids, np.int32(1))
        self.seen += n
        self.before2[:n] = b1
        self.before1[:n] = ids
        self.step += 1
        if self.step & (self.step - 1) == 0 or self.step % 32 == 0:
            self._spread()


def layout(n: int) -> tuple[int, int]:
    """(lanes, steps) for n ids; only the last lane may be shorter."""
    lanes = max(1, min(LANES, -(-n // LEAST_STEPS)))
    steps = max(1, -(-n // lanes))
    return -(-n // steps), steps


def encode(ids: np.ndarray, alphabet: int) -> bytes:
    """A block of ids (below alphabet, which is at most SCALE / 2)."""
    ids = np.ascontiguousarray(ids, "<u4")
    n = len(ids)
    if alphabet > SCALE // 2 or n and int(ids.max()) >= alphabet:
        raise ValueError("ids don't fit the alphabet")
    lanes, steps = layout(n)
    grid = np.zeros(lanes * steps, np.int64)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    last = n - (lanes - 1) * steps
    model = Model(alphabet, lanes)
    low, span = np.zeros(lanes, U), np.full(lanes, 0xFFFFFFFFFFFFFFFF, U)
    out_lane: list[np.ndarray] = []
    out_word: list[np.ndarray] = []
    every = np.arange(lanes)
    for t in range(steps if n else 0):
        m = lanes if t < last else lanes - 1
        if not m:
            break
        x = grid[t, :m]
        c1, c2, w0, w1, w2 = model.mix(m)
        begin, hit1, hit2 = at(model.sums, x), c1 == x, c2 == x
        cum = w0 * begin + SCALE * (w1 * (c1 < x) + w2 * (c2 < x))
        freq = w0 * (at(model.sums, x + 1) - begin) + SCALE * (w1 * hit1 + w2 * hit2)
        r = span[:m] >> SHIFT
        lo = low[:m] + r * cum.astype(U)
        sp = r * freq.astype(U)
        settled = (lo ^ (lo + sp)) < EDGE
        narrow = ~settled & (sp < EDGE)
        sp = np.where(narrow, (U(0) - lo) & LOW32, sp)
        put = settled | narrow
        out_lane.append(np.flatnonzero(put))
        out_word.append((at(lo, out_lane[-1]) >> W32).astype(np.uint32))
        low[:m] = np.where(put, lo << W32, lo)
        span[:m] = np.where(put, sp << W32, sp)
        model.learn(x, hit1, hit2)
    if n:
        out_lane += [every, every]
        out_word += [(low >> W32).astype(np.uint32), (low & LOW32).astype(np.uint32)]
    lane = np.concatenate(out_lane) if out_lane else np.zeros(0, np.int64)
    word = np.concatenate(out_word) if out_word else np.zeros(0, np.uint32)
    word = word[np.argsort(lane.astype(np.uint16), kind="stable")]  # below LANES; 16 bits are sorted by radix
    body = np.bincount(lane, minlength=lanes).astype("<u4").tobytes() + word.astype("<u4").tobytes()
    return HEADER.pack(MAGIC, VERSION, alphabet, n, lanes, zlib.crc32(ids.tobytes()), zlib.crc32(body)) + body


def decode(block: bytes) -> np.ndarray:
    """The ids of a block, as little-endian unsigned 32-bit integers; CorruptBlock if a checksum fails."""
    if len(block) < HEADER.size:
        raise CorruptBlock("too short")
    magic, version, alphabet, n, lanes, crc_ids, crc_body = HEADER.unpack_from(block)
    body = memoryview(block)[HEADER.size :]
    if magic != MAGIC or version != VERSION or zlib.crc32(body) != crc_body or lanes != layout(n)[0]:
        raise CorruptBlock("not a block, or damaged")
    if not n:
        return np.zeros(0, "<u4")
    steps = layout(n)[1]
    sizes = np.frombuffer(body, "<u4", lanes).astype(np.int64)
    words = np.append(np.frombuffer(body, "<u4", offset=4 * lanes), np.zeros(2, np.uint32))
    place = np.cumsum(sizes) - sizes
    last = n - (lanes - 1) * steps
    model = Model(alphabet, lanes, True)
    low, span = np.zeros(lanes, U), np.full(lanes, 0xFFFFFFFFFFFFFFFF, U)
    code = at(words, place).astype(U) << W32 | at(words, place + 1).astype(U)
    place = place + 2
    grid = np.zeros((steps, lanes), np.int64)
    most = U((1 << TOTAL_BITS) - 1)
    for t in range(steps):
        m = lanes if t < last else lanes - 1
        if not m:
            break
        c1, c2, w0, w1, w2 = model.mix(m)
        r = span[:m] >> SHIFT
        v = np.minimum((code[:m] - low[:m]) // r, most).astype(np.int64)
        # the predictions' own weight is taken off v where their id lies below, and tells them where v is in it
        k1, k2 = np.maximum(c1, 0), np.maximum(c2, 0)
        both, s1, s2 = c1 == c2, at(model.sums, k1), at(model.sums, k2)
        f1, f2 = at(model.sums, k1 + 1) - s1, at(model.sums, k2 + 1) - s2
        mine1, mine2 = SCALE * w1, SCALE * w2
        at1, at2 = w0 * s1 + mine2 * (c2 < c1), w0 * s2 + mine1 * (c1 < c2)
        end1, end2 = at1 + w0 * f1 + mine1 + mine2 * both, at2 + w0 * f2 + mine2 + mine1 * both
        is1, is2 = (w1 > 0) & (v >= at1) & (v < end1), (w2 > 0) & (v >= at2) & (v < end2)
        x, cum, freq = np.where(is1, c1, c2), np.where(is1, at1, at2), np.where(is1, end1 - at1, end2 - at2)
        free = np.flatnonzero(~(is1 | is2))
        if len(free):  # an id that isn't predicted: by its share alone, or one whose prediction has no weight
            u, w = at(v, free), at(w0, free)
            above = at(mine1, free) * (u >= at(end1, free)) + at(mine2, free) * (u >= at(end2, free))
            y = at(model.owner, ((u - above) / w).astype(np.int64)).astype(np.int64)  # both below 2^26: the quotient is exact
            begin = at(model.sums, y)
            x[free], cum[free], freq[free] = y, w * begin + above, w * (at(model.sums, y + 1) - begin)
        hit1, hit2 = c1 == x, c2 == x
        lo = low[:m] + r * cum.astype(U)
        sp = r * freq.astype(U)
        settled = (lo ^ (lo + sp)) < EDGE
        narrow = ~settled & (sp < EDGE)
        sp = np.where(narrow, (U(0) - lo) & LOW32, sp)
        put = settled | narrow
        cd = code[:m]
        code[:m] = np.where(put, cd << W32 | at(words, place[:m]).astype(U), cd)  # past the end: the last word, which is 0
        place[:m] += put
        low[:m] = np.where(put, lo << W32, lo)
        span[:m] = np.where(put, sp << W32, sp)
        grid[t, :m] = x
        model.learn(x, hit1, hit2)
    ids = grid.T.reshape(-1)[:n].astype("<u4")
    if zlib.crc32(ids.tobytes()) != crc_ids:
        raise CorruptBlock("ids differ from their checksum")
    return ids
