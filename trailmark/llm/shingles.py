"""Word shingles of many texts at once, as 64-bit hashes, on arrays of bytes."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
from xxhash import xxh3_64_intdigest

U = np.uint64
BLOCK = 1 << 20
_RANDOM = np.random.Generator(np.random.PCG64(20240601))
#: Random multipliers of the words of a shingle; the same in every process.
WORDS = _RANDOM.integers(0, 2**64, 64, dtype=U) | U(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finisher of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, its text's index) of UTF-8 texts, A-Z lower-cased. The hash is XXH3, of all bytes."""
    parts = [t.lower().split() for t in texts]  # of bytes: A-Z, and the six separators
    n = [len(x) for x in parts]
    return np.fromiter(map(xxh3_64_intdigest, chain.from_iterable(parts)), U, sum(n)), np.repeat(np.arange(len(texts)), n)


def distinct(text: bytes, k: int) -> set[tuple[bytes, ...]]:
    """The distinct shingles of a text, as words."""
    w = text.lower().split()
    return {*zip(*(w[i:] for i in range(k)))} if len(w) >= k else {tuple(w)} if w else set()


def of_block(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingles, the number of each text's); a text of 1 to k - 1 words has one shingle."""
    w, doc = words(texts)
    n_words = np.bincount(doc, minlength=len(texts))
    n = np.where(n_words >= k, n_words - k + 1, np.minimum(n_words, 1))
    begin = np.cumsum(n_words) - n_words
    owner = np.repeat(np.arange(len(texts)), n)
    at = begin[owner] + np.arange(len(owner)) - (np.cumsum(n) - n)[owner]
    size = np.minimum(n_words[owner], k)
    h = size.astype(U) * WORDS[-1]
    for i in range(k):
        has = size > i
        if has.all():
            h += w[at + i] * WORDS[i]
        else:
            h[has] += w[at[has] + i] * WORDS[i]
    h = mixed(h)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], np.bincount(owner[new], minlength=len(texts))


def blocks(texts: list[str | None]) -> Iterator[tuple[int, int, list[bytes]]]:
    """(begin, end, UTF-8) of runs of texts of about BLOCK bytes; null: empty."""
    at = 0
    while at < len(texts):
        held: list[bytes] = []
        size, begin = 0, at
        while at < len(texts) and (not held or size < BLOCK):
            held.append((texts[at] or "").encode("utf-8", "surrogatepass"))
            size += len(held[-1])
            at += 1
        yield begin, at, held


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of counts values, modulo 2^64; empty runs: 0."""
    total = np.zeros(len(values) + 1, U)
    np.cumsum(values, out=total[1:])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]
