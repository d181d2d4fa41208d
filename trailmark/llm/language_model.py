"""Operator 1: n-gram language model in an Elias-Fano trie, and scores of texts.

Tokens are words, A-Z lower-cased, and one end after each text, which is also what stands before its
first word. All n-grams of one to three tokens of the texts learnt from are counted, none left out.
Probabilities are interpolated: p(w | context) = share(context, w) + left(context) * p(w | shorter context)
with share = (c - D) / c(context) and left = D * (distinct next tokens) / c(context); single tokens
have (c + 0.5) / (N + 0.5 * (V + 1)), N tokens and V distinct ones learnt from.

The model is never in one place. It is cut into segments of about equal size, each built, mapped
and asked in one task; what goes through the network are compressed sorted lists, a row for each
window of about WINDOW tokens and segment:

1. Texts are read once into windows: a window holds its texts' tokens as numbers of its own word
   list. A word is known by 80 bits of a 128-bit hash of its bytes (at 10^10 distinct words, some
   4 in 100,000 corpora hold two that agree).
2. Words go to the segment of their first bits. There, level 1 of the trie is built (sorted hashes
   as an Elias-Fano sequence, counts, ids in order of count), and each window's words are looked up.
3. Windows, now of ids, are cut into distinct trigrams (two tokens and what follows, nothing after an
   end). Bounds sampled from all windows deal them out by their first two tokens, so that no segment
   depends on how frequent a single word is; of a word whose pairs lie in several segments all of these are asked.
4. A segment adds up its windows' counts and builds levels 2 and 3: for each node a monotone
   pointer to its children; their ids, made one monotone sequence by starting each node's where the
   last one's ended, so a child is found by a successor search relative to its context; 16-bit
   logarithms of the smoothed shares and, by parent, of `left`. The levels are written to an unlinked
   scratch file and memory-mapped, then every window's list is answered from them.
5. A window puts the answers together: interpolation needs `share` of three tokens from one segment
   and of two from another, so it is done where the tokens are. Sums are made text by text.

Null text: empty, so the end alone. Null doc_id: learnt from, not held out. Repeated rows count as
often as they are there. A very long text is a window of its own. Without texts to learn from N and
V are 0, and nothing is known. Empty table: empty result. Extra columns aren't carried. More than
2^31 distinct words are an error.
"""

from __future__ import annotations

import tempfile
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import removed, table, written
from .elias_fano import Sequence, pack

DISCOUNT, WINDOW = 0.75, 1_500_000
#: Words of a segment of level 1, and trigrams of a segment of the levels below, of all windows, about.
WORDS, GRAMS, SAMPLED = 1_000_000, 1_500_000, 1024
U = np.uint64
#: Stands for the end; holds a separator, so no word is the same.
END, SEED = b" end", 20240601
GRID = 3000.0  # steps of a decade
ABSENT = 0xFFFF
HEAD = "docs array<long>, learn array<boolean>, lengths array<int>, n_tokens long, n_types long, tokens binary"
SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def bundle(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers >= 0 in one compressed run of bytes: of each its length, width and byte planes."""
    head, planes = [len(arrays)], []
    for x in arrays:
        x = np.ascontiguousarray(x, "<u8")
        width = max(1, -(-int(x.max()).bit_length() // 8)) if len(x) else 1
        head += [len(x), width]
        planes.append(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())
    raw = b"".join(planes)
    return np.array(head, "<u8").tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def unbundle(raw: bytes) -> list[np.ndarray]:
    """The arrays of bundle(), as 64-bit integers."""
    n = int.from_bytes(raw[:8], "little")
    head = np.frombuffer(raw, "<u8", 1 + 2 * n)[1:].astype(int).reshape(-1, 2)
    flat = np.frombuffer(pa.decompress(raw[8 * (1 + 2 * n) :], decompressed_size=int(head.prod(axis=1).sum()), codec="zstd", asbytes=True), np.uint8)
    out, at = [], 0
    for size, width in head.tolist():
        wide = np.zeros((size, 8), np.uint8)
        wide[:, :width] = flat[at : at + size * width].reshape(width, size).T
        out.append(wide.reshape(-1).view("<i8"))
        at += size * width
    return out


def steps(values: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Differences within runs of sorted numbers; the first of a run as it is."""
    out = values.copy()
    out[1:] -= values[:-1]
    first = (np.cumsum(runs) - runs)[runs > 0]
    out[first] = values[first]
    return out


def unsteps(out: np.ndarray, runs: np.ndarray) -> np.ndarray:
    total = np.cumsum(out)
    runs = runs[runs > 0]
    first = np.cumsum(runs) - runs
    return total - np.repeat(total[first] - out[first], runs)


def quantised(p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-np.log10(np.maximum(p, 1e-21)) * GRID), 0, ABSENT - 1).astype(np.uint16)


def value(q: np.ndarray, absent: float) -> np.ndarray:
    return np.where(q == ABSENT, absent, 10.0 ** (q / -GRID))


def padded(x: np.ndarray) -> np.ndarray:
    """x as whole 64-bit words."""
    raw = np.zeros(-(-x.nbytes // 8), U)
    raw.view(np.uint8)[: x.nbytes] = np.ascontiguousarray(x).view(np.uint8)
    return raw


def mapped(words: np.ndarray) -> np.ndarray:
    """words in an unlinked scratch file, memory-mapped: pages hold them, not the heap, and nothing stays behind."""
    with tempfile.TemporaryFile() as f:
        words.tofile(f)
        f.flush()
        return np.memmap(f, U, "r", shape=words.shape).view(np.ndarray) if len(words) else words


class Words:
    """A segment of level 1: sorted hashes (first 64 bits, without the segment's own), 16 more bits of each, and ids."""

    @staticmethod
    def build(rest: np.ndarray, more: np.ndarray, ids: np.ndarray, bits: int) -> np.ndarray:
        return np.concatenate([pack(rest, (1 << (64 - bits)) - 1), ids.astype(U), padded(more)])

    def __init__(self, words: np.ndarray) -> None:
        self.rest = Sequence(words)
        n = self.rest.n
        self.ids = words[self.rest.end : self.rest.end + n].view(np.int64)
        self.more = words[self.rest.end + n :].view(np.uint16)[:n]

    def find(self, rest: np.ndarray, more: np.ndarray) -> np.ndarray:
        """Index of each hash, or -1. Hashes may share their first bits, so a few steps may follow."""
        at = self.rest.find(rest)
        while self.rest.n and len(wrong := np.flatnonzero((at >= 0) & (self.more[np.maximum(at, 0)] != more))):
            nxt = at[wrong] + 1
            inside = np.minimum(nxt, self.rest.n - 1)
            at[wrong] = np.where((nxt < self.rest.n) & (self.rest.get(inside) == rest[wrong]), nxt, -1)
        return at


class Children:
    """A level from 2 on; `left` is by parent, all else by child."""

    @staticmethod
    def build(n_parents: int, parents: np.ndarray, ids: np.ndarray, p: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Of children sorted by (parent, id)."""
        pointers = np.searchsorted(parents, np.arange(n_parents + 1))
        last = np.flatnonzero(np.append(parents[1:] != parents[:-1], True)) if len(parents) else np.zeros(0, np.int64)
        base = np.append(0, np.cumsum(ids[last] + 1))[np.searchsorted(parents[last], parents)]
        relative = base + ids
        top = int(relative[-1]) if len(relative) else 0
        return np.concatenate([np.array([n_parents, len(left)], U), pack(pointers, len(ids)), pack(relative, top), padded(quantised(p)), padded(quantised(left))])

    def __init__(self, words: np.ndarray, at: int = 0) -> None:
        self.n_parents, n_left = int(words[at]), int(words[at + 1])
        self.pointers = Sequence(words, at + 2)
        self.ids = Sequence(words, self.pointers.end)
        self.n, at = self.ids.n, self.ids.end
        size = -(-2 * self.n // 8)
        self.p = words[at : at + size].view(np.uint16)[: self.n]
        self.end = at + size + -(-2 * n_left // 8)
        self.left = words[at + size : self.end].view(np.uint16)[:n_left]

    def range(self, parents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first index and the end of each parent's children."""
        return self.pointers.get(parents).astype(np.int64), self.pointers.get(parents + 1).astype(np.int64)

    def find(self, parent: np.ndarray, runs: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Index of each child, or -1; of each parent (-1: none) as many ids as its run is long."""
        found = np.full(len(ids), -1, np.int64)
        some = np.flatnonzero(parent >= 0)
        if not len(some):
            return found
        lo, hi, base = np.zeros(len(parent), np.int64), np.zeros(len(parent), np.int64), np.zeros(len(parent), U)
        lo[some], hi[some] = self.range(parent[some])
        later = some[lo[some] > 0]
        base[later] = self.ids.get(lo[later] - 1) + U(1)
        owner = np.repeat(np.arange(len(parent)), runs)
        live = np.flatnonzero(hi[owner] > lo[owner])
        own = owner[live]
        at = self.ids.find(base[own] + ids[live].astype(U))
        found[live] = np.where((at >= lo[own]) & (at < hi[own]), at, -1)
        return found


class Trie:
    """A segment of levels 2 and 3: first tokens, their children (second tokens), and the children of those."""

    @staticmethod
    def build(pairs: np.ndarray, pair: np.ndarray, third: np.ndarray, counts: np.ndarray, firsts: np.ndarray, first_counts: np.ndarray) -> np.ndarray:
        """Of sorted distinct pairs (first << 32 | second), and triples sorted by (pair's index, third)."""
        a = pairs >> 32
        tops, parent = np.unique(a, return_inverse=True)
        n = np.bincount(pair, counts, len(pairs))
        of_first = first_counts[np.searchsorted(firsts, tops)]
        two = Children.build(len(tops), parent, pairs & 0xFFFFFFFF, (n - DISCOUNT) / of_first[parent], np.zeros(0))
        left = DISCOUNT * np.bincount(pair, minlength=len(pairs)) / n
        three = Children.build(len(pairs), pair, third, (counts - DISCOUNT) / n[pair], left)
        return np.concatenate([pack(tops, int(tops[-1]) if len(tops) else 0), two, three])

    def __init__(self, words: np.ndarray) -> None:
        self.tops = Sequence(words)
        self.two = Children(words, self.tops.end)
        self.three = Children(words, self.two.end)

    def answers(self, firsts: np.ndarray, first_runs: np.ndarray, seconds: np.ndarray, second_runs: np.ndarray, thirds: np.ndarray) -> tuple[np.ndarray, ...]:
        """(distinct next tokens of each first; share of each second; `left` after each second; share of each third)."""
        top = self.tops.find(firsts.astype(U))
        nexts = np.zeros(len(firsts), np.int64)
        live = np.flatnonzero(top >= 0)
        lo, hi = self.two.range(top[live]) if len(live) else (np.zeros(0, np.int64),) * 2
        nexts[live] = hi - lo
        node = self.two.find(top, first_runs, seconds)
        leaf = self.three.find(node, second_runs, thirds)
        take = lambda values, at: np.where(at >= 0, values[np.maximum(at, 0)], ABSENT) if len(values) else np.full(len(at), ABSENT)
        return nexts, take(self.two.p, node), take(self.three.left, node), take(self.three.p, leaf)


def tokenised(docs: DataFrame) -> DataFrame:
    """Windows of docs (doc_id, text, learn): HEAD, with tokens as numbers of the window's words; the words' hashes, sorted; counts to learn; order.

    order: the words' numbers in order of their hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def start() -> tuple[defaultdict[bytes, int], list[int | None], list[bool], list[np.ndarray]]:
            number: defaultdict[bytes, int] = defaultdict()
            number.default_factory = number.__len__
            number[END]
            return number, [], [], []

        def close() -> pa.RecordBatch:
            tokens = np.concatenate(parts)
            lengths = np.fromiter(map(len, parts), np.int32, len(parts))
            raw = np.frombuffer(b"".join([xxhash.xxh3_128_digest(w, SEED) for w in number]), np.uint8).reshape(-1, 16)
            first, more = raw[:, :8].copy().view(">u8").reshape(-1).astype(U), raw[:, 8:10].copy().view(">u2").reshape(-1).astype(np.uint16)
            order = np.lexsort((more, first))
            counts = np.bincount(tokens[np.repeat(np.array(learn, bool), lengths)], minlength=len(number))
            cols = (
                pa.array([docs], pa.list_(pa.int64())), pa.array([learn], pa.list_(pa.bool_())), pa.array([lengths], pa.list_(pa.int32())),
                pa.array([len(tokens)], pa.int64()), pa.array([len(number)], pa.int64()), pa.array([bundle(tokens)]), pa.array([first[order].tobytes() + more[order].tobytes()]),
                pa.array([bundle(counts[order])]), pa.array([bundle(order)]),
            )
            return pa.RecordBatch.from_arrays(list(cols), names=["docs", "learn", "lengths", "n_tokens", "n_types", "tokens", "words", "learnt", "order"])

        number, docs, learn, parts = start()
        size = 0
        for b in batches:
            ids, flags = b.column(0).to_pylist(), b.column(2).to_pylist()
            for at, text in enumerate(b.column(1)):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").lower().split()
                words.append(END)
                parts.append(np.fromiter(map(number.__getitem__, words), np.uint32, len(words)))
                docs.append(ids[at])
                learn.append(bool(flags[at]))
                size += len(words)
                if size >= WINDOW:
                    yield close()
                    number, docs, learn, parts = start()
                    size = 0
        if parts:
            yield close()

    made = docs.select("doc_id", "text", "learn").mapInArrow(run, f"{HEAD}, words binary, learnt binary, order binary")
    return made.withColumn("win", F.monotonically_increasing_id())  # the windows are written once, so it doesn't change


def hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(raw) // 10
    return np.frombuffer(raw, U, n), np.frombuffer(raw, np.uint16, n, 8 * n)


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Rows of a partition by their first column; each partition was dealt one number, or a few."""
    held = [b for b in batches if b.num_rows]
    if held:
        t = pa.Table.from_batches(held)
        part = np.asarray(t.column(0))
        for number in np.unique(part).tolist():
            yield number, t.filter(pa.array(part == number))


def vocabulary(windows: DataFrame, bits: int) -> DataFrame:
    """(win, seg, named, n_types, n_tokens): ids (0: not learnt) and counts of each window's words of a segment; a row without win has the segment's totals."""
    segments = 1 << bits

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for win, raw, learnt in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                (first, more), (counts,) = hashes(raw), unbundle(learnt)
                cuts = np.append(np.searchsorted(first, np.arange(segments).astype(U) << U(64 - bits)), len(first))
                rows = [(s, a, e) for s, (a, e) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if e > a]
                cols = (
                    pa.array([s for s, _, _ in rows], pa.int32()), pa.array([win] * len(rows), pa.int64()),
                    pa.array([first[a:e].tobytes() + more[a:e].tobytes() for _, a, e in rows], pa.binary()), pa.array([bundle(counts[a:e]) for _, a, e in rows], pa.binary()),
                )
                yield pa.RecordBatch.from_arrays(list(cols), names=["seg", "win", "words", "learnt"])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for seg, t in groups(batches):
            asked = [hashes(x.as_py()) for x in t.column("words")]
            n = np.concatenate([unbundle(x.as_py())[0] for x in t.column("learnt")])
            first, more = (np.concatenate(x) for x in zip(*asked, strict=True))
            order = np.lexsort((more, first))
            first, more, n = first[order], more[order], n[order]
            new = np.append(True, (first[1:] != first[:-1]) | (more[1:] != more[:-1]))
            at = np.flatnonzero(new)
            counts = np.add.reduceat(n, at)
            at, counts = at[counts > 0], counts[counts > 0]
            rank = np.empty(len(at), np.int64)
            rank[np.argsort(-counts, kind="stable")] = np.arange(len(at))
            ids = rank * segments + seg + 1
            if len(ids) and int(ids.max()) >= 1 << 31:
                raise OverflowError("more distinct words than ids")
            rest = lambda x: x << U(bits) >> U(bits)
            level = Words(mapped(Words.build(rest(first[at]), more[at], ids, bits)))
            named = []
            for f, m in asked:
                found = level.find(rest(f), m)
                known = np.maximum(found, 0)
                named.append(bundle(*(np.where(found >= 0, x[known], 0) for x in (level.ids, counts))) if len(at) else bundle(*(np.zeros(len(f)),) * 2))
            wins = [*t.column("win").to_pylist(), None]
            cols = (
                pa.array(wins, pa.int64()), pa.array([seg] * len(wins), pa.int32()), pa.array([*named, None], pa.binary()),
                pa.array([0] * len(named) + [len(at)], pa.int64()), pa.array([0] * len(named) + [int(counts.sum())], pa.int64()),
            )
            yield pa.RecordBatch.from_arrays(list(cols), names=["win", "seg", "named", "n_types", "n_tokens"])

    dealt = windows.select("win", "words", "learnt").mapInArrow(deal, "seg int, win long, words binary, learnt binary")
    return dealt.repartitionById(segments, "seg").mapInArrow(look_up, "win long, seg int, named binary, n_types long, n_tokens long")


def by_segment(t: pa.Table, column: str) -> list[list[np.ndarray]]:
    """The arrays of a window's answers, in order of the segments."""
    return [unbundle(t.column(column)[i].as_py()) for i in np.argsort(np.asarray(t.column("seg"))).tolist()]


def with_ids(windows: DataFrame, names: DataFrame) -> DataFrame:
    """Windows with tokens as ids, types (the ids there are, sorted, and their counts) and a sample of pairs."""

    def run(w: pa.Table, named: pa.Table) -> pa.Table:
        ids, counts = (np.concatenate(x) for x in zip(*by_segment(named, "named"), strict=True))
        order = unbundle(w.column("order")[0].as_py())[0]
        of = np.empty(len(ids), np.int64)
        of[order] = ids
        tokens = of[unbundle(w.column("tokens")[0].as_py())[0]]
        known = np.argsort(ids)[np.count_nonzero(ids == 0) :]
        pairs = (tokens[:-1] << 32 | tokens[1:])[::SAMPLED]
        w = w.drop_columns(["tokens", "order"]).append_column("tokens", pa.array([bundle(tokens)]))
        return w.append_column("types", pa.array([bundle(ids[known], counts[known])])).append_column("sample", pa.array([pairs], pa.list_(pa.int64())))

    left = windows.select("win", "docs", "learn", "lengths", "tokens", "order")
    right = names.where("win IS NOT NULL").select("win", "seg", "named")
    schema = "win long, docs array<long>, learn array<boolean>, lengths array<int>, tokens binary, types binary, sample array<long>"
    return left.groupBy("win").cogroup(right.groupBy("win")).applyInArrow(run, schema)


class Grams:
    """The distinct trigrams of a window, sorted, and where its tokens have theirs. Row of token i: the token before, itself, the token after (0: none, or not known)."""

    def __init__(self, tokens: np.ndarray, lengths: np.ndarray, types: np.ndarray, bounds: np.ndarray) -> None:
        n = len(tokens)
        self.first = np.cumsum(lengths) - lengths
        end = tokens[-1] if n else 0
        before = np.empty(n, np.int64)
        before[1:] = tokens[:-1]
        before[self.first] = end
        after = np.zeros(n, np.int64)
        after[:-1] = tokens[1:]
        after[self.first + lengths - 1] = 0
        self.before = before
        self.rows = np.flatnonzero((before > 0) & (tokens > 0))
        self.pairs, pair = np.unique(before[self.rows] << 32 | tokens[self.rows], return_inverse=True)
        triples, triple = np.unique(pair << 32 | after[self.rows], return_inverse=True)
        self.third, self.of_pair = triples & 0xFFFFFFFF, triples >> 32
        self.pair, self.triple = pair, triple
        self.runs = np.bincount(self.of_pair, minlength=len(self.pairs))
        # known tokens before any token, once for each segment that holds pairs of theirs anywhere
        a = np.unique(before[before > 0])
        lo, hi = (np.searchsorted(bounds, x, side="right") for x in (a << 32, a << 32 | 0xFFFFFFFF))
        self.firsts = np.repeat(a, hi - lo + 1)
        self.seg = np.repeat(lo, hi - lo + 1) + np.arange(len(self.firsts)) - np.repeat(np.cumsum(hi - lo + 1) - (hi - lo + 1), hi - lo + 1)
        wide = np.concatenate([[0], bounds, [np.iinfo(np.int64).max]])
        begin = np.searchsorted(self.pairs, np.maximum(self.firsts << 32, wide[self.seg]))
        finish = np.searchsorted(self.pairs, np.minimum((self.firsts + 1) << 32, wide[self.seg + 1]))
        self.first_runs, self.begin, self.finish = finish - begin, begin, finish
        self.type_of_first = np.searchsorted(types, self.firsts)


def requests(windows: DataFrame, bounds: np.ndarray) -> DataFrame:
    """(seg, win, asked): what each window asks of a segment, with its counts to learn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                tokens, lengths = unbundle(b.column("tokens")[i].as_py())[0], np.asarray(b.column("lengths")[i].as_py(), np.int64)
                types, counts = unbundle(b.column("types")[i].as_py())
                g = Grams(tokens, lengths, types, bounds)
                learn = np.repeat(np.asarray(b.column("learn")[i].as_py(), bool), lengths)[g.rows]
                n = np.bincount(g.triple[learn], minlength=len(g.third))
                after = np.append(0, np.cumsum(g.runs))
                segs, at = np.unique(g.seg, return_index=True)
                blobs = []
                for lo, hi in zip(at.tolist(), np.append(at, len(g.seg)).tolist()[1:], strict=True):
                    p, q = int(g.begin[lo:hi].min()), int(g.finish[lo:hi].max())
                    firsts, first_runs, runs = g.firsts[lo:hi], g.first_runs[lo:hi], g.runs[p:q]
                    inside = slice(int(after[p]), int(after[q]))
                    blobs.append(
                        bundle(
                            np.append(firsts[:1], np.diff(firsts)), counts[g.type_of_first[lo:hi]], first_runs, steps(g.pairs[p:q] & 0xFFFFFFFF, first_runs),
                            runs, steps(g.third[inside], runs), n[inside],
                        )
                    )
                win = b.column("win")[i].as_py()
                yield pa.RecordBatch.from_arrays([pa.array(segs, pa.int32()), pa.array([win] * len(segs), pa.int64()), pa.array(blobs, pa.binary())], names=["seg", "win", "asked"])

    return windows.select("win", "learn", "lengths", "tokens", "types").mapInArrow(run, "seg int, win long, asked binary")


def read_request(raw: bytes) -> tuple[np.ndarray, ...]:
    """(firsts, their counts, their runs, seconds, their runs, thirds, counts to learn)."""
    firsts, counts, first_runs, seconds, runs, thirds, n = unbundle(raw)
    return np.cumsum(firsts), counts, first_runs, unsteps(seconds, first_runs), runs, unsteps(thirds, runs), n


def segment(asked: list[tuple[np.ndarray, ...]]) -> np.ndarray:
    """The segment of the trie that the windows' requests make together."""
    firsts, at = np.unique(np.concatenate([x[0] for x in asked]), return_index=True)
    counts = np.concatenate([x[1] for x in asked])[at]
    keys = np.concatenate([np.repeat(x[0], x[2]) << 32 | x[3] for x in asked])
    pairs, pair = np.unique(keys, return_inverse=True)
    pair = np.repeat(pair, np.concatenate([x[4] for x in asked]))
    triples, of = np.unique(pair << 32 | np.concatenate([x[5] for x in asked]), return_inverse=True)
    n = np.bincount(of, np.concatenate([x[6] for x in asked]), len(triples))
    triples, n = triples[n > 0], n[n > 0]
    learnt, pair = np.unique(triples >> 32, return_inverse=True)
    return Trie.build(pairs[learnt], pair, triples & 0xFFFFFFFF, n, firsts, counts)


def answered(asked: DataFrame, segments: int) -> DataFrame:
    """(win, seg, found): the answers to every request."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for seg, t in groups(batches):
            lists = [read_request(x.as_py()) for x in t.column("asked")]
            trie = Trie(mapped(segment(lists)))
            found = [bundle(*trie.answers(a, a_runs, b, b_runs, c)) for a, _, a_runs, b, b_runs, c, _ in lists]
            yield pa.RecordBatch.from_arrays([t.column("win").combine_chunks(), pa.array([seg] * len(found), pa.int32()), pa.array(found, pa.binary())], names=["win", "seg", "found"])

    return asked.repartitionById(segments, "seg").mapInArrow(run, "win long, seg int, found binary")


def interpolated(windows: DataFrame, answers: DataFrame, bounds: np.ndarray, total: int, types_learnt: int) -> DataFrame:
    """SCORES of the windows' texts."""
    scale = total + 0.5 * (types_learnt + 1)

    def run(w: pa.Table, answers: pa.Table) -> pa.Table:
        tokens, lengths = unbundle(w.column("tokens")[0].as_py())[0], np.asarray(w.column("lengths")[0].as_py(), np.int64)
        types, counts = unbundle(w.column("types")[0].as_py())
        g = Grams(tokens, lengths, types, bounds)
        place = np.searchsorted(types, tokens)
        n = np.where(tokens > 0, np.append(counts, 0)[place], 0)
        single = np.log10((n + 0.5) / scale)
        p = (n + 0.5) / scale
        if answers.num_rows:
            nexts, two, left, three = (np.concatenate(x) for x in zip(*by_segment(answers, "found"), strict=True))
            distinct = np.bincount(g.type_of_first, nexts, len(types))
            back = DISCOUNT * distinct / counts
            known = g.before > 0
            weight = np.where(known, np.append(back, 1.0)[np.searchsorted(types, g.before)], 1.0)
            share = np.zeros(len(tokens))
            share[g.rows] = value(two[g.pair], 0.0)
            p = share + weight * p
            # the row of the token before has the pair before this token, and the two with it
            share, weight = np.zeros(len(tokens)), np.ones(len(tokens))
            share[g.rows], weight[g.rows] = value(three[g.triple], 0.0), value(left[g.pair], 1.0)
            later = np.ones(len(tokens), bool)
            later[g.first] = False
            later = np.flatnonzero(later)
            p[later] = share[later - 1] + weight[later - 1] * p[later]
        sums = lambda x: np.add.reduceat(x, g.first)
        docs = w.column("docs").combine_chunks().flatten()
        return pa.table(
            [docs, pa.array(lengths), pa.array(sums((n > 0).astype(np.int64))), pa.array(sums(single)), pa.array(sums(np.log10(p)))],
            names=["doc_id", "n_tokens", "n_known", "base_score", "score"],
        )

    left = windows.select("win", "docs", "lengths", "tokens", "types")
    return left.groupBy("win").cogroup(answers.groupBy("win")).applyInArrow(run, SCORES)


def score(docs: DataFrame, learn: Column) -> tuple[DataFrame, int, int]:
    """(SCORES of docs (doc_id, text), N, V) by the model of the documents that `learn` picks. Other texts are scored by adding them with learn false."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    read = written(tokenised(docs.select("doc_id", "text", F.coalesce(learn, F.lit(False)).alias("learn"))), "read")
    n_tokens, n_types = read.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n_types"), F.lit(0))).first()
    names = written(vocabulary(read, max(1, (max(partitions, n_types // WORDS) - 1).bit_length())), "names")
    types, total = names.agg(F.coalesce(F.sum("n_types"), F.lit(0)), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    windows = written(with_ids(read, names), "windows")
    removed(read)
    removed(names)
    segments = max(partitions, n_tokens // GRAMS)
    sample = windows.select(F.explode(F.col("sample").cast("array<double>")).alias("key"))
    cuts = sample.approxQuantile("key", [i / segments for i in range(1, segments)], 0.25 / segments) if n_tokens else []
    bounds = np.unique(np.asarray(cuts, np.float64).astype(np.int64))
    answers = answered(requests(windows, bounds), len(bounds) + 1)
    return interpolated(windows, answers, bounds, total, types), total, types


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 1, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores, total, _ = score(table(spark, sf_dir, "documents"), ~held_out())
    return scores.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
