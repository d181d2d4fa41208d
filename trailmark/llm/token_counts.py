"""Operator 2: token counts by heap-and-linked-list byte-pair merging, without making ids.

For SentencePiece BPE models with byte fallback, identity normalisation and a dummy prefix. A text
is symbols, one a character (space is U+2581). A heap holds adjacent pairs that are pieces of the
vocabulary, by rank, then place; a linked list joins what is merged. The count is the initial
symbols minus the merges, a character outside the vocabulary counting as its UTF-8 bytes.

Merges never cross two adjacent characters that no piece holds side by side. So a text is cut there
(before spaces first), and each distinct cut is merged once a worker; a bounded memo holds counts.

Null or empty text: 0 tokens, 0 bytes. Very long texts and words cost n log n. Rows are counted one
by one, so ties, repeated rows and empty tables need nothing special. Extra columns are carried
where `keep` names them, but for n_bytes and n_tokens.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table
from .word_ids import vocabulary

VOCABULARY, LIMIT = "piece_bpe_32k.model", 4096
SPACE = "▁"
RUNS = re.compile(r" +[^ ]*")
WORDS, CUTS = 400_000, 400_000
NORMAL, USER_DEFINED, UNUSED = 1, 4, 5


class Counter:
    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if not (model.trainer_spec.model_type == 2 and model.trainer_spec.byte_fallback and spec.add_dummy_prefix) or spec.precompiled_charsmap or spec.remove_extra_whitespaces:
            raise ValueError("only BPE models with byte fallback, a dummy prefix and identity normalisation are supported")
        if any(p.type in (USER_DEFINED, UNUSED) for p in model.pieces):
            raise ValueError("models with user-defined or unused pieces aren't supported")
        order = sorted((-p.score, i, p.piece) for i, p in enumerate(model.pieces) if p.type == NORMAL)
        self.rank = {piece: n for n, (_, _, piece) in enumerate(order)}
        self.pairs = {piece[i : i + 2] for piece in self.rank for i in range(len(piece) - 1)}
        self.splits_before_space = not any(p[1] == SPACE != p[0] for p in self.pairs)
        self.words: dict[str, int] = {}
        self.cuts: dict[str, int] = {}

    def merged(self, cut: str) -> int:
        """Tokens of a string of symbols, by merging."""
        rank = self.rank
        symbols = list(cut)
        n = len(symbols)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := rank.get(cut[i : i + 2])) is not None]
        heapify(heap)
        merges = 0
        while heap:
            _, i, size = heappop(heap)
            j = after[i] if symbols[i] else n
            if j >= n or len(symbols[i]) + len(symbols[j]) != size:
                continue  # one of the two has been merged since
            symbols[i] += symbols[j]
            symbols[j] = ""
            merges += 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                both = symbols[i] + symbols[k]
                if (r := rank.get(both)) is not None:
                    heappush(heap, (r, i, len(both)))
            h = before[i]
            if h >= 0:
                both = symbols[h] + symbols[i]
                if (r := rank.get(both)) is not None:
                    heappush(heap, (r, h, len(both)))
        initial = sum(1 if c in rank else len(c.encode("utf-8", "surrogatepass")) for c in cut)
        return initial - merges

    def _word(self, word: str) -> int:
        """Tokens of a run of spaces with what follows; spaces are SPACE here."""
        total, begin, pairs, cuts = 0, 0, self.pairs, self.cuts
        for i in range(1, len(word) + 1):
            if i == len(word) or word[i - 1 : i + 1] not in pairs:
                cut = word[begin:i]
                n = cuts.get(cut)
                if n is None:
                    if len(cuts) >= CUTS:
                        cuts.clear()
                    n = self.merged(cut)
                    if len(cut) <= 64:
                        cuts[cut] = n
                total += n
                begin = i
        return total

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if SPACE in text or not self.splits_before_space:
            return self._word(SPACE + text.replace(" ", SPACE))
        words = text.split(" ")
        if "" in words:
            words = [x[1:] for x in RUNS.findall(" " + text)]
        held = self.words
        if missing := {w for w in words if w not in held}:
            if len(held) + len(missing) > WORDS:
                held.clear()
                missing = set(words)
            for w in missing:
                held[w] = self._word(SPACE + w.replace(" ", SPACE))
        return sum(map(held.__getitem__, words))


@lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    """One for each Python worker and vocabulary."""
    return Counter(path)


def counted(docs: DataFrame, path: str | None = None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """keep (all columns but the text by default), n_bytes and n_tokens."""
    path = path or vocabulary(VOCABULARY)
    carried = [c for c in (keep if keep is not None else docs.columns) if c not in ("n_bytes", "n_tokens", text)]
    # the bytes of a text are counted before it leaves the JVM
    rows = docs.select(*carried, F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for b in batches:
            made = pa.array([count(x) for x in b.column("_text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], made], names=[*b.schema.names[:-1], "n_tokens"])

    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("n_tokens", T.LongType())])
    return rows.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(table(spark, sf_dir, "documents"), keep=["doc_id"]).withColumn("over_limit", F.col("n_tokens") > LIMIT)
