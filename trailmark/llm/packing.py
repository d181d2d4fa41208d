"""Operator 7: hierarchical residual packing of token sequences.

Documents are tokenized once into pieces (only longer ones than the capacity are cut). Pieces are
dealt out by a hash of their number, whatever they hold, about ITEMS to a partition and two partitions at
least; every partition packs its own by best fit, longest first. Nearly full
sequences are done. The underfull ones then act as items themselves: groups of FAN partitions pack
theirs together, then groups of groups, until one group is left. These rounds move only
(sequence, used) pairs. What a group hands on is bounded: at most one sequence up to half full
remains in a group, so of the fuller ones no more can find a partner than there are groups.

Null text: the end id alone. Empty text: likewise. Ties and repeated rows: every row is packed, in
its own right, and rows that repeat an id keep that id. Empty table: empty result. Extra columns
aren't carried.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .word_ids import crc32, vocabulary, word_ids

CAPACITY, END, FAN, NEARLY_FULL, ITEMS = 2048, 0, 8, 0.99, 20_000
VOCABULARY = "word_bpe_49k.json"
#: Bytes of text whose words a task tells apart at once; fewer than op4's, as pipeline runs this in workers that other stages have filled.
CHUNK = 1 << 21
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of docs (doc_id, text)."""
    tail = struct.pack("<I", end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(path)
        for b in batches:
            rows: list[tuple[int | None, int, int, int, int]] = []
            docs_of = b.column(0).to_pylist()
            for first, raws in encoder.chunks(b.column(1), CHUNK):
                for doc, raw in zip(docs_of[first : first + len(raws)], raws, strict=True):
                    raw += tail
                    for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                        part = raw[at : at + 4 * capacity]
                        rows.append((doc, k, k * capacity, len(part) // 4, crc32(part)))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECE_SCHEMA)


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each item, its offset there, used length of each bin), longest items first.

    Open bins are kept by free space; the tightest fit is the lowest set bit of a mask of spaces.
    """
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    used: list[int] = []
    by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    order = np.argsort(-lengths, kind="stable")
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = mask >> n
        if fits:
            space = n + (fits & -fits).bit_length() - 1
            b = by_space[space].pop()
            if not by_space[space]:
                mask &= ~(1 << space)
        else:
            b, space = len(used), capacity
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += n
        space -= n
        if space:
            by_space[space].append(b)
            mask |= 1 << space
    return bins, offsets, np.asarray(used, np.int64)


def local(items: DataFrame, capacity: int) -> DataFrame:
    """items with bin, offset, used (of its bin) and part (its partition)."""
    schema = f"{PIECE_SCHEMA}, bin long, offset long, used long, part int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        t = pa.Table.from_batches(held)
        bins, offsets, used = best_fit(np.asarray(t.column("length")), capacity)
        part = TaskContext.get().partitionId()
        t = t.append_column("bin", pa.array(bins + (part << 32))).append_column("offset", pa.array(offsets))
        t = t.append_column("used", pa.array(used[bins] if len(bins) else bins)).append_column("part", pa.array(np.full(len(bins), part, np.int32)))
        yield from t.to_batches(max_chunksize=100_000)

    return items.mapInArrow(run, schema)


def merge_round(bins: DataFrame, groups: int, capacity: int) -> DataFrame:
    """bins (bin, used, part) packed as items within groups of FAN parts: (bin, target, base, used, part, again).

    target: the bin that now holds it, from base on; used: of the target; part: the group;
    again: whether the target goes on to the next round.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["used", "bin"], ascending=[False, True], kind="stable").reset_index(drop=True)
        at, offset, used = best_fit(pdf["used"].to_numpy(np.int64), capacity)
        first = pdf.assign(at=at, offset=offset).query("offset == 0").set_index("at")["bin"]
        small = used * 2 <= capacity
        open_ = used < NEARLY_FULL * capacity
        fuller = np.flatnonzero(open_ & ~small)
        fuller = fuller[np.argsort(used[fuller], kind="stable")][:groups]
        again = small.copy()
        again[fuller] = True
        return pd.DataFrame(
            {"bin": pdf["bin"], "target": first.loc[at].to_numpy(), "base": offset, "used": used[at], "part": (pdf["part"] // FAN).astype("int32"), "again": again[at]}
        )

    schema = "bin long, target long, base long, used long, part int, again boolean"
    keyed = bins.select("bin", "used", "part", F.floor(F.col("part") / FAN).cast("int").alias("_g"))
    return keyed.groupBy("_g").applyInPandas(lambda pdf: run(pdf.drop(columns="_g")), schema)


def pack(items: DataFrame, capacity: int = CAPACITY, per_part: int = ITEMS) -> DataFrame:
    """items (PIECE_SCHEMA, read from a written table, as they are numbered) with sequence_id and offset; `length` is at most capacity."""
    parts = max(2, -(-items.count() // per_part))
    dealt = items.withColumn("_k", F.monotonically_increasing_id()).repartition(parts, F.xxhash64("_k")).drop("_k")
    placed = written(local(dealt, capacity), "local")
    parts = (placed.agg(F.max("part")).first()[0] or 0) + 1
    # at most `parts` fuller bins of a part can ever meet one that is up to half full
    heads = placed.where((F.col("offset") == 0) & (F.col("used") < NEARLY_FULL * capacity)).select("bin", "used", "part")
    opened = written(heads, "open")
    moves = None
    while parts > 1:
        parts = -(-parts // FAN)
        done = written(merge_round(opened, parts, capacity), "round")
        step = done.select("bin", "target", "base")
        if moves is None:
            moves = step
        else:
            nxt = step.select(F.col("bin").alias("_b"), F.col("target").alias("_t"), F.col("base").alias("_o"))
            moves = moves.join(nxt, moves["target"] == nxt["_b"], "left").select(
                "bin", F.coalesce("_t", "target").alias("target"), (F.col("base") + F.coalesce("_o", F.lit(0))).alias("base")
            )
        opened = done.where("again and base = 0").select(F.col("target").alias("bin"), "used", "part")
    if moves is None:
        return placed.withColumnRenamed("bin", "sequence_id").drop("used", "part")
    moves = moves.where("base > 0 or target <> bin").withColumnRenamed("bin", "_bin")
    return placed.join(moves, placed["bin"] == moves["_bin"], "left").select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.coalesce("target", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset"),
    )


def packed(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    return pack(written(pieces(docs, path or vocabulary(VOCABULARY), capacity, end), "pieces"), capacity)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
