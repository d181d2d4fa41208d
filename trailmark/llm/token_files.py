"""Operator 4: token ids written as range-coded shards, and read back.

Documents are encoded, an end id is appended to each, and shards hold consecutive ranges of doc_id:
the ranges come from quantiles of the ids alone, so no text is read for them; an id (or the missing
one) that holds more rows than a shard is dealt out over several by a checksum of its texts' ids.
Each shard is one task's. A shard is a sequence
of blocks of whole documents, at least BLOCK ids each but the last (see range_coder). The file
format is a Parquet table with a row for each block: shard, block, n_ids, the documents' ids and
lengths, and the coded payload. Blocks stand alone: one is decoded without any other, and a lost
task's blocks are simply made again.

Null text: the end id alone. Null doc_id: first. Ties and repeated rows: documents of the same id
stand side by side, ordered by checksum. Empty table: no blocks. Extra columns aren't stored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import range_coder
from .common import shared_dir, table
from .word_ids import crc32, vocabulary, word_ids

VOCABULARY, END, BLOCK = "word_bpe_49k.json", 1, 1 << 20
LEAST = -(1 << 63)
BLOCKS = "shard int, block long, n_ids long, doc_ids array<long>, lengths array<long>, payload binary"
ROWS = "shard int, block long, place long, doc_id long, front long, n_tokens long, ids_crc32 long"


def encoded(docs: DataFrame, path: str, end: int, shards: int) -> DataFrame:
    """(shard, doc_id, tie, ids) of docs (doc_id, text); ids as little-endian unsigned 16 or 32 bits, tie: their crc32."""
    tail = struct.pack("<I", end)
    cuts: list[float] = []
    if shards > 1:
        known = docs.select(F.coalesce("doc_id", F.lit(LEAST)).cast("double").alias("doc_id"))
        cuts = sorted(known.approxQuantile("doc_id", [i / shards for i in range(1, shards)], 0.2 / shards))
    bounds = np.asarray(cuts, np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(path)
        small = encoder.size <= 1 << 16
        for b in batches:
            for at, raws in encoder.chunks(b.column(1)):
                raws = [x + tail for x in raws]
                if small:
                    raws = [np.frombuffer(x, "<u4").astype("<u2").tobytes() for x in raws]
                ids = b.column(0).slice(at, len(raws))
                tie = np.fromiter(map(crc32, raws), np.int64, len(raws))
                # an id that several bounds name holds that many shards' worth of rows: its rows are dealt out by tie
                key = ids.fill_null(LEAST).cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False)
                low, high = np.searchsorted(bounds, key), np.searchsorted(bounds, key, side="right")
                of = low + (tie * (high - low + 1) >> 32)
                yield pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), ids, pa.array(tie), pa.array(raws, pa.binary())], names=["shard", "doc_id", "tie", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "shard int, doc_id long, tie long, ids binary")


def blocks(rows: DataFrame, alphabet: int, size: int = BLOCK) -> DataFrame:
    """BLOCKS of rows (shard, doc_id, ids) that are sorted by shard, doc_id and tie within partitions."""
    kind = "<u2" if alphabet <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, bytes]] = []
        total, shard, number = 0, None, 0
        width = int(kind[-1])

        def close() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(x for _, x in held), kind).astype("<u4")
            row = {
                "shard": pa.array([shard], pa.int32()),
                "block": pa.array([number], pa.int64()),
                "n_ids": pa.array([len(ids)], pa.int64()),
                "doc_ids": pa.array([[d for d, _ in held]], pa.list_(pa.int64())),
                "lengths": pa.array([[len(x) // width for _, x in held]], pa.list_(pa.int64())),
                "payload": pa.array([range_coder.encode(ids, alphabet)], pa.binary()),
            }
            return pa.RecordBatch.from_arrays(list(row.values()), names=list(row))

        for b in batches:
            for s, d, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if held and (s != shard or total >= size):
                    yield close()
                    number = number + 1 if s == shard else 0
                    held, total = [], 0
                elif s != shard:
                    number = 0
                shard = s
                held.append((d, raw))
                total += len(raw) // width
        if held:
            yield close()

    return rows.mapInArrow(run, BLOCKS)


def write(docs: DataFrame, folder: str, path: str | None = None, end: int = END, size: int = BLOCK) -> None:
    """docs (doc_id, text) into folder, as many shards as the session has shuffle partitions."""
    path = path or vocabulary(VOCABULARY)
    shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = encoded(docs, path, end, shards).repartitionById(shards, "shard").sortWithinPartitions("shard", "doc_id", "tie", "ids")
    blocks(rows.drop("tie"), word_ids(path).size, size).write.parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in folder, from its decoded blocks."""
    stored = spark.read.schema(BLOCKS).parquet(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                docs, lengths = b.column("doc_ids")[i].as_py(), np.asarray(b.column("lengths")[i].as_py(), np.int64)
                raw = range_coder.decode(b.column("payload")[i].as_py()).tobytes()
                ends = np.cumsum(lengths)
                if ends[-1] * 4 != len(raw):
                    raise range_coder.CorruptBlock("documents' lengths differ from the block's")
                crcs = [crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                n = len(docs)
                cols = (
                    pa.array(np.full(n, b.column("shard")[i].as_py(), np.int32)), pa.array(np.full(n, b.column("block")[i].as_py(), np.int64)), pa.array(np.arange(n)),
                    pa.array(docs, pa.int64()), pa.array(ends - lengths), pa.array(lengths), pa.array(crcs, pa.int64()),
                )
                yield pa.RecordBatch.from_arrays(list(cols), names=["shard", "block", "place", "doc_id", "front", "n_tokens", "ids_crc32"])

    sizes = stored.select("shard", "block", "n_ids")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    in_shard = before(Window.partitionBy("shard").orderBy("block"))
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("_n"))  # a row a shard
    shards = shards.select("shard", F.coalesce(F.sum("_n").over(before(Window.orderBy("shard"))), F.lit(0)).alias("_s"))
    starts = sizes.select("shard", "block", F.coalesce(F.sum("n_ids").over(in_shard), F.lit(0)).alias("_b")).join(shards, "shard")
    return (
        stored.mapInArrow(run, ROWS)
        .join(starts, ["shard", "block"])
        .select("doc_id", (F.col("_s") + F.col("_b") + F.col("front")).cast("long").alias("start"), "n_tokens", "ids_crc32")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/ids"
    write(table(spark, sf_dir, "documents"), folder)
    return read(spark, folder)
