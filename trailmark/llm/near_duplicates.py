"""Operator 8: n-gram Jaccard join with several global token orders.

A document's set is its distinct shingles of K words, A-Z lower-cased, as 64-bit hashes; with fewer
words the whole sequence is one shingle, without words the set is empty and linked with nothing.
Two sets link when 100 * intersection >= PERCENT * union.

Rows are written once with a number each; sets, texts and links are by row, so rows that repeat an
id, or have none, are never confused.

1. Features (one pass for frequencies, one for features): set size, 128 bits of hash of the set, and
   the prefix of n - ceil(PERCENT * n / 100) + 1 tokens under the first of ORDERS token orders. Linked sets
   share a prefix token under every global order. All orders put shingles that many documents share
   last, then go by hashes with different seeds. (Which shingles count as frequent only shapes the
   orders: any order gives the same links. So the list of them may be bounded, and is broadcast.)
2. Equal sets are one node, named by its smallest row.
3. Candidates share a prefix token under the first order, have sizes near enough to each other (part of the
   join's key, which also splits frequent tokens), and share it at places that leave enough tokens behind
   for the overlap needed: the first token that two linked sets share has such places. In a group of
   copies that differ too much, what makes them differ is rare and stands in front, so their shared
   tokens come too late; the group doesn't become all its pairs. Tokens of one node only are dropped.
   Each token's nodes are first paired with one of them alone, so copies in a large group meet a few
   hubs and not each other: the one that has the token furthest in front, hence the fewest rare
   shingles, as what the others are copies of has. Then all pairs whose nodes aren't yet in one component follow.
4. Candidates must share prefix tokens under the other orders as well (intersection of the filters).
5. Those left are verified on the words of the whole texts, not on hashes.

Null text: empty set. Null doc_id: the row is returned with a null component and links nothing (in
kept() such rows are compared like all others). Rows that repeat an id: each has its own set; what
one of them reaches, the id reaches. Extra columns aren't carried by join(), all by kept(). Empty table: empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shingles as S
from .common import removed, shuffles_removed, table, written
from .components import components

K, PERCENT, ORDERS = 4, 85, 3
#: Shingles counted as frequent: in at least FREQUENT documents; at most MOST of them, 9 MB, are told to all tasks.
FREQUENT, MOST, WINDOW = 8, 1_000_000, 4_000_000
U = np.uint64
T = TypeVar("T")
SEEDS = (U(0), U(0x243F6A8885A308D3), U(0x13198A2E03707344), U(0xA4093822299F31D0))
STIR, STIR_MORE = U(0x452821E638D01377), U(0xBE5466CF34E90C6C)
FEATURES = "row long, doc_id long, n_shingles long, set_hash long, set_more long, prefix array<long>"
SET = ["n_shingles", "set_hash", "set_more"]
#: Nodes up to this number, 32 MB at most, are broadcast to pick their texts; more are joined by shuffling.
BROADCAST = 2_000_000
#: Characters of texts whose shingles a task holds at once, so that long texts don't add up.
HELD = 1 << 20


def frequent(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, frequency classes) of the most frequent shingles, sorted by shingle.

    Tasks count within windows of WINDOW shingles and report those seen twice or more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def report() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            twice = n > 1
            return pa.RecordBatch.from_arrays([pa.array(h[twice].view(np.int64)), pa.array(n[twice])], names=["h", "n"])

        for b in batches:
            for _, _, raw in S.blocks(b.column(0).to_pylist()):
                h, _ = S.of_block(raw, k)
                held.append(h)
                size += len(h)
                if size >= WINDOW:
                    yield report()
                    held, size = [], 0
        if held:
            yield report()

    counts = docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    top = counts.where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "h").limit(MOST).toPandas()
    top = top.assign(h=top["h"].to_numpy(np.int64).view(np.uint64)).sort_values("h")
    return top["h"].to_numpy(U), np.frexp(top["n"].to_numpy(float))[1].astype(np.uint8)


def sizes(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n_shingles, component_id) of rows without an id, which link nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [len(S.distinct((x.as_py() or "").encode("utf-8", "surrogatepass"), k)) for x in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64())], names=["n_shingles"])

    null = F.lit(None).cast("long")
    return docs.select("text").mapInArrow(run, "n_shingles long").select(null.alias("doc_id"), "n_shingles", null.alias("component_id"))


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    needed = -(-percent * n // 100)
    return np.where(n > 0, n - needed + 1, 0)


def ordered(h: np.ndarray, n: np.ndarray, common: tuple[np.ndarray, np.ndarray], orders: range, percent: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The prefixes of sets (h: their tokens, n: their sizes) under some orders, and the prefixes' lengths."""
    known, classes = common
    owner = np.repeat(np.arange(len(n)), n)
    level = np.zeros(len(h), U)
    if len(known) and len(h):
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        level = np.where(known[at] == h, classes[at], 0).astype(U) << U(56)
    p = prefix_length(n, percent)
    chosen = np.arange(len(h)) - (np.cumsum(n) - n)[owner] < p[owner]
    return [h[np.lexsort((level | S.mixed(h ^ SEEDS[i]) >> U(8), owner))][chosen] for i in orders], p


def features(docs: DataFrame, k: int, percent: int, common: Broadcast) -> DataFrame:
    """FEATURES of docs (row, doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for begin, end, raw in S.blocks(b.column(2).to_pylist()):
                h, n = S.of_block(raw, k)
                (prefix,), p = ordered(h, n, common.value, range(1), percent)
                cuts = np.append(0, np.cumsum(p)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(begin, end - begin), b.column(1).slice(begin, end - begin), pa.array(n.astype(np.int64)),
                        *(pa.array(S.sums(S.mixed(h ^ x), n).view(np.int64)) for x in (STIR, STIR_MORE)), pa.ListArray.from_arrays(cuts, pa.array(prefix.view(np.int64))),
                    ],
                    names=["row", "doc_id", *SET, "prefix"],
                )

    return docs.select("row", "doc_id", "text").mapInArrow(run, FEATURES)


def remembered(make: Callable[[str], T], most: int) -> Callable[[str], T]:
    """make, with its results for the latest texts held: of at most `most` characters in all, or of one text."""
    held: dict[str, T] = {}
    size = 0

    def get(text: str) -> T:
        nonlocal size
        if text not in held:
            if size + len(text) > most:
                held.clear()
                size = 0
            held[text] = make(text)
            size += len(text)
        return held[text]

    return get


def verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int, common: Broadcast) -> DataFrame:
    """The pairs (a, b) that pass the other orders' filters and link, written. Rows stream; no group is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def prefixes(text: str) -> list[np.ndarray]:
            h, n = S.of_block([text.encode("utf-8", "surrogatepass")], k)
            return ordered(h, n, common.value, range(1, ORDERS), percent)[0]

        of = remembered(prefixes, HELD)
        shingles = remembered(lambda text: S.distinct(text.encode("utf-8", "surrogatepass"), k), HELD)

        def links(x: str, y: str) -> bool:
            if not all(np.isin(p, q).any() for p, q in zip(of(x), of(y), strict=True)):
                return False
            one, two = shingles(x), shingles(y)
            both = len(one & two)
            return 100 * both >= percent * (len(one) + len(two) - both)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                mask = pa.array([links(x, y) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], names=["a", "b"])

    nodes = written(pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct(), "nodes")
    picked = F.broadcast(nodes) if nodes.count() <= BROADCAST else nodes
    texts = written(docs.select("row", F.coalesce("text", F.lit("")).alias("text")).join(picked, "row", "left_semi"), "texts")
    b = texts.select(F.col("row").alias("b"), F.col("text").alias("_tb"))
    a = texts.select(F.col("row").alias("a"), F.col("text").alias("_ta"))
    rows = pairs.join(b, "b").join(a, "a").select("a", "b", "_ta", "_tb")
    found = written(rows.mapInArrow(run, "a long, b long").distinct(), "links")
    removed(nodes)
    removed(texts)
    return found


def grouped(docs: DataFrame, k: int, percent: int, by_id: bool) -> DataFrame:
    """(row, doc_id, n_shingles, component) of docs (row, doc_id, text); component: a row of the group that links make, its own if n_shingles is 0.

    by_id: rows of one id are one document.
    """
    sc = docs.sparkSession.sparkContext
    common = sc.broadcast(frequent(docs, k))
    feats = written(features(docs, k, percent, common), "features")
    known = feats.where("n_shingles > 0")
    classes = written(known.groupBy(*SET).agg(F.min("row").alias("node")), "classes")

    # one row stands for equal sets
    placed = written(known.select("row", "doc_id", *SET).join(classes, SET).select("row", "doc_id", "node"), "placed")
    removed(classes)
    others = placed.where("row <> node").select("row")
    others = F.broadcast(others) if others.count() <= BROADCAST else others
    alone = known.join(others, "row", "left_anti")
    rows = alone.select(F.posexplode("prefix").alias("at", "token"), "row", "n_shingles").select("token", F.col("row").alias("node"), (F.col("n_shingles") * 2**32 + F.col("at")).alias("_m"))
    nodes = rows.repartition("token").select("token", "node", F.shiftright("_m", 32).alias("n"), (F.shiftright("_m", 32) - F.col("_m") % 2**32).alias("rest"))
    many, hub = F.count("*").over(Window.partitionBy("token")), F.min(F.struct(F.col("n") - F.col("rest"), "node")).over(Window.partitionBy("token"))["node"]
    posting = written(nodes.withColumns({"many": many, "hub": hub}).where("many > 1").drop("many"), "postings")
    counted = written(feats.select("row", "doc_id", "n_shingles"), "counted")
    removed(feats)
    # the overlap needed is PERCENT / (100 + PERCENT) of both sizes, and what is left from the token on must reach it
    enough = F.least("ra", "rb") * (100 + percent) >= (F.col("na") + F.col("nb")) * percent

    tops = posting.where("node = hub").select("token", F.col("n").alias("nb"), F.col("rest").alias("rb"))
    spokes = posting.where("node <> hub").select("token", F.col("node").alias("a"), F.col("hub").alias("b"), F.col("n").alias("na"), F.col("rest").alias("ra"))
    hubs = written(spokes.join(tops, "token").where(enough).select("a", "b").distinct(), "hubs")
    first = verified(hubs, docs, k, percent, common)
    removed(hubs)
    parts = written(components(first), "parts")

    tagged = posting.join(parts, "node", "left").select("token", "node", "n", "rest", F.coalesce("component", "node").alias("component"))
    two = F.min("component").over(Window.partitionBy("token")) != F.max("component").over(Window.partitionBy("token"))
    tagged = written(tagged.select("*", two.alias("two")).where("two").drop("two"), "tagged")
    removed(posting)
    # a linked set's size is at most 100 / PERCENT times the smaller one's: it lies in the same or the next class of sizes
    size = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent + 1e-6)).cast("int")
    left = tagged.select("token", F.explode(F.array(size, size + 1)).alias("size"), F.col("node").alias("a"), F.col("n").alias("na"), F.col("rest").alias("ra"), F.col("component").alias("ca"))
    right = tagged.select("token", size.alias("size"), F.col("node").alias("b"), F.col("n").alias("nb"), F.col("rest").alias("rb"), F.col("component").alias("cb"))
    smaller = (F.col("na") < F.col("nb")) | (F.col("na") == F.col("nb")) & (F.col("a") < F.col("b"))
    pairs = written(left.join(right, ["token", "size"]).where(smaller & (F.col("ca") != F.col("cb")) & enough).select("a", "b").distinct(), "pairs")
    removed(tagged)
    second = verified(pairs, docs, k, percent, common)
    removed(pairs)

    links = first.unionByName(second)
    if by_id:
        least = placed.groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("_m")).where("b <> _m").drop("_m")
        links = links.unionByName(placed.join(least, "doc_id").select(F.col("node").alias("a"), "b").where("a <> b").distinct())
    named = placed.join(components(links), "node", "left").select("row", F.coalesce("component", "node").alias("component"))
    return counted.join(named, "row", "left").select("row", "doc_id", "n_shingles", F.coalesce("component", "row").alias("component"))


def numbered(docs: DataFrame) -> DataFrame:
    """docs with a number for each row, written, so that it stays."""
    return written(docs.withColumn("row", F.monotonically_increasing_id()), "rows")


def join(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of docs (doc_id, text), a row for each row."""
    with shuffles_removed(docs.sparkSession):
        rows = numbered(docs.select("doc_id", "text"))
        found = written(grouped(rows.where(F.col("doc_id").isNotNull()), k, percent, True), "found")
    # most components are of one row, named by itself
    least = found.where("n_shingles > 0").groupBy("component").agg(F.min("doc_id").alias("least"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    linked = found.join(least, "component", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("least", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
    nameless = sizes(rows.where(F.col("doc_id").isNull()), k)
    return linked.unionByName(nameless)


def kept(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs without near duplicates: of each group of rows one stays, that with the smallest id (none: last), then the first.

    Rows that repeat an id, or have none, are documents of their own. Rows without words all stay.
    """
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    with shuffles_removed(docs.sparkSession):
        rows = numbered(docs)
        found = written(grouped(rows, k, percent, False), "found")
        chosen = found.groupBy("component").agg(F.min(order).alias("_o"), F.count("*").alias("_n")).where("_n > 1").select("component", F.col("_o.row").alias("_c"))
        # those that go are fewer than those that stay, so rows are seldom shuffled for them
        gone = written(found.join(chosen, "component").where("row <> _c").select("row"), "gone")
        removed(found)
        few = gone.count() <= BROADCAST
    return rows.join(F.broadcast(gone) if few else gone, "row", "left_anti").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS g
  FROM d),
n AS (SELECT doc_id, len(g) AS n FROM s),
t AS (SELECT doc_id, unnest(g) AS g FROM s),
p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
  FROM t x JOIN t y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (
  SELECT a, b FROM p JOIN n u ON u.doc_id = a JOIN n v ON v.doc_id = b
  WHERE 100 * c >= 85 * (u.n + v.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (
  WITH RECURSIVE reach(a, b) AS (
    SELECT doc_id, doc_id FROM n UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b)
  SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, r.c AS component_id FROM n JOIN r ON r.a = n.doc_id
"""
