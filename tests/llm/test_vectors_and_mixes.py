"""Nearest neighbours, mixing, packing and the pipeline, by brute force on small fixtures."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from trailmark.llm import mixing, nearest, packing, registry
from trailmark.llm.common import written
from trailmark.llm.word_ids import vocabulary, word_ids

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_nearest_is_exact(spark):
    r = np.random.default_rng(1)
    v = r.normal(size=(400, 8)).astype(np.float32)
    v[10:40] = v[10]  # ties
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    rows += [(1000, None), (1100, [0.0] * 8), (1200, [1.0] * 7 + [float("nan")]), (1300, [float("inf")] * 8), (1400, [None] + [1.0] * 7), (1500, [1.0, 2.0]), (40, v[40].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("mine"))
    got = {}
    for x in nearest.nearest(df, F.col("vec_id") % 20 == 0, 5).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    ids = np.array([i for i, x in rows if i < 400])
    m = np.array([x for i, x in rows if i < 400], float)
    for q in range(0, 400, 20):
        if q == 40:
            continue  # twice in the table
        d = np.sqrt(np.square(m - v[q].astype(float)).sum(axis=1))
        best = sorted((dd, i) for dd, i in zip(d, ids, strict=True) if i != q)[:5]
        assert [(k + 1, i) for k, (_, i) in enumerate(best)] == [x[:2] for x in sorted(got[q])]
        assert [x[2] for x in sorted(got[q])] == pytest.approx([dd for dd, _ in best])
    assert 1500 not in got and 1100 not in got
    assert nearest.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0).count() == 0


def shares(sizes: dict, cap=3):
    """Targets by refilling until none is above its limit."""
    weight = {s: i % 3 + 1 for i, s in enumerate(sorted(sizes, key=lambda x: (x is None, x or "")))}
    full, total = {}, sum(sizes.values())
    while True:
        left, open_ = total - sum(full.values()), [s for s in sizes if s not in full]
        w = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / w >= cap * sizes[s]]
        if not over:
            return {s: full.get(s, left * weight[s] / w if s not in full else 0) for s in sizes}
        full |= {s: cap * sizes[s] for s in over}


def test_mixing_by_brute_force(spark):
    r = random.Random(2)
    rows = [(i, "w " * r.randint(0, 40), r.choice(["a", "b", "b", "b", "b", None, "é"])) for i in range(300)] + [(300, None, "a"), (7, "x y", "a"), (7, "x y", "a"), (None, "no id", "b"), (301, "", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("target", F.lit("mine"))
    got = mixing.take(mixing.sized(df, [])).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = shares(sizes)
    for s in sizes:
        mine = [x for x in got if x.source == s]
        assert mine[0].target == pytest.approx(want[s]) and mine[0].source_size == sizes[s]
        assert sum(x.taken for x in mine) == int(want[s] + 0.5)
        assert all(0 <= x.taken <= 3 * x.size for x in mine)
    again = mixing.take(mixing.sized(df.repartition(5), [])).collect()
    key = lambda x: (x.source or "", str(x.doc_id), x.before, x.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    x = next(x for x in got if x.source == "b" and x.size)
    assert hashlib.md5(f"mix-1:{x.doc_id}".encode()).hexdigest()
    assert mixing.take(mixing.sized(spark.createDataFrame([], DOCS), [])).count() == 0


def test_mixed_documents_come_near_their_targets(spark):
    r = random.Random(3)
    rows = [(i, "w " * r.randint(1, 30), "en", r.choice("aab"), 0) for i in range(200)]
    df = spark.createDataFrame(rows, DOCS)
    out = mixing.mixed(df)
    assert out.columns == df.columns
    targets = {x.source: x.target for x in mixing.targets(mixing.sized(df, [])).collect()}
    for x in out.groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " "))).alias("n")).collect():
        assert abs(x.n - targets[x.source]) <= 30


def test_best_fit_packs_well_and_rightly():
    r = np.random.default_rng(4)
    lengths = r.integers(1, 2049, 5000)
    bins, offsets, used = packing.best_fit(lengths)
    assert used.max() <= 2048 and len(used) <= 1.02 * lengths.sum() / 2048 + 1
    for b in range(len(used)):
        mine = np.flatnonzero(bins == b)
        mine = mine[np.argsort(offsets[mine])]
        assert (np.cumsum(lengths[mine]) - lengths[mine] == offsets[mine]).all() and lengths[mine].sum() == used[b]


def test_packing_is_gapless_and_whole(spark):
    r = random.Random(5)
    rows = [(i, " ".join(r.choice(["cat", "dog", "sat", "unbelievable"]) for _ in range(r.choice([1, 30, 300, 900, 5000]))), "en", "s", 0) for i in range(80)]
    rows += [(100, None, None, None, 0), (101, "", None, None, 0), (5, rows[5][1], "en", "s", 0)]
    df = spark.createDataFrame(rows, DOCS).withColumn("offset", F.lit("mine")).repartition(7)
    items = packing.pieces(df, vocabulary("word_bpe_49k.json"))
    got = packing.pack(items, per_part=20).collect()  # several partitions and rounds
    words = word_ids(vocabulary("word_bpe_49k.json"))
    ids = {i: words.ids([t])[0] + b"\0\0\0\0" for i, t, *_ in rows}
    want = sum(-(-len(ids[i]) // 4 // 2048) for i, *_ in rows)
    assert len(got) == want
    for x in got:
        part = ids[x.doc_id][4 * x.start : 4 * (x.start + x.length)]
        assert x.start == 2048 * x.piece and packing.crc32(part) == x.ids_crc32
    by = {}
    for x in got:
        by.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
    assert len(by) <= 1.1 * sum(len(ids[i]) // 4 for i, *_ in rows) / 2048 + 2
    assert packing.packed(spark.createDataFrame([], DOCS)).count() == 0


def test_pipeline_stages_and_registry(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "mixing", "packing"]
    r = random.Random(6)
    words = [f"word{i}" for i in range(300)]
    clean = [(i, " ".join(r.choice(words) for _ in range(120)), "en", f"s{i % 2}", 0) for i in range(20)]
    rows = [*clean, (50, clean[0][1], "en", "s0", 0), (51, "short", "en", "s0", 0), (52, None, None, None, None), (53, "@#$% ### $$$ " * 40, "en", "s1", 0)]
    df = spark.createDataFrame(rows, DOCS)
    kept = corpus_pipeline.quality(spark, df, "")
    assert {x.doc_id for x in kept.collect()} == {*range(20), 50}
    single = corpus_pipeline.near_duplicate(spark, kept, "")
    assert sorted(x.doc_id for x in single.collect()) == list(range(20)) and single.columns == df.columns
    mixed = corpus_pipeline.mix(spark, single, "")
    assert mixed.columns == df.columns and mixed.count() > 0
    packed = corpus_pipeline.pack(spark, mixed, "")
    assert packed.agg(F.sum(F.when(F.col("piece") == 0, 1))).first()[0] == mixed.count()
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))


def test_nearest_of_huge_and_tiny_vectors(spark):
    """Squares that overflow or underflow, in one table with ordinary vectors: Decimal arithmetic as brute force."""
    from decimal import Decimal, localcontext

    rows = [(100, [1e160, 2e160]), (1, [1e160, 1e160]), (2, [3e160, 2e160]), (3, [1.0, 2.0]), (200, [1.0, 1.0]), (4, [1e-200, 1e-200]), (300, [2e-200, 1e-200]), (5, [1.0, 1.5]), (6, [-1e160, 2e160]), (7, [3e-200, 0.0])]
    got = {}
    for r in nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    with localcontext() as c:
        c.prec, c.Emax, c.Emin = 60, 10**6, -(10**6)
        for q in (100, 200, 300):
            a = dict(rows)[q]
            far = sorted((sum((Decimal(x) - Decimal(y)) ** 2 for x, y in zip(a, v, strict=True)).sqrt(), i) for i, v in rows if i != q)
            found = sorted(got[q])
            assert len(found) == 9 and all(s == pytest.approx(float(d), rel=1e-12) for (_, _, s), (d, _) in zip(found, far, strict=True))


def test_packing_rounds_run_at_every_size(spark):
    rows = [(i, 0, 0, 1 + (i * 7919) % 2048, i) for i in range(300)] + [(None, 0, 0, 700, 0)] * 40
    items = written(spark.createDataFrame(rows, packing.PIECE_SCHEMA))
    whole = len(packing.best_fit(np.array([r[3] for r in rows]))[2])
    for per_part in (packing.ITEMS, 20):
        out = packing.pack(items, per_part=per_part).collect()
        used = {}
        for r in out:
            used.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for parts in used.values():
            ends = [0, *(o + n for o, n in sorted(parts))]
            assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 2048
        assert len(out) == len(rows) and len(used) <= 1.06 * whole + 1


def test_pipeline_of_repeated_ids_nulls_and_nothing(spark, tmp_path):
    """run() over odd rows: no text without a near duplicate goes, whatever its id; ids of the pieces by the library."""
    from tokenizers import Tokenizer

    r = random.Random(8)
    words = [f"word{i}" for i in range(400)]
    texts = [" ".join(r.choice(words) for _ in range(90)) for _ in range(9)]
    rows = [(7, texts[0]), (7, texts[1]), (8, texts[2]), (8, texts[2]), (None, texts[3]), (None, texts[4]), (9, texts[4].upper()), (10, texts[5] + " tail"), (11, texts[5]), (12, texts[6]), (12, None), (13, ""), (14, texts[7]), (15, texts[8])]
    df = spark.createDataFrame([(i, t, "en", "s", 0, 1.5) for i, t in rows], f"{DOCS}, component double")
    df.write.parquet(f"file://{tmp_path}/a/documents.parquet")
    df.limit(0).write.parquet(f"file://{tmp_path}/b/documents.parquet")
    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    want = []
    for i, t in [(7, texts[0]), (7, texts[1]), (8, texts[2]), (None, texts[3]), (9, texts[4].upper()), (10, texts[5] + " tail"), (12, texts[6]), (14, texts[7]), (15, texts[8])]:
        ids = [*library.encode(t, add_special_tokens=False).ids, 0]
        want.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    # one source: its target is its size, so every document is taken once
    got = corpus_pipeline.run(spark, f"file://{tmp_path}/a")
    assert sorted(((r.doc_id, r.length, r.ids_crc32) for r in got.collect()), key=str) == sorted(want, key=str)
    assert corpus_pipeline.run(spark, f"file://{tmp_path}/b").count() == 0
