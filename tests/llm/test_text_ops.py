"""Operators on texts: small fixtures with nulls, empty and long texts, ties, repeated rows, clashing columns, empty tables."""

import itertools
import math
import random
import time
import zlib
from collections import Counter as Tally
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trailmark.llm import html_text, language_model, near_duplicates, quality_rules, range_coder, shingles, token_counts, token_files, url_filters
from trailmark.llm import word_ids as word_ids_module
from trailmark.llm.elias_fano import Sequence, pack
from trailmark.llm.word_ids import WordIds, vocabulary, word_ids

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(60)]


def text(seed, n=120):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def docs(spark):
    base = text(1)
    near = base.split()
    near[60] = "changed"
    rows = [
        (1, base), (2, base.upper()), (3, " ".join(near)), (4, text(2)), (5, ""), (6, None), (7, " \t\n "), (8, "one two"), (9, "One\ttwo"), (10, "a b c d " * 3000),
        (11, "x" * 50_000), (12, text(3)), (12, text(3)), (13, "line\nline\nline\n\nother"), (14, "naïve ÀÉ <|endoftext|> ▁▁ \U0001f600  two  spaces"),
    ]
    return spark.createDataFrame([(i, t, "en", "s" if i % 3 else None, len(t or "")) for i, t in rows], DOCS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_quality_rules_by_brute_force(spark):
    got = {r.doc_id: r for r in quality_rules.ledger(docs(spark).withColumn("fail_bits", F.lit("mine")).withColumn("n_words", F.lit(-1))).collect()}
    for r in docs(spark).collect():
        t = r.text or ""
        ws = [w for w in t.replace("\t", " ").replace("\n", " ").split(" ") if w]
        seen = Tally(zip(ws, ws[1:], ws[2:], strict=False))
        hit = {i + k for i, g in enumerate(zip(ws, ws[1:], ws[2:], strict=False)) if seen[g] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if x.strip(" \t\x0b\x0c\r")]
        row = got[r.doc_id]
        assert (row.n_words, row.word_chars, row.n_dup_lines, row.n_repeat_words) == (len(ws), sum(map(len, ws)), len(lines) - len(set(lines)), len(hit))
        assert bool(row.fail_bits & 1) == (len(ws) < 50)
    assert quality_rules.ledger(empty(spark)).count() == 0


def test_policies_and_ablations(spark):
    ledger = quality_rules.ledger(docs(spark), keep=["doc_id"])
    rows = ledger.collect()
    for a in quality_rules.ablations(ledger).collect():
        rule = next(x for x in quality_rules.RULES if x.name == a.rule)
        mask = quality_rules.POLICIES[a.policy]
        assert a.n_kept == sum(not r.fail_bits & mask for r in rows)
        assert a.n_failed == sum(bool(r.fail_bits & 1 << rule.bit) for r in rows)
        assert a.n_kept_without == sum(not r.fail_bits & mask & ~(1 << rule.bit) for r in rows)
    assert quality_rules.accepted(docs(spark)).columns == docs(spark).columns


def test_quality_rules_run_no_python(spark):
    plan = quality_rules.query.__globals__["ledger"](docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_token_counts_are_the_librarys(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    got = token_counts.counted(docs(spark).withColumn("n_tokens", F.lit("mine")), keep=["doc_id", "text", "n_tokens"]).collect()
    by = {r.doc_id: r.n_tokens for r in got}
    for r in docs(spark).collect():
        assert by[r.doc_id] == len(library.encode(r.text or ""))
    r = random.Random(3)
    parts = ["a", "th", "the ", " ", "  ", "\n", "é", "▁", "ing", ".", "漢", "<s>", "\t"]
    count = token_counts.counter(vocabulary("piece_bpe_32k.model")).count
    for _ in range(500):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 25)))
        assert count(t) == len(library.encode(t)), t


def test_word_ids_are_the_librarys():
    words = word_ids(vocabulary("word_bpe_49k.json"))
    r = random.Random(4)
    parts = ["It's", " don't", "İ", "ﬁ", "ß", "é", "é", "\x1c", "<|endoftext|>", "<|", " ", "\n", "½", "12", "Σ", "日本", "!!", "'s", "­", "a_b", "\xa0", "x."]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(500)] + [None, ""]
    assert words.ids(texts) == [words._whole(t or "") for t in texts]


def test_word_ids_of_a_column_are_made_once_for_each_distinct_piece(monkeypatch):
    words = WordIds(vocabulary("word_bpe_49k.json"))
    r = random.Random(6)
    parts = ["Ab", "é", "Ǆx", "ŉ", "ª", "st", "...", "?", "#&", "'s", "\x00", "\x85", "　", " ", "  ", "<|", "7", "×", "漢"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(300)] + [None, "", " "]
    column = pa.array([None, "before", *texts, "after"], pa.string()).slice(2, len(texts))
    monkeypatch.setattr(word_ids_module, "CHUNK", 500)
    assert words.ids(column) == words.ids(texts) == [words._whole(t or "") for t in texts]
    assert [at for at, _ in words.chunks(column)][1:] and words.ids(pa.array([], pa.string())) == []
    # words that differ in case or in the punctuation behind them share their letters' ids
    words.words.clear()
    words.parts.clear()
    words.ids([f"{w}{e} {w.upper()}{e}" for w in ("alpha", "beta", "gamma") for e in ("", ".", "!!", "###")])
    assert len(words.parts) == 6 and not words.words


def test_range_coder_round_trips_and_finds_damage():
    r = np.random.default_rng(5)
    for n, top in ((0, 5), (1, 5), (127, 2), (129, 49408), (5000, 300)):
        ids = r.integers(0, top, n)
        block = range_coder.encode(ids, 49408)
        assert (range_coder.decode(block) == ids).all()
    with pytest.raises(range_coder.CorruptBlock):
        range_coder.decode(block[:-3] + bytes([block[-3] ^ 1]) + block[-2:])
    assert len(range_coder.encode(np.arange(20_000) % 7, 49408)) < 3000


def test_token_files_by_brute_force(spark, tmp_path):
    table = docs(spark).unionByName(spark.createDataFrame([(None, "no id", "en", None, 5)], DOCS))
    token_files.write(table, f"file://{tmp_path}/ids", size=300)
    got = token_files.read(spark, f"file://{tmp_path}/ids").collect()
    words = word_ids(vocabulary("word_bpe_49k.json"))
    rows = sorted(((r.doc_id, words.ids([r.text])[0] + b"\1\0\0\0") for r in table.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    at, want = 0, []
    for d, raw in rows:
        want.append((d, at, len(raw) // 4, zlib.crc32(raw)))
        at += len(raw) // 4
    assert sorted(map(tuple, got), key=lambda x: x[1]) == want
    token_files.write(empty(spark), f"file://{tmp_path}/none")
    assert token_files.read(spark, f"file://{tmp_path}/none").count() == 0


def groups(rows, k, percent):
    sets = []
    for i, t in rows:
        ws = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
        sets.append((i, set(zip(*[ws[j:] for j in range(k)], strict=False)) if len(ws) >= k else {tuple(ws)} if ws else set()))
    up = {i: i for i, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            a, b = sorted((root(a), root(b)))
            up[b] = a
    return {(i, len(s), root(i)) for i, s in sets}


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_near_duplicates_by_brute_force(spark, k, percent):
    r = random.Random(6)
    rows = [(x.doc_id, x.text) for x in docs(spark).collect()]
    hub = text(9, 150).split()
    for i in range(100, 160):  # a group of copies, of which some differ too much
        copy = list(hub)
        for _ in range(r.randint(0, 8)):
            copy[r.randrange(len(copy))] = f"new{r.random()}"
        rows.append((i, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(x.doc_id, x.n_shingles, x.component_id) for x in near_duplicates.join(df, k, percent).collect()}
    assert got == groups(rows, k, percent)


def test_near_duplicates_of_nothing_and_of_odd_rows(spark):
    assert near_duplicates.join(empty(spark)).count() == 0
    odd = spark.createDataFrame([(None, text(1)), (3, None), (4, text(1))], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in near_duplicates.join(odd).collect()} == {(None, None), (3, 3), (4, 4)}


def test_html_keeps_the_article_only():
    page = """<html><head><title>T</title></head><body><nav><ul><li>Menu</ul></nav><div class="ad">Buy</div>
    <article><h1>Head &amp; line</h1><p><b>One<br>two <i>three</i><p>Four&nbsp;five<div class="comments">Nice!</div><form>Mail</form></article>
    <aside>Side</aside><script>var x = "</p>";</script><footer>Foot</footer>"""
    assert [t for k, t in html_text.blocks(page) if k == html_text.MAIN] == ["Head & line", "One two three", "Four five"]
    assert html_text.blocks(None) == [] and html_text.blocks("<p") == [] and html_text.blocks("a < b") == [(html_text.OPEN, "a < b")]


def test_html_repeats_are_boilerplate_without_markup(spark):
    same = "this line stands on every page of the host and says nothing at all"
    rows = [(i, f"http://h.example/{i}", f"<div>{same}</div><div>{text(i, 40)}</div>") for i in range(6)]
    rows += [(7, None, None), (8, "http://h.example/8", ""), (9, "x", "<p>alone</p>")]
    got = {r.page_id: r for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i].text == text(i, 40) and got[i].n_chars == len(text(i, 40)) for i in range(6))
    assert got[7].text == "" and got[8].text == "" and got[9].text == "alone"


def test_repeated_runs_by_brute_force():
    r = random.Random(8)
    streams = [[r.choice("ab") for _ in range(r.randint(0, 30))] for _ in range(12)]
    pages = np.arange(12) // 2
    got = html_text.repeated(streams, pages, depth=4, sharing=3)
    where = {}
    for s, p in zip(streams, pages, strict=True):
        for i in range(len(s) - 3):
            where.setdefault(tuple(s[i : i + 4]), set()).add(p)
    want = []
    for s in streams:
        hit = [False] * len(s)
        for i in range(len(s) - 3):
            if len(where[tuple(s[i : i + 4])]) >= 3:
                hit[i : i + 4] = [True] * 4
        want += hit
    assert got.tolist() == want


def test_url_rules(spark):
    urls = ["http://a.example.com/en/7?x", "https://EXAMPLE.com/en/8", "http://b.net/de/", "http://x.example.net/de/81", "http://org/es/", "http://forge.org/es", "nothing", None, "http://notcom/en/", "http://a.com:80/en/1"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {r.page_id: (r.host, r.rule, r.verdict) for r in url_filters.judge(df.withColumn("host", F.lit("mine"))).collect()}
    assert [got[i][1] for i in range(len(urls))] == ["example.com/en/7", "com/en/", "net/de/", "example.net/de/8", "org/es/", None, None, None, None, None]
    assert got[1] == ("example.com", "com/en/", "block") and got[6] == ("", None, "allow")
    root = url_filters.build([("a.b", "", "allow"), ("a.b", "", "block"), ("b", "/x/y", "allow")])
    assert url_filters.longest(root, "a.b", "/q")[1] == "block" and url_filters.longest(root, "z.b", "/x/yz")[1] == "allow" and url_filters.longest(root, "b", "/x") is None


def test_elias_fano():
    r = np.random.default_rng(9)
    for n, top in ((0, 9), (1, 0), (100, 99), (3000, 2**60), (500, 20)):
        v = np.sort(r.integers(0, top + 1, n).astype(np.uint64))
        s = Sequence(pack(v, top))
        assert (s.get(np.arange(n)) == v).all()
        q = np.append(v, r.integers(0, top + 1, 200).astype(np.uint64))
        at = s.find(q)
        assert ((at >= 0) == np.isin(q, v)).all() and (v[at[at >= 0]] == q[at >= 0]).all()


def test_language_model_by_brute_force(spark):
    rows = [(i, " ".join(random.Random(i).choice("abcd") for _ in range(30))) for i in range(40)] + [(50, None), (51, ""), (52, "A zzz b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    learnt = [(i, t) for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    seqs = {i: [*(t or "").lower().split(), None] for i, t in rows}
    one, two, three = Tally(), Tally(), Tally()
    for i, _ in learnt:
        s = [None, *seqs[i]]
        one.update(s[1:])
        two.update(zip(s, s[1:], strict=False))
        three.update(zip(s, s[1:], s[2:], strict=False))
    total, types = sum(one.values()), len(one)
    p1 = lambda w: (one[w] + 0.5) / (total + 0.5 * (types + 1))

    def mixed(counts, context, size, w, lower):
        kept = {k[-1]: c for k, c in counts.items() if k[:-1] == context}
        left = 1 - sum(c - 0.75 for c in kept.values()) / size
        return (kept[w] - 0.75) / size + left * lower if w in kept else left * lower

    def score(i):
        s, out = [None, *seqs[i]], 0.0
        for j in range(1, len(s)):
            p = p1(s[j])
            if one[s[j - 1]] or s[j - 1] is None:
                p = mixed(two, (s[j - 1],), one[s[j - 1]], s[j], p)
            if j > 1 and two[s[j - 2], s[j - 1]]:
                p = mixed(three, (s[j - 2], s[j - 1]), two[s[j - 2], s[j - 1]], s[j], p)
            out += math.log10(p)
        return out

    scores, n, v = language_model.score(df, ~language_model.held_out())
    assert (n, v) == (total, types)
    for r in scores.collect():
        assert r.n_tokens == len(seqs[r.doc_id]) and r.n_known == sum(one[w] > 0 for w in seqs[r.doc_id])
        assert r.base_score == pytest.approx(sum(math.log10(p1(w)) for w in seqs[r.doc_id]))
        assert r.score == pytest.approx(score(r.doc_id), abs=0.002 * r.n_tokens)


def test_language_model_of_nothing(spark):
    scores, n, v = language_model.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), F.lit(False))
    got = scores.first()
    assert (n, v) == (0, 0) and got.n_tokens == 3 and got.n_known == 0 and got.base_score == 0


def test_shingles_by_brute_force():
    texts = ["a b c d e", "", "a", "A b\tC", "a b c a b c a b c", "\n"]
    h, n = shingles.of_block([t.encode() for t in texts], 3)
    want = [len(set(zip(w, w[1:], w[2:], strict=False))) if len(w) >= 3 else min(1, len(w)) for w in ([x for x in t.lower().split()] for t in texts)]
    assert n.tolist() == want and len(h) == sum(want)


def test_near_duplicates_of_an_id_with_several_texts(spark):
    a, b, c = text(21), text(22), text(23, 60)
    rows = [(1, a), (5, b), (5, a), (7, b), (9, c), (5, c), (11, text(24))]
    got = {r.doc_id: r.component_id for r in near_duplicates.join(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.doc_id != 5}
    assert got[1] == 1 and got[11] == 11 and got[7] == got[9]


def test_html_repeats_are_counted_over_a_split_host(spark, monkeypatch):
    same = "this notice stands on few pages of a large host and says nothing at all"
    rows = [(i, f"http://h.example/{i}", (f"<div>{same}</div>" if i % 20 == 0 else "") + f"<div>{text(i, 40)}</div>") for i in range(80)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    whole = sorted(html_text.extract(pages).collect())
    monkeypatch.setattr(html_text, "PAGES", 4)
    assert sorted(html_text.extract(pages).collect()) == whole
    assert all(r.text == text(r.page_id, 40) for r in whole)


@pytest.mark.parametrize("size", [2000, 2])
def test_html_cuts_repeated_spans_only(spark, monkeypatch, size):
    monkeypatch.setattr(html_text, "PAGES", size)
    menu = "<ul><li>home<li>news and more<li>contact us<li>about this site<li>legal</ul>"
    quote = "a passage that three pages share and that is as long as what else stands here so far"
    rows = [(i, f"http://h.example/{i}", f"{menu}<p>{text(i, 12)} {quote}</p>") for i in range(4)]
    rows += [(10 + i, f"http://c.example/{i}", f"<p>{text(99, 30)}</p><p>{text(98, 30)}</p>") for i in range(5)]
    got = {r.page_id: r for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i].text for i in range(4)] == [text(i, 12) for i in range(4)]
    assert all(got[10 + i].text == text(99, 30) + "\n\n" + text(98, 30) and got[10 + i].n_repeated == 0 for i in range(5))


@pytest.mark.parametrize(
    "page",
    [
        '<body style="overflow-x:hidden"><p>Kept</p></body>', '<p aria-hidden="false">Kept</p>', '<p title="no hidden cost">Kept</p>', '<p><a href="/hidden-gems?id=nav">Kept</a></p>',
        '<div class="site no-sidebar"><p>Kept</p></div>', "<svg/><p>Kept</p>", "<svg><g><text>a</text></g><p>Kept</p>", "<datalist><option value=x><p>Kept</p>", "<div><iframe src=x></div><p>Kept</p>", "<object>Kept",
        "<p>Ke<noscript><div>a</div></noscript>pt</p>", "<p>Ke<select><option>a<option>b</select>pt</p>", "<p>Kept</p><script>a </p> b", "<p>Kept</p><svg><foreignObject><p>a</p></foreignObject></svg>",
    ],
)
def test_html_loses_no_text_by_loose_patterns(page):
    assert html_text.blocks(page) == [(html_text.OPEN, "Kept")]


def test_html_class_words_do_not_override_an_enclosed_article():
    got = html_text.blocks('<div class="site sidebar-left"><div>a</div><article>b<div class="comments">c</div></article></div><p hidden>d</p><article class="comment">e</article>')
    assert got == [(html_text.FURNITURE, "a"), (html_text.MAIN, "b"), (html_text.FURNITURE, "c"), (html_text.FURNITURE, "d"), (html_text.FURNITURE, "e")]


def test_language_model_query_keeps_single_ngrams(spark, tmp_path):
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i in range(20)]
    copy, learnt = held.index(True), [i for i, x in enumerate(held) if not x]
    rows = [(i, text(7 if k == 0 else 100 + i)) for k, i in enumerate(learnt[:3])] + [(copy, text(7))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in language_model.query(spark, f"file://{tmp_path}").collect()}
    assert got[copy].held_out and got[copy].score > got[copy].base_score + 0.3 * got[copy].n_tokens


def thue_morse(a, b):
    return "".join((a, b)[bin(i).count("1") % 2] for i in range(1024))


def test_language_model_tells_regular_words_apart(spark):
    docs = spark.createDataFrame([(1, thue_morse("a", "b")), (2, thue_morse("b", "a"))], "doc_id long, text string")
    scores, n, v = language_model.score(docs, F.col("doc_id") == 1)
    assert all(math.isfinite(r.score) for r in scores.collect())
    assert (n, v) == (2, 2) and {r.doc_id: r.n_known for r in scores.collect()} == {1: 2, 2: 1}


def test_language_model_of_unknown_words_after_a_known_one(spark):
    df = spark.createDataFrame([(1, "x y"), (2, "x zz")], "doc_id long, text string").repartition(2)
    got = {r.doc_id: r for r in language_model.score(df, F.col("doc_id") == 1)[0].collect()}
    p1 = lambda c: (c + 0.5) / (3 + 0.5 * 4)
    first = 0.25 + 0.75 * p1(1)  # x after the end; then zz after x, and the end after zz
    assert got[2].score == pytest.approx(math.log10(first * 0.75 * (0.75 * p1(0)) * p1(1)), abs=0.002)


def test_words_that_share_their_first_hash_bits():
    rest, more = np.array([5, 5, 5, 9], np.uint64), np.array([1, 4, 7, 1], np.uint16)
    level = language_model.Words(language_model.Words.build(rest, more, np.array([3, 1, 2, 4]), 3))
    assert level.find(np.array([5, 5, 5, 5, 9, 8], np.uint64), np.array([7, 1, 4, 2, 1, 1], np.uint16)).tolist() == [2, 0, 1, -1, 3, -1]


def test_bundles_round_trip():
    arrays = [np.array([], np.int64), np.arange(300), np.array([2**62, 0, 7])]
    assert all((a == b).all() for a, b in zip(arrays, language_model.unbundle(language_model.bundle(*arrays)), strict=True))


def test_language_model_query_of_odd_rows(spark, tmp_path, monkeypatch):
    """Null, empty, blank and very long texts, null and repeated ids, a clashing column; several windows and segments give the same."""
    rows = [(None, "a b c"), (1, None), (1, None), (2, ""), (3, " \t"), (4, "a b " * 20_000), (5, "the end of the end"), (6, "the end of the end"), (7, "A B C")]
    df = spark.createDataFrame([(i, t, 3.0) for i, t in rows], "doc_id long, text string, score double").repartition(2)
    df.write.parquet(f"file://{tmp_path}/documents.parquet")
    key = lambda r: (r.doc_id is None, r.doc_id, r.n_tokens, r.n_known, round(r.score, 9), round(r.base_score, 6))
    one = sorted(map(key, language_model.query(spark, f"file://{tmp_path}").collect()), key=str)
    assert len(one) == len(rows) and [x[2] for x in one if x[1] == 4] == [40_001]
    monkeypatch.setattr(language_model, "GRAMS", 1000)
    monkeypatch.setattr(language_model, "SAMPLED", 2)
    assert sorted(map(key, language_model.query(spark, f"file://{tmp_path}").collect()), key=str) == one
    none = language_model.score(df.limit(0), F.lit(True))
    assert none[0].count() == 0 and none[1:] == (0, 0)


def test_shingles_of_regular_words_differ(spark):
    a, b = thue_morse("a", "b"), thue_morse("b", "a")
    rows = [(1, a), (2, b), (3, f"p q r {a} p q r {b}")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1, 1), 2: (1, 2), 3: (5, 3)}


def jaccard(x, y, k):
    one, two = (shingles.distinct((t or "").encode(), k) for t in (x, y))
    return len(one & two) / len(one | two) if one and two else 0.0


def test_kept_loses_no_text_without_a_duplicate(spark):
    """Repeated ids with different texts, ids that are null, texts that are null or empty, a clashing column: brute force over rows."""
    near = text(31).split()
    near[60] = "changed"
    rows = [
        (7, text(31)), (7, text(32)), (8, text(33)), (8, text(33)), (None, " ".join(near)), (None, text(34)), (9, text(34).upper()), (10, None), (11, ""), (None, None),
        (12, thue_morse("a", "b")), (13, thue_morse("b", "a")), (14, text(35, 400)), (15, text(35, 400) + " tail"),
    ]
    df = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, row int").withColumnRenamed("row", "component").repartition(3)
    got = [(r.doc_id, r.text) for r in near_duplicates.kept(df).collect()]
    groups = []
    for i, t in rows:
        joined = [g for g in groups if any(jaccard(t, u, 5) >= 0.8 for _, u in g)]
        groups = [g for g in groups if g not in joined] + [[x for g in joined for x in g] + [(i, t)]]
    want = [min(g, key=lambda x: (x[0] is None, x[0] or 0)) for g in groups]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert near_duplicates.kept(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<article><header><h1>Title</h1></header><section id="related-work"><p>Body</p></section><p>E = <math><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup></math></p></article>', ["Title", "Body", "E = mc2"]),
        ('<header>Site</header><main><p>a</p><div class="share-buttons">x</div><div class="comment-policy">b</div><footer>y</footer><div id="comments"><p>z</p></div></main>', ["a", "b"]),
        ("<article><p>a <object>b</object> c</p></article>", ["a b c"]),
    ],
)
def test_html_keeps_headings_sections_and_formulas(page, want):
    assert [t for k, t in html_text.blocks(page) if k == html_text.MAIN] == want


def test_html_pages_by_a_second_reading(spark):
    """Whole pages against the standard library's parser; nulls, empty and very long pages, repeated rows, clashing columns, an empty table."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.depth, self.parts = 0, [[]]

        def handle_starttag(self, tag, attrs):
            self.depth += tag == "article"
            self.parts += [[]] if tag in ("p", "h1", "article") else []
            self.parts[-1] += ["\n"] if tag == "br" else []

        def handle_endtag(self, tag):
            self.depth -= tag == "article"
            self.parts += [[]] if tag in ("p", "h1", "article") else []

        def handle_data(self, data):
            if self.depth:
                self.parts[-1].append(data)

    def read(html):
        r = Reader()
        r.feed(html or "")
        r.close()
        return "\n\n".join(x for x in (" ".join("".join(p).split()) for p in r.parts) if x)

    def page(i, n):
        return f"<nav><li>home {i}<li>more</nav><div class=ad>{text(i, 9)}</div><article><h1>{text(i, 5)} &amp; &eacute;</h1><p><b>{text(i + 1, n)}<br>x</b><p>{text(i, 30)}</p></article><footer>&copy; f</footer>"

    rows = [(i, f"http://{'ab'[i % 2]}.example/{i}", page(i, 20)) for i in range(30)] + [(30, "http://a.example", page(30, 60_000)), (31, None, None), (None, "http://a.example", ""), (5, "http://b.example/5", page(5, 20)), (None, "u", page(6, 8))]
    df = spark.createDataFrame([(i, u, h, 1, "k") for i, u, h in rows], "page_id long, url string, html string, split int, host string").repartition(3)
    got = sorted((str(r.page_id), str(r.url), r.text, r.n_chars) for r in html_text.extract(df).collect())
    assert got == sorted((str(i), str(u), read(h), len(read(h))) for i, u, h in rows)
    assert html_text.extract(df.limit(0)).count() == 0


def test_verification_holds_a_bounded_number_of_characters():
    made = []
    get = near_duplicates.remembered(lambda x: made.append(x) or len(x), 10)
    assert [get(x) for x in ("aaaa", "bbbb", "aaaa", "c" * 50, "aaaa", "")] == [4, 4, 4, 50, 4, 0]
    assert made == ["aaaa", "bbbb", "c" * 50, "aaaa", ""]


@pytest.mark.parametrize("most", [0, 2_000_000])
def test_near_duplicates_leave_little_on_disk(spark, monkeypatch, most):
    """Tables that nothing reads again, and shuffle files, go during the stage; by either join, broadcast or not, the same rows stay."""
    monkeypatch.setattr(near_duplicates, "BROADCAST", most)
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    tables = lambda: set(shared.glob("trailmark-*/*"))
    blocks = lambda: {x for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ").split() if x.startswith("shuffle")}
    near = text(41).split()
    near[60] = "changed"
    df = spark.createDataFrame([(1, text(41)), (2, text(41)), (3, " ".join(near)), (4, text(42)), (5, None), (None, text(42))], "doc_id long, text string").repartition(3)
    had, held = tables(), blocks()
    kept = near_duplicates.kept(df)
    assert {p.name for p in tables() - had} & {"features", "classes", "postings", "hubs", "nodes", "texts", "tagged", "pairs", "found"} == set()
    for _ in range(100):  # they go in the background
        if not (left := blocks() - held):
            break
        time.sleep(0.1)
    assert not left
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 5]
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_word_ids_by_smaller_chunks_are_the_same():
    words = word_ids(vocabulary("word_bpe_49k.json"))
    texts = pa.array([text(51), None, "", "x" * 5000, text(52), "na\u00efve  two", text(53, 9)])
    found = list(words.chunks(texts, 700))
    assert [at for at, _ in found] == [0, 3, 4]
    assert [x for _, part in found for x in part] == words.ids(texts)
