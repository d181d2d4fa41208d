"""Operator 3: main text of web pages, with a suffix array over each host's token streams.

1. Pages are read into blocks by a forgiving tag reader: block-level tags end a block, inline ones
   and line breaks don't. A block is `main` (in an article or main element), `furniture` (in a menu,
   header, footer, sidebar, form, script, advert, notice or comment, by tag, role or class) or open.
   An article or main element is main even inside what only class or id words call furniture; a
   header in it is its heading; and in it a class or id counts only if it says nothing but furniture
   (`share-buttons`, not `related-work`). Frames, drawings, options and the like are left out, up to
   their end, the end of what they stand in or, where HTML lets them end so, the next block; without
   any of these only their tag is.
2. A page's other blocks than main ones are one token stream. The streams of one host are put end to
   end, and their suffixes sorted by prefix doubling to a depth of DEPTH tokens. A run of DEPTH tokens or more that
   starts alike in PAGES_SHARING pages of the host, distinct in id and in text, is a repeated one. (A token is in
   such a run just if it is in one of DEPTH tokens, so sorting deeper would cover no other tokens.) Hosts
   of more than PAGES pages are split by hash of the page: their runs of DEPTH tokens are counted
   host-wide by hash, and each part gets those of its runs that are repeated on the host, which gives the same.
3. Furniture goes. Of open blocks the tokens that repeated runs cover go: boilerplate that markup
   doesn't tell. Where a page has main blocks, its open blocks go as well, and main blocks
   stay even if they repeat: articles quote and copy each other, and the article is what is asked
   for. So on pages with an article element repeats alone never cost text.

Null or empty html: empty text. Null url: its own group of pages, like urls without a host. Rows
that repeat an id or a page are pages of their own, except that rows of one page id, and whole
copies of a page's text, count as one page in finding repeats. Very long pages are read whole. Empty table: empty result. Extra columns
aren't carried.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

DEPTH, PAGES_SHARING, PAGES = 8, 3, 2000
READ, COUNTED = 1000, 250  # pages whose runs are gathered, and counted, at once
#: Hosts of more than PAGES pages are broadcast up to this number, about 50 MB; more are joined by shuffling.
BROADCAST = 500_000
MAIN, OPEN, FURNITURE, WORDED = 0, 1, 2, 3  # WORDED: furniture by class or id words; only while reading
#: Fixed lists: names of HTML.
RAW = frozenset("script style textarea title".split())
LEFT_OUT = frozenset("noscript template iframe svg select datalist option annotation annotation-xml".split())
#: LEFT_OUT elements that a block ends, and the blocks that do.
OPEN_ENDED = frozenset("svg select datalist option".split())
BREAKS = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header li main nav ol p pre section table tbody td th tr ul".split()
)
STATE = re.compile(r"(?:no|not|non|without|with|has|hide)[-_]")  # such class names say what a page has, not what the element is
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br object "
    "math menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split()
)
FURNITURE_TAGS = frozenset("nav header footer aside form menu dialog button fieldset head audio video canvas".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
FURNITURE_WORDS = frozenset(
    "ad ads advert advertisement advertising adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header masthead menu modal nav navbar "
    "navigation newsletter notice overlay pagination pager popup promo promoted related respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
#: Words that say nothing of an element's text when they stand beside furniture words.
PLACES = frozenset("area bar block bottom box button buttons container content count group head inner item items left link links list module outer panel right row section side slot sticky text title top unit wrap wrapper".split())
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
SPLIT = re.compile(r"[^a-z0-9]+")
MULTIPLIER, NO_ID = np.uint64(0x9E3779B97F4A7C15), -(1 << 63)
PARSED = "page_id long, url string, host string, kinds array<int>, blocks array<string>"
RESULT = "page_id long, url string, text string, n_chars long, n_repeated long"
OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("n_repeated", pa.int64())])


def _place(tag: str, attributes: str, outer: int) -> int:
    """What an element's text is, given what its parent's is."""
    if outer == FURNITURE or tag in FURNITURE_TAGS and not (tag == "header" and outer == MAIN):
        return FURNITURE
    main, worded = tag in ("article", "main"), False
    if attributes.strip(" /\n\t\r"):
        for name, *values in ATTRIBUTE.findall(attributes):
            value, name = "".join(values).lower(), name.lower()
            if name == "hidden" or name == "role" and value in FURNITURE_ROLES:
                return FURNITURE
            if name in ("class", "id") and tag not in ("html", "body"):
                for parts in ({*SPLIT.split(x)} - {""} for x in value.split() if not STATE.match(x)):
                    worded |= not FURNITURE_WORDS.isdisjoint(parts) and (outer != MAIN or parts <= FURNITURE_WORDS | PLACES)
            main |= name == "role" and value == "main" or name == "itemprop" and value == "articlebody"
    return WORDED if worded else MAIN if main else outer


def _after(html: str, at: int, tag: str, around: list[tuple[str, int]]) -> int:
    """Where to read on after the start tag of a LEFT_OUT element that ends at `at`; -1: it has no end."""
    outer, inner = {x for x, _ in around}, [tag]
    while m := TAG.search(html, at):
        at = max(m.end(), m.start() + 1)
        name = (m[2] or "").lower()
        if m[1]:
            if name in inner:
                while inner.pop() != name:
                    pass
                if not inner:
                    return at
            elif name in outer:
                return m.start()
        elif name in RAW:
            close = _close(name).search(html, at)
            at = close.end() if close else len(html)
        elif name in BREAKS and tag in OPEN_ENDED and "foreignobject" not in inner:
            return m.start()
        elif name and name not in VOID and not m[3].rstrip().endswith("/"):
            inner.append(name)
    return -1


@lru_cache(maxsize=len(RAW))
def _close(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I)


def blocks(html: str | None) -> list[tuple[int, str]]:
    """(kind, text) of a page's blocks that have text, in order."""
    out: list[tuple[int, str]] = []
    if not html:
        return out
    stack: list[tuple[str, int]] = []
    kind = OPEN
    held: dict[int, list[str]] = {}
    endless: set[str] = set()  # LEFT_OUT names without an end in the rest of the page

    def flush() -> None:
        for k, parts in held.items():
            if text := " ".join("".join(parts).split()):
                out.append((FURNITURE if k == WORDED else k, text))
        held.clear()

    at = 0
    while at < len(html):
        m = TAG.search(html, at)
        end = m.start() if m else len(html)
        if end > at:
            held.setdefault(kind, []).append(unescape(html[at:end]))
        if not m:
            break
        at = max(m.end(), end + 1)
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag == "br":
            held.setdefault(kind, []).append("\n")
            continue
        if m[1]:
            if tag not in INLINE:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
                if tag in INLINE and stack[i][0] not in INLINE:
                    break  # a stray end tag of an inline element ends no block
            kind = stack[-1][1] if stack else OPEN
            continue
        if tag in RAW:
            close = _close(tag).search(html, at)
            at = close.end() if close else len(html)
            continue
        if tag in LEFT_OUT:
            if tag not in endless and not m[3].rstrip().endswith("/"):
                after = _after(html, at, tag, stack)
                if after < 0:
                    endless.add(tag)
                else:
                    at = after
            continue
        if tag not in INLINE:
            flush()
            while stack and (stack[-1][0] in INLINE or stack[-1][0] == "p" or stack[-1][0] == tag and tag in ("li", "dt", "dd", "tr", "td", "th") or tag == "body" and stack[-1][0] == "head"):
                stack.pop()
            kind = stack[-1][1] if stack else OPEN
        if tag not in VOID and not m[3].rstrip().endswith("/"):
            kind = _place(tag, m[3], kind)
            stack.append((tag, kind))
    flush()
    return out


def firsts(run: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(an index of each distinct (run, key), its number among those of its run)."""
    order = np.lexsort((key, run))
    r, k = run[order], key[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (k[1:] != k[:-1])
    at = order[new]
    return at, np.arange(len(at)) - np.searchsorted(run[at], run[at])


def shared(run: np.ndarray, sharing: int, *keys: np.ndarray) -> np.ndarray:
    """For each member of runs (numbered from 0), whether its run has as many distinct values of every key."""
    return np.logical_and.reduce([np.bincount(run[firsts(run, key)[0]]) >= sharing for key in keys])[run] if len(run) else run.astype(bool)


def repeated(streams: list[list[str]], pages: np.ndarray, depth: int = DEPTH, sharing: int = PAGES_SHARING, copies: np.ndarray | None = None) -> np.ndarray:
    """For each token of the streams, end to end, whether a repeated run covers it.

    pages: the page of each stream; copies: the text of its page, by number. Suffixes are ranked by their first 1, 2, 4 ... depth tokens;
    a suffix that ends before depth tokens of its stream is none.
    """
    lengths = np.asarray([len(x) for x in streams], np.int64)
    n = int(lengths.sum())
    covered = np.zeros(n, bool)
    if n < depth:
        return covered
    ids: dict[str, int] = {}
    rank = np.fromiter((ids.setdefault(w, len(ids)) for x in streams for w in x), np.int64, n)
    owner = np.repeat(np.arange(len(streams)), lengths)
    rest = np.cumsum(lengths)[owner] - np.arange(n)  # tokens from here to the stream's end
    size = 1
    while size < depth:
        step = min(size, depth - size)
        after = np.full(n, -1, np.int64)
        after[: n - step] = rank[step:]
        after[rest <= step] = -1
        _, rank = np.unique(rank * (n + 1) + after + 1, return_inverse=True)
        size += step
    whole = np.flatnonzero(rest >= depth)
    run = np.unique(rank[whole], return_inverse=True)[1]  # the suffix array, to this depth
    hot = whole[shared(run, sharing, pages[owner[whole]], (pages if copies is None else copies)[owner[whole]])]
    return covered_from(hot, n, depth)


def covered_from(starts: np.ndarray, n: int, depth: int = DEPTH) -> np.ndarray:
    """For each of n tokens, whether a run of depth tokens from one of the starts covers it."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + depth, -1)
    return np.cumsum(change)[:-1] > 0


def windows(streams: list[list[str]], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(where the runs of depth tokens start in the streams, end to end; their 64-bit hashes)."""
    lengths = np.asarray([len(x) for x in streams], np.int64)
    n = int(lengths.sum())
    if n < depth:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ids: dict[str, int] = {}
    word = np.fromiter((ids.setdefault(w, len(ids)) for x in streams for w in x), np.int64, n)
    hashed = pd.util.hash_array(np.array(list(ids), object), categorize=False)[word]
    rest = np.cumsum(lengths)[np.repeat(np.arange(len(streams)), lengths)] - np.arange(n)
    total = np.zeros(n - depth + 1, np.uint64)
    for j in range(depth):
        total = total * MULTIPLIER + hashed[j : n - depth + 1 + j]
    at = np.flatnonzero(rest[: n - depth + 1] >= depth)
    return at, total[at].view(np.int64)


def numbered(*keys: np.ndarray) -> np.ndarray:
    """The run of each row, by number: rows with the same keys."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), np.int64)
    for key in keys:
        new[1:] |= key[order][1:] != key[order][:-1]
    run = np.empty(len(order), np.int64)
    run[order] = np.cumsum(new)
    return run


def evidence(group: pa.Table) -> pa.Table:
    """Of runs (hash, h, salt, id, copy), those on PAGES_SHARING distinct pages of their host, once a salt."""
    hashes, h, salt, page, copy = (np.asarray(group.column(x)) for x in ("hash", "h", "salt", "id", "copy"))
    hot = shared(numbered(hashes, h), PAGES_SHARING, page, copy)
    found = pa.table({"h": h[hot], "salt": salt[hot], "hash": hashes[hot]})
    return found.group_by(["h", "salt", "hash"]).aggregate([]).select(["h", "salt", "hash"])


def stream(kinds: list[int], texts: list[str]) -> list[str]:
    """The tokens of a page's blocks other than main ones."""
    return " ".join([t for k, t in zip(kinds, texts, strict=True) if k != MAIN]).split()


def runs(split: DataFrame) -> DataFrame:
    """(hash, h, salt, id, copy): runs of parsed pages (h, salt); of many pages of one salt read together, PAGES_SHARING ids and texts stand for all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, READ):
                b = batch.slice(begin, READ)
                found = b.column("blocks").to_pylist()
                streams, texts = [stream(k, x) for k, x in zip(b.column("kinds").to_pylist(), found, strict=True)], [" ".join(x) for x in found]
                at, hashes = windows(streams)
                row = np.repeat(np.arange(len(texts)), [len(x) for x in streams])[at]
                h, salt, page = (np.asarray(c)[row] for c in (b.column("h"), b.column("salt"), b.column("id")))
                copy = pd.util.hash_array(np.array(texts, object), categorize=False).view(np.int64)[row]
                same = numbered(hashes, salt, h)
                few = np.unique(np.concatenate([i[nth < PAGES_SHARING] for i, nth in (firsts(same, page), firsts(same, copy))]))
                yield pa.RecordBatch.from_arrays([pa.array(x[few]) for x in (hashes, h, salt, page, copy)], names=["hash", "h", "salt", "id", "copy"])

    return split.mapInArrow(run, "hash long, h long, salt int, id long, copy long")


def parsed(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                b = batch.slice(at, 500)
                found = [blocks(x) for x in b.column("html").to_pylist()]
                hosts = [re.split(r"[/?#]", x.partition("://")[2], maxsplit=1)[0].lower() if x else "" for x in b.column("url").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("page_id"), b.column("url"), pa.array(hosts, pa.string()),
                        pa.array([[k for k, _ in x] for x in found], pa.list_(pa.int32())), pa.array([[t for _, t in x] for x in found], pa.list_(pa.string())),
                    ],
                    names=["page_id", "url", "host", "kinds", "blocks"],
                )

    return rows.mapInArrow(run, PARSED)


def decide(group: pa.Table, hot: pa.Table) -> pa.Table:
    """The pages' text, of a group of pages of one host; hot: the repeated runs (hash) of a group of a split host."""
    if not group.num_rows:
        return pa.table({x.name: pa.array([], x.type) for x in OUT}, schema=OUT)
    ids = group.column("page_id").to_pylist()
    kinds, texts = group.column("kinds").to_pylist(), group.column("blocks").to_pylist()
    names: dict[int | None, int] = {}
    number = [names.setdefault(x, len(names)) for x in ids]
    streams = [stream(k, x) for k, x in zip(kinds, texts, strict=True)]
    if group.column("split")[0].as_py():
        at, hashes = windows(streams)
        hit = covered_from(at[np.isin(hashes, np.asarray(hot.column("hash")))], sum(len(x) for x in streams))
    else:
        seen: dict[str, int] = {}
        copies = [seen.setdefault(" ".join(x), len(seen)) for x in texts]
        hit = repeated(streams, np.asarray(number, np.int64), copies=np.asarray(copies, np.int64))
    out, tokens, at = [], [], 0
    for ks, ts in zip(kinds, texts, strict=True):
        has_main, kept, total = MAIN in ks, [], 0
        for k, t in zip(ks, ts, strict=True):
            if k == MAIN:
                kept.append(t)
                continue
            size = t.count(" ") + 1  # blocks have single spaces
            cut = hit[at : at + size]
            n = int(cut.sum())
            total += n
            if k == OPEN and not has_main and n < size:
                kept.append(" ".join(x for x, c in zip(t.split(" "), cut.tolist(), strict=True) if not c) if n else t)
            at += size
        out.append("\n\n".join(kept))
        tokens.append(total)
    return pa.table({"page_id": group.column("page_id"), "url": group.column("url"), "text": pa.array(out, pa.string()), "n_chars": pa.array([len(x) for x in out], pa.int64()), "n_repeated": pa.array(tokens, pa.int64())})


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars, n_repeated): n_repeated counts the page's tokens in repeated runs, outside main blocks."""
    host = F.coalesce(F.lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))
    large = pages.select(host.alias("_h")).groupBy("_h").agg(F.count("*").alias("_n")).where(F.col("_n") > PAGES)
    large = written(large, "hosts")
    many, rows = large.agg(F.count("*"), F.coalesce(F.sum("_n"), F.lit(0))).first()
    small = many <= BROADCAST  # so the pages are dealt once, by host and salt
    read = parsed(pages, page_id, url, html)
    salt = F.pmod(F.xxhash64("page_id", "url", "blocks"), F.ceil(F.coalesce("_n", F.lit(1)) / PAGES)).cast("int")
    among = lambda how: read.join(F.broadcast(large) if small else large, read["host"] == large["_h"], how)
    dealt = among("left").select("page_id", "url", "kinds", "blocks", "host", salt.alias("salt"), F.col("_n").isNotNull().alias("split"))
    key = F.xxhash64("_h")
    if rows:
        found = runs(among("inner").select("kinds", "blocks", key.alias("h"), salt.alias("salt"), F.coalesce("page_id", F.lit(NO_ID)).alias("id")))
        bucket = F.pmod(F.xxhash64("hash"), F.lit(-(-rows // COUNTED))).alias("bucket")
        hot = found.select("*", bucket).groupBy("bucket").applyInArrow(evidence, "h long, salt int, hash long")
        names = large.select(F.col("_h").alias("host"), key.alias("h"))
        hot = hot.join(F.broadcast(names) if small else names, "h").select("host", "salt", "hash")
    else:
        hot = pages.sparkSession.createDataFrame([], "host string, salt int, hash long")
    return dealt.groupBy("host", "salt").cogroup(hot.groupBy("host", "salt")).applyInArrow(decide, RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
