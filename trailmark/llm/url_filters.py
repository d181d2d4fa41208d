"""Operator 9: allow and block rules on URLs, by a broadcast trie of reversed host labels and path segments.

A rule is (host, path, verdict). It fits its host and all subdomains if the URL's path starts with
the rule's path, as a string. Of the fitting rules the longest (host and path characters together)
wins; of equally long ones, which can only be the same rule given twice, block wins. Without a
fitting rule the verdict is `default`.

The rules are broadcast, so their number is bounded: more than MAX_RULES are refused. Null urls and
urls without :// have an empty host and path, fit no rule and get the default. Rows are judged one
by one: repeated rows, empty tables, very long urls need nothing special. Extra columns are carried
if named in `keep`; the columns made here are host, path, rule, verdict, and replace such ones.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

#: About 200 bytes a rule in the trie: 200 MB in each Python worker at most.
MAX_RULES = 1_000_000
#: The rules of the contract.
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass
class Paths:
    """Trie over path segments; `ends` are the last, perhaps partial, segments of rules that end here."""

    below: dict[str, "Paths"] = field(default_factory=dict)
    ends: dict[str, tuple[str, str]] = field(default_factory=dict)
    lengths: tuple[int, ...] = ()


@dataclass
class Hosts:
    """Trie over host labels, last label first."""

    below: dict[str, "Hosts"] = field(default_factory=dict)
    paths: Paths | None = None


def build(rules: Iterable[tuple[str, str, str]]) -> Hosts:
    root = Hosts()
    for n, (host, path, verdict) in enumerate(rules):
        if n >= MAX_RULES:
            raise ValueError(f"more than {MAX_RULES} rules can't be broadcast")
        node = root
        for label in reversed(host.translate(str.maketrans(UPPER, LOWER)).split(".")):
            node = node.below.setdefault(label, Hosts())
        node.paths = at = node.paths or Paths()
        *whole, last = path.split("/")
        for segment in whole:
            at = at.below.setdefault(segment, Paths())
        if at.ends.get(last, ("", ""))[1] != "block":
            at.ends[last] = (host + path, verdict)
            at.lengths = tuple(sorted({*at.lengths, len(last)}, reverse=True))
    return root


def longest(root: Hosts, host: str, path: str) -> tuple[str, str] | None:
    """The rule and verdict of the longest fitting rule."""
    best: tuple[int, str, str] | None = None
    node, segments = root, path.split("/")
    for label in reversed(host.split(".") if host else ()):
        node = node.below.get(label)
        if node is None:
            break
        at = node.paths
        for segment in segments:
            if at is None:
                break
            for n in at.lengths:
                if n <= len(segment) and (hit := at.ends.get(segment[:n])):
                    if best is None or len(hit[0]) > best[0]:
                        best = (len(hit[0]), *hit)
                    break
            at = at.below.get(segment)
    return best and best[1:]


def judge(urls: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, url: str = "url", keep: list[str] | None = None, default: str = "allow") -> DataFrame:
    own = ("host", "path", "rule", "verdict")
    carried = [c for c in (keep if keep is not None else urls.columns) if c not in own]
    rest = F.when(F.instr(F.col(url), "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)"))
    parts = urls.withColumn("_rest", rest).select(
        *carried,
        F.coalesce(F.translate(F.regexp_extract("_rest", r"^[^/?#]*", 0), UPPER, LOWER), F.lit("")).alias("host"),
        F.coalesce(F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1), F.lit("")).alias("path"),
    )
    trie = urls.sparkSession.sparkContext.broadcast(build(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = trie.value
        for b in batches:
            found = [longest(root, h, p) or (None, default) for h, p in zip(b.column("host").to_pylist(), b.column("path").to_pylist(), strict=True)]
            rule, verdict = pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, rule, verdict], names=[*b.schema.names, "rule", "verdict"])

    schema = T.StructType([*parts.schema.fields, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])
    return parts.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), keep=["page_id"])


ORACLE = r"""
WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
p AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM r),
rules(h, s, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
                          ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
f AS (
  SELECT page_id, h || s AS rule, v,
         row_number() OVER (PARTITION BY page_id ORDER BY length(h || s) DESC) AS n
  FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.v, 'allow') AS verdict
FROM p LEFT JOIN f ON f.page_id = p.page_id AND f.n = 1
"""
