"""Operator 10: a rule bitmask ledger.

Every rule is evaluated once; the ledger keeps its measurements and one failure bit a rule in
`fail_bits`. Policies are versioned masks over those bits, so another policy or an ablation needs
no second look at the texts: verdicts are `fail_bits & mask`, ablations one bitwise aggregation.

Only DataFrame functions run here. Nulls: a null text has no words, so it fails the length rule.
Empty text: likewise. Repeated rows are judged row by row. An empty table gives an empty ledger.
Extra columns are carried along unless `keep` says which; the ledger's own names (MEASURES,
n_lines, fail_bits) replace columns of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, let, table, text_of

SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """A rule fails where `failed` is true of the measurements."""

    bit: int
    name: str
    failed: str


#: Bits are never given to another rule: stored ledgers stay readable.
RULES = (
    Rule(0, "too_short", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > 3 * n_words"),
    Rule(3, "repeated_lines", "n_dup_lines >= 5 and 10 * n_dup_lines > 3 * n_lines"),
    Rule(4, "word_length", "word_chars < 2 * n_words or word_chars > 20 * n_words"),
)
BASE_MASK = 0b00011
#: Versioned policies: a document is kept if none of the policy's bits is set.
POLICIES = {"v1": BASE_MASK, "v2": 0b11111}
CURRENT = "v2"


def measures(text: Column) -> dict[str, Column]:
    """The measurements of a text, as long columns.

    Repeats: a word repeats if it lies in a window of three words that the text holds twice or
    more. Windows are compared by a 64-bit hash; sorting (hash, place) brings equal ones together,
    so very long texts cost n log n.
    """

    def repeats(words: Column) -> Column:
        hashes = F.transform(
            F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))),
            lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)),
        )

        def covered(h: Column) -> Column:
            def of(order: Column) -> Column:
                twice = F.filter(
                    order,
                    lambda x, i: (F.get(order, i - 1)["h"] == x["h"]) | (F.get(order, i + 1)["h"] == x["h"]),
                )
                places = F.array_sort(F.transform(twice, lambda x: x["p"]))
                return F.aggregate(
                    places,
                    F.struct(F.lit(0).alias("n"), F.lit(-3).alias("at")),
                    lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["at"])).alias("n"), p.alias("at")),
                    lambda a: a["n"],
                )

            order = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
            return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(order, of))

        return let(hashes, covered)

    def of_lines(lines: Column) -> Column:
        return F.struct(
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        )

    bare = F.translate(text, " \t\n\x0b\x0c\r", "")
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0)
    of_words = let(
        words,
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeats(w).cast("long").alias("n_repeat_words")),
    )
    return {
        "_w": of_words,
        "_l": let(lines, of_lines),
        "word_chars": F.length(bare).cast("long"),
        "n_symbols": (F.length(bare) - F.length(F.translate(bare, SYMBOLS, ""))).cast("long"),
    }


def ledger(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with the measurements and fail_bits; keep: the columns to carry, all by default."""
    own = {*MEASURES, "n_lines", "fail_bits", "_w", "_l", "_t"}
    carried = [c for c in (keep if keep is not None else docs.columns) if c not in own]
    m = measures(F.col("_t"))
    out = docs.select(*carried, text_of(text).alias("_t")).select(*carried, *(c.alias(k) for k, c in m.items()))
    out = out.select(
        *carried,
        F.col("_w.n_words"), "word_chars", "n_symbols", F.col("_l.n_dup_lines"), F.col("_w.n_repeat_words"),
        F.col("_l.n_lines"),
    )
    bits = sum((F.when(F.expr(r.failed), F.lit(1 << r.bit)).otherwise(F.lit(0)) for r in RULES), F.lit(0))
    return out.withColumn("fail_bits", bits.cast("long"))


def kept(policy: str = CURRENT, bits: str = "fail_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(POLICIES[policy]).cast("long")) == 0


def accepted(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """docs, with their own columns, without those that the policy rejects."""
    row = ledger(docs.select(F.struct(*docs.columns).alias("_row"), "text"), keep=["_row"])
    return row.where(kept(policy)).select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def ablations(of_ledger: DataFrame) -> DataFrame:
    """For each policy and each of its rules: documents kept, failed by the rule, kept without the rule.

    One pass: documents are first counted by fail_bits (at most 2^rules groups).
    """
    by_bits = of_ledger.groupBy("fail_bits").agg(F.count("*").alias("n"))
    cases = F.array(
        *[
            F.struct(F.lit(p).alias("policy"), F.lit(r.name).alias("rule"), F.lit(m).cast("long").alias("mask"), F.lit(1 << r.bit).cast("long").alias("bit"))
            for p, m in POLICIES.items()
            for r in RULES
            if m >> r.bit & 1
        ]
    )
    rows = by_bits.select("fail_bits", "n", F.explode(cases).alias("c")).select("fail_bits", "n", "c.*")
    failing = F.col("fail_bits").bitwiseAND(F.col("mask"))
    without = F.col("fail_bits").bitwiseAND(F.col("mask").bitwiseXOR(F.col("bit")))
    count = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(F.lit(0)))
    return rows.groupBy("policy", "rule").agg(
        count(failing == 0).alias("n_kept"),
        count(F.col("fail_bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        count(without == 0).alias("n_kept_without"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return rows.select(
        "doc_id", *MEASURES, (F.col("fail_bits").bitwiseAND(F.lit(BASE_MASK).cast("long")) != 0).alias("base_failed"), kept().alias("kept"), "fail_bits"
    )


ORACLE = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
l AS (
  SELECT doc_id, t, ws, len(ws) AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
         list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) AS g
  FROM w),
r AS (
  SELECT doc_id, win, list(p) AS ps
  FROM (SELECT doc_id, unnest(g) AS win, unnest(range(1, len(g) + 1)) AS p FROM l)
  GROUP BY doc_id, win HAVING count(*) > 1),
c AS (
  SELECT doc_id, count(DISTINCT p + k) AS n
  FROM (SELECT doc_id, unnest(ps) AS p FROM r), (SELECT unnest([0, 1, 2]) AS k)
  GROUP BY doc_id),
m AS (
  SELECT l.doc_id, n_words, word_chars, n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
         len(ls) AS n_lines, coalesce(c.n, 0) AS n_repeat_words
  FROM l LEFT JOIN c ON c.doc_id = l.doc_id),
b AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END)
    + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END)
    + (CASE WHEN n_dup_lines >= 5 AND 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END)
    + (CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 16 ELSE 0 END) AS bits
  FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, (bits & 3) <> 0 AS base_failed,
       (bits & 31) = 0 AS kept, CAST(bits AS BIGINT) AS fail_bits
FROM b
"""
