"""Operator 6: mix sources to target weights by hash-random order and exact budgets.

Every document gets a key that is random but fixed: md5 of the seed and its id. Within a source,
documents in order of that key are taken until the source's budget is met; a budget above the
source's size takes the whole source again first (epochs). Running totals are distributed: the key's
first digits split a source, however large, into `2^(4 * DIGITS)` even ranges; sums by (source,
range) are added up over ranges, and a second running total is taken inside each range. So a source
with a third of all rows is no single task's load, and no text is shuffled.

Targets: the weights share the total size; a target stops at `max_epochs` times its source's size,
and what that leaves over goes to the others by weight, until none is above. Sources are the null
one (last in order) and those by code point, weighted 1, 2, 3, repeating.

Null text: size 0. Documents of size 0 are never needed: taken 0. Ties in the key are broken by
doc_id, then by size; repeated rows count as documents of their own. Documents without an id hash
the word null. An empty table gives an empty result. Extra columns are carried where `keep` names
them, except of the names made here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, text_of, word_count, written

SEED, DIGITS, MAX_EPOCHS = "mix-1", 3, 3
OWN = ("size", "source_size", "target", "budget", "before", "taken")


def targets(sized: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, weight, source_size, target) of documents with (source, size): a row a source.

    Sources fill up in the order of max_epochs * size / weight; source i stops at its limit exactly
    if its share of what the earlier ones leave is no smaller. The windows run over one row a source.
    """
    by = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = by.withColumn("weight", F.pmod(F.row_number().over(order) - 1, F.lit(3)) + 1)
    limit = F.col("source_size") * max_epochs
    filling = Window.orderBy(limit / F.col("weight"), F.col("source").asc_nulls_last())
    upto = filling.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    run = (
        weighed.withColumn("limit", limit)
        .withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(upto), F.lit(0)))
        .withColumn("weights", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(upto), F.lit(0)))
        .withColumn("full", F.col("limit") * F.col("weights") <= F.col("left") * F.col("weight"))
    )
    # the first source that isn't full has what is left for all after it
    rate = F.max(F.when(~F.col("full"), F.struct(-F.col("limit") / F.col("weight"), F.col("weights"), F.col("left").alias("left")))).over(everything)
    return run.withColumn("rate", rate).select(
        "source", "weight", "source_size",
        F.when(F.col("full"), F.col("limit").cast("double"))
        .otherwise(F.col("rate.left").cast("double") * F.col("weight") / F.col("rate.weights"))
        .alias("target"),
    )


def random_key(doc_id: str, seed: str = SEED) -> Column:
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))))


def place(doc_id: str, size: str | Column) -> Column:
    """What a source's documents are ordered by."""
    size = F.col(size) if isinstance(size, str) else size
    return F.struct(random_key(doc_id).alias("key"), F.coalesce(F.col(doc_id), F.lit(-(2**63))).alias("id"), size.alias("size"))


def take(sized: DataFrame, digits: int = DIGITS, seed: str = SEED, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """sized (with doc_id, source, size) and OWN: `before` is the size of the source's documents in front.

    taken = whole epochs of the document, and of the last, partial one what the budget still covers.
    """
    keyed = sized.withColumn("_key", random_key("doc_id", seed)).withColumn("_range", F.substring("_key", 1, digits))
    same = lambda a, b: a.eqNullSafe(b)
    shared = targets(sized, max_epochs)
    sums = keyed.groupBy("source", "_range").agg(F.sum("size").cast("long").alias("_sum"))
    upto = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    fronts = sums.select("source", "_range", F.coalesce(F.sum("_sum").over(upto), F.lit(0)).alias("_front"))
    t, f = shared.select(F.col("source").alias("_s"), "source_size", "target"), None
    f = fronts.select(F.col("source").alias("_fs"), F.col("_range").alias("_fr"), "_front")
    f = f.join(t, same(F.col("_fs"), F.col("_s"))).drop("_s")
    inside = Window.partitionBy("source", "_range").orderBy("_key", F.col("doc_id"), "size").rowsBetween(Window.unboundedPreceding, -1)
    run = keyed.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    run = run.join(f, same(run["source"], F.col("_fs")) & (run["_range"] == F.col("_fr")))
    whole = lambda a, b: F.expr(f"if({b} = 0, 0, {a} div {b})")
    return (
        run.withColumn("budget", F.floor(F.col("target") + 0.5).cast("long"))
        .withColumn("before", F.col("_front") + F.col("_in"))
        .withColumn("_epochs", whole("budget", "source_size"))
        .withColumn("_rest", F.col("budget") - F.col("_epochs") * F.col("source_size"))
        .withColumn("taken", (F.col("_epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - F.col("before")))).cast("long"))
        .drop("_key", "_range", "_fs", "_fr", "_front", "_in", "_epochs", "_rest")
    )


def sized(docs: DataFrame, keep: list[str], size: Column | None = None) -> DataFrame:
    cols = [c for c in keep if c not in (*OWN, "doc_id", "source")]
    return docs.select("doc_id", "source", *cols, (size if size is not None else word_count(text_of())).alias("size"))


def mixed(docs: DataFrame) -> DataFrame:
    """The mix as documents: a row for each time a document is taken, with the columns of docs.

    Documents stay whole: the one that the budget cuts is taken if at least half of it fits. Each
    source's order is cut at one place, so the texts are only filtered, never sorted or shuffled;
    rows that repeat an id and a size stand or fall together.
    """
    sizes = written(sized(docs, []), "sizes")
    got = written(take(sizes).select("doc_id", "source", "size", "source_size", "budget", "taken"), "taken")
    epochs = F.expr("if(source_size = 0, 0, budget div source_size)")
    part = F.col("taken") - epochs * F.col("size")
    cuts = got.groupBy(F.col("source").alias("_source")).agg(
        F.max(epochs).alias("_epochs"),
        F.max(F.when((F.col("size") > 0) & (part * 2 >= F.col("size")), place("doc_id", "size"))).alias("_last"),
    )
    row = docs.select(F.struct(*docs.columns).alias("_row"), "source", place("doc_id", word_count(text_of())).alias("_at"))
    times = F.col("_epochs") + F.coalesce((F.col("_at") <= F.col("_last")).cast("int"), F.lit(0))
    return (
        row.join(cuts, row["source"].eqNullSafe(cuts["_source"]))
        .where(F.col("_at.size") > 0)
        .withColumn("_times", times.cast("int"))
        .where(F.col("_times") > 0)
        .select("_row", F.explode(F.sequence(F.lit(1), F.col("_times"))))
        .select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = written(sized(table(spark, sf_dir, "documents"), []), "sizes")
    return take(sizes).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS lim FROM s),
o AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(lim) OVER f, 0) AS lft, sum(weight) OVER () - coalesce(sum(weight) OVER f, 0) AS ws
  FROM w WINDOW f AS (ORDER BY CAST(lim AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
u AS (SELECT *, lim * ws <= lft * weight AS is_full FROM o),
b AS (SELECT lft AS l0, ws AS w0 FROM u WHERE NOT is_full ORDER BY CAST(lim AS DOUBLE) / weight, source NULLS LAST LIMIT 1),
t AS (
  SELECT source, source_size,
         CASE WHEN is_full THEN CAST(lim AS DOUBLE) ELSE CAST(l0 AS DOUBLE) * weight / w0 END AS target
  FROM u LEFT JOIN b ON true),
r AS (
  SELECT doc_id, size, source_size, target, CAST(floor(target + 0.5) AS BIGINT) AS budget,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE budget // source_size END AS ep FROM r)
SELECT doc_id, size, source_size, target,
       CAST(ep * size + greatest(0, least(size, budget - ep * source_size - bef)) AS BIGINT) AS taken
FROM e
"""
