"""Unions of fraction ranges [lo, hi], in two forms: within an array, and over rows.

The array form keeps a row a target; the row form (gaps and islands) never gathers a target's
spans, so a target with millions of spans stays distributed work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOUCH = 1e-9
SPAN = "array<struct<lo:double,hi:double>>"


def merged(spans: Column) -> Column:
    """Disjoint sorted union of an array of (lo, hi); ends that are swapped are put right."""
    fixed = F.array_sort(F.transform(spans, lambda s: F.struct(F.least(s["lo"], s["hi"]).alias("lo"), F.greatest(s["lo"], s["hi"]).alias("hi"))))
    empty = F.array().cast(SPAN)

    def add(held: Column, s: Column) -> Column:
        last = F.element_at(held, -1)
        joined = F.concat(F.slice(held, 1, F.size(held) - 1), F.array(F.struct(last["lo"].alias("lo"), F.greatest(last["hi"], s["hi"]).alias("hi"))))
        return F.when((F.size(held) > 0) & (s["lo"] <= F.try_element_at(held, F.lit(-1))["hi"] + TOUCH), joined).otherwise(F.concat(held, F.array(s)))

    return F.aggregate(fixed, empty, add)


def fraction(spans: Column) -> Column:
    """Covered share of a disjoint union, at most 1; null means all, as old records have no spans."""
    total = F.aggregate(spans, F.lit(0.0), lambda a, s: a + (s["hi"] - s["lo"]))
    return F.when(spans.isNull(), F.lit(1.0)).otherwise(F.least(F.lit(1.0), total))


def needed(length: Column) -> Column:
    """The share from which a target counts as complete: up to 15 m may be missing, never more than half."""
    return F.greatest(F.lit(0.5), F.lit(1.0) - F.lit(15.0) / F.greatest(length, F.lit(1.0)))


def islands(rows: DataFrame, keys: list[str], lo: str = "lo", hi: str = "hi") -> DataFrame:
    """(keys, lo, hi) of the disjoint union of each key's spans.

    Spans are made distinct first: the order (lo, hi) is then total, and both windows see the same.
    """
    spans = rows.select(*keys, F.least(lo, hi).alias("lo"), F.greatest(lo, hi).alias("hi")).distinct()
    order = Window.partitionBy(*keys).orderBy("lo", "hi")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    starts = spans.withColumn("_top", F.max("hi").over(before))
    starts = starts.withColumn("_new", F.when(F.col("_top").isNull() | (F.col("lo") > F.col("_top") + TOUCH), 1).otherwise(0))
    marked = starts.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_island")


def covered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_islands, frac) of each key's spans."""
    return islands(rows, keys).groupBy(*keys).agg(F.count("*").alias("n_islands"), F.least(F.lit(1.0), F.sum(F.col("hi") - F.col("lo"))).alias("frac"))
