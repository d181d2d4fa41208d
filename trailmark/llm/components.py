"""Connected components of links, by alternating large and small stars. Nothing goes to the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of links (a, b); component: the smallest node reached.

    Each round joins links with the smallest neighbour of one end; links only ever move towards
    smaller nodes, so once a round changes nothing all that is left are stars.
    """
    pairs = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    state = None
    edges = written(pairs, "links")
    while True:
        # large star: what is above u goes to the least node that u knows
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).withColumnRenamed("u", "w")
        up = edges.select(F.col("v").alias("w"), F.col("u").alias("x"))
        down = least.select(F.col("w").alias("x"), "m")
        large = up.join(least, "w").select("x", "m").unionByName(down)
        large = large.where("x <> m").select(F.col("x").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and what is below it go to the least of them
        kept = written(large, "large")
        lows = kept.groupBy("u").agg(F.min("v").alias("m"))
        small = kept.join(lows, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lows.select("u", F.col("m").alias("v")))
        edges = written(small.where("u <> v").distinct(), "small")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == state:
            break
        state = now
    stars = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
