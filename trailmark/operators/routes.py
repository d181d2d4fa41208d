"""Routes as rows: turns, straight runs, elevation totals, map layers, reviews, name cross-checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import bearing, maneuver, touches_zone, turn
from ..functions.intervals import fraction, needed

PALETTE = 10


def turns(route: DataFrame) -> DataFrame:
    """route (route_id, ord, name, ulat, ulon, vlat, vlon) with bearing, angle to the next edge, and the words for it."""
    w = Window.partitionBy("route_id").orderBy("ord")
    rows = route.withColumn("bearing", bearing(F.col("ulat"), F.col("ulon"), F.col("vlat"), F.col("vlon")))
    rows = rows.withColumn("angle", turn(F.col("bearing"), F.lead("bearing").over(w))).withColumn("onto", F.lead("name").over(w))
    return rows.withColumn("instruction", maneuver(F.col("angle")))


def straight_runs(route: DataFrame, angle: float = 30.0) -> DataFrame:
    """(route_id, run, first_ord, edges, m, names): a run ends where the heading turns by more than angle or is unknown."""
    w = Window.partitionBy("route_id").orderBy("ord")
    rows = turns(route).withColumn("_was", F.lag("angle").over(w))
    rows = rows.withColumn("_new", F.when(F.col("_was").isNull() | (F.abs("_was") > angle), 1).otherwise(0))
    rows = rows.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    names = F.array_join(F.array_sort(F.collect_set("name")), ", ")
    return rows.groupBy("route_id", "run").agg(F.min("ord").alias("first_ord"), F.count("*").alias("edges"), F.sum("length").alias("m"), F.left(names, F.lit(48)).alias("names"))


def elevation_totals(route: DataFrame) -> DataFrame:
    """route (route_id, length, zu, zv, deadhead) summed: metres, ascent and descent, deadhead's share."""
    rise = F.col("zv") - F.col("zu")
    s = lambda c, x: F.sum(F.when(c, x).otherwise(F.lit(0.0)))
    dead = F.col("deadhead")
    return route.groupBy("route_id").agg(
        s(~dead, F.col("length")).alias("required_m"), s(dead, F.col("length")).alias("deadhead_m"), s(rise > 0, rise).alias("ascent_m"),
        s(rise < 0, -rise).alias("descent_m"), s(dead & (rise > 0), rise).alias("deadhead_ascent_m"),
    )


def layer_status(edges: DataFrame, line: Column, zones: list[tuple[float, float, float]]) -> DataFrame:
    """edges (length, intervals, note; intervals null where unseen needs `seen`) with status base, partial or done, and its layer."""
    hidden = touches_zone(line, zones)
    frac = F.when(F.col("seen"), fraction(F.col("intervals")))
    done = frac >= needed(F.col("length"))
    status = F.when(hidden | frac.isNull(), "base").when(done, "done").when(frac >= 0.05, "partial").otherwise("base")
    layer = F.when(status == "done", F.when(F.trim(F.coalesce("note", F.lit(""))) == "", "(unlabelled)").otherwise(F.col("note")))
    return edges.withColumn("status", status).withColumn("layer", layer)


def trimmed_extent(values: DataFrame, column: str, trim: float = 0.0015) -> DataFrame:
    """One row (low, high): values at index int(n * trim) from either end. Ranks by count, so nothing is collected."""
    counts = values.groupBy(column).agg(F.count("*").alias("_c"))
    n = counts.agg(F.sum("_c").alias("_n"))
    w = Window.orderBy(column)  # a row for each distinct value
    ranked = counts.withColumn("_upto", F.sum("_c").over(w)).join(n, F.lit(True)).withColumn("_i", F.floor(F.col("_n") * trim))
    low = F.min(F.when(F.col("_upto") > F.col("_i"), F.col(column)))
    high = F.min(F.when(F.col("_upto") > F.col("_n") - 1 - F.col("_i"), F.col(column)))
    return ranked.agg(low.alias("low"), high.alias("high"))


def review_flags(imports: DataFrame) -> DataFrame:
    """imports with `flags`, an array: what is odd about an import's figures."""
    raw, near, got = F.col("raw_m"), F.col("near_target_trace_m"), F.coalesce("required_assigned_m", "assigned_m")
    rules = {
        "vehicle": F.col("vehicle_m") > 0,
        "gps_gaps": F.col("n_raw_gaps") > 0,
        "assigned_over_physical": (raw != 0) & (got > raw * 1.05),
        "unmatched": (F.col("n_points") > 0) & (F.col("n_unmatched") / F.col("n_points") >= 0.20),
        "far_from_inventory": (raw != 0) & (near / raw < 0.60),
        "assigned_over_near": (near != 0) & (got > near * 1.20),
        "repeats_or_fragments": (near >= 1000) & (got / near < 0.65),
    }
    flags = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()])
    return imports.withColumn("flags", F.filter(flags, lambda x: x.isNotNull()))


def cross_check(official: DataFrame, inventory: DataFrame) -> DataFrame:
    """official (name, m) against inventory (name, m): (name, official_m, inventory_m, verdict).

    A name is looked up as it is, then without spaces, then with ' street'; a length of 0 is no find.
    """
    squash = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    by = inventory.groupBy("name").agg(F.sum("m").alias("m"))
    tight = inventory.groupBy(squash(F.col("name")).alias("_k")).agg(F.sum("m").alias("_tight"))
    rows = official.where("m >= 30").select("name", F.col("m").alias("official_m"))
    rows = rows.join(by.select("name", F.col("m").alias("_plain")), "name", "left")
    rows = rows.withColumn("_k", squash(F.col("name"))).join(tight, "_k", "left")
    rows = rows.withColumn("_s", F.concat("name", F.lit(" street"))).join(by.select(F.col("name").alias("_s"), F.col("m").alias("_street")), "_s", "left")
    found = F.coalesce(F.nullif("_plain", F.lit(0.0)), F.nullif("_tight", F.lit(0.0)), "_street", F.lit(0.0))
    rows = rows.withColumn("inventory_m", found)
    verdict = F.when(F.col("inventory_m") >= 0.45 * F.col("official_m"), "matched").when(F.col("inventory_m") < 30, "missing").otherwise("undercount")
    return rows.select("name", "official_m", "inventory_m", verdict.alias("verdict"))
