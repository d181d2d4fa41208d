"""Coverage evidence and what follows from it: completion, diary, what remains, migration."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import by_cells, in_cell, planar_m
from ..functions.intervals import covered, fraction, merged, needed


def edge_id(u: Column, v: Column, key: Column, coverage_id: Column | None = None) -> Column:
    """coverage_id if there is one, else both ends in string order and the key."""
    u, v = u.cast("string"), v.cast("string")
    plain = F.concat_ws("-", F.least(u, v), F.greatest(u, v), key.cast("string"))
    return plain if coverage_id is None else F.coalesce(coverage_id, plain)


def alias_lookup(edges: DataFrame, walked: DataFrame) -> DataFrame:
    """(edge_ord, coverage_id, place): records found for an edge under any of its ids (column `ids`), in that order, once each."""
    wanted = edges.select("edge_ord", F.posexplode(F.array_distinct("ids")).alias("place", "coverage_id"))
    return wanted.join(walked.select("coverage_id").distinct(), "coverage_id")


def combined(records: DataFrame, key: str) -> DataFrame:
    """(key, intervals, date, note): union of records (intervals, date, note, ord); date and note of the earliest, first on a tie."""
    first = F.min(F.struct(F.coalesce("date", F.lit("")).alias("d"), F.col("ord"), F.col("date"), F.col("note")))
    whole = F.array(F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi")))
    rows = records.groupBy(key).agg(F.flatten(F.collect_list(F.coalesce("intervals", whole))).alias("_i"), first.alias("_f"))
    return rows.select(key, merged(F.col("_i")).alias("intervals"), F.col("_f.date").alias("date"), F.col("_f.note").alias("note"))


def complete(frac: Column, length: Column) -> Column:
    return frac >= needed(length)


def complete9(frac: Column, length: Column) -> Column:
    """complete, with both sides rounded: sums of floats in another order give the same answer."""
    return F.round(frac, 9) >= F.round(needed(length), 9)


def stats(targets: DataFrame) -> DataFrame:
    """One row over targets (length, frac; null frac: never seen)."""
    frac, done = F.coalesce("frac", F.lit(0.0)), F.coalesce(complete9(F.col("frac"), F.col("length")), F.lit(False))
    rows = targets.select("length", frac.alias("f"), done.alias("done"))
    agg = rows.agg(
        F.count("*").alias("n_required"),
        F.coalesce(F.sum("length"), F.lit(0.0)).alias("total"),
        F.coalesce(F.sum(F.when(F.col("done"), F.col("length"))), F.lit(0.0)).alias("walked"),
        F.coalesce(F.sum(F.col("length") * F.col("f")), F.lit(0.0)).alias("covered"),
        F.count_if("done").alias("n_complete"),
        F.count_if(~F.col("done") & (F.col("f") > 0)).alias("n_partial"),
    )
    share = lambda x: F.when(F.col("total") > 0, 100.0 * F.col(x) / F.col("total")).otherwise(F.lit(0.0))
    return agg.select(
        "n_required", "n_complete", "n_partial", (F.col("total") / 1000).alias("total_km"), (F.col("walked") / 1000).alias("walked_km"),
        (F.col("covered") / 1000).alias("covered_km"), share("walked").alias("pct_done"), share("covered").alias("observed_pct"),
    )


def by_name(targets: DataFrame) -> DataFrame:
    """Completion of every name, over targets (name, length, frac)."""
    done = F.coalesce(complete9(F.col("frac"), F.col("length")), F.lit(False))
    rows = targets.select("name", "length", F.coalesce("frac", F.lit(0.0)).alias("f"), done.alias("done"))
    return rows.groupBy("name").agg(
        F.count("*").alias("targets"), F.count_if("done").alias("complete"), F.sum("length").alias("length_m"), F.sum(F.col("length") * F.col("f")).alias("covered_m")
    )


def remaining_by_name(targets: DataFrame) -> DataFrame:
    """(name, left, left_m) of what isn't complete."""
    open_ = targets.where(~F.coalesce(complete9(F.col("frac"), F.col("length")), F.lit(False)))
    return open_.groupBy("name").agg(F.count("*").alias("left"), F.sum("length").alias("left_m"))


def remaining_edges(edges: DataFrame, done: DataFrame, required_only: bool = True) -> DataFrame:
    """edges (coverage_id, coverage_required) without the complete ids."""
    rows = edges.where("coverage_required") if required_only else edges
    return rows.join(done.select("coverage_id"), "coverage_id", "left_anti")


def diary(records: DataFrame) -> DataFrame:
    """(date, km, named_km, edges) of records (date, length, frac, named), by first date; without one: '?'."""
    rows = records.withColumn("date", F.coalesce("date", F.lit("?"))).withColumn("m", F.col("length") * F.col("frac"))
    return rows.groupBy("date").agg(
        (F.sum("m") / 1000).alias("km"), (F.sum(F.when(F.col("named"), F.col("m")).otherwise(F.lit(0.0))) / 1000).alias("named_km"), F.count("*").alias("edges")
    )


def diary_notes(records: DataFrame) -> DataFrame:
    """(date, note, km): the diary by note; blank notes aren't shown."""
    rows = records.where(F.trim(F.coalesce("note", F.lit(""))) != "").withColumn("date", F.coalesce("date", F.lit("?")))
    return rows.groupBy("date", "note").agg((F.sum(F.col("length") * F.col("frac")) / 1000).alias("km"))


def recorded(walked: DataFrame, spans: DataFrame, date: str, note: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(walked with spans added, gained): spans (coverage_id, lo, hi) are clamped and united with what is there.

    First date and note stay; last_date is set. gained has (coverage_id) of targets that grew by more than 1e-6.
    """
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c)))
    new = spans.groupBy("coverage_id").agg(F.collect_list(F.struct(clamp("lo").alias("lo"), clamp("hi").alias("hi"))).alias("_new"))
    whole = F.array(F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi")))
    none = F.array().cast("array<struct<lo:double,hi:double>>")
    held = walked.withColumn("_old", F.coalesce("intervals", whole))
    rows = held.join(new, "coverage_id", "full").withColumn("_was", fraction(F.coalesce("_old", none)))
    rows = rows.withColumn("intervals", merged(F.concat(F.coalesce("_old", none), F.coalesce("_new", none))))
    touched = F.col("_new").isNotNull()
    out = rows.select(
        "coverage_id", "intervals", F.when(F.col("_old").isNull(), F.lit(date)).otherwise(F.col("date")).alias("date"),
        F.when(F.col("_old").isNull(), F.lit(note)).otherwise(F.coalesce("note", F.when(touched, F.lit(note)))).alias("note"),
        F.when(touched, F.lit(date)).otherwise(F.col("last_date")).alias("last_date"),
    )
    gained = rows.where(touched & (fraction(F.col("intervals")) - F.col("_was") > 1e-6)).select("coverage_id")
    return out, gained


def mark_route(route: DataFrame, edges: DataFrame) -> DataFrame:
    """(coverage_id, lo, hi): full spans of a walked route; unannotated edges only where they aren't deadhead; unknown edges are ignored."""
    a, b = F.least("u", "v"), F.greatest("u", "v")
    keyed = edges.select(a.alias("_a"), b.alias("_b"), F.col("key").alias("_k"), "coverage_id", edge_id(F.col("u"), F.col("v"), F.col("key")).alias("_plain"))
    rows = route.withColumn("_a", a).withColumn("_b", b).withColumn("_k", F.col("key")).join(keyed, ["_a", "_b", "_k"])
    rows = rows.where(F.col("coverage_id").isNotNull() | ~F.col("deadhead"))
    return rows.select(F.coalesce("coverage_id", "_plain").alias("coverage_id"), F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi")).distinct()


def first_completion(spans: DataFrame, targets: DataFrame) -> DataFrame:
    """(coverage_id, length, import_ord): the import whose spans make a target complete.

    Spans carry import_ord. Covered share only grows, so for each import the union of all spans up
    to it is taken: each span is repeated for the imports of its own target from its own on.
    """
    imports = spans.select("coverage_id", F.col("import_ord").alias("upto")).distinct()
    rows = spans.join(imports, "coverage_id").where("import_ord <= upto").select("coverage_id", "upto", "lo", "hi")
    frac = covered(rows, ["coverage_id", "upto"]).join(targets.select("coverage_id", "length"), "coverage_id")
    return frac.where(complete9(F.col("frac"), F.col("length"))).groupBy("coverage_id", "length").agg(F.min("upto").alias("import_ord"))


def rekey(old: DataFrame, new: DataFrame) -> DataFrame:
    """(old_id, new_id or null): the nearest target of the same name, under 40 m away and of similar length.

    old and new have (id, ord, name, lat, lon, length): midpoints. Only cells about a midpoint are compared.
    """
    place = (F.col("lat"), F.col("lon"))
    a, b = by_cells(old, *place, 120.0, 50.0).alias("a"), in_cell(new, *place, 120.0).alias("b")
    d = planar_m(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"))
    close = (d < 40) & (F.abs(F.col("a.length") - F.col("b.length")) <= F.greatest(F.lit(20.0), 0.35 * F.col("a.length")))
    on = (F.col("a.name") == F.col("b.name")) & (F.col("a.gy") == F.col("b.gy")) & (F.col("a.gx") == F.col("b.gx"))
    hits = a.join(b, on).where(close).groupBy(F.col("a.id").alias("old_id")).agg(F.min(F.struct(d.alias("d"), F.col("b.ord"), F.col("b.id"))).alias("_m"))
    return old.select(F.col("id").alias("old_id")).join(hits.select("old_id", F.col("_m.id").alias("new_id")), "old_id", "left")


def migration(matches: DataFrame) -> DataFrame:
    """One row: migrated (distinct new ids), merged (more than one old id), lost."""
    return matches.agg(
        F.count_distinct("new_id").alias("migrated"), (F.count("new_id") - F.count_distinct("new_id")).alias("merged"), F.count_if(F.col("new_id").isNull()).alias("lost")
    )


def store_overlap(walked: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: (walked, known): known under 0.5 of walked means that the store belongs to another network."""
    known = walked.join(edges.select("coverage_id").distinct().withColumn("_k", F.lit(1)), "coverage_id", "left")
    return known.agg(F.count("*").alias("walked"), F.count("_k").alias("known")).withColumn("warn", F.col("known") < 0.5 * F.col("walked"))


def across_areas(targets: DataFrame) -> DataFrame:
    """targets (area_ord, edge_ord, name, lat, lon, length, frac), with those of several areas counted once.

    Greedy in arrival order within a name: a target joins the first earlier one within 40 m and of
    similar length, which keeps the larger fraction. The fold depends on the order, so a name is one
    task's work; names have few targets.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        import math

        pdf = pdf.sort_values(["area_ord", "edge_ord"])
        kept: list[dict] = []
        for r in pdf.to_dict("records"):
            for k in kept:
                dx = (r["lon"] - k["lon"]) * 111320.0 * math.cos(math.radians((r["lat"] + k["lat"]) / 2))
                dy = (r["lat"] - k["lat"]) * 110540.0
                if math.hypot(dx, dy) <= 40 and abs(r["length"] - k["length"]) <= max(20.0, 0.35 * k["length"]):
                    k["frac"] = max(k["frac"], r["frac"])
                    break
            else:
                kept.append(dict(r))
        return pd.DataFrame(kept, columns=list(pdf.columns))

    return targets.groupBy("name").applyInPandas(fold, targets.schema)


def note_order(records: DataFrame) -> DataFrame:
    """(note, first_date, colour): notes by first date, with a palette place that later notes don't change."""
    firsts = records.groupBy("note").agg(F.min("date").alias("first_date"))
    order = Window.orderBy("first_date", "note")  # a row a note
    return firsts.withColumn("colour", F.pmod(F.row_number().over(order) - 1, F.lit(10)))

