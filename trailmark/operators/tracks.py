"""GPS tracks as window queries: steps, rides, splitting, distances."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import planar_m

SEGMENT = ["walk_id", "seg_ord"]
GAP_M, RIDE_KMH, RIDE_STEP_M, RIDE_STEPS, RIDE_M = 150.0, 13.0, 2000.0, 3, 150.0


def steps(fixes: DataFrame) -> DataFrame:
    """fixes with step_m and step_s to the next fix of the segment (null at the last)."""
    w = Window.partitionBy(*SEGMENT).orderBy("fix_ord")
    nlat, nlon, nts = (F.lead(c).over(w) for c in ("lat", "lon", "ts"))
    return fixes.withColumn("step_m", planar_m(F.col("lat"), F.col("lon"), nlat, nlon)).withColumn("step_s", nts - F.col("ts"))


def track_totals(stepped: DataFrame, keys: list[str] | None = None, gap: float = GAP_M) -> DataFrame:
    """(keys, n_points, raw_m, raw_gap_m, n_raw_gaps): jumps beyond gap are missing observation, not distance."""
    one = lambda c, x: F.coalesce(F.sum(F.when(c, x)), F.lit(0.0))
    s = F.col("step_m")
    return stepped.groupBy(*(keys or SEGMENT)).agg(
        F.count("*").alias("n_points"), one(s <= gap, s).alias("raw_m"), one(s > gap, s).alias("raw_gap_m"), F.count_if(s > gap).alias("n_raw_gaps")
    )


def is_ride() -> Column:
    """Whether a step is faster than walking; jumps of 2 km and more are gaps, not rides."""
    return F.coalesce((F.col("step_s") > 0) & (F.col("step_m") < RIDE_STEP_M) & (F.col("step_m") * 3.6 > RIDE_KMH * F.col("step_s")), F.lit(False))


def rides(stepped: DataFrame) -> DataFrame:
    """(walk_id, seg_ord, first_fix, last_fix, n_steps, ride_m) of maximal runs of ride steps that are long enough.

    Runs are islands: the place in the segment minus the place among ride steps is the same inside one.
    """
    w = Window.partitionBy(*SEGMENT).orderBy("fix_ord")
    rows = stepped.withColumn("ride", is_ride()).withColumn("_n", F.row_number().over(w))
    fast = rows.where("ride").withColumn("_island", F.col("_n") - F.row_number().over(w))
    runs = fast.groupBy(*SEGMENT, "_island").agg(
        F.min("fix_ord").alias("first_fix"), (F.max("fix_ord") + 1).alias("last_fix"), F.count("*").alias("n_steps"), F.sum("step_m").alias("ride_m")
    )
    return runs.where((F.col("n_steps") >= RIDE_STEPS) & (F.col("ride_m") >= RIDE_M)).drop("_island")


def without_rides(fixes: DataFrame) -> DataFrame:
    """fixes without those inside rides, with `piece`: where a segment is cut by a ride a new piece begins.

    A ride's two ends stay. Pieces of one fix are dropped. fix_ord is consecutive within a segment.
    """
    found = rides(steps(fixes))
    ends = found.select(*SEGMENT, F.col("last_fix").alias("fix_ord"), F.lit(1).alias("_cut"))
    within = found.where("last_fix - first_fix > 1").select(*SEGMENT, F.explode(F.sequence(F.col("first_fix") + 1, F.col("last_fix") - 1)).alias("fix_ord"))
    kept = fixes.join(within, [*SEGMENT, "fix_ord"], "left_anti").join(ends.distinct(), [*SEGMENT, "fix_ord"], "left")
    w = Window.partitionBy(*SEGMENT).orderBy("fix_ord").rowsBetween(Window.unboundedPreceding, 0)
    pieces = kept.withColumn("piece", F.coalesce(F.sum("_cut").over(w), F.lit(0)).cast("int")).drop("_cut")
    size = F.count("*").over(Window.partitionBy(*SEGMENT, "piece"))
    return pieces.withColumn("_size", size).where("_size >= 2").drop("_size")


def moved(fixes: DataFrame, least: float = 1.0) -> DataFrame:
    """fixes more than `least` metres from the last one kept: a fold, so each segment is one group."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        import math

        pdf = pdf.sort_values("fix_ord", ignore_index=True)
        keep, at = [], None
        for i, (lat, lon) in enumerate(zip(pdf["lat"], pdf["lon"], strict=True)):
            if at is not None:
                dx = (lon - at[1]) * 111320.0 * math.cos(math.radians((lat + at[0]) / 2))
                if math.hypot(dx, (lat - at[0]) * 110540.0) <= least:
                    continue
            keep.append(i)
            at = (lat, lon)
        return pdf.iloc[keep]

    return fixes.groupBy(*SEGMENT).applyInPandas(fold, fixes.schema)
