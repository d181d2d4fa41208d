"""Planar geometry on degrees, as Column expressions: no UDFs, so scans keep their codegen stage.

Distances use metres a degree of longitude at the equator and of latitude, with the cosine of a
reference latitude. Which reference a function takes is part of its meaning: thresholds of a few
metres sit on top of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Metres a degree.
LON_M, LAT_M = 111320.0, 110540.0


def planar_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance in metres, about the mean latitude of both points."""
    return planar_at(lat1, lon1, lat2, lon2, (lat1 + lat2) / 2.0)


def planar_at(lat1: Column, lon1: Column, lat2: Column, lon2: Column, lat0: Column) -> Column:
    """Distance in metres about latitude lat0."""
    dx = (lon2 - lon1) * F.lit(LON_M) * F.cos(F.radians(lat0))
    dy = (lat2 - lat1) * F.lit(LAT_M)
    return F.sqrt(dx * dx + dy * dy)


def _scale(gy: Column, size: float) -> Column:
    """Metres a degree of longitude, for all of a band of cells."""
    return F.lit(LON_M) * F.greatest(F.cos(F.radians((gy + 0.5) * size / LAT_M)), F.lit(1e-3))


def in_cell(rows: DataFrame, lat: Column, lon: Column, size: float | Column) -> DataFrame:
    """rows with gy, gx: the grid cell of a point; cells are about size metres wide and high."""
    rows = rows.withColumn("gy", F.floor(lat * LAT_M / size))
    return rows.withColumn("gx", F.floor(lon * _scale(F.col("gy"), size) / size))


def by_cells(rows: DataFrame, lat: Column, lon: Column, size: float | Column, reach: float | Column) -> DataFrame:
    """rows once for each cell that a point within reach metres may be in: four at most, if reach is at most half of size."""
    rows = rows.withColumn("gy", F.explode(F.sequence(F.floor((lat * LAT_M - reach) / size), F.floor((lat * LAT_M + reach) / size))))
    x = lon * _scale(F.col("gy"), size)
    return rows.withColumn("gx", F.explode(F.sequence(F.floor((x - reach) / size), F.floor((x + reach) / size))))


def degrees2(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Squared distance in degrees, longitude scaled about the first point; ranks neighbours."""
    dx = (lon2 - lon1) * F.cos(F.radians(lat1))
    dy = lat2 - lat1
    return dx * dx + dy * dy


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Degrees clockwise from north, 0 to 360."""
    dx = (lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2.0))
    return F.pmod(F.degrees(F.atan2(dx, lat2 - lat1)), F.lit(360.0))


def turn(from_bearing: Column, to_bearing: Column) -> Column:
    """Signed heading change, -180 to 180; right is positive."""
    return F.pmod(to_bearing - from_bearing + 180.0, F.lit(360.0)) - 180.0


def maneuver(angle: Column) -> Column:
    """Words for a signed heading change."""
    size = F.abs(angle)
    side = F.when(angle >= 0, F.lit("right")).otherwise(F.lit("left"))
    return (
        F.when(size <= 20, F.lit("Continue"))
        .when(size <= 50, F.concat(F.lit("Slight "), side))
        .when(size <= 135, F.concat(F.lit("Turn "), side))
        .when(size <= 170, F.concat(F.lit("Sharp "), side))
        .otherwise(F.lit("U-turn"))
    )


def axis_distance(a: Column, b: Column) -> Column:
    """Degrees between two axes, 0 to 90."""
    d = F.pmod(F.abs(a - b), F.lit(180.0))
    return F.least(d, F.lit(180.0) - d)


def in_any_zone(lat: Column, lon: Column, zones: list[tuple[float, float, float]]) -> Column:
    """Whether a point lies in a circle (lat, lon, radius in metres), its edge included."""
    out = F.lit(False)
    for zlat, zlon, r in zones:
        out = out | (planar_at(F.lit(zlat), F.lit(zlon), lat, lon, F.lit(zlat)) <= r)
    return out


def point_to_segment_m(lat: Column, lon: Column, a: Column, b: Column, lat0: Column) -> Column:
    """Distance of a point to segment a-b (structs of lon, lat), about latitude lat0."""
    kx, ky = F.lit(LON_M) * F.cos(F.radians(lat0)), F.lit(LAT_M)
    bx, by = (b["lon"] - a["lon"]) * kx, (b["lat"] - a["lat"]) * ky
    px, py = (lon - a["lon"]) * kx, (lat - a["lat"]) * ky
    n = bx * bx + by * by
    t = F.when(n == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (px * bx + py * by) / n)))
    dx, dy = px - t * bx, py - t * by
    return F.sqrt(dx * dx + dy * dy)


def touches_zone(line: Column, zones: list[tuple[float, float, float]]) -> Column:
    """Whether a polyline (array of lon, lat) comes within any zone's radius."""
    out = F.lit(False)
    pairs = F.transform(F.slice(line, 1, F.greatest(F.size(line) - 1, F.lit(0))), lambda p, i: F.struct(p.alias("a"), F.get(line, i + 1).alias("b")))
    for zlat, zlon, r in zones:
        out = out | F.exists(pairs, lambda s: point_to_segment_m(F.lit(zlat), F.lit(zlon), s["a"], s["b"], F.lit(zlat)) <= r)  # noqa: B023
    return out
