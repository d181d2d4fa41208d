"""Turn-by-turn cues and track points of routes."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import planar_m
from .routes import turns

SHARP, APART_M = 50.0, 25.0
CUES = "route_id string, ord int, lat double, lon double, text string, street string, sym string"


def cues(legs: DataFrame) -> DataFrame:
    """CUES of routes (route_id, ord, name, ulat, ulon, vlat, vlon): start, turns onto other streets or by more than 20 degrees, end.

    A cue is dropped if it comes within 25 m of the last one kept and its turn is under 50 degrees: a
    fold, so each route is one group.
    """

    def fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        first, last = pdf.iloc[0], pdf.iloc[-1]
        out = [(int(first.ord), first.ulat, first.ulon, f"Start on {first['name'] or 'path'}", first["name"], "Flag, Green")]
        for r in pdf.iloc[:-1].to_dict("records"):
            angle = r["angle"]
            sharp = angle is not None and not math.isnan(angle) and abs(angle) >= SHARP
            turned = angle is not None and not math.isnan(angle) and abs(angle) > 20
            if not turned and (r["onto"] or "") == (r["name"] or ""):
                continue
            _, lat, lon, *_ = out[-1]
            dx = (r["vlon"] - lon) * 111320.0 * math.cos(math.radians((lat + r["vlat"]) / 2))
            if sharp or math.hypot(dx, (r["vlat"] - lat) * 110540.0) >= APART_M:
                text = f"{r['instruction']} onto {r['onto']}" if r["onto"] else r["instruction"]
                out.append((int(r["ord"]) + 1, r["vlat"], r["vlon"], text, r["onto"], "Left" if "left" in r["instruction"] else "Right" if "right" in r["instruction"] else "Straight"))
        out.append((int(last.ord) + 1, last.vlat, last.vlon, "End", last["name"], "Flag, Red"))
        return pd.DataFrame([(str(key[0]), *x) for x in out], columns=[c.split()[0] for c in CUES.split(", ")])

    return turns(legs).groupBy("route_id").applyInPandas(fold, CUES)


def with_heights(line: Column, zu: Column, zv: Column) -> Column:
    """line (lon, lat) as points (lon, lat, ele): heights go evenly, by planar distance, from one end's to the other's."""
    legs = F.transform(F.slice(line, 2, F.greatest(F.size(line) - 1, F.lit(0))), lambda p, i: planar_m(F.get(line, i)["lat"], F.get(line, i)["lon"], p["lat"], p["lon"]))
    whole = F.aggregate(legs, F.lit(0.0), lambda a, m: a + m)

    def height(p: Column, i: Column) -> Column:
        run = F.aggregate(F.slice(legs, 1, i), F.lit(0.0), lambda a, m: a + m)
        share = F.when(whole > 0, run / whole).otherwise(F.lit(0.0))
        return F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"), (zu + (zv - zu) * share).alias("ele"))

    return F.transform(line, height)
