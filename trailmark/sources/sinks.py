"""Results as files: GPX, GeoJSON, JSON stores, routes, map layers as SVG."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def replace_file(spark: SparkSession, path: str, text: str) -> None:
    """Write a file in one step: a new file beside it, then a rename. Works on any file system that Spark knows."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, part = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    fs = target.getFileSystem(conf)
    out = fs.create(part)
    out.write(bytearray(text.encode()))
    out.hsync()
    out.close()
    if fs.exists(target):
        fs.delete(target, False)
    if not fs.rename(part, target):
        raise OSError(f"{path} can't be replaced")


def write_snapshot(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """A prepared network, so that later commands don't prepare it again."""
    nodes.write.mode("overwrite").parquet(f"{folder}/nodes")
    edges.write.mode("overwrite").parquet(f"{folder}/edges")


def read_snapshot(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/edges")


def store_json(walked: DataFrame, meta: dict[str, str | int]) -> str:
    """A store as one JSON text (a store is a zone's passages)."""
    record = F.struct(F.transform("intervals", lambda s: F.array(s["lo"], s["hi"])).alias("intervals"), "date", "note", "last_date")
    head = [F.lit(v).alias(k) for k, v in meta.items()]
    entries = F.array_sort(F.collect_list(F.struct("coverage_id", record)))
    return walked.agg(F.to_json(F.struct(F.map_from_entries(entries).alias("walked"), *head)).alias("j")).first().j


def xml_text(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def gpx(points: DataFrame, cues: DataFrame | None, name: str) -> str:
    """GPX of points (ord, lat, lon, ele) of one route, repeated points dropped, with cues (ord, lat, lon, text) as waypoints."""
    w = Window.orderBy("ord")  # one route
    kept = points.withColumn("_a", F.lag("lat").over(w)).withColumn("_b", F.lag("lon").over(w)).where(~(F.col("lat").eqNullSafe(F.col("_a")) & F.col("lon").eqNullSafe(F.col("_b"))))
    at = lambda tag, body: F.concat(F.format_string(f'<{tag} lat="%.7f" lon="%.7f">', "lat", "lon"), body, F.lit(f"</{tag}>"))
    ele = F.when(F.col("ele").isNotNull(), F.format_string("<ele>%.1f</ele>", "ele")).otherwise(F.lit(""))
    lines = lambda df, x: df.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", x.alias("x")))), lambda s: s["x"]), "\n").alias("t")).first().t
    track = lines(kept, at("trkpt", ele))
    way = lines(cues, at("wpt", F.concat(F.lit("<name>"), xml_text(F.col("text")), F.lit("</name>")))) + "\n" if cues is not None else ""
    title = name.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<gpx version="1.1" creator="trailmark" xmlns="http://www.topografix.com/GPX/1/1">\n{way}<trk><name>{title}</name><trkseg>\n{track}\n</trkseg></trk>\n</gpx>\n'


def geojson(rows: DataFrame, line: Column, properties: list[str], order: str) -> str:
    """A FeatureCollection of lines, a feature a row."""
    coords = F.transform(line, lambda p: F.array(p["lon"], p["lat"]))
    feature = F.struct(
        F.lit("Feature").alias("type"), F.struct(F.lit("LineString").alias("type"), coords.alias("coordinates")).alias("geometry"), F.struct(*properties).alias("properties")
    )
    all_ = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), feature.alias("_f")))), lambda s: s["_f"])
    return rows.agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), all_.alias("features"))).alias("j")).first().j


def progress_geojson(edges: DataFrame, line: Column, walked: DataFrame, canonical: bool = True) -> str:
    """Edges with whether they are walked; canonical: only what is required."""
    rows = edges.where("coverage_required") if canonical else edges
    flag = walked.select("coverage_id").distinct().withColumn("walked", F.lit(True))
    rows = rows.join(flag, "coverage_id", "left").withColumn("walked", F.coalesce("walked", F.lit(False)))
    return geojson(rows, line, ["coverage_id", "coverage_name", "walked"], "edge_ord")


def route_json(route: DataFrame) -> str:
    """A route as an array of [u, v, key, deadhead]."""
    steps = F.array_sort(F.collect_list(F.struct("ord", "u", "v", "key", "deadhead")))
    made = route.agg(F.to_json(steps).alias("j")).first().j
    return json.dumps([[s["u"], s["v"], s["key"], s["deadhead"]] for s in json.loads(made)])


def svg(rows: DataFrame, line: Column, colours: dict[str, str], size: int = 1000, pad: float = 0.035) -> str:
    """Map layers of rows with `status` and `layer` as SVG: base, then partial, then done."""
    order = F.when(F.col("status") == "base", 0).when(F.col("status") == "partial", 1).otherwise(2)
    drawn = rows.select(order.alias("z"), "status", "layer", line.alias("line")).where("line is not null")
    box = drawn.select(F.explode("line").alias("p")).agg(F.min("p.lon"), F.max("p.lon"), F.min("p.lat"), F.max("p.lat")).first()
    if box[0] is None:
        return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {size} {size}"></svg>'
    w, h = max(box[1] - box[0], 1e-9), max(box[3] - box[2], 1e-9)
    k = size / max(w, h)
    path = F.array_join(F.transform("line", lambda p: F.format_string("%.1f,%.1f", (p["lon"] - box[0]) * k + size * pad, (F.lit(box[3]) - p["lat"]) * k + size * pad)), " ")
    out = []
    for r in drawn.orderBy("z").select("status", "layer", path.alias("d")).toLocalIterator():
        colour = colours.get(r.layer or "", "#d33") if r.status == "done" else "#e90" if r.status == "partial" else "#bbb"
        out.append(f'<polyline fill="none" stroke="{colour}" points="{r.d}"/>')
    full = (round(w * k + 2 * size * pad), round(h * k + 2 * size * pad))
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {full[0]} {full[1]}">\n' + "\n".join(out) + "\n</svg>\n"
