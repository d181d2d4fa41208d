"""Street networks, zones, stores and lists from files."""

from __future__ import annotations

import ast
import json
import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geo import planar_m
from ..functions.names import official_name, street_type
from ..schema import EDGES

GRAPHML = "_id string, _source string, _target string, data array<struct<_key:string,_VALUE:string>>"
RAW_NODES = "id string, lat double, lon double, tags map<string,string>"
RAW_WAYS = "id string, refs array<string>, tags map<string,string>"
#: Ways that the inventory looks at; what counts is decided by the rules.
HIGHWAYS = "trunk primary secondary tertiary unclassified residential living_street service pedestrian footway path steps track bridleway corridor cycleway busway bus_guideway".split()


def _graphml(spark: SparkSession, path: str, tag: str) -> DataFrame:
    rows = spark.read.format("xml").option("rowTag", tag).option("ignoreNamespace", "true").schema(GRAPHML).load(path)
    return rows.withColumn("d", F.map_from_entries(F.transform("data", lambda x: F.struct(x["_key"].alias("key"), x["_VALUE"].alias("value")))))


def _keys(spark: SparkSession, path: str) -> dict[str, str]:
    """GraphML's attribute keys: a few dozen declarations at the head of the file."""
    rows = spark.read.format("xml").option("rowTag", "key").option("ignoreNamespace", "true").schema("_id string, `_attr.name` string, _for string").load(path)
    return {r["_id"]: r["_attr.name"] for r in rows.collect()}


def _values(text) -> list[str] | None:
    if text is None:
        return None
    if text.startswith("[") and text.endswith("]"):
        try:
            return [str(x) for x in ast.literal_eval(text)]
        except (ValueError, SyntaxError):
            return [text]
    return [text]


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(NODES, EDGES) of a GraphML snapshot; lists in attributes become arrays, WKT geometry a polyline."""
    names = _keys(spark, path)
    back = {v: k for k, v in names.items()}
    get = lambda n: F.try_element_at("d", F.lit(back.get(n, n)))
    nodes = _graphml(spark, path, "node").select(
        F.col("_id").alias("node_id"), F.monotonically_increasing_id().alias("node_ord"), get("x").try_cast("double").alias("x"), get("y").try_cast("double").alias("y"),
        get("elevation").try_cast("double").alias("elevation"),
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                d = {names.get(k, k): v for k, v in (r.d or {}).items()}
                line = d.pop("geometry", None)
                points = None
                if line and "(" in line:
                    points = [dict(zip(("lon", "lat"), map(float, p.split()[:2]), strict=True)) for p in line[line.index("(") + 1 : line.rindex(")")].split(",")]
                try:
                    length = float(d.pop("length", "nan"))
                except ValueError:
                    length = math.nan
                osmid = d.pop("osmid", None)
                tags = {k: v for k, x in d.items() if (v := _values(x))}
                out.append((r.edge_ord, r.u, r.v, int(d.get("id") or 0) if str(d.get("id") or "0").isdigit() else 0, None if math.isnan(length) else length, osmid, points, tags))
            yield pd.DataFrame(out, columns=["edge_ord", "u", "v", "key", "length", "osmid", "geometry", "tags"])

    raw = _graphml(spark, path, "edge").select(F.monotonically_increasing_id().alias("edge_ord"), F.col("_source").alias("u"), F.col("_target").alias("v"), "d")
    return nodes, raw.mapInPandas(run, EDGES)


def read_osm(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(RAW_NODES, RAW_WAYS) of an OSM XML extract: a download is a file that something else has fetched."""
    tag = "array<struct<_k:string,_v:string>>"
    read = lambda t, s: spark.read.format("xml").option("rowTag", t).schema(s).load(path)
    tags = F.map_from_entries(F.transform(F.coalesce("tag", F.array().cast(tag)), lambda x: F.struct(x["_k"].alias("key"), x["_v"].alias("value"))))
    nodes = read("node", f"_id string, _lat double, _lon double, tag {tag}").select(F.col("_id").alias("id"), F.col("_lat").alias("lat"), F.col("_lon").alias("lon"), tags.alias("tags"))
    ways = read("way", f"_id string, nd array<struct<_ref:string>>, tag {tag}").select(F.col("_id").alias("id"), F.transform("nd", lambda x: x["_ref"]).alias("refs"), tags.alias("tags"))
    return nodes, ways


def wanted(ways: DataFrame) -> DataFrame:
    """The coverage superset: roads and paths that aren't areas, and piers."""
    get = lambda n: F.try_element_at("tags", F.lit(n))
    links = [f"{h}_link" for h in ("trunk", "primary", "secondary", "tertiary")]
    return ways.where((get("highway").isin(*HIGHWAYS, *links) & (F.coalesce(get("area"), F.lit("")) != "yes")) | (get("man_made") == "pier"))


def simplified(nodes: DataFrame, ways: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(NODES, EDGES): ways cut at junctions and ends, never across names or classes, as a way has one of each.

    A node is a junction if it is in more than one place of the ways or ends one.
    """
    steps = ways.select("id", "tags", F.size("refs").alias("_n"), F.posexplode("refs").alias("pos", "ref"))
    uses = steps.groupBy("ref").agg(F.count("*").alias("uses"), F.max((F.col("pos") == 0) | (F.col("pos") == F.col("_n") - 1)).alias("ends"))
    w = Window.partitionBy("id").orderBy("pos")
    placed = steps.join(uses, "ref").join(nodes.select(F.col("id").alias("ref"), "lat", "lon"), "ref")
    cut = ((F.col("uses") > 1) | F.col("ends")).cast("int")
    placed = placed.withColumn("cut", cut).withColumn("piece", F.sum("cut").over(w) - F.when((F.col("cut") == 1) & (F.col("pos") == F.col("_n") - 1), 1).otherwise(0))
    placed = placed.withColumn("m", planar_m(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")))
    # a junction ends one piece and begins the next
    both = placed.withColumn("p", F.when((F.col("cut") == 1) & (F.col("pos") > 0) & (F.col("pos") < F.col("_n") - 1), F.array("piece", F.col("piece") - 1)).otherwise(F.array("piece")))
    rows = both.select("id", "tags", "pos", "ref", "lat", "lon", "m", F.explode("p").alias("piece"))
    rows = rows.withColumn("m", F.when(F.col("pos") == F.min("pos").over(Window.partitionBy("id", "piece")), F.lit(0.0)).otherwise(F.col("m")))
    line = F.array_sort(F.collect_list(F.struct("pos", "lon", "lat", "ref")))
    pieces = rows.groupBy("id", "piece").agg(line.alias("line"), F.sum("m").alias("length"), F.first("tags").alias("tags")).where(F.size("line") > 1)
    u, v = F.col("line")[0]["ref"], F.element_at("line", -1)["ref"]
    keyed = pieces.withColumn("u", u).withColumn("v", v)
    pair = Window.partitionBy(F.least("u", "v"), F.greatest("u", "v")).orderBy("id", "piece")
    edges = keyed.select(
        F.monotonically_increasing_id().alias("edge_ord"), "u", "v", (F.row_number().over(pair) - 1).cast("int").alias("key"), "length", F.col("id").alias("osmid"),
        F.transform("line", lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))).alias("geometry"), F.transform_values("tags", lambda _, x: F.array(x)).alias("tags"),
    )
    used = edges.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    kept = nodes.join(used, "id", "left_semi").select(
        F.col("id").alias("node_id"), F.monotonically_increasing_id().alias("node_ord"), F.col("lon").alias("x"), F.col("lat").alias("y"), F.try_element_at("tags", F.lit("ele")).try_cast("double").alias("elevation")
    )
    return kept, edges


def read_zone(spark: SparkSession, path: str) -> list[list[list[float]]]:
    """Rings of a GeoJSON polygon: bare, as a feature, or as the only feature of a collection."""
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())  # one boundary
    j = json.loads(text)
    if j.get("type") == "FeatureCollection":
        if len(j.get("features", [])) != 1:
            raise ValueError("a zone is one feature")
        j = j["features"][0]
    j = j.get("geometry") if j.get("type") == "Feature" else j
    if not j or j.get("type") != "Polygon":
        raise ValueError("a zone is a polygon")
    return j["coordinates"]


def within(rows: DataFrame, rings: list, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """rows inside the polygon: crossings of a ray counted over all rings, as one expression."""
    x, y = F.col(lon), F.col(lat)
    crossings = F.lit(0)
    for ring in rings:
        for (x1, y1), (x2, y2) in zip([p[:2] for p in ring], [p[:2] for p in ring[1:]], strict=False):
            if y1 != y2:
                crossings = crossings + (((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < (y - y1) * ((x2 - x1) / (y2 - y1)) + x1)).cast("int")
    return rows.where(crossings % 2 == 1)


STORE = "walked map<string,struct<intervals:array<array<double>>,date:string,note:string,last_date:string>>, schema_version int, model string, inventory_fingerprint string"
IMPORT = (
    "date string, note string, matcher string, source string, raw_m double, assigned_m double, required_assigned_m double, raw_gap_m double, near_target_trace_m double, "
    "vehicle_m double, new_complete_m double, n_points int, n_unmatched int, n_skipped int, n_raw_gaps int, n_vehicle_fixes int"
)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """WALKED of a JSON store; records without intervals are wholly walked."""
    rows = spark.read.schema(STORE).json(path, multiLine=True).select(F.explode("walked").alias("coverage_id", "r"))
    spans = F.transform("r.intervals", lambda s: F.struct(s[0].alias("lo"), s[1].alias("hi")))
    whole = F.array(F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi")))
    return rows.select("coverage_id", F.coalesce(spans, whole).alias("intervals"), "r.date", "r.note", "r.last_date")


def read_imports(spark: SparkSession, path: str) -> DataFrame:
    """(digest, IMPORT) of a JSON store."""
    rows = spark.read.schema(f"imports map<string,struct<{', '.join(':'.join(x.split()) for x in IMPORT.split(', '))}>>").json(path, multiLine=True)
    return rows.select(F.explode("imports").alias("digest", "r")).select("digest", "r.*")


def read_route(spark: SparkSession, path: str) -> DataFrame:
    """(ord, u, v, key, deadhead) of a route file: an array of [u, v, key, deadhead]."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<array<string>>")).alias("ord", "s"))
    return rows.select("ord", F.col("s")[0].alias("u"), F.col("s")[1].alias("v"), F.col("s")[2].cast("int").alias("key"), F.col("s")[3].cast("boolean").alias("deadhead"))


def read_redactions(spark: SparkSession, path: str | None, flags: list[tuple[float, float, float | None]] = ()) -> list[tuple[float, float, float]]:
    """Circles to hide: a privacy file's and those given; the radius is 200 m where none is said."""
    zones = [(a, b, 200.0 if r is None else r) for a, b, r in flags]
    if path:
        rows = spark.read.schema("hide array<struct<lat:double,lon:double,radius_m:double,label:string>>").json(path, multiLine=True)
        zones = [(r.lat, r.lon, r.radius_m) for r in rows.select(F.explode("hide").alias("h")).select("h.lat", "h.lon", F.coalesce("h.radius_m", F.lit(200.0)).alias("radius_m")).collect()] + zones
    return zones


def read_elevations(spark: SparkSession, path: str) -> DataFrame:
    """(node_id, elevation) of a sidecar: one JSON object."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.explode(F.from_json("value", "map<string,double>")).alias("node_id", "elevation"))


def fetch_elevations(nodes: DataFrame, known: DataFrame, fetch: Callable[[list[tuple[float, float]]], list[float | None]], batch: int = 100, pause: float = 1.05) -> DataFrame:
    """(node_id, elevation) of nodes that aren't known, asked for in batches; no answer counts as 0.

    fetch gets (lat, lon) pairs. One partition, since the service takes about one request a second.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        first = True
        for pdf in parts:
            for at in range(0, len(pdf), batch):
                some = pdf.iloc[at : at + batch]
                if not first:
                    time.sleep(pause)
                first = False
                got = fetch(list(zip(some["y"], some["x"], strict=True)))
                yield pd.DataFrame({"node_id": some["node_id"].to_numpy(), "elevation": [0.0 if x is None else float(x) for x in got]})

    rows = nodes.join(known.select("node_id"), "node_id", "left_anti").where(F.col("x").isNotNull() & F.col("y").isNotNull())
    return rows.select("node_id", "y", "x").coalesce(1).mapInPandas(run, "node_id string, elevation double")


def read_official(spark: SparkSession, path: str, layers: list[str] | None = None) -> DataFrame:
    """(name, m) of an official centerline list: active rows of the layers, without tunnels (by type), on and off ramps, freeways and unnamed ones."""
    rows = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    name = official_name(F.concat_ws(" ", "street", F.coalesce(street_type(F.col("st_type")), F.lower("st_type"))))
    rows = rows.where(F.lower(F.trim("active")) == "true").withColumn("name", F.trim(name))
    if layers:
        rows = rows.where(F.upper(F.trim("layer")).isin(*[x.strip().upper() for x in layers]))
    rows = rows.where((F.col("name") != "") & ~F.coalesce(F.upper(F.trim("st_type")) == "TUNL", F.lit(False)) & ~F.col("name").rlike(r"^unnamed \d+$|^i-\d+\b| (on|off) ramp$"))
    pairs = F.transform(F.regexp_extract_all("line", F.lit(r"(-?[0-9.]+ -?[0-9.]+)"), F.lit(1)), lambda p: F.struct(F.split(p, " ")[0].cast("double").alias("lon"), F.split(p, " ")[1].cast("double").alias("lat")))
    legs = F.zip_with(F.slice("_p", 1, F.greatest(F.size("_p") - 1, F.lit(0))), F.slice("_p", 2, F.greatest(F.size("_p") - 1, F.lit(0))), _leg)
    return rows.withColumn("_p", pairs).withColumn("m", F.aggregate(legs, F.lit(0.0), lambda a, x: a + x)).groupBy("name").agg(F.sum("m").alias("m"))


def _leg(a, b):
    return planar_m(a["lat"], a["lon"], b["lat"], b["lon"])

