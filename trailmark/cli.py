"""Commands over a zone's folder: python -m trailmark.cli <verb> --zone DIR ...

A zone's folder holds `nodes` and `edges` (a prepared snapshot), `walked` and `imports` (Parquet).
"""

from __future__ import annotations

import argparse
import json
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.geo import planar_m
from .functions.intervals import fraction
from .functions.names import display_name, official_name
from .operators import inventory, matching, network, progress, routes, rules, tracks
from .operators.cues import cues, with_heights
from .plans.graphs import elevation_stats
from .plans.outings import edge_id, to_graph
from .plans.sweeps import plan
from .sources import gpx, networks, sinks

EMPTY = {"walked": "coverage_id string, intervals array<struct<lo:double,hi:double>>, date string, note string, last_date string", "imports": f"digest string, {networks.IMPORT}"}


class Zone:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, name: str):
        """(path of a table, its file system)."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def has(self, name: str) -> bool:
        """Whether there is a table; one that a broken off replacement left beside its place is put back first."""
        path, fs = self.path(name)
        old, _ = self.path(f"{name}.old")
        if not fs.exists(path) and fs.exists(old):
            fs.rename(old, path)
        return fs.exists(path)

    def table(self, name: str) -> DataFrame:
        if self.has(name):
            return self.spark.read.parquet(f"{self.folder}/{name}")
        return self.spark.createDataFrame([], EMPTY[name]) if name in EMPTY else self.spark.read.parquet(f"{self.folder}/{name}")

    def replace(self, name: str, df: DataFrame) -> None:
        """A table's new version: written beside the old one, then renamed. At each moment one whole version is there."""
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}.new")
        held = self.has(name)
        (path, fs), (old, _), (new, _) = self.path(name), self.path(f"{name}.old"), self.path(f"{name}.new")
        fs.delete(old, True)
        if held and not fs.rename(path, old) or not fs.rename(new, path):
            raise OSError(f"{path.toString()} can't be replaced")
        fs.delete(old, True)
        self.spark.catalog.refreshByPath(f"{self.folder}/{name}")

    def targets(self) -> DataFrame:
        """Required passages with their state."""
        e = self.table("edges").where("coverage_required").select("edge_ord", "coverage_id", F.col("coverage_name").alias("name"), "coverage_class", "length", "u")
        w = self.table("walked").select("coverage_id", fraction(F.col("intervals")).alias("frac"), "date", "note")
        return e.join(w, "coverage_id", "left")


def fetch(z: Zone, a) -> DataFrame:
    """A snapshot from a GraphML or OSM XML file, cut to a zone's polygon, prepared."""
    if a.source.endswith(".osm"):
        nodes, ways = networks.read_osm(z.spark, a.source)
        nodes, edges = networks.simplified(nodes, networks.wanted(ways))
    else:
        nodes, edges = networks.read_graphml(z.spark, a.source)
    if a.polygon:
        nodes = networks.within(nodes, networks.read_zone(z.spark, a.polygon), "x", "y")
        edges = edges.join(nodes.select(F.col("node_id").alias("u")), "u", "left_semi").join(nodes.select(F.col("node_id").alias("v")), "v", "left_semi")
    named, left = inventory.prepare(edges, nodes)
    sinks.write_snapshot(nodes, named, z.folder)
    left.write.mode("overwrite").parquet(f"{z.folder}/audit")
    return inventory.inventory_audit(z.table("edges"))


def status(z: Zone, a) -> DataFrame:
    """Completion, the number of days, the latest one, and whether most of what is walked isn't of this network."""
    days = log(z, a).orderBy("date").collect()  # a row a day
    last = days[-1] if days else None
    alien = progress.store_overlap(z.table("walked"), z.table("edges")).first().warn
    return progress.stats(z.targets()).withColumns({
        "days": F.lit(len(days)), "latest": F.lit(last.date if last else None).cast("string"), "latest_km": F.lit(last.km if last else None).cast("double"), "other_network": F.lit(alien),
    })


def audit(z: Zone, a) -> DataFrame:
    classes = z.targets().groupBy(F.concat(F.lit("class:"), "coverage_class").alias("what")).agg(F.count("*").alias("n"), F.sum("length").alias("m"))
    left = z.table("audit").select(F.concat(F.lit("excluded:"), "reason").alias("what"), F.col("edges").alias("n"), "m")
    e = z.table("edges")
    gaps = z.spark.createDataFrame([(f"tag not kept:{x}", 0, 0.0) for x in rules.tag_gaps(e, a.declared or [], rules.CRITICAL_TAGS)], "what string, n long, m double")
    islands = network.island_totals(e, network.components(e)).orderBy(F.desc("required_km")).limit(4)
    return classes.unionByName(left).unionByName(islands.select(F.concat(F.lit("island:"), "component").alias("what"), F.col("edges").alias("n"), (F.col("required_km") * 1000).alias("m"))).unionByName(gaps)


def remaining(z: Zone, a) -> DataFrame:
    return progress.remaining_by_name(z.targets()).orderBy(F.desc("left_m"), "name")


def log(z: Zone, a) -> DataFrame:
    return progress.diary(z.targets().where("frac is not null").withColumn("named", F.col("name") != "")).orderBy("date")


def elevation(z: Zone, a) -> DataFrame:
    nodes, missing = network.with_elevations(z.table("nodes"), networks.read_elevations(z.spark, a.source))
    z.replace("nodes", nodes)
    return z.table("nodes").agg(F.count("elevation").alias("known"), F.count_if(F.col("elevation").isNull()).alias("missing"), F.min("elevation").alias("min"), F.max("elevation").alias("max"))


def import_(z: Zone, a) -> DataFrame:
    """Match GPX files and add their spans; files known by digest are passed over, unless forced.

    Of files with the same contents the first by name counts.
    """
    known = z.table("imports")
    files = gpx.digests(z.spark, a.source).groupBy("digest").agg(F.min("walk_id").alias("walk_id"))
    fresh = files if a.force else files.join(known.select("digest"), "digest", "left_anti")
    fixes = gpx.read_fixes(z.spark, a.source).join(fresh, "walk_id", "left_semi")
    ridden = tracks.rides(tracks.steps(fixes)).groupBy("walk_id").agg(F.sum("ride_m").alias("vehicle_m"), F.sum(F.col("last_fix") - F.col("first_fix") - 1).cast("int").alias("n_vehicle_fixes"))
    found = network.kept(matching.match_tracks(tracks.without_rides(fixes), matching.network_rows(z.table("edges")), ["walk_id", "seg_ord", "piece"]), "matched")
    spans = found.where("coverage_id is not null").select("walk_id", "coverage_id", "lo", "hi")
    before = z.targets().where(progress.complete(F.col("frac"), F.col("length"))).agg(F.coalesce(F.sum("length"), F.lit(0.0))).first()[0]
    walked, _ = progress.recorded(z.table("walked"), spans, a.date, a.note)
    z.replace("walked", walked)
    after = z.targets().where(progress.complete(F.col("frac"), F.col("length"))).agg(F.coalesce(F.sum("length"), F.lit(0.0))).first()[0]
    m = matching.walk_metrics(found).join(ridden, "walk_id", "left").join(fresh, "walk_id")
    rows = m.select(
        "digest", F.lit(a.date).alias("date"), F.lit(a.note).alias("note"), F.lit("hmm").alias("matcher"), F.col("walk_id").alias("source"), "raw_m", F.col("matched_m").alias("assigned_m"),
        F.col("named_m").alias("required_assigned_m"), "raw_gap_m", "near_target_trace_m", F.coalesce("vehicle_m", F.lit(0.0)).alias("vehicle_m"), F.lit(max(0.0, after - before)).alias("new_complete_m"),
        *[F.col(c).cast("int").alias(c) for c in ("n_points", "n_unmatched", "n_skipped", "n_raw_gaps")], F.coalesce("n_vehicle_fixes", F.lit(0)).alias("n_vehicle_fixes"),
    )
    rows = network.kept(rows, "rows")  # the tables that they are made from are replaced
    z.replace("imports", known.join(rows.select("digest"), "digest", "left_anti").unionByName(rows))
    return rows


def rebuild(z: Zone, a) -> DataFrame:
    """A new store from the original files, each with the date in its name (else --date, else today) and its track's name as note.

    Days are added in order. A store that is there stays until all are done, and is replaced with --force only.
    """
    if not a.force and (z.has("walked") or z.has("imports")):
        raise SystemExit("there is a store already; --force replaces it")
    named = gpx.digests(z.spark, a.source).select("walk_id", gpx.date_in_name(F.col("walk_id")).alias("date"))
    files = named.join(gpx.track_names(z.spark, a.source), "walk_id", "left").collect()  # a row a file
    made = Zone(z.spark, f"{z.folder}/rebuilt")
    made.replace("edges", z.table("edges"))
    for name in EMPTY:
        made.replace(name, z.spark.createDataFrame([], EMPTY[name]))
    folder = a.source if len(files) > 1 or not a.source.endswith(".gpx") else a.source.rsplit("/", 1)[0]
    folder = folder.rsplit("/", 1)[0] if "*" in folder or folder.endswith(".gpx") else folder.rstrip("/")
    for f in sorted(files, key=lambda f: (f.date or a.date or date.today().isoformat(), f.walk_id)):
        one = {"source": f"{folder}/{f.walk_id}", "date": f.date or a.date or date.today().isoformat(), "note": f.name or f.walk_id.rsplit(".", 1)[0], "force": False}
        import_(made, argparse.Namespace(**vars(a) | one))
    for name in EMPTY:
        z.replace(name, made.table(name))
    path, fs = z.path("rebuilt")
    fs.delete(path, True)
    return z.table("imports")


def review(z: Zone, a) -> DataFrame:
    return routes.review_flags(z.table("imports")).orderBy("date", "source").select("date", "source", "raw_m", "near_target_trace_m", "assigned_m", "new_complete_m", "flags")


def done(z: Zone, a) -> DataFrame:
    """Mark a planned route; edges that the network doesn't have stop it."""
    route = networks.read_route(z.spark, a.source)
    e = z.table("edges").select(F.least("u", "v").alias("_a"), F.greatest("u", "v").alias("_b"), F.col("key").alias("_k"))
    lost = route.join(e, (F.least("u", "v") == F.col("_a")) & (F.greatest("u", "v") == F.col("_b")) & (F.col("key") == F.col("_k")), "left_anti").count()
    if lost:
        raise SystemExit(f"{lost} of the route's edges aren't in the network; nothing was changed")
    walked, gained = progress.recorded(z.table("walked"), progress.mark_route(route, z.table("edges")), a.date, a.note)
    gained = network.kept(gained, "gained")
    z.replace("walked", walked)
    return gained


def plan_(z: Zone, a) -> DataFrame:
    """Plan an outing and write its files: route, GPX with heights and cues, GeoJSON.

    It is planned on the start's piece of the network if work is left there, else on the piece with most left.
    """
    e, n = z.table("edges"), z.table("nodes")
    heights = n.select("node_id", "elevation")
    rows = e.join(heights.select(F.col("node_id").alias("u"), F.col("elevation").alias("zu")), "u").join(heights.select(F.col("node_id").alias("v"), F.col("elevation").alias("zv")), "v")
    cols = rows.select("edge_ord", "u", "v", "key", "length", "ulon", "ulat", "vlon", "vlat", "zu", "zv", display_name().alias("name"), F.try_element_at("tags", F.lit("highway"))[0].alias("highway"), F.col("coverage_required").alias("required"), "coverage_id")
    g = to_graph(cols.toPandas())  # one zone's streets
    walked = {r.coverage_id for r in z.targets().where(progress.complete(F.col("frac"), F.col("length"))).select("coverage_id").collect()}
    start = g.nearest(*a.start) if a.start else None
    g = g.with_work(lambda x: bool(x.data.get("required")) and edge_id(x) not in walked, start)
    start = start if start in g.nodes else g.nearest(*a.start) if a.start else None
    out = plan(g, edge_id, lambda x: x.data.get("required"), walked, start, a.km, a.style, a.axis, a.straight_km, a.loop)
    route = z.spark.createDataFrame([(i, str(u), str(v), k, d) for i, (u, v, k, d) in enumerate(out["route"])], "ord int, u string, v string, key int, deadhead boolean")
    sinks.replace_file(z.spark, f"{a.out}.route.json", sinks.route_json(route))
    legs = network.kept(steps(route, rows), "legs")
    sinks.replace_file(z.spark, f"{a.out}.gpx", sinks.gpx(track(legs), cues(legs), "plan"))
    sinks.replace_file(z.spark, f"{a.out}.geojson", sinks.geojson(legs, F.col("line"), ["name", "length", "deadhead"], "ord"))
    swirls = routes.straight_runs(legs).orderBy(F.desc("m"), "run").limit(3).collect() if a.style == "efficient" else []
    stats = {k: v for k, v in out.items() if k not in ("route", "endpoints")} | elevation_stats(g, out["route"]) | {"swirls": [[round(r.m), r.names] for r in swirls]}
    return z.spark.createDataFrame([(json.dumps(stats),)], "summary string")


def steps(route: DataFrame, rows: DataFrame) -> DataFrame:
    """The edges of a route (ord, u, v, key, deadhead), turned as they are walked: ends, line, heights, name."""
    line = inventory.line_of()
    e = rows.select("key", "length", display_name().alias("name"), *[F.col(c).alias(f"_{c}") for c in ("u", "v", "ulon", "ulat", "vlon", "vlat", "zu", "zv")], line.alias("_line"))
    a, b = F.least("u", "v"), F.greatest("u", "v")
    x = route.withColumns({"_a": a, "_b": b}).join(e.withColumns({"_a": F.least("_u", "_v"), "_b": F.greatest("_u", "_v")}), ["_a", "_b", "key"])
    ahead = F.col("u") == F.col("_u")
    pick = lambda p, q: F.when(ahead, F.col(p)).otherwise(F.col(q))
    # a line may be stored from either end: it begins at the one that is nearer to its first point
    first, gap = F.col("_line")[0], lambda p: planar_m(F.col("_line")[0]["lat"], F.col("_line")[0]["lon"], F.col(f"{p}lat"), F.col(f"{p}lon"))
    ends = x.select(
        F.lit("plan").alias("route_id"), "ord", "deadhead", "name", "length", "_line", pick("_ulat", "_vlat").alias("ulat"), pick("_ulon", "_vlon").alias("ulon"),
        pick("_vlat", "_ulat").alias("vlat"), pick("_vlon", "_ulon").alias("vlon"), pick("_zu", "_zv").alias("zu"), pick("_zv", "_zu").alias("zv"),
    )
    return ends.withColumn("line", F.when(first.isNull() | (gap("u") <= gap("v")), F.col("_line")).otherwise(F.reverse("_line"))).drop("_line")


def track(legs: DataFrame) -> DataFrame:
    """(ord, lat, lon, ele) of the points of a route's legs."""
    points = legs.select("ord", F.posexplode(with_heights(F.col("line"), F.col("zu"), F.col("zv"))).alias("_i", "p"))
    return points.select(F.struct("ord", "_i").alias("ord"), "p.lat", "p.lon", "p.ele")


def map_(z: Zone, a) -> DataFrame:
    seen = z.table("walked")
    sinks.replace_file(z.spark, f"{a.out}.geojson", sinks.progress_geojson(z.table("edges"), inventory.line_of(), seen))
    return seen.agg(F.count("*").alias("walked"))


def render(z: Zone, a) -> DataFrame:
    w = z.table("walked").select("coverage_id", "intervals", "note", F.lit(True).alias("seen"))
    rows = z.table("edges").where("coverage_required").join(w, "coverage_id", "left").withColumn("seen", F.coalesce("seen", F.lit(False)))
    zones = networks.read_redactions(z.spark, a.privacy)
    layers = routes.layer_status(rows, inventory.line_of(), zones)
    sinks.replace_file(z.spark, f"{a.out}.svg", sinks.svg(layers, inventory.line_of(), {}))
    return layers.groupBy("status").agg(F.count("*").alias("edges"))


def migrate(z: Zone, a) -> DataFrame:
    """Carry the evidence of an older snapshot over by name and place."""
    place = lambda folder: Zone(z.spark, folder).table("edges").where("coverage_required").select(F.col("coverage_id").alias("id"), F.col("edge_ord").alias("ord"), F.lower("coverage_name").alias("name"), ((F.col("ulat") + F.col("vlat")) / 2).alias("lat"), ((F.col("ulon") + F.col("vlon")) / 2).alias("lon"), "length")
    old = Zone(z.spark, a.source)
    held = old.table("walked")
    matches = network.kept(progress.rekey(place(a.source).join(held.select(F.col("coverage_id").alias("id")), "id", "left_semi"), place(z.folder)), "matches")
    moved = held.join(matches, held["coverage_id"] == matches["old_id"]).where("new_id is not null").select(F.col("new_id").alias("coverage_id"), "intervals", "date", "note", "last_date", F.col("old_id").alias("ord"))
    merged = progress.combined(moved, "coverage_id").withColumn("last_date", F.lit(None).cast("string"))
    z.replace("walked", merged)
    return progress.migration(matches)


def total(z: Zone, a) -> DataFrame:
    zones = [Zone(z.spark, f) for f in [z.folder, *(a.more or [])]]
    parts = []
    for i, x in enumerate(zones):
        e = x.table("edges").select("coverage_id", ((F.col("ulat") + F.col("vlat")) / 2).alias("lat"), ((F.col("ulon") + F.col("vlon")) / 2).alias("lon"), F.col("coverage_required").alias("_r")).where("_r").drop("_r")
        parts.append(x.targets().join(e, "coverage_id").select(F.lit(i).alias("area_ord"), "edge_ord", F.lower("name").alias("name"), "lat", "lon", "length", F.coalesce("frac", F.lit(0.0)).alias("frac")))
    return progress.stats(progress.across_areas(reduce(DataFrame.unionByName, parts)))


def crosscheck(z: Zone, a) -> DataFrame:
    mine = z.targets().groupBy(official_name(F.col("name")).alias("name")).agg(F.sum("length").alias("m"))
    return routes.cross_check(networks.read_official(z.spark, a.source, a.layers), mine).where("verdict <> 'matched'").orderBy(F.desc("official_m"))


VERBS = {
    "fetch": fetch, "status": status, "audit": audit, "plan": plan_, "elevation": elevation, "done": done, "import": import_, "rebuild": rebuild, "review": review, "map": map_, "render": render,
    "log": log, "remaining": remaining, "migrate": migrate, "total": total, "crosscheck": crosscheck,
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="trailmark", description=__doc__)
    p.add_argument("verb", choices=VERBS)
    p.add_argument("--zone", required=True, help="the zone's folder")
    p.add_argument("--source", help="file or files to read")
    p.add_argument("--polygon")
    p.add_argument("--out", default="out")
    p.add_argument("--date")
    p.add_argument("--note")
    p.add_argument("--force", action="store_true")
    p.add_argument("--style", choices=("snake", "efficient"), default="snake")
    p.add_argument("--axis", choices=("ns", "ew"), default="ns")
    p.add_argument("--km", type=float, default=8.0)
    p.add_argument("--straight-km", type=float, default=1.4)
    p.add_argument("--loop", action="store_true")
    p.add_argument("--start", type=lambda s: tuple(map(float, s.split(","))), help="lat,lon")
    p.add_argument("--privacy")
    p.add_argument("--layers", nargs="*", default=["STREETS"])
    p.add_argument("--declared", nargs="*", help="tags that the snapshot was made to keep")
    p.add_argument("--more", nargs="*", help="further zones' folders")
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("trailmark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    VERBS[a.verb](Zone(spark, a.zone), a).show(200, truncate=False)


if __name__ == "__main__":
    main()


