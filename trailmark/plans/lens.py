"""Street networks, evidence and tracks made from the driver's star-schema tables, in Spark and in SQL.

The tables hold no streets, so every query starts from the same deterministic lens: parts are the
nodes of a grid 40 wide, line items are spans walked on them, events are fixes of walks. The SQL
texts say the same for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.rules import with_ends

ZONES = ((0.010, 0.010, 300.0), (0.003, 0.030, 450.0))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(
        k.cast("string").alias("node_id"), k.alias("node_ord"), ((k % 40).cast("double") * 0.001).alias("x"), (F.floor(k / 40).cast("double") * 0.001).alias("y"),
        F.col("p_size").cast("double").alias("elevation"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid's edges with tags by the size and type of the part that they start from."""
    part = read(spark, sf_dir, "part").select("p_partkey", "p_size", "p_type")
    n = part.agg(F.count("*").alias("n"))
    k, s = F.col("p_partkey"), F.col("p_size")
    row = F.floor(k / 40).cast("long")
    east = F.struct((k * 2).alias("edge_ord"), k.alias("a"), (k + 1).alias("b"), F.concat(F.lit("row"), row.cast("string")).alias("base"))
    north = F.struct((k * 2 + 1).alias("edge_ord"), k.alias("a"), (k + 40).alias("b"), F.concat(F.lit("col"), (k % 40).cast("string")).alias("base"))
    both = part.join(F.broadcast(n)).select("p_size", "p_type", "n", F.explode(F.array(east, north)).alias("e")).select("p_size", "p_type", "n", "e.*")
    rows = both.where((F.col("b") < F.col("n")) & ((F.col("edge_ord") % 2 == 1) | (F.col("a") % 40 < 39)))
    one = lambda c, v: F.when(c, F.array(F.lit(v)))
    t = F.col("p_type")
    kinds = {"STANDARD": "residential", "MEDIUM": "tertiary", "PROMO": "path", "LARGE": "steps", "SMALL": "service", "ECONOMY": "footway"}
    highway: Column = F.when(s == 43, F.lit("motorway"))
    for p, h in kinds.items():
        highway = highway.when(t == p, F.lit(h))
    tags = F.create_map(
        F.lit("highway"), F.array(highway),
        F.lit("name"), F.when(s % 7 != 0, F.array("base")),
        F.lit("service"), F.when(t == "SMALL", F.when(s % 3 == 0, F.array(F.lit("driveway"))).when(s % 3 == 1, F.array(F.lit("alley")))),
        F.lit("access"), one(s % 11 == 0, "private"),
        F.lit("foot"), F.when(s % 22 == 0, F.array(F.lit("yes"))).when(s % 13 == 0, F.array(F.lit("no"))),
        F.lit("amenity"), one(s == 17, "parking"), F.lit("area"), one(s == 23, "yes"), F.lit("man_made"), one((s == 23) & (F.col("a") % 2 == 1), "pier"),
        F.lit("indoor"), one(s == 29, "yes"), F.lit("tunnel"), one(s == 31, "building_passage"), F.lit("sidewalk"), one(s == 37, "separate"), F.lit("railway"), one(s == 41, "platform"),
    )
    return rows.select(
        "edge_ord", F.col("a").cast("string").alias("u"), F.col("b").cast("string").alias("v"), F.lit(0).alias("key"), (F.lit(20.0) + s * 5).alias("length"),
        F.col("a").cast("string").alias("osmid"), F.lit(None).cast("array<struct<lon:double,lat:double>>").alias("geometry"), F.map_filter(tags, lambda _, v: v.isNotNull()).alias("tags"),
    )


NET = """
nodes AS (
  SELECT p_partkey AS node_id, CAST(p_partkey % 40 AS DOUBLE) * 0.001 AS x, CAST(p_partkey // 40 AS DOUBLE) * 0.001 AS y, CAST(p_size AS DOUBLE) AS elevation FROM part),
both_ways AS (
  SELECT p_partkey * 2 AS edge_ord, p_partkey AS u, p_partkey + 1 AS v, 'row' || CAST(p_partkey // 40 AS VARCHAR) AS base, p_size AS s, p_type AS t FROM part WHERE p_partkey % 40 < 39
  UNION ALL
  SELECT p_partkey * 2 + 1, p_partkey, p_partkey + 40, 'col' || CAST(p_partkey % 40 AS VARCHAR), p_size, p_type FROM part),
edges AS (
  SELECT edge_ord, u, v, 20.0::DOUBLE + s * 5 AS length, CASE WHEN s % 7 <> 0 THEN base END AS name,
    CASE WHEN s = 43 THEN 'motorway' WHEN t = 'STANDARD' THEN 'residential' WHEN t = 'MEDIUM' THEN 'tertiary' WHEN t = 'PROMO' THEN 'path'
      WHEN t = 'LARGE' THEN 'steps' WHEN t = 'SMALL' THEN 'service' WHEN t = 'ECONOMY' THEN 'footway' END AS highway,
    CASE WHEN t = 'SMALL' AND s % 3 = 0 THEN 'driveway' WHEN t = 'SMALL' AND s % 3 = 1 THEN 'alley' END AS service,
    CASE WHEN s % 11 = 0 THEN 'private' END AS access, CASE WHEN s % 22 = 0 THEN 'yes' WHEN s % 13 = 0 THEN 'no' END AS foot,
    CASE WHEN s = 17 THEN 'parking' END AS amenity, CASE WHEN s = 23 THEN 'yes' END AS area, CASE WHEN s = 23 AND u % 2 = 1 THEN 'pier' END AS man_made,
    CASE WHEN s = 29 THEN 'yes' END AS indoor, CASE WHEN s = 31 THEN 'building_passage' END AS tunnel, CASE WHEN s = 37 THEN 'separate' END AS sidewalk,
    CASE WHEN s = 41 THEN 'platform' END AS railway
  FROM both_ways WHERE v < (SELECT count(*) FROM part)),
placed AS (
  SELECT e.*, a.x AS ulon, a.y AS ulat, b.x AS vlon, b.y AS vlat, a.elevation AS zu, b.elevation AS zv
  FROM edges e JOIN nodes a ON a.node_id = e.u JOIN nodes b ON b.node_id = e.v),
reasoned AS (
  SELECT *, coalesce(CASE
    WHEN service IN ('driveway', 'parking_aisle', 'drive-through', 'drive_through') THEN 'parking_or_driveway'
    WHEN highway IN ('bus_stop', 'motorway', 'motorway_link', 'raceway', 'busway', 'bus_guideway') THEN 'non_pedestrian_highway'
    WHEN railway = 'platform' THEN 'transit_platform'
    WHEN access IN ('private', 'no', 'customers', 'emergency', 'permit') AND coalesce(foot, '') NOT IN ('yes', 'designated', 'permissive', 'official') THEN 'restricted_access'
    WHEN amenity = 'parking' THEN 'parking_facility' WHEN indoor IN ('yes', 'room', 'corridor') THEN 'indoor'
    WHEN tunnel = 'building_passage' THEN 'building_passage' WHEN area IN ('yes', '1', 'true') AND man_made IS NULL THEN 'non_linear_area' END,
    CASE WHEN sqrt(power(((ulon + vlon) / 2 - 0.010) * 111320.0 * cos(radians(0.010)), 2) + power(((ulat + vlat) / 2 - 0.010) * 110540.0, 2)) <= 300.0
           OR sqrt(power(((ulon + vlon) / 2 - 0.030) * 111320.0 * cos(radians(0.003)), 2) + power(((ulat + vlat) / 2 - 0.003) * 110540.0, 2)) <= 450.0 THEN 'out_of_scope' END) AS reason,
    CASE WHEN man_made = 'pier' THEN 'pier' WHEN highway = 'steps' THEN 'staircase' WHEN service = 'alley' THEN 'alley'
         WHEN highway IN ('path', 'footway', 'pedestrian', 'bridleway', 'track', 'cycleway') THEN 'trail' ELSE 'street' END AS cls
  FROM placed)
"""


def surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The named edges and, beside every second one, a parallel copy 6 to 95 m away: (as edges, with ends); copies have odd edge_ord."""
    base = edges(spark, sf_dir)
    n = nodes(spark, sf_dir)
    rows = with_ends(base, n).where(F.try_element_at("tags", F.lit("name")).isNotNull())
    k = F.col("u").cast("long")
    off = (F.lit(6.0) + (k % 30) * 3.0) / 110540.0
    fixed = rows.where((k % 2) == 0).withColumn("_north", F.col("edge_ord") % 2 == 1).withColumn("edge_ord", F.col("edge_ord") * 2 + 1)
    for c in ("ulon", "vlon"):
        fixed = fixed.withColumn(c, F.when(F.col("_north"), F.col(c) + off).otherwise(F.col(c)))
    for c in ("ulat", "vlat"):
        fixed = fixed.withColumn(c, F.when(F.col("_north"), F.col(c)).otherwise(F.col(c) + off))
    return rows.withColumn("edge_ord", F.col("edge_ord") * 2).unionByName(fixed.drop("_north"))


SURFACES = NET + """,
surfaces AS (
  SELECT edge_ord * 2 AS edge_ord, u, v, length, name, highway, service, cls, foot, ulon, ulat, vlon, vlat FROM reasoned WHERE name IS NOT NULL
  UNION ALL
  SELECT edge_ord * 2 + 1, u, v, length, name, highway, service, cls, foot,
    ulon + CASE WHEN edge_ord % 2 = 1 THEN (6.0::DOUBLE + (u % 30) * 3.0::DOUBLE) / 110540.0::DOUBLE ELSE 0 END,
    ulat + CASE WHEN edge_ord % 2 = 0 THEN (6.0::DOUBLE + (u % 30) * 3.0::DOUBLE) / 110540.0::DOUBLE ELSE 0 END,
    vlon + CASE WHEN edge_ord % 2 = 1 THEN (6.0::DOUBLE + (u % 30) * 3.0::DOUBLE) / 110540.0::DOUBLE ELSE 0 END,
    vlat + CASE WHEN edge_ord % 2 = 0 THEN (6.0::DOUBLE + (u % 30) * 3.0::DOUBLE) / 110540.0::DOUBLE ELSE 0 END
  FROM reasoned WHERE name IS NOT NULL AND u % 2 = 0),
feats AS (
  SELECT *, (ulat + vlat) / 2 AS lat0, (ulat + vlat) / 2 AS mlat, (ulon + vlon) / 2 AS mlon FROM surfaces),
frames AS (
  SELECT a.name, a.edge_ord AS a, b.edge_ord AS b, a.cls AS ca, b.cls AS cb, a.length AS la, b.length AS lb, a.u AS au, b.u AS bu,
    (a.vlon - a.ulon) * 111320.0 * cos(radians(a.lat0)) AS ax, (a.vlat - a.ulat) * 110540.0 AS ay,
    (b.vlon - b.ulon) * 111320.0 * cos(radians(a.lat0)) AS bx, (b.vlat - b.ulat) * 110540.0 AS by_,
    (b.mlon - a.mlon) * 111320.0 * cos(radians(a.lat0)) AS mx, (b.mlat - a.mlat) * 110540.0 AS my,
    (b.ulon - a.ulon) * 111320.0 * cos(radians(a.lat0)) AS uux, (b.ulat - a.ulat) * 110540.0 AS uuy,
    (b.vlon - a.vlon) * 111320.0 * cos(radians(a.lat0)) AS vvx, (b.vlat - a.vlat) * 110540.0 AS vvy,
    (b.vlon - a.ulon) * 111320.0 * cos(radians(a.lat0)) AS uvx, (b.vlat - a.ulat) * 110540.0 AS uvy,
    (b.ulon - a.vlon) * 111320.0 * cos(radians(a.lat0)) AS vux, (b.ulat - a.vlat) * 110540.0 AS vuy
  FROM feats a JOIN feats b ON a.name = b.name AND a.edge_ord < b.edge_ord),
measured AS (
  SELECT *, sqrt(ax * ax + ay * ay) AS na, sqrt(bx * bx + by_ * by_) AS nb FROM frames),
metrics AS (
  SELECT *, (ax * bx + ay * by_) / (na * nb) AS dot, abs((mx * ax + my * ay) / na) AS along, abs((mx * ay - my * ax) / na) AS perp,
    CASE WHEN ax * bx + ay * by_ >= 0 THEN greatest(sqrt(uux * uux + uuy * uuy), sqrt(vvx * vvx + vvy * vvy))
         ELSE greatest(sqrt(uvx * uvx + uvy * uvy), sqrt(vux * vux + vuy * vuy)) END AS ends,
    CASE WHEN (ca = 'street' AND cb = 'trail') OR (ca = 'trail' AND cb = 'street') THEN 24.0 WHEN ca = 'street' AND cb = 'street' THEN 45.0 ELSE 32.0 END AS lim
  FROM measured WHERE na >= 0.5 AND nb >= 0.5),
pairs AS (
  SELECT name, a, b FROM metrics
  WHERE (ca = cb OR lim = 24.0) AND abs(dot) >= 0.9271838545667874 AND la / lb BETWEEN 0.60 AND 1.67 AND ends <= lim
    AND along <= greatest(6.0, 0.20 * least(la, lb)) AND perp <= lim)
"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence: (target, lo, hi, day, note)."""
    lo = (F.col("l_quantity") - 1) / 50
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("target"), lo.alias("lo"), F.least(F.lit(1.0), lo + F.col("l_tax") + 0.02).alias("hi"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"), F.col("l_returnflag").alias("note"),
    )


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(target, name, length): parts as coverage targets, named by brand."""
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("target"), F.col("p_brand").alias("name"), (F.lit(20.0) + F.col("p_size") * 5).alias("length"))


EVIDENCE = """
spans AS (
  SELECT l_partkey AS target, (l_quantity - 1) / 50 AS lo, least(1.0::DOUBLE, (l_quantity - 1) / 50 + l_tax + 0.02::DOUBLE) AS hi,
         strftime(l_shipdate, '%Y-%m-%d') AS day, l_returnflag AS note FROM lineitem),
targets AS (SELECT p_partkey AS target, p_brand AS name, 20.0::DOUBLE + p_size * 5 AS length FROM part),
distinct_spans AS (SELECT DISTINCT target, least(lo, hi) AS lo, greatest(lo, hi) AS hi FROM spans),
topped AS (
  SELECT *, max(hi) OVER (PARTITION BY target ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM distinct_spans),
marked AS (
  SELECT *, sum(CASE WHEN top IS NULL OR lo > top + 1e-9 THEN 1 ELSE 0 END) OVER (PARTITION BY target ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM topped),
islands AS (SELECT target, min(lo) AS lo, max(hi) AS hi FROM marked GROUP BY target, island),
covered AS (SELECT target, count(*) AS n_islands, least(1.0::DOUBLE, sum(hi - lo)) AS frac FROM islands GROUP BY target),
state AS (
  SELECT t.*, c.n_islands, c.frac, coalesce(round(c.frac, 9) >= round(greatest(0.5::DOUBLE, 1.0::DOUBLE - 15.0::DOUBLE / greatest(length, 1.0::DOUBLE)), 9), false) AS done
  FROM targets t LEFT JOIN covered c ON c.target = t.target)
"""


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walks: a fix each event, every 5 s and 8 m northward; errors step 3 m, fixes 10 to 14 of 25 ride 100 m; every 40th jumps 400 m."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = read(spark, sf_dir, "events").select("user_id", "event_type", F.row_number().over(w).cast("int").alias("fix_ord"))
    n = F.col("fix_ord")
    step = F.when((n % 25 >= 10) & (n % 25 <= 14), 100).when(n % 40 == 0, 400).when(F.col("event_type") == "error", 3).otherwise(8)
    at = F.sum(step).over(Window.partitionBy("user_id").orderBy("fix_ord").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_at", at).select(
        F.col("user_id").cast("string").alias("walk_id"), F.lit(0).alias("seg_ord"), "fix_ord", (F.col("_at") / F.lit(110540.0)).alias("lat"), F.lit(0.0).alias("lon"),
        (n * 5).cast("double").alias("ts"),
    )


TRACK = """
numbered AS (SELECT user_id, event_type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS n FROM events),
stepped AS (
  SELECT user_id, n, CASE WHEN n % 25 >= 10 AND n % 25 <= 14 THEN 100 WHEN n % 40 = 0 THEN 400 WHEN event_type = 'error' THEN 3 ELSE 8 END AS st FROM numbered),
summed AS (SELECT user_id, n, sum(st) OVER (PARTITION BY user_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS pos FROM stepped),
fixes AS (SELECT CAST(user_id AS VARCHAR) AS walk_id, 0 AS seg_ord, n AS fix_ord, CAST(pos AS DOUBLE) / 110540.0::DOUBLE AS lat, CAST(n * 5 AS DOUBLE) AS ts FROM summed),
steps AS (
  SELECT *, (lead(lat) OVER w - lat) * 110540.0::DOUBLE AS step_m, lead(ts) OVER w - ts AS step_s FROM fixes WINDOW w AS (PARTITION BY walk_id, seg_ord ORDER BY fix_ord)),
fast AS (
  SELECT *, fix_ord - row_number() OVER (PARTITION BY walk_id, seg_ord ORDER BY fix_ord) AS island FROM steps
  WHERE coalesce(step_s > 0 AND step_m < 2000 AND step_m * 3.6 > 13.0 * step_s, false)),
rides AS (
  SELECT walk_id, seg_ord, min(fix_ord) AS first_fix, max(fix_ord) + 1 AS last_fix, count(*) AS n_steps, sum(step_m) AS ride_m
  FROM fast GROUP BY walk_id, seg_ord, island HAVING count(*) >= 3 AND sum(step_m) >= 150),
kept AS (
  SELECT f.*, CASE WHEN r.last_fix IS NOT NULL THEN 1 ELSE 0 END AS cut
  FROM fixes f LEFT JOIN rides r ON r.walk_id = f.walk_id AND r.seg_ord = f.seg_ord AND r.last_fix = f.fix_ord
  WHERE NOT EXISTS (SELECT 1 FROM rides q WHERE q.walk_id = f.walk_id AND q.seg_ord = f.seg_ord AND f.fix_ord > q.first_fix AND f.fix_ord < q.last_fix)),
pieces AS (SELECT *, sum(cut) OVER (PARTITION BY walk_id, seg_ord ORDER BY fix_ord ROWS UNBOUNDED PRECEDING) AS piece FROM kept),
walkable AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY walk_id, seg_ord, piece) AS size FROM pieces) WHERE size >= 2)
"""


def route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walks over the grid: from each node (route) whose steps stay on it, a fixed pattern of 12 steps east and north, as route rows with ends."""
    part = read(spark, sf_dir, "part")
    n = part.agg(F.count("*").alias("n"))
    # 8 steps east and 4 north
    start = part.where("p_partkey % 40 + 8 < 40").select(F.col("p_partkey").alias("k0")).join(F.broadcast(n)).where("k0 + 8 + 4 * 40 < n")
    i = F.col("i")
    # of three steps the third goes north
    east = lambda x: x - F.floor(x / 3).cast("long")
    rows = start.select("k0", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("i")).withColumn("i", i.cast("long"))
    a = F.col("k0") + east(i) + F.floor(i / 3).cast("long") * 40
    b = F.col("k0") + east(i + 1) + F.floor((i + 1) / 3).cast("long") * 40
    return rows.select(F.col("k0").alias("route_id"), i.alias("ord"), a.alias("a"), b.alias("b"), (i % 4 == 3).alias("deadhead"))


ROUTE = """
grid AS (SELECT p_partkey AS k, CAST(p_partkey % 40 AS DOUBLE) * 0.001 AS x, CAST(p_partkey // 40 AS DOUBLE) * 0.001 AS y, p_size FROM part),
walks AS (
  SELECT p_partkey AS route_id, i AS ord, p_partkey + (i - i // 3) + (i // 3) * 40 AS a, p_partkey + (i + 1 - (i + 1) // 3) + ((i + 1) // 3) * 40 AS b, i % 4 = 3 AS deadhead
  FROM part, range(0, 12) AS r(i) WHERE p_partkey % 97 = 0 AND p_partkey % 40 < 30 AND p_partkey + 250 < (SELECT count(*) FROM part)),
legs AS (
  SELECT w.*, f.x AS ulon, f.y AS ulat, t.x AS vlon, t.y AS vlat, CAST(f.p_size AS DOUBLE) AS zu, CAST(t.p_size AS DOUBLE) AS zv, 20.0::DOUBLE + f.p_size * 5 AS length,
    CASE WHEN b = a + 40 THEN 'col' || CAST(a % 40 AS VARCHAR) ELSE 'row' || CAST(a // 40 AS VARCHAR) END AS name
  FROM walks w JOIN grid f ON f.k = w.a JOIN grid t ON t.k = w.b),
headed AS (
  SELECT *, ((degrees(atan2((vlon - ulon) * cos(radians((ulat + vlat) / 2)), vlat - ulat)) % 360) + 360) % 360 AS bearing FROM legs),
turned AS (
  SELECT *, ((((lead(bearing) OVER w - bearing + 180) % 360) + 360) % 360) - 180 AS angle, lead(name) OVER w AS onto FROM headed WINDOW w AS (PARTITION BY route_id ORDER BY ord))
"""


def legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """route with ends, elevations, lengths and names."""
    n = nodes(spark, sf_dir).select(F.col("node_ord").alias("k"), "x", "y", F.col("elevation").alias("z"))
    a = n.select(F.col("k").alias("a"), F.col("x").alias("ulon"), F.col("y").alias("ulat"), F.col("z").alias("zu"))
    b = n.select(F.col("k").alias("b"), F.col("x").alias("vlon"), F.col("y").alias("vlat"), F.col("z").alias("zv"))
    rows = route(spark, sf_dir).join(a, "a").join(b, "b")
    name = F.when(F.col("b") == F.col("a") + 40, F.concat(F.lit("col"), (F.col("a") % 40).cast("string"))).otherwise(F.concat(F.lit("row"), F.floor(F.col("a") / 40).cast("string")))
    return rows.withColumn("name", name).withColumn("length", F.lit(20.0) + F.col("zu") * 5)
