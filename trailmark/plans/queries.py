"""The driver's queries over the lens, each with its SQL. Floats are rounded in both, as sums may run in another order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import planar_m
from ..functions.intervals import covered, islands, needed
from ..functions.names import display_name, normalized_name, official_name
from ..operators import cues, inventory, matching, network, progress, routes, rules, tracks
from . import lens as L
from . import outings

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r(c: str, n: int = 3):
    return F.round(c, n).alias(c)


def _reasoned(spark: SparkSession, sf: str) -> DataFrame:
    return rules.public_network(L.edges(spark, sf), L.nodes(spark, sf), L.ZONES)


# ---- rules -------------------------------------------------------------------------------------


@query(f"WITH {L.NET} SELECT reason, count(*) AS edges, round(sum(length), 3) AS m FROM reasoned WHERE reason IS NOT NULL GROUP BY reason")
def exclusion_audit(spark, sf):
    return rules.audit(_reasoned(spark, sf)).select("reason", "edges", r("m"))


@query(f"WITH {L.NET} SELECT cls, count(*) AS edges, round(sum(length) / 1000, 6) AS km FROM reasoned WHERE reason IS NULL AND name IS NOT NULL GROUP BY cls")
def passage_class_hist(spark, sf):
    rows = _reasoned(spark, sf).where("reason is null").where(display_name() != "")
    return rows.groupBy(rules.passage_class().alias("cls")).agg(F.count("*").alias("edges"), F.round(F.sum("length") / 1000, 6).alias("km"))


@query(
    f"""WITH {L.NET} SELECT edge_ord, reason IS NULL AND name IS NOT NULL AS eligible, coalesce(foot IN ('no', 'use_sidepath'), false) OR coalesce(sidewalk = 'separate', false) AS restricted,
    coalesce(name, '') <> '' AND coalesce(highway, '') <> 'bus_stop' AS required, cls FROM reasoned WHERE reason IS NULL"""
)
def routing_network(spark, sf):
    rows = _reasoned(spark, sf).where("reason is null")
    return rows.select(
        "edge_ord", rules.is_eligible().alias("eligible"), rules.foot_restricted().alias("restricted"), rules.is_required().alias("required"), rules.passage_class().alias("cls")
    )


@query(f"WITH {L.NET} SELECT n.node_id FROM nodes n WHERE EXISTS (SELECT 1 FROM reasoned e WHERE reason IS NULL AND (e.u = n.node_id OR e.v = n.node_id))")
def connected_nodes(spark, sf):
    live = _reasoned(spark, sf).where("reason is null").select(F.explode(F.array("u", "v")).alias("node_id"))
    return L.nodes(spark, sf).join(live, "node_id", "left_semi").select(F.col("node_id").cast("long").alias("node_id"))


@query(f"WITH {L.NET} SELECT edge_ord FROM reasoned WHERE reason = 'out_of_scope'")
def out_of_scope_filter(spark, sf):
    return _reasoned(spark, sf).where("reason = 'out_of_scope'").select("edge_ord")


@query(f"WITH {L.NET} SELECT count(*) AS edges FROM edges WHERE service IS NULL OR service NOT IN ('driveway', 'parking_aisle', 'drive-through', 'drive_through')")
def drop_driveways(spark, sf):
    return rules.without_driveways(L.edges(spark, sf)).agg(F.count("*").alias("edges"))


# ---- evidence and progress ---------------------------------------------------------------------


def _state(spark: SparkSession, sf: str) -> DataFrame:
    return L.targets(spark, sf).join(covered(L.spans(spark, sf), ["target"]), "target", "left")


@query(f"WITH {L.EVIDENCE} SELECT target, round(lo, 9) AS lo, round(hi, 9) AS hi FROM islands")
def interval_union(spark, sf):
    return islands(L.spans(spark, sf), ["target"]).select("target", r("lo", 9), r("hi", 9))


@query(f"WITH {L.EVIDENCE} SELECT target, n_islands, round(frac, 9) AS frac FROM covered")
def coverage_frac(spark, sf):
    return covered(L.spans(spark, sf), ["target"]).select("target", "n_islands", r("frac", 9))


@query(f"WITH {L.EVIDENCE} SELECT target FROM state WHERE done")
def completed_ids(spark, sf):
    return _state(spark, sf).where(progress.complete9(F.col("frac"), F.col("length"))).select("target")


@query(
    f"""WITH {L.EVIDENCE} SELECT name, count(*) AS targets, CAST(sum(done::INT) AS BIGINT) AS complete, round(sum(length), 3) AS length_m,
    round(sum(length * coalesce(frac, 0)), 3) AS covered_m FROM state GROUP BY name"""
)
def progress_by_name(spark, sf):
    return progress.by_name(_state(spark, sf)).select("name", "targets", "complete", r("length_m"), r("covered_m"))


@query(
    f"""WITH {L.EVIDENCE} SELECT count(*) AS n_required, CAST(sum(done::INT) AS BIGINT) AS n_complete, CAST(sum((NOT done AND coalesce(frac, 0) > 0)::INT) AS BIGINT) AS n_partial,
    round(sum(length) / 1000, 6) AS total_km, round(sum(CASE WHEN done THEN length ELSE 0 END) / 1000, 6) AS walked_km, round(sum(length * coalesce(frac, 0)) / 1000, 6) AS covered_km,
    round(100 * sum(CASE WHEN done THEN length ELSE 0 END) / sum(length), 6) AS pct_done, round(100 * sum(length * coalesce(frac, 0)) / sum(length), 6) AS observed_pct FROM state"""
)
def progress_stats(spark, sf):
    s = progress.stats(_state(spark, sf))
    return s.select("n_required", "n_complete", "n_partial", *[r(c, 6) for c in ("total_km", "walked_km", "covered_km", "pct_done", "observed_pct")])


@query(f'WITH {L.EVIDENCE} SELECT name, count(*) AS "left", round(sum(length), 3) AS left_m FROM state WHERE NOT done GROUP BY name')
def remaining_ways(spark, sf):
    return progress.remaining_by_name(_state(spark, sf)).select("name", "left", r("left_m"))


@query(f"WITH {L.EVIDENCE} SELECT target FROM state WHERE NOT done")
def remaining_network(spark, sf):
    s = _state(spark, sf).select(F.col("target").alias("coverage_id"), F.lit(True).alias("coverage_required"), "length", "frac")
    return progress.remaining_edges(s, s.where(progress.complete9(F.col("frac"), F.col("length")))).select(F.col("coverage_id").alias("target"))


_RECORDS = """,
firsts AS (SELECT target, min({'d': day, 'n': note}) AS f FROM spans GROUP BY target),
records AS (SELECT f.target, f.f.d AS day, f.f.n AS note, s.length, s.frac, s.name FROM firsts f JOIN state s ON s.target = f.target)
"""


def _records(spark: SparkSession, sf: str) -> DataFrame:
    first = L.spans(spark, sf).groupBy("target").agg(F.min(F.struct("day", "note")).alias("f"))
    rows = first.join(_state(spark, sf), "target")
    return rows.select("target", F.col("f.day").alias("date"), F.col("f.note").alias("note"), "length", "frac", (F.col("name") < "Brand#2").alias("named"))


@query(
    f"""WITH {L.EVIDENCE} {_RECORDS} SELECT day AS date, round(sum(length * frac) / 1000, 6) AS km,
    round(sum(CASE WHEN name < 'Brand#2' THEN length * frac ELSE 0 END) / 1000, 6) AS named_km, count(*) AS edges FROM records GROUP BY day"""
)
def walk_diary(spark, sf):
    return progress.diary(_records(spark, sf)).select("date", r("km", 6), r("named_km", 6), "edges")


@query(f"WITH {L.EVIDENCE} {_RECORDS} SELECT day AS date, note, round(sum(length * frac) / 1000, 6) AS km FROM records GROUP BY day, note")
def diary_notes(spark, sf):
    return progress.diary_notes(_records(spark, sf)).select("date", "note", r("km", 6))


@query(
    f"""WITH {L.EVIDENCE}, f AS (SELECT note, min(day) AS first_date FROM spans GROUP BY note)
    SELECT note, first_date, (row_number() OVER (ORDER BY first_date, note) - 1) % 10 AS colour FROM f"""
)
def note_palette(spark, sf):
    rows = progress.note_order(L.spans(spark, sf).withColumnRenamed("day", "date"))
    return rows.select("note", "first_date", F.col("colour").cast("long").alias("colour"))


@query(
    f"""WITH {L.EVIDENCE}, n AS (SELECT target, len(list(lo)) AS k FROM islands GROUP BY target), f AS (SELECT target, min({{'d': day, 'n': note}}) AS f FROM spans GROUP BY target)
    SELECT f.target, f.f.d AS date, f.f.n AS note, n.k AS n_islands, round(c.frac, 9) AS frac FROM f JOIN n ON n.target = f.target JOIN covered c ON c.target = f.target"""
)
def combined_record(spark, sf):
    from ..functions.intervals import fraction

    s = L.spans(spark, sf).select("target", F.array(F.struct("lo", "hi")).alias("intervals"), F.col("day").alias("date"), "note", F.col("note").alias("ord"))
    rows = progress.combined(s, "target")
    return rows.select("target", "date", "note", F.size("intervals").cast("long").alias("n_islands"), F.round(fraction(F.col("intervals")), 9).alias("frac"))


@query(
    f"""WITH {L.EVIDENCE}, ids AS (SELECT target AS edge_ord, unnest([target * 2, target * 3, target]) AS id, unnest([0, 1, 2]) AS place FROM targets),
    one AS (SELECT edge_ord, id, min(place) AS place FROM ids GROUP BY edge_ord, id), known AS (SELECT DISTINCT target FROM spans)
    SELECT edge_ord, id, rank() OVER (PARTITION BY edge_ord ORDER BY place) AS found FROM one JOIN known ON known.target = id"""
)
def alias_lookup(spark, sf):
    from pyspark.sql import Window

    e = L.targets(spark, sf).select(F.col("target").alias("edge_ord"), F.array(F.col("target") * 2, F.col("target") * 3, F.col("target")).alias("ids"))
    rows = progress.alias_lookup(e, L.spans(spark, sf).select(F.col("target").alias("coverage_id")))
    found = F.row_number().over(Window.partitionBy("edge_ord").orderBy("place")).cast("long")
    return rows.select("edge_ord", F.col("coverage_id").alias("id"), found.alias("found"))


@query(
    f"""WITH {L.EVIDENCE}, imp AS (SELECT target, lo, hi, CAST(substr(day, 1, 4) AS INTEGER) AS y FROM spans), upto AS (SELECT DISTINCT target, y AS upto FROM imp),
    d AS (SELECT DISTINCT i.target, upto, lo, hi FROM imp i JOIN upto u ON u.target = i.target AND i.y <= upto),
    tp AS (SELECT *, max(hi) OVER (PARTITION BY target, upto ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM d),
    mk AS (SELECT *, sum(CASE WHEN top IS NULL OR lo > top + 1e-9 THEN 1 ELSE 0 END) OVER (PARTITION BY target, upto ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS isl FROM tp),
    ii AS (SELECT target, upto, min(lo) AS lo, max(hi) AS hi FROM mk GROUP BY target, upto, isl),
    fr AS (SELECT target, upto, least(1.0::DOUBLE, sum(hi - lo)) AS frac FROM ii GROUP BY target, upto),
    dn AS (SELECT f.target, min(upto) AS y, any_value(length) AS length FROM fr f JOIN targets t ON t.target = f.target
           WHERE round(frac, 9) >= round(greatest(0.5::DOUBLE, 1.0::DOUBLE - 15.0::DOUBLE / greatest(length, 1.0::DOUBLE)), 9) GROUP BY f.target)
    SELECT y AS import_ord, count(*) AS new_complete, round(sum(length), 3) AS new_complete_m FROM dn GROUP BY y"""
)
def new_complete_per_import(spark, sf):
    s = L.spans(spark, sf).select(F.col("target").alias("coverage_id"), "lo", "hi", F.left("day", F.lit(4)).cast("int").alias("import_ord"))
    t = L.targets(spark, sf).select(F.col("target").alias("coverage_id"), "length")
    return progress.first_completion(s, t).groupBy("import_ord").agg(F.count("*").alias("new_complete"), F.round(F.sum("length"), 3).alias("new_complete_m"))


# ---- inventory ---------------------------------------------------------------------------------


def _features(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.features(L.surfaces(spark, sf))


@query(f"WITH {L.SURFACES} SELECT name, a, b FROM pairs")
def same_block_pairs(spark, sf):
    return inventory.block_pairs(_features(spark, sf)).select("name", "a", "b").distinct()


@query(
    f"""WITH {L.SURFACES} SELECT name, a, b FROM metrics WHERE ca = 'street' AND cb = 'street' AND abs(dot) >= 0.9271838545667874 AND la / lb BETWEEN 0.5 AND 2.0
    AND perp > 45 AND perp <= 90 AND along <= 0.35 * least(la, lb)"""
)
def near_miss_pairs(spark, sf):
    return inventory.near_misses(_features(spark, sf))


_CLUSTERS = """,
links AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach AS (
  WITH RECURSIVE walk(x, y) AS (SELECT edge_ord, edge_ord FROM feats UNION SELECT w.x, l.b FROM walk w JOIN links l ON l.a = w.y) SELECT x AS edge_ord, min(y) AS cluster FROM walk GROUP BY x),
scored AS (
  SELECT r.cluster, f.*, CASE WHEN cls = 'street' AND highway NOT IN ('footway', 'path', 'pedestrian') THEN 0 ELSE 1 END AS sr, CASE WHEN service IS NULL THEN 0 ELSE 1 END AS ss
  FROM reach r JOIN feats f ON f.edge_ord = r.edge_ord),
ranked AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY sr, ss, length, edge_ord) AS rn, max(length) OVER (PARTITION BY cluster) AS cluster_m,
  count(*) OVER (PARTITION BY cluster) AS surfaces FROM scored)
"""


@query(f"WITH {L.SURFACES} {_CLUSTERS} SELECT edge_ord, cluster FROM reach")
def cluster_components(spark, sf):
    f = _features(spark, sf)
    return inventory.clusters(f, inventory.block_pairs(f)).select("edge_ord", "cluster")


def _elected(spark: SparkSession, sf: str) -> DataFrame:
    f = _features(spark, sf)
    return inventory.elect(inventory.clusters(f, inventory.block_pairs(f)))


@query(f"WITH {L.SURFACES} {_CLUSTERS} SELECT cluster, edge_ord AS rep, round(cluster_m, 3) AS cluster_m, surfaces FROM ranked WHERE rn = 1")
def representatives(spark, sf):
    return _elected(spark, sf).where("rep = edge_ord").select("cluster", "rep", r("cluster_m"), "surfaces")


@query(
    f"""WITH {L.SURFACES} {_CLUSTERS}, b AS (SELECT edge_ord, cluster, name || ':' || cls || ':' || CAST(u % 3 AS VARCHAR) AS base, CAST(u % 2 AS VARCHAR) AS suffix FROM ranked WHERE rn = 1),
    n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY cluster) AS n FROM b), i AS (SELECT *, CASE WHEN n = 1 THEN base ELSE base || ':' || suffix END AS id FROM n),
    k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cluster) AS k FROM i) SELECT edge_ord, CASE WHEN k = 1 THEN id ELSE id || '-' || CAST(k AS VARCHAR) END AS coverage_id FROM k"""
)
def collision_ids(spark, sf):
    reps = _elected(spark, sf).where("rep = edge_ord")
    k = F.col("u").cast("long")
    named = reps.select("edge_ord", "cluster", F.concat_ws(":", "name", "cls", (k % 3).cast("string")).alias("base"), (k % 2).cast("string").alias("suffix"))
    return inventory.collisions(named, order="cluster").select("edge_ord", "coverage_id")


@query(
    f"""WITH {L.SURFACES}, st AS (SELECT edge_ord AS cluster, length - 60.0::DOUBLE AS cluster_m, name, u, v, (vlon - ulon) * 111320.0 * cos(radians(lat0)) AS dx, (vlat - ulat) * 110540.0 AS dy FROM feats WHERE cls = 'street'),
    e AS (SELECT cluster, cluster_m, name, dx / sqrt(dx * dx + dy * dy) AS dx, dy / sqrt(dx * dx + dy * dy) AS dy, unnest([u, v]) AS node FROM st)
    SELECT DISTINCT s.cluster FROM e s JOIN e l ON s.node = l.node AND s.name = l.name AND s.cluster <> l.cluster
    WHERE s.cluster_m < 20 AND l.cluster_m >= 20 AND abs(s.dx * l.dx + s.dy * l.dy) >= 0.7"""
)
def shard_neighbours(spark, sf):
    rows = _features(spark, sf).withColumn("cluster", F.col("edge_ord")).withColumn("cluster_m", F.col("length") - 60.0)
    return inventory.shards(rows)


@query(None)
def prepared_inventory(spark, sf):
    named, _ = inventory.prepare(L.edges(spark, sf), L.nodes(spark, sf), L.ZONES)
    return named.select("edge_ord", "coverage_id", "coverage_required", "coverage_name", "coverage_class", "coverage_exclusion")


@query(None)
def observation_aliases(spark, sf):
    rows = inventory.features(rules.with_ends(L.edges(spark, sf), L.nodes(spark, sf)))
    shifted = _features(spark, sf)
    return inventory.aliases(rows.where("name = ''"), shifted.where("cls = 'street'"))


@query(
    """SELECT sha256(string_agg(id, chr(10) ORDER BY id)) AS fingerprint, count(*) AS targets FROM (
    SELECT 'p' || CAST(p_partkey AS VARCHAR) || ':' || CAST(20 + p_size * 5 AS VARCHAR) || '.0' AS id FROM part)"""
)
def inventory_fingerprint(spark, sf):
    t = L.targets(spark, sf).select(F.concat(F.lit("p"), F.col("target").cast("string")).alias("coverage_id"), "length")
    return inventory.fingerprint(t)


# ---- network -----------------------------------------------------------------------------------


@query(f"WITH {L.NET}, e AS (SELECT u, v FROM reasoned WHERE reason IS NULL), d AS (SELECT unnest([u, v]) AS node_id FROM e) SELECT node_id, count(*) AS degree FROM d GROUP BY node_id HAVING count(*) % 2 = 1")
def odd_nodes(spark, sf):
    rows = network.odd_nodes(_reasoned(spark, sf).where("reason is null"))
    return rows.select(F.col("node_id").cast("long").alias("node_id"), "degree")


_COMPS = """,
live AS (SELECT edge_ord, u, v, length, name FROM reasoned WHERE reason IS NULL AND length > 120),
step AS (SELECT u AS a, v AS b FROM live UNION SELECT v, u FROM live),
comps AS (WITH RECURSIVE walk(x, y) AS (SELECT a, a FROM step UNION SELECT w.x, s.b FROM walk w JOIN step s ON s.a = w.y) SELECT x AS node_id, min(y) AS component FROM walk GROUP BY x)
"""


def _public(spark: SparkSession, sf: str) -> DataFrame:
    rows = _reasoned(spark, sf).where("reason is null")
    return rows.withColumn("u", F.col("u").cast("long")).withColumn("v", F.col("v").cast("long"))


@query(f"WITH {L.NET} {_COMPS} SELECT node_id, component FROM comps")
def network_components(spark, sf):
    return network.components(_public(spark, sf))


@query(
    f"""WITH {L.NET} {_COMPS}, z AS (SELECT component, count(*) AS nodes FROM comps GROUP BY component), m AS (SELECT component FROM z ORDER BY nodes DESC, component LIMIT 1)
    SELECT z.component, any_value(z.nodes) AS nodes, count(*) AS edges, round(sum(CASE WHEN name IS NOT NULL THEN length ELSE 0 END) / 1000, 6) AS required_km
    FROM live l JOIN comps c ON c.node_id = l.u JOIN z ON z.component = c.component WHERE z.component NOT IN (SELECT component FROM m) GROUP BY z.component
    HAVING sum(CASE WHEN name IS NOT NULL THEN length ELSE 0 END) / 1000 >= 0.05"""
)
def island_totals(spark, sf):
    e = _public(spark, sf).withColumn("coverage_required", display_name() != "")
    return network.island_totals(e, network.components(e)).select("component", "nodes", "edges", r("required_km", 6))


@query(
    """WITH n AS (SELECT p_partkey AS node_id, CAST(p_partkey % 40 AS DOUBLE) * 0.001 AS x, CAST(p_partkey // 40 AS DOUBLE) * 0.001 AS y FROM part),
    p AS (SELECT s_suppkey AS point_id, (s_suppkey % 37) * 0.0011::DOUBLE AS lon, (s_suppkey % 53) * 0.0007::DOUBLE + 0.0001::DOUBLE AS lat FROM supplier),
    d AS (SELECT point_id, node_id, power((x - lon) * cos(radians(lat)), 2) + power(y - lat, 2) AS d2 FROM p, n),
    q AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY d2, node_id) AS k FROM d) SELECT point_id, node_id FROM q WHERE k = 1"""
)
def nearest_node(spark, sf):
    s = F.col("s_suppkey")
    p = L.read(spark, sf, "supplier").select(s.alias("point_id"), ((s % 37) * F.lit(0.0011)).alias("lon"), ((s % 53) * F.lit(0.0007) + F.lit(0.0001)).alias("lat"))
    return network.nearest(p, L.nodes(spark, sf)).select("point_id", F.col("node_id").cast("long").alias("node_id"))


@query(
    f"""WITH {L.NET}, p AS (SELECT s_suppkey AS fix_id, (s_suppkey % 37) * 0.00103::DOUBLE AS lon, (s_suppkey % 53) * 0.00071::DOUBLE + 0.0001::DOUBLE AS lat FROM supplier),
    c AS (SELECT fix_id, edge_ord, edge_ord // 2 AS identity, (vlon - ulon) * 111320.0 * cos(radians(lat)) AS bx, (vlat - ulat) * 110540.0 AS by_,
      (lon - ulon) * 111320.0 * cos(radians(lat)) AS px, (lat - ulat) * 110540.0 AS py FROM p, placed WHERE abs(lon - ulon) < 0.01 AND abs(lat - ulat) < 0.01),
    t AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (px * bx + py * by_) / (bx * bx + by_ * by_))) AS t FROM c),
    d AS (SELECT fix_id, edge_ord, identity, t AS frac, sqrt(power(px - t * bx, 2) + power(py - t * by_, 2)) AS d FROM t),
    o AS (SELECT *, row_number() OVER (PARTITION BY fix_id, identity ORDER BY round(d, 6), edge_ord) AS n FROM d WHERE d <= 65.0),
    k AS (SELECT *, row_number() OVER (PARTITION BY fix_id ORDER BY round(d, 6), edge_ord) AS rank FROM o WHERE n = 1)
    SELECT fix_id, CAST(rank AS INTEGER) AS rank, edge_ord, round(d, 4) AS d, round(frac, 6) AS frac FROM k WHERE rank <= 8"""
)
def candidate_topk(spark, sf):
    s = F.col("s_suppkey")
    p = L.read(spark, sf, "supplier").select(s.alias("fix_id"), ((s % 37) * F.lit(0.00103)).alias("lon"), ((s % 53) * F.lit(0.00071) + F.lit(0.0001)).alias("lat"))
    e = rules.with_ends(L.edges(spark, sf), L.nodes(spark, sf)).select("edge_ord", F.floor(F.col("edge_ord") / 2).alias("identity"), inventory.line_of().alias("line"))
    return network.candidates(p, e).select("fix_id", "rank", "edge_ord", r("d", 4), r("frac", 6))


@query(f"WITH {L.NET} SELECT edge_ord, round(abs(zu - zv), 6) AS rise, round(length + 8 * abs(zu - zv), 6) AS effort FROM placed")
def effort(spark, sf):
    return network.effort(L.edges(spark, sf), L.nodes(spark, sf)).select("edge_ord", r("rise", 6), r("effort", 6))


@query(
    f"""WITH {L.NET}, b AS (SELECT radians(4 * ((degrees(atan2((vlon - ulon) * cos(radians((ulat + vlat) / 2)), vlat - ulat)) + 360) % 360)) AS b FROM placed),
    s AS (SELECT avg(sin(b)) AS s, avg(cos(b)) AS c FROM b) SELECT round(((degrees(atan2(s, c)) / 4) % 90 + 90) % 90, 2) % 90 AS axis FROM s"""
)
def dominant_axes(spark, sf):
    rows = network.dominant_axis(rules.with_ends(L.edges(spark, sf), L.nodes(spark, sf)))
    return rows.select((F.round("axis", 2) % 90).alias("axis"))


@query(f"WITH {L.NET} SELECT least(u, v) AS a, greatest(u, v) AS b, min(length) AS length FROM (SELECT u, v, length FROM edges UNION ALL SELECT v, u, length + 1 FROM edges) GROUP BY 1, 2")
def shortest_parallel(spark, sf):
    e = L.edges(spark, sf).select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), "key", "length")
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"), (F.col("key") + 1).alias("key"), (F.col("length") + 1).alias("length")))
    return network.shortest_parallel(both).select("a", "b", "length")


@query(f"WITH {L.NET} SELECT edge_ord, round(sqrt(power((vlon - ulon) * 111320.0 * cos(radians((ulat + vlat) / 2)), 2) + power((vlat - ulat) * 110540.0, 2)), 4) AS planar_m FROM placed")
def edge_lengths(spark, sf):
    rows = rules.with_ends(L.edges(spark, sf), L.nodes(spark, sf))
    return rows.select("edge_ord", F.round(planar_m(F.col("ulat"), F.col("ulon"), F.col("vlat"), F.col("vlon")), 4).alias("planar_m"))


# ---- tracks ------------------------------------------------------------------------------------


@query(
    f"""WITH {L.TRACK} SELECT walk_id, count(*) AS n_points, round(coalesce(sum(CASE WHEN step_m <= 150 THEN step_m END), 0), 3) AS raw_m,
    round(coalesce(sum(CASE WHEN step_m > 150 THEN step_m END), 0), 3) AS raw_gap_m, CAST(sum(CASE WHEN step_m > 150 THEN 1 ELSE 0 END) AS BIGINT) AS n_raw_gaps FROM steps GROUP BY walk_id"""
)
def track_steps(spark, sf):
    t = tracks.track_totals(tracks.steps(L.fixes(spark, sf)), ["walk_id"])
    return t.select("walk_id", "n_points", r("raw_m"), r("raw_gap_m"), "n_raw_gaps")


@query(f"WITH {L.TRACK} SELECT walk_id, first_fix, last_fix, n_steps, round(ride_m, 3) AS ride_m FROM rides")
def vehicle_runs(spark, sf):
    return tracks.rides(tracks.steps(L.fixes(spark, sf))).select("walk_id", "first_fix", "last_fix", "n_steps", r("ride_m"))


@query(f"WITH {L.TRACK} SELECT walk_id, CAST(piece AS INTEGER) AS piece, count(*) AS fixes, min(fix_ord) AS first_fix, max(fix_ord) AS last_fix FROM walkable GROUP BY walk_id, piece")
def track_split(spark, sf):
    rows = tracks.without_rides(L.fixes(spark, sf))
    return rows.groupBy("walk_id", "piece").agg(F.count("*").alias("fixes"), F.min("fix_ord").alias("first_fix"), F.max("fix_ord").alias("last_fix"))


@query(None)
def stationary_filter(spark, sf):
    return tracks.moved(L.fixes(spark, sf)).groupBy("walk_id").agg(F.count("*").alias("fixes"))


# ---- routes, layers, reviews -------------------------------------------------------------------


@query(f"WITH {L.ROUTE} SELECT route_id, ord, round(bearing, 4) AS bearing, round(angle, 4) AS angle, onto, CASE WHEN angle IS NULL OR abs(angle) > 170 THEN 'U-turn' WHEN abs(angle) <= 20 THEN 'Continue' WHEN abs(angle) <= 50 THEN 'Slight ' || CASE WHEN angle >= 0 THEN 'right' ELSE 'left' END WHEN abs(angle) <= 135 THEN 'Turn ' || CASE WHEN angle >= 0 THEN 'right' ELSE 'left' END ELSE 'Sharp ' || CASE WHEN angle >= 0 THEN 'right' ELSE 'left' END END AS instruction FROM turned")
def maneuvers(spark, sf):
    return routes.turns(L.legs(spark, sf)).select("route_id", "ord", r("bearing", 4), r("angle", 4), "onto", "instruction")


@query(
    f"""WITH {L.ROUTE}, w AS (SELECT *, lag(angle) OVER (PARTITION BY route_id ORDER BY ord) AS was FROM turned),
    i AS (SELECT *, sum(CASE WHEN was IS NULL OR abs(was) > 30 THEN 1 ELSE 0 END) OVER (PARTITION BY route_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS run FROM w)
    SELECT route_id, CAST(run AS BIGINT) AS run, min(ord) AS first_ord, count(*) AS edges, round(sum(length), 3) AS m, substr(string_agg(DISTINCT name, ', ' ORDER BY name), 1, 48) AS names FROM i GROUP BY route_id, run"""
)
def straight_runs(spark, sf):
    return routes.straight_runs(L.legs(spark, sf)).select("route_id", "run", "first_ord", "edges", r("m"), "names")


@query(
    f"""WITH {L.ROUTE} SELECT route_id, round(sum(CASE WHEN NOT deadhead THEN length ELSE 0 END), 3) AS required_m, round(sum(CASE WHEN deadhead THEN length ELSE 0 END), 3) AS deadhead_m,
    round(sum(CASE WHEN zv > zu THEN zv - zu ELSE 0 END), 3) AS ascent_m, round(sum(CASE WHEN zv < zu THEN zu - zv ELSE 0 END), 3) AS descent_m,
    round(sum(CASE WHEN deadhead AND zv > zu THEN zv - zu ELSE 0 END), 3) AS deadhead_ascent_m FROM legs GROUP BY route_id"""
)
def route_elevation(spark, sf):
    return routes.elevation_totals(L.legs(spark, sf)).select("route_id", *[r(c) for c in ("required_m", "deadhead_m", "ascent_m", "descent_m", "deadhead_ascent_m")])


@query(
    """WITH n AS (SELECT p_retailprice AS x, row_number() OVER (ORDER BY p_retailprice) - 1 AS i, count(*) OVER () AS n FROM part)
    SELECT min(CASE WHEN i = CAST(floor(n * 0.0015) AS BIGINT) THEN x END) AS low, min(CASE WHEN i = n - 1 - CAST(floor(n * 0.0015) AS BIGINT) THEN x END) AS high FROM n"""
)
def extent_trim(spark, sf):
    return routes.trimmed_extent(L.read(spark, sf, "part"), "p_retailprice")


def _segment(z: tuple[float, float, float]) -> str:
    lat, lon, rad = z
    kx = f"(111320.0 * cos(radians({lat})))"
    t = f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, (({lon} - ulon) * {kx} * (vlon - ulon) * {kx} + ({lat} - ulat) * 110540.0 * (vlat - ulat) * 110540.0) / (power((vlon - ulon) * {kx}, 2) + power((vlat - ulat) * 110540.0, 2))))"
    return f"(sqrt(power(({lon} - ulon) * {kx} - {t} * (vlon - ulon) * {kx}, 2) + power(({lat} - ulat) * 110540.0 - {t} * (vlat - ulat) * 110540.0, 2)) <= {rad})"


@query(
    f"""WITH {L.NET}, {L.EVIDENCE}, f AS (SELECT target, min({{'d': day, 'n': note}}) AS f FROM spans GROUP BY target),
    j AS (SELECT e.edge_ord, e.length, s.frac, f.f.n AS note, {_segment(L.ZONES[0])} OR {_segment(L.ZONES[1])} AS hidden FROM placed e LEFT JOIN state s ON s.target = e.u LEFT JOIN f ON f.target = e.u),
    k AS (SELECT *, CASE WHEN hidden OR frac IS NULL THEN 'base' WHEN round(frac, 9) >= round(greatest(0.5::DOUBLE, 1.0::DOUBLE - 15.0::DOUBLE / greatest(length, 1.0::DOUBLE)), 9) THEN 'done' WHEN frac >= 0.05 THEN 'partial' ELSE 'base' END AS status FROM j)
    SELECT status, CASE WHEN status = 'done' THEN note END AS layer, count(*) AS edges, round(sum(length), 3) AS m FROM k GROUP BY 1, 2"""
)
def layer_status(spark, sf):
    placed = rules.with_ends(L.edges(spark, sf), L.nodes(spark, sf))
    rec = _records(spark, sf).select(F.col("target").cast("string").alias("u"), "note", F.array(F.struct(F.lit(0.0).alias("lo"), F.round("frac", 9).alias("hi"))).alias("intervals"), F.lit(True).alias("seen"))
    rows = placed.join(rec, "u", "left").withColumn("seen", F.coalesce("seen", F.lit(False)))
    out = routes.layer_status(rows, inventory.line_of(), list(L.ZONES))
    return out.groupBy("status", "layer").agg(F.count("*").alias("edges"), F.round(F.sum("length"), 3).alias("m"))


_IMPORTS = """WITH i AS (SELECT o_orderkey AS id, o_totalprice AS raw_m, round(o_totalprice * (o_custkey % 7) / 5.0::DOUBLE, 4) AS assigned_m, round(o_totalprice * (o_orderkey % 11) / 10.0::DOUBLE, 4) AS near,
  CAST(o_custkey % 4 AS BIGINT) AS gaps, CAST(o_custkey % 50 AS BIGINT) AS unmatched, CASE WHEN o_orderkey % 9 = 0 THEN 120.0::DOUBLE ELSE 0 END AS vehicle_m FROM orders)"""


@query(
    _IMPORTS
    + """, f AS (SELECT unnest(list_filter([CASE WHEN vehicle_m > 0 THEN 'vehicle' END, CASE WHEN gaps > 0 THEN 'gps_gaps' END, CASE WHEN raw_m <> 0 AND assigned_m > raw_m * 1.05 THEN 'assigned_over_physical' END,
    CASE WHEN unmatched / 100.0::DOUBLE >= 0.20 THEN 'unmatched' END, CASE WHEN raw_m <> 0 AND near / raw_m < 0.60 THEN 'far_from_inventory' END,
    CASE WHEN near <> 0 AND assigned_m > near * 1.20 THEN 'assigned_over_near' END, CASE WHEN near >= 1000 AND assigned_m / near < 0.65 THEN 'repeats_or_fragments' END], lambda x: x IS NOT NULL)) AS flag FROM i)
    SELECT flag, count(*) AS imports FROM f GROUP BY flag"""
)
def review_flags(spark, sf):
    o = L.read(spark, sf, "orders")
    p = F.col("o_totalprice")
    i = o.select(
        p.alias("raw_m"), F.round(p * (F.col("o_custkey") % 7) / 5.0, 4).alias("assigned_m"), F.lit(None).cast("double").alias("required_assigned_m"),
        F.round(p * (F.col("o_orderkey") % 11) / 10.0, 4).alias("near_target_trace_m"), (F.col("o_custkey") % 4).alias("n_raw_gaps"), F.lit(100).alias("n_points"),
        (F.col("o_custkey") % 50).alias("n_unmatched"), F.when(F.col("o_orderkey") % 9 == 0, 120.0).otherwise(0.0).alias("vehicle_m"),
    )
    return routes.review_flags(i).select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("imports"))


@query(
    """WITH off AS (SELECT replace(p_name, 'bolt', 'saint 01st.') AS name, sum(p_retailprice) / 30 AS m FROM part GROUP BY 1),
    o AS (SELECT replace(replace(name, 'saint', 'st'), '01st.', '1st') AS name, m FROM off WHERE m >= 30),
    inv AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN replace(n, ' ', '') WHEN p_partkey % 3 = 1 THEN n || ' street' ELSE n END AS name, sum(p_size) AS m
      FROM (SELECT p_partkey, p_size, replace(p_name, 'bolt', 'st 1st') AS n FROM part WHERE p_size > 20) GROUP BY 1),
    t AS (SELECT replace(name, ' ', '') AS k, sum(m) AS m FROM inv GROUP BY 1),
    j AS (SELECT o.name, o.m AS official_m, coalesce(nullif(CAST(a.m AS DOUBLE), 0), nullif(CAST(t.m AS DOUBLE), 0), CAST(s.m AS DOUBLE), 0) AS inventory_m
      FROM o LEFT JOIN inv a ON a.name = o.name LEFT JOIN t ON t.k = replace(o.name, ' ', '') LEFT JOIN inv s ON s.name = o.name || ' street')
    SELECT name, round(official_m, 3) AS official_m, round(inventory_m, 3) AS inventory_m, CASE WHEN inventory_m >= 0.45 * official_m THEN 'matched' WHEN inventory_m < 30 THEN 'missing' ELSE 'undercount' END AS verdict FROM j"""
)
def name_crosscheck(spark, sf):
    part = L.read(spark, sf, "part")
    off = part.groupBy(F.replace("p_name", F.lit("bolt"), F.lit("saint 01st.")).alias("n")).agg((F.sum("p_retailprice") / 30).alias("m")).select(official_name(F.col("n")).alias("name"), "m")
    n = F.replace("p_name", F.lit("bolt"), F.lit("st 1st"))
    k = F.col("p_partkey") % 3
    inv = part.where("p_size > 20").select(F.when(k == 0, F.replace(n, F.lit(" "), F.lit(""))).when(k == 1, F.concat(n, F.lit(" street"))).otherwise(n).alias("name"), F.col("p_size").cast("double").alias("m"))
    return routes.cross_check(off, inv).select("name", r("official_m"), r("inventory_m"), "verdict")


# ---- migration ---------------------------------------------------------------------------------

_MIGRATE = """WITH o AS (SELECT p_partkey AS id, p_brand AS name, CAST(p_partkey // 40 AS DOUBLE) * 0.001 AS lat, CAST(p_partkey % 40 AS DOUBLE) * 0.001 AS lon, 20.0::DOUBLE + p_size * 5 AS length FROM part),
n AS (SELECT id + 1000000 AS id, id AS ord, name, lat + (id % 5) * 0.0001::DOUBLE AS lat, lon, length * (1 + (id % 3) * 0.2::DOUBLE) AS length FROM o WHERE id % 6 <> 0),
h AS (SELECT a.id AS old_id, b.id AS new_id, b.ord, sqrt(power((b.lon - a.lon) * 111320.0 * cos(radians((a.lat + b.lat) / 2)), 2) + power((b.lat - a.lat) * 110540.0, 2)) AS d
  FROM o a JOIN n b ON a.name = b.name WHERE abs(a.length - b.length) <= greatest(20.0, 0.35 * a.length)),
k AS (SELECT *, row_number() OVER (PARTITION BY old_id ORDER BY d, ord) AS k FROM h WHERE d < 40),
m AS (SELECT o.id AS old_id, k.new_id FROM o LEFT JOIN k ON k.old_id = o.id AND k.k = 1)"""


def _migration(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    old = L.read(spark, sf, "part").select(
        k.alias("id"), k.alias("ord"), F.col("p_brand").alias("name"), (F.floor(k / 40).cast("double") * 0.001).alias("lat"), ((k % 40).cast("double") * 0.001).alias("lon"),
        (F.lit(20.0) + F.col("p_size") * 5).alias("length"),
    )
    new = old.where("id % 6 <> 0").select(
        (F.col("id") + 1000000).alias("id"), "ord", "name", (F.col("lat") + (F.col("id") % 5) * F.lit(0.0001)).alias("lat"), "lon", (F.col("length") * (1 + (F.col("id") % 3) * F.lit(0.2))).alias("length")
    )
    return progress.rekey(old, new)


@query(f"{_MIGRATE} SELECT old_id, coalesce(new_id, -1) AS new_id FROM m")
def migrate_match(spark, sf):
    return _migration(spark, sf).select("old_id", F.coalesce("new_id", F.lit(-1)).alias("new_id"))


@query(f"{_MIGRATE} SELECT count(DISTINCT new_id) AS migrated, count(new_id) - count(DISTINCT new_id) AS merged, count(*) - count(new_id) AS lost FROM m")
def migration_counts(spark, sf):
    return progress.migration(_migration(spark, sf))


@query(f"WITH {L.EVIDENCE}, w AS (SELECT DISTINCT target FROM spans), e AS (SELECT target FROM targets WHERE target % 5 <> 0) SELECT count(*) AS walked, count(e.target) AS known, count(e.target) < 0.5 * count(*) AS warn FROM w LEFT JOIN e ON e.target = w.target")
def store_overlap(spark, sf):
    w = L.spans(spark, sf).select(F.col("target").alias("coverage_id")).distinct()
    return progress.store_overlap(w, L.targets(spark, sf).where("target % 5 <> 0").select(F.col("target").alias("coverage_id")))


@query(None)
def city_total_dedupe(spark, sf):
    k = F.col("target")
    t = _state(spark, sf).select(
        F.lit(0).alias("area_ord"), k.alias("edge_ord"), "name", (F.floor(k / 40).cast("double") * 0.0003).alias("lat"), ((k % 40).cast("double") * 0.0003).alias("lon"), "length", F.coalesce("frac", F.lit(0.0)).alias("frac")
    )
    both = t.unionByName(t.where("edge_ord % 3 = 0").withColumn("area_ord", F.lit(1)).withColumn("frac", F.lit(0.5)))
    return progress.across_areas(both).agg(F.count("*").alias("targets"), F.round(F.sum("length"), 3).alias("m"), F.round(F.sum(F.col("length") * F.col("frac")), 3).alias("covered_m"))


@query(
    r"""SELECT p_partkey, trim(regexp_replace(lower('  The  ' || p_name || ' '), '\s+', ' ', 'g')) AS norm, greatest(0.5::DOUBLE, 1.0::DOUBLE - 15.0::DOUBLE / greatest(20.0::DOUBLE + p_size * 5, 1)) AS need FROM part"""
)
def normalised_names(spark, sf):
    p = L.read(spark, sf, "part")
    return p.select("p_partkey", normalized_name(F.concat(F.lit("  The  "), "p_name", F.lit(" "))).alias("norm"), needed(F.lit(20.0) + F.col("p_size") * 5).alias("need"))


# ---- kernels: no SQL form; their own invariants are tested -------------------------------------


def _zones(spark, sf):
    placed = _reasoned(spark, sf).where("reason is null")
    z = lambda side: L.nodes(spark, sf).select(F.col("node_id").alias(side), F.col("elevation").alias(f"z{side}"))
    rows = placed.join(z("u"), "u").join(z("v"), "v")
    cols = rows.select("edge_ord", "u", "v", "key", "length", "ulon", "ulat", "vlon", "vlat", "zu", "zv", display_name().alias("name"), F.element_at(F.col("tags"), "highway")[0].alias("highway"))
    cols = cols.withColumn("required", F.col("name") != "").withColumn("coverage_id", F.lit(None).cast("string"))
    return outings.zones_of(cols)


def _plan(kind, km):
    def f(spark, sf):
        s = outings.summaries(_zones(spark, sf), kind, km)
        return s.select("group", "streets", r("required_m"), r("deadhead_m"), r("total_m"), "n_odd_nodes")

    return f


for _name, _kind, _km in (("plan_efficient", "efficient", 2.0), ("plan_snake", "snake", 2.0), ("chunk_disk", "disk", 3.0), ("twin_collapse", "twins", 0.0), ("stair_ascent", "ascent", 0.0)):
    QUERIES[_name] = _plan(_kind, _km)


@query(None)
def map_match(spark, sf):
    named, _ = inventory.prepare(L.edges(spark, sf), L.nodes(spark, sf), L.ZONES)
    rows = matching.network_rows(named)
    legs = L.legs(spark, sf)
    # a fix every tenth of each leg, 4 m beside it
    t = F.explode(F.sequence(F.lit(0), F.lit(9)))
    walk = legs.select("route_id", "ord", "ulon", "ulat", "vlon", "vlat", t.alias("t")).select(
        F.col("route_id").cast("string").alias("walk_id"), F.lit(0).alias("seg_ord"), (F.col("ord") * 10 + F.col("t")).cast("int").alias("fix_ord"),
        (F.col("ulat") + (F.col("vlat") - F.col("ulat")) * F.col("t") / 10 + 0.00003).alias("lat"), (F.col("ulon") + (F.col("vlon") - F.col("ulon")) * F.col("t") / 10 + 0.00003).alias("lon"),
        F.lit(None).cast("double").alias("ts"),
    )
    found = matching.match_tracks(walk, rows)
    return found.groupBy("walk_id").agg(F.count("coverage_id").alias("spans"), F.round(F.sum("matched_m"), 2).alias("matched_m"), F.round(F.sum("raw_m"), 2).alias("raw_m"), F.sum("n_unmatched").alias("n_unmatched"))


@query(None)
def route_cues(spark, sf):
    rows = cues.cues(L.legs(spark, sf))
    return rows.select("route_id", "ord", "text", "street", "sym", r("lat", 6), r("lon", 6))
