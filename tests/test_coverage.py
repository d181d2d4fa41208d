"""Rules, intervals, inventory, tracks, matching, sources and the query catalogue on small networks."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from trailmark import cli
from trailmark.functions import geo, intervals, names
from trailmark.operators import inventory, matching, network, progress, routes, rules, tracks
from trailmark.plans import queries
from trailmark.schema import EDGES, NODES
from trailmark.sources import gpx, networks, sinks
from trailmark.streaming import evidence

M = 1 / 110540.0  # a metre of latitude


def net(spark, nodes, edges):
    """nodes: name -> (x, y) in metres at the equator; edges: (u, v, tags[, length])."""
    n = spark.createDataFrame([(k, i, x / 111320.0, y * M, None) for i, (k, (x, y)) in enumerate(nodes.items())], NODES)
    rows = []
    for i, (u, v, tags, *m) in enumerate(edges):
        (x1, y1), (x2, y2) = nodes[u], nodes[v]
        length = m[0] if m else ((x1 - x2) ** 2 + (y1 - y2) ** 2) ** 0.5
        rows.append((i, u, v, 0, float(length), str(i), None, {k: x if isinstance(x, list) else [x] for k, x in tags.items()}))
    return spark.createDataFrame(rows, EDGES), n


def one(spark, column, **tags):
    df = spark.createDataFrame([({k.replace("__", ":"): x if isinstance(x, list) else [x] for k, x in tags.items()},)], "tags map<string,array<string>>")
    return df.select(column).first()[0]


@pytest.mark.parametrize(
    ("tags", "reason"),
    [
        ({"service": "driveway"}, "parking_or_driveway"), ({"highway": "motorway"}, "non_pedestrian_highway"), ({"highway": "elevator"}, "mechanical_vertical_transport"),
        ({"public_transport": "platform"}, "transit_platform"), ({"access": "private"}, "restricted_access"), ({"access": "private", "foot": "yes"}, None),
        ({"parking": "surface"}, "parking_facility"), ({"indoor": "yes"}, "indoor"), ({"tunnel": "building_passage"}, "building_passage"), ({"area": "yes"}, "non_linear_area"),
        ({"area": "yes", "man_made": "pier"}, None), ({"name": "Big Parking Garage"}, "parking_or_loading"), ({"highway": ["residential", "bus_stop"]}, "non_pedestrian_highway"), ({}, None),
    ],
)
def test_exclusions(spark, tags, reason):
    assert one(spark, rules.exclusion_reason(), **tags) == reason


def test_classes_and_names(spark):
    for tags, cls in (({"man_made": "pier"}, "pier"), ({"highway": "steps"}, "staircase"), ({"service": "alley"}, "alley"), ({"highway": "path"}, "trail"), ({"highway": "primary"}, "street"), ({"highway": " STEPS "}, "staircase")):
        assert one(spark, rules.passage_class(), **tags) == cls
    assert one(spark, rules.is_required(), name="Great Highway Promenade") is False and one(spark, rules.is_required(), name="Great Highway") is True
    assert one(spark, rules.is_required(), name="X", highway="bus_stop") is False and one(spark, rules.foot_restricted(), sidewalk="separate") is True
    assert one(spark, names.name_key(), name=["b", "a"]) == ["a", "b"] and one(spark, names.display_name()) == ""
    df = spark.createDataFrame([("O’Farrell  St.",), ("Saint Mary 01st",)], "s string")
    assert [r[0] for r in df.select(names.official_name(F.col("s"))).collect()] == ["ofarrell st", "st mary 1st"]


@pytest.mark.parametrize(
    ("angle", "words"), [(0, "Continue"), (20, "Continue"), (-21, "Slight left"), (50, "Slight right"), (51, "Turn right"), (-135, "Turn left"), (136, "Sharp right"), (170, "Sharp right"), (171, "U-turn"), (-180, "U-turn")]
)
def test_maneuvers(spark, angle, words):
    assert spark.range(1).select(geo.maneuver(F.lit(float(angle)))).first()[0] == words


def test_interval_unions(spark):
    cases = [([(0, 0.4), (0.4, 0.7), (0.9, 1)], [(0, 0.7), (0.9, 1)]), ([(0.6, 0.2)], [(0.2, 0.6)]), ([(0, 0.5), (0.45, 1)], [(0, 1)]), ([], [])]
    for spans, want in cases:
        df = spark.createDataFrame([([(float(a), float(b)) for a, b in spans],)], f"i {intervals.SPAN}")
        got = df.select(intervals.merged(F.col("i")).alias("m")).select("m", intervals.fraction(F.col("m"))).first()
        assert [tuple(x) for x in got[0]] == want and got[1] == pytest.approx(sum(b - a for a, b in want))
    r = random.Random(1)
    rows = [(i % 9, a, a + r.random() / 5) for i in range(400) for a in [r.random()]]
    df = spark.createDataFrame(rows, "k long, lo double, hi double")
    arrays = df.groupBy("k").agg(intervals.merged(F.collect_list(F.struct("lo", "hi"))).alias("m")).select("k", F.explode("m").alias("s")).select("k", "s.lo", "s.hi")
    assert sorted(map(tuple, arrays.collect())) == sorted(map(tuple, intervals.islands(df, ["k"]).select("k", "lo", "hi").collect()))


def test_two_surfaces_are_one_passage_and_two_blocks_are_two(spark):
    e, n = net(spark, {"a": (0, 0), "b": (111, 0), "c": (222, 0), "a2": (0, 9), "b2": (111, 9)}, [("a", "b", {"name": "Main", "highway": "residential"}), ("b", "c", {"name": "Main", "highway": "residential"}), ("a2", "b2", {"name": "Main", "highway": "footway"})])
    named, left = inventory.prepare(e, n, zones=())
    rows = {r.edge_ord: r for r in named.collect()}
    assert [rows[i].coverage_required for i in range(3)] == [True, True, False]
    assert rows[0].coverage_id == rows[2].coverage_id != rows[1].coverage_id and rows[0].coverage_id.startswith("passage:")
    assert left.count() == 0
    a = inventory.inventory_audit(named).first()
    assert (a.targets, a.aliases, a.shards) == (2, 1, 0)


def test_carriageways_shards_rings_and_aliases(spark):
    street = {"name": "Wide", "highway": "primary"}
    for apart, targets, misses in ((40, 1, 0), (60, 2, 1)):
        e, n = net(spark, {"a": (0, 0), "b": (100, 0), "c": (0, apart), "d": (100, apart)}, [("a", "b", street), ("c", "d", street)])
        named, _ = inventory.prepare(e, n, zones=())
        assert named.where("coverage_required").count() == targets
        assert inventory.near_misses(inventory.features(rules.with_ends(e, n))).count() == misses
    e, n = net(spark, {"a": (0, 0), "b": (7, 0), "c": (118, 0)}, [("a", "b", street), ("b", "c", street)])
    rows = {r.edge_ord: r for r in inventory.prepare(e, n, zones=())[0].collect()}
    assert rows[0].coverage_id is None and rows[0].coverage_required is False and rows[0].coverage_exclusion == "intersection_shard" and rows[1].coverage_required
    e, n = net(spark, {"a": (0, 0), "b": (10, 0), "c": (20, 0), "d": (20, 15)}, [("a", "b", street), ("b", "c", street), ("c", "d", {"name": "Wide", "highway": "primary"})])
    assert inventory.prepare(e, n, zones=())[0].where("coverage_required").count() == 3
    tags = [({"man_made": "pier", "area": "yes", "name": "Pier"}), street, {"highway": "footway", "footway": "sidewalk"}]
    e, n = net(spark, {"a": (0, 0), "b": (100, 0), "c": (0, 300), "d": (100, 300), "s": (0, 308), "t": (100, 308)}, [("a", "b", tags[0]), ("c", "d", tags[1]), ("s", "t", tags[2])])
    rows = {r.edge_ord: r for r in inventory.prepare(e, n, zones=())[0].collect()}
    assert rows[0].coverage_exclusion == "pier_area_ring" and rows[2].coverage_id == rows[1].coverage_id and rows[2].coverage_required is False
    e, n = net(spark, {"a": (0, 0), "b": (100, 0)}, [("a", "b", street)])
    _, left = inventory.prepare(e, n, zones=((0.0, 0.00045, 300.0),))
    assert [tuple(x)[:2] for x in left.collect()] == [("out_of_scope", 1)]


def test_arcs_between_the_same_ends_stay_apart(spark):
    e, n = net(spark, {"a": (0, 0), "b": (40, 0)}, [("a", "b", {"name": "Arc", "highway": "residential"}, 40), ("a", "b", {"name": "Arc", "highway": "residential"}, 100)])
    ids = [r.coverage_id for r in inventory.prepare(e, n, zones=())[0].where("coverage_required").collect()]
    assert len(set(ids)) == 2 and ids[0].split(":")[:2] == ids[1].split(":")[:2]


def test_progress_of_full_and_half_blocks(spark):
    t = spark.createDataFrame([("a", 100.0, 1.0), ("b", 100.0, 0.5), ("c", 100.0, 0.85)], "name string, length double, frac double")
    s = progress.stats(t.where("name <> 'c'")).first()
    assert (s.covered_km, s.walked_km, s.pct_done, s.observed_pct) == (pytest.approx(0.15), pytest.approx(0.1), 50, 75)
    assert progress.stats(t.where("name = 'c'")).first().pct_done == 100 and progress.stats(t.where("false")).first().pct_done == 0
    w = spark.createDataFrame([("x", [(0.0, 0.5)], "2024-01-02", "n1", None), ("old", None, "2023-01-01", None, None)], cli.EMPTY["walked"])
    out, gained = progress.recorded(w, spark.createDataFrame([("x", 0.4, 1.2), ("new", 0.1, 0.2), ("old", 0.0, 0.5)], "coverage_id string, lo double, hi double"), "2024-02-01", "n2")
    rows = {r.coverage_id: r for r in out.collect()}
    assert tuple(rows["x"].intervals[0]) == (0.0, 1.0) and rows["x"].date == "2024-01-02" and rows["x"].note == "n1" and rows["x"].last_date == "2024-02-01"
    assert rows["new"].date == "2024-02-01" and sorted(r[0] for r in gained.collect()) == ["new", "x"]


def test_migration_moves_merges_and_loses(spark):
    cols = "id string, ord long, name string, lat double, lon double, length double"
    old = spark.createDataFrame([("a", 0, "m", 0.0, 0.0, 100.0), ("b", 1, "m", 0.0001, 0.0, 100.0), ("c", 2, "z", 0.0, 0.0, 100.0)], cols)
    new = spark.createDataFrame([("n", 0, "m", 0.00005, 0.0, 110.0)], cols)
    assert tuple(progress.migration(progress.rekey(old, new)).first()) == (1, 1, 1)


def fixes(spark, rows):
    return spark.createDataFrame([("w", s, i, float(lat), float(lon), None if t is None else float(t)) for s, i, lat, lon, t in rows], "walk_id string, seg_ord int, fix_ord int, lat double, lon double, ts double")


def test_rides_are_cut_out(spark):
    pts, y = [], 0.0
    for i in range(55):
        pts.append((0, i, y * M, 0.0, i * 10))
        y += 100 if 20 <= i < 35 else 8
    f = fixes(spark, pts)
    ride = tracks.rides(tracks.steps(f)).first()
    assert (ride.first_fix, ride.last_fix, ride.n_steps) == (20, 35, 15) and ride.ride_m == pytest.approx(1500)
    left = tracks.without_rides(f)
    assert left.select("piece").distinct().count() == 2 and left.count() == 55 - 14
    t = tracks.track_totals(tracks.steps(fixes(spark, [(0, 0, 0, 0, None), (0, 1, 110 * M, 0, None), (0, 2, 0.05, 0, None)]))).first()
    assert 100 < t.raw_m < 120 and t.raw_gap_m > 5000 and t.n_raw_gaps == 1


def street_grid(spark, n=4, size=111.0):
    nodes = {f"{r},{c}": (c * size, r * size) for r in range(n) for c in range(n)}
    edges = [(f"{r},{c}", f"{r},{c + 1}", {"name": f"row{r}", "highway": "residential"}) for r in range(n) for c in range(n - 1)]
    edges += [(f"{r},{c}", f"{r + 1},{c}", {"name": f"col{c}", "highway": "residential"}) for r in range(n - 1) for c in range(n)]
    return net(spark, nodes, edges)


def test_matching_credits_what_was_walked_and_nothing_else(spark):
    e, n = street_grid(spark)
    named, _ = inventory.prepare(e, n, zones=())
    rows = matching.network_rows(named)
    ids = {r.coverage_name + r.u + r.v: r.coverage_id for r in named.collect()}
    r = random.Random(2)
    walk = [(0, i, r.gauss(0, 3) * M, (i * 5 + r.gauss(0, 3)) / 111320, None) for i in range(67)]
    far = [(1, i, (300 + 40) * M, (i * 5 + 2000) / 111320, None) for i in range(20)]
    found = matching.match_tracks(fixes(spark, walk + far), rows).collect()
    spans = {x.coverage_id: (x.lo, x.hi) for x in found if x.coverage_id}
    row0 = {ids[f"row00,{c}0,{c + 1}"] for c in range(3)}
    assert row0 <= set(spans) and all(spans[k][1] - spans[k][0] > 0.9 for k in row0)
    assert not [k for k in set(spans) - row0 if spans[k][1] - spans[k][0] > 0.3]
    m = {x.seg_ord: x for x in found if x.coverage_id is None}
    assert m[1].n_unmatched == 20 and m[1].matched_m == 0 and m[0].n_skipped == 0 and 280 < m[0].named_m < 380
    total = matching.walk_metrics(matching.match_tracks(fixes(spark, walk + far), rows)).first()
    assert total.n_points == 87
    gap = fixes(spark, [(0, 0, 0, 0.0002, None), (0, 1, 0, 0.0004, None), (0, 2, 333 * M, 0.0028, None), (0, 3, 333 * M, 0.0029, None)])
    assert not [x for x in matching.match_tracks(gap, rows).collect() if x.coverage_id and x.hi - x.lo > 0.5]


def test_components_nearest_and_candidates(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(30) if i not in (9, 19)] + [(40, 40)], "u long, v long").repartition(6)
    got = {r.node_id: r.component for r in network.components(e).collect()}
    assert got[9] == 0 and got[10] == 10 and got[19] == 10 and got[30] == 20 and got[40] == 40
    nodes = spark.createDataFrame([("a", 0, 0.0, 0.0, None), ("b", 1, 5.0, 5.0, None), ("c", 2, 0.0, 0.0, None)], NODES)
    pts = spark.createDataFrame([(1, 0.001, 0.0), (2, 3.0, 3.0)], "point_id long, lat double, lon double")
    assert {r.point_id: r.node_id for r in network.nearest(pts, nodes).collect()} == {1: "a", 2: "b"}


def test_layers_and_redaction(spark):
    e, n = street_grid(spark, 2)
    rows = rules.with_ends(e, n).withColumn("seen", F.col("edge_ord") < 2).withColumn("intervals", F.when(F.col("edge_ord") == 0, F.array(F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi")))).otherwise(F.array(F.struct(F.lit(0.0).alias("lo"), F.lit(0.3).alias("hi"))))).withColumn("note", F.lit(" "))
    got = {r.edge_ord: (r.status, r.layer) for r in routes.layer_status(rows, inventory.line_of(), []).collect()}
    assert got == {0: ("done", "(unlabelled)"), 1: ("partial", None), 2: ("base", None), 3: ("base", None)}
    hidden = routes.layer_status(rows, inventory.line_of(), [(0.0, 0.0005, 30.0)]).where("edge_ord = 0").first()
    assert hidden.status == "base"
    assert "<polyline" in sinks.svg(routes.layer_status(rows, inventory.line_of(), []), inventory.line_of(), {})


def test_gpx_reading_and_writing(spark, tmp_path):
    head = '<?xml version="1.0"?><gpx xmlns="http://www.topografix.com/GPX/1/1">'
    (tmp_path / "a - Mar 5, 2024.gpx").write_text(f'{head}<trk><name>  </name></trk><trk><name>Walk</name><trkseg><trkpt lat="1" lon="2"><ele>3</ele><time>2024-03-05T00:00:10Z</time></trkpt><trkpt lat="x" lon="2"/><trkpt lat="1.5" lon="2"><time>bad</time></trkpt></trkseg><trkseg><trkpt lat="3" lon="4"/></trkseg></trk></gpx>')
    rows = sorted(map(tuple, gpx.read_fixes(spark, f"file://{tmp_path}/*.gpx").collect()))
    assert [r[1:5] for r in rows] == [(0, 0, 1.0, 2.0), (0, 2, 1.5, 2.0), (1, 0, 3.0, 4.0)] and rows[0][5] == 1709596810.0 and rows[1][5] is None
    assert gpx.track_names(spark, f"file://{tmp_path}/*.gpx").first().name == "Walk" and len(gpx.digests(spark, f"file://{tmp_path}/*.gpx").first().digest) == 64
    df = spark.createDataFrame([("a - Mar 5, 2024 (2).gpx",), ("a - Foo 5, 2024.gpx",)], "n string")
    assert [r[0] for r in df.select(gpx.date_in_name(F.col("n"))).collect()] == ["2024-03-05", None]
    pts = spark.createDataFrame([(0, 1.0, 2.0, 3.0), (1, 1.0, 2.0, 3.0), (2, 1.5, 2.0, None)], "ord int, lat double, lon double, ele double")
    cues = spark.createDataFrame([(0, 1.0, 2.0, "Turn <right> & go")], "ord int, lat double, lon double, text string")
    text = sinks.gpx(pts, cues, "A & B")
    assert text.count("<trkpt") == 2 and "&lt;right&gt; &amp; go" in text and "<ele>3.0</ele>" in text
    sinks.replace_file(spark, f"file://{tmp_path}/out.gpx", text)
    sinks.replace_file(spark, f"file://{tmp_path}/out.gpx", text)
    assert gpx.read_fixes(spark, f"file://{tmp_path}/out.gpx").count() == 2


def test_network_files(spark, tmp_path):
    (tmp_path / "g.graphml").write_text(
        '<?xml version="1.0"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="d0" for="node" attr.name="x"/><key id="d1" for="node" attr.name="y"/><key id="d2" for="edge" attr.name="name"/><key id="d3" for="edge" attr.name="length"/><key id="d4" for="edge" attr.name="geometry"/>'
        '<graph><node id="1"><data key="d0">0.0</data><data key="d1">1.0</data></node><node id="2"><data key="d0">0.1</data><data key="d1">1.0</data></node>'
        "<edge source=\"1\" target=\"2\" id=\"0\"><data key=\"d2\">['A', 'B']</data><data key=\"d3\">12.5</data><data key=\"d4\">LINESTRING (0 1, 0.05 1.1, 0.1 1)</data></edge></graph></graphml>"
    )
    n, e = networks.read_graphml(spark, f"file://{tmp_path}/g.graphml")
    r = e.first()
    assert n.count() == 2 and r.tags["name"] == ["A", "B"] and r.length == 12.5 and len(r.geometry) == 3
    (tmp_path / "x.osm").write_text(
        '<osm><node id="1" lat="0" lon="0"/><node id="2" lat="0" lon="0.001"/><node id="3" lat="0" lon="0.002"/><node id="4" lat="0.001" lon="0.001"/>'
        '<way id="9"><nd ref="1"/><nd ref="2"/><nd ref="3"/><tag k="highway" v="residential"/><tag k="name" v="M"/></way><way id="8"><nd ref="2"/><nd ref="4"/><tag k="highway" v="path"/></way>'
        '<way id="7"><nd ref="1"/><nd ref="4"/><tag k="highway" v="motorway"/></way></osm>'
    )
    n, e = networks.simplified(*(lambda p: (p[0], networks.wanted(p[1])))(networks.read_osm(spark, f"file://{tmp_path}/x.osm")))
    assert sorted((r.u, r.v) for r in e.collect()) == [("1", "2"), ("2", "3"), ("2", "4")] and n.count() == 4
    assert e.agg(F.sum("length")).first()[0] == pytest.approx(222.64 + 110.54, abs=0.1)
    (tmp_path / "zone.json").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[-1, -1], [0.0015, -1], [0.0015, 1], [-1, 1], [-1, -1]]]}}]}))
    rings = networks.read_zone(spark, f"file://{tmp_path}/zone.json")
    assert networks.within(n, rings, "x", "y").count() == 3
    (tmp_path / "bad.json").write_text('{"type": "Point"}')
    with pytest.raises(ValueError):
        networks.read_zone(spark, f"file://{tmp_path}/bad.json")
    (tmp_path / "store.json").write_text(json.dumps({"walked": {"a": {"date": "2024-01-01"}, "b": {"intervals": [[0, 0.5]]}}, "imports": {"d": {"raw_m": 5.0}}}))
    got = {r.coverage_id: [tuple(x) for x in r.intervals] for r in networks.read_store(spark, f"file://{tmp_path}/store.json").collect()}
    assert got == {"a": [(0.0, 1.0)], "b": [(0.0, 0.5)]} and networks.read_imports(spark, f"file://{tmp_path}/store.json").first().raw_m == 5.0
    text = sinks.store_json(networks.read_store(spark, f"file://{tmp_path}/store.json"), {"schema_version": 2})
    assert json.loads(text)["walked"]["b"]["intervals"] == [[0.0, 0.5]]
    (tmp_path / "off.csv").write_text('street,st_type,layer,active,line\nMAIN,ST,S,true,"LINESTRING (0 0, 0.001 0)"\nUNNAMED 5,,S,true,"LINESTRING (0 0, 1 0)"\nOLD,ST,S,false,"LINESTRING (0 0, 1 0)"\nRAMPART,ST,s,TRUE,"LINESTRING (0 0, 0.001 0)"\nBAY,TUNL,S,true,"LINESTRING (0 0, 1 0)"\nI-80 W,,S,true,"LINESTRING (0 0, 1 0)"\nMAIN ON RAMP,,S,true,"LINESTRING (0 0, 1 0)"\nODD,ST,S,1,"LINESTRING (0 0, 1 0)"\n')
    off = networks.read_official(spark, f"file://{tmp_path}/off.csv", ["S"]).collect()
    assert sorted((r.name, round(r.m, 1)) for r in off) == [("main street", 111.3), ("rampart street", 111.3)]
    asked = []
    n150 = spark.createDataFrame([(str(i), i, 0.0, 0.0, None) for i in range(150)], NODES)
    assert networks.fetch_elevations(n150, spark.createDataFrame([], "node_id string, elevation double"), lambda p: [None if i % 2 else 7.0 for i in range(len(p))], pause=0.0).agg(F.sum("elevation")).first()[0] == 525.0
    assert asked == []


def test_names_fold_cases_and_cells_lose_no_pair(spark):
    names_ = ["Große  Straße", "ΟΔΟΣ", "Kadıköy", " ÉTÉ "]
    rows = spark.createDataFrame([(x,) for x in names_], "x string")
    assert [r.n for r in rows.select(names.normalized_name(F.col("x"), ()).alias("n")).collect()] == [" ".join(x.split()).casefold() for x in names_]
    rng = random.Random(5)
    spots = [(str(i), i, rng.choice("ab"), lat + rng.uniform(0, 0.003), rng.uniform(-0.003, 0.003), rng.uniform(50, 100)) for i in range(300) for lat in [rng.choice([-60.0, 0.0, 37.7])]]
    cols = "id string, ord int, name string, lat double, lon double, length double"
    old, new = spots[:150], spots[150:]
    got = {r.old_id: r.new_id for r in progress.rekey(spark.createDataFrame(old, cols), spark.createDataFrame(new, cols)).collect()}
    far = lambda p, q: math.hypot((p[4] - q[4]) * 111320 * math.cos(math.radians((p[3] + q[3]) / 2)), (p[3] - q[3]) * 110540)
    near = {p[0]: min(((far(p, q), q[1], q[0]) for q in new if p[2] == q[2] and far(p, q) < 40 and abs(p[5] - q[5]) <= max(20, 0.35 * p[5])), default=(0, 0, None))[2] for p in old}
    assert got == near and any(near.values())


def test_streamed_evidence(spark, tmp_path):
    src = f"file://{tmp_path}/in"
    spark.createDataFrame([("a", 0.0, 0.4, "2024-01-02"), ("a", 0.3, 0.6, "2024-01-01"), ("b", 0.9, 1.5, None)], "coverage_id string, lo double, hi double, date string").write.parquet(src)
    stream = spark.readStream.schema("coverage_id string, lo double, hi double, date string").parquet(src)
    q = evidence.progress(stream).writeStream.format("memory").queryName("seen").outputMode("update").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.coverage_id: r for r in spark.table("seen").collect()}
    assert got["a"].frac == pytest.approx(0.6) and got["a"].date == "2024-01-01" and got["b"].frac == pytest.approx(0.1)
    evidence.upsert(stream, f"file://{tmp_path}/table", f"{tmp_path}/c2").awaitTermination(120)
    assert spark.read.parquet(f"file://{tmp_path}/table/version=0").count() == 2


def test_commands_from_snapshot_to_plan(spark, tmp_path):
    e, n = street_grid(spark, 4)
    named, left = inventory.prepare(e, n, zones=())
    zone = f"file://{tmp_path}/zone"
    sinks.write_snapshot(n, named, zone)
    left.write.parquet(f"{zone}/audit")
    z = cli.Zone(spark, zone)
    pts = "".join(f'<trkpt lat="0.00002" lon="{i * 5 / 111320}"/>' for i in range(67))
    (tmp_path / "w.gpx").write_text(f"<gpx><trk><trkseg>{pts}</trkseg></trk></gpx>")
    args = lambda verb, *more: cli.parser().parse_args([verb, "--zone", zone, "--date", "2024-05-01", "--note", "n", *more])
    run = lambda verb, *more: cli.VERBS[verb](z, args(verb, *more)).collect()
    first = run("import", "--source", f"file://{tmp_path}/w.gpx")
    assert first[0].new_complete_m > 300 and run("import", "--source", f"file://{tmp_path}/w.gpx") == []
    assert run("status")[0].n_complete == 3 and len(run("log")) == 1 and run("review")[0].flags == []
    assert {r.name for r in run("remaining")} == {f"row{i}" for i in (1, 2, 3)} | {f"col{i}" for i in range(4)}
    assert len(run("audit")) >= 1 and run("total")[0].n_required == 24
    run("plan", "--out", f"file://{tmp_path}/day", "--km", "1", "--style", "efficient")
    steps = json.loads((tmp_path / "day.route.json").read_text())
    drawn, track = json.loads((tmp_path / "day.geojson").read_text())["features"], (tmp_path / "day.gpx").read_text()
    assert len(steps) == len(drawn) > 3 and [f["properties"]["deadhead"] for f in drawn] == [s[3] for s in steps]
    ends = [f["geometry"]["coordinates"] for f in drawn]
    assert all(a[-1] == b[0] for a, b in zip(ends, ends[1:], strict=False))
    assert "Start on" in track and "<name>End</name>" in track and track.count("<trkpt") == len(steps) + 1
    with pytest.raises(SystemExit):
        run("rebuild", "--source", f"file://{tmp_path}/w.gpx")
    for name in ("Hill - May 3, 2024.gpx", "copy - May 4, 2024.gpx"):
        (tmp_path / name).write_text((tmp_path / "w.gpx").read_text())
    made = run("rebuild", "--source", f"file://{tmp_path}/*2024.gpx", "--force")
    assert [(r.source, r.date, r.note) for r in made] == [("Hill - May 3, 2024.gpx", "2024-05-03", "Hill - May 3, 2024")]
    assert run("status")[0].latest == "2024-05-03" and not run("status")[0].other_network
    assert len(run("done", "--source", f"file://{tmp_path}/day.route.json")) > 0
    run("map", "--out", f"file://{tmp_path}/m")
    run("render", "--out", f"file://{tmp_path}/m")
    assert "FeatureCollection" in (tmp_path / "m.geojson").read_text() and "<svg" in (tmp_path / "m.svg").read_text()


def test_catalogue_has_sql_for_what_sql_can_say():
    assert set(queries.ORACLES) <= set(queries.QUERIES) and len(queries.QUERIES) >= 50
    assert set(queries.QUERIES) - set(queries.ORACLES) == {
        "prepared_inventory", "observation_aliases", "stationary_filter", "city_total_dedupe", "plan_efficient", "plan_snake", "chunk_disk", "twin_collapse", "stair_ascent", "map_match", "route_cues"
    }
