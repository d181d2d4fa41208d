"""Tables of the engine. Order columns (*_ord) carry what other tools keep as iteration order; they break every tie."""

POINT = "struct<lon:double,lat:double>"
LINE = f"array<{POINT}>"
NODES = "node_id string, node_ord long, x double, y double, elevation double"
EDGES = f"edge_ord long, u string, v string, key int, length double, osmid string, geometry {LINE}, tags map<string,array<string>>"
FIXES = "walk_id string, seg_ord int, fix_ord int, lat double, lon double, ts double"
SPANS = "coverage_id string, lo double, hi double, walk_id string, date string, note string"
WALKED = "coverage_id string, intervals array<struct<lo:double,hi:double>>, date string, note string, last_date string"
ROUTE = "route_id string, ord int, u string, v string, key int, deadhead boolean"
