"""Many outings at once: each request's piece of the network is one grouped task."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graphs import Edge, Graph, ascent, disk, inspect, without_twins
from .sweeps import plan

ROUTE = "group string, ord int, u string, v string, key int, deadhead boolean"
SUMMARY = "group string, streets int, required_m double, deadhead_m double, total_m double, n_odd_nodes int"


def to_graph(pdf: pd.DataFrame) -> Graph:
    """Edges with ends and elevations (u, v, key, length, ulon, ulat, vlon, vlat, name, highway, required, coverage_id, zu, zv)."""
    g = Graph()
    for r in pdf.sort_values("edge_ord").to_dict("records"):
        for s in "uv":
            g.add_node(r[s], x=r[f"{s}lon"], y=r[f"{s}lat"], elevation=r.get(f"z{s}"))
        name = r.get("name")
        g.add(r["u"], r["v"], int(r["key"]), length=r["length"], name=name if isinstance(name, str) else "", highway=r.get("highway"), required=bool(r.get("required")), coverage_id=r.get("coverage_id"))
    return g


def edge_id(e: Edge) -> str:
    u, v = sorted((str(e.u), str(e.v)))
    return e.data.get("coverage_id") or f"{u}-{v}-{e.key}"


def outings(edges: DataFrame, style: str = "efficient", target_km: float = 8.0) -> DataFrame:
    """ROUTE of a plan for each value of `group`, over its largest connected piece; groups are sizes of a zone."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        g = to_graph(pdf).largest()
        out = plan(g, edge_id, lambda e: e.data.get("required"), set(), target_km=target_km, style=style)
        return pd.DataFrame([(key[0], i, *step) for i, step in enumerate(out["route"])], columns=[x.split()[0] for x in ROUTE.split(", ")])

    return edges.groupBy("group").applyInPandas(run, ROUTE)


def summaries(edges: DataFrame, kind: str, target_km: float = 8.0) -> DataFrame:
    """SUMMARY a group: inspection, efficient, snake, disk, twins (edges dropped) or ascent."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        g = to_graph(pdf).largest()
        required = lambda e: e.data.get("required")
        first = next(iter(g.nodes))
        if kind == "inspection":
            out = inspect(g, open_route=True)
        elif kind == "disk":
            part = disk(g, first, target_km)
            out = {"n_streets": len(part.edges), "required_m": part.total_km() * 1000, "deadhead_m": 0.0, "total_m": part.total_km() * 1000, "n_odd_nodes": 0}
        elif kind == "twins":
            left, n = without_twins(g)
            out = {"n_streets": n, "required_m": left.total_km() * 1000, "deadhead_m": 0.0, "total_m": left.total_km() * 1000, "n_odd_nodes": 0}
        elif kind == "ascent":
            top = max(g.nodes, key=lambda n: (g.nodes[n].get("elevation") or 0.0, str(n)))
            way = ascent(g, first, top) or [first]
            m = sum(g.cheapest(a, b).length() for a, b in zip(way, way[1:], strict=False))
            out = {"n_streets": len(way) - 1, "required_m": m, "deadhead_m": 0.0, "total_m": m, "n_odd_nodes": 0}
        else:
            out = plan(g, edge_id, required, set(), target_km=target_km, style=kind)
        return pd.DataFrame([(key[0], out["n_streets"], out["required_m"], out["deadhead_m"], out["total_m"], out["n_odd_nodes"])], columns=[x.split()[0] for x in SUMMARY.split(", ")])

    return edges.groupBy("group").applyInPandas(run, SUMMARY)


def zones_of(placed: DataFrame, size: float = 0.01) -> DataFrame:
    """placed with `group`: square zones by the first end, so that each outing is one task."""
    return placed.withColumn("group", F.concat_ws(":", F.floor(F.col("ulon") / size).cast("string"), F.floor(F.col("ulat") / size).cast("string")))
