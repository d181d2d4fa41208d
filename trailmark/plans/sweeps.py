"""Snake plans: sweep the parallel streets of a slab end to end, one after another."""

from __future__ import annotations

import math
from collections import defaultdict

from .graphs import Edge, Graph, empty_plan, inspect, path_to, shortest


def axes(g: Graph) -> tuple[float, float]:
    """The two main street directions, degrees in [0, 180): circular mean of four times the bearings."""
    s = c = 0.0
    for e in g.edges:
        b = g.bearing(e.u, e.v)
        if b is not None:
            s += math.sin(math.radians(4 * b))
            c += math.cos(math.radians(4 * b))
    first = (math.degrees(math.atan2(s, c)) / 4) % 90
    return first, first + 90


def axis_gap(a: float, b: float) -> float:
    d = abs(a - b) % 180
    return min(d, 180 - d)


def end_to_end(g: Graph, edges: list[Edge]) -> list[tuple]:
    """A street's edges as steps from one end to the other; with forks or loops, as an open inspection."""
    part = Graph()
    for e in edges:
        for n in (e.u, e.v):
            part.add_node(n, **g.nodes[n])
        part.add(e.u, e.v, e.key, **e.data)
    ends = [n for n in part.nodes if part.degree(n) == 1]
    if len(ends) == 2 and all(part.degree(n) <= 2 for n in part.nodes):
        out, at, used = [], ends[0], set()
        while len(out) < len(edges):
            e = next(x for x in part.near[at] if id(x) not in used)
            used.add(id(e))
            out.append((at, e.other(at), e.key))
            at = e.other(at)
        return out
    return [(a, b, k) for a, b, k, _ in inspect(part, open_route=True)["route"]]


def sweep(g: Graph, edge_id, required, start=None, target_km: float = 8.0, axis: str = "ns", straight_km: float = 1.5, done: set | None = None, _tried: tuple = ()) -> dict:
    """Streets along an axis near start, end to end, until target_km of walking in all. Empty: no such streets on either axis."""
    done = done or set()
    if not g.edges:
        return empty_plan(start)
    start = start if start in g.nodes else next(iter(g.nodes))
    first, second = axes(g)
    north = first if axis_gap(first, 0) <= axis_gap(second, 0) else second
    target, other = (north, (north + 90) % 180) if axis == "ns" else ((north + 90) % 180, north)
    x0, y0 = g.xy(start)
    k = 111320.0 * math.cos(math.radians(y0))
    t = math.radians(target)

    def local(n) -> tuple[float, float]:
        """(along the axis, across it) in metres from the start."""
        x, y = (g.xy(n)[0] - x0) * k, (g.xy(n)[1] - y0) * 110540.0
        return x * math.sin(t) + y * math.cos(t), x * math.cos(t) - y * math.sin(t)

    place = {n: local(n) for n in g.nodes if g.xy(n)}
    ahead = sum(a > 0 for a, _ in place.values()) >= sum(a < 0 for a, _ in place.values())
    side = 1 if ahead else -1
    slab = {n for n, (a, _) in place.items() if -1 <= side * a <= straight_km * 1000 + 1}
    by_name: dict = defaultdict(list)
    for e in g.edges:
        b = g.bearing(e.u, e.v)
        if e.u in slab and e.v in slab and b is not None and edge_id(e) not in done and required(e) and axis_gap(b, target) < axis_gap(b, other):
            names = e.data.get("name")
            by_name[tuple(sorted(names)) if isinstance(names, list | tuple) else (e.name,)].append(e)
    streets = []
    for edges in by_name.values():
        part = Graph()
        for e in edges:
            part.add(e.u, e.v, e.key, **e.data)
        for nodes in part.components():
            steps = end_to_end(g, [e for e in edges if e.u in nodes])
            length = sum(g.cheapest(a, b).length(missing=0.0) for a, b, _ in steps)
            streets.append((sum(place[n][1] for n in nodes) / len(nodes), length, steps, nodes))
    if not streets:
        tried = (*_tried, axis)
        turned = "ew" if axis == "ns" else "ns"
        return {**empty_plan(start), "axis_deg": round(target, 1)} if turned in tried else sweep(g, edge_id, required, start, target_km, turned, straight_km, done, tried)
    streets.sort(key=lambda s: s[0])
    here = min(range(len(streets)), key=lambda i: min(math.hypot(*place[n]) for n in streets[i][3]))
    step = 1 if sum(s[1] for s in streets[here + 1 :]) >= sum(s[1] for s in streets[:here]) else -1
    chosen, total, i = [], 0.0, here
    while 0 <= i < len(streets):
        chosen.append(streets[i][2])
        total += streets[i][1]
        if total >= target_km * 1000:
            break
        i += step

    def assemble() -> tuple[list[tuple], float, float]:
        at, route, need, dead = start, [], 0.0, 0.0
        for steps in chosen:
            dist, by = shortest(g, [at])
            a, b = steps[0][0], steps[-1][1]
            entry = a if dist.get(a, math.inf) <= dist.get(b, math.inf) else b
            for p, q, e in path_to(by, entry):
                route.append((p, q, e.key, True))
                dead += e.length(missing=0.0)
            for p, q, key in steps if entry == a else [(q, p, key) for p, q, key in reversed(steps)]:
                route.append((p, q, key, False))
                need += next((e for e in g.between(p, q) if e.key == key), g.cheapest(p, q)).length(missing=0.0)
            at = b if entry == a else a
        return route, need, dead

    route, need, dead = assemble()
    while len(chosen) > 1 and need + dead > max(0.1, target_km) * 1000:
        chosen.pop()
        route, need, dead = assemble()
    return {
        "route": route, "required_m": need, "deadhead_m": dead, "total_m": need + dead, "efficiency": need / (need + dead) if need + dead else 1.0, "n_odd_nodes": 0,
        "endpoints": (route[0][0], route[-1][1]) if route else (start, start), "n_streets": len(chosen), "axis_deg": round(target, 1),
    }


def plan(g: Graph, edge_id, required, walked: set, start=None, target_km: float = 8.0, style: str = "snake", axis: str = "ns", straight_km: float = 1.4, loop: bool = False) -> dict:
    """A day's plan. A snake that finds too little falls back to an efficient outing; loop closes it by the shortest way."""
    from .graphs import cover

    out = None
    if style == "snake":
        out = sweep(g, edge_id, required, start, target_km, axis, straight_km, walked)
        if out["required_m"] < min(1000.0, 0.25 * target_km * 1000):
            out = None
    if out is None:
        out = cover(g, walked, edge_id, required, start, target_km)
    if loop and out["route"]:
        dist, by = shortest(g, [out["route"][-1][1]])
        home = out["route"][0][0]
        if home not in dist:
            raise ValueError("the way back isn't connected")
        back = path_to(by, home)
        out["route"] += [(a, b, e.key, True) for a, b, e in back]
        out["deadhead_m"] += sum(e.length() for *_, e in back)
        out["total_m"] = out["required_m"] + out["deadhead_m"]
        out["endpoints"] = (home, home)
    return out
