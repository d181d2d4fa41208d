"""Small street graphs in memory, for one outing at a time: shortest paths, inspection routes, sweeps.

These run on one bounded component (a day's walk), on the driver or as one grouped task an outing
(see outings.py). Everything that looks at a whole city is a DataFrame query in operators/.
"""

from __future__ import annotations

import heapq
import math
import warnings
from collections import defaultdict
from dataclasses import dataclass, field

from .matching_pairs import min_weight_pairs

LARGE_ODD = 600


@dataclass
class Edge:
    u: object
    v: object
    key: int
    data: dict = field(default_factory=dict)

    def other(self, n):
        return self.v if n == self.u else self.u

    def length(self, weight: str = "length", missing: float = 1.0) -> float:
        w = self.data.get(weight)
        return missing if w is None else float(w)

    @property
    def name(self) -> str:
        n = self.data.get("name")
        n = (n[0] if n else "") if isinstance(n, list | tuple) else n
        return str(n or "").strip()


class Graph:
    """Undirected, with parallel edges told apart by key."""

    def __init__(self) -> None:
        self.nodes: dict = {}
        self.near: dict = defaultdict(list)
        self.edges: list[Edge] = []

    def add_node(self, n, **data) -> None:
        self.nodes.setdefault(n, {}).update(data)

    def add(self, u, v, key: int | None = None, **data) -> Edge:
        self.add_node(u)
        self.add_node(v)
        if key is None:
            taken = {e.key for e in self.between(u, v)}
            key = next(k for k in range(len(taken) + 1) if k not in taken)
        e = Edge(u, v, key, data)
        self.edges.append(e)
        self.near[u].append(e)
        if v != u:
            self.near[v].append(e)
        return e

    def between(self, u, v) -> list[Edge]:
        return [e for e in self.near[u] if e.other(u) == v]

    def cheapest(self, u, v, weight: str = "length") -> Edge | None:
        return min(self.between(u, v), key=lambda e: (e.length(weight), e.key), default=None)

    def degree(self, n) -> int:
        return sum(2 if e.u == e.v else 1 for e in self.near[n])

    def part(self, nodes) -> Graph:
        nodes, g = set(nodes), Graph()
        for n in self.nodes:
            if n in nodes:
                g.add_node(n, **self.nodes[n])
        for e in self.edges:
            if e.u in nodes and e.v in nodes:
                g.add(e.u, e.v, e.key, **e.data)
        return g

    def components(self) -> list[set]:
        out, seen = [], set()
        for start in self.nodes:
            if start in seen:
                continue
            found, todo = {start}, [start]
            while todo:
                n = todo.pop()
                for e in self.near[n]:
                    m = e.other(n)
                    if m not in found:
                        found.add(m)
                        todo.append(m)
            seen |= found
            out.append(found)
        return out

    def largest(self) -> Graph:
        return self.part(max(self.components(), key=len, default=set()))

    def with_work(self, open_, start=None) -> Graph:
        """The piece to plan on: the start's, if it has open edges, else the one with the most metres of them."""
        pieces = [self.part(x) for x in self.components()]
        left = lambda g: sum(e.length(missing=0.0) for e in g.edges if open_(e))
        about = next((g for g in pieces if start is not None and start in g.nodes), None)
        return about if about is not None and left(about) > 0 else max(pieces, key=left, default=Graph())

    def xy(self, n) -> tuple[float, float] | None:
        d = self.nodes.get(n, {})
        return (float(d["x"]), float(d["y"])) if d.get("x") is not None and d.get("y") is not None else None

    def bearing(self, u, v) -> float | None:
        a, b = self.xy(u), self.xy(v)
        if a is None or b is None:
            return None
        return math.degrees(math.atan2((b[0] - a[0]) * math.cos(math.radians((a[1] + b[1]) / 2)), b[1] - a[1])) % 360

    def nearest(self, lat: float, lon: float):
        k = math.cos(math.radians(lat))
        d = lambda n: ((self.xy(n)[0] - lon) * k) ** 2 + (self.xy(n)[1] - lat) ** 2
        return min((n for n in self.nodes if self.xy(n)), key=d, default=None)

    def total_km(self) -> float:
        return sum(e.length(missing=0.0) for e in self.edges) / 1000


def shortest(g: Graph, sources, weight: str = "length", cutoff: float | None = None, cost=None) -> tuple[dict, dict]:
    """(distance, edge by which each node is reached) from the nearest of the sources, no farther than cutoff.

    cost(edge, from_node) overrides weight; None forbids the edge.
    """
    dist, by = {}, {}
    heap = [(0.0, i, s, None) for i, s in enumerate(sources) if s in g.nodes]
    count = len(heap)
    while heap:
        d, _, n, e = heapq.heappop(heap)
        if n in dist:
            continue
        dist[n], by[n] = d, e
        for nxt in g.near[n]:
            w = nxt.length(weight) if cost is None else cost(nxt, n)
            m = nxt.other(n)
            if w is not None and m not in dist and (cutoff is None or d + w <= cutoff):
                count += 1
                heapq.heappush(heap, (d + w, count, m, nxt))
    return dist, by


def path_to(by: dict, n) -> list[tuple]:
    """(from, to, edge) steps to n."""
    out = []
    while by.get(n) is not None:
        e = by[n]
        m = e.other(n)
        out.append((m, n, e))
        n = m
    return out[::-1]


def trail(g: Graph, start) -> list[tuple]:
    """An Euler trail (from, to, edge) from start that prefers to stay on its street and go straight (Hierholzer)."""
    left = {n: list(es) for n, es in g.near.items()}
    used: set[int] = set()
    stack, out = [(start, None, None)], []
    while stack:
        n, came, e = stack[-1]
        options = [x for x in left.get(n, ()) if id(x) not in used]
        left[n] = options
        if not options:
            stack.pop()
            if e is not None:
                out.append((came, n, e))
            continue
        heading = g.bearing(came, n) if came is not None else None

        def cost(x, n=n, e=e, heading=heading):
            if e is not None and x.name and x.name == e.name:
                return -1000.0
            b = g.bearing(n, x.other(n))
            return 0.0 if heading is None or b is None else abs((b - heading + 180) % 360 - 180)

        nxt = min(options, key=cost)
        used.add(id(nxt))
        stack.append((nxt.other(n), n, nxt))
    return out[::-1]


def empty_plan(start=None) -> dict:
    return {"route": [], "required_m": 0.0, "deadhead_m": 0.0, "total_m": 0.0, "efficiency": 1.0, "n_odd_nodes": 0, "endpoints": (start, start), "n_streets": 0}


def _summed(g: Graph, route: list[tuple], odd: int, weight: str) -> dict:
    need = sum(e.length(weight) for *_, e, dead in route if not dead)
    dead = sum(e.length(weight) for *_, e, dead in route if dead)
    return {
        "route": [(a, b, e.key, d) for a, b, e, d in route], "required_m": need, "deadhead_m": dead, "total_m": need + dead, "efficiency": need / (need + dead) if need + dead else 1.0,
        "n_odd_nodes": odd, "endpoints": (route[0][0], route[-1][1]) if route else (None, None), "n_streets": len({e.name for *_, e, d in route if not d and e.name}),
    }


def inspect(g: Graph, weight: str = "length", start=None, open_route: bool = False, force_start=None) -> dict:
    """Shortest walk over every edge (Chinese postman): odd nodes are paired at least cost, paths between pairs walked again.

    An open route leaves the best two odd nodes unpaired, by two free terminals in the matching. A
    forced start is one of the ends; at an even node a closed walk competes with open ones from there.
    """
    g_edges = [e for e in g.edges]
    if not g_edges:
        return empty_plan(force_start or start)
    live = g.part({n for e in g_edges for n in (e.u, e.v)})
    if len(live.components()) > 1:
        raise ValueError("the graph isn't connected")
    odd = [n for n in live.nodes if live.degree(n) % 2]
    if len(odd) > LARGE_ODD:
        warnings.warn(f"{len(odd)} odd nodes: matching takes their number cubed", stacklevel=2)
    forced = force_start if force_start in live.nodes else None

    def walk(terminals: list, begin) -> tuple[float, list[tuple]]:
        """With `terminals` joining the odd nodes at no cost; begin: where the walk starts, if it matters."""
        ends = list(odd)
        for t in terminals:  # a terminal at a node flips its parity
            if t is not None:
                ends = [n for n in ends if n != t] if t in ends else [*ends, t]
        free = sum(t is None for t in terminals)
        reach = {n: shortest(live, [n], weight) for n in ends}
        size = len(ends) + free
        cost = [[None] * size for _ in range(size)]
        for i in range(size):
            for j in range(size):
                if i != j:
                    if i < len(ends) and j < len(ends):
                        cost[i][j] = reach[ends[i]][0].get(ends[j])
                    elif i < len(ends) or j < len(ends):
                        cost[i][j] = 0.0
        extra, alone = [], []
        for i, j in min_weight_pairs(cost):
            if j < len(ends):
                extra += path_to(reach[ends[i]][1], ends[j])
            else:
                alone.append(ends[i])
        double = live.part(live.nodes)
        first = {id(e): False for e in double.edges}
        for a, b, e in extra:
            first[id(double.add(a, b, -1 - len(double.edges), **e.data, _of=e.key))] = True
        at = begin if begin is not None else alone[0] if alone else start if start in live.nodes else g_edges[0].u
        steps = trail(double, at)
        route = []
        for a, b, e in steps:
            dead = first[id(e)]
            route.append((a, b, Edge(a, b, e.data.get("_of", e.key), {k: v for k, v in e.data.items() if k != "_of"}), dead))
        return sum(e.length(weight) for _, _, e in extra), route

    if forced is None:
        terminals = [None, None] if open_route and odd else []
        return _summed(live, walk(terminals, None)[1], len(odd), weight)
    if not open_route:
        return _summed(live, walk([], forced)[1], len(odd), weight)
    # open from a fixed node: the walk ends at the best node; one end is free, the other is the start
    best = walk([forced, None], forced) if odd or forced else walk([], forced)
    closed = walk([], forced)
    return _summed(live, min((best, closed), key=lambda x: x[0])[1], len(odd), weight)


def cover(g: Graph, walked: set, edge_id, required, start=None, target_km: float = 8.0, weight: str = "length", open_route: bool = True) -> dict:
    """An outing over ways not yet covered (rural postman): grow a connected piece to about target_km, then inspect it.

    The nearest open way joins next, with the way to it; connectors count twice while growing, as
    they are mostly walked both ways. Growth stops at 0.65 of the target, or before a way that would
    go beyond it.
    """
    need = {(frozenset((e.u, e.v)), e.key): e for e in g.edges if required(e) and edge_id(e) not in walked}
    if not need:
        return empty_plan(start)
    if start is None or start not in g.nodes:
        start = next(iter(need.values())).u
    target = max(target_km, 0.1) * 1000
    piece, inside, chosen, total, seed = Graph(), {start}, set(), 0.0, 300.0
    piece.add_node(start, **g.nodes[start])
    held: set = set()

    def take(e: Edge) -> bool:
        k = (frozenset((e.u, e.v)), e.key)
        if k in held:
            return False
        held.add(k)
        for n in (e.u, e.v):
            piece.add_node(n, **g.nodes[n])
        piece.add(e.u, e.v, e.key, **e.data)
        return True

    open_ = dict(need)
    while total < 0.65 * target and open_:
        hit = None
        for cut in (seed, seed * 6, None):
            dist, by = shortest(g, inside, weight, cut)
            options = [(min(dist.get(e.u, math.inf), dist.get(e.v, math.inf)), i, k) for i, (k, e) in enumerate(open_.items())]
            d, _, k = min(options)
            if d < math.inf:
                hit, seed = (d, k), max(300.0, 3 * d)
                break
        if hit is None:
            break
        d, k = hit
        e = open_[k]
        if chosen and total + 2 * d + e.length(weight) > target:
            break
        del open_[k]
        entry = e.u if dist.get(e.u, math.inf) <= dist.get(e.v, math.inf) else e.v
        for a, b, step in path_to(by, entry):
            inside |= {a, b}
            if take(step):
                total += 2 * step.length(weight)
        take(e)
        chosen.add(k)
        total += e.length(weight)
        inside |= {e.u, e.v}
    plan = inspect(piece, weight, open_route=open_route, force_start=start)
    route, seen = [], set()
    for a, b, key, dead in plan["route"]:
        k = (frozenset((a, b)), key)
        e = next(x for x in piece.between(a, b) if x.key == key)
        dead = dead or k not in chosen or k in seen
        seen.add(k)
        route.append((a, b, e, dead))
    return _summed(g, route, plan["n_odd_nodes"], weight) if route else empty_plan(start)


def ascent(g: Graph, start, summit, discount: float = 0.6, climb: float = 4.0) -> list | None:
    """Nodes of the cheapest way up: named stairs are cheaper, climbing elsewhere costs extra. None if there is none."""
    z = lambda n: float(g.nodes[n].get("elevation") or 0.0)

    def cost(e: Edge, n) -> float:
        length = e.length(missing=0.0)
        steps = "steps" in (e.data.get("highway") if isinstance(e.data.get("highway"), list) else [e.data.get("highway")])
        return length * discount if steps and e.name else length + climb * max(0.0, z(e.other(n)) - z(n))

    if start not in g.nodes or summit not in g.nodes:
        return None
    dist, by = shortest(g, [start], cost=cost)
    return [start, *(b for _, b, _ in path_to(by, summit))] if summit in dist else None


def chunks(g: Graph, target_km: float) -> list[list[Edge]]:
    """All edges in connected chunks of about target_km each."""
    done: set[int] = set()
    out = []
    for first in g.edges:
        if id(first) in done:
            continue
        chunk, total, todo = [], 0.0, [first]
        while todo and total < target_km * 1000:
            e = todo.pop()
            if id(e) in done:
                continue
            done.add(id(e))
            chunk.append(e)
            total += e.length()
            todo += [x for n in (e.u, e.v) for x in g.near[n] if id(x) not in done]
        out.append(chunk)
    return out


def disk(g: Graph, start, target_km: float, weight: str = "length") -> Graph:
    """The compact connected piece around start whose inner edges add up to about target_km."""
    dist, _ = shortest(g, [start], weight)
    inside, total = set(), 0.0
    for n in sorted(dist, key=dist.get):
        total += sum(e.length() for e in g.near[n] if e.other(n) in inside or e.other(n) == n)
        inside.add(n)
        if total >= target_km * 1000:
            break
    return g.part(inside)


def without_twins(g: Graph, perp_m: float = 20.0) -> tuple[Graph, int]:
    """g without unnamed roads that run beside another within perp_m, where the way round stays short.

    Named ways, stairs and paths always stay. Edges go in order, each looking at what is left.
    """
    lat0 = sum(g.xy(n)[1] for n in g.nodes if g.xy(n)) / max(1, sum(1 for n in g.nodes if g.xy(n)))
    kx = 111320.0 * math.cos(math.radians(lat0))
    info = {}
    for e in g.edges:
        a, b = g.xy(e.u), g.xy(e.v)
        if a and b:
            ax, ay, bx, by = a[0] * kx, a[1] * 110540.0, b[0] * kx, b[1] * 110540.0
            m = math.hypot(bx - ax, by - ay)
            if m > 0:
                info[id(e)] = ((ax + bx) / 2, (ay + by) / 2, (bx - ax) / m, (by - ay) / m, m)
    cells = defaultdict(list)
    for e in g.edges:
        if id(e) in info:
            cells[int(info[id(e)][0] // 100), int(info[id(e)][1] // 100)].append(e)
    gone: set[int] = set()
    for e in g.edges:
        highway = e.data.get("highway")
        kinds = set(highway if isinstance(highway, list) else [highway])
        if id(e) not in info or e.name or kinds & {"steps", "path"}:
            continue
        x, y, dx, dy, m = info[id(e)]
        reach = int(m // 100) + 2
        twins = (
            o
            for i in range(-reach, reach + 1)
            for j in range(-reach, reach + 1)
            for o in cells.get((int(x // 100) + i, int(y // 100) + j), ())
            if o is not e and id(o) not in gone
        )
        for o in twins:
            ox, oy, px, py, om = info[id(o)]
            along, side = (ox - x) * dx + (oy - y) * dy, abs((ox - x) * dy - (oy - y) * dx)
            if abs(dx * px + dy * py) >= math.cos(math.radians(25)) and 0.5 < side <= perp_m and abs(along) <= (m + om) / 2:
                cut = 2.5 * e.length() + 10
                dist, _ = shortest(g, [e.u], cutoff=cut, cost=lambda s, _n, e=e: None if s is e or id(s) in gone else s.length())
                if dist.get(e.v, math.inf) <= cut:
                    gone.add(id(e))
                    break
    out = Graph()
    for e in g.edges:
        if id(e) not in gone:
            for n in (e.u, e.v):
                out.add_node(n, **g.nodes[n])
            out.add(e.u, e.v, e.key, **e.data)
    return out, len(gone)


def elevation_stats(g: Graph, route: list[tuple]) -> dict:
    z = lambda n: float(g.nodes[n].get("elevation") or 0.0)
    out = dict.fromkeys(("required_m", "deadhead_m", "ascent_m", "descent_m", "deadhead_ascent_m"), 0.0)
    for a, b, key, dead in route:
        options = g.between(a, b)
        e = next((x for x in options if x.key == key), None) or g.cheapest(a, b)
        rise = z(b) - z(a)
        out["deadhead_m" if dead else "required_m"] += e.length() if e else 0.0
        out["ascent_m"] += max(0.0, rise)
        out["descent_m"] += max(0.0, -rise)
        out["deadhead_ascent_m"] += max(0.0, rise) if dead else 0.0
    return out
