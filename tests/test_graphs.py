"""Routes with known optima, and validity of every trail."""

import itertools
import random
from functools import lru_cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trailmark.plans.graphs import Graph, ascent, chunks, cover, disk, elevation_stats, inspect, path_to, shortest, without_twins
from trailmark.plans.matching_pairs import min_weight_pairs
from trailmark.plans.sweeps import axes, plan, sweep

always = lambda e: bool(e.name)
ident = lambda e: (frozenset((e.u, e.v)), e.key)


def grid(n, length=1.0):
    g = Graph()
    for r, c in itertools.product(range(n), repeat=2):
        g.add_node((r, c), x=c * 0.001, y=r * 0.001)
    for r, c in itertools.product(range(n), repeat=2):
        if c + 1 < n:
            g.add((r, c), (r, c + 1), length=length, name=f"row{r}")
        if r + 1 < n:
            g.add((r, c), (r + 1, c), length=length, name=f"col{c}")
    return g


def build(*edges):
    g = Graph()
    for u, v, m in edges:
        g.add(u, v, length=m, name=f"{u}{v}")
    return g


def check(g, route):
    assert all(a[1] == b[0] for a, b in itertools.pairwise(route))
    first = [(frozenset(s[:2]), s[2]) for s in route if not s[3]]
    assert sorted(map(str, first)) == sorted(str(ident(e)) for e in g.edges)


def test_checker_rejects_a_broken_trail():
    with pytest.raises(AssertionError):
        check(grid(2), [((0, 0), (0, 1), 0, False), ((1, 1), (1, 0), 0, False)])


def test_optima():
    assert inspect(grid(3))["total_m"] == 16
    assert inspect(grid(3), open_route=True)["total_m"] == 14
    assert inspect(grid(3), open_route=True, force_start=(1, 1))["total_m"] == 15
    square = build(("a", "b", 1), ("b", "c", 1), ("c", "d", 1), ("d", "a", 1), ("a", "c", 2**0.5))
    assert inspect(square)["deadhead_m"] == pytest.approx(2**0.5)
    assert inspect(build(("a", "b", 1), ("b", "c", 1)))["deadhead_m"] == 2
    lollipop = build(("a", "b", 1), ("b", "c", 1), ("c", "d", 1), ("d", "b", 1))
    assert inspect(lollipop, open_route=True, force_start="c")["deadhead_m"] == 1
    assert inspect(Graph())["route"] == []
    with pytest.raises(ValueError):
        inspect(build(("a", "b", 1), ("c", "d", 1)))


@pytest.mark.parametrize("n", [2, 3, 4, 5])
@pytest.mark.parametrize("open_route", [False, True])
def test_trails_are_valid(n, open_route):
    out = inspect(grid(n), open_route=open_route)
    check(grid(n), out["route"])
    assert out["required_m"] == len(grid(n).edges) and out["total_m"] == out["required_m"] + out["deadhead_m"]


def test_parallel_edges_keep_their_keys():
    g = Graph()
    for k in (0, 5, 7):
        g.add("a", "b", k, length=1.0 + k)
    check(g, inspect(g, open_route=True)["route"])


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 4), st.integers(0, 10**6))
def test_matching_costs_what_brute_force_does(half, seed):
    r, n = random.Random(seed), 2 * half
    w = [[None] * n for _ in range(n)]
    for i, j in itertools.combinations(range(n), 2):
        w[i][j] = w[j][i] = r.randint(0, 30) / 4

    @lru_cache(None)
    def best(mask):
        if mask == (1 << n) - 1:
            return 0
        i = next(i for i in range(n) if not mask >> i & 1)
        return min(w[i][j] + best(mask | 1 << i | 1 << j) for j in range(i + 1, n) if not mask >> j & 1)

    pairs = min_weight_pairs(w)
    assert sorted(x for p in pairs for x in p) == list(range(n))
    assert sum(w[i][j] for i, j in pairs) == pytest.approx(best(0))


def test_cover_reaches_both_islands():
    g = Graph()
    for i, n in enumerate("abcd"):
        g.add_node(n, x=i * 0.001, y=0.0)
    g.add("a", "b", length=100, name="one")
    g.add("b", "c", length=50)
    g.add("c", "d", length=100, name="two")
    out = cover(g, set(), ident, always, "a", 8)
    assert out["required_m"] == 200 and out["total_m"] == 250 and out["n_streets"] == 2
    assert all(a[1] == b[0] for a, b in itertools.pairwise(out["route"]))
    assert cover(g, {ident(e) for e in g.edges}, ident, always)["route"] == []
    assert cover(grid(5), set(), ident, always, (0, 0), 0.01)["total_m"] < cover(grid(5, 100.0), set(), ident, always, (0, 0), 1.0)["total_m"]


def test_snake_walks_each_street_of_its_axis_once():
    for axis, word in (("ns", "col"), ("ew", "row")):
        out = sweep(grid(5, 111.0), ident, always, (0, 0), 50, axis)
        mine = [s for s in out["route"] if not s[3]]
        assert len(mine) == 20 and out["n_streets"] == 5
        g = grid(5)
        assert all(next(e for e in g.between(a, b) if e.key == k).name.startswith(word) for a, b, k, _ in mine)
        assert all(a[1] == b[0] for a, b in itertools.pairwise(out["route"]))
    assert sweep(grid(5, 111.0), ident, always, (0, 0), 1.2)["total_m"] <= 1200
    first, second = axes(grid(3))
    assert min(first, 90 - first) == pytest.approx(0, abs=0.1) and second == first + 90


def test_plan_falls_back_and_closes_the_loop():
    out = plan(grid(4, 10.0), ident, always, set(), (0, 0), 8, "snake", loop=True)
    assert out["route"][0][0] == out["route"][-1][1]


def test_ascent_takes_named_stairs():
    g = Graph()
    for n, z in (("s", 0), ("m", 5), ("t", 20)):
        g.add_node(n, elevation=z)
    g.add("s", "t", length=100, highway="residential")
    g.add("s", "m", length=60, highway="steps", name="Steps")
    g.add("m", "t", length=60, highway="steps", name="Steps")
    assert ascent(g, "s", "t") == ["s", "m", "t"] and ascent(g, "s", "nowhere") is None
    s = elevation_stats(g, [("s", "m", 0, False), ("m", "t", 0, True)])
    assert (s["ascent_m"], s["deadhead_ascent_m"], s["deadhead_m"]) == (20, 15, 60)


def test_chunks_and_disks():
    g = grid(6)
    parts = chunks(g, 0.01)
    assert sorted(id(e) for p in parts for e in p) == sorted(map(id, g.edges))
    d = disk(g, (2, 2), 0.012)
    assert len(d.components()) == 1 and d.total_km() * 1000 >= 12
    dist, by = shortest(g, [(0, 0)])
    assert dist[5, 5] == 10 and len(path_to(by, (5, 5))) == 10


def test_twins():
    g = Graph()
    for n, x, y in (("a", 0, 37.77), ("b", 0.001136, 37.77), ("c", 0, 37.770136), ("d", 0.001136, 37.770136)):
        g.add_node(n, x=x, y=y)
    g.add("a", "b", length=100, name="Main")
    g.add("c", "d", length=100)
    g.add("a", "c", length=15)
    g.add("b", "d", length=15)
    out, n = without_twins(g)
    assert n == 1 and not out.between("c", "d") and out.between("a", "b")
