"""The lens hands the operators the whole table."""

from trailmark.plans import lens, queries


def grid(spark, tmp_path, n):
    rows = [(k, 10 + k % 40, "STANDARD") for k in range(n)]
    spark.createDataFrame(rows, "p_partkey long, p_size int, p_type string").write.parquet(f"file://{tmp_path}/part.parquet")
    return f"file://{tmp_path}"


def test_a_walk_starts_at_every_part_whose_steps_stay_on_the_grid(spark, tmp_path):
    n = 400
    got = {}
    for r in lens.route(spark, grid(spark, tmp_path, n)).collect():
        got.setdefault(r.route_id, {})[r.ord] = (r.a, r.b)
    want = {}
    for k in range(n):
        at, steps = k, []
        for i in range(12):
            to = at + (40 if i % 3 == 2 else 1)
            if to >= n or to == at + 1 and to % 40 == 0:
                break
            steps.append((at, to))
            at = to
        if len(steps) == 12:
            want[k] = dict(enumerate(steps))
    assert got == want


def test_components_and_islands_are_of_the_whole_public_network(spark, tmp_path):
    # private parts cut the grid in pieces
    n = 400
    rows = [(k, 11 if k % 40 == 35 or k // 40 == 8 else 4 if k % 40 != 36 else 30, "STANDARD") for k in range(n)]
    spark.createDataFrame(rows, "p_partkey long, p_size int, p_type string").write.parquet(f"file://{tmp_path}/part.parquet")
    live = queries._reasoned(spark, f"file://{tmp_path}").where("reason is null").collect()
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for e in live:
        a, b = sorted((root(int(e.u)), root(int(e.v))))
        up[b] = a
    want = {x: root(x) for x in up}
    got = {r.node_id: r.component for r in queries.network_components(spark, f"file://{tmp_path}").collect()}
    assert got == want and any(e.length <= 120 for e in live)
    main = max(set(want.values()), key=lambda c: (list(want.values()).count(c), -c))
    km, edges = {}, {}
    for e in live:
        c = want[int(e.u)]
        edges[c] = edges.get(c, 0) + 1
        km[c] = km.get(c, 0) + (e.length / 1000 if e.tags["name"] else 0)
    islands = {r.component: (r.edges, r.required_km) for r in queries.island_totals(spark, f"file://{tmp_path}").collect()}
    assert islands and islands == {c: (edges[c], round(km[c], 6)) for c in edges if c != main and km[c] >= 0.05}
