"""Registered queries against their SQL, hand-computed cases and invariants."""

import math
import random
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lithoframe.functions import crs, scalars
from lithoframe.functions import geometry as G
from lithoframe.operators import circuit, corridors, embed, graph, hull, raster, scoring, spatial_join, spectral, vectorise
from lithoframe.operators.components import components
from lithoframe.plans import catalog
from lithoframe.plans.fixtures import Fixtures

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
WITHOUT_SQL = sorted(set(catalog.queries()) - set(catalog.oracle_sql()))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def close(v):
    return None if v is None or (isinstance(v, float) and math.isnan(v)) else float(f"{v:.8g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, con, name):
    got = catalog.queries()[name](spark, SF)
    want = con.execute(f"select {', '.join(got.columns)} from ({catalog.oracle_sql()[name]})").fetchall()
    rows = lambda x: Counter(tuple(map(close, r)) for r in x)
    assert rows(got.collect()) == rows(want)


@pytest.mark.parametrize("name", WITHOUT_SQL)
def test_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() >= 0


def test_small_components_of_the_whole_grid(spark):
    """Against a flood fill."""
    cells = {(r.row_id, r.col_id) for r in Fixtures(spark, SF).dem.where("elev > 70.5").collect()}
    want, left = set(), set(cells)
    while left:
        group, todo = set(), [left.pop()]
        while todo:
            x = todo.pop()
            group.add(x)
            near = {(x[0] + i, x[1] + j) for i, j in ((0, 1), (1, 0), (0, -1), (-1, 0))} & left
            left -= near
            todo += near
        want |= group if len(group) >= 6 else set()
    got = [tuple(r) for r in catalog.queries()["small_components"](spark, SF).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_signal_skeleton_of_a_long_shape_by_joins(spark, monkeypatch):
    """signal_skeleton: a column of 160 cells stays whole where components go by rounds of joins; its line has all cells and both ends."""
    for m in (raster, vectorise):
        monkeypatch.setattr(m, "components", lambda edges: components(edges, 0))
    cells = spark.range(160).select(F.col("id").cast("int").alias("row_id"), F.lit(3).alias("col_id"))
    assert raster.remove_small(cells).count() == 160
    (line,) = vectorise.skeleton_to_lines(cells).collect()
    assert (line.n_pixels, line.u, line.v) == (160, 3, (159 << 32) + 3)


def test_signal_skeleton_against_thinning_in_memory(spark, tmp_path, monkeypatch):
    """signal_skeleton: the whole query on 160 rows with a band through all of them, where components go by rounds of joins."""
    for m in (raster, vectorise):
        monkeypatch.setattr(m, "components", lambda edges: components(edges, 0))
    rng = random.Random(5)
    rows = [(k, 30.0 if k % 100 in (3, 4) or (k % 100 > 5 and rng.random() < 0.57) else 20.0) for k in range(16_000)]
    spark.createDataFrame(rows, "event_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = Counter(tuple(r) for r in catalog.queries()["signal_skeleton"](spark, str(tmp_path)).collect())

    ring = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]
    near = lambda x, offsets, cells: [y for i, j in offsets if (y := (x[0] + i, x[1] + j)) in cells]

    def groups(left, offsets):
        while left:
            group = todo = [left.pop()]
            for x in todo:  # it grows
                found = near(x, offsets, left)
                left.difference_update(found)
                todo += found
            yield group

    strong = {divmod(k, 100) for k, v in rows if v > 25 and k % 97}
    live, size = {x for g in groups(strong, ring[::2]) if len(g) >= 50 for x in g}, 0
    while len(live) != size:
        size = len(live)
        for step in (0, 1):
            gone = set()
            for x in live:
                p = [(x[0] + i, x[1] + j) in live for i, j in ring]
                n, e, s, w = p[::2]
                kept = (e and s and (n or w)) if step == 0 else (n and w and (e or s))
                if 2 <= sum(p) <= 6 and sum(p[k] < p[(k + 1) % 8] for k in range(8)) == 1 and not kept:
                    gone.add(x)
            live = live - gone
    key, want = lambda x: (x[0] << 32) + x[1], Counter()
    inner = {x for x in live if len(near(x, ring, live)) == 2}
    for g in groups(set(inner), ring):
        ends = [key(y) for x in g for y in near(x, ring, live - inner)]
        want[key(min(g)), len(g) + (2 if ends else 0), min(ends, default=None), max(ends, default=None)] += 1
    want = Counter({k: n for k, n in want.items() if k[1] >= 5})
    assert max(k[1] for k in want) > 150 and sum(want.values()) > 10 and got == want


def test_stability_proxy_of_a_last_row_that_is_not_full(spark, con, tmp_path):
    """Against its SQL where the last row has 6 of 25 cells; beside them nothing is made up."""
    con.execute(f"copy (select * from embeddings where vec_id < 81) to '{tmp_path}/embeddings.parquet' (format parquet)")
    own = duckdb.connect()
    for t in TABLES:
        own.execute(f"create view {t} as select * from read_parquet('{tmp_path if t == 'embeddings' else SF}/{t}.parquet')")
    got = sorted(tuple(map(close, r)) for r in catalog.queries()["stability_proxy"](spark, str(tmp_path)).select("row_id", "col_id", "stability").collect())
    want = sorted(tuple(map(close, r)) for r in own.execute(f"select row_id, col_id, stability from ({catalog.oracle_sql()['stability_proxy']})").fetchall())
    assert len(want) == 81 and got == want


def test_skeleton_lines_do_not_broadcast_grids(spark, tmp_path):
    """skeleton_lines: files of cells look small, but their broadcast doesn't fit the driver's memory."""
    spark.range(500).select((F.col("id") / 20).cast("int").alias("row_id"), (F.col("id") % 20).cast("int").alias("col_id")).write.parquet(str(tmp_path / "cells"))
    cells = spark.read.parquet(str(tmp_path / "cells"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for df in (raster.neighbours(cells), raster.erode(cells), vectorise.skeleton_to_lines(cells)):
        assert "SortMergeJoin" in plan(df) and "BroadcastHashJoin" not in plan(df)


def test_nearest_line_beyond_the_first_radius(spark):
    """The search grows until every segment has its distance; without a network there is none."""
    line = lambda k, x: (k, float(x), 0.0, float(x), 10.0)
    schema = "line_id int, x1 double, y1 double, x2 double, y2 double"
    segments = spark.createDataFrame([line(k, 10**k) for k in range(5)], schema)
    got = {r.line_id: r._d for r in scoring.nearest_line(segments, spark.createDataFrame([line(9, 0)], schema), "line_id", 20.0).collect()}
    assert {k: round(d) for k, d in got.items()} == {k: 10**k for k in range(5)}
    assert scoring.nearest_line(segments, segments.limit(0), "line_id").count() == 0


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_directions(spark):
    raw = ["North", "south (blocked)", "N and E", "East/West", "unknown", None, "NE", "S, N, south", "nan"]
    df = spark.createDataFrame([(r,) for r in raw], "r string").select(scalars.normalise_directions(F.col("r")).alias("d"))
    assert [r.d for r in df.collect()] == [["N"], ["S"], ["N", "E"], ["E", "W"], [], [], [], ["S", "N"], []]


def test_scalars(spark):
    n = scalars.num
    assert one(spark, scalars.safe_div(n(1), n(0))) == 0.0
    assert abs(one(spark, scalars.walking_seconds(n(10), n(0))) - 10 / (6 * math.exp(-0.175) / 3.6)) < 1e-9
    assert one(spark, scalars.walking_seconds(n(10), F.lit(None).cast("double"))) == pytest.approx(100)
    bands = {b: n(1) for b in ("blue", "green", "red", "rededge", "nir2")} | {"nir1": n(3)}
    assert one(spark, scalars.indices(bands)["ndvi"]) == 0.5
    assert one(spark, scalars.spectral_angle([n(1), n(2)], [n(1), n(2)])) == pytest.approx(0, abs=1e-4)


def test_wall_of_the_unit_square(spark):
    ring = G.box_ring(scalars.num(0.5), scalars.num(0.5), scalars.num(0.5), scalars.num(0.5))
    w = one(spark, G.best_wall(ring, F.lit("N")))
    assert (w.mx, w.my, round(w.nx, 9), w.ny, w.edge_len) == (0.5, 1.0, 0.0, 1.0, 1.0)


def test_runs_split_by_gap_and_length(spark):
    rows = spark.createDataFrame([(0, i, v) for i, v in enumerate((0.0, 10.0, 20.0, 30.0, 40.0))] + [(1, i, v) for i, v in enumerate((0.0, 5.0, 20.0))], "g int, id int, v double")
    got = {(r.g, r.id): r["sub"] for r in corridors.split_runs(rows, ["g"], ["id"], "v").collect()}
    assert [got[0, i] for i in range(5)] == [0, 0, 0, 0, 1] and [got[1, i] for i in range(3)] == [0, 0, 1]


def test_path_and_star_centrality(spark):
    path = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0)], "a long, b long, w double")
    got = {(r.kind, r.a, r.b): r.value for r in graph.betweenness(path).collect()}
    assert got["node", 1, 1] == 1.0 and got["edge", 0, 1] == pytest.approx(2 / 3)
    star = spark.createDataFrame([(0, i, 1.0) for i in range(1, 6)], "a long, b long, w double")
    assert {r.a: r.value for r in graph.betweenness(star).where("kind = 'node'").collect()}[0] == pytest.approx(1)
    depth = {r.node: (r.depth, r.integration) for r in graph.integration(path).collect()}
    assert depth == {0: (1.5, 2.0), 1: (1.0, 0.0), 2: (1.5, 2.0)}


def test_gabriel_and_its_family(spark):
    line = spark.createDataFrame([(i, float(i), 0.0) for i in range(3)], "id long, x double, y double")
    assert {(r.a, r.b) for r in graph.gabriel(line, "id").collect()} == {(0, 1), (1, 2)}
    rng = random.Random(1)
    pts = spark.createDataFrame([(i, rng.random() * 100, rng.random() * 100) for i in range(60)], "id long, x double, y double")
    edges = lambda df: {(r.a, r.b) for r in df.collect()}
    gab = graph.gabriel(pts, "id")
    assert edges(graph.beta_skeleton(pts, "id", 1.0)) == edges(gab) and edges(graph.beta_skeleton(pts, "id")) <= edges(gab)
    tree = graph.spanning_tree(graph._pairs_to(pts, "id", None)[0].select("a", "b", F.col("dist").alias("w")))
    assert edges(tree) <= edges(gab) and tree.count() == 59
    again = graph.spanning_tree(gab.select("a", "b", F.col("dist").alias("w")), small=0)
    assert edges(again) == edges(tree)


def test_components_both_ways(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(500 + i, 501 + i) for i in range(60)]
    df = spark.createDataFrame(pairs, "a long, b long")
    small, large = ({(r.node, r.comp) for r in components(df, k).collect()} for k in (1000, 0))
    assert small == large and components(df.limit(0)).count() == 0


def test_shortest_paths_both_ways(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([(a, b, rng.random()) for a in range(30) for b in range(a + 1, 30) if rng.random() < 0.12], "a long, b long, w double")
    got = [{r.node: round(r.cost, 9) for r in graph.shortest_paths(df, 0, k).collect()} for k in (1000, 0)]
    assert got[0] == got[1]


def test_components_of_a_long_path_by_joins(spark):
    """small_components: a path numbered along its way is one component, however many cells it has."""
    df = spark.range(100, 300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert sorted(tuple(r) for r in components(df, 0).collect()) == [(k, 100) for k in range(100, 301)]


def test_clusters_are_components(spark):
    rng = random.Random(6)
    pts = [(i, rng.random() * 60, rng.random() * 60) for i in range(60)]
    got = {r.id: r.cluster for r in graph.dbscan(spark.createDataFrame(pts, "id long, x double, y double"), "id", 6.0).collect()}
    for i, x, y in pts:
        for j, u, v in pts:
            if math.hypot(x - u, y - v) <= 6:
                assert got[i] == got[j]
    assert sorted(set(got.values())) == list(range(len(set(got.values()))))


def test_assignment_is_optimal():
    rng = np.random.default_rng(7)
    for _ in range(30):
        n, m = rng.integers(1, 6), 6
        cost = rng.random((n, m))
        got = hull.min_cost_matching(cost)
        assert len(set(got)) == n and sum(cost[i, c] for i, c in enumerate(got)) == pytest.approx(min(sum(cost[i, c] for i, c in enumerate(p)) for p in permutations(range(m), int(n))))


def test_hull_holds_all_points(spark):
    rng = random.Random(8)
    pts = [(rng.random(), rng.random()) for _ in range(200)]
    df = spark.createDataFrame(pts, "x double, y double").repartition(4)
    got = [(r.x, r.y) for r in hull.convex_hull(df).orderBy("i").collect()]
    for (ax, ay), (bx, by) in zip(got, got[1:] + got[:1], strict=True):
        assert all((bx - ax) * (y - ay) - (by - ay) * (x - ax) >= -1e-12 for x, y in pts)
    assert hull.in_buffered_hull(df, hull.convex_hull(df), 0.0).where("not in_hull").count() == 0


def test_mercator_of_a_known_point(spark):
    e, n = crs.forward(scalars.num(31.1342), scalars.num(29.9792), 36)
    row = spark.range(1).select(e.alias("e"), n.alias("n")).first()
    lon, lat = crs.inverse(scalars.num(row.e), scalars.num(row.n), 36)
    back = spark.range(1).select(lon.alias("lon"), lat.alias("lat")).first()
    assert (back.lon, back.lat) == (pytest.approx(31.1342, abs=1e-10), pytest.approx(29.9792, abs=1e-10))
    on_meridian = spark.range(1).select(crs.forward(scalars.num(33.0), scalars.num(0.0), 36)[0].alias("e")).first().e
    assert on_meridian == pytest.approx(500_000)


def test_circuit_obeys_kirchhoff(spark):
    two = spark.createDataFrame([(0, 0, 2.0), (0, 1, 2.0)], "row_id int, col_id int, cost double")
    assert {r.current for r in circuit.currents(two, [([(0, 0)], (0, 1))]).collect()} == {0.5}
    rng = np.random.default_rng(9)
    a, b = np.array([(i, j) for i in range(12) for j in range(i + 1, 12) if rng.random() < 0.4]).T
    g, into = rng.random(len(a)) + 0.1, np.zeros(12)
    into[[2, 5]] = 1.0
    v = circuit.solve(12, a, b, g, into, 0)
    out = np.bincount(a, g * (v[a] - v[b]), 12) - np.bincount(b, g * (v[a] - v[b]), 12)
    assert np.allclose(out[1:], into[1:], atol=1e-6) and out[0] == pytest.approx(-2)
    assert np.allclose(circuit.solve(4, np.array([0, 2]), np.array([1, 3]), np.ones(2), np.array([0, 1.0, 0, 1.0]), 0), [0, 1, 0, 0])


def test_components_of_variance(spark):
    df, share = spectral.pca(spectral.radiance(Fixtures(spark, SF).pixels))
    assert share.sum() == pytest.approx(1)
    c = spectral.covariance(df, [f"pc{k}" for k in range(1, 9)], sample=False)
    assert np.allclose(c - np.diag(np.diag(c)), 0, atol=1e-8)


def test_norm01_stays_within_bounds(spark):
    got = spectral.norm01(Fixtures(spark, SF).pixels, "dn3", "v").agg(F.min("v").alias("a"), F.max("v").alias("b")).first()
    assert (got.a, got.b) == (0.0, pytest.approx(1.0))


def test_thinning_keeps_a_line_and_thins_a_bar(spark):
    cells = spark.createDataFrame([(r, q) for r in range(5) for q in range(20)], "row_id int, col_id int")
    thin = raster.skeletonize(cells)
    assert 0 < thin.count() < 30 and thin.join(cells, ["row_id", "col_id"], "left_anti").count() == 0
    line = spark.createDataFrame([(0, q) for q in range(10)], "row_id int, col_id int")
    assert raster.skeletonize(line).count() == 10


def test_gaussian_keeps_the_sum(spark):
    cells = spark.createDataFrame([(r, q, float(r * q % 5)) for r in range(6) for q in range(7)], "row_id int, col_id int, v double")
    total = lambda df: df.agg(F.sum("v").alias("s")).first().s
    assert total(raster.gaussian(cells, "v", 1.5, 6, 7)) == pytest.approx(total(cells))


def test_sight_may_touch_but_not_enter(spark):
    box = spark.createDataFrame([(0, 5.0, 5.0, 1.0, 1.0)], "shp_idx long, cx double, cy double, hw double, hh double")
    segs = spark.createDataFrame([(0, 0.0, 5.0, 10.0, 5.0), (1, 0.0, 6.0, 10.0, 6.0), (2, 0.0, 0.0, 1.0, 1.0), (3, 3.0, 5.0, 5.0, 7.0), (4, 5.0, 5.0, 5.0, 5.5)], "id long, x1 double, y1 double, x2 double, y2 double")
    assert {r.id for r in spatial_join.visible(segs, ["id"], box).collect()} == {1, 2, 3}


def test_rings_of_any_shape(spark):
    """An L-shaped and a turned building: sight, clipped lengths and cells against finely spaced points."""
    ell = [(0, 0), (20, 0), (20, 6), (6, 6), (6, 20), (0, 20), (0, 0)]
    turned = [(40 + 9 * math.cos(a), 10 + 5 * math.sin(a + 0.4)) for a in (0, 1.6, 3.1, 4.7)]
    rings = {0: ell, 1: [*turned, turned[0]]}
    polygons = spark.createDataFrame([(k, [(float(x), float(y)) for x, y in r]) for k, r in rings.items()], "shp_idx long, ring array<struct<x: double, y: double>>")

    def inside(x, y, ring):
        """Winding number by angles."""
        turn = 0.0
        for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False):
            turn += math.atan2((ax - x) * (by - y) - (ay - y) * (bx - x), (ax - x) * (bx - x) + (ay - y) * (by - y))
        return abs(turn) > math.pi

    rng = random.Random(11)
    rows = [(k, *(rng.uniform(-5, 55) if i % 2 == 0 else rng.uniform(-5, 25) for i in range(4))) for k in range(60)]
    rows += [(100, -5.0, 0.0, 25.0, 0.0), (101, 6.0, 6.0, 6.0, 30.0), (102, 6.0, 10.0, 20.0, 10.0), (103, -1.0, 12.0, 20.0, 12.0), (104, 15.0, -2.0, -2.0, 15.0), (105, 10.0, 25.0, 25.0, 10.0)]
    segments = spark.createDataFrame(rows, "id long, x1 double, y1 double, x2 double, y2 double")
    got = {r.id: r for r in spatial_join.covered_length(segments, ["id"], polygons, 8.0).collect()}
    seen = {r.id for r in spatial_join.visible(segments, ["id"], polygons, 8.0).collect()}
    assert {100, 101, 102, 105} <= seen and not {103, 104} & seen and got[103].inside_len == pytest.approx(6)
    for k, x1, y1, x2, y2 in rows[:60]:
        n = 4000
        share = sum(any(inside(x1 + (i + 0.5) / n * (x2 - x1), y1 + (i + 0.5) / n * (y2 - y1), r) for r in rings.values()) for i in range(n)) / n
        assert got[k].inside_len == pytest.approx(share * math.hypot(x2 - x1, y2 - y1), abs=0.1)
        assert (k in seen) == (not got[k].crosses)
    cells = {(r.shp_idx, r.row_id, r.col_id) for r in raster.ring_cells(polygons, 40.0, 1.0).collect()}
    assert cells == {(k, i, j) for k, r in rings.items() for i in range(40) for j in range(60) if inside(j + 0.5, 40 - (i + 0.5), r)}


def test_overlapping_buildings_count_once(spark):
    box = spark.createDataFrame([(0, 5.0, 0.0, 2.0, 1.0), (1, 6.0, 0.0, 2.0, 1.0)], "shp_idx long, cx double, cy double, hw double, hh double")
    seg = spark.createDataFrame([(0, 0.0, 0.0, 10.0, 0.0)], "id long, x1 double, y1 double, x2 double, y2 double")
    assert spatial_join.covered_length(seg, ["id"], box).first().inside_len == pytest.approx(5)


def test_embedding_separates_groups():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 0.1, (30, 4)), rng.normal(5, 0.1, (30, 4))])
    y = embed.embed(x, 10, 300)
    assert np.linalg.norm(y[:30].mean(0) - y[30:].mean(0)) > 2 * max(y[:30].std(), y[30:].std()) / 2


def test_agreement_without_lines(spark):
    fx = Fixtures(spark, SF)
    got = scoring.agrees_with_lines(fx.skeleton, "line_id", fx.lines.limit(0))
    assert got.count() == fx.skeleton.count() and got.where("agrees").count() == 0


def test_every_edge_has_both_ends(spark):
    e = graph.proximity_graph(Fixtures(spark, SF).doors, None)
    near = defaultdict(int)
    for r in e.collect():
        near[r.a] += 1
        near[r.b] += 1
    assert {r.node: r.degree for r in graph.degrees(e).collect()} == dict(near)


def test_gabor_and_coherence_take_the_whole_grid(spark):
    """Both queries against brute force on a grid of more rows than 10 and of other columns than 100."""
    from types import SimpleNamespace

    from lithoframe.plans import q_raster

    z = np.random.default_rng(3).random((23, 37))
    rows = [(i, j, None if (i * 37 + j) % 97 == 0 else float(z[i, j])) for i in range(23) for j in range(37)]
    z = np.array([0.0 if v is None else v for _, _, v in rows]).reshape(23, 37)
    fx = SimpleNamespace(spark=spark, dem=spark.createDataFrame(rows, "row_id int, col_id int, elev double"))

    want = np.zeros_like(z)
    for pair in raster.gabor_kernels(0.40):
        parts = []
        for kernel in pair:
            out, wide = np.zeros_like(z), np.pad(z, 30)
            for (i, j), w in kernel.items():
                out += w * wide[30 + i : 53 + i, 30 + j : 67 + j]
            parts.append(out)
        want = np.maximum(want, np.hypot(*parts))
    got = q_raster.gabor(fx).collect()
    assert len(got) == z.size and all(abs(r[2] - want[r[0], r[1]]) < 1e-5 for r in got)

    def smooth(x):
        w = np.array(raster.gaussian_weights(2.0))
        for axis in (0, 1):
            x = np.apply_along_axis(lambda v: np.convolve(np.pad(v, len(w) // 2, "symmetric"), w, "valid"), axis, x)
        return x

    dy, dx = np.gradient(z)
    xx, xy, yy = smooth(dx * dx), smooth(dx * dy), smooth(dy * dy)
    want = ((xx - yy) ** 2 + 4 * xy * xy) / (xx + yy + 1e-8) ** 2
    got = q_raster.coherence(fx).collect()
    assert len(got) == z.size and all(abs(r[2] - want[r[0], r[1]]) < 1e-5 for r in got)
