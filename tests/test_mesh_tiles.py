"""Exact predicates against rational brute force, mesh tiles of any size, point location, and all methods on rasters."""

from fractions import Fraction
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridfill.operators import grid as gr
from gridfill.operators import mesh, natural, regions, tiles
from gridfill.operators.cubic import curved_triangles, minimum_curvature
from gridfill.operators.grid import Grid
from gridfill.plans import fill
from gridfill.session import materialize

GRID = Grid.from_bounds("d", 46.0, 51.0, -60.0, -53.0, 32.0)
KEYS = ["datasetName", "name"]


def rational_triangles(u, v, ids, ratio):
    """Every triple without a point inside its circle, in rational numbers; points on one circle form a fan from the lowest number."""
    pts = [(Fraction(float(a)), Fraction(float(b)) * Fraction(float(ratio))) for a, b in zip(u, v)]
    turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])

    def in_circle(a, b, c, d):
        rows = [(p[0] - d[0], p[1] - d[1]) for p in (a, b, c)]
        sq = [x * x + y * y for x, y in rows]
        return sum(sq[i] * (rows[j][0] * rows[k][1] - rows[j][1] * rows[k][0]) for i, j, k in ((0, 1, 2), (1, 2, 0), (2, 0, 1)))

    out = set()
    for t in combinations(range(len(pts)), 3):
        t = sorted(t, key=lambda i: ids[i])
        a, b, c = (pts[i] for i in t)
        s = turn(a, b, c)
        if s == 0:
            continue
        if s < 0:
            b, c = c, b
        sides = [in_circle(a, b, c, p) for i, p in enumerate(pts) if i not in t]
        ring = [i for i, p in enumerate(pts) if i not in t and in_circle(a, b, c, p) == 0]
        if any(x > 0 for x in sides) or any(ids[i] < ids[t[0]] or turn(b, c, pts[i]) < 0 for i in ring):
            continue
        out.add(tuple(sorted(int(ids[i]) for i in t)))
    return out


def star_triangles(u, v, ids, ratio, hull=None):
    """The triangles that all stars report, every sample seeing all others."""
    n = len(u)
    d = (u[:, None] - u) ** 2 + ((v[:, None] - v) * ratio) ** 2
    d[np.arange(n), np.arange(n)] = np.inf
    order = np.argsort(d, axis=1, kind="stable")[:, :n - 1]
    good, found = mesh.stars(ids, u, v, u[order], v[order], ids[order].astype(float), np.ones(n, bool), ratio, hull)
    assert good.all()
    got = [tuple(sorted((int(ids[r]), int(ids[order[r, a]]), int(ids[order[r, b]])))) for r, a, b in found]
    assert len(got) == len(set(got))
    return set(got)


def point_sets():
    rng = np.random.default_rng(7)
    t = np.sort(rng.uniform(0, 2 * np.pi, 14))
    circle = np.c_[50 + 20 * np.cos(t), 50 + 20 * np.sin(t)]
    yield "jittered circle", circle + rng.normal(size=circle.shape) * 1e-13, 1.0
    yield "circle and centre", np.r_[circle, [[50, 50]]], 1.0
    yield "cluster", np.r_[rng.uniform(0, 100, (10, 2)), 50 + rng.uniform(0, 1e-9, (10, 2))], 1.3
    line = np.c_[np.linspace(0, 90, 16), np.linspace(0, 30, 16)]
    yield "near a line", line + rng.normal(size=line.shape) * 1e-13, 0.7
    yield "line and a point", np.r_[line, [[10.0, 50.0]]], 0.7
    x, y = np.meshgrid(np.arange(4), np.arange(5), indexing="ij")
    cells = np.c_[x.ravel(), y.ravel()] + 0.5
    yield "lattice", cells, 1.4823
    yield "square lattice", cells, 1.0
    yield "lattice in eighths", cells / 8 + 3, 0.9
    yield "tenths, so nearly a lattice", cells / 10, 1.1
    yield "wide lattice", np.floor(rng.uniform(0, 40000, (16, 2))) + 0.5, 1.2
    yield "parallel rows", np.r_[np.c_[np.arange(9.0), np.zeros(9)], np.c_[np.arange(9.0) + 0.25, np.full(9, 1e-12)]], 1.0


@pytest.mark.parametrize("name,pts,ratio", list(point_sets()), ids=[p[0] for p in point_sets()])
def test_stars_equal_rational_brute_force(name, pts, ratio):
    ids = np.random.default_rng(1).permutation(len(pts)) + 5
    u, v = np.ascontiguousarray(pts[:, 0]), np.ascontiguousarray(pts[:, 1])
    assert star_triangles(u, v, ids, ratio) == rational_triangles(u, v, ids, ratio)


def test_collinear_points_have_no_triangles():
    u = np.arange(6.0)
    assert star_triangles(u, 2 * u, np.arange(6), 1.1) == set()
    assert star_triangles(u / 7, u / 7, np.arange(6), 1.0) == rational_triangles(u / 7, u / 7, np.arange(6), 1.0)


def as_samples(u, v, value=None):
    return pd.DataFrame({"datasetName": "d", "name": "f", "index": np.arange(len(u)), "lat": GRID.lat_min + u * GRID.lat_gap,
                         "lon": GRID.lon_min + v * GRID.lon_gap, "value": np.ones(len(u)) if value is None else value})


def corners_of(tri):
    return [tuple(sorted((r["point1"], r["point2"], r["point3"]))) for r in tri.collect()]


def test_delaunay_of_clusters_and_thin_sets_by_rounds(spark):
    rng = np.random.default_rng(3)
    u = np.r_[rng.uniform(1, 15, 14), 7 + rng.uniform(0, 1e-8, 10), np.linspace(2, 14, 8)]
    v = np.r_[rng.uniform(1, 15, 14), 8 + rng.uniform(0, 1e-8, 10), np.linspace(1, 1 + 1e-9, 8)]
    samples = as_samples(u, v)
    at = mesh._mesh_points(spark.createDataFrame(samples), GRID).toPandas().sort_values("index")
    expected = rational_triangles(at.u.values, at.v.values, at["index"].values, GRID.lon_gap / GRID.lat_gap)
    got = corners_of(mesh.delaunay(spark.createDataFrame(samples), GRID, first_k=12))
    assert len(got) == len(set(got)) and set(got) == expected


def test_few_and_stacked_samples(spark):
    rows = pd.concat([as_samples(np.array([3.0]), np.array([3.0])).assign(name="one"), as_samples(np.array([3.0, 4.0]), np.array([3.0, 4.0])).assign(name="two"),
                      as_samples(np.array([3.0, 3.0, 4.0, 5.0]), np.array([3.0, 3.0, 4.0, 3.0])).assign(name="stack")])
    tri = mesh.delaunay(spark.createDataFrame(rows), GRID).collect()
    assert [(r["name"], r["point1"]) for r in tri] == [("stack", 0)] and {tri[0]["point2"], tri[0]["point3"]} == {2, 3}
    assert mesh.delaunay(spark.createDataFrame(rows).limit(0), GRID).count() == 0


def test_hull_turns_are_exact():
    assert regions._turn([0.1, 0.1], [0.2, 0.2], [0.3, 0.3]) == (Fraction(0.2) - Fraction(0.1)) * (Fraction(0.3) - Fraction(0.1)) - (Fraction(0.2) - Fraction(0.1)) * (Fraction(0.3) - Fraction(0.1))
    pts = np.array([[0.0, 0.0], [1.0, 1e-17], [2.0, 0.0], [1.0, 1.0]])
    assert [0.0, 0.0] in regions.hull_vertices(pts).tolist() and [1.0, 1e-17] not in regions.hull_vertices(pts).tolist()


# ---------------------------------------------------------------- tiles

@pytest.fixture(scope="module")
def meshed(spark):
    rng = np.random.default_rng(11)
    boxes = np.sort(rng.choice(GRID.all_num, 150, replace=False))
    x, y = boxes // GRID.y_num, boxes % GRID.y_num
    samples = pd.DataFrame({"datasetName": "d", "name": "f", "index": boxes, "box_x": x, "box_y": y, "lat": GRID.lat_min + (x + .5) * GRID.lat_gap,
                            "lon": GRID.lon_min + (y + .5) * GRID.lon_gap, "value": rng.normal(size=len(boxes)), "grid_length": 32.0})
    tri = mesh.delaunay(spark.createDataFrame(samples), GRID).cache()
    return samples, tri, mesh.boxes_in_triangles(tri, GRID).cache()


@pytest.mark.parametrize("most", [1, 7, 40, 10**6])
def test_tiles_hold_every_corner_once(spark, meshed, most, monkeypatch):
    monkeypatch.setattr(tiles, "BASE", 2)
    rng = np.random.default_rng(0)
    u = np.r_[rng.uniform(-3, 60, 200), 20 + rng.uniform(0, 1e-3, 200)]
    v = np.r_[rng.uniform(-3, 60, 200), 30 + rng.uniform(0, 1e-3, 200)]
    points = spark.createDataFrame(pd.DataFrame({"datasetName": "d", "name": "f", "u": u, "v": v}))
    plan, levels = tiles.plan_tiles(points, most)
    rows = plan.collect()
    held = np.zeros(len(u), int)
    for r in rows:
        side = 2.0 ** r["level"]
        inside = (np.floor(u / side) == r["tx"]) & (np.floor(v / side) == r["ty"])
        assert 0 < inside.sum() <= most
        held += inside
    assert (held == 1).all() and set(levels) == {r["level"] for r in rows}


@pytest.mark.parametrize("most,targets", [(16, 40)])
def test_results_do_not_depend_on_tiles(spark, meshed, monkeypatch, most, targets):
    _, tri, located = meshed
    whole = {r["box_index"]: r["value"] for r in natural.natural_neighbour(located, tri, GRID).collect()}
    lists = {r["box_index"]: [t["tri_index"] for t in r["triangles"]] for r in natural.conflict_triangles(located, tri, GRID).collect()}
    curved = {r["box_index"]: r["value"] for r in minimum_curvature(tri, GRID).collect()}
    monkeypatch.setattr(tiles, "BASE", 2)
    monkeypatch.setattr(tiles, "TARGETS", targets)
    small = {r["box_index"]: r["value"] for r in natural.natural_neighbour(located, tri, GRID, most=most).collect()}
    assert small.keys() == whole.keys() and all((a is None) == (whole[k] is None) and (a is None or a == pytest.approx(whole[k], abs=1e-9)) for k, a in small.items())
    assert {r["box_index"]: [t["tri_index"] for t in r["triangles"]] for r in natural.conflict_triangles(located, tri, GRID, most=most).collect()} == lists
    again = {r["box_index"]: r["value"] for r in minimum_curvature(tri, GRID, most=most).collect()}
    assert again.keys() == curved.keys() == whole.keys() and max(abs(again[k] - curved[k]) for k in curved) < 1e-4


def test_slopes_solve_the_whole_system(spark, meshed):
    samples, tri, _ = meshed
    ratio = GRID.lon_gap / GRID.lat_gap
    at = {i: k for k, i in enumerate(samples["index"])}
    xy, f = np.c_[samples.box_x + .5, (samples.box_y + .5) * ratio], samples.value.values
    a, b = np.zeros((2 * len(at), 2 * len(at))), np.zeros(2 * len(at))
    rows = curved_triangles(tri, GRID, 1e-8).collect()
    for i, j in {tuple(sorted(s)) for r in rows for s in combinations((at[r["point1"]], at[r["point2"]], at[r["point3"]]), 2)}:
        for p, q in ((i, j), (j, i)):
            e = xy[q] - xy[p]
            cube = (e @ e) ** 1.5
            a[2 * p:2 * p + 2, 2 * p:2 * p + 2] += 4 * np.outer(e, e) / cube
            a[2 * p:2 * p + 2, 2 * q:2 * q + 2] += 2 * np.outer(e, e) / cube
            b[2 * p:2 * p + 2] += 6 * e * (f[q] - f[p]) / cube
    g = np.linalg.solve(a, b).reshape(-1, 2)
    for r in rows:
        for k in (1, 2, 3):
            assert (r[f"gx{k}"], r[f"gy{k}"]) == pytest.approx(tuple(g[at[r[f"point{k}"]]]), abs=1e-6)


def test_one_shuffle_of_triangles_a_round(spark, meshed):
    _, tri, located = meshed
    tri = materialize(tri)
    plan, levels = tiles.plan_tiles(tri.select(*KEYS, F.col("u1").alias("u"), F.col("v1").alias("v")))
    dealt = tiles.dealt_triangles(tri, plan, levels).groupBy(*tiles.TILE).count()
    text = dealt._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") <= 1 and "Cartesian" not in text and "SortMergeJoin" not in text


# ---------------------------------------------------------------- location

def brute_located(rows, points):
    out = {}
    for b, x, y in points:
        best = None
        for r in rows:
            p = [(r[f"u{k}"], r[f"v{k}"]) for k in (1, 2, 3)]
            turn = [(p[j][0] - p[i][0]) * (y - p[i][1]) - (p[j][1] - p[i][1]) * (x - p[i][0]) for i, j in ((0, 1), (1, 2), (2, 0))]
            if all(t >= -1e-12 for t in turn) or all(t <= 1e-12 for t in turn):
                name = tuple(sorted((r["point1"], r["point2"], r["point3"])))
                best = name if best is None else min(best, name)
        if best:
            out[b] = best
    return out


def test_boxes_and_points_in_triangles_equal_brute_force(spark, meshed, monkeypatch):
    _, tri, located = meshed
    rows = tri.collect()
    boxes = [(b, b // GRID.y_num + .5, b % GRID.y_num + .5) for b in range(GRID.all_num)]
    expected = brute_located(rows, boxes)
    name = lambda r: tuple(sorted((r["point1"], r["point2"], r["point3"])))
    found = located.collect()
    assert len(found) == len(expected) and {r["box_index"]: name(r) for r in found} == expected
    monkeypatch.setattr(mesh, "LARGE", 2)
    assert {r["box_index"]: name(r) for r in mesh.boxes_in_triangles(tri, GRID).collect()} == expected
    rng = np.random.default_rng(5)
    free = [(i, float(x), float(y)) for i, (x, y) in enumerate(np.r_[rng.uniform(-1, 20, (300, 2)), np.floor(rng.uniform(0, 18, (60, 2))) + 0.5])]
    points = spark.createDataFrame([("d", "f", *p) for p in free], "datasetName string, name string, box_index long, pu double, pv double")
    got = mesh.points_in_triangles(points, tri).collect()
    assert {r["box_index"]: name(r) for r in got} == brute_located(rows, free) and len(got) == len({r["box_index"] for r in got})


def test_slivers_and_a_large_triangle(spark):
    rows = [("d", "f", i, 100 + i, 200 + i, 300 + i, *c, 0.0, 0.0, 0.0) for i, c in enumerate([
        (0.0, 0.0, 1000.0, 1e-3, 1000.0, 2e-3), (0.0, 0.0, 700.0, 900.0, 0.0, 900.0), (2.5, 2.5, 2.5, 3.5, 2.75, 3.0), (0.0, 0.0, 0.0, -5.0, 900.0, -5.0)])]
    tri = spark.createDataFrame(rows, "datasetName string, name string, tri_index long, point1 long, point2 long, point3 long, u1 double, v1 double, u2 double, v2 double, "
                                      "u3 double, v3 double, value1 double, value2 double, value3 double")
    rng = np.random.default_rng(2)
    free = [(i, float(x), float(y)) for i, (x, y) in enumerate(np.r_[rng.uniform(-2, 1000, (300, 2)), np.c_[rng.uniform(0, 1000, 50), rng.uniform(0, 2e-3, 50)], [[2.5, 2.5], [2.5, 3.0], [0.0, 0.0]]])]
    points = spark.createDataFrame([("d", "f", *p) for p in free], "datasetName string, name string, box_index long, pu double, pv double")
    got = {r["box_index"]: (r["point1"], r["point2"], r["point3"]) for r in mesh.points_in_triangles(points, tri).collect()}
    assert got == brute_located(tri.collect(), free)


def test_all_methods_fill_a_raster(spark, meshed):
    samples, tri, _ = meshed
    f = lambda lat, lon: 2 * lat - 3 * lon + 1
    means = spark.createDataFrame(samples.assign(value=f(samples.lat, samples.lon)))
    raster = gr.fixed_count_raster(spark, GRID, 12, 15)
    spread = samples.value.std()
    for method, params in (("nn", {}), ("idw", {}), ("moving_average", {}), ("DM", {}), ("polynomial", {}), ("krige", {"max_lag": 1.0}), ("rbf", {"tile": 4, "function": "linear"}),
                           ("triangle", {}), ("natural_neighbor", {}), ("min_curvature", {})):
        out = fill.fill_points(means, GRID, method, raster, params).toPandas()
        assert len(out) == raster.count() and out.box_index.is_unique
        there = out[out.value.notna()]
        assert len(there) > 0.7 * len(out) and (len(there) == len(out) or method in ("triangle", "natural_neighbor", "min_curvature"))
        error = np.abs(there.value - f(there.box_lat, there.box_lon)).max()
        assert error < (1e-5 if method in ("triangle", "natural_neighbor", "min_curvature", "polynomial") else 10 * spread), method
