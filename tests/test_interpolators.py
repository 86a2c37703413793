import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridfill.operators import regions, simple, solvers
from gridfill.operators.cubic import cubic_patch, minimum_curvature
from gridfill.operators.grid import Grid
from gridfill.operators.mesh import boxes_in_triangles, delaunay, linear_triangulation, with_vertices
from gridfill.operators.natural import natural_neighbour
from gridfill.operators.rbf import tiled_rbf
from gridfill.operators.variogram import empirical_variogram, fit_model, fit_variogram
from test_neighbors import lattice

# Twenty neighbours of one box as (dist, value): distances 1, 2, 3 ..., values run through the numbers 1 to 20.
DIST_VALUE = [(float(i + 1), float(7 * i % 20 + 1)) for i in range(20)]
GRID = Grid.from_bounds("d", 46.0, 51.0, -60.0, -53.0, 32.0)
SCHEMA = ("datasetName string, name string, box_index long, box_lat double, box_lon double, "
          "neighbors array<struct<dist:double,index:long,lat:double,lon:double,value:double>>")


def one_box(spark, neighbours):
    return spark.createDataFrame([("d", "f", 1, 0.0, 0.0, neighbours)], SCHEMA)


def plane(lat, lon):
    return 2 * lat - 3 * lon + 1


def test_first_values_of_the_known_list(spark):
    box = one_box(spark, [(d, i, 0.0, 0.0, v) for i, (d, v) in enumerate(DIST_VALUE)])
    assert simple.nearest(box, 1).first()["value"] == pytest.approx(1.0)
    assert simple.nearest(box, 5).first()["value"] == pytest.approx(7.0)
    m = simple.data_metrics(box, 20).first()
    v = np.array([x for _, x in DIST_VALUE])
    assert m["median"] == pytest.approx(np.median(v)) and m["Q3"] == pytest.approx(np.percentile(v, 75))
    assert m["var"] == pytest.approx(v.var(ddof=1)) and m["CV"] == pytest.approx(v.std() / v.mean() * 100)


def test_no_or_coincident_neighbours(spark):
    assert simple.nearest(one_box(spark, []), 3).first()["value"] is None
    assert simple.idw(one_box(spark, [])).first()["value"] is None
    assert simple.idw(one_box(spark, [(0.0, 1, 0.0, 0.0, 7.0), (1.0, 2, 1.0, 0.0, 9.0)])).first()["value"] == 7.0
    near = [(0.0, 1, 0.0, 0.0, 7.0), (1.0, 2, 1.0, 0.0, 9.0), (1.0, 3, 0.0, 1.0, 5.0)]
    exact = solvers.ordinary_kriging(one_box(spark, near), 3, "linear", F.array(F.lit(2.0), F.lit(0.0))).first()["value"]
    assert exact == pytest.approx(7.0)
    assert solvers.ordinary_kriging(one_box(spark, near), 4, "linear", F.array(F.lit(2.0), F.lit(0.0))).first()["value"] is None
    assert solvers.local_polynomial(one_box(spark, near), 5).first()["value"] is None


@pytest.mark.parametrize("degree", [2, 3])
def test_polynomials_reproduce_polynomials(degree):
    rng = np.random.default_rng(0)
    lat, lon = rng.uniform(46, 51, (20, 16)), rng.uniform(-60, -53, (20, 16))
    f = lambda a, o: 3 + a - 2 * o + 0.1 * a * o - 0.2 * o * o
    at_lat, at_lon = lat.mean(1), lon.mean(1)
    got = solvers.fit_polynomials(lat, lon, f(lat, lon), at_lat, at_lon, degree)
    assert np.allclose(got, f(at_lat, at_lon), atol=1e-6)


def test_underdetermined_polynomial_is_the_minimum_norm_fit():
    rng = np.random.default_rng(1)
    lat, lon, val = rng.uniform(46, 51, (1, 5)), rng.uniform(-60, -53, (1, 5)), rng.normal(size=(1, 5))
    terms = lambda a, o: np.stack([a, o, a * a, a * o, o * o], -1)
    x = terms(lat[0], lon[0])
    beta = np.linalg.lstsq(x - x.mean(0), val[0] - val[0].mean(), rcond=None)[0]
    want = val[0].mean() + (terms(48.0, -56.0) - x.mean(0)) @ beta
    assert solvers.fit_polynomials(lat, lon, val, np.array([48.0]), np.array([-56.0]), 2)[0] == pytest.approx(want, rel=1e-6)


@pytest.mark.parametrize("model,params", [("linear", [1.0, 0.1]), ("spherical", [1.0, 2.0, 0.1]), ("gaussian", [1.0, 2.0, 0.1]),
                                          ("exponential", [1.0, 2.0, 0.0]), ("power", [1.0, 1.5, 0.0])])
def test_kriging_weights_sum_to_one_and_models_refit(model, params):
    rng = np.random.default_rng(2)
    lat, lon = rng.uniform(0, 3, (7, 6)), rng.uniform(0, 3, (7, 6))
    w = solvers.kriging_weights(lat, lon, np.full(7, 1.5), np.full(7, 1.5), model, np.tile(params, (7, 1)))
    assert np.allclose(w.sum(1), 1)
    h = np.linspace(0.2, 3, 12)
    g = solvers.semivariance(model, h, np.array(params))
    assert np.allclose(solvers.semivariance(model, h, fit_model(model, h, g)), g, rtol=1e-3, atol=1e-3)


def test_singular_kriging_gives_the_mean(spark):
    near = [(1.0, 1, 1.0, 0.0, 4.0), (1.0, 2, 1.0, 0.0, 6.0)]
    assert solvers.ordinary_kriging(one_box(spark, near), 2, "linear", F.array(F.lit(1.0), F.lit(0.0))).first()["value"] == pytest.approx(5.0)


def test_variogram_equals_all_pairs(spark):
    samples, _ = lattice(spark, 4, 0.2)
    from test_neighbors import GRID as g16
    got = {r["lag"]: r for r in empirical_variogram(spark.createDataFrame(samples), g16, 0.9).collect()}
    d = np.hypot((samples.box_x.values[:, None] - samples.box_x.values) * g16.lat_gap, (samples.box_y.values[:, None] - samples.box_y.values) * g16.lon_gap)
    h = 0.5 * (samples.value.values[:, None] - samples.value.values) ** 2
    i, j = np.triu_indices(len(samples), 1)
    use = d[i, j] <= 0.9
    lag = np.minimum((d[i, j][use] / 0.15).astype(int), 5)
    for n in range(6):
        assert got[n]["n"] == (lag == n).sum()
        assert got[n]["gamma"] == pytest.approx(h[i, j][use][lag == n].mean())
    assert fit_variogram(empirical_variogram(spark.createDataFrame(samples), g16, 0.9), "spherical").count() == 1


@pytest.mark.parametrize("block", [50_000, 300])
def test_scattered_variogram_equals_all_pairs(spark, monkeypatch, block):
    from gridfill.operators import variogram
    monkeypatch.setattr(variogram, "BLOCK_POINTS", block)
    monkeypatch.setattr(variogram, "CELL_POINTS", 200)
    rng = np.random.default_rng(8)
    n = 5000 if block > 300 else 1500
    lat, lon = rng.uniform(46, 51, n), rng.uniform(-60, -53, n)
    lat[: n // 3], lon[: n // 3] = 48 + rng.uniform(0, 0.05, n // 3), -55 + rng.uniform(0, 0.05, n // 3)  # a third of all in one place
    samples = pd.DataFrame({"datasetName": "d", "name": "f", "index": np.arange(n), "lat": lat, "lon": lon, "value": 1000 + lat + rng.normal(size=n)})
    got = {r["lag"]: r for r in variogram.scattered_variogram(spark.createDataFrame(samples)).collect()}
    i, j = np.triu_indices(n, 1)
    d, h = np.hypot(lat[i] - lat[j], lon[i] - lon[j]), 0.5 * (samples.value.values[i] - samples.value.values[j]) ** 2
    lag = np.minimum((d / (np.hypot(np.ptp(lat), np.ptp(lon)) / 6)).astype(int), 5)
    for k in range(6):
        assert got[k]["n"] == (lag == k).sum()
        assert got[k]["gamma"] == pytest.approx(h[lag == k].mean(), rel=1e-9) and got[k]["dist"] == pytest.approx(d[lag == k].mean(), rel=1e-6)


def test_scattered_variogram_counts_stacked_samples_by_position(spark, monkeypatch):
    from gridfill.operators import variogram
    seen = []
    whole = variogram.materialize
    monkeypatch.setattr(variogram, "materialize", lambda df: seen.append(whole(df)) or seen[-1])
    rng = np.random.default_rng(9)
    n, places = 4000, 150
    at = rng.integers(0, places, n)
    lat, lon = rng.uniform(46, 51, places)[at], rng.uniform(-60, -53, places)[at]
    samples = pd.DataFrame({"datasetName": "d", "name": "f", "index": np.arange(n), "lat": lat, "lon": lon, "value": 1000 + lat + rng.normal(size=n)})
    got = {r["lag"]: r for r in variogram.scattered_variogram(spark.createDataFrame(samples)).collect()}
    i, j = np.triu_indices(n, 1)
    d, h = np.hypot(lat[i] - lat[j], lon[i] - lon[j]), 0.5 * (samples.value.values[i] - samples.value.values[j]) ** 2
    lag = np.minimum((d / (np.hypot(np.ptp(lat), np.ptp(lon)) / 6)).astype(int), 5)
    for k in range(6):
        assert got[k]["n"] == (lag == k).sum()
        assert got[k]["gamma"] == pytest.approx(h[lag == k].mean(), rel=1e-9) and got[k]["dist"] == pytest.approx(d[lag == k].mean(), rel=1e-6)
    assert max(df.count() for df in seen) <= places  # no step after the first reads a row per sample


# ---------------------------------------------------------------- meshes

def mesh_samples(spark, seed=11, n=60):
    rng = np.random.default_rng(seed)
    boxes = rng.choice(GRID.all_num, n, replace=False)
    x, y = boxes // GRID.y_num, boxes % GRID.y_num
    lat, lon = GRID.lat_min + (x + .5) * GRID.lat_gap, GRID.lon_min + (y + .5) * GRID.lon_gap
    return pd.DataFrame({"datasetName": "d", "name": "f", "index": boxes, "box_x": x, "box_y": y, "lat": lat, "lon": lon, "value": plane(lat, lon)})


def brute_triangles(pts, ids):
    """All empty triples; a circle's points form a fan from the lowest id."""
    from itertools import combinations
    out = set()
    for t in combinations(range(len(pts)), 3):
        a, b, c = pts[list(t)]
        det = 2 * ((b - a)[0] * (c - a)[1] - (b - a)[1] * (c - a)[0])
        if abs(det) < 1e-12:
            continue
        b2, c2 = ((b - a) ** 2).sum(), ((c - a) ** 2).sum()
        o = a + np.array([(c - a)[1] * b2 - (b - a)[1] * c2, (b - a)[0] * c2 - (c - a)[0] * b2]) / det
        d2, r2 = ((pts - o) ** 2).sum(1), ((a - o) ** 2).sum()
        if (d2 < r2 * (1 - 1e-9)).any():
            continue
        ring = np.flatnonzero(abs(d2 - r2) <= r2 * 1e-9)
        ring = ring[np.argsort(np.arctan2(*(pts[ring] - o).T))]
        ring = np.roll(ring, -np.argmin(ids[ring]))
        place = sorted(list(ring).index(i) for i in t)
        if place[0] == 0 and place[2] == place[1] + 1:
            out.add(tuple(sorted(ids[list(t)])))
    return out


@pytest.fixture(scope="module")
def meshed(spark):
    samples = mesh_samples(spark)
    tri = delaunay(spark.createDataFrame(samples), GRID).cache()
    return samples, tri


def test_triangles_equal_brute_force_on_a_lattice(meshed):
    samples, tri = meshed
    pts = np.c_[samples.box_x * GRID.lat_gap, samples.box_y * GRID.lon_gap]
    got = [tuple(sorted((r["point1"], r["point2"], r["point3"]))) for r in tri.collect()]
    assert len(got) == len(set(got)) and set(got) == brute_triangles(pts, samples["index"].values)
    assert sorted(r["tri_index"] for r in tri.collect()) == list(range(len(got)))


def test_triangles_of_scattered_points(spark):
    rng = np.random.default_rng(4)
    lat, lon = rng.uniform(46.1, 50.9, 45), rng.uniform(-59.9, -53.1, 45)
    samples = pd.DataFrame({"datasetName": "d", "name": "f", "index": np.arange(45), "lat": lat, "lon": lon, "value": 1.0})
    got = {tuple(sorted((r["point1"], r["point2"], r["point3"]))) for r in delaunay(spark.createDataFrame(samples), GRID, first_k=8).collect()}
    assert got == brute_triangles(np.c_[lat, lon], np.arange(45))


def test_square_and_line(spark):
    rows = [("d", "square", i, x, y, 0.0, 0.0, float(x - 2 * y)) for i, (x, y) in enumerate([(2, 2), (2, 4), (4, 2), (4, 4)])]
    rows += [("d", "line", i, i, i, 0.0, 0.0, 1.0) for i in range(5)]
    s = spark.createDataFrame(rows, "datasetName string, name string, index long, box_x long, box_y long, lat double, lon double, value double")
    tri = delaunay(s, GRID).cache()
    assert {(r["name"], *sorted((r["point1"], r["point2"], r["point3"]))) for r in tri.collect()} == {("square", 0, 1, 3), ("square", 0, 2, 3)}
    located = boxes_in_triangles(tri, GRID)
    assert located.count() == 9
    mid = linear_triangulation(located).where(F.col("box_index") == 3 * GRID.y_num + 3).first()["value"]
    assert mid == pytest.approx(-3.0)


def test_mesh_methods_reproduce_a_plane(spark, meshed):
    samples, tri = meshed
    located = boxes_in_triangles(tri, GRID).cache()
    at = spark.createDataFrame([(i, float(GRID.lat_min + (i // GRID.y_num + .5) * GRID.lat_gap), float(GRID.lon_min + (i % GRID.y_num + .5) * GRID.lon_gap))
                                for i in range(GRID.all_num)], "box_index long, lat double, lon double")
    for result, tolerance in ((linear_triangulation(located), 1e-9), (natural_neighbour(located, tri, GRID), 1e-9), (minimum_curvature(tri, GRID), 1e-6)):
        rows = result.join(at, "box_index").where("value is not null").collect()
        assert len(rows) > 100
        assert max(abs(r["value"] - plane(r["lat"], r["lon"])) for r in rows) < tolerance
    known = {r["box_index"]: r["value"] for r in natural_neighbour(located, tri, GRID).collect()}
    assert all(known[b] == pytest.approx(v) for b, v in zip(samples["index"], samples.value))


def test_sibson_weights_equal_counted_areas(spark):
    samples = mesh_samples(spark, 21, 25)
    samples["value"] = np.random.default_rng(0).normal(size=len(samples))
    tri = delaunay(spark.createDataFrame(samples), GRID)
    got = {r["box_index"]: r["value"] for r in natural_neighbour(boxes_in_triangles(tri, GRID), tri, GRID).collect() if r["value"] is not None}
    pts = np.c_[samples.box_x + .5, (samples.box_y + .5) * GRID.lon_gap / GRID.lat_gap]
    span = np.arange(-15, 45, 0.05)
    gx, gy = np.meshgrid(span, span, indexing="ij")
    near = np.min([(gx - p[0]) ** 2 + (gy - p[1]) ** 2 for p in pts], 0)
    owner = np.argmin([(gx - p[0]) ** 2 + (gy - p[1]) ** 2 for p in pts], 0)
    inner = [b for b in got if b not in set(samples["index"]) and abs(b // GRID.y_num - 8) < 3 and abs(b % GRID.y_num - 8) < 3][:4]
    assert inner
    for b in inner:
        q = (b // GRID.y_num + .5, (b % GRID.y_num + .5) * GRID.lon_gap / GRID.lat_gap)
        taken = (gx - q[0]) ** 2 + (gy - q[1]) ** 2 < near
        w = np.bincount(owner[taken], minlength=len(pts))
        assert got[b] == pytest.approx((w @ samples.value.values) / w.sum(), abs=0.03)


def test_cubic_patch_reproduces_quadratics_and_joins_smoothly():
    f = lambda p: 1 + p[..., 0] - 2 * p[..., 1] + 0.5 * p[..., 0] ** 2 - p[..., 0] * p[..., 1]
    g = lambda p: np.stack([1 + p[..., 0] - p[..., 1], -2 - p[..., 0]], -1)
    xy = np.array([[[0, 0], [4, 1], [1, 3]]], float)
    across = np.array([[[4, 3], [-1, 2], [2, -2]]], float)
    for at in ([1.5, 1.2], [0.5, 0.6], [3.0, 1.2]):
        assert cubic_patch(xy, f(xy), g(xy), across, np.array([at]))[0] == pytest.approx(f(np.array(at)))


def test_vertices_by_number(spark, meshed):
    samples, tri = meshed
    rows = with_vertices(tri, spark.createDataFrame(samples)).collect()
    value = dict(zip(samples["index"], samples.value))
    assert len(rows) == tri.count()
    assert all(r["value2"] == pytest.approx(value[r["point2"]]) for r in rows)


@pytest.mark.parametrize("function", ["multiquadric", "linear"])
def test_rbf_tiles_fill_every_box(spark, function):
    samples = mesh_samples(spark, 5, 40)
    boxes = np.arange(GRID.all_num)
    targets = pd.DataFrame({"datasetName": "d", "name": "f", "box_index": boxes, "box_x": boxes // GRID.y_num, "box_y": boxes % GRID.y_num,
                            "box_lat": 0.0, "box_lon": 0.0})
    tiled = tiled_rbf(spark.createDataFrame(targets), spark.createDataFrame(samples), GRID, function, 4)
    assert tiled.where("value is null").count() == 0 and tiled.count() == len(targets)
    with pytest.raises(ValueError):
        tiled_rbf(spark.createDataFrame(targets), spark.createDataFrame(samples), GRID, function, 0)


def test_local_rbf_uses_the_neighbours_there_are(spark):
    points = [(0.1 * i, i, 0.3 * i, 0.1 * i * i, 2.0 * i + 1) for i in range(6)]
    few = solvers.local_rbf(one_box(spark, points), 32, "linear").first()["value"]
    exact = solvers.local_rbf(one_box(spark, points), 6, "linear").first()["value"]
    assert few == pytest.approx(exact) and few != pytest.approx(np.mean([p[-1] for p in points]))
    assert solvers.local_rbf(one_box(spark, points[:1]), 32, "linear").first()["value"] == pytest.approx(1.0)


def test_delaunay_ends_on_near_equal_positions(spark):
    rng = np.random.default_rng(4)
    lat = np.r_[rng.uniform(46.5, 50.5, 20), 48.0 + rng.uniform(0, 1e-8, 20)]
    lon = np.r_[rng.uniform(-59.5, -53.5, 20), -56.0 + rng.uniform(0, 1e-8, 20)]
    samples = pd.DataFrame({"datasetName": "d", "name": "f", "index": np.arange(40), "lat": lat, "lon": lon, "value": 1.0})
    found = delaunay(spark.createDataFrame(samples), GRID).toPandas()
    assert set(found[["point1", "point2", "point3"]].to_numpy().ravel()) == set(range(40))  # near is not equal
    area = ((found.u2 - found.u1) * (found.v3 - found.v1) - (found.u3 - found.u1) * (found.v2 - found.v1)).abs().sum() / 2
    u, v = (lat - GRID.lat_min) / GRID.lat_gap, (lon - GRID.lon_min) / GRID.lon_gap
    hull = regions.convex_hulls(spark.createDataFrame(pd.DataFrame({"k": 1, "lat": u, "lon": v})), ["k"]).first()["vertices"]
    x, y = (np.array([p[c] for p in hull]) for c in ("lat", "lon"))
    assert area == pytest.approx(abs(x @ np.roll(y, -1) - y @ np.roll(x, -1)) / 2, rel=1e-9)
