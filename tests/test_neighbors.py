import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridfill.operators.grid import Grid
from gridfill.operators.neighbors import collect_neighbours, knn, neighbour_ids, ring_members, window_members

GRID = Grid.from_bounds("d", 46.0, 51.0, -60.0, -53.0, 16.0)


def lattice(spark, seed, share, name="f"):
    """Random share of the grid's boxes as samples, the rest as targets."""
    rng = np.random.default_rng(seed)
    all_boxes = np.arange(GRID.all_num)
    known = rng.random(GRID.all_num) < share
    x, y = all_boxes // GRID.y_num, all_boxes % GRID.y_num
    samples = pd.DataFrame({"datasetName": "d", "name": name, "index": all_boxes[known], "box_x": x[known], "box_y": y[known],
                            "lat": GRID.lat_min + (x[known] + .5) * GRID.lat_gap, "lon": GRID.lon_min + (y[known] + .5) * GRID.lon_gap,
                            "value": rng.normal(size=known.sum())})
    targets = pd.DataFrame({"datasetName": "d", "name": name, "box_index": all_boxes[~known], "box_x": x[~known], "box_y": y[~known],
                            "box_lat": GRID.lat_min + (x[~known] + .5) * GRID.lat_gap, "box_lon": GRID.lon_min + (y[~known] + .5) * GRID.lon_gap})
    return samples, targets


def brute(samples, targets, k):
    d = np.sqrt(((samples.box_x.values - targets.box_x.values[:, None]) * GRID.lat_gap) ** 2
                + ((samples.box_y.values - targets.box_y.values[:, None]) * GRID.lon_gap) ** 2)
    order = np.lexsort((np.broadcast_to(samples["index"].values, d.shape), d), axis=1)[:, :k]
    return {b: list(samples["index"].values[o]) for b, o in zip(targets.box_index, order)}


def ids(df):
    return {r["box_index"]: [n["index"] for n in r["neighbors"]] for r in df.select("box_index", "neighbors").collect()}


@pytest.mark.parametrize("share,k,max_pairs", [(0.02, 5, 1 << 20), (0.3, 7, 1 << 20), (0.02, 5, 500)])
def test_exact_knn_equals_brute_force_with_ties(spark, share, k, max_pairs):
    samples, targets = lattice(spark, 1, share)
    found = knn(spark.createDataFrame(targets), spark.createDataFrame(samples), GRID, k, max_pairs=max_pairs)
    assert ids(found) == brute(samples, targets, k)


def test_one_dense_corner_is_split_not_dropped(spark):
    """All samples in one corner: far boxes would see every sample of it."""
    samples, targets = lattice(spark, 3, 0.5)
    samples = samples[(samples.box_x < 12) & (samples.box_y < 12)]
    found = knn(spark.createDataFrame(targets), spark.createDataFrame(samples), GRID, 3, max_pairs=2000)
    assert ids(found) == brute(samples, targets, 3)


def test_fewer_samples_than_k_and_features_without_samples(spark):
    samples, targets = lattice(spark, 2, 0.1)
    samples = samples.head(3)
    other = targets.assign(name="empty").head(10)
    found = knn(spark.createDataFrame(pd.concat([targets, other])), spark.createDataFrame(samples), GRID, 5)
    rows = found.groupBy("name").agg(F.min(F.size("neighbors")).alias("lo"), F.max(F.size("neighbors")).alias("hi"), F.count("*").alias("n")).collect()
    assert {(r["name"], r["lo"], r["hi"], r["n"]) for r in rows} == {("f", 3, 3, len(targets)), ("empty", 0, 0, 10)}


def test_ring_search_needs_enough(spark):
    samples, targets = lattice(spark, 2, 0.1)
    found = knn(spark.createDataFrame(targets), spark.createDataFrame(samples.head(4)), GRID, 5, exact=False)
    assert neighbour_ids(found, 5).where("neigh is not null").count() == 0
    assert found.count() == len(targets)


def test_stacked_raw_samples(spark):
    """A third of all samples on one position: the lowest numbers come first, nothing else changes."""
    rng = np.random.default_rng(5)
    lat = np.concatenate([rng.uniform(46.1, 50.9, 200), np.full(100, 48.0)])
    lon = np.concatenate([rng.uniform(-59.9, -53.1, 200), np.full(100, -56.0)])
    samples = pd.DataFrame({"datasetName": "d", "name": "f", "index": np.arange(300), "lat": lat, "lon": lon, "value": 1.0})
    _, targets = lattice(spark, 1, 0.5)
    targets = targets.drop(columns=["box_x", "box_y"])
    found = ids(knn(spark.createDataFrame(targets), spark.createDataFrame(samples), GRID, 4))
    d = np.hypot(lat - targets.box_lat.values[:, None], lon - targets.box_lon.values[:, None]).round(9)
    order = np.lexsort((np.broadcast_to(np.arange(300), d.shape), d), axis=1)[:, :4]
    assert found == {b: list(o) for b, o in zip(targets.box_index, order)}


def test_result_does_not_depend_on_partitions(spark):
    samples, targets = lattice(spark, 7, 0.1)
    one = ids(knn(spark.createDataFrame(targets).coalesce(1), spark.createDataFrame(samples).coalesce(1), GRID, 5))
    many = ids(knn(spark.createDataFrame(targets).repartition(13), spark.createDataFrame(samples).repartition(7), GRID, 5))
    assert one == many


def test_collector_ties_take_the_lower_index(spark):
    pairs = spark.createDataFrame([("a", 1.0, 4, 0.0, 0.0, 1.0), ("a", 1.0, 2, 0.0, 0.0, 2.0), ("a", 0.5, 9, 0.0, 0.0, 3.0)],
                                  "t string, dist double, index long, lat double, lon double, value double")
    row = collect_neighbours(pairs, ["t"], 2).first()
    assert [n["index"] for n in row["neighbors"]] == [9, 2]


@pytest.mark.parametrize("build", [lambda t, s: ring_members(t, s, 4), lambda t, s: window_members(t, s, 3), lambda t, s: knn(t, s, GRID, 3)])
def test_plans_have_no_cartesian_product(spark, build):
    samples, targets = lattice(spark, 1, 0.1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = build(spark.createDataFrame(targets), spark.createDataFrame(samples))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
