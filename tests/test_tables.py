import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridfill.operators import grid as gr
from gridfill.operators import aggregate, prep, regions, summaries
from gridfill.operators.aggregate import box_values, exact_quantiles, fill_missing, outside
from gridfill.plans import fill, registry
from gridfill.plans.prepare import prepare
from gridfill.sources import tables
from test_neighbors import GRID, lattice


def test_box_assignment_edges(spark):
    g = gr.Grid("d", 1.0, 0.0, 2.0, 0.0, 3.0, 1.0, 1.0, 2, 3)
    s = spark.createDataFrame([(1, 2.0, 3.0), (2, -0.5, 0.5), (3, 1.5, 0.0)], "index long, lat double, lon double")
    got = {r["index"]: (r["box_indx"], r["box_indy"], r["box_index"]) for r in g.assign(s.withColumn("datasetName", F.lit("d"))).collect()}
    assert got == {1: (1, 2, 5), 2: (None, 0, None), 3: (1, 0, 3)}


def test_box_index_round_trip(spark):
    boxes = GRID.boxes(spark)
    back = boxes.withColumn("again", GRID.position_to_index(F.col("box_lat"), F.col("box_lon")))
    assert back.where("again <> box_index").count() == 0 and boxes.count() == GRID.all_num


def test_pyramid_doubles_below_the_limit(spark):
    levels = [g.grid_length for g in gr.pyramid_grids(GRID)]
    b = spark.createDataFrame([("d", 46.0, 51.0, -60.0, -53.0)], "datasetName string, lat_min double, lat_max double, lon_min double, lon_max double")
    assert levels == [16.0, 32.0, 64.0, 128.0, 256.0]
    assert sorted(r["grid_length"] for r in gr.pyramid(b, F.lit(16.0)).collect()) == levels
    total = gr.pyramid_box_count(b, [16.0, 32.0]).first()["all_num"]
    assert total == sum(g.all_num for g in gr.pyramid_grids(GRID))


def test_preparation_of_awkward_values(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, "x"), (2, 1.0, 0.0, "2.5"), (3, -3.0, 2.0, None), (4, 8.0, 2.0, "nan")], "index long, a double, b double, t string")
    got = {r["index"]: r for r in prep.coerce_numbers(prep.clamp_negatives(prep.add_log10(prep.add_ratio(df, "r", "a", "b"), "l", "a"), ["a"]), ["t"]).collect()}
    assert got[1]["r"] == 0 and got[2]["r"] is None and got[4]["r"] == 4
    assert got[1]["l"] is None and got[3]["l"] is None and got[3]["a"] == 0
    assert [got[i]["t"] for i in (1, 2, 3, 4)] == [None, 2.5, None, None]


def test_dense_index_is_consecutive(spark):
    df = spark.range(1000).repartition(7).select((F.col("id") * 3).alias("k"))
    rows = prep.dense_index(df, ["k"]).collect()
    assert {r["k"]: r["index"] for r in rows} == {3 * i: i for i in range(1000)}


@pytest.mark.parametrize("partition", [1 << 20, 50])
def test_quantiles_of_hot_groups_are_exact(spark, partition, monkeypatch):
    monkeypatch.setattr(aggregate, "PARTITION", partition)
    rng = np.random.default_rng(0)
    name = np.where(np.arange(4000) % 3 == 0, "rare", "hot")
    name[-900:] = [f"n{i // 3}" for i in range(900)]
    pdf = pd.DataFrame({"k": np.arange(4000) % 2, "name": name, "value": rng.normal(size=4000).round(2)})
    pdf.loc[pdf.name == "n7", "value"] = 1.5
    got = {(r["k"], r["name"]): r for r in exact_quantiles(spark.createDataFrame(pdf), ["k", "name"], {"a": 0.0, "q": 0.25, "m": 0.5, "z": 1.0}).collect()}
    groups = dict(list(pdf.groupby(["k", "name"])))
    assert got.keys() == groups.keys()
    for key, part in groups.items():
        for out, p in (("a", 0), ("q", .25), ("m", .5), ("z", 1)):
            assert got[key][out] == pytest.approx(np.quantile(part.value, p))


def test_quantiles_of_odd_values(spark):
    inf, nan = float("inf"), float("nan")
    rows = [("a", 1.0), ("a", inf), ("a", inf), ("b", None), ("c", -inf), ("c", 3.0), (None, 4.0), (None, 6.0), ("d", 2.0), ("d", nan)]
    got = {r["name"]: (r["lo"], r["hi"]) for r in exact_quantiles(spark.createDataFrame(rows, "name string, value double"), ["name"], {"lo": 0.0, "hi": 1.0}).collect()}
    assert got.keys() == {"a", "c", "d", None} and got["a"] == (1.0, inf) and got["c"] == (-inf, 3.0) and got[None] == (4.0, 6.0)
    assert got["d"][0] == 2.0 and np.isnan(got["d"][1])
    assert exact_quantiles(spark.createDataFrame([], "name string, value double"), ["name"], {"m": 0.5}).count() == 0


def test_one_group_spreads_over_all_partitions(spark, monkeypatch):
    monkeypatch.setattr(aggregate, "PARTITION", 100_000)
    rows = spark.range(1_000_000).select(F.lit("one").alias("name"), (F.col("id") * 7919 % 1_000_003).cast("double").alias("value"))
    seen = []
    keep = aggregate.materialize
    monkeypatch.setattr(aggregate, "materialize", lambda df: seen.append(keep(df)) or seen[-1])
    (r,) = exact_quantiles(rows, ["name"], {"q": 0.25, "m": 0.5}).collect()
    v = np.arange(1_000_000) * 7919 % 1_000_003
    assert (r["q"], r["m"]) == (np.quantile(v, 0.25), np.median(v))
    sizes = [x["count"] for x in seen[-1].groupBy("_part").count().collect()]
    assert len(sizes) >= 8 and max(sizes) < 300_000


def test_counts_of_values_are_bounded_by_a_batch(spark, monkeypatch):
    """No task holds all values that differ: they are counted batch by batch, and added up where they are sorted."""
    plans, keep = [], aggregate.materialize
    monkeypatch.setattr(aggregate, "materialize", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df))
    rows = spark.range(60_000).select((F.col("id") % 2).alias("k"), F.when(F.col("id") % 3 == 0, F.lit(-0.0)).otherwise((F.col("id") * 7919 % 30_011).cast("double")).alias("value"))
    got = {r["k"]: (r["lo"], r["m"], r["hi"]) for r in exact_quantiles(rows, ["k"], {"lo": 0.0, "m": 0.5, "hi": 0.9}).collect()}
    i = np.arange(60_000)
    v = np.where(i % 3 == 0, 0.0, i * 7919 % 30_011)
    assert got == {k: tuple(np.quantile(v[i % 2 == k], p) for p in (0.0, 0.5, 0.9)) for k in (0, 1)}
    assert "Aggregate" not in plans[0]


def test_a_failing_feature_does_not_stop_the_others(spark, monkeypatch):
    samples, _ = lattice(spark, 9, 0.15)
    means = spark.createDataFrame(pd.concat([samples.assign(name=n) for n in ("a", "bad", "c")] + [samples.head(3).assign(name="short")]).assign(grid_length=16.0))

    def broken(method, params=None):
        run = real(method, params)
        stop = F.udf(lambda name: 1 / 0 if name == "bad" else 0.0, "double")
        return lambda t, m, g: run(t, m, g).withColumn("value", F.col("value") + stop("name"))

    real = fill.interpolator
    monkeypatch.setattr(fill, "interpolator", broken)
    reg, result, outcomes = fill.run_many(registry.empty_registry(spark), {"d": (means, GRID)}, "nn", minimum=4)
    told = {r["name"]: r for r in outcomes.collect()}
    assert [told[n]["is_valid"] for n in ("a", "bad", "c", "short")] == [True, False, True, False]
    assert "ZeroDivisionError" in told["bad"]["reason"] and told["short"]["reason"] == "fewer than 4 samples" and told["a"]["reason"] is None
    assert {r["name"] for r in result.select("name").distinct().collect()} == {"a", "c"}
    assert {r["feature_name"]: r["is_valid"] for r in reg.collect()} == {n: told[n]["is_valid"] for n in told}


def test_fill_keeps_known_boxes_for_every_method(spark):
    samples, _ = lattice(spark, 9, 0.15)
    means = spark.createDataFrame(samples.assign(grid_length=16.0)).cache()
    for method, params in (("nn", {}), ("idw", {"n_closest_points": 5}), ("DM", {"function": "Q1"}), ("polynomial", {"n_closest_points": 16}), ("krige", {"max_lag": 0.6})):
        out = fill.fill(means, GRID, method, params).toPandas().set_index("box_index")
        assert len(out) == GRID.all_num and out.value.notna().all()
        assert np.allclose(out.loc[samples["index"], "value"], samples.value)


def test_unknown_methods_and_values_are_errors(spark):
    for call in (lambda: registry.function_of("spline"), lambda: fill.interpolator("spline"), lambda: fill.interpolator("polynomial", {"degree": 0})):
        with pytest.raises(ValueError):
            call()


def test_registry_run_and_validity(spark):
    samples, _ = lattice(spark, 9, 0.15)
    means = spark.createDataFrame(pd.concat([samples, samples.assign(name="few").head(3)]).assign(grid_length=16.0))
    reg, result = fill.run(registry.empty_registry(spark), means, GRID, "polynomial", {"n_closest_points": 5, "degree": 2})
    rows = {r["feature_name"]: r for r in reg.collect()}
    assert rows["f"]["is_valid"] and not rows["few"]["is_valid"]
    assert rows["f"]["params"] == "degree,n_closest_points:2,5" and {r["method_id"] for r in rows.values()} == {1, 2}
    assert result.count() == 2 * GRID.all_num
    assert registry.register(reg, reg.drop("method_id", "is_valid")).count() == 2
    assert registry.next_method_id(result).first()["method_id"] == 3


def test_prepare_builds_all_tables(spark):
    wide = spark.createDataFrame([("d", i, 46 + i % 7 * 0.7, -60 + i % 11 * 0.6, float(i), None if i % 5 else 1.0) for i in range(100)],
                                 "datasetName string, index long, lat double, lon double, a double, b double")
    p = prepare(wide, ["a", "b"], "d", 32.0)
    assert p.long.count() == 120 and p.means.where("name='a'").count() == 77
    assert p.box_map.where("box_indx < 0 or box_indy < 0").count() == 0 and p.boxes.select("grid_length").distinct().count() == len(gr.pyramid_grids(p.grid))
    assert p.mean_map.count() == 77 * len(gr.pyramid_grids(p.grid))


def test_table_round_trip_prunes_partitions(spark, tmp_path):
    samples, _ = lattice(spark, 9, 0.15)
    means = spark.createDataFrame(samples.assign(grid_length=16.0, aggregate_func="mean"))
    path = str(tmp_path / "means")
    tables.append_table(means, path, tables.MEAN_PARTITIONS)
    tables.append_table(means.withColumn("name", F.lit("other")), path, tables.MEAN_PARTITIONS)
    read = tables.read_means(spark, path, "d", 16.0, "mean", "f")
    assert read.count() == len(samples)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(datasetName" in plan and "PushedFilters: [IsNotNull(aggregate_func)" in plan
    with pytest.raises(ValueError):
        tables.read_samples(spark, path)


def test_hull_and_polygon(spark):
    rng = np.random.default_rng(0)
    pts = np.r_[rng.uniform(0, 10, (500, 2)), [[0, 0], [0, 10], [10, 10], [10, 0], [5, 0]]]
    df = spark.createDataFrame(pd.DataFrame({"region": "r", "lat": pts[:, 0], "lon": pts[:, 1]})).repartition(5)
    hull = regions.convex_hulls(df, ["region"])
    assert {(v["lat"], v["lon"]) for v in hull.first()["vertices"]} == {(0, 0), (0, 10), (10, 10), (10, 0)}
    probe = spark.createDataFrame([(1, 5.0, 5.0), (2, 11.0, 5.0), (3, 5.0, 10.0), (4, 5.0, 0.0)], "id long, box_lat double, box_lon double")
    assert {r["id"] for r in regions.clip_to_polygons(probe, hull).collect()} == {1, 3}
    labelled = regions.label_regions(probe, hull.withColumn("priority", F.lit(1)))
    assert {r["id"]: r["region"] for r in labelled.collect()} == {1: "r", 2: "NULL", 3: "r", 4: "NULL"}
    two = hull.withColumn("priority", F.lit(1)).unionByName(hull.withColumns({"priority": F.lit(0), "region": F.lit("first")}))
    twice = probe.unionByName(probe)
    many = two.unionByName(two.withColumn("priority", F.explode(F.sequence(F.lit(2), F.lit(501)))))  # 1,002 polygons
    rows = [(r["id"], r["region"]) for r in regions.label_regions(twice, many).collect()]
    assert sorted(rows) == sorted(2 * [(1, "first"), (2, "NULL"), (3, "first"), (4, "NULL")])


def test_constant_features_and_pivot(spark):
    df = spark.createDataFrame([("d", "a", 0, 0, 1.0), ("d", "a", 0, 1, 2.0), ("d", "b", 0, 0, 5.0), ("d", "b", 0, 1, 5.0)],
                               "datasetName string, name string, box_x long, box_y long, value double")
    assert {r["name"] for r in summaries.drop_constant_features(df).collect()} == {"a"}
    row = summaries.grid_pivot(df).where("name='a'").first()
    assert (row["0"], row["1"]) == (1.0, 2.0)


def test_fill_missing_keeps_old(spark):
    old = spark.createDataFrame([(1, 1.0), (2, None), (3, None)], "id long, value double")
    new = spark.createDataFrame([(1, 9.0), (2, 8.0)], "id long, value double")
    assert {r["id"]: r["value"] for r in fill_missing(old, new, ["id"]).collect()} == {1: 1.0, 2: 8.0, 3: None}


@pytest.mark.parametrize("kind", ["fixed", "edge", "degree"])
def test_nearest_on_rasters(spark, kind):
    s = lattice(spark, 60, 0.1)[0]
    samples = spark.createDataFrame(s).withColumn("grid_length", F.lit(GRID.grid_length))
    raster = {"fixed": lambda: gr.fixed_count_raster(spark, GRID, 12, 12), "edge": lambda: gr.edge_raster(spark, GRID), "degree": lambda: gr.degree_raster(spark, GRID, 0.5)}[kind]()
    got = fill.fill_points(samples, GRID, "nn", raster).toPandas()
    for (dataset, name), part in got.groupby(["datasetName", "name"]):
        own = s[(s.datasetName == dataset) & (s.name == name)]
        d = np.hypot(part.box_lat.to_numpy()[:, None] - own.lat.to_numpy(), part.box_lon.to_numpy()[:, None] - own.lon.to_numpy())
        value = own.value.to_numpy()
        assert all(abs(value[np.abs(row - row.min()) < 1e-9] - v).min() < 1e-9 for row, v in zip(d, part.value))
    assert len(got) == raster.count() * s.groupby(["datasetName", "name"]).ngroups


def test_samples_outside_the_bounds_have_no_box(spark):
    s = spark.createDataFrame([("d", "f", 1, 46.5, -52.5, 1.0), ("d", "f", 2, 46.5, -59.0, 2.0)], "datasetName string, name string, index long, lat double, lon double, value double")
    assert [r["value"] for r in box_values(s, GRID).collect()] == [2.0]
    assert [r["n"] for r in outside(s, GRID).collect()] == [1]
