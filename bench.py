"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

All methods fill the 2 km grid of the order samples (71,724 boxes, two features). `prepare` builds box means
and the list of empty boxes from the raw table; the methods start from those two tables, as they do in a
pipeline. Each method's time includes its neighbour search, mesh or variogram.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from gridfill.operators import mesh, natural, regions, simple, solvers, summaries, variogram  # noqa: E402
from gridfill.operators.aggregate import box_values  # noqa: E402
from gridfill.operators.cubic import minimum_curvature  # noqa: E402
from gridfill.operators.grid import Grid, pyramid_map  # noqa: E402
from gridfill.operators.neighbors import knn  # noqa: E402
from gridfill.operators.prep import first_per_position, wide_to_long  # noqa: E402
from gridfill.operators.rbf import tiled_rbf  # noqa: E402
from gridfill.plans import base  # noqa: E402
from gridfill.session import build_session, materialize  # noqa: E402

KEYS = ["datasetName", "name"]
STEP = float(os.environ.get("BENCH_GRID_KM", "2"))


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    spark = build_session("gridfill-bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        # Tables of a few MB: let small partitions stand, so that all cores take part.
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k", "spark.sql.files.openCostInBytes": "64k"})
    spark.sparkContext.setLogLevel("ERROR")
    grid = base.grid_of("demo", STEP)
    times: dict[str, float] = {}
    boxes: dict[str, int] = {}

    def timed(name: str, build) -> None:
        if only and name not in only:
            return
        start = time.time()
        row = build().agg(F.count("*").alias("n")).first()
        times[name], boxes[name] = round(time.time() - start, 3), row["n"]
        print(f"{name:22} {times[name]:8.2f}s {boxes[name]:9} rows", file=sys.stderr, flush=True)

    # One small job first, so that no query pays for starting the JVM.
    base.order_samples(spark, sf).groupBy("datasetName").count().collect()
    start = time.time()
    long = base.order_long(spark, sf)
    means = base.order_means(spark, sf, STEP)
    targets = base.order_targets(spark, sf, STEP)
    times["prepare"] = round(time.time() - start, 3)
    boxes["prepare"] = targets.count()
    n_means = means.count()

    def near(k, **search):
        return knn(targets, means, grid, k, **search)

    value = lambda df: df.where(F.col("value").isNotNull())
    timed("box_mean", lambda: box_values(long, grid))
    timed("box_median", lambda: box_values(long, grid, "median"))
    timed("pyramid_map", lambda: pyramid_map(base.order_samples(spark, sf), grid))
    timed("first_per_position", lambda: first_per_position(base.order_samples(spark, sf), "index"))
    timed("fences", lambda: summaries.fences(long))
    timed("nearest_ring", lambda: value(simple.nearest(near(5, metric="alpha", exact=False, need=1, start_level=2), 5)))
    timed("idw", lambda: value(simple.idw(near(8), 8)))
    timed("metrics", lambda: simple.metrics_long(near(5), 5))
    timed("local_polynomial", lambda: value(solvers.local_polynomial(near(16), 16, 2)))

    def krige():
        fit = materialize(variogram.fit_variogram(variogram.empirical_variogram(means, grid, 0.2), "spherical"))
        return value(solvers.ordinary_kriging(near(5).join(fit, KEYS, "left"), 5, "spherical"))

    timed("kriging", krige)
    timed("rbf", lambda: value(tiled_rbf(targets, means, grid, "multiquadric", 8)))
    tri = {}

    def triangulate():
        tri["t"] = materialize(mesh.delaunay(means, grid))
        return tri["t"]

    if not only or {"linear", "natural_neighbour", "minimum_curvature", "delaunay"} & set(only):
        timed("delaunay", triangulate)
        if "t" not in tri:
            triangulate()
        located = materialize(mesh.boxes_in_triangles(tri["t"], grid).join(targets.select(*KEYS, "box_index"), [*KEYS, "box_index"], "left_semi"))
        timed("linear", lambda: value(mesh.linear_triangulation(mesh.boxes_in_triangles(tri["t"], grid))))
        timed("natural_neighbour", lambda: value(natural.natural_neighbour(located, tri["t"], grid)))
        timed("minimum_curvature", lambda: value(minimum_curvature(tri["t"], grid)))
    timed("hull", lambda: regions.convex_hulls(base.customer_samples(spark, sf), ["region"]))
    timed("label_regions", lambda: regions.label_regions(base.order_samples(spark, sf), base.polygons(spark, sf), "lat", "lon"))
    print(json.dumps({"metric": "total seconds, all methods on the 2 km grid", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf.rstrip("/")), "rows": boxes, "samples": n_means,
                      "grid_km": STEP, "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
