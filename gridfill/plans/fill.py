"""Whole runs: known boxes keep their values, every other box is filled by one method, all features at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfill.operators import simple, solvers
from gridfill.operators.aggregate import boxes_to_search, boxes_with_values, count_missing, feature_boxes, fill_missing, values_on_coarser
from gridfill.operators.cubic import minimum_curvature
from gridfill.operators.grid import Grid
from gridfill.operators.mesh import delaunay, linear_triangulation, locate
from gridfill.operators.natural import natural_neighbour
from gridfill.operators.neighbors import knn
from gridfill.operators.prep import features_with_enough
from gridfill.operators.rbf import tiled_rbf
from gridfill.operators.variogram import empirical_variogram, fit_variogram, full_variogram
from gridfill.plans import registry as reg
from gridfill.session import materialize

KEYS = ["datasetName", "name"]


def _by_neighbours(k: int, interpolate: Callable[[DataFrame], DataFrame], need: int, options: dict) -> Callable:
    search = {"metric": options.get("metric", "degrees"), "exact": options.get("exact", True),
              "start_level": options.get("start_level", 1)}

    def run(targets: DataFrame, means: DataFrame, grid: Grid) -> DataFrame:
        return interpolate(knn(targets, means, grid, k, need=need, **search)).select(*KEYS, "box_index", "value")

    return run


def _kriging(params: dict) -> Callable:
    k, model = int(params.get("n_closest_points", 5)), params.get("variogram_model", "linear")

    def run(targets: DataFrame, means: DataFrame, grid: Grid) -> DataFrame:
        near_only = params.get("max_lag")
        pairs = full_variogram(means, grid) if near_only is None else empirical_variogram(means, grid, near_only)
        fitted = materialize(fit_variogram(pairs, model))
        near = knn(targets, means, grid, k, metric=params.get("metric", "degrees"), exact=params.get("exact", True))
        return solvers.ordinary_kriging(near.join(fitted, KEYS, "left"), k, model).select(*KEYS, "box_index", "value")

    return run


def _mesh(interpolate: Callable) -> Callable:
    def run(targets: DataFrame, means: DataFrame, grid: Grid) -> DataFrame:
        triangles = materialize(delaunay(means, grid))
        return interpolate(materialize(locate(triangles, grid, targets)), triangles, grid)

    return run


def interpolator(method: str, params: dict | None = None) -> Callable[[DataFrame, DataFrame, Grid], DataFrame]:
    """(targets, box means, grid) -> (datasetName, name, box_index, value) for a method name.

    Names: nn, idw, moving_average, DM, polynomial, krige, rbf, triangle, natural_neighbor, min_curvature.
    """
    p = dict(params or {})
    reg.check_params(method, p)
    if method == "nn":
        k = int(p.get("n_closest_points", 1))
        return _by_neighbours(k, lambda d: simple.nearest(d, k), 1, p)
    if method == "moving_average":
        k = int(p.get("n_closest_points", 5))
        return _by_neighbours(k, lambda d: simple.moving_average(d, k), 1, p)
    if method == "idw":
        k = int(p.get("n_closest_points", 8))
        return _by_neighbours(k, lambda d: simple.idw(d, k, float(p.get("power", 1.0))), 1, p)
    if method == "DM":
        k, func = int(p.get("n_closest_points", 5)), p.get("function", "median")
        return _by_neighbours(k, lambda d: simple.data_metrics(d, k).withColumn("value", F.col(func)), 1, p)
    if method == "polynomial":
        k, degree = int(p.get("n_closest_points", 16)), int(p.get("degree", 2))
        return _by_neighbours(k, lambda d: solvers.local_polynomial(d, k, degree), k, p)
    if method == "krige":
        return _kriging(p)
    if method == "rbf":
        return lambda t, m, g: tiled_rbf(t, m, g, p.get("function", "multiquadric"), int(p.get("tile", 8))).select(*KEYS, "box_index", "value")
    if method == "triangle":
        return _mesh(lambda located, _, __: linear_triangulation(located, p.get("weights", "barycentric")))
    if method == "natural_neighbor":
        return _mesh(natural_neighbour)
    if method == "min_curvature":
        return lambda t, m, g: minimum_curvature(materialize(delaunay(m, g)), g, float(p.get("tolerance", 1e-6)), targets=t)
    raise ValueError(f"method {method!r} is not known")


def fill(means: DataFrame, grid: Grid, method: str, params: dict | None = None, boxes: DataFrame | None = None,
         aggr_func: str = "mean", keep_known: bool = True) -> DataFrame:
    """(datasetName, name, box_index, box_lat, box_lon, value) for every box and feature.

    `means` are the box means of the origin grid. When `grid` is coarser than theirs, the boxes that hold
    means take their average (or median) first.
    """
    boxes = boxes if boxes is not None else grid.boxes(means.sparkSession)
    lengths = {r[0] for r in means.select("grid_length").distinct().collect()}
    known = means if lengths <= {grid.grid_length} else materialize(values_on_coarser(means, grid, aggr_func))
    cols = [*KEYS, "box_index", "box_x", "box_y", "box_lat", "box_lon"]
    current = boxes_with_values(boxes, known)
    targets = boxes_to_search(boxes, known).select(*cols) if keep_known else current.select(*cols)
    computed = interpolator(method, params)(materialize(targets), known, grid)
    if not keep_known:
        current = current.withColumn("value", F.lit(None).cast("double"))
    return fill_missing(current, computed, [*KEYS, "box_index"]).select(*KEYS, "box_index", "box_lat", "box_lon", "value")


def fill_points(means: DataFrame, grid: Grid, method: str, points: DataFrame, params: dict | None = None) -> DataFrame:
    """(datasetName, name, box_index, box_lat, box_lon, value) at free positions, such as those of a raster, by any method.

    `points` have datasetName, box_index, box_lat, box_lon; box_index numbers them and is unrelated to the grid's boxes. Neighbour methods
    search around each position, mesh methods find its triangle, RBF the tiles it lies in.
    """
    targets = materialize(feature_boxes(points.select("datasetName", "box_index", "box_lat", "box_lon"), means).withColumns({
        "pu": (F.col("box_lat") - F.lit(grid.lat_min)) / F.lit(grid.lat_gap), "pv": (F.col("box_lon") - F.lit(grid.lon_min)) / F.lit(grid.lon_gap)}))
    computed = interpolator(method, params)(targets, means, grid)
    return targets.join(computed, [*KEYS, "box_index"], "left").select(*KEYS, "box_index", "box_lat", "box_lon", "value")


def fill_metrics(means: DataFrame, grid: Grid, funcs: tuple[str, ...] = simple.METRICS, k: int = 5) -> DataFrame:
    """All features and all metric functions in one job: known boxes keep their value under every function."""
    boxes = grid.boxes(means.sparkSession)
    targets = materialize(boxes_to_search(boxes, means).select(*KEYS, "box_index", "box_x", "box_y", "box_lat", "box_lon"))
    computed = simple.metrics_long(knn(targets, means, grid, k), k, funcs).select(
        *KEYS, "func", "box_index", "box_lat", "box_lon", "value")
    each = F.explode(F.array(*[F.lit(f) for f in funcs])).alias("func")
    known = means.select(*KEYS, each, F.col("index").alias("box_index"), F.col("lat").alias("box_lat"), F.col("lon").alias("box_lon"), "value")
    return known.unionByName(computed)


def _registered(registry: DataFrame, features: DataFrame, grid: Grid, method: str, params: dict | None, aggr_func: str, dedupe: bool) -> tuple[DataFrame, DataFrame]:
    """(registry with the method for each feature, the features' method ids)."""
    text = F.lit(reg.params_string(params or {})).cast("string")
    new = features.select(
        F.lit(method).alias("method_name"), text.alias("params"), F.col("datasetName").alias("dataset_name"), F.lit(grid.grid_length).alias("grid_length"),
        F.col("name").alias("feature_name"), F.lit(aggr_func).alias("aggregate_func"))
    registry = materialize(reg.register(registry, new, dedupe=dedupe))
    same = registry.where((F.col("method_name") == method) & (F.col("grid_length") == grid.grid_length) & F.col("params").eqNullSafe(text)
                          & (F.col("aggregate_func") == aggr_func))
    return registry, same.groupBy(F.col("dataset_name").alias("datasetName"), F.col("feature_name").alias("name")).agg(F.max("method_id").alias("method_id"))


def run(registry: DataFrame, means: DataFrame, grid: Grid, method: str, params: dict | None = None,
        aggr_func: str = "mean", dedupe: bool = False) -> tuple[DataFrame, DataFrame]:
    """Register one method per feature, fill the grid, and mark each method valid if no box stayed empty.

    Returns (registry snapshot, result with method_id).
    """
    registry, ids = _registered(registry, means.select(*KEYS).distinct(), grid, method, params, aggr_func, dedupe)
    result = materialize(fill(means, grid, method, params, aggr_func=aggr_func).join(ids, KEYS))
    return reg.validity_from_result(registry, result), result


#: Samples that a feature needs. Fixed values.
MINIMUM = {"polynomial": 16, "krige": 10}
OUTCOME = "datasetName string, name string, n_samples long, n_missing long, is_valid boolean, reason string"


def _attempt(fill_some: Callable[[list[str]], DataFrame], names: list[str]) -> tuple[list[DataFrame], dict[str, str]]:
    """(results, reason of each feature that fails). All features are one job; only when it fails, halves of them are tried, so that
    the failing ones are found and the others are filled."""
    if not names:
        return [], {}
    try:
        return [fill_some(names)], {}
    except Exception as e:  # whatever one feature's values do to a kernel must not stop the others
        if len(names) == 1:
            cause = getattr(e, "java_exception", None)
            lines = [x.strip() for x in (str(cause) if cause is not None else str(e)).splitlines() if x.strip()]
            told = next((x for x in reversed(lines) if "Error" in x and not x.startswith("at ")), lines[0] if lines else type(e).__name__)
            return [], {names[0]: told[:500]}
    half = len(names) // 2
    (one, bad), (two, worse) = _attempt(fill_some, names[:half]), _attempt(fill_some, names[half:])
    return one + two, bad | worse


def run_many(registry: DataFrame, per_dataset: dict[str, tuple[DataFrame, Grid]], method: str, params: dict | None = None,
             minimum: int | None = None) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """The same over several datasets; each dataset's features run as one job.

    Features with fewer than `minimum` box means (by default what the method needs) are not filled, and a feature that fails does not stop the others:
    both are registered as not valid, with the reason in the third table, `outcomes` (OUTCOME). A feature with boxes left empty or not
    finite is not valid either. The second table, the results, is None where no feature was filled.
    """
    need = MINIMUM.get(method, 1) if minimum is None else minimum
    results, outcomes, status = None, [], []
    for means, grid in per_dataset.values():
        registry, ids = _registered(registry, means.select(*KEYS).distinct(), grid, method, params, "mean", False)
        sizes = {(r["datasetName"], r["name"]): r["n"] for r in means.groupBy(*KEYS).agg(F.count("value").alias("n")).collect()}  # a row per feature
        enough = features_with_enough(means.where(F.col("value").isNotNull()), need)
        full = sorted({name for (_, name), n in sizes.items() if n >= need})
        done, failed = _attempt(lambda names: materialize(fill(enough.where(F.col("name").isin(names)), grid, method, params)), full)  # noqa: B023
        left: dict[tuple, int] = {}
        for part in done:
            part = part.join(ids, KEYS)
            results = part if results is None else results.unionByName(part)
            bad = F.count_if(F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf")))
            left |= {(r["datasetName"], r["name"]): r["n"] for r in part.groupBy(*KEYS).agg(bad.alias("n")).collect()}
        for key, n in sorted(sizes.items()):
            reason = f"fewer than {need} samples" if n < need else failed.get(key[1])
            if reason is None and left.get(key):
                reason = "boxes without a finite value"
            outcomes.append((*key, n, left.get(key), reason is None, reason))
        told = registry.sparkSession.createDataFrame([o for o in outcomes if (o[0], o[1]) in sizes], OUTCOME)
        status.append(told.join(ids, KEYS).select("method_id", "is_valid"))
    if status:
        known = status[0]
        for more in status[1:]:
            known = known.unionByName(more)
        registry = registry.join(known.withColumnRenamed("is_valid", "_ok"), "method_id", "left").withColumn("is_valid", F.coalesce("_ok", "is_valid")).drop("_ok")
        registry = materialize(registry)
    return registry, results, registry.sparkSession.createDataFrame(outcomes, OUTCOME)


def missing_per_feature(result: DataFrame) -> DataFrame:
    return count_missing(result, KEYS)
