"""Quartile fences, histograms, contour levels and grid pivots: the data behind the maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridfill.operators.aggregate import distinct_values, exact_quantiles
from gridfill.operators.regions import clip_to_polygons


def fences(df: DataFrame, keys: Sequence[str] = ("name",), reach: float = 1.5) -> DataFrame:
    """Quartiles, IQR and the outlier fences per group."""
    q = exact_quantiles(df, keys, {"q1": 0.25, "q3": 0.75})
    iqr = F.col("q3") - F.col("q1")
    return q.withColumns({"iqr": iqr, "lower_bound": F.col("q1") - reach * iqr, "upper_bound": F.col("q3") + reach * iqr})


def count_outliers(df: DataFrame, limits: DataFrame, keys: Sequence[str] = ("name",), by: Sequence[str] = ()) -> DataFrame:
    """Values outside the fences, per group."""
    outside = (F.col("value") < F.col("lower_bound")) | (F.col("value") > F.col("upper_bound"))
    return (df.join(limits.select(*keys, "lower_bound", "upper_bound"), list(keys))
            .groupBy(*dict.fromkeys([*keys, *by])).agg(F.count_if(outside).alias("n_outliers")))


def level_edges(limits: DataFrame, n: int, places: int, keys: Sequence[str] = ("name",)) -> DataFrame:
    """n equal parts of the fenced range as an array of n + 1 rounded edges."""
    step = (F.col("upper_bound") - F.col("lower_bound")) / n
    edges = F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.round(
        F.when(i == n, F.col("upper_bound")).otherwise(F.col("lower_bound") + i * step), places))
    return limits.select(*keys, edges.alias("edges"))


def given_edges(df: DataFrame, edges: Sequence[float], keys: Sequence[str] = ("name",)) -> DataFrame:
    return df.select(*keys).distinct().withColumn("edges", F.array(*[F.lit(float(e)) for e in edges]))


def bin_of(value: Column, edges: Column) -> Column:
    """Number of the bin [edge i, edge i+1) that holds the value, from 0; NULL outside."""
    below = F.size(F.filter(edges, lambda e: e <= value))
    return F.when((below >= 1) & (below < F.size(edges)), below - 1)


def histogram(df: DataFrame, edges: DataFrame, keys: Sequence[str] = ("name",), by: Sequence[str] = ()) -> DataFrame:
    """Counts per bin, empty bins included: one row per group, `by` value and bin."""
    group = list(dict.fromkeys([*keys, *by]))
    counted = (df.join(edges, list(keys)).withColumn("bin", bin_of(F.col("value"), F.col("edges")))
               .groupBy(*group, "bin").agg(F.count("*").alias("_n")))
    inside = counted.where(F.col("bin").isNotNull())
    bins = (counted.select(*group).distinct().join(edges, list(keys))
            .select(*group, "edges", F.explode(F.sequence(F.lit(0), F.size("edges") - 2)).alias("bin"))
            .select(*group, "bin", F.get("edges", F.col("bin")).alias("bin_from"), F.get("edges", F.col("bin") + 1).alias("bin_to")))
    return bins.join(inside, [*group, "bin"], "left").select(
        *group, F.col("bin").cast("long").alias("bin"), "bin_from", "bin_to", F.coalesce("_n", F.lit(0)).cast("long").alias("n"))


def compare_histograms(original: DataFrame, interpolated: DataFrame, num_bins: int = 10,
                       edges: Sequence[float] | None = None, shape: DataFrame | None = None) -> DataFrame:
    """Histogram of original and interpolated values on one set of bins, taken from the original.

    Both inputs: name, box_lat, box_lon, value. Outliers fall outside the bins, hence out of the counts.
    """
    if edges is None:
        bins = level_edges(fences(original), num_bins, 2)
    else:
        bins = given_edges(original, edges)
    cols = ["name", "box_lat", "box_lon", "value"]
    both = (original.select(F.lit("original").alias("source"), *cols)
            .unionByName(interpolated.select(F.lit("interpolation").alias("source"), *cols)))
    if shape is not None:
        both = clip_to_polygons(both, shape)
    return histogram(both, bins, by=["source"])


def contour_levels(original: DataFrame, interpolated: DataFrame, legend: int | Sequence[float] | None = None,
                   shape: DataFrame | None = None) -> DataFrame:
    """Level number of every interpolated box; six equal parts, `legend` equal parts, or given edges."""
    if legend is None or isinstance(legend, int):
        edges = level_edges(fences(original), legend or 6, 4)
    elif isinstance(legend, (list, tuple)):
        edges = given_edges(original, legend)
    else:
        raise ValueError("legend must be None, an integer or a list of edges")
    inside = interpolated if shape is None else clip_to_polygons(interpolated, shape)
    return (inside.join(edges, "name").withColumn("level", bin_of(F.col("value"), F.col("edges")).cast("long"))
            .drop("edges"))


def drop_constant_features(df: DataFrame, keys: Sequence[str] = ("datasetName", "name")) -> DataFrame:
    """Rows of the features with more than one distinct value."""
    varied = distinct_values(df, keys).where(F.col("n_distinct") > 1).select(*keys)
    return df.join(varied, list(keys), "left_semi")


def feature_summaries(original: DataFrame, interpolated: DataFrame, legend: int | None = None) -> DataFrame:
    """Boxes per contour level for every feature whose result is not constant."""
    levels = contour_levels(original, drop_constant_features(interpolated, ["name"]), legend)
    return levels.groupBy("name", "level").agg(F.count("*").alias("n"))


def grid_rows(df: DataFrame, keys: Sequence[str] = ("datasetName", "name")) -> DataFrame:
    """The value matrix as one row per grid row: columns in lon order as an array."""
    return df.groupBy(*keys, "box_lat").agg(F.sort_array(F.collect_list(F.struct("box_lon", "value"))).alias("row"))


def grid_pivot(df: DataFrame, column: str = "box_y", row: str = "box_x", columns: Sequence | None = None) -> DataFrame:
    """The value matrix of a small window as columns; with `columns` given, Spark need not look for them first, and all of them
    are there. Spark refuses more columns than its pivot limit."""
    grouped = df.groupBy("name", row)
    return (grouped.pivot(column) if columns is None else grouped.pivot(column, list(columns))).agg(F.first("value"))


def sorted_coordinates(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)
