"""Interpolators that are plain column expressions over the neighbour array (no Python in the tasks)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("median", "max", "min", "Q1", "Q3", "mean", "var", "std", "CV")
COINCIDENT = 1e-12      # distance below which a sample counts as lying on the box


def values_of(neighbors: Column, k: int | None = None) -> Column:
    part = neighbors if k is None else F.slice(neighbors, 1, k)
    return F.transform(part, lambda n: n["value"])


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def array_mean(values: Column) -> Column:
    return F.when(F.size(values) > 0, array_sum(values) / F.size(values))


def nearest(df: DataFrame, k: int = 1) -> DataFrame:
    """Mean of the first k neighbours' values; NULL without any."""
    return df.withColumn("value", array_mean(values_of(F.col("neighbors"), k)))


def moving_average(df: DataFrame, k: int) -> DataFrame:
    return nearest(df, k)


def idw(df: DataFrame, k: int = 8, power: float = 1.0) -> DataFrame:
    """Inverse-distance weighting; a sample on the box gives its own value."""
    near = F.slice("neighbors", 1, k)
    weight = lambda n: F.lit(1.0) / (n["dist"] if power == 1 else F.pow(n["dist"], F.lit(float(power))))
    sums = F.aggregate(
        near, F.struct(F.lit(0.0).alias("vw"), F.lit(0.0).alias("w")),
        lambda acc, n: F.struct((acc["vw"] + n["value"] * weight(n)).alias("vw"), (acc["w"] + weight(n)).alias("w")))
    first = F.get(F.col("neighbors"), F.lit(0))
    return (df.withColumn("_s", F.when(first["dist"] > COINCIDENT, sums))
            .withColumn("value", F.when(first["dist"] <= COINCIDENT, first["value"]).otherwise(F.col("_s.vw") / F.col("_s.w")))
            .drop("_s"))


def _array_quantile(ordered: Column, p: float) -> Column:
    rank = (F.size(ordered) - 1) * F.lit(p)
    lo = F.get(ordered, F.floor(rank).cast("int"))
    hi = F.get(ordered, F.ceil(rank).cast("int"))
    return lo + (hi - lo) * (rank - F.floor(rank))


def data_metrics(df: DataFrame, k: int = 5) -> DataFrame:
    """All nine metrics of the k nearest values as columns, in one pass over the array."""
    df = df.withColumn("_v", F.sort_array(values_of(F.col("neighbors"), k))).withColumn("_m", array_mean(F.col("_v")))
    n, mean = F.size("_v"), F.col("_m")
    df = df.withColumn("_ss", F.aggregate("_v", F.lit(0.0), lambda acc, x: acc + (x - F.col("_m")) * (x - F.col("_m"))))
    var = F.when(n > 1, F.col("_ss") / (n - 1))
    return df.withColumns({
        "median": _array_quantile(F.col("_v"), 0.5), "max": F.array_max("_v"), "min": F.array_min("_v"),
        "Q1": _array_quantile(F.col("_v"), 0.25), "Q3": _array_quantile(F.col("_v"), 0.75), "mean": mean,
        "var": var, "std": F.sqrt(var),
        "CV": F.when(n > 0, F.try_divide(F.sqrt(F.col("_ss") / n), mean) * 100),
    }).drop("_v", "_m", "_ss")


def metrics_long(df: DataFrame, k: int = 5, funcs: tuple[str, ...] = METRICS) -> DataFrame:
    """The metrics as (func, value) rows."""
    wide = data_metrics(df, k).drop("neighbors")
    ids = [c for c in wide.columns if c not in METRICS]
    return wide.unpivot(ids, list(funcs), "func", "value")
