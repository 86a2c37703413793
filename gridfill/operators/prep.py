"""Feature preparation on wide sample tables, and the wide -> long step."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gridfill.session import materialize


def select_region(df: DataFrame, column: str, name: str) -> DataFrame:
    """Keep one region and name the dataset after it."""
    return df.where(F.col(column) == F.lit(name)).withColumn("datasetName", F.lit(name))


def ratio(x: Column, y: Column) -> Column:
    """x / y; 0 when both are 0; NULL when only y is 0."""
    return F.when(y != 0, x / y).when((y == 0) & (x == 0), F.lit(0.0))


def add_ratio(df: DataFrame, new: str, a: str, b: str) -> DataFrame:
    return df.withColumn(new, ratio(F.col(a), F.col(b)))


def add_log10(df: DataFrame, new: str, column: str) -> DataFrame:
    """log10; NULL where the argument is not positive."""
    c = F.col(column)
    return df.withColumn(new, F.when(c > 0, F.log10(c)))


def clamp_negatives(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.withColumns({c: F.when(F.col(c) < 0, F.lit(0.0)).otherwise(F.col(c)) for c in columns})


def to_number(c: Column) -> Column:
    """Text -> double; text that is no number, and NaN, become NULL."""
    number = c.try_cast("double")
    return F.when(~F.isnan(number), number)


def coerce_numbers(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.withColumns({c: to_number(F.col(c)) for c in columns})


def features_except(df: DataFrame, unused: Iterable[str]) -> list[str]:
    drop = set(unused)
    return [c for c in df.columns if c not in drop]


def features_by_type(df: DataFrame, exclude: Iterable[str] = ("Latitude", "Longitude", "lat", "lon")) -> list[str]:
    drop = set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType) and f.name not in drop]


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def cut_latitude(df: DataFrame, max_lat: float, column: str = "lat") -> DataFrame:
    return df.where(F.col(column) <= F.lit(float(max_lat)))


def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def first_per_position(df: DataFrame, order: str = "index", lat: str = "lat", lon: str = "lon",
                       keys: Sequence[str] = ()) -> DataFrame:
    """One row per position: the one with the lowest `order`. min_by combines map-side, so a position
    that holds a large share of all rows costs one row per task in the shuffle."""
    rest = [c for c in df.columns if c not in {lat, lon, *keys}]
    picked = df.groupBy(*keys, lat, lon).agg(
        F.min_by(F.struct(*rest), F.col(order)).alias("_row"))
    return picked.select(*[F.col(f"_row.{c}").alias(c) if c in rest else F.col(c) for c in df.columns])


def dense_index(df: DataFrame, order: Sequence[str], name: str = "index", start: int = 0) -> DataFrame:
    """Consecutive numbers in the given order without a one-partition window.

    Range-partition and sort once, number inside each partition, then add the partition's offset. The
    offset table has one row per partition.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    marked = materialize(ranged.select(
        "*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_mono")))
    per_part = marked.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_mono").alias("_first"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select(
        "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return (marked.join(offsets, "_part")
            .withColumn(name, F.col("_mono") - F.col("_first") + F.col("_offset") + F.lit(start))
            .drop("_part", "_mono", "_first", "_offset"))


def wide_to_long(df: DataFrame, features: Sequence[str],
                 ids: Sequence[str] = ("datasetName", "index", "lat", "lon")) -> DataFrame:
    """One row per sample and feature with a usable number; rows without position are dropped."""
    numbers = df.select(*ids, *[to_number(F.col(f"`{f}`")).alias(f) for f in features])
    return numbers.unpivot(list(ids), [F.col(f"`{f}`") for f in features], "name", "value").dropna(
        subset=["lat", "lon", "value"])


def features_with_enough(long: DataFrame, minimum: int, keys: Sequence[str] = ("datasetName", "name")) -> DataFrame:
    """Rows of those features that have at least `minimum` samples."""
    enough = long.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= minimum).select(*keys)
    return long.join(enough, list(keys), "left_semi")


def known(df: DataFrame) -> DataFrame:
    return df.where(F.col("value").isNotNull())


def missing(df: DataFrame) -> DataFrame:
    return df.where(F.col("value").isNull())


def one_feature(df: DataFrame, name: str) -> DataFrame:
    return df.where(F.col("name") == F.lit(name))
