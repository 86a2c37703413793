"""Reading samples and grid tables, writing results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridfill.functions.text import safe_file_name

ORIGIN_SCHEMA = "datasetName string, index long, lat double, lon double, name string, value double"
BOX_SCHEMA = "datasetName string, grid_length double, box_x long, box_y long, box_index long, box_lat double, box_lon double, tag long"
MAP_SCHEMA = "datasetName string, grid_length double, index long, box_indx long, box_indy long, box_index long"
MEAN_SCHEMA = ("datasetName string, index long, lat double, lon double, name string, value double, "
               "grid_length double, aggregate_func string")
RESULT_SCHEMA = "box_index long, box_lat double, box_lon double, value double, method_id long"
MEAN_PARTITIONS = ("datasetName", "grid_length", "name")
RESULT_PARTITIONS = ("method_id",)


def sample_schema(categories: Sequence[str], features: Sequence[str], text_numbers: Sequence[str] = ()) -> T.StructType:
    """Schema of a wide sample file; features that may hold text stay strings until they are coerced."""
    fields = [T.StructField("Longitude", T.DoubleType()), T.StructField("Latitude", T.DoubleType())]
    fields += [T.StructField(c, T.StringType()) for c in categories]
    fields += [T.StructField(f, T.StringType() if f in text_numbers else T.DoubleType()) for f in features]
    return T.StructType(fields)


def read_samples(spark: SparkSession, path: str, schema: T.StructType | str | None = None, fmt: str = "csv") -> DataFrame:
    """Wide samples from CSV (with header; schema required, so no inference pass) or Parquet."""
    if fmt == "parquet":
        reader = spark.read if schema is None else spark.read.schema(schema)
        return reader.parquet(path)
    if schema is None:
        raise ValueError("reading CSV needs a schema")
    return spark.read.schema(schema).csv(path, header=True)


def append_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Append rows to a Parquet table. Rows are clustered by the partition columns first, so a task
    does not open a file in every partition; AQE splits a partition value that is much larger than the rest."""
    if partition_by:
        df = df.hint("rebalance", *[F.col(c) for c in partition_by])
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def read_means(spark: SparkSession, path: str, dataset: str, grid_length: float, aggr_func: str, name: str) -> DataFrame:
    """Mean samples of one dataset, resolution, aggregate and feature; the path columns prune partitions."""
    return (spark.read.parquet(path)
            .where((F.col("datasetName") == dataset) & (F.col("grid_length") == grid_length)
                   & (F.col("name") == name) & (F.col("aggregate_func") == aggr_func))
            .select("index", "lat", "lon", "value"))


def read_boxes(spark: SparkSession, path: str, dataset: str, grid_length: float) -> DataFrame:
    return (spark.read.parquet(path).where((F.col("datasetName") == dataset) & (F.col("grid_length") == grid_length))
            .select("box_index", "box_lat", "box_lon"))


def read_result(spark: SparkSession, path: str, method_id: int) -> DataFrame:
    """One method's result; only its partition is read."""
    return result_of_method(spark.read.parquet(path), method_id)


def result_of_method(result: DataFrame, method_id: int) -> DataFrame:
    return result.where(F.col("method_id") == method_id)


def result_in_rectangle(result: DataFrame, method_id: int, rectangle: tuple[float, float, float, float]) -> DataFrame:
    """(south, north, west, east), bounds included; the ranges reach the Parquet scan."""
    south, north, west, east = rectangle
    return result_of_method(result, method_id).where(
        F.col("box_lat").between(south, north) & F.col("box_lon").between(west, east))


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_feature_grids(result: DataFrame, path: str, mode: str = "append") -> None:
    """All features' result grids in one table, tagged with feature, variogram and grid length."""
    safe = result.withColumn("feature", safe_file_name(F.col("name")))
    safe.write.mode(mode).partitionBy("feature", "variogram", "grid_length").parquet(path)


def neighbours_as_text(neighbours: DataFrame) -> DataFrame:
    """Neighbour id arrays as text, since CSV has no arrays."""
    return neighbours.withColumn("neigh", F.when(F.col("neigh").isNotNull(), F.concat_ws(";", F.col("neigh").cast("array<string>"))))


def export_neighbours(neighbours: DataFrame, path: str, mode: str = "errorifexists") -> None:
    write_csv(neighbours_as_text(neighbours), path, mode)
