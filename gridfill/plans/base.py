"""Sample tables derived from the star-schema inputs, prepared once per session and folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfill.operators.aggregate import box_values, boxes_to_search
from gridfill.operators.grid import Grid
from gridfill.operators.mesh import boxes_in_triangles, delaunay
from gridfill.operators.neighbors import knn
from gridfill.operators.prep import wide_to_long
from gridfill.session import materialize

SOUTH, NORTH, WEST, EAST = 46.0, 51.0, -60.0, -53.0
FEATURES = ["price", "cust"]
TARGET = ["datasetName", "name", "box_index", "box_x", "box_y", "box_lat", "box_lon"]

_prepared: dict[tuple, DataFrame] = {}


def once(spark: SparkSession, sf_dir: str, what: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A prepared table is written once per application, folder and state of the folder, as a pipeline would keep it."""
    key = (spark.sparkContext.applicationId, sf_dir, changed(spark, sf_dir), what)
    if key not in _prepared:
        _prepared[key] = materialize(build())
    return _prepared[key]


def changed(spark: SparkSession, folder: str) -> int:
    """When the newest file or folder in `folder` was written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return max((f.getModificationTime() for f in path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)), default=0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid_of(dataset: str, grid_length: float) -> Grid:
    return Grid.from_bounds(dataset, SOUTH, NORTH, WEST, EAST, grid_length)


def position(key: str) -> dict:
    k = F.col(key)
    return {"lat": F.lit(SOUTH) + (k * 7919 % 5000).cast("double") / F.lit(1000.0),
            "lon": F.lit(WEST) + (k * 104729 % 7000).cast("double") / F.lit(1000.0)}


def order_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide samples: one per order, features price and cust."""
    pos = position("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.lit("demo").alias("datasetName"), F.col("o_orderkey").alias("index"), pos["lat"].alias("lat"), pos["lon"].alias("lon"),
        F.col("o_totalprice").alias("price"), F.col("o_custkey").cast("double").alias("cust"))


def customer_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second dataset: one sample per customer, with a region column and negative values."""
    pos = position("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.lit("customers").alias("datasetName"), F.col("c_custkey").alias("index"), pos["lat"].alias("lat"), pos["lon"].alias("lon"),
        F.col("c_mktsegment").alias("region"), F.col("c_acctbal").alias("balance"))


def supplier_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Third dataset: few, scattered samples, for the mesh operators."""
    pos = position("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        F.lit("suppliers").alias("datasetName"), F.col("s_suppkey").alias("index"), pos["lat"].alias("lat"), pos["lon"].alias("lon"),
        F.col("s_acctbal").alias("balance"))


def order_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide_to_long(order_samples(spark, sf_dir), FEATURES)


def order_means(spark: SparkSession, sf_dir: str, grid_length: float = 8.0) -> DataFrame:
    return once(spark, sf_dir, f"order_means_{grid_length}",
                lambda: box_values(order_long(spark, sf_dir), grid_of("demo", grid_length)))


def order_targets(spark: SparkSession, sf_dir: str, grid_length: float = 8.0) -> DataFrame:
    grid = grid_of("demo", grid_length)
    return once(spark, sf_dir, f"order_targets_{grid_length}",
                lambda: boxes_to_search(grid.boxes(spark), order_means(spark, sf_dir, grid_length)).select(*TARGET))


def order_neighbours(spark: SparkSession, sf_dir: str, k: int = 16, grid_length: float = 8.0) -> DataFrame:
    return once(spark, sf_dir, f"order_knn_{k}_{grid_length}",
                lambda: knn(order_targets(spark, sf_dir, grid_length), order_means(spark, sf_dir, grid_length),
                            grid_of("demo", grid_length), k))


def supplier_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "supplier_means", lambda: box_values(
        wide_to_long(supplier_samples(spark, sf_dir), ["balance"]), grid_of("suppliers", 8.0)))


def supplier_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "supplier_targets", lambda: boxes_to_search(
        grid_of("suppliers", 8.0).boxes(spark), supplier_means(spark, sf_dir)).select(*TARGET))


def supplier_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "supplier_triangles",
                lambda: delaunay(supplier_means(spark, sf_dir), grid_of("suppliers", 8.0)))


def supplier_located(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "supplier_located",
                lambda: boxes_in_triangles(supplier_triangles(spark, sf_dir), grid_of("suppliers", 8.0)))


def order_triangles(spark: SparkSession, sf_dir: str, grid_length: float = 8.0) -> DataFrame:
    return once(spark, sf_dir, f"order_triangles_{grid_length}",
                lambda: delaunay(order_means(spark, sf_dir, grid_length), grid_of("demo", grid_length)))


def order_located(spark: SparkSession, sf_dir: str, grid_length: float = 8.0) -> DataFrame:
    """Boxes without a value inside the hull, with their triangle."""
    return once(spark, sf_dir, f"order_located_{grid_length}", lambda: boxes_in_triangles(
        order_triangles(spark, sf_dir, grid_length), grid_of("demo", grid_length)).join(
            order_targets(spark, sf_dir, grid_length).select("datasetName", "name", "box_index"),
            ["datasetName", "name", "box_index"], "left_semi"))


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One diamond per customer region, spanned by the region's own bounds; priority by name."""
    b = customer_samples(spark, sf_dir).groupBy("region").agg(
        F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lon").alias("w"), F.max("lon").alias("e"),
        F.avg("balance").alias("m"))
    # Shrunk by the region's mean balance, so that the diamonds differ.
    f = F.lit(0.2) + F.pmod(F.round(F.col("m")), F.lit(60.0)) / 100
    my, mx = (F.col("s") + F.col("n")) / 2, (F.col("w") + F.col("e")) / 2
    hy, hx = (F.col("n") - F.col("s")) / 2 * f, (F.col("e") - F.col("w")) / 2 * f
    corner = lambda a, o: F.struct(a.alias("lat"), o.alias("lon"))
    return b.select(F.col("region"), F.col("region").alias("priority"), F.array(
        corner(my - hy, mx), corner(my, mx + hx), corner(my + hy, mx), corner(my, mx - hx)).alias("vertices"))
