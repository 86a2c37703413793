"""Regular grids: spec from bounds, boxes, sample -> box, the resolution pyramid, and free rasters."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfill.functions.geo import degree_gaps, haversine_km, haversine_km_value, lat_gap_col, lon_gap_col


@dataclass(frozen=True)
class Grid:
    """A grid of x_num (latitude) by y_num (longitude) boxes; box_index = x * y_num + y."""

    dataset: str
    grid_length: float
    lat_min: float
    lat_max: float
    lon_min: float
    lon_max: float
    lat_gap: float
    lon_gap: float
    x_num: int
    y_num: int

    @classmethod
    def from_bounds(cls, dataset: str, lat_min: float, lat_max: float, lon_min: float, lon_max: float,
                    grid_length: float) -> Grid:
        lat_gap, lon_gap = degree_gaps(grid_length, lat_max, lat_min)
        return cls(dataset, float(grid_length), lat_min, lat_max, lon_min, lon_max, lat_gap, lon_gap,
                   math.ceil((lat_max - lat_min) / lat_gap), math.ceil((lon_max - lon_min) / lon_gap))

    @classmethod
    def from_samples(cls, samples: DataFrame, dataset: str, grid_length: float) -> Grid:
        """One min/max aggregation over the dataset's positions."""
        row = (samples.where(F.col("datasetName") == dataset)
               .agg(F.min("lat"), F.max("lat"), F.min("lon"), F.max("lon")).first())
        return cls.from_bounds(dataset, *row, grid_length)

    def coarser(self, grid_length: float) -> Grid:
        return Grid.from_bounds(self.dataset, self.lat_min, self.lat_max, self.lon_min, self.lon_max, grid_length)

    @property
    def all_num(self) -> int:
        return self.x_num * self.y_num

    def centre_lat(self, box_x: Column) -> Column:
        return F.lit(self.lat_min + self.lat_gap / 2) + box_x * F.lit(self.lat_gap)

    def centre_lon(self, box_y: Column) -> Column:
        return F.lit(self.lon_min + self.lon_gap / 2) + box_y * F.lit(self.lon_gap)

    def index_of(self, box_x: Column, box_y: Column) -> Column:
        return box_x * F.lit(self.y_num).cast("long") + box_y

    def box_x_of(self, lat: Column) -> Column:
        """Row of a latitude; a sample on the upper bound belongs to the last row, one outside the bounds to none (null)."""
        x = F.floor((lat - F.lit(self.lat_min)) / F.lit(self.lat_gap)).cast("long")
        return F.when(x.between(0, self.x_num - 1), x).when((x == self.x_num) & (lat <= F.lit(self.lat_max)), x - 1)

    def box_y_of(self, lon: Column) -> Column:
        y = F.floor((lon - F.lit(self.lon_min)) / F.lit(self.lon_gap)).cast("long")
        return F.when(y.between(0, self.y_num - 1), y).when((y == self.y_num) & (lon <= F.lit(self.lon_max)), y - 1)

    def boxes(self, spark: SparkSession) -> DataFrame:
        """Every box; row-major index. Generated, so nothing is read or broadcast."""
        y_num = F.lit(self.y_num).cast("long")
        i = F.col("id")
        return spark.range(self.all_num).select(
            F.lit(self.dataset).alias("datasetName"), F.lit(self.grid_length).alias("grid_length"),
            F.floor(i / y_num).cast("long").alias("box_x"), (i % y_num).alias("box_y"), i.alias("box_index"),
        ).withColumns({"box_lat": self.centre_lat(F.col("box_x")), "box_lon": self.centre_lon(F.col("box_y")),
                       "tag": F.lit(0).cast("long")})

    def index_to_centre(self, df: DataFrame) -> DataFrame:
        y_num = F.lit(self.y_num).cast("long")
        x, y = F.floor(F.col("box_index") / y_num), F.pmod(F.col("box_index"), y_num)
        return df.withColumns({"box_lat": self.centre_lat(x), "box_lon": self.centre_lon(y)})

    def position_to_index(self, lat: Column, lon: Column) -> Column:
        return self.index_of(self.box_x_of(lat), self.box_y_of(lon))

    def assign(self, samples: DataFrame) -> DataFrame:
        """Add grid_length, box_indx, box_indy, box_index to rows with lat, lon."""
        return (samples.withColumns({"grid_length": F.lit(self.grid_length),
                                     "box_indx": self.box_x_of(F.col("lat")),
                                     "box_indy": self.box_y_of(F.col("lon"))})
                .withColumn("box_index", self.index_of(F.col("box_indx"), F.col("box_indy"))))


def bounds(samples: DataFrame) -> DataFrame:
    """Bounds of each dataset."""
    return samples.groupBy("datasetName").agg(
        F.min("lat").alias("lat_min"), F.max("lat").alias("lat_max"),
        F.min("lon").alias("lon_min"), F.max("lon").alias("lon_max"))


def grid_spec(bounds_df: DataFrame, grid_length: Column) -> DataFrame:
    """Gaps and box counts per row of `bounds_df`, for any number of datasets and resolutions."""
    mid = (F.col("lat_max") + F.col("lat_min")) / 2
    return (bounds_df.withColumn("grid_length", grid_length)
            .withColumns({"lat_gap": lat_gap_col(F.col("grid_length")), "lon_gap": lon_gap_col(F.col("grid_length"), mid)})
            .withColumns({"x_num": F.ceil((F.col("lat_max") - F.col("lat_min")) / F.col("lat_gap")).cast("long"),
                          "y_num": F.ceil((F.col("lon_max") - F.col("lon_min")) / F.col("lon_gap")).cast("long")}))


def max_grid_length(bounds_df: DataFrame) -> DataFrame:
    """Half the width in km at the middle latitude."""
    mid = (F.col("lat_min") + F.col("lat_max")) / 2
    return bounds_df.withColumn("max_grid_length", haversine_km(mid, F.col("lon_min"), mid, F.col("lon_max")) / 2)


def pyramid(bounds_df: DataFrame, base: Column) -> DataFrame:
    """Spec rows for g, 2g, 4g ... below the largest useful resolution (one row per dataset and level)."""
    limited = max_grid_length(bounds_df).withColumn("_base", base)
    steps = F.when(F.col("_base") < F.col("max_grid_length"),
                   F.ceil(F.log2(F.col("max_grid_length") / F.col("_base"))) - 1)
    levels = (limited.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), steps.cast("long"))))
              .withColumn("_g", F.col("_base") * F.pow(F.lit(2.0), F.col("_k"))))
    return grid_spec(levels.where(F.col("_g") < F.col("max_grid_length")), F.col("_g")).drop("_k", "_g", "_base")


def pyramid_grids(grid: Grid) -> list[Grid]:
    """The same levels as Grid objects (a handful: log2 of width over step)."""
    mid = (grid.lat_min + grid.lat_max) / 2
    limit = haversine_km_value(mid, grid.lon_min, mid, grid.lon_max) / 2
    grids, g = [], grid.grid_length
    while g < limit:
        grids.append(grid.coarser(g))
        g *= 2
    return grids


def pyramid_boxes(spark: SparkSession, grid: Grid) -> DataFrame:
    """Boxes of every level in one DataFrame."""
    out = None
    for level in pyramid_grids(grid):
        boxes = level.boxes(spark)
        out = boxes if out is None else out.unionByName(boxes)
    return out


def pyramid_map(samples: DataFrame, grid: Grid) -> DataFrame:
    """Samples mapped to every level: one narrow explode over the level list, no shuffle and no join."""
    levels = F.array(*[
        F.struct(F.lit(g.grid_length).alias("grid_length"), g.box_x_of(F.col("lat")).alias("box_indx"),
                 g.box_y_of(F.col("lon")).alias("box_indy"),
                 g.position_to_index(F.col("lat"), F.col("lon")).alias("box_index"))
        for g in pyramid_grids(grid)])
    return samples.withColumn("_l", F.explode(levels)).select(*samples.columns, "_l.*")


def pyramid_box_count(bounds_df: DataFrame, base_lengths: list[float]) -> DataFrame:
    """Boxes over the pyramids of several base resolutions, every level counted once per dataset."""
    bases = F.explode(F.array(*[F.lit(float(b)) for b in base_lengths]))
    levels = pyramid(bounds_df.withColumn("_b", bases), F.col("_b"))
    distinct = levels.select("datasetName", "grid_length", "x_num", "y_num").distinct()
    return distinct.groupBy("datasetName").agg(F.sum(F.col("x_num") * F.col("y_num")).alias("all_num"))


def raster(spark: SparkSession, dataset: str, lat_start: float, lat_step: float, n_lat: int,
           lon_start: float, lon_step: float, n_lon: int) -> DataFrame:
    """Points start + i * step on both axes, row-major: (datasetName, box_index, row, col, box_lat, box_lon)."""
    i = F.col("id")
    width = F.lit(n_lon).cast("long")
    return (spark.range(n_lat * n_lon).select(
        F.lit(dataset).alias("datasetName"), i.alias("box_index"), F.floor(i / width).cast("long").alias("row"), (i % width).alias("col"))
        .withColumns({"box_lat": F.lit(lat_start) + F.col("row") * F.lit(lat_step),
                      "box_lon": F.lit(lon_start) + F.col("col") * F.lit(lon_step)}))


def _steps(start: float, stop: float, step: float) -> int:
    """How many points a half-open range with a float step holds."""
    return max(0, math.ceil((stop - start) / step))


def fixed_count_raster(spark: SparkSession, grid: Grid, n_lat: int, n_lon: int) -> DataFrame:
    """N steps per axis, the first and the last left out."""
    lat_step = (grid.lat_max - grid.lat_min) / n_lat
    lon_step = (grid.lon_max - grid.lon_min) / n_lon
    return raster(spark, grid.dataset, grid.lat_min + lat_step, lat_step,
                  _steps(grid.lat_min + lat_step, grid.lat_max - lat_step, lat_step),
                  grid.lon_min + lon_step, lon_step,
                  _steps(grid.lon_min + lon_step, grid.lon_max - lon_step, lon_step))


def edge_raster(spark: SparkSession, grid: Grid) -> DataFrame:
    """Km steps anchored on the minimum, the maximum included."""
    return raster(spark, grid.dataset,
                  grid.lat_min, grid.lat_gap, _steps(grid.lat_min, grid.lat_max + grid.lat_gap, grid.lat_gap),
                  grid.lon_min, grid.lon_gap, _steps(grid.lon_min, grid.lon_max + grid.lon_gap, grid.lon_gap))


def degree_raster(spark: SparkSession, grid: Grid, step: float) -> DataFrame:
    """Equal steps in degrees on both axes, at most `step` apart, both ends included."""
    n_lat = math.ceil((grid.lat_max - grid.lat_min) / step) + 1
    n_lon = math.ceil((grid.lon_max - grid.lon_min) / step) + 1
    return raster(spark, grid.dataset,
                  grid.lat_min, (grid.lat_max - grid.lat_min) / max(n_lat - 1, 1), n_lat,
                  grid.lon_min, (grid.lon_max - grid.lon_min) / max(n_lon - 1, 1), n_lon)


def parent_box(df: DataFrame, ratio: int) -> DataFrame:
    """Key columns of the box that holds this one on a grid `ratio` times coarser."""
    return df.withColumns({"parent_x": F.floor(F.col("box_x") / F.lit(ratio)),
                           "parent_y": F.floor(F.col("box_y") / F.lit(ratio))})
