"""Data preparation as one plan: wide samples -> long samples, grid, box means, resolution pyramid."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from gridfill.operators.aggregate import box_values
from gridfill.operators.grid import Grid, pyramid_boxes, pyramid_map
from gridfill.operators.prep import wide_to_long
from gridfill.session import materialize


@dataclass(frozen=True)
class Prepared:
    grid: Grid
    long: DataFrame             # OriginData
    box_map: DataFrame          # sample -> box at the base resolution
    means: DataFrame            # MeanOriginData
    boxes: DataFrame            # InsertData, all levels
    mean_map: DataFrame         # OrigindataMapInsert: box means -> boxes, all levels


def prepare(wide: DataFrame, features: Sequence[str], dataset: str, grid_length: float, aggr_func: str = "mean",
            grid: Grid | None = None) -> Prepared:
    """`wide`: datasetName, index, lat, lon and one column per feature. Box means are written once,
    since every later step starts from them."""
    grid = grid or Grid.from_samples(wide, dataset, grid_length)
    long = wide_to_long(wide, features)
    means = materialize(box_values(long, grid, aggr_func))
    positions = means.select("datasetName", "index", "lat", "lon").distinct()
    return Prepared(grid, long, grid.assign(wide.select("datasetName", "index", "lat", "lon")), means,
                    pyramid_boxes(wide.sparkSession, grid), pyramid_map(positions, grid))
