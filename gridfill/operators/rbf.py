"""Radial basis functions by partition of unity: one dense fit per tile, blended where tiles overlap."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfill.operators.grid import Grid
from gridfill.operators.neighbors import cell_offsets, knn
from gridfill.operators.solvers import RBF_FUNCTIONS, local_rbf, rbf_predict
from gridfill.session import materialize

KEYS = ["datasetName", "name"]
FALLBACK_K = 32         # neighbours used for boxes that no tile serves


def _wendland(t):
    """Smooth bump: 1 at 0, 0 from 1 on."""
    return F.when(t < 1, F.pow(1 - t, F.lit(4.0)) * (4 * t + 1)).otherwise(F.lit(0.0))


def tiled_rbf(targets: DataFrame, samples: DataFrame, grid: Grid, function: str = "multiquadric", tile: int = 8) -> DataFrame:
    """RBF value of each target box, or free position (pu, pv in box units): (target columns, value).

    Tiles are `tile` boxes wide. A tile fits the box means of its 3x3 neighbourhood, at most (3 * tile)^2
    of them, so no group outgrows a task, and predicts boxes up to one tile width from its centre on
    both axes. Every tile with a sample around it makes a fit. Boxes served by several tiles take the mean weighted by a
    smooth bump; boxes that no tile with samples serves are fitted on their nearest samples, as many as there are.
    """
    if tile < 1:
        raise ValueError(f"tiles are at least one box wide, not {tile}")
    if function not in RBF_FUNCTIONS:
        raise ValueError(f"unknown radial function {function!r}")
    known = samples.where(F.col("value").isNotNull())
    # Free targets have their own position; boxes are counted from 0, as the box means are.
    free = {"pu", "pv"} <= set(targets.columns)
    at_x, at_y = (F.col("pu") - 0.5, F.col("pv") - 0.5) if free else (F.col("box_x"), F.col("box_y"))
    placed = targets.withColumns({"_x": at_x, "_y": at_y})
    spread_s = known.withColumn("_o", cell_offsets(1, 1)).select(
        *KEYS, (F.floor(F.col("box_x") / tile) + F.col("_o.dx")).alias("tx"), (F.floor(F.col("box_y") / tile) + F.col("_o.dy")).alias("ty"), "box_x", "box_y", "value")
    off = lambda c, t: F.abs(F.col(c) + 0.5 - (F.col(t) + 0.5) * tile) / tile
    spread_t = (placed.withColumn("_o", cell_offsets(1, 1)).select(
        *KEYS, (F.floor((F.col("_x") + 0.5) / tile) + F.col("_o.dx")).alias("tx"), (F.floor((F.col("_y") + 0.5) / tile) + F.col("_o.dy")).alias("ty"),
        F.col("_x").cast("double").alias("box_x"), F.col("_y").cast("double").alias("box_y"), "box_index")
        .withColumn("w", _wendland(off("box_x", "tx")) * _wendland(off("box_y", "ty"))).where(F.col("w") > 0))
    gaps = (grid.lat_gap, grid.lon_gap)

    def fit(boxes: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        if not len(boxes) or not len(near):
            return pd.DataFrame({"datasetName": pd.Series(dtype=object), "name": pd.Series(dtype=object),
                                 "box_index": pd.Series(dtype="int64"), "w": pd.Series(dtype=float), "wv": pd.Series(dtype=float)})
        at = lambda d, c, g: d[c].to_numpy(float) * g
        pred = rbf_predict(at(near, "box_x", gaps[0]), at(near, "box_y", gaps[1]), near["value"].to_numpy(),
                           at(boxes, "box_x", gaps[0]), at(boxes, "box_y", gaps[1]), function)
        w = boxes["w"].to_numpy()
        return pd.DataFrame({"datasetName": str(boxes["datasetName"].iloc[0]), "name": str(boxes["name"].iloc[0]),
                             "box_index": boxes["box_index"].to_numpy(), "w": w, "wv": w * pred})

    group = [*KEYS, "tx", "ty"]
    pieces = spread_t.groupBy(*group).cogroup(spread_s.groupBy(*group)).applyInPandas(
        fit, "datasetName string, name string, box_index long, w double, wv double")
    blended = pieces.groupBy(*KEYS, "box_index").agg((F.sum("wv") / F.sum("w")).alias("value"))
    result = targets.join(blended, [*KEYS, "box_index"], "left")
    result = materialize(result)
    served = result.where(F.col("value").isNotNull())
    lonely = result.where(F.col("value").isNull()).drop("value")
    far = local_rbf(knn(lonely, samples, grid, FALLBACK_K), FALLBACK_K, function).drop("neighbors")
    return served.unionByName(far)
