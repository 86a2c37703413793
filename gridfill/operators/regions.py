"""Convex hulls, point in polygon, clipping to shapes and labelling with regions."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridfill.functions.geo import inside_polygon
from gridfill.session import materialize

HULL_SALT = 64
WAYS = 32               # directions whose extremes thin the points before a hull
COVER = 32              # cells along the longer side of a polygon
SALT = 8                # copies of a cell


def hull_vertices(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise from the lowest (first axis, then second)."""
    pts = np.unique(points, axis=0)
    if len(pts) < 3:
        return pts

    def chain(seq) -> list:
        out: list = []
        for p in seq:
            while len(out) > 1 and _turn(out[-2], out[-1], p) <= 0:
                out.pop()
            out.append(p)
        return out

    pts = pts.tolist()
    return np.array(chain(pts)[:-1] + chain(pts[::-1])[:-1])


def _turn(a: list[float], b: list[float], c: list[float]):
    """Positive where the way from a over b to c turns left: in doubles where their error cannot change the sign, else exactly."""
    one, two = (b[0] - a[0]) * (c[1] - a[1]), (b[1] - a[1]) * (c[0] - a[0])
    if abs(one - two) > 4e-16 * (abs(one) + abs(two)):
        return one - two
    (ax, ay), (bx, by), (cx, cy) = (map(Fraction, p) for p in (a, b, c))
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def _outer(points: DataFrame, keys: list[str]) -> DataFrame:
    """Points that can be corners of their group's hull: those not surely inside the polygon of its extremes in WAYS directions.

    All by column functions, so Python sees a small rest of the points.
    """
    ways = [(math.cos(2 * math.pi * k / WAYS), math.sin(2 * math.pi * k / WAYS)) for k in range(WAYS)]
    far = points.groupBy(*keys).agg(*[F.max_by(F.struct("lat", "lon"), F.col("lat") * c + F.col("lon") * s).alias(f"_e{k}") for k, (c, s) in enumerate(ways)])
    inside = F.lit(True)
    for k in range(WAYS):
        a, b = F.col(f"_e{k}"), F.col(f"_e{(k + 1) % WAYS}")
        one = (b["lat"] - a["lat"]) * (F.col("lon") - a["lon"])
        two = (b["lon"] - a["lon"]) * (F.col("lat") - a["lat"])
        same = (a["lat"] == b["lat"]) & (a["lon"] == b["lon"])
        inside = inside & (same | (one - two > 1e-12 * (F.abs(one) + F.abs(two))))
    one_place = F.array_max(F.array(*[F.col(f"_e{k}") for k in range(WAYS)])) == F.array_min(F.array(*[F.col(f"_e{k}") for k in range(WAYS)]))
    return points.join(far, keys).where(~inside | one_place).select(*keys, "lat", "lon")


def convex_hulls(df: DataFrame, keys: Sequence[str], lat: str = "lat", lon: str = "lon") -> DataFrame:
    """One row per group with `vertices` array<struct<lat,lon>>, counter-clockwise.

    Points inside a partial hull are dropped as early as possible: in every task first, then in
    salted groups, and only the corners that are left meet in one group.
    """
    keys = list(keys)
    key_schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    points = df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(*keys, F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"))
    points = _outer(points, keys)

    def shrink(pdf: pd.DataFrame) -> pd.DataFrame:
        kept = [pd.DataFrame(hull_vertices(part[["lat", "lon"]].to_numpy()), columns=["lat", "lon"]).assign(
            **dict(zip(keys, key if isinstance(key, tuple) else (key,)))) for key, part in pdf.groupby(keys, sort=False)]
        return pd.concat(kept)[[*keys, "lat", "lon"]] if kept else pdf[[*keys, "lat", "lon"]]

    def in_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            held = shrink(pdf if held is None else pd.concat([held, pdf]))
        if held is not None:
            yield held

    def corners(pdf: pd.DataFrame) -> pd.DataFrame:
        hull = hull_vertices(pdf[["lat", "lon"]].to_numpy())
        row = {k: pdf[k].iloc[0] for k in keys}
        return pd.DataFrame([{**row, "vertices": [{"lat": a, "lon": b} for a, b in hull]}])

    schema = f"{key_schema}, lat double, lon double"
    partial = points.mapInPandas(in_task, schema)
    salted = (partial.withColumn("_salt", F.spark_partition_id() % HULL_SALT).groupBy(*keys, "_salt")
              .applyInPandas(lambda pdf: shrink(pdf[[*keys, "lat", "lon"]]), schema))
    return salted.groupBy(*keys).applyInPandas(corners, f"{key_schema}, vertices array<struct<lat:double,lon:double>>")


def _cut_by(a: Column, b: Column, south: Column, west: Column, side: Column) -> Column:
    """Whether the side from a to b may meet the cell: their bounds overlap and the cell's corners are not all on one side of its line."""
    north, east = south + side, west + side
    apart = ((F.greatest(a["lat"], b["lat"]) < south) | (F.least(a["lat"], b["lat"]) > north)
             | (F.greatest(a["lon"], b["lon"]) < west) | (F.least(a["lon"], b["lon"]) > east))
    turn = lambda lat, lon: (b["lat"] - a["lat"]) * (lon - a["lon"]) - (b["lon"] - a["lon"]) * (lat - a["lat"])
    corners = [turn(lat, lon) for lat in (south, north) for lon in (west, east)]
    return ~apart & ~((F.least(*corners) > 0) | (F.greatest(*corners) < 0))


def cover(polygons: DataFrame) -> DataFrame:
    """Polygons copied to the cells that cover them: (level, cx, cy, whole). A whole cell lies inside the polygon, in others points need a test.

    Cells are squares of 2^level degrees, about COVER of them along the polygon's longer side, so a small polygon is not lost in a
    large cell and a large one takes no more cells than a small one. Cells outside are left out.
    """
    lats, lons = F.transform("vertices", lambda p: p["lat"]), F.transform("vertices", lambda p: p["lon"])
    extent = F.greatest(F.array_max(lats) - F.array_min(lats), F.array_max(lons) - F.array_min(lons), F.lit(2.0 ** -30))
    cells = polygons.where(F.size("vertices") >= 3).withColumn("level", F.ceil(F.log2(extent / COVER)).cast("int")).withColumn("_side", F.pow(F.lit(2.0), F.col("level")))
    span = lambda a: F.sequence(F.floor(F.array_min(a) / F.col("_side")).cast("long"), F.floor(F.array_max(a) / F.col("_side")).cast("long"))
    cells = cells.withColumn("cx", F.explode(span(lats))).withColumn("cy", F.explode(span(lons)))
    south, west = F.col("cx") * F.col("_side"), F.col("cy") * F.col("_side")
    sides = F.zip_with("vertices", F.concat(F.slice("vertices", 2, F.size("vertices")), F.slice("vertices", 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    margin = F.col("_side") * 1e-9  # a point on a cell's border may be counted to either cell
    border = F.exists(sides, lambda s: _cut_by(s["a"], s["b"], south - margin, west - margin, F.col("_side") + 2 * margin))
    middle = inside_polygon(south + F.col("_side") / 2, west + F.col("_side") / 2, F.col("vertices"))
    return cells.withColumn("whole", ~border).where(border | middle).drop("_side")


def _met(points: DataFrame, polygons: DataFrame, lat: str, lon: str) -> DataFrame:
    """Points joined with the polygons that hold them. Points look up one cell per size of polygon; a hot cell is copied SALT times and its
    points are dealt to the copies by position."""
    cells = materialize(cover(polygons))
    levels = sorted(r[0] for r in cells.select("level").distinct().collect())
    held = cells.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))).withColumnsRenamed({"level": "_level", "cx": "_cx", "cy": "_cy", "whole": "_whole"})
    at = F.array(*[F.struct(F.lit(lv).alias("_level"), F.floor(F.col(lat) / 2.0 ** lv).cast("long").alias("_cx"), F.floor(F.col(lon) / 2.0 ** lv).cast("long").alias("_cy")) for lv in levels])
    if not levels:
        at = F.array().cast("array<struct<_level:int,_cx:bigint,_cy:bigint>>")
    salt = F.pmod(F.xxhash64(lat, lon), F.lit(SALT)).cast("int")
    looked = points.withColumn("_p", F.explode(at)).select(*points.columns, F.col("_p._level").alias("_level"), F.col("_p._cx").alias("_cx"), F.col("_p._cy").alias("_cy"), salt.alias("_salt"))
    joined = looked.join(held, ["_level", "_cx", "_cy", "_salt"])
    return joined.where(F.col("_whole") | inside_polygon(F.col(lat), F.col(lon), F.col("vertices"))).drop("_level", "_cx", "_cy", "_salt", "_whole")


def clip_to_polygons(points: DataFrame, polygons: DataFrame, lat: str = "box_lat", lon: str = "box_lon") -> DataFrame:
    """Rows inside any of the polygons (column `vertices`). Each distinct position is looked up once."""
    inside = _met(points.select(lat, lon).distinct(), polygons.select("vertices"), lat, lon).select(lat, lon).distinct()
    return points.join(inside, [lat, lon], "left_semi")


def points_in_polygons(points: DataFrame, polygons: DataFrame, lat: str = "box_lat", lon: str = "box_lon") -> DataFrame:
    """One row per point and polygon that holds it; polygons are tested each by itself."""
    return _met(points, polygons, lat, lon)


def label_regions(points: DataFrame, polygons: DataFrame, lat: str = "box_lat", lon: str = "box_lon") -> DataFrame:
    """Add `region`: the first (by `priority`, then name) polygon that holds the point, else 'NULL'.

    A label depends on the position alone, so distinct positions meet the polygons of their cell, one row per candidate,
    and every row takes its position's label: equal rows stay, whatever the number of polygons.
    """
    hits = _met(points.select(lat, lon).distinct(), polygons.select("priority", "region", "vertices"), lat, lon)
    labels = hits.groupBy(lat, lon).agg(F.min(F.struct("priority", "region"))["region"].alias("_region"))
    return points.join(labels, [lat, lon], "left").select(*points.columns, F.coalesce("_region", F.lit("NULL")).alias("region"))
