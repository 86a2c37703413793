"""Tiles of a triangulation: what one task works on, with a halo of triangles around it.

Tiles are the cells of a quadtree over the corners, planned on counts per cell: a tile holds at most MOST corners (more only where
cells of 2^FINEST boxes still hold more). A triangle belongs to the tile of its first corner and is copied to every tile that has
one of its corners in its halo, a quarter of the tile's width. A corner inside the halo has all its triangles in the tile, so a side is
known to be on the hull, or not, wherever one of its ends lies inside. What a tile cannot decide goes to a tile twice as wide in the next round.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridfill.session import materialize

KEYS = ["datasetName", "name"]
TILE = [*KEYS, "level", "tx", "ty"]
MOST = 4096             # corners of a tile
BASE = 5                # level of the first counts: cells of 32 boxes
FINEST = -40
HALO = 0.25             # of a tile's width
TARGETS = 1 << 16       # targets of one tile that one task handles
HULL, UNKNOWN = -1, -2


def _cell(position: Column, level) -> Column:
    return F.floor(position / (F.pow(F.lit(2.0), level) if isinstance(level, Column) else F.lit(2.0 ** level))).cast("long")


def _up(cell: Column, steps) -> Column:
    return F.floor(cell / F.pow(F.lit(2.0), steps)).cast("long")


def rolled_up(cells: DataFrame, base: int, top: int) -> DataFrame:
    """(keys, level, cx, cy, n) for the levels base to top, summed from counts per cell at the base: samples are not read again."""
    step = F.col("level") - F.lit(base)
    return (cells.withColumn("level", F.explode(F.sequence(F.lit(base), F.lit(top))))
            .groupBy(*KEYS, "level", _up(F.col("cx"), step).alias("cx"), _up(F.col("cy"), step).alias("cy")).agg(F.sum("n").alias("n")))


def cell_counts(points: DataFrame, level: int) -> DataFrame:
    """(keys, cx, cy, n): points (u, v) per cell of 2^level boxes."""
    return points.groupBy(*KEYS, _cell(F.col("u"), level).alias("cx"), _cell(F.col("v"), level).alias("cy")).agg(F.count("*").alias("n"))


def plan_tiles(corners: DataFrame, most: int = MOST) -> tuple[DataFrame, list[int]]:
    """(tiles, their levels) that hold all corners (keys, u, v), each once."""
    tiles, base, points = None, BASE, corners.select(*KEYS, "u", "v")
    while True:
        cells = materialize(cell_counts(points, base))
        if tiles is None:
            spans = cells.agg(*[f(c) for c in ("cx", "cy") for f in (F.min, F.max)]).first()
            wide = 0 if spans[0] is None else max(spans[1] - spans[0], spans[3] - spans[2])
            top = base + int(wide).bit_length()
        sums = rolled_up(cells, base, top)
        parents = sums.select(*KEYS, (F.col("level") - 1).alias("level"), F.col("cx").alias("px"), F.col("cy").alias("py"), F.col("n").alias("above"))
        each = sums.withColumns({"px": _up(F.col("cx"), 1), "py": _up(F.col("cy"), 1)}).join(parents, [*KEYS, "level", "px", "py"], "left")
        light = (F.col("n") <= most) | F.lit(base <= FINEST) & (F.col("level") == base)
        found = each.where(light & (F.col("above").isNull() | (F.col("above") > most))).select(*KEYS, "level", F.col("cx").alias("tx"), F.col("cy").alias("ty"))
        tiles = found if tiles is None else tiles.unionByName(found)
        heavy = cells.where(F.col("n") > most).select(*KEYS, F.col("cx").alias("_x"), F.col("cy").alias("_y"))
        if base <= FINEST or heavy.isEmpty():
            tiles = materialize(tiles)
            return tiles, sorted(r[0] for r in tiles.select("level").distinct().collect())
        points = points.withColumns({"_x": _cell(F.col("u"), base), "_y": _cell(F.col("v"), base)}).join(heavy, [*KEYS, "_x", "_y"], "left_semi").drop("_x", "_y")
        # The heavy cells themselves stand for their parents' level in the next round.
        top, base = base - 1, max(FINEST, base - 3)


def _candidates(levels: list[int], spans: list[tuple[str, str]], halo: float) -> Column:
    """Array of (level, tx, ty) of the cells within reach of any of the positions."""
    parts = []
    for level in levels:
        side = 2.0 ** level
        for u, v in spans:
            reach = [f"sequence(CAST(floor(({c} - {halo * side!r}D) / {side!r}D) AS BIGINT), CAST(floor(({c} + {halo * side!r}D) / {side!r}D) AS BIGINT))" for c in (u, v)]
            parts.append(f"flatten(transform({reach[0]}, x -> transform({reach[1]}, y -> named_struct('level', {level}, 'tx', x, 'ty', y))))")
    return F.expr(f"explode(array_distinct(concat({', '.join(parts)})))")


def dealt_triangles(triangles: DataFrame, tiles: DataFrame, levels: list[int]) -> DataFrame:
    """Triangles with every tile that needs them."""
    spread = triangles.withColumn("_c", _candidates(levels, [("u1", "v1"), ("u2", "v2"), ("u3", "v3")], HALO)).select(*triangles.columns, "_c.*")
    return spread.join(tiles, TILE)


def homed(rows: DataFrame, tiles: DataFrame, levels: list[int]) -> DataFrame:
    """Rows that carry a triangle's columns, with the triangle's own tile."""
    return rows.withColumn("_c", _candidates(levels, [("u1", "v1")], 0.0)).select(*rows.columns, "_c.*").join(tiles, TILE)


def _numbers(table: pa.Table, names: list[str]) -> np.ndarray:
    return np.stack([table.column(c).to_numpy() for c in names], axis=1)


class Mesh:
    """The triangles of a tile: corners (rows of `xy`, the second axis scaled by `ratio`), which triangles are the tile's own, and
    the triangle across the side opposite each corner (HULL where there is none, UNKNOWN where it may lie beyond the halo)."""

    def __init__(self, table: pa.Table, level: int, tx: int, ty: int, ratio: float):
        side = 2.0 ** level
        self.index = table.column("tri_index").to_numpy()
        points = _numbers(table, ["point1", "point2", "point3"])
        u, v = _numbers(table, ["u1", "u2", "u3"]), _numbers(table, ["v1", "v2", "v3"])
        self.ids, first, corner = np.unique(points.ravel(), return_index=True, return_inverse=True)
        self.corner = corner.reshape(points.shape)
        self.u, self.v, self.value = u.ravel()[first], v.ravel()[first], _numbers(table, ["value1", "value2", "value3"]).ravel()[first]
        self.xy = np.stack([self.u, self.v * ratio], axis=1)
        self.own = (np.floor(u[:, 0] / side) == tx) & (np.floor(v[:, 0] / side) == ty)
        w = HALO * side
        self.whole = ((np.floor((self.u - w) / side) <= tx) & (tx <= np.floor((self.u + w) / side))
                      & (np.floor((self.v - w) / side) <= ty) & (ty <= np.floor((self.v + w) / side)))
        n = len(points)
        ends = np.sort(np.stack([self.corner[:, [1, 2, 0]].ravel(), self.corner[:, [2, 0, 1]].ravel()], axis=1), axis=1)
        key = ends[:, 0].astype(np.int64) * len(self.ids) + ends[:, 1]
        order = np.argsort(key, kind="stable")
        twin = np.flatnonzero(key[order][1:] == key[order][:-1])
        across = np.where(self.whole[ends].any(1), HULL, UNKNOWN)
        across[order[twin]], across[order[twin + 1]] = order[twin + 1] // 3, order[twin] // 3
        self.across = across.reshape(n, 3)
        self.sides = ends

    def circles(self) -> tuple[np.ndarray, np.ndarray]:
        """Circumcentres and squared radii."""
        a, b, c = (self.xy[self.corner[:, i]] for i in range(3))
        b, c = b - a, c - a
        d = 2 * (b[:, 0] * c[:, 1] - b[:, 1] * c[:, 0])
        b2, c2 = (b * b).sum(1), (c * c).sum(1)
        with np.errstate(divide="ignore", invalid="ignore"):
            off = np.stack([(c[:, 1] * b2 - b[:, 1] * c2) / d, (b[:, 0] * c2 - c[:, 0] * b2) / d], axis=1)
        return a + off, (off * off).sum(1)


def by_tiles(triangles: DataFrame, work: Callable[[tuple, pa.Table], pa.Table], schema: str, most: int = MOST) -> DataFrame:
    """Results of `work((level, tx, ty), triangles of the tile)` for every triangle once.

    `work` returns a row per own triangle: tri_index, ok and what it found. Triangles with ok false are done again by tiles twice as wide.
    """
    corners = triangles.select(*KEYS, F.col("u1").alias("u"), F.col("v1").alias("v"))
    tiles, levels = plan_tiles(corners, most)
    full = f"datasetName string, name string, level int, tx long, ty long, {schema}"

    def run(key: tuple, table: pa.Table) -> pa.Table:
        dataset, name, level, tx, ty = (k.as_py() for k in key)
        found = work((level, tx, ty), table)
        n = len(found)
        return pa.table({"datasetName": pa.array([dataset] * n, pa.string()), "name": pa.array([name] * n, pa.string()), "level": pa.array([level] * n, pa.int32()),
                         "tx": pa.array([tx] * n, pa.int64()), "ty": pa.array([ty] * n, pa.int64()), **{c: found.column(c) for c in found.column_names}})

    done, wanted = None, None
    while True:
        found = dealt_triangles(triangles, tiles, levels).groupBy(*TILE).applyInArrow(run, full)
        if wanted is not None:
            found = found.join(wanted, [*TILE, "tri_index"], "left_semi")
        found = materialize(found)
        good = found.where("ok").drop("ok", "level", "tx", "ty")
        done = good if done is None else done.unionByName(good)
        left = found.where("not ok")
        if left.isEmpty():
            return done
        wanted, tiles, levels = _wider(left, "tri_index")


def _wider(left: DataFrame, what: str) -> tuple[DataFrame, DataFrame, list[int]]:
    """(what is left with its next tile, those tiles, their levels)."""
    wanted = materialize(left.select(*KEYS, (F.col("level") + 1).alias("level"), _up(F.col("tx"), 1).alias("tx"), _up(F.col("ty"), 1).alias("ty"), what))
    tiles = wanted.select(*TILE).distinct()
    return wanted, tiles, sorted(r[0] for r in tiles.select("level").distinct().collect())


def targets_by_tiles(located: DataFrame, triangles: DataFrame, work: Callable[[tuple, pa.Table, pa.Table], pa.Table], schema: str,
                     most: int = MOST) -> DataFrame:
    """Results of `work((level, tx, ty), triangles of the tile, targets in its own triangles)` for every target once.

    `located` has box_index, tri_index, pu, pv and its triangle's u1, v1. A tile with many targets is copied to several tasks. `work`
    returns box_index, ok and what it found; targets with ok false are done again by tiles twice as wide.
    """
    corners = triangles.select(*KEYS, F.col("u1").alias("u"), F.col("v1").alias("v"))
    tiles, levels = plan_tiles(corners, most)
    full = f"datasetName string, name string, level int, tx long, ty long, {schema}"
    slim = located.select(*KEYS, "box_index", "tri_index", "pu", "pv", "u1", "v1")

    def run(key: tuple, mesh: pa.Table, targets: pa.Table) -> pa.Table:
        dataset, name, level, tx, ty, _ = (k.as_py() for k in key)
        found = work((level, tx, ty), mesh, targets)
        n = len(found)
        return pa.table({"datasetName": pa.array([dataset] * n, pa.string()), "name": pa.array([name] * n, pa.string()), "level": pa.array([level] * n, pa.int32()),
                         "tx": pa.array([tx] * n, pa.int64()), "ty": pa.array([ty] * n, pa.int64()), **{c: found.column(c) for c in found.column_names}})

    done = None
    at_home = materialize(homed(slim, tiles, levels))
    while True:
        loads = at_home.groupBy(*TILE).agg((1 + F.floor(F.count("*") / TARGETS)).alias("_parts"))
        loads = materialize(loads)
        targets = at_home.join(loads, TILE).withColumn("_part", F.pmod(F.xxhash64("box_index"), F.col("_parts"))).drop("_parts")
        meshes = dealt_triangles(triangles, loads, levels).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))).drop("_parts")
        found = materialize(meshes.groupBy(*TILE, "_part").cogroup(targets.groupBy(*TILE, "_part")).applyInArrow(run, full))
        good = found.where("ok").drop("ok", "level", "tx", "ty")
        done = good if done is None else done.unionByName(good)
        left = found.where("not ok")
        if left.isEmpty():
            return done
        wanted, _, levels = _wider(left, "box_index")
        at_home = materialize(slim.join(wanted, [*KEYS, "box_index"]))
