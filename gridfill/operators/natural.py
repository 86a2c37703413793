"""Natural neighbours: the triangles whose circle holds a target, and Sibson's weights, walked inside mesh tiles.

A walk starts in the target's own triangle and goes on over the sides of every triangle whose circle holds the target. A tile decides
all walks that stay where its sides are known; the others are walked again in a tile twice as wide. So there is one shuffle of
triangles and targets a round whatever the number of steps, and a triangle with many targets is copied to several tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfill.operators.grid import Grid
from gridfill.operators.mesh import TIE, target_position
from gridfill.operators.tiles import UNKNOWN, Mesh, targets_by_tiles

KEYS = ["datasetName", "name"]
FLAT = 1e-9             # relative height below which a target lies on a side


class Walk:
    """Conflicts (target, triangle), rim sides (target, triangle, side) around them, and targets that met an unknown side."""

    def __init__(self, mesh: Mesh, start: np.ndarray, at: np.ndarray):
        self.centre, r2 = mesh.circles()
        holds = lambda q, t: ((self.centre[t] - at[q]) ** 2).sum(1) < r2[t] * (1 - TIE)
        self.left = np.zeros(len(start), bool)
        conflicts, rim = [], []
        q, t = np.arange(len(start)), start
        q, t = (a[holds(q, t)] for a in (q, t))
        came, seen = np.full(len(q), -9), np.empty(0, np.int64)
        while len(q):
            conflicts.append(np.stack([q, t], axis=1))
            seen = np.union1d(seen, q * len(mesh.corner) + t)
            ahead = []
            for side in range(3):
                to = mesh.across[t, side]
                on = to != came
                self.left[q[on & (to == UNKNOWN)]] = True
                inner = on & (to >= 0)
                inner[inner] = holds(q[inner], to[inner])
                border = on & ~inner & (to != UNKNOWN)
                rim.append(np.stack([q[border], t[border], np.full(border.sum(), side)], axis=1))
                ahead.append(np.stack([q[inner], to[inner], t[inner]], axis=1))
            ahead = np.concatenate(ahead)
            key = ahead[:, 0] * len(mesh.corner) + ahead[:, 1]
            _, first = np.unique(key, return_index=True)  # rounding must not close a ring
            first = first[~np.isin(key[first], seen)]
            q, t, came = ahead[first].T
        self.conflicts = np.concatenate(conflicts) if conflicts else np.empty((0, 2), np.int64)
        self.rim = np.concatenate(rim) if rim else np.empty((0, 3), np.int64)


def _areas(group: np.ndarray, n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Area of the convex polygon of each group's points, in any order."""
    size = np.maximum(np.bincount(group, minlength=n), 1)
    x = x - (np.bincount(group, x, n) / size)[group]
    y = y - (np.bincount(group, y, n) / size)[group]
    order = np.lexsort((np.arctan2(y, x), group))
    group, x, y = group[order], x[order], y[order]
    last = np.ones(len(group), bool)
    last[:-1] = group[1:] != group[:-1]
    first = np.flatnonzero(np.concatenate([[True], last[:-1]])) if len(group) else np.empty(0, int)
    after = np.arange(1, len(group) + 1)
    after[last] = first
    return 0.5 * np.abs(np.bincount(group, x * y[after] - x[after] * y, n))


def sibson(mesh: Mesh, start: np.ndarray, at: np.ndarray, walk: Walk) -> np.ndarray:
    """Value at each target: the area its cell would take from each neighbour's cell weighs the neighbour's value. NaN on the hull.

    What it takes from one neighbour is a convex polygon whose corners are circumcentres: of the conflict triangles at that
    neighbour, and of the target with the two rim sides at that neighbour.
    """
    q, t = walk.conflicts.T
    rq, rt, side = walk.rim.T
    one, two = mesh.corner[rt, (side + 1) % 3], mesh.corner[rt, (side + 2) % 3]
    a, b = mesh.xy[one] - at[rq], mesh.xy[two] - at[rq]
    d = a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]
    a2, b2 = (a * a).sum(1), (b * b).sum(1)
    flat = np.abs(d) < FLAT * np.sqrt(a2 * b2)
    d = np.where(flat, np.inf, 2 * d)
    new = np.stack([(b[:, 1] * a2 - a[:, 1] * b2) / d, (a[:, 0] * b2 - b[:, 0] * a2) / d], axis=1)
    target = np.concatenate([np.repeat(q, 3), rq, rq])
    corner = np.concatenate([mesh.corner[t].ravel(), one, two])
    point = np.concatenate([np.repeat(walk.centre[t] - at[q], 3, axis=0), new, new])
    pairs, group = np.unique(target * len(mesh.ids) + corner, return_inverse=True)
    area = _areas(group, len(pairs), point[:, 0], point[:, 1])
    owner, value = pairs // len(mesh.ids), mesh.value[pairs % len(mesh.ids)]
    n = len(start)
    whole = np.bincount(owner, area, n)
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.bincount(owner, area * value, n) / whole
    out[rq[flat]] = np.nan
    for k in range(3):  # a target on a sample takes its value
        c = mesh.corner[start, k]
        same = (mesh.xy[c] == at).all(1)
        out[same] = mesh.value[c[same]]
    return out


def _started(key: tuple, mesh_rows: pa.Table, targets: pa.Table, ratio: float) -> tuple[Mesh, np.ndarray, np.ndarray, Walk]:
    mesh = Mesh(mesh_rows, *key, ratio)
    order = np.argsort(mesh.index, kind="stable")
    start = order[np.searchsorted(mesh.index, targets.column("tri_index").to_numpy(), sorter=order)]
    at = np.stack([targets.column("pu").to_numpy(), targets.column("pv").to_numpy() * ratio], axis=1)
    return mesh, start, at, Walk(mesh, start, at)


def natural_neighbour(located: DataFrame, triangles: DataFrame, grid: Grid, **tiling) -> DataFrame:
    """(keys, box_index, value) of located targets. A target on a sample takes its value, one on the hull has NULL."""
    ratio = grid.lon_gap / grid.lat_gap

    def work(key: tuple, mesh_rows: pa.Table, targets: pa.Table) -> pa.Table:
        if not len(targets):
            return pa.table({"box_index": pa.array([], pa.int64()), "ok": pa.array([], pa.bool_()), "value": pa.array([], pa.float64())})
        mesh, start, at, walk = _started(key, mesh_rows, targets, ratio)
        value = sibson(mesh, start, at, walk)
        return pa.table({"box_index": targets.column("box_index"), "ok": pa.array(~walk.left), "value": pa.array(value, mask=np.isnan(value))})

    return targets_by_tiles(target_position(located), triangles, work, "box_index long, ok boolean, value double", **tiling)


def conflict_triangles(located: DataFrame, triangles: DataFrame, grid: Grid, **tiling) -> DataFrame:
    """(keys, box_index, triangles): for each located target the triangles whose circle holds it, with their circumcentres, by number."""
    ratio = grid.lon_gap / grid.lat_gap

    def work(key: tuple, mesh_rows: pa.Table, targets: pa.Table) -> pa.Table:
        kind = pa.list_(pa.struct([("tri_index", pa.int64()), ("cx", pa.float64()), ("cy", pa.float64())]))
        if not len(targets):
            return pa.table({"box_index": pa.array([], pa.int64()), "ok": pa.array([], pa.bool_()), "triangles": pa.array([], kind)})
        mesh, start, at, walk = _started(key, mesh_rows, targets, ratio)
        q, t = walk.conflicts.T
        order = np.lexsort((mesh.index[t], q))
        q, t = q[order], t[order]
        ends = np.searchsorted(q, np.arange(len(start) + 1)).astype(np.int32)
        each = pa.StructArray.from_arrays([pa.array(mesh.index[t]), pa.array(walk.centre[t, 0]), pa.array(walk.centre[t, 1])], ["tri_index", "cx", "cy"])
        return pa.table({"box_index": targets.column("box_index"), "ok": pa.array(~walk.left), "triangles": pa.ListArray.from_arrays(pa.array(ends), each)})

    found = targets_by_tiles(target_position(located), triangles, work, "box_index long, ok boolean, triangles array<struct<tri_index:long,cx:double,cy:double>>", **tiling)
    return found.where(F.size("triangles") > 0)  # none for a target on a sample


