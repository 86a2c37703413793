"""Minimum curvature: a C1 surface of cubic pieces over the Delaunay triangles.

The slopes at the samples minimise the curvature of the triangle sides (Nielson 1983, Renka & Cline
1984); every triangle is split at its centroid into three cubic Bezier pieces (Alfeld 1984, Farin 1986).
Slopes are swept inside mesh tiles: what a sample feels of others shrinks at least by half a step, so a
tile with enough halo needs nothing from outside. Each tile sweeps twice, from two different guesses for the samples at its
rim; triangles whose slopes the guesses change go to a tile twice as wide.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfill.operators.grid import Grid
from gridfill.operators.mesh import locate, target_position
from gridfill.operators.tiles import UNKNOWN, Mesh, by_tiles
from gridfill.session import materialize

KEYS = ["datasetName", "name"]
RHO = 0.5               # one Jacobi sweep at least halves the error, on any mesh
FOUND = [f"{c}{i}" for i in (1, 2, 3) for c in ("gx", "gy", "mid_u", "mid_v")]


def tile_slopes(mesh: Mesh, sweeps: int) -> tuple[np.ndarray, np.ndarray]:
    """(slopes of the tile's corners, how much the guesses at its rim move each).

    Chebyshev-accelerated Jacobi sweeps. Corners without all their triangles keep their guess: once the slope their own sides
    give, once zero.
    """
    n = len(mesh.ids)
    both = np.concatenate([mesh.sides, mesh.sides[:, ::-1]]).astype(np.int64)
    i, j = np.divmod(np.unique(both[:, 0] * n + both[:, 1]), n)
    e, df = mesh.xy[j] - mesh.xy[i], mesh.value[j] - mesh.value[i]
    cube = (e * e).sum(1) ** 1.5
    total = lambda w: np.bincount(i, w, n)
    a, b, d = (total(4 * p * q / cube) for p, q in ((e[:, 0], e[:, 0]), (e[:, 0], e[:, 1]), (e[:, 1], e[:, 1])))
    right = np.stack([total(6 * e[:, k] * df / cube) for k in (0, 1)], axis=1)
    det = a * d - b * b
    sure = det > 1e-12 * (a + d) ** 2  # at the rim, sides may all point one way
    det = np.where(sure, det, 1)
    inverse = np.where(sure[:, None, None], np.stack([np.stack([d, -b], 1), np.stack([-b, a], 1)], 1) / det[:, None, None], 0)
    start = np.einsum("nij,nj->ni", inverse, right)
    free = mesh.whole

    def swept(guess: np.ndarray) -> np.ndarray:
        now, before, omega = np.where(free[:, None], start, guess), np.zeros((n, 2)), 2.0
        before[~free] = guess[~free]
        for sweep in range(1, sweeps + 1):
            omega = 1 / (1 - RHO * RHO / 2) if sweep == 1 else 1 / (1 - RHO * RHO * omega / 4)
            push = 2 * (e * now[j]).sum(1) / cube
            felt = np.stack([total(e[:, k] * push) for k in (0, 1)], axis=1)
            step = omega * (start - np.einsum("nij,nj->ni", inverse, felt) - before) + before
            now, before = np.where(free[:, None], step, guess), now
        return now

    slopes = swept(start)
    return slopes, np.abs(slopes - swept(np.zeros((n, 2)))).max(1) if not free.all() else np.zeros(n)


def curved_triangles(triangles: DataFrame, grid: Grid, tolerance: float = 1e-6, **tiling) -> DataFrame:
    """Triangles with the slopes gx, gy at their corners (in units of the row step) and the centroid mid_u, mid_v across the side
    opposite each corner (NULL on the hull). The number of sweeps follows from the tolerance."""
    ratio = grid.lon_gap / grid.lat_gap
    sweeps = math.ceil(math.log(tolerance * 1e-2) / math.log(RHO / (1 + math.sqrt(1 - RHO * RHO))))

    def work(key: tuple, rows: pa.Table) -> pa.Table:
        mesh = Mesh(rows, *key, ratio)
        slopes, moved = tile_slopes(mesh, sweeps)
        own = np.flatnonzero(mesh.own)
        corner, across = mesh.corner[own], mesh.across[own]
        most = np.abs(slopes[mesh.whole]).max(initial=0)
        ok = (across != UNKNOWN).all(1) & mesh.whole[corner].all(1) & (moved[corner].max(1, initial=0) <= tolerance * most)
        mids = [mesh.u[mesh.corner].mean(1), mesh.v[mesh.corner].mean(1)]
        out = {"tri_index": pa.array(mesh.index[own]), "ok": pa.array(ok)}
        for k in range(3):
            to = across[:, k]
            out |= {f"{c}{k + 1}": pa.array(slopes[corner[:, k], n]) for n, c in enumerate(("gx", "gy"))}
            out |= {f"{c}{k + 1}": pa.array(mids[n][to], mask=to < 0) for n, c in enumerate(("mid_u", "mid_v"))}
        return pa.table(out).select(["tri_index", "ok", *FOUND])

    slopes = by_tiles(triangles, work, f"tri_index long, ok boolean, {', '.join(c + ' double' for c in FOUND)}", **tiling)
    return triangles.join(slopes, [*KEYS, "tri_index"])


def cubic_patch(xy: np.ndarray, f: np.ndarray, g: np.ndarray, across: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Value of the split cubic at one point per row.

    xy (n,3,2) corners, f (n,3) values, g (n,3,2) slopes, across (n,3,2) centroid of the triangle over the
    side opposite each corner (NaN on the hull), at (n,2).
    """
    centre = xy.mean(1)

    def bary(p: np.ndarray) -> np.ndarray:
        d1, d2, d = xy[:, 1] - xy[:, 0], xy[:, 2] - xy[:, 0], p - xy[:, 0]
        whole = d1[:, 0] * d2[:, 1] - d1[:, 1] * d2[:, 0]
        b1 = (d[:, 0] * d2[:, 1] - d[:, 1] * d2[:, 0]) / whole
        b2 = (d1[:, 0] * d[:, 1] - d1[:, 1] * d[:, 0]) / whole
        return np.stack([1 - b1 - b2, b1, b2], 1)

    edge = {(i, j): f[:, i] + np.einsum("nc,nc->n", g[:, i], xy[:, j] - xy[:, i]) / 3 for i in range(3) for j in range(3) if i != j}
    inner = [(f[:, i] + edge[i, (i + 1) % 3] + edge[i, (i + 2) % 3]) / 3 for i in range(3)]
    side = []
    for i in range(3):
        j, k = (i + 1) % 3, (i + 2) % 3
        # Direction across the side, in coordinates of (corner j, corner k, centre): the slope along it must be linear.
        b = bary(across[:, i])
        free = np.isfinite(b[:, 0])
        alpha = np.where(free, b[:, j] - b[:, i], 0.5)
        beta = np.where(free, b[:, k] - b[:, i], 0.5)
        gamma = np.where(free, 3 * b[:, i] - 1, -1.0)
        bend = (alpha * (f[:, j] - 2 * edge[j, k] + edge[k, j]) + beta * (f[:, k] - 2 * edge[k, j] + edge[j, k])) / gamma
        side.append((bend + inner[j] + inner[k]) / 2)
    near = [(inner[i] + side[(i + 1) % 3] + side[(i + 2) % 3]) / 3 for i in range(3)]
    top = (near[0] + near[1] + near[2]) / 3
    b = bary(at)
    part = b.argmin(1)
    out = np.empty(len(f))
    for i in range(3):
        j, k = (i + 1) % 3, (i + 2) % 3
        m = part == i
        s, t, u = (b[:, j] - b[:, i])[m], (b[:, k] - b[:, i])[m], 3 * b[m, i]
        out[m] = (f[m, j] * s ** 3 + f[m, k] * t ** 3 + top[m] * u ** 3 + 3 * edge[j, k][m] * s * s * t + 3 * edge[k, j][m] * s * t * t
                  + 3 * inner[j][m] * s * s * u + 3 * inner[k][m] * t * t * u + 3 * near[j][m] * s * u * u + 3 * near[k][m] * t * u * u
                  + 6 * side[i][m] * s * t * u)
    return out


def minimum_curvature(triangles: DataFrame, grid: Grid, tolerance: float = 1e-6, targets: DataFrame | None = None, **tiling) -> DataFrame:
    """(keys, box_index, value) of the targets inside the hull: boxes, free positions (pu, pv), or every box of the grid."""
    ratio = grid.lon_gap / grid.lat_gap
    full = materialize(curved_triangles(triangles, grid, tolerance, **tiling))
    located = target_position(locate(full, grid, targets))
    nan = F.lit(float("nan"))
    each = lambda names: [F.coalesce(F.col(c) * (ratio if c.startswith(("v", "mid_v")) and not c.startswith("value") else 1.0), nan) for c in names]
    packed = F.array(*each([f"{a}{i}" for i in (1, 2, 3) for a in ("u", "v")]), *each([f"value{i}" for i in (1, 2, 3)]),
                     *each([f"{a}{i}" for i in (1, 2, 3) for a in ("gx", "gy")]), *each([f"{a}{i}" for i in (1, 2, 3) for a in ("mid_u", "mid_v")]),
                     F.col("pu"), F.col("pv") * ratio)

    @F.arrow_udf("double")
    def patch(rows: pa.Array) -> pa.Array:
        m = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), 23)
        return pa.array(cubic_patch(m[:, :6].reshape(-1, 3, 2), m[:, 6:9], m[:, 9:15].reshape(-1, 3, 2),
                                    m[:, 15:21].reshape(-1, 3, 2), m[:, 21:]))

    return located.select(*KEYS, "box_index", patch(packed).alias("value"))
