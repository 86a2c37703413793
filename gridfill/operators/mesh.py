"""Delaunay triangles without a global mesh, boxes and free positions in triangles, and linear interpolation.

Each sample builds the triangles around itself from its nearest samples. They are final once every
sample that could lie inside one of their circles has been seen; samples near the edge of the data
also use the convex hull, because a circle matters only where it overlaps the hull. Samples that cannot
be sure yet look at four times as many neighbours in the next round. Which side of a line or circle a point lies on is decided exactly:
in doubles where their error bound allows, in whole numbers otherwise.
"""

from __future__ import annotations

from functools import cmp_to_key

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridfill.functions.geo import triangle_area
from gridfill.operators.grid import Grid
from gridfill.operators.neighbors import knn
from gridfill.operators.prep import dense_index, first_per_position
from gridfill.operators.regions import convex_hulls
from gridfill.session import materialize

KEYS = ["datasetName", "name"]
FIRST_K = 32
TIE = 1e-9              # box units within which a target counts as on a side
EPS = 2.0 ** -52
FARTHEST = 1e100        # bend of a circle that is a line
BATCH = 1 << 21         # neighbours of the samples handled at once
RIM = 1 - 1e-9
LARGE = 1 << 14         # boxes of a triangle's bounds above which its rows are dealt out
MAX_CUTS = 64           # strips of a triangle in the point index


# ---------------------------------------------------------------- triangles around a sample (numpy, many samples at once)

def _pad(lists: pa.Array, width: int, fill: float) -> np.ndarray:
    lengths = np.diff(lists.offsets.to_numpy())
    out = np.full((len(lists), width), fill)
    out[np.arange(width) < lengths[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _hull_reach(cx, cy, hx, hy) -> np.ndarray:
    """At least the largest distance from the origin to a point that lies in both the hull and the circle around (cx, cy) through the origin.

    A point p is in the circle if |p|^2 / 2r <= p n, with n towards the centre: this stays exact enough for circles that are
    almost lines.
    """
    r = np.hypot(cx, cy)
    nx, ny, bend = (cx / r)[:, None], (cy / r)[:, None], (0.5 / r)[:, None]
    far2 = hx * hx + hy * hy
    slack = 1e-9 * np.sqrt(far2.max(1, keepdims=True))
    value = bend * far2 - hx * nx - hy * ny - slack
    far = np.where(value <= 0, np.sqrt(far2), 0).max(1)
    ex, ey = np.roll(hx, -1, 1) - hx, np.roll(hy, -1, 1) - hy
    two, one = bend * (ex * ex + ey * ey), 2 * bend * (hx * ex + hy * ey) - ex * nx - ey * ny
    disc = one * one - 4 * two * value
    with np.errstate(divide="ignore", invalid="ignore"):
        half = -0.5 * (one + np.where(one < 0, -1, 1) * np.sqrt(np.where(disc >= 0, disc, np.nan)))
        for t in (half / two, value / half):
            t = np.where((t >= -1e-9) & (t <= 1 + 1e-9), t, np.nan)
            far = np.fmax(far, np.nan_to_num(np.hypot(hx + t * ex, hy + t * ey)).max(1))
    inside = ((ex * (2 * cy[:, None] - hy) - ey * (2 * cx[:, None] - hx)) >= 0).all(1)
    return np.where(inside, np.maximum(far, 2 * r), far) * (1 + 1e-9)


def _whole(*lists) -> list[list[int]]:
    """Doubles as whole numbers of one common unit."""
    parts = [[float(x).as_integer_ratio() for x in values] for values in lists]
    unit = max((d for values in parts for _, d in values), default=1)
    return [[n * (unit // d) for n, d in values] for values in parts]


def exact_next(u: list[float], v: list[float], ratio: float, turn: int) -> tuple[list[int], float] | None:
    """The exact answer where doubles leave a doubt: u, v have the sample, a neighbour and candidates. Of those left of the line to
    the neighbour, the ones that no other lies before (in the circle through sample and neighbour), by angle, and their circle."""
    us, vs = _whole(u, v)
    p, q = [x - us[0] for x in us[1:]], [x - vs[0] for x in vs[1:]]
    n, d = ratio.as_integer_ratio()
    cross = [turn * (p[0] * y - q[0] * x) for x, y in zip(p, q)]
    height = [(x - p[0]) * x * d * d + (y - q[0]) * y * n * n for x, y in zip(p, q)]
    best: list[int] = []
    for i in range(1, len(p)):
        if cross[i] > 0:
            ahead = height[i] * cross[best[0]] - height[best[0]] * cross[i] if best else -1
            best = [i] if ahead < 0 else [*best, i] if ahead == 0 else best
    if not best:
        return None
    best.sort(key=cmp_to_key(lambda i, j: -turn * (1 if p[i] * q[j] > q[i] * p[j] else -1)))
    try:
        bend = height[best[0]] / (2 * cross[best[0]] * n * d)
    except OverflowError:
        bend = FARTHEST if height[best[0]] > 0 else -FARTHEST
    return [i - 1 for i in best], min(max(bend, -FARTHEST), FARTHEST)


class _Lattice:
    """Next corners where all positions are whole numbers of steps: exact in 64-bit numbers."""

    def __init__(self, u0, v0, u, v, ratio: float):
        self.ratio, self.u0, self.v0, self.u, self.v = ratio, u0, v0, u, v
        p, q = u - u0[:, None], v - v0[:, None]
        self.there = np.isfinite(p)
        self.p, self.q = (np.where(self.there, a, 0).astype(np.int64) for a in (p, q))

    @staticmethod
    def fits(u0, v0, u, v) -> bool:
        p, q = u - u0[:, None], v - v0[:, None]
        return all(bool((~np.isfinite(a) | ((a == np.rint(a)) & (np.abs(a) < 1 << 14))).all()) for a in (p, q))

    def step(self, rows: np.ndarray, cur: np.ndarray, turn: int):
        """(which rows go on, their candidates that come next, order by angle, bend of the circle)."""
        p, q, r2 = self.p[rows], self.q[rows], self.ratio * self.ratio
        at = np.arange(len(rows))
        pa, qa = p[at, cur][:, None], q[at, cur][:, None]
        cross = turn * (pa * q - qa * p)
        left = self.there[rows] & (cross > 0)
        first, second = (p - pa) * p, (q - qa) * q
        with np.errstate(divide="ignore", invalid="ignore"):
            bend = np.where(left, (first + r2 * second) / (2 * cross * self.ratio), np.inf)
        ref = bend.argmin(1)
        on = np.isfinite(bend[at, ref])
        tie, doubt = np.zeros_like(left), on.copy()
        for _ in range(8):
            k = np.flatnonzero(doubt)
            if not len(k):
                break
            c, a0, b0 = cross[k, ref[k]][:, None], first[k, ref[k]][:, None], second[k, ref[k]][:, None]
            a, b = first[k] * c - a0 * cross[k], second[k] * c - b0 * cross[k]
            ahead = a + r2 * b
            near = np.abs(ahead) <= 1e-12 * (np.abs(a) + r2 * np.abs(b))
            unclear = left[k] & near & (ahead != 0) & ((a != 0) | (b != 0))
            before = left[k] & (ahead < 0) & ~near
            same = left[k] & near
            done = ~before.any(1) & ~unclear.any(1)
            tie[k[done]] = same[done]
            doubt[k[done]] = False
            ref[k] = np.where(before.any(1), np.where(before, bend[k], np.inf).argmin(1), ref[k])
        angle = np.arctan2(cross * self.ratio, pa * p + qa * q * r2)
        bend = bend[at, ref]
        order = np.argsort(np.where(tie, angle, np.inf), axis=1, kind="stable")
        _settle(self, rows, cur, turn, np.flatnonzero(doubt), left, tie, order, on, bend)
        return on, tie, order, bend

    def beyond(self, rows: np.ndarray, cur: np.ndarray, hu: np.ndarray, hv: np.ndarray, turn: int) -> np.ndarray:
        """Whether a hull corner lies left of the line to the neighbour."""
        p, q = (hu - self.u0[rows][:, None]).astype(np.int64), (hv - self.v0[rows][:, None]).astype(np.int64)
        return (turn * (self.p[rows, cur][:, None] * q - self.q[rows, cur][:, None] * p) > 0).any(1)


class _Free:
    """Next corners of free positions: doubles with a bound of their error, whole numbers where it leaves a doubt."""

    def __init__(self, u0, v0, u, v, ratio: float):
        self.ratio, self.u0, self.v0, self.u, self.v = ratio, u0, v0, u, v
        self.x, self.y = u - u0[:, None], (v - v0[:, None]) * ratio

    def step(self, rows: np.ndarray, cur: np.ndarray, turn: int):
        x, y = self.x[rows], self.y[rows]
        at = np.arange(len(rows))
        ax, ay = x[at, cur][:, None], y[at, cur][:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            cross = turn * (ax * y - ay * x)
            blur = 8 * EPS * (np.abs(ax * y) + np.abs(ay * x))
            height = x * (x - ax) + y * (y - ay)
            rough = 8 * EPS * (np.abs(x) * (np.abs(x) + np.abs(ax)) + np.abs(y) * (np.abs(y) + np.abs(ay)))
            there = np.isfinite(x)
            there[at, cur] = False
            sure = there & (cross > blur)
            bend = np.where(sure, height / (2 * cross), np.inf)
            error = np.where(sure, (rough + 2 * np.abs(bend) * blur) / (cross - blur) + 8 * EPS * np.abs(bend), 0)
            bound = np.where(sure, bend + error, np.inf).min(1)[:, None]
            close = sure & (bend - error <= bound)
            faint = there & (np.abs(cross) <= blur) & ~((height > rough) & ((height - rough) / (2 * blur) > bound))
        ref = np.where(close, bend, np.inf).argmin(1)
        on = np.isfinite(bound[:, 0])
        tie = np.zeros_like(sure)
        tie[at[on], ref[on]] = True
        order = np.argsort(~tie, axis=1, kind="stable")
        bend = bend[at, ref]
        _settle(self, rows, cur, turn, np.flatnonzero((close.sum(1) > 1) | faint.any(1)), close | faint, tie, order, on, bend)
        return on, tie, order, bend

    def beyond(self, rows: np.ndarray, cur: np.ndarray, hu: np.ndarray, hv: np.ndarray, turn: int) -> np.ndarray:
        hx, hy = hu - self.u0[rows][:, None], (hv - self.v0[rows][:, None]) * self.ratio
        ax, ay = self.x[rows, cur][:, None], self.y[rows, cur][:, None]
        cross, blur = turn * (ax * hy - ay * hx), 8 * EPS * (np.abs(ax * hy) + np.abs(ay * hx))
        out = (cross > blur).any(1)
        for i in np.flatnonzero(~out & (np.abs(cross) <= blur).any(1)):
            r = rows[i]
            some = np.flatnonzero(np.abs(cross[i]) <= blur[i])
            us = [self.u0[r], self.u[r, cur[i]], *hu[i, some]]
            out[i] = exact_next(us, [self.v0[r], self.v[r, cur[i]], *hv[i, some]], self.ratio, turn) is not None
        return out


def _settle(kind, rows, cur, turn, doubtful, candidates, tie, order, on, bend) -> None:
    """Decide the doubtful rows exactly, in place."""
    for i in doubtful:
        r, some = rows[i], np.flatnonzero(candidates[i])
        us, vs = ([p0[r], p[r, cur[i]], *p[r, some]] for p0, p in ((kind.u0, kind.u), (kind.v0, kind.v)))
        found = exact_next(us, vs, kind.ratio, turn)
        tie[i] = False
        on[i] = found is not None
        if found:
            chosen = some[found[0]]
            tie[i, chosen] = True
            order[i] = np.concatenate([chosen, np.setdiff1d(np.arange(order.shape[1]), chosen)])
            bend[i] = found[1]


def stars(own: np.ndarray, u0: np.ndarray, v0: np.ndarray, u: np.ndarray, v: np.ndarray, ids: np.ndarray, seen_all: np.ndarray,
          ratio: float, hull: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """Delaunay triangles around each row's sample, exactly.

    u0, v0: samples; u, v: their neighbours, nearest first, NaN-padded (the second axis counts `ratio` times); ids: their numbers; own: the
    samples'. Returns (final?, (row, slot, slot) of the triangles whose lowest id is the sample's own).
    Points on one circle form a fan from the lowest id, so only that sample reports them.
    """
    rows, width = u.shape
    kind = (_Lattice if _Lattice.fits(u0, v0, u, v) else _Free)(u0, v0, u, v, ratio)
    x, y = u - u0[:, None], (v - v0[:, None]) * ratio
    last = np.sum(np.isfinite(x), 1) - 1
    end = np.maximum(last, 0)
    reach = np.where(last >= 0, np.hypot(x[np.arange(rows), end], y[np.arange(rows), end]), 0) * RIM
    good = (last >= 0) | seen_all
    out = [np.empty((0, 3), np.int64)]
    closed = np.zeros(rows, bool)
    for turn in (1, -1):
        active = np.flatnonzero((last >= 1) & ~closed & good)
        cur = np.zeros(rows, int)
        while len(active):
            on, tie, order, bend = kind.step(active, cur[active], turn)
            rest = active[~on]
            if len(rest) and hull is None:
                good[rest] &= seen_all[rest]
            elif len(rest):
                good[rest] &= seen_all[rest] | ~kind.beyond(rest, cur[rest], hull[0][rest], hull[1][rest], turn)
            if not on.any():
                break
            active, tie, order, bend = active[on], tie[on], order[on], np.clip(bend[on], -FARTHEST, FARTHEST)
            ax, ay = x[active, cur[active]], y[active, cur[active]]
            cx, cy = ax / 2 - turn * bend * ay, ay / 2 + turn * bend * ax
            unsure = np.flatnonzero(~seen_all[active] & ~(2 * np.hypot(cx, cy) < reach[active]))
            if len(unsure) and hull is None:
                good[active[unsure]] = False
            elif len(unsure):
                r = active[unsure]
                good[r] &= _hull_reach(cx[unsure], cy[unsure], hull[0][r] - u0[r][:, None], (hull[1][r] - v0[r][:, None]) * ratio) < reach[r]
            count = tie.sum(1)
            lowest = np.minimum(np.where(tie, ids[active], np.inf).min(1), ids[active, cur[active]])
            mine = own[active] < lowest
            prev = cur[active]
            for m in range(count.max()):
                use = mine & (m < count)
                sides = (prev[use], order[use, m])[::turn]
                out.append(np.stack([active[use], *sides], axis=1))
                prev = np.where(m < count, order[:, m], prev)
            cur[active] = prev
            back = prev == 0
            closed[active[back]] = True
            # A star that is not final is done again: no need to go on.
            active = active[~back & good[active]]
    return good, np.concatenate(out)


def _mesh_points(samples: DataFrame, grid: Grid) -> DataFrame:
    """Samples with position u, v in box units; of those on one position the lowest index."""
    rows = samples.where(F.col("value").isNotNull())
    if {"box_x", "box_y"} <= set(samples.columns):
        return rows.select(*KEYS, "index", (F.col("box_x") + 0.5).alias("u"), (F.col("box_y") + 0.5).alias("v"), "value")
    placed = rows.select(*KEYS, "index", ((F.col("lat") - grid.lat_min) / grid.lat_gap).alias("u"),
                         ((F.col("lon") - grid.lon_min) / grid.lon_gap).alias("v"), "value")
    return first_per_position(placed, "index", "u", "v", KEYS)


def _star_udf(k: int, ratio: float):
    """(number, position, neighbours' numbers, positions and values, hull) -> struct(ok, triangles). Rows are handled so many at a
    time that their arrays stay small whatever k is."""
    step = max(1, BATCH // max(k, 1))

    def some(own: pa.Array, x: pa.Array, y: pa.Array, ids: pa.Array, nx: pa.Array, ny: pa.Array, values: pa.Array, hx: pa.Array, hy: pa.Array) -> pa.Array:
        corners = np.diff(hx.offsets.to_numpy())
        hull = None
        if len(corners) and corners.min() > 0:
            hull = tuple(_repeat_last(_pad(a, int(corners.max()), np.nan)) for a in (hx, hy))
        sizes = np.diff(ids.offsets.to_numpy())
        width = max(1, int(sizes.max(initial=1)))
        near_u, near_v, numbers = _pad(nx, width, np.nan), _pad(ny, width, np.nan), _pad(ids, width, np.inf)
        good, found = stars(own.to_numpy(zero_copy_only=False), x.to_numpy(zero_copy_only=False), y.to_numpy(zero_copy_only=False), near_u, near_v,
                            numbers, sizes < k, ratio, hull)
        found = found[good[found[:, 0]]]
        found = found[np.argsort(found[:, 0], kind="stable")]
        offsets = np.searchsorted(found[:, 0], np.arange(len(good) + 1))
        first = ids.offsets.to_numpy()[:-1].astype(np.int64) - (ids.offsets[0].as_py() if len(ids) else 0)
        flat = [a.flatten() for a in (ids, nx, ny, values)]
        corners = [a.take(pa.array(first[found[:, 0]] + found[:, c])) for c in (1, 2) for a in flat]
        each = pa.StructArray.from_arrays(corners, [f"{n}{c}" for c in (2, 3) for n in ("point", "u", "v", "value")])
        return pa.StructArray.from_arrays([pa.array(good), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), each)], ["ok", "triangles"])

    def star(own: pa.Array, x: pa.Array, y: pa.Array, ids: pa.Array, nx: pa.Array, ny: pa.Array, values: pa.Array, hx: pa.Array, hy: pa.Array) -> pa.Array:
        columns = (own, x, y, ids, nx, ny, values, hx, hy)
        parts = [some(*(pa.concat_arrays([c.slice(at, step)]) for c in columns)) for at in range(0, len(own), step)]
        return pa.concat_arrays(parts) if parts else some(*columns)

    corner = ", ".join(f"{n}{c}:{'bigint' if n == 'point' else 'double'}" for c in (2, 3) for n in ("point", "u", "v", "value"))
    return F.arrow_udf(star, f"struct<ok:boolean,triangles:array<struct<{corner}>>>")


def delaunay(samples: DataFrame, grid: Grid, first_k: int = FIRST_K) -> DataFrame:
    """Triangles of every feature's samples: tri_index, corners point1..3 (point1 the lowest, counter-
    clockwise) with positions u1, v1, ... in box units and values value1..3."""
    points = materialize(_mesh_points(samples, grid))
    ratio = grid.lon_gap / grid.lat_gap
    sources = points.withColumns({"lat": F.col("u"), "lon": F.col("v")})
    pending = points.select(*KEYS, F.col("index").alias("box_index"), F.col("u").alias("x"), F.col("v").alias("y"),
                            F.col("value").alias("own_value"), "u", "v")
    hulls = None
    k, triangles = first_k, None
    while True:
        star_udf = _star_udf(k, ratio)
        near = knn(pending, sources, grid, k + 1)
        others = near.withColumn("neighbors", F.filter("neighbors", lambda n: n["index"] != F.col("box_index")))
        if hulls is None:
            others = others.withColumns({"hx": F.array().cast("array<double>"), "hy": F.array().cast("array<double>")})
        else:
            others = others.join(hulls, KEYS)
        star = star_udf("box_index", "x", "y", *[F.col(f"neighbors.{c}") for c in ("index", "lat", "lon", "value")], "hx", "hy")
        # The neighbours stay behind: a sample is written with its triangles, or alone if it must look further.
        done = materialize(others.select(*KEYS, "box_index", "x", "y", "own_value", star.alias("star")))
        found = done.where("star.ok").withColumn("_t", F.explode("star.triangles")).select(
            *KEYS, F.col("box_index").alias("point1"), "_t.point2", "_t.point3", F.col("x").alias("u1"), F.col("y").alias("v1"), "_t.u2", "_t.v2",
            "_t.u3", "_t.v3", F.col("own_value").alias("value1"), "_t.value2", "_t.value3")
        triangles = found if triangles is None else triangles.unionByName(found)
        pending = done.where("not star.ok").select(*KEYS, "box_index", "x", "y", "own_value", F.col("x").alias("u"), F.col("y").alias("v"))
        if pending.isEmpty():
            break
        if hulls is None:
            corners = convex_hulls(points.select(*KEYS, F.col("u").alias("lat"), F.col("v").alias("lon")), KEYS)
            hulls = materialize(corners.select(*KEYS, F.col("vertices.lat").alias("hx"), F.col("vertices.lon").alias("hy")))
        k *= 4
    return dense_index(triangles, ["datasetName", "name", "point1", "point2", "point3"], "tri_index")


def _repeat_last(padded: np.ndarray) -> np.ndarray:
    """Fill the NaN tail of each row with the row's last number (a repeated hull corner changes nothing)."""
    last = np.maximum(np.sum(np.isfinite(padded), 1) - 1, 0)
    fill = padded[np.arange(len(padded)), last]
    return np.where(np.isfinite(padded), padded, fill[:, None])


# ---------------------------------------------------------------- operators on triangles

def drop_degenerate(triangles: DataFrame, eps: float = 1e-12) -> DataFrame:
    """Leave out triangles with repeated or collinear corners."""
    area = triangle_area(*[F.col(c) for c in ("u1", "v1", "u2", "v2", "u3", "v3")])
    return triangles.where(F.abs(area) > eps)


def with_vertices(triangles: DataFrame, samples: DataFrame) -> DataFrame:
    """Corner positions and values looked up by sample number: one join for all three corners."""
    corner = F.explode(F.array(*[F.struct(F.lit(i).alias("pos"), F.col(f"point{i}").alias("index")) for i in (1, 2, 3)]))
    long = triangles.select(*KEYS, "tri_index", corner.alias("_c")).select(*KEYS, "tri_index", "_c.*")
    found = long.join(samples.select(*KEYS, "index", "lat", "lon", "value"), [*KEYS, "index"])
    pick = lambda i, c: F.max(F.when(F.col("pos") == i, F.col(c))).alias(f"{c if c != 'index' else 'point'}{i}")
    return found.groupBy(*KEYS, "tri_index").agg(*[pick(i, c) for i in (1, 2, 3) for c in ("index", "lat", "lon", "value")])


def _first_triangle(cells: DataFrame, key: str) -> DataFrame:
    """Of the triangles that hold one target, the one with the smallest corner numbers."""
    rest = [c for c in cells.columns if c not in (*KEYS, key)]
    picked = cells.groupBy(*KEYS, key).agg(F.min_by(F.struct(*rest), F.sort_array(F.array("point1", "point2", "point3"))).alias("_t"))
    return picked.select(*KEYS, key, "_t.*")


def _near_side(px: Column, py: Column) -> Column:
    """Whether a position inside or on a triangle lies so near a side that another triangle may hold it too."""
    near = F.lit(False)
    for i, j in ((1, 2), (2, 3), (3, 1)):
        du, dv = F.col(f"u{j}") - F.col(f"u{i}"), F.col(f"v{j}") - F.col(f"v{i}")
        turn = du * (py - F.col(f"v{i}")) - dv * (px - F.col(f"u{i}"))
        near = near | (F.abs(turn) <= 8 * TIE * F.sqrt(du * du + dv * dv))
    return near


def _strip(x: Column, width: float) -> tuple[Column, Column]:
    """Lowest and highest v of the part of the triangle with u from x to x + width (a line for width 0)."""
    u, v = [F.col(f"u{i}") for i in (1, 2, 3)], [F.col(f"v{i}") for i in (1, 2, 3)]
    found = [F.when((u[i] >= x) & (u[i] <= x + width), v[i]) for i in range(3)] if width else []
    for border in (x, x + width)[: 2 if width else 1]:
        for i, j in ((0, 1), (1, 2), (2, 0)):
            within = (border >= F.least(u[i], u[j]) - TIE) & (border <= F.greatest(u[i], u[j]) + TIE)
            sloped = F.when(u[i] != u[j], v[i] + (border - u[i]) * (v[j] - v[i]) / F.when(u[i] != u[j], u[j] - u[i]))
            found += [F.when(within, F.coalesce(sloped, f(v[i], v[j]))) for f in (F.least, F.greatest)]
    return F.least(*found), F.greatest(*found)


def boxes_in_triangles(triangles: DataFrame, grid: Grid, keep_all: bool = False) -> DataFrame:
    """Boxes whose centre lies in a triangle (edges included), with the triangle's columns.

    Each triangle is cut into grid rows and each row gives its range of boxes, so only boxes really inside are produced and
    nothing is joined. The rows of a large triangle are dealt to all tasks first. A centre on a shared edge belongs to the triangle
    with the smallest corner numbers, unless keep_all; only centres near an edge are shuffled for that.
    """
    u = [F.col(f"u{i}") for i in (1, 2, 3)]
    v = [F.col(f"v{i}") for i in (1, 2, 3)]
    first = F.greatest(F.ceil(F.least(*u) - 0.5 - TIE), F.lit(0))
    last = F.least(F.floor(F.greatest(*u) - 0.5 + TIE), F.lit(grid.x_num - 1))
    wide = (F.greatest(*u) - F.least(*u)) * (F.greatest(*v) - F.least(*v)) > LARGE

    def rows_of(some: DataFrame) -> DataFrame:
        return some.where(first <= last).withColumn("box_x", F.explode(F.sequence(first.cast("long"), last.cast("long"))))

    def cells_of(rows: DataFrame) -> DataFrame:
        least, most = _strip(F.col("box_x") + 0.5, 0)
        low = F.greatest(F.ceil(least - 0.5 - TIE), F.lit(0)).cast("long")
        high = F.least(F.floor(most - 0.5 + TIE), F.lit(grid.y_num - 1)).cast("long")
        rows = rows.withColumns({"_lo": low, "_hi": high}).where(F.col("_lo") <= F.col("_hi"))
        return (rows.withColumn("box_y", F.explode(F.sequence("_lo", "_hi"))).drop("_lo", "_hi")
                .withColumn("box_index", grid.index_of(F.col("box_x"), F.col("box_y"))))

    large = rows_of(triangles.where(wide)).repartition(*KEYS, "tri_index", "box_x")
    cells = cells_of(rows_of(triangles.where(~wide))).unionByName(cells_of(large))
    if keep_all:
        return cells
    near = _near_side(F.col("box_x") + 0.5, F.col("box_y") + 0.5)
    shared = _first_triangle(cells.where(near), "box_index")
    return cells.where(~near).unionByName(shared.select(cells.columns))


def points_in_triangles(points: DataFrame, triangles: DataFrame) -> DataFrame:
    """Free positions (keys, box_index, pu, pv in box units) inside a triangle (edges included), with the triangle's columns.

    Triangles are cut into cells as wide as the root of their area, at most MAX_CUTS of their strips a side, so a triangle has a few cells
    whatever its size; points meet the triangles of their cell, one level per size class in use. A point on a shared edge
    belongs to the triangle with the smallest corner numbers.
    """
    area = F.abs(triangle_area(*[F.col(c) for c in ("u1", "v1", "u2", "v2", "u3", "v3")]))
    u, v = [F.col(f"u{i}") for i in (1, 2, 3)], [F.col(f"v{i}") for i in (1, 2, 3)]
    extent = F.greatest(F.greatest(*u) - F.least(*u), F.greatest(*v) - F.least(*v))
    size = F.greatest(F.sqrt(area), extent / MAX_CUTS, F.lit(2.0 ** -40))
    sized = triangles.withColumn("_level", F.ceil(F.log2(size)).cast("int"))
    levels = [r[0] for r in sized.select("_level").distinct().collect()]
    cells = None
    for level in levels:
        side = 2.0 ** level
        at = lambda x: F.floor(x / side).cast("long")  # noqa: B023
        strips = sized.where(F.col("_level") == level).withColumn("_cx", F.explode(F.sequence(at(F.least(*u) - TIE), at(F.greatest(*u) + TIE))))
        low, high = _strip(F.col("_cx") * side - TIE, side + 2 * TIE)
        part = strips.withColumns({"_lo": at(low - TIE), "_hi": at(high + TIE)}).withColumn("_cy", F.explode(F.sequence("_lo", "_hi"))).drop("_lo", "_hi")
        cells = part if cells is None else cells.unionByName(part)
    if cells is None:
        return points.join(sized, KEYS).drop("_level").limit(0)
    places = F.array(*[F.struct(F.lit(lv).alias("_level"), F.floor(F.col("pu") / 2.0 ** lv).cast("long").alias("_cx"),
                                F.floor(F.col("pv") / 2.0 ** lv).cast("long").alias("_cy")) for lv in levels])
    placed = points.select(*KEYS, "box_index", "pu", "pv", F.explode(places).alias("_p")).select(*KEYS, "box_index", "pu", "pv", "_p.*")
    inside = F.lit(True)
    turned = F.signum(triangle_area(*[F.col(c) for c in ("u1", "v1", "u2", "v2", "u3", "v3")]))
    for i, j in ((1, 2), (2, 3), (3, 1)):
        du, dv = F.col(f"u{j}") - F.col(f"u{i}"), F.col(f"v{j}") - F.col(f"v{i}")
        turn = (du * (F.col("pv") - F.col(f"v{i}")) - dv * (F.col("pu") - F.col(f"u{i}"))) * turned
        inside = inside & (turn >= -TIE * F.sqrt(du * du + dv * dv))
    met = placed.join(cells, [*KEYS, "_level", "_cx", "_cy"]).where(inside).drop("_level", "_cx", "_cy")
    return _first_triangle(met, "box_index")


def target_position(located: DataFrame) -> DataFrame:
    """With pu, pv: a target's position in box units, the centre for a box."""
    if {"pu", "pv"} <= set(located.columns):
        return located
    return located.withColumns({"pu": F.col("box_x") + 0.5, "pv": F.col("box_y") + 0.5})


def locate(triangles: DataFrame, grid: Grid, targets: DataFrame | None = None) -> DataFrame:
    """Targets inside the hull with their triangle: boxes, free positions (pu, pv), or every box of the grid."""
    if targets is not None and {"pu", "pv"} <= set(targets.columns):
        return points_in_triangles(targets, triangles)
    located = boxes_in_triangles(triangles, grid)
    return located if targets is None else located.join(targets.select(*KEYS, "box_index"), [*KEYS, "box_index"], "left_semi")


def _bary(px: Column, py: Column) -> list[Column]:
    u = [F.col(f"u{i}") for i in (1, 2, 3)]
    v = [F.col(f"v{i}") for i in (1, 2, 3)]
    whole = triangle_area(u[0], v[0], u[1], v[1], u[2], v[2])
    return [triangle_area(px, py, u[1], v[1], u[2], v[2]) / whole,
            triangle_area(u[0], v[0], px, py, u[2], v[2]) / whole,
            triangle_area(u[0], v[0], u[1], v[1], px, py) / whole]


def linear_triangulation(located: DataFrame, weights: str = "barycentric") -> DataFrame:
    """Value of each located box. 'barycentric' is the plane through the corners; 'edge_mean' weighs
    mean corner values with sub-areas the way the warehouse job does."""
    located = target_position(located)
    w = _bary(F.col("pu"), F.col("pv"))
    val = [F.col(f"value{i}") for i in (1, 2, 3)]
    if weights == "barycentric":
        value = w[0] * val[0] + w[1] * val[1] + w[2] * val[2]
    elif weights == "edge_mean":
        opposite1, opposite2, opposite3 = (F.abs(x) for x in w)
        value = 0.5 * (opposite3 * (val[0] + val[1]) + opposite2 * (val[0] + val[1]) + opposite1 * (val[1] + val[2]))
    else:
        raise ValueError("weights must be 'barycentric' or 'edge_mean'")
    return located.select(*KEYS, "box_index", value.alias("value"))
