"""Empirical variograms of all features and the fit of a model to them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfill.operators.grid import Grid
from gridfill.operators.neighbors import cell_offsets
from gridfill.operators.solvers import PARAMETER_COUNT, VARIOGRAM_MODELS, semivariance
from gridfill.session import materialize

KEYS = ["datasetName", "name"]
BLOCK = 1024            # rows of one side handled at a time inside a tile
NODES = 7               # Chebyshev nodes of a cell on each axis
CELL_POINTS, BLOCK_POINTS = 4096, 50_000  # points of one cell, of one block of cells
BLOCKS, MOST_POINTS = 16, 1_000_000  # blocks hold more points before there are more blocks, up to this many points
COLUMNS = 1 << 21       # complex numbers of one quantity in a group of grid columns


def empirical_variogram(means: DataFrame, grid: Grid, max_lag: float, n_lags: int = 6) -> DataFrame:
    """Per feature and lag bin: mean distance, mean half squared difference and number of pairs.

    Pairs up to `max_lag` degrees. No pair ever becomes a row: samples are copied to the tiles (max_lag
    wide) they can pair with, each tile adds up its own pairs, and only one row per tile and bin is shuffled.
    A tile holds at most one box mean per box, so its size is bounded by the tile's width in boxes.
    """
    wide_x = max(1, int(np.ceil(max_lag / grid.lat_gap)))
    wide_y = max(1, int(np.ceil(max_lag / grid.lon_gap)))
    gaps, step = (grid.lat_gap, grid.lon_gap), max_lag / n_lags

    def add_up(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["own"]]
        x, y = pdf["box_x"].to_numpy(float), pdf["box_y"].to_numpy(float)
        ids, v = pdf["index"].to_numpy(), pdf["value"].to_numpy()
        count, dist, gamma = np.zeros(n_lags, np.int64), np.zeros(n_lags), np.zeros(n_lags)
        for start in range(0, len(own), BLOCK):
            part = own.iloc[start:start + BLOCK]
            dx = (part["box_x"].to_numpy(float)[:, None] - x) * gaps[0]
            dy = (part["box_y"].to_numpy(float)[:, None] - y) * gaps[1]
            d = np.sqrt(dx * dx + dy * dy)
            pair = (part["index"].to_numpy()[:, None] < ids) & (d <= max_lag)
            lag = np.minimum((d[pair] / step).astype(np.int64), n_lags - 1)
            half = 0.5 * ((part["value"].to_numpy()[:, None] - v) ** 2)[pair]
            count += np.bincount(lag, minlength=n_lags)
            dist += np.bincount(lag, weights=d[pair], minlength=n_lags)
            gamma += np.bincount(lag, weights=half, minlength=n_lags)
        used = np.flatnonzero(count)
        return pd.DataFrame({"datasetName": str(pdf["datasetName"].iloc[0]), "name": str(pdf["name"].iloc[0]),
                             "lag": used.astype(np.int64), "s_dist": dist[used], "s_gamma": gamma[used], "n": count[used]})

    tx, ty = F.floor(F.col("box_x") / wide_x), F.floor(F.col("box_y") / wide_y)
    spread = means.where(F.col("value").isNotNull()).withColumn("_o", cell_offsets(1, 1)).select(
        *KEYS, (tx + F.col("_o.dx")).alias("tx"), (ty + F.col("_o.dy")).alias("ty"),
        ((F.col("_o.dx") == 0) & (F.col("_o.dy") == 0)).alias("own"), "index", "box_x", "box_y", "value")
    tiles = spread.groupBy(*KEYS, "tx", "ty").applyInPandas(
        add_up, "datasetName string, name string, lag long, s_dist double, s_gamma double, n long")
    return tiles.groupBy(*KEYS, "lag").agg(F.sum("n").alias("n"), F.sum("s_dist").alias("_d"), F.sum("s_gamma").alias("_g")).select(
        *KEYS, "lag", (F.col("_d") / F.col("n")).alias("dist"), (F.col("_g") / F.col("n")).alias("gamma"), "n")


def extent(grid: Grid) -> float:
    """No two box centres of the grid are further apart, in degrees."""
    return float(np.hypot(grid.x_num * grid.lat_gap, grid.y_num * grid.lon_gap))


def full_variogram(means: DataFrame, grid: Grid, n_lags: int = 6) -> DataFrame:
    """The same over all pairs of a feature, in time that grows with the boxes and not with the pairs.

    Pairs of one offset are added up at once: with the mask m, values v and squares w of the boxes, the sum of squared
    differences over an offset is the correlation of m with w, of w with m, less twice that of v with itself. A
    correlation over the grid is a Fourier transform along grid rows and one along columns, each row, block of columns and
    offset row being a group of its own, bounded by the grid's width or height.
    """
    width, height = 2 * grid.y_num, 2 * grid.x_num
    block = max(1, min(64, COLUMNS // height))
    step = extent(grid) / n_lags
    known = means.where(F.col("value").isNotNull())
    mean = materialize(known.groupBy(*KEYS).agg(F.avg("value").alias("_mean")))  # a row per feature: written, so that its size is known
    centred = known.join(mean, KEYS).select(
        *KEYS, "box_x", "box_y", (F.col("value") - F.col("_mean")).alias("v"))  # near zero, so squares lose no digits
    blocks = range(0, width // 2 + 1, block)

    def named(pdf: pd.DataFrame, **columns) -> pd.DataFrame:
        return pd.DataFrame({"datasetName": str(pdf["datasetName"].iloc[0]), "name": str(pdf["name"].iloc[0]), **columns})

    def rows(pdf: pd.DataFrame) -> pd.DataFrame:
        line = np.zeros((3, width))
        at, v = pdf["box_y"].to_numpy(), pdf["v"].to_numpy()
        line[:, at] = np.ones(len(v)), v, v * v
        wave = np.fft.rfft(line)
        return named(pdf, part=list(blocks), at=int(pdf["box_x"].iloc[0]), data=[np.ascontiguousarray(wave[:, b:b + block]).tobytes() for b in blocks])

    def columns(pdf: pd.DataFrame) -> pd.DataFrame:
        lines = [np.frombuffer(d, complex).reshape(3, -1) for d in pdf["data"]]
        plane = np.zeros((3, height, lines[0].shape[1]), complex)
        plane[:, pdf["at"].to_numpy()] = np.stack(lines, axis=1)
        m, v, w = np.fft.fft(plane, axis=1)
        n, s = np.abs(m) ** 2, 2 * (m.conj() * w).real - 2 * np.abs(v) ** 2
        both = np.fft.ifft(np.stack([n, s]), axis=1)[:, :grid.x_num]
        return named(pdf, part=int(pdf["part"].iloc[0]), at=list(range(grid.x_num)), data=[np.ascontiguousarray(both[:, x]).tobytes() for x in range(grid.x_num)])

    def offsets(pdf: pd.DataFrame) -> pd.DataFrame:
        dx = int(pdf["at"].iloc[0])
        ordered = pdf.sort_values("part")["data"]
        n, s = np.fft.irfft(np.concatenate([np.frombuffer(d, complex).reshape(2, -1) for d in ordered], axis=1), width)
        dy = np.arange(width)
        dy = np.where(dy >= grid.y_num, dy - width, dy)
        n = np.rint(n).astype(np.int64)
        used = (n > 0) & ((dx > 0) | (dy > 0))
        n, half = n[used], 0.5 * s[used]
        d = np.hypot(dx * grid.lat_gap, dy[used] * grid.lon_gap)
        lag = np.minimum((d / step).astype(np.int64), n_lags - 1)
        count, dist, gamma = (np.bincount(lag, weights=x, minlength=n_lags) for x in (n, d * n, half))
        there = np.flatnonzero(count)
        return named(pdf, lag=there.astype(np.int64), s_dist=dist[there], s_gamma=gamma[there], n=np.rint(count[there]).astype(np.int64))

    wave = "datasetName string, name string, part int, at int, data binary"
    spread = centred.groupBy(*KEYS, "box_x").applyInPandas(rows, wave)
    turned = spread.groupBy(*KEYS, "part").applyInPandas(columns, wave)
    sums = turned.groupBy(*KEYS, "at").applyInPandas(offsets, "datasetName string, name string, lag long, s_dist double, s_gamma double, n long")
    return sums.groupBy(*KEYS, "lag").agg(F.sum("n").alias("n"), F.sum("s_dist").alias("_d"), F.sum("s_gamma").alias("_g")).select(
        *KEYS, "lag", (F.col("_d") / F.col("n")).alias("dist"), (F.col("_g") / F.col("n")).alias("gamma"), "n")


class _Cells:
    """Points in cells, with what pairs of cells need: bounds of the points, moments of the values, and weights of Chebyshev nodes that
    stand for the points in sums of smooth functions. A point is all `k` samples of one position, with their mean value and the sum of
    squares of what they differ from it by."""

    def __init__(self, cell: np.ndarray, x: np.ndarray, y: np.ndarray, v: np.ndarray, k: np.ndarray, inner: np.ndarray):
        order = np.argsort(cell, kind="stable")
        self.x, self.y, self.v, self.k, self.inner = x[order], y[order], v[order], k[order].astype(float), inner[order]
        self.cell, self.start, points = np.unique(cell[order], return_index=True, return_counts=True)
        self.end = self.start + points
        self.n = np.add.reduceat(self.k, self.start)
        lows, highs = ([f.reduceat(a, self.start) for a in (self.x, self.y)] for f in (np.minimum, np.maximum))
        self.low, self.high = np.stack(lows, 1), np.stack(highs, 1)
        self.s, self.ss = (np.add.reduceat(a, self.start) for a in (self.k * self.v, self.k * self.v * self.v + self.inner))
        node = np.cos(np.pi * (np.arange(NODES) + 0.5) / NODES)
        middle, half = (self.low + self.high) / 2, np.maximum((self.high - self.low) / 2, 1e-300)
        self.weight = np.empty((NODES * NODES, len(points)))
        first = 0
        while first < len(points):  # some cells at a time: a point takes a number for each node
            last = max(first + 1, int(np.searchsorted(self.end, self.start[first] + CELL_POINTS, "right")))
            where, these = np.repeat(np.arange(first, last), points[first:last]), slice(self.start[first], self.end[last - 1])
            terms = []
            for axis, a in enumerate((self.x, self.y)):
                t = np.clip((a[these] - middle[where, axis]) / half[where, axis], -1, 1)
                cosines = np.cos(np.arange(NODES)[:, None] * np.arccos(t))
                basis = np.cos(np.arange(NODES)[None] * np.arccos(node)[:, None]) * np.where(np.arange(NODES) == 0, 1, 2) / NODES
                terms.append(basis @ cosines)  # nodes x points: how much of a point each node takes
            both = terms[0][:, None] * (terms[1] * self.k[these])[None]
            self.weight[:, first:last] = np.add.reduceat(both.reshape(NODES * NODES, -1), self.start[first:last] - self.start[first], axis=1)
            first = last
        grid = [middle[:, axis] + node[:, None] * half[:, axis] for axis in (0, 1)]
        self.node_x = np.repeat(grid[0], NODES, axis=0)
        self.node_y = np.tile(grid[1], (NODES, 1))


def _add_pairs(a: _Cells, b: _Cells, same: bool, step: float, n_lags: int, apart: float) -> np.ndarray:
    """(count, sum of distances, sum of half squared differences) per lag, over all pairs of a point of `a` and one of `b`."""
    out = np.zeros((3, n_lags))
    lag = lambda d: np.minimum((d / step).astype(np.int64), n_lags - 1)
    if same:  # samples of one position
        out[0, 0], out[2, 0] = (a.k * (a.k - 1) / 2).sum(), 0.5 * (a.k * a.inner).sum()
    for i in range(len(a.n)):
        j = np.arange(i if same else 0, len(b.n))
        gap = np.maximum(np.maximum(b.low[j] - a.high[i], a.low[i] - b.high[j]), 0)
        reach = np.maximum(b.high[j] - a.low[i], a.high[i] - b.low[j])
        near, far = np.hypot(*gap.T), np.hypot(*reach.T)
        whole = (near >= apart) & (lag(near * (1 - 1e-12)) == lag(far * (1 + 1e-12)))
        k = j[whole]
        if len(k):
            d = np.hypot(a.node_x[:, i][:, None, None] - b.node_x[:, k], a.node_y[:, i][:, None, None] - b.node_y[:, k])
            dist = np.einsum("p,pqk,qk->k", a.weight[:, i], d, b.weight[:, k])
            half = 0.5 * (a.ss[i] * b.n[k] + a.n[i] * b.ss[k]) - a.s[i] * b.s[k]
            for row, w in enumerate((a.n[i] * b.n[k], dist, half)):
                out[row] += np.bincount(lag(near[whole]), w, n_lags)
        mine = slice(a.start[i], a.end[i])
        for k in j[~whole]:
            for at in range(b.start[k], b.end[k], BLOCK):
                other = slice(at, min(at + BLOCK, b.end[k]))
                d = np.hypot(a.x[mine][:, None] - b.x[other], a.y[mine][:, None] - b.y[other])
                n = a.k[mine][:, None] * b.k[other]
                half = 0.5 * (n * (a.v[mine][:, None] - b.v[other]) ** 2 + a.inner[mine][:, None] * b.k[other] + a.k[mine][:, None] * b.inner[other])
                use = np.ones(d.shape, bool)
                if same and k == i:
                    use = np.arange(a.start[i], a.end[i])[:, None] < np.arange(other.start, other.stop)
                lags = lag(d[use])
                for row, w in enumerate((n[use], (n * d)[use], half[use])):
                    out[row] += np.bincount(lags, w, n_lags)
    return out


def scattered_variogram(samples: DataFrame, n_lags: int = 6) -> DataFrame:
    """The same over all pairs of a feature's samples at free positions (lat, lon); lags are parts of the diagonal of its bounds.

    The samples of one position are one point with their number, mean and sum of squares, so that cost follows the number of positions.
    Pairs of cells that lie inside one lag are added up by moments (differences exactly, distances through Chebyshev nodes, to about 1e-6);
    only cells that are close or span a border between lags compare their points. Cells are dealt to blocks, and each pair of blocks is a
    group of bounded size: a cell with many points is split into several of the same place. Blocks grow before there are more of them, as
    each point goes to a group per block.
    """
    known = samples.where(F.col("value").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    bounds = materialize(known.groupBy(*KEYS).agg(
        F.avg("value").alias("_mean"), F.min("lat").alias("_lat"), F.min("lon").alias("_lon"),
        (F.max("lat") - F.min("lat")).alias("_h"), (F.max("lon") - F.min("lon")).alias("_w")))  # a row per feature
    centred = known.join(bounds.select(*KEYS, "_mean"), KEYS).select(*KEYS, "lat", "lon", (F.col("value") - F.col("_mean")).alias("v"))
    stacks = materialize(centred.groupBy(*KEYS, "lat", "lon").agg(
        F.avg("v").alias("v"), F.count("v").alias("k"), (F.var_pop("v") * F.count("v")).alias("inner")))
    bounds = bounds.join(stacks.groupBy(*KEYS).agg(F.count("*").alias("_n")), KEYS)
    cells = F.greatest(F.lit(4), F.least(F.lit(64), F.round(F.sqrt("_n") / 8))).cast("double")
    side = F.greatest(F.greatest("_h", "_w") / cells, F.lit(1e-300))
    blocks = F.greatest(F.lit(4), F.least(F.lit(BLOCKS), F.ceil(F.col("_n") / BLOCK_POINTS)), F.ceil(F.col("_n") / MOST_POINTS))
    bounds = materialize(bounds.withColumns({"_side": side, "_step": F.greatest(F.sqrt(F.col("_h") * F.col("_h") + F.col("_w") * F.col("_w")) / n_lags, F.lit(1e-300)),
                                             "_blocks": blocks.cast("int")}))  # a row per feature
    placed = stacks.join(bounds, KEYS).withColumns({"_cx": F.floor((F.col("lat") - F.col("_lat")) / F.col("_side")), "_cy": F.floor((F.col("lon") - F.col("_lon")) / F.col("_side"))})
    full = materialize(placed.groupBy(*KEYS, "_cx", "_cy").agg(F.count("*").alias("_there")))
    parts = F.pmod(F.xxhash64("lat", "lon"), F.ceil(F.col("_there") / CELL_POINTS)).alias("_part")
    points = placed.join(full, [*KEYS, "_cx", "_cy"]).select(
        *KEYS, "lat", "lon", "v", "k", "inner", "_side", "_step", "_blocks", F.xxhash64("_cx", "_cy", parts).alias("cell"))
    points = points.withColumn("mine", F.pmod(F.col("cell"), F.col("_blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    dealt = points.select(*KEYS, F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "cell", "lat", "lon", "v", "k", "inner", "_side", "_step")

    def add_up(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        made = [_Cells(*(part[c].to_numpy() for c in ("cell", "lat", "lon", "v", "k", "inner"))) for part in (pdf[pdf["mine"] == b] for b in (i, j)) if len(part)]
        if len(made) < 2:
            return pd.DataFrame({"datasetName": pd.Series(dtype=object), "name": pd.Series(dtype=object), "lag": pd.Series(dtype="int64"), "n": pd.Series(dtype="int64"),
                                 "s_dist": pd.Series(dtype=float), "s_gamma": pd.Series(dtype=float)})
        sums = _add_pairs(*made, i == j, float(pdf["_step"].iloc[0]), n_lags, 2 * float(pdf["_side"].iloc[0]))
        used = np.flatnonzero(sums[0])
        return pd.DataFrame({"datasetName": str(pdf["datasetName"].iloc[0]), "name": str(pdf["name"].iloc[0]), "lag": used.astype(np.int64),
                             "n": np.rint(sums[0, used]).astype(np.int64), "s_dist": sums[1, used], "s_gamma": sums[2, used]})

    found = dealt.groupBy(*KEYS, "i", "j").applyInPandas(add_up, "datasetName string, name string, lag long, n long, s_dist double, s_gamma double")
    return found.groupBy(*KEYS, "lag").agg(F.sum("n").alias("n"), F.sum("s_dist").alias("_d"), F.sum("s_gamma").alias("_g")).select(
        *KEYS, "lag", (F.col("_d") / F.col("n")).alias("dist"), (F.col("_g") / F.col("n")).alias("gamma"), "n")


def _start(model: str, h: np.ndarray, g: np.ndarray) -> np.ndarray:
    if model == "linear":
        return np.array([(g.max() - g.min()) / max(h.max() - h.min(), 1e-12), g.min()])
    if model == "power":
        return np.array([(g.max() - g.min()) / max(h.max() - h.min(), 1e-12), 1.1, g.min()])
    return np.array([max(g.max() - g.min(), 1e-12), 0.5 * h.max(), g.min()])


def fit_model(model: str, h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Least-squares parameters, all non-negative, by damped Gauss-Newton steps on a few lag bins."""
    if model == "linear":
        slope, nugget = np.polyfit(h, g, 1) if len(h) > 1 else (0.0, g[0])
        if slope < 0:
            slope, nugget = 0.0, g.mean()
        elif nugget < 0:
            slope, nugget = (h @ g) / (h @ h), 0.0
        return np.array([slope, nugget])
    unit = max(g.max(), 1e-300)
    upper = np.array([np.inf, 1.999, np.inf]) if model == "power" else np.array([np.inf, 10 * h.max(), np.inf])
    lower = np.array([0.0, 1e-3 if model == "power" else 1e-6 * h.max(), 0.0])
    scale = np.array([unit, 1.0 if model == "power" else h.max(), unit])
    p = np.clip(_start(model, h, g), lower, upper) / scale
    residual = lambda q: (semivariance(model, h, q * scale) - g) / unit
    damping, r = 1e-3, residual(p)
    for _ in range(200):
        step = 1e-6 * np.maximum(np.abs(p), 1e-3)
        jac = np.stack([(residual(p + step[i] * np.eye(3)[i]) - r) / step[i] for i in range(3)], axis=1)
        move = np.linalg.lstsq(jac.T @ jac + damping * np.eye(3), -jac.T @ r, rcond=None)[0]
        trial = np.clip((p + move) * scale, lower, upper) / scale
        r_trial = residual(trial)
        if r_trial @ r_trial < r @ r:
            done = np.abs(trial - p).max() < 1e-12
            p, r, damping = trial, r_trial, max(damping / 3, 1e-12)
            if done:
                break
        else:
            damping *= 4
            if damping > 1e12:
                break
    return p * scale


def fit_variogram(empirical: DataFrame, model: str = "linear") -> DataFrame:
    """One row per feature: model and its parameters as an array (see solvers.semivariance).

    The input has at most n_lags rows per feature, so each group is tiny.
    """
    if model not in VARIOGRAM_MODELS:
        raise ValueError(f"unknown variogram model {model!r}")
    if model == "linear":   # closed form, no Python
        slope = F.coalesce(F.try_divide(F.covar_pop("dist", "gamma"), F.var_pop("dist")), F.lit(0.0))
        stats = empirical.groupBy(*KEYS).agg(
            slope.alias("s"), F.avg("dist").alias("h"), F.avg("gamma").alias("g"),
            (F.sum(F.col("dist") * F.col("gamma")) / F.sum(F.col("dist") * F.col("dist"))).alias("through"))
        nugget = F.col("g") - F.col("s") * F.col("h")
        params = (F.when(F.col("s") < 0, F.array(F.lit(0.0), F.col("g")))
                  .when(nugget < 0, F.array(F.col("through"), F.lit(0.0))).otherwise(F.array(F.col("s"), nugget)))
        return stats.select(*KEYS, F.lit(model).alias("variogram_model"), params.alias("variogram"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        p = fit_model(model, pdf["dist"].to_numpy(), pdf["gamma"].to_numpy())
        return pd.DataFrame({"datasetName": [str(pdf["datasetName"].iloc[0])], "name": [str(pdf["name"].iloc[0])],
                             "variogram_model": model, "variogram": [p.tolist()]})

    return empirical.groupBy(*KEYS).applyInPandas(
        fit, "datasetName string, name string, variogram_model string, variogram array<double>")


def given_variogram(means: DataFrame, model: str, params: list[float]) -> DataFrame:
    """The same parameters for every feature."""
    if len(params) != PARAMETER_COUNT[model]:
        raise ValueError(f"{model} takes {PARAMETER_COUNT[model]} parameters")
    return means.select(*KEYS).distinct().select(
        *KEYS, F.lit(model).alias("variogram_model"), F.array(*[F.lit(float(p)) for p in params]).alias("variogram"))
