"""Interpolators that solve a small dense system per box: kriging, local polynomials, local RBF.

The neighbour arrays reach Python as Arrow list columns. Each batch is one numpy call on a stack of
systems; there is no Python work per box.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RBF_FUNCTIONS = ("multiquadric", "gaussian", "linear")


def to_matrix(lists: pa.Array) -> np.ndarray:
    """Arrow list column whose lists all have one length -> matrix; NULL lists are left out."""
    rows = len(lists) - lists.null_count
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def solve_per_box(df: DataFrame, k: int, fit: Callable[..., np.ndarray], params: Column | None = None,
                  few: Column | None = None) -> DataFrame:
    """`value` = fit(lat, lon, val, at_lat, at_lon, params) for boxes with k neighbours, all stacked by row.

    Boxes with fewer get `few` (NULL by default) and take no part in the batch.
    """

    @F.arrow_udf("double")
    def solve(lat: pa.Array, lon: pa.Array, val: pa.Array, at_lat: pa.Array, at_lon: pa.Array, par: pa.Array) -> pa.Array:
        full = lat.is_valid()
        out = np.full(len(lat), np.nan)
        if lat.null_count < len(lat):
            out[full.to_numpy(zero_copy_only=False)] = fit(
                to_matrix(lat), to_matrix(lon), to_matrix(val), at_lat.filter(full).to_numpy(zero_copy_only=False),
                at_lon.filter(full).to_numpy(zero_copy_only=False), to_matrix(par.filter(full)))
        return pa.array(out, from_pandas=True)

    near = F.slice("neighbors", 1, k)
    columns = [F.when(F.size("neighbors") >= k, near[f]) for f in ("lat", "lon", "value")]
    solved = solve(*columns, F.col("box_lat"), F.col("box_lon"), params if params is not None else F.array(F.lit(0.0)))
    if few is not None:
        solved = F.when(F.size("neighbors") >= k, solved).otherwise(few)
    return df.withColumn("value", solved)


def solve_each(matrix: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """Stacked solve; NaN for singular systems."""
    try:
        return np.linalg.solve(matrix, rhs[..., None])[..., 0]
    except np.linalg.LinAlgError:
        out = np.full(rhs.shape, np.nan)
        for i in range(len(matrix)):
            try:
                out[i] = np.linalg.solve(matrix[i], rhs[i])
            except np.linalg.LinAlgError:
                pass
        return out


# ---------------------------------------------------------------- local polynomials

def polynomial_terms(x: np.ndarray, y: np.ndarray, degree: int) -> np.ndarray:
    """All monomials of degree 1 .. degree; the constant is handled by centring."""
    return np.stack([x ** (d - j) * y ** j for d in range(1, degree + 1) for j in range(d + 1)], axis=-1)


def fit_polynomials(lat, lon, val, at_lat, at_lon, degree: int) -> np.ndarray:
    n_terms = (degree + 1) * (degree + 2) // 2 - 1
    if lat.shape[1] > n_terms:
        # Enough points: moving and scaling the origin leaves the fit as it is and keeps it well conditioned.
        scale = np.maximum(np.abs(lat - at_lat[:, None]).max(1), np.abs(lon - at_lon[:, None]).max(1))
        scale = np.where(scale > 0, scale, 1.0)[:, None]
        x, y = (lat - at_lat[:, None]) / scale, (lon - at_lon[:, None]) / scale
        x0 = y0 = np.zeros(len(lat))
    else:
        x, y, x0, y0 = lat, lon, at_lat, at_lon
    terms, target = polynomial_terms(x, y, degree), polynomial_terms(x0, y0, degree)
    mean_terms, mean_val = terms.mean(1, keepdims=True), val.mean(1)
    beta = np.linalg.pinv(terms - mean_terms, rcond=1e-12) @ (val - mean_val[:, None])[..., None]
    return mean_val + np.einsum("bt,bt->b", target - mean_terms[:, 0], beta[..., 0])


def local_polynomial(df: DataFrame, k: int = 16, degree: int = 2) -> DataFrame:
    """Least-squares polynomial on the first k neighbours; NULL with fewer."""

    def fit(lat, lon, val, at_lat, at_lon, _):
        return fit_polynomials(lat, lon, val, at_lat, at_lon, degree)

    return solve_per_box(df, k, fit)


# ---------------------------------------------------------------- kriging

def semivariance(model: str, h, p):
    """Model value at distance h; p[..., i] are the parameters. linear: slope, nugget; power: scale,
    exponent, nugget; the others: partial sill, range, nugget."""
    if model == "linear":
        return p[..., 0] * h + p[..., 1]
    if model == "power":
        return p[..., 0] * h ** p[..., 1] + p[..., 2]
    psill, reach, nugget = p[..., 0], p[..., 1], p[..., 2]
    if model == "gaussian":
        return psill * (1 - np.exp(-(h ** 2) / (reach * 4 / 7) ** 2)) + nugget
    if model == "exponential":
        return psill * (1 - np.exp(-h / (reach / 3))) + nugget
    if model == "spherical":
        s = h / reach
        return np.where(h <= reach, psill * (1.5 * s - 0.5 * s ** 3), psill) + nugget
    if model == "hole-effect":
        return psill * (1 - (1 - h / (reach / 3)) * np.exp(-h / (reach / 3))) + nugget
    raise ValueError(f"unknown variogram model {model!r}")


VARIOGRAM_MODELS = ("linear", "power", "gaussian", "spherical", "exponential", "hole-effect")
PARAMETER_COUNT = {m: 2 if m == "linear" else 3 for m in VARIOGRAM_MODELS}


def kriging_weights(lat, lon, at_lat, at_lon, model: str, params: np.ndarray) -> np.ndarray:
    """Ordinary kriging weights of shape (rows, k); NaN for singular systems."""
    rows, k = lat.shape
    between = np.hypot(lat[:, :, None] - lat[:, None, :], lon[:, :, None] - lon[:, None, :])
    to_box = np.hypot(lat - at_lat[:, None], lon - at_lon[:, None])
    system = np.ones((rows, k + 1, k + 1))
    system[:, :k, :k] = np.where(between > 0, semivariance(model, between, params[:, None, None, :]), 0.0)
    system[:, k, k] = 0.0
    rhs = np.ones((rows, k + 1))
    rhs[:, :k] = np.where(to_box > 0, semivariance(model, to_box, params[:, None, :]), 0.0)
    return solve_each(system, rhs)[:, :k]


def ordinary_kriging(df: DataFrame, k: int = 5, model: str = "linear", params: Column | None = None) -> DataFrame:
    """Ordinary kriging on the first k neighbours with given variogram parameters (array column,
    `variogram` by default). NULL with fewer than k or without parameters; a singular system gives the neighbours' mean."""
    if model not in VARIOGRAM_MODELS:
        raise ValueError(f"unknown variogram model {model!r}")
    width = PARAMETER_COUNT[model]

    def fit(lat, lon, val, at_lat, at_lon, par):
        w = kriging_weights(lat, lon, at_lat, at_lon, model, par)
        out = np.einsum("bk,bk->b", w, val)
        return np.where(np.isfinite(out), out, np.where(np.isfinite(par).all(1), val.mean(1), np.nan))

    params = params if params is not None else F.col("variogram")
    usable = F.when(F.size(params) == width, params).otherwise(F.array(*[F.lit(float("nan"))] * width))
    return solve_per_box(df, k, fit, usable)


# ---------------------------------------------------------------- radial basis functions on k neighbours

def radial(function: str, r: np.ndarray, epsilon) -> np.ndarray:
    if function == "multiquadric":
        return np.sqrt((r / epsilon) ** 2 + 1)
    if function == "gaussian":
        return np.exp(-((r / epsilon) ** 2))
    if function == "linear":
        return r
    raise ValueError(f"unknown radial function {function!r}")


def shape_parameter(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Average spacing: (product of the non-zero extents / n) ** (1 / number of them), last axis = points."""
    spans = np.stack([np.ptp(lat, axis=-1), np.ptp(lon, axis=-1)], axis=-1)
    used = (spans > 0).sum(-1)
    product = np.where(spans > 0, spans, 1.0).prod(-1)
    return np.where(used > 0, (product / lat.shape[-1]) ** (1.0 / np.maximum(used, 1)), 1.0)


def rbf_predict(lat, lon, val, at_lat, at_lon, function: str) -> np.ndarray:
    """One dense fit: lat, lon, val of shape (n,), evaluated at the given points."""
    eps = shape_parameter(lat, lon)
    system = radial(function, np.hypot(lat[:, None] - lat[None, :], lon[:, None] - lon[None, :]), eps)
    try:
        weights = np.linalg.solve(system, val)
    except np.linalg.LinAlgError:
        weights = np.linalg.lstsq(system, val, rcond=None)[0]
    return radial(function, np.hypot(at_lat[:, None] - lat[None, :], at_lon[:, None] - lon[None, :]), eps) @ weights


def local_rbf(df: DataFrame, k: int, function: str) -> DataFrame:
    """RBF fit on the first k neighbours of each box, or on all of them where there are fewer.

    Rows are filled up with neighbours at no position: in the system each of those stands for itself and has weight 0.
    """

    def fit(lat, lon, val, at_lat, at_lon, _):
        there = np.isfinite(lat)
        first = lat[:, :1], lon[:, :1]
        lat, lon, val = np.where(there, lat, first[0]), np.where(there, lon, first[1]), np.where(there, val, 0.0)
        spans = np.stack([np.ptp(lat, axis=-1), np.ptp(lon, axis=-1)], axis=-1)
        used = (spans > 0).sum(-1)
        eps = np.where(used > 0, (np.where(spans > 0, spans, 1.0).prod(-1) / there.sum(1)) ** (1.0 / np.maximum(used, 1)), 1.0)[:, None]
        system = radial(function, np.hypot(lat[:, :, None] - lat[:, None, :], lon[:, :, None] - lon[:, None, :]), eps[..., None])
        both = there[:, :, None] & there[:, None, :]
        system = np.where(both, system, np.eye(lat.shape[1]))
        w = solve_each(system, val)
        phi = radial(function, np.hypot(lat - at_lat[:, None], lon - at_lon[:, None]), eps)
        out = np.einsum("bk,bk->b", w, np.where(there, phi, 0.0))
        alone = there.sum(1) == 1  # one sample says the same everywhere, whatever the function is at distance 0
        return np.where(np.isfinite(out) & ~alone, out, val.sum(1) / there.sum(1))

    nowhere = F.array(F.struct(*[F.lit(float("nan")).alias(c) for c in ("lat", "lon", "value")]))
    given = F.transform("neighbors", lambda n: F.struct(n["lat"].alias("lat"), n["lon"].alias("lon"), n["value"].alias("value")))
    filled = F.concat(given, F.flatten(F.array_repeat(nowhere, k)))
    padded = df.withColumn("_near", F.col("neighbors")).withColumn("neighbors", F.when(F.size("neighbors") > 0, F.slice(filled, 1, k)).otherwise(given))
    return solve_per_box(padded, k, fit).withColumn("neighbors", F.col("_near")).drop("_near")
