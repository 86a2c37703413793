"""Whitening of embeddings on their principal components, found by contour integration (FEAST).

Vectors are whole numbers (quantised before), so sums and products are exact: each batch multiplies its rows in limbs that
doubles hold exactly, Spark adds the limbs' sums as decimals, and the covariance n * sum(x x') - S S' over n * n is rounded once.
That is the centred covariance, without cancellation. It is over the distinct vectors. Only its d x d entries come to the driver.

Eigenvalues are counted by the signs of an LDL' factorisation (inertia). Bisection by these counts isolates the largest ones in
intervals away from all others; in each, a quadrature of solves with complex shifts projects onto the eigenvectors of the interval, and
Rayleigh-Ritz takes them out. An interval that gives another number than its inertia is an error. Clusters of equal eigenvalues
stay in one interval; any basis of theirs is right.

Defined results: rows whose vector is null or holds null or non-finite entries are left out. Shorter vectors are filled with zeros. Repeated
rows and null ids get rows of their own, repeated vectors count once in the covariance. Components without variance (below d * 1e-13
of the largest) are left out, so equal vectors, a single one or an empty table give no rows. The sign of a component makes its entry of
largest size positive (the first such). A deviation beyond 64 bits is null. Columns other than the two named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfill.session import materialize

#: Bits of a limb, rows whose products of limbs are added at once: their sums stay below 2**53.
LIMB, ROWS = 20, 4096
#: Points on the half circle, rounds, relative size of what counts as zero.
POINTS, ROUNDS, ZERO = 12, 20, 1e-13


def quantised(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, x): entries as floor(scale * c) of the rows whose vectors are whole and finite."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    rows = vectors.filter(F.col(vector).isNotNull()).filter(finite)
    return rows.select(F.col(key).alias("vec_id"), F.transform(vector, lambda c: F.floor(scale * c.cast("double")).cast("long")).alias("x"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of whole numbers, filled with zeros."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    lengths = np.diff(offsets)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _limbs(x: np.ndarray) -> list[np.ndarray]:
    """x = sum of limb k * 2 ** (k * LIMB), each below 2 ** LIMB in size."""
    out, rest = [], x
    while rest.any() or not out:
        carry = (rest + (1 << (LIMB - 1))) >> LIMB if np.abs(rest).max(initial=0) < 1 << 62 else rest >> LIMB
        out.append((rest - (carry << LIMB)).astype(float))
        rest = carry
    return out


def moments(fit: DataFrame, width: int) -> tuple[int, list[int], list[list[int]]]:
    """n, sums and sums of products of the vectors in column x, exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            x = _matrix(batch.column(0), width)
            x = np.concatenate([np.ones((len(x), 1), np.int64), x], axis=1)  # products with the ones are n and the sums
            for at in range(0, len(x), ROWS):
                limbs = _limbs(x[at : at + ROWS])
                for i, a in enumerate(limbs):
                    for j, b in enumerate(limbs):
                        total[i + j] = total.get(i + j, 0) + (a.T @ b).astype(np.int64)
        rows, cols = np.triu_indices(width + 1)
        for power, product in total.items():
            cells = pa.array(rows * (width + 1) + cols, pa.int64())
            yield pa.RecordBatch.from_arrays([cells, pa.array([power] * len(cells), pa.int32()), pa.array(product[rows, cols], pa.int64())], ["cell", "power", "part"])

    parts = fit.select("x").mapInArrow(run, "cell bigint, power int, part bigint")
    product = [[0] * (width + 1) for _ in range(width + 1)]
    for r in parts.groupBy("cell", "power").agg(F.sum(F.col("part").cast("decimal(20,0)")).alias("total")).toLocalIterator():
        i, j = divmod(r["cell"], width + 1)
        product[i][j] += int(r["total"]) << (LIMB * r["power"])
        product[j][i] = product[i][j]
    return product[0][0], product[0][1:], [row[1:] for row in product[1:]]


def covariance(n: int, sums: list[int], products: list[list[int]]) -> np.ndarray:
    return np.array([[(n * products[i][j] - sums[i] * sums[j]) / (n * n) for j in range(len(sums))] for i in range(len(sums))]).reshape(len(sums), len(sums))


def above(v: np.ndarray, shift: float) -> int:
    """Number of eigenvalues above `shift`: positive pivots of LDL' with pivots of one or two rows, the largest first."""
    a = v - shift * np.eye(len(v))
    positive = 0
    while len(a):
        size = np.abs(a)
        diagonal = size.diagonal()
        i, j = divmod(int(size.argmax()), len(a))
        k = int(diagonal.argmax())
        if diagonal[k] >= 0.64 * size[i, j]:
            if not diagonal[k]:
                return positive
            pivots = [k]
        else:
            pivots = [i, j]
        rest = np.setdiff1d(np.arange(len(a)), pivots)
        block, side = a[np.ix_(pivots, pivots)], a[np.ix_(rest, pivots)]
        if len(pivots) == 1:
            positive += int(block[0, 0] > 0)
        else:  # the determinant is negative: one eigenvalue of each sign
            positive += 1
        a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(block, side.T)
        a = (a + a.T) / 2
    return positive


def intervals(v: np.ndarray, most: int) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues inside) of disjoint intervals that hold the `most` largest eigenvalues above zero, apart from all others
    by an interval's width where bisection can tell them apart."""
    top = float(np.abs(v).sum(1).max(initial=0)) * (1 + 1e-9)
    least = len(v) * ZERO * top
    if not top > 0:
        return []
    known: dict[float, int] = {top: 0}

    def over(x: float) -> int:
        if x >= top:
            return 0
        if x not in known:
            known[x] = above(v, x)
        return known[x]

    out, waiting = [], [(least, top)]
    while waiting and sum(n for *_, n in out) < most:
        low, high = waiting.pop()
        n, width = over(low) - over(high), high - low
        if not n:
            continue
        alone = over(max(least, low - width)) - over(high + width) == n and width <= 0.5 * high
        if alone or width <= 4e-16 * top * len(v):
            out.append((low, high, n))
        else:
            waiting += [(low, (low + high) / 2), ((low + high) / 2, high)]
    return out


def _in_interval(v: np.ndarray, low: float, high: float, n: int, rng: np.random.Generator) -> np.ndarray:
    """Orthonormal vectors that span the n eigenvectors with eigenvalues in the interval."""
    d = len(v)
    width = high - low
    centre, radius = (low + high) / 2, 0.75 * width + 1e-15 * high
    x, weight = np.polynomial.legendre.leggauss(POINTS)
    turn = np.exp(1j * np.pi / 2 * (1 - x))
    y = rng.standard_normal((d, min(d, 2 * n + 2)))
    best, found = np.inf, None
    for _ in range(ROUNDS):
        if y.shape[1] < d:
            q = sum(w / 2 * (radius * t * np.linalg.solve((centre + radius * t) * np.eye(d) - v, y.astype(complex))).real for t, w in zip(turn, weight, strict=True))
        else:
            q = y
        q, _ = np.linalg.qr(q)
        value, ritz = np.linalg.eigh(q.T @ v @ q)
        vectors = q @ ritz
        near = np.argsort(np.abs(value - centre), kind="stable")[:n]
        error = np.abs(v @ vectors[:, near] - vectors[:, near] * value[near]).max()
        if error < best * 0.5:
            best, found = error, (value, vectors, near)
        else:
            break
        y = vectors
    value, vectors, near = found
    slack = 0.25 * width + 1e-12 * high
    if ((value > low - slack) & (value < high + slack) & (np.abs(v @ vectors - vectors * value).max(0) < 1e-6 * high)).sum() < n:
        raise ArithmeticError(f"an interval of {n} eigenvalues gave fewer")
    return vectors[:, near]


def components(v: np.ndarray, most: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors in columns) of the `most` largest eigenvalues above zero, falling."""
    rng = np.random.default_rng(0)
    spans = [_in_interval(v, *span, rng) for span in intervals(v, most)]
    if not spans:
        return np.empty(0), np.empty((len(v), 0))
    q, _ = np.linalg.qr(np.concatenate(spans, axis=1))
    value, ritz = np.linalg.eigh(q.T @ v @ q)
    value, vectors = value[::-1][:most], (q @ ritz)[:, ::-1][:, :most]
    vectors = vectors / np.linalg.norm(vectors, axis=0)
    largest = np.abs(vectors).round(9).argmax(0)
    return value, vectors * np.where(vectors[largest, np.arange(len(value))] < 0, -1, 1)


@dataclass(frozen=True)
class Whitening:
    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums: 64-bit numbers where all fit, else Python's."""
        most = max(int(np.abs(x).max(initial=0)), abs(int(x.min(initial=0)))) * self.n + max(map(abs, self.sums), default=0)
        if most < 1 << 62:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def whitened(self, deviation: np.ndarray) -> np.ndarray:
        return deviation.astype(float) / self.n @ self.vectors / np.sqrt(self.values)

    def squares(self, deviation: np.ndarray) -> list[int | None]:
        most = int(np.abs(deviation).max(initial=0))
        if most * most * max(1, deviation.shape[1]) < 1 << 63:
            return (deviation.astype(np.int64) ** 2).sum(1).tolist()
        wide = (deviation.astype(object) ** 2).sum(1)
        return [int(s) if s < 1 << 63 else None for s in wide]


def fit(vectors: DataFrame, most: int = 4) -> tuple[Whitening, float]:
    """The whitening of the distinct vectors in column x, and its largest error: of the covariance of their whitened forms against the identity."""
    distinct = materialize(vectors.select("x").distinct())
    width = distinct.agg(F.max(F.size("x"))).first()[0] or 0
    n, sums, products = moments(distinct, width)
    if not n:
        return Whitening(0, (), np.empty(0), np.empty((width, 0)), np.empty(0)), 0.0
    v = covariance(n, sums, products)
    values, axes = components(v, most)
    w = Whitening(n, tuple(sums), values, axes, values / np.trace(v) if len(values) else values)
    k = len(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            z = w.whitened(w.deviations(_matrix(batch.column(0), width)))
            z = np.concatenate([np.ones((len(z), 1)), z], axis=1)
            total += z.T @ z
        cells = np.arange(total.size)
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(total.ravel())], ["cell", "part"])

    sums_of = distinct.mapInArrow(run, "cell bigint, part double").groupBy("cell").agg(F.sum("part").alias("total"))
    found = np.zeros((k + 1) ** 2)
    for r in sums_of.collect():
        found[r["cell"]] = r["total"] / n
    found = found.reshape(k + 1, k + 1)
    error = np.abs(found[1:, 1:] - np.outer(found[0, 1:], found[0, 1:]) - np.eye(k)).max(initial=0)
    return w, float(error)


def whiten(vectors: DataFrame, most: int = 4) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for the rows of `quantised`."""
    w, error = fit(vectors, most)
    kind = dict(vectors.dtypes)["vec_id"]
    sent = vectors.sparkSession.sparkContext.broadcast(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        k, width = len(known.values), len(known.sums)
        for batch in batches:
            rows = len(batch)
            if not rows or not k:
                continue
            deviation = known.deviations(_matrix(batch.column(1), width))
            each = pa.array(np.repeat(np.arange(rows), k))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()), pa.array([known.n] * (rows * k), pa.int64()),
                pa.array(known.squares(deviation), pa.int64()).take(each), pa.array(known.whitened(deviation).ravel()),
                pa.array(np.tile(known.explained, rows)), pa.array([error] * (rows * k), pa.float64())],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    schema = f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    return vectors.select("vec_id", "x").mapInArrow(run, schema)
