"""Whitening of embeddings on their leading principal components, by Chebyshev-filtered subspace iteration.

A component is an eigenvector of the vectors' covariance V. V is never formed: a pass over all rows gives V @ Q for a block Q of
some 30 columns, as the sum of every task's part of centred X.T @ (X @ Q), summed by dimension in the JVM before it comes to the
driver (dimensions x columns numbers). Each round applies a Chebyshev polynomial of V to the block, one pass a degree. The
polynomial stays small from 0 to the block's smallest Ritz value, where the unwanted spectrum lies (V has no negative
eigenvalues), and grows fast above it. QR makes the block orthonormal again, and Rayleigh-Ritz turns it to the best
eigenvectors within. A component is done when its residual |V v - e v| certifies it to double precision.

Vectors come as integers x = floor(1024 * c) + 100000, so sums are exact; beyond 2^40 in size 1024 * c is held at 2^40. Rows
whose vector is null, empty or holds null or non-finite entries are left out, and so are vectors of another length than the
commonest (ties: the longest). Repeated rows count as often as they stand there; null ids stay null; other columns are ignored.
Components without variance are left out, so equal vectors, a single one or an empty table give no rows. A deviation beyond the
range of long is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadmill.llm._shared import staged
from leadmill.llm.vectors import block, finite, of_one_length

LIMIT = float(1 << 40)
#: Columns of the block beside the wanted ones, highest degree of the polynomial, most growth across the block, most rounds.
MORE_COLUMNS, DEGREE, MOST_GROWTH, MOST_ROUNDS = 24, 12, 1e10, 60
#: Residuals as a share of the largest eigenvalue: what ends the iteration, and what must hold when rounding ends it.
CERTIFIED, LEAST = 2e-15, 1e-11


@dataclass
class Centre:
    """n vectors with sums S by dimension: S = n * floor + rest, so x - S / n is (x - floor) - rest / n without cancellation."""

    n: int
    floor: np.ndarray
    rest: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.floor) - self.rest / self.n

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S)^2, exact."""
        away = x - self.floor
        most = self.n * (int(np.abs(away).max(initial=0)) + 1)
        if most * most * max(x.shape[1], 1) < 1 << 63:
            return ((self.n * away - self.rest) ** 2).sum(axis=1).tolist()
        exact = ((self.n * away.astype(object) - self.rest.astype(object)) ** 2).sum(axis=1)
        return [int(v) if v < 1 << 63 else None for v in exact]


@dataclass
class Whitening:
    """Unit components as columns, by falling eigenvalue, with the variance of all dimensions."""

    centre: Centre
    components: np.ndarray
    values: np.ndarray
    trace: float

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centre.centred(x) @ self.components / np.sqrt(self.values)


def scaled(df: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    """(key, x) of the usable rows as a staged table, and their dimensions."""
    entry = lambda c: F.floor(F.greatest(F.least(c.cast("double") * 1024, F.lit(LIMIT)), F.lit(-LIMIT))) + 100000
    own = df.select(F.col(key).alias("key"), F.col(vector).alias("vector")).where(finite(F.col("vector")))
    own, d = of_one_length(own, "vector")
    return staged(own.select("key", F.transform("vector", entry).cast("array<long>").alias("x")), "whitening"), d


def centre_of(x: DataFrame, d: int) -> Centre:
    """Exact sums: of each batch in its task, then as decimals."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array(block(b, "x", d).sum(axis=0)), pa.array([b.num_rows] * d)], ["i", "s", "n"])

    sums = x.select("x").mapInArrow(parts, "i long, s long, n long").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")), F.sum("n")).collect()
    sums.sort()
    if not sums:
        return Centre(0, np.zeros(d, np.int64), np.zeros(d, np.int64))
    n, totals = sums[0][2], [int(r[1]) for r in sums]
    return Centre(n, np.array([s // n for s in totals]), np.array([s % n for s in totals]))


def summed(x: DataFrame, d: int, part: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """The sum over all rows' blocks of a matrix of the given width; each task sends one of its own."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                own = part(block(b, "x", d))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["place", "v"])

    rows = x.select("x").mapInArrow(parts, "place long, v double").groupBy("place").agg(F.sum("v").alias("v")).toPandas()
    return rows.sort_values("place")["v"].to_numpy().reshape(-1, width)


def filtered(covariance: Callable[[np.ndarray], np.ndarray], q: np.ndarray, vq: np.ndarray, cut: float, top: float) -> np.ndarray:
    """A Chebyshev polynomial of covariance on [0, cut], applied to q and scaled to 1 at top; vq is the first pass's covariance(q).

    Its degree is at most DEGREE, and so low that it grows to no more than MOST_GROWTH at top: the block's other columns keep
    their digits beside the largest ones."""
    half = cut / 2
    if half <= 1e-14 * top:  # no more dimensions vary than the block has
        return vq / top
    degree = int(min(DEGREE, max(1, np.arccosh(MOST_GROWTH) // np.arccosh(max(top / half - 1, 1 + 1e-9)))))
    sigma = first = half / (top - half)
    before, now = q, (vq - half * q) * (sigma / half)
    for _ in range(degree - 1):
        after = 1 / (2 / first - sigma)
        before, now = now, (covariance(now) - half * now) * (2 * after / half) - (sigma * after) * before
        sigma = after
    return now


def leading(covariance: Callable[[np.ndarray], np.ndarray], d: int, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and eigenvectors as columns of the d x d matrix that covariance multiplies by a block.

    A component whose residual is at the level of rounding is locked: the block is kept orthogonal to it from then on, so that the
    polynomial grows by what is still sought. Those of relative size under 1e-12 are left out."""
    wanted = min(components, d)
    locked, sizes = np.zeros((d, 0)), np.zeros(0)

    def apart(block_: np.ndarray) -> np.ndarray:
        for _ in range(2):
            block_ = block_ - locked @ (locked.T @ block_)
        return block_

    q, last = np.random.default_rng(1).standard_normal((d, min(d, components + MORE_COLUMNS))), np.inf
    for _ in range(MOST_ROUNDS):
        q = np.linalg.qr(apart(q))[0]
        vq = apart(covariance(q))
        small = q.T @ vq
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        scale = float(max([*values[:1], *sizes[:1]])) or 1.0
        residual = np.linalg.norm(vq - q * values, axis=0) / scale
        most = float(residual[: wanted - len(sizes)].max())
        good = residual <= (LEAST if most <= LEAST and most > last / 2 or q.shape[1] + len(sizes) == d else CERTIFIED * np.sqrt(d))
        n = min(int(np.argmin(good)) if not good.all() else len(good), wanted - len(sizes))
        locked, sizes = np.hstack([locked, q[:, :n]]), np.concatenate([sizes, values[:n]])
        if len(sizes) == wanted or n < len(values) and values[n] <= 1e-12 * scale:
            order = np.argsort(-sizes, kind="stable")
            order = order[sizes[order] > 1e-12 * scale]
            return sizes[order], locked[:, order]
        q, vq, values, last = q[:, n:], vq[:, n:], values[n:], most if not n else np.inf
        q = filtered(lambda block_: apart(covariance(block_)), q, vq, max(float(values[-1]), 0.0), float(values[0]))
    raise ArithmeticError(f"no certified components after {MOST_ROUNDS} rounds: residual {most:.1e}")


def fit(x: DataFrame, d: int, components: int = 8) -> Whitening | None:
    """The leading components of x (a table with arrays of d whole numbers in the column x); None without variance."""
    centre = centre_of(x, d)
    if not centre.n or not d:
        return None

    def covariance(q: np.ndarray) -> np.ndarray:
        return summed(x, d, lambda block_: (y := centre.centred(block_)).T @ (y @ q), q.shape[1]) / centre.n

    trace = float(summed(x, d, lambda block_: (centre.centred(block_) ** 2).sum(axis=0)[:, None], 1).sum()) / centre.n
    if trace <= 0:
        return None
    values, vectors = leading(covariance, d, components)
    return Whitening(centre, vectors, values, trace)


def identity_error(x: DataFrame, d: int, model: Whitening) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity, by a pass over the rows."""
    k = len(model.values)

    def part(block_: np.ndarray) -> np.ndarray:
        w = model.whitened(block_)
        return np.vstack([w.T @ w, w.sum(axis=0)])

    sums = summed(x, d, part, k) / model.centre.n
    return float(np.abs(sums[:k] - np.outer(sums[k], sums[k]) - np.eye(k)).max())


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 8) -> DataFrame:
    """For each usable row and component: key, component (from 1), n, deviation, whitened, explained (the component's share of the
    variance), identity_error (one value, measured over all rows)."""
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    x, d = scaled(df, key, vector)
    model = fit(x, d, components) if d else None
    if model is None:
        return df.sparkSession.createDataFrame([], schema)
    k, error = len(model.values), identity_error(x, d, model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = block(b, "x", d)
            each = lambda values: np.tile(values, len(own))
            of_row = pa.array(np.repeat(np.arange(len(own)), k))
            deviation = pa.array(model.centre.deviation(own), pa.int64()).take(of_row)
            numbers = [pa.array(each(np.arange(1, k + 1, dtype=np.int32))), pa.array(each(np.full(k, model.centre.n))), deviation]
            numbers += [pa.array(v) for v in (model.whitened(own).ravel(), each(model.values / model.trace), each(np.full(k, error)))]
            yield pa.RecordBatch.from_arrays([b.column("key").take(of_row), *numbers], [key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return x.mapInArrow(rows, schema)
