"""Whitening of embeddings by shifted CholeskyQR.

The distinct integer vectors (floor of 256 times each component) are written once; n of them have
the sums S. Their centred rows C = x - S / n are a tall matrix that is never brought together. A
pass sums the Gram matrix of the rows as orthogonalised so far in the tasks, and its cells in
Spark; the driver factors it, and the next pass takes the rows through one more triangular solve.
The first Gram matrix is shifted, so that its Cholesky factor exists whatever the condition of C;
so is a later one that does not factor. Passes end when the rows are orthonormal, or after
``MOST_PASSES`` (dependent dimensions). With R the product of the factors and G the last Gram matrix,
C'C = R'GR, and the singular values s and right vectors of G^(1/2) R give eigenvalues s**2 / n and
components, without squaring the condition.

Sums S and deviations are exact (integers). Only matrices of dimension times dimension, and a
number for each of them, reach the driver; vectors do not.

Edge cases: rows whose vector is null, empty, or holds a null or non-finite component are left
out, as are those of another length than the most frequent one. Rows with equal or null ids are
rows of their own. Components without variance (to about 13 digits of the largest) cannot be
whitened and are left out; if there are none at all, as for a table with one distinct vector or
none, the result is empty. Extra columns are ignored.
"""

from __future__ import annotations

import math
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.llm.common import Scratch
from threadlake.llm.vectors import EXACT_LONG, largest, matrix, scaled, usual_size

MOST_PASSES = 6
ORTHONORMAL = 1e-11
DECIMAL = pa.decimal128(38, 0)
EMPTY = "component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"


def _sums(size: int):
    """Per task: the exact sum of each dimension, and the number of rows as dimension -1."""
    def emit(batches):
        total, n = np.zeros(size, object), 0
        for batch in batches:
            x = matrix(batch.column("x"), size)
            exact = x if largest(x) * len(x) < EXACT_LONG else x.astype(object)
            total, n = total + exact.sum(axis=0).astype(object), n + len(x)
        values = [Decimal(int(s)) for s in [n, *total.tolist()]]
        yield pa.record_batch([pa.array(range(-1, size), pa.int32()), pa.array(values, DECIMAL)], ["at", "s"])
    return emit


class Centre:
    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums, self.most = n, sums, max(map(abs, sums), default=0)

    def exact(self, x: np.ndarray) -> np.ndarray:
        """n x - S."""
        if self.n * largest(x) + self.most < EXACT_LONG:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def rows(self, x: np.ndarray) -> np.ndarray:
        return self.exact(x).astype(np.float64) / self.n


def solved(rows: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Y with Y R = rows, for an upper triangular R."""
    y = np.empty_like(rows)
    for j in range(rows.shape[1]):
        y[:, j] = (rows[:, j] - y[:, :j] @ r[:j, j]) / r[j, j]
    return y


def _gram(size: int, centre: Centre, through, width: int):
    """Per task: the upper cells of the Gram matrix of ``through(centred rows)``."""
    upper = np.triu_indices(width)

    def emit(batches):
        total = np.zeros((width, width))
        for batch in batches:
            x = matrix(batch.column("x"), size)
            for at in range(0, len(x), 4096):
                y = through(centre.rows(x[at:at + 4096]))
                total += y.T @ y
        yield pa.record_batch([pa.array(upper[0] * width + upper[1], pa.int64()), pa.array(total[upper])], ["cell", "s"])
    return emit


def gram(fit: DataFrame, size: int, centre: Centre, through, width: int) -> np.ndarray:
    cells = fit.mapInArrow(_gram(size, centre, through, width), "cell bigint, s double").groupBy("cell").agg(F.sum("s").alias("s")).collect()
    out = np.zeros(width * width)
    out[[r["cell"] for r in cells]] = [r["s"] for r in cells]
    out = out.reshape(width, width)
    return np.triu(out) + np.triu(out, 1).T


def factor(g: np.ndarray, n: int, shifted: bool) -> np.ndarray:
    """Upper Cholesky factor of G, shifted if asked for or needed."""
    d = len(g)
    shift = 11 * (n * d + d * (d + 1)) * np.finfo(float).eps / 2 * max(np.linalg.norm(g, 2), np.finfo(float).tiny)
    shift = min(shift, 0.1 * np.linalg.norm(g, 2)) or 1.0
    at = shift if shifted else 0.0
    while True:
        try:
            return np.linalg.cholesky(g + at * np.eye(d)).T
        except np.linalg.LinAlgError:
            at = max(shift, 10 * at)


def components(fit: DataFrame, size: int, centre: Centre) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of the covariance, falling, and unit eigenvectors as rows."""
    factors: list[np.ndarray] = []

    def through(rows: np.ndarray) -> np.ndarray:
        for r in factors:
            rows = solved(rows, r)
        return rows

    for done in range(MOST_PASSES + 1):
        g = gram(fit, size, centre, through, size)
        if done == MOST_PASSES or np.abs(g - np.eye(size)).max() < ORTHONORMAL:
            break
        factors.append(factor(g, centre.n, shifted=not done))
    values, turn = np.linalg.eigh(g)
    r = np.sqrt(np.maximum(values, 0))[:, None] * turn.T
    for f in reversed(factors):
        r = r @ f
    _, s, axes = np.linalg.svd(r)
    signs = np.sign(axes[np.arange(size), np.abs(axes).argmax(axis=1)])
    return s**2 / centre.n, axes * signs[:, None]


def _whiten(size: int, centre: Centre, weights: np.ndarray):
    def emit(batches):
        for batch in batches:
            x = matrix(batch.column("x"), size)
            for at in range(0, len(x), 4096):
                exact = centre.exact(x[at:at + 4096])
                if exact.dtype == object or largest(exact) ** 2 * size >= EXACT_LONG:
                    exact = exact.astype(object)
                off = [Decimal(int(v)) if v < 10**38 else None for v in (exact**2).sum(axis=1).tolist()]
                z = exact.astype(np.float64) / centre.n @ weights
                white = pa.ListArray.from_arrays(pa.array(np.arange(0, z.size + 1, max(1, z.shape[1]), dtype=np.int32)), pa.array(z.ravel()))
                yield pa.record_batch([batch.column("id").slice(at, len(z)), pa.array(off, DECIMAL), white], ["id", "deviation", "white"])
    return emit


def whitened(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, most: int = 4) -> DataFrame:
    """(id, component, n, deviation decimal(38,0), whitened, explained, identity_error) for each row
    that takes part and each of the first ``most`` components. ``deviation`` is null beyond 38
    digits."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "whitening")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), scaled(F.col(vector_col), scale).alias("x")).where("x is not null")
    rows = scratch.write(rows, "rows")
    size = usual_size(rows, "x")
    if size is None:
        return spark.createDataFrame([], f"id bigint, {EMPTY}").withColumnRenamed("id", id_col)
    rows = rows.where(F.size("x") == size)
    fit = scratch.write(rows.select("x").distinct(), "fit")
    found = fit.mapInArrow(_sums(size), "at int, s decimal(38,0)").groupBy("at").agg(F.sum("s").alias("s")).orderBy("at").collect()
    centre = Centre(int(found[0]["s"]), [int(r["s"]) for r in found[1:]])
    values, axes = components(fit, size, centre)
    trace = float(values.sum())
    kept = int((np.sqrt(values[:most]) > math.sqrt(values[0]) * 16 * size * np.finfo(float).eps).sum()) if values[0] > 0 else 0
    if not kept:
        return spark.createDataFrame([], f"id bigint, {EMPTY}").withColumnRenamed("id", id_col)
    weights = axes[:kept].T / np.sqrt(values[:kept])
    # A column of ones beside the whitened rows gives their sums in the same pass.
    g = gram(fit, size, centre, lambda c: np.column_stack([c @ weights, np.ones(len(c))]), kept + 1) / centre.n
    error = float(np.abs(g[:kept, :kept] - np.outer(g[:kept, kept], g[:kept, kept]) - np.eye(kept)).max())
    out = rows.mapInArrow(_whiten(size, centre, weights), "id bigint, deviation decimal(38,0), white array<double>")
    out = out.select("id", "deviation", F.posexplode("white").alias("at", "whitened"))
    share = F.element_at(F.array(*(F.lit(float(v / trace)) for v in values[:kept])), F.col("at") + 1)
    return out.select(F.col("id").alias(id_col), (F.col("at") + 1).alias("component"), F.lit(centre.n).cast("bigint").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error"))
