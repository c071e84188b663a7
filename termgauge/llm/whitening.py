"""Whitening of embeddings along the principal components of their distinct vectors.

Vectors are made integers first (``floor(scale * c) + offset``), so that distinct ones, their number and
their sums are exact. Spark computes what depends on the rows: the distinct vectors, written once; their
sums; their covariance, from rows that are centred on the exact mean before they are multiplied, as partial
matrices added up in two levels; the covariance of the whitened rows; and the projections, with the
components broadcast. The driver holds matrices of the dimension squared only (at most ``WIDEST``).

Components come from spectral divide and conquer. A polar decomposition of the covariance shifted by a value
within its spectrum (QDWH: dynamically weighted Halley steps, by QR where the weight is large and by Cholesky
else) gives the projector on the subspace of the eigenvalues above the shift. A basis of it and one of its
complement split the matrix in two blocks, which are split in turn until they are numbers, or equal to a
multiple of the identity within rounding.

Defined results: a vector that is NULL, holds NULL or a number that is not finite, or has another length than
most vectors have (ties: the longer one) is left out; repeated vectors count once in the fit and each get
their rows; an empty table gives no rows; repeated or NULL keys are kept as they are. Components without
variance have NULL for ``whitened``, and without any variance ``explained`` is NULL; a ``deviation`` of 2^63 or
more is NULL. Numbers beyond 2^62 count as 2^62. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termgauge.session import materialise

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
WIDEST = 4096
FAN = 64  # partial results that reach the driver
EPS = float(np.finfo(float).eps)


# ---------------------------------------------------------------- symmetric matrices


def polar_factor(a: np.ndarray, most_steps: int = 30) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix, which is its matrix sign (QDWH)."""
    n = len(a)
    x = a / np.linalg.norm(a)
    try:
        low = 1 / np.linalg.norm(np.linalg.inv(x))  # never above the least singular value
    except np.linalg.LinAlgError:
        low = EPS
    low = min(max(low, EPS), 1.0)
    eye = np.eye(n)
    for _ in range(most_steps):
        square = low * low
        d = np.cbrt(4 * (1 - square) / square**2)
        root = np.sqrt(1 + d)
        wa = root + np.sqrt(8 - 4 * d + 8 * (2 - square) / (square * root)) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        before = x
        if wc > 100:
            q = np.linalg.qr(np.vstack([np.sqrt(wc) * x, eye]))[0]
            x = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[:n] @ q[n:].T)
        else:
            lower = np.linalg.cholesky(eye + wc * (x.T @ x))
            half = np.linalg.solve(lower, x.T)
            x = wb / wc * x + (wa - wb / wc) * np.linalg.solve(lower.T, half).T
        low = min(low * (wa + wb * square) / (1 + wc * square), 1.0)
        if np.linalg.norm(x - before) < np.cbrt(4 * EPS) and 1 - low < 10 * EPS:
            break
    return (x + x.T) / 2


def _shifts(a: np.ndarray):
    """Values within the spectrum: the median and the mean of the diagonal, then places around the mean."""
    diagonal = np.diag(a)
    mean = diagonal.mean()
    spread = np.linalg.norm(a - mean * np.eye(len(a))) / np.sqrt(len(a))
    yield float(np.median(diagonal))
    yield mean
    for step in (0.13, -0.13, 0.31, -0.31, 0.57, -0.57, 0.03, -0.03):
        yield mean + step * spread


def _split(a: np.ndarray, scale: float):
    """Bases of the invariant subspaces above and below a shift; the best of several shifts."""
    n, rng, best = len(a), np.random.default_rng(n_seed(len(a))), None
    for shift in _shifts(a):
        projector = (polar_factor(a - shift * np.eye(n)) + np.eye(n)) / 2
        k = int(round(float(np.trace(projector))))
        if not 0 < k < n:
            continue
        basis = np.linalg.qr(projector @ rng.standard_normal((n, k)))[0]
        basis = np.linalg.qr(projector @ basis, mode="complete")[0]
        above, below = basis[:, :k], basis[:, k:]
        coupling = np.linalg.norm(below.T @ a @ above)
        if best is None or coupling < best[0]:
            best = coupling, above, below
        if coupling <= 10 * n * EPS * scale:
            break
    return best


def n_seed(n: int) -> int:
    return 7 + n


def eigen(a: np.ndarray, scale: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix."""
    n = len(a)
    scale = float(np.linalg.norm(a)) if scale is None else scale
    diagonal = np.diag(a)
    if n == 1 or np.linalg.norm(a - diagonal.mean() * np.eye(n)) <= EPS * n * scale:
        return diagonal.copy(), np.eye(n)
    found = _split(a, scale)
    if found is None:  # no shift separates what rounding blurs
        return diagonal.copy(), np.eye(n)
    values, vectors = [], []
    for basis in found[1:]:
        block = basis.T @ a @ basis
        own, turned = eigen((block + block.T) / 2, scale)
        values.append(own)
        vectors.append(basis @ turned)
    whole, basis = np.concatenate(values), np.hstack(vectors)
    order = np.argsort(-whole, kind="stable")
    return whole[order], basis[:, order]


# ---------------------------------------------------------------- sums over rows


def integers(vector: Column, scale: int = SCALE, offset: int = OFFSET) -> Column:
    """``floor(scale * c) + offset`` of every entry, as long."""
    most = float(1 << 62)
    own = lambda c: F.floor(F.least(F.greatest(c * F.lit(float(scale)), F.lit(-most)), F.lit(most)))
    return F.transform(vector.cast("array<double>"), lambda c: own(c) + F.lit(offset).cast("bigint"))


def usable(vectors: DataFrame, key: str, column: str, scale: int = SCALE, offset: int = OFFSET) -> tuple[DataFrame, int]:
    """key, x of the vectors that are whole, finite and of the usual length, and that length."""
    vector = F.col(f"`{column}`")
    good = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    rows = vectors.where(vector.isNotNull() & good).select(F.col(f"`{key}`").alias("vec_id"), vector.alias("vector"))
    sizes = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = sizes[0] if sizes else 0
    if d > WIDEST:
        raise ValueError(f"vectors of {d} numbers; the driver's matrices are for {WIDEST} at most")
    return rows.where(F.size("vector") == d).select("vec_id", integers(F.col("vector"), scale, offset).alias("x")), d


def matrix_of(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def summed(rows: DataFrame, width: int, kind: str, part: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum of ``part`` over all batches: ``width`` numbers of a kind. Tasks send one row each, and these are
    added in ``FAN`` tasks before the driver adds what is left."""

    def partial(batches):
        from pyspark import TaskContext

        total = np.zeros(width, kind)
        for batch in batches:
            total += part(batch)
        numbers = [pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary())]
        yield pa.RecordBatch.from_arrays(numbers, ["task", "sums"])

    def again(batches):
        total = np.zeros(width, kind)
        for batch in batches:
            for row in batch.column(1):
                total += np.frombuffer(row.as_buffer(), kind)
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["task", "sums"])

    schema = "task long, sums binary"
    found = rows.mapInArrow(partial, schema).repartition(FAN, "task").mapInArrow(again, schema).collect()
    return np.sum([np.frombuffer(r.sums, kind) for r in found], axis=0) if found else np.zeros(width, kind)


LOW_BITS = 30


def exact_sums(rows: DataFrame, d: int) -> tuple[int, list[int]]:
    """How many rows, and the exact sum of each place of ``x``."""

    def part(batch):
        x = matrix_of(batch.column(0), d)
        high, low = x >> LOW_BITS, x & ((1 << LOW_BITS) - 1)
        return np.concatenate([[len(x)], high.sum(axis=0), low.sum(axis=0)])

    total = summed(rows, 2 * d + 1, "<i8", part).tolist()
    return total[0], [(h << LOW_BITS) + v for h, v in zip(total[1 : d + 1], total[d + 1 :])]


# ---------------------------------------------------------------- fit and projection


class Whitening(NamedTuple):
    """n vectors with sums S, their covariance, components (columns) with eigenvalues e, and how far the
    covariance of what they whiten is from the identity."""

    n: int
    sums: list[int]
    covariance: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float | None

    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        """The mean as whole numbers and n-ths."""
        whole = [s // self.n for s in self.sums]
        return np.array(whole, np.int64), np.array([s - self.n * w for s, w in zip(self.sums, whole)], np.int64)

    def scaled(self) -> np.ndarray:
        """Components over the root of their eigenvalue; NaN where there is no variance."""
        floor = len(self.sums) * EPS * max(float(self.values.max(initial=0.0)), 0.0)
        with np.errstate(invalid="ignore", divide="ignore"):
            return self.components / np.sqrt(np.where(self.values > floor, self.values, np.nan))


def centred(x: np.ndarray, whole: np.ndarray, rest: np.ndarray, n: int) -> np.ndarray:
    """x - S/n, rounded once."""
    return (x - whole).astype(float) - rest / n


def fit(rows: DataFrame, d: int, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct vectors of ``usable`` rows; None without any."""
    if not d:
        return None
    distinct = materialise(rows.select("x").distinct(), "whitening-vectors")
    n, sums = exact_sums(distinct, d)
    if not n:
        return None
    whole, rest = Whitening(n, sums, *[None] * 5).centre()

    def gram(batch):
        y = centred(matrix_of(batch.column(0), d), whole, rest, n)
        return (y.T @ y).ravel()

    covariance = summed(distinct, d * d, "<f8", gram).reshape(d, d) / n
    covariance = (covariance + covariance.T) / 2
    values, vectors = eigen(covariance)
    k = min(components, d)
    own = Whitening(n, sums, covariance, vectors[:, :k], np.maximum(values[:k], 0.0), float(np.trace(covariance)), None)
    scaled = own.scaled()
    scaled = scaled[:, ~np.isnan(scaled[0])]
    if not scaled.shape[1]:
        return own
    m = scaled.shape[1]

    def whitened(batch):
        z = centred(matrix_of(batch.column(0), d), whole, rest, n) @ scaled
        return (z.T @ z).ravel()

    error = np.abs(summed(distinct, m * m, "<f8", whitened).reshape(m, m) / n - np.eye(m)).max()
    return own._replace(identity_error=float(error))


def deviations(x: np.ndarray, whole: np.ndarray, rest: np.ndarray, n: int) -> pa.Array:
    """Sum of (n x - S)^2 for each row, exact; NULL where it takes more than 63 bits."""
    with np.errstate(over="ignore"):
        apart = x - whole
        term = n * apart - rest
        exact = (term * term).sum(axis=1)
    about = ((float(n) * apart.astype(float) - rest) ** 2).sum(axis=1)
    fits = about < 2.0**63 * (1 - 1e-9)
    found: list[int | None] = [v if ok else None for v, ok in zip(exact.tolist(), fits.tolist())]
    for row in np.flatnonzero(~fits & (about < 2.0**63 * (1 + 1e-9))).tolist():
        value = sum((n * int(a) - int(r)) ** 2 for a, r in zip(apart[row], rest))
        found[row] = value if value < 1 << 63 else None
    return pa.array(found, pa.int64())


def whiten(rows: DataFrame, d: int, model: Whitening | None) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every ``usable`` row and component."""
    numbers = [("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType())]
    numbers += [(c, T.DoubleType()) for c in ("whitened", "explained", "identity_error")]
    schema = T.StructType([rows.schema["vec_id"], *[T.StructField(c, t) for c, t in numbers]])
    spark = rows.sparkSession
    if model is None:
        return spark.createDataFrame([], schema)
    whole, rest = model.centre()
    shares = model.values / model.trace if model.trace > 0 else np.full(len(model.values), np.nan)
    # d x components numbers, with d bounded by WIDEST.
    shared = spark.sparkContext.broadcast((model.n, whole, rest, model.scaled(), shares, model.identity_error))

    def run(batches):
        n, whole, rest, scaled, shares, error = shared.value
        k = scaled.shape[1]
        for whole_batch in batches:
            for lo in range(0, whole_batch.num_rows, 1000):
                batch = whole_batch.slice(lo, 1000)
                x = matrix_of(batch.column(1), d)
                rows_at = pa.array(np.repeat(np.arange(len(x)), k))
                z = centred(x, whole, rest, n) @ scaled
                columns = [
                    batch.column(0).take(rows_at),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(x) * k, n, np.int64)),
                    deviations(x, whole, rest, n).take(rows_at),
                    pa.array(z.ravel(), from_pandas=True),
                    pa.array(np.tile(shares, len(x)), from_pandas=True),
                    pa.array([error] * (len(x) * k), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.select("vec_id", "x").mapInArrow(run, schema)


def whiten_embeddings(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``whiten`` of all usable vectors by the whitening fitted to them."""
    rows, d = usable(vectors, key, column)
    return whiten(rows, d, fit(rows, d, components))
