"""Embedding whitening: principal components of the vectors' exact integer form, refined beyond float32.

Entries become longs (``floor(1024 c) + 100000``); counts and sums are exact.
Tasks multiply blocks of centred rows, one row of partial covariances leaves
each task, and sums by matrix row form the covariance, a d x d matrix.  Its
eigenvectors are computed in float32 and corrected by Ogita-Aishima steps: with
R = I - X'X and S = X'AX in extended precision, X moves by X E, where E holds
(S_ij + l_j R_ij) / (l_j - l_i) for apart eigenvalues and R_ij / 2 within a
cluster.  Steps converge quadratically.  A cluster (neighbours nearer than the
step's error bound) only becomes an exact invariant subspace that way; it is
then solved as a small problem of its own, shifted by its mean so that its
differences keep their digits, and the steps go on.

The rows are projected in double precision.  ``identity_error`` is measured on
the projected rows themselves: their covariance, centred by their own means.

Only the d x d matrix and 8 x 8 figures reach the driver; d is the vectors'
length, not a number of rows.  Vectors of different lengths are fitted apart.

Defined results: rows whose vector is null or holds null or non-finite entries
(or entries whose long form does not fit) are dropped, an empty vector has no
components; null ids and repeated rows are kept and count each; a component
without variance (one row, equal rows, fewer rows than dimensions) has
explained 0 and null whitened, and is left out of identity_error, which is null
if no component is left; a deviation beyond a long is null; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from paylens.llm.store import stored, table
from paylens.session import ship_package

COMPONENTS, SCALE, SHIFT = 8, 1024, 100000
_LARGEST = float(1 << 52)  # of |1024 c|: beyond, doubles and longs part
_ROWS = 4096


def _rows(column: pa.ListArray) -> np.ndarray:
    """Vectors of one length as an int64 matrix of their long form."""
    values = column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py():column.offsets[-1].as_py()]
    return np.floor(values.reshape(len(column), -1) * SCALE).astype(np.int64) + SHIFT


def _sums_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (id, vector) to (rows, sums) of the task."""
    n, sums = 0, None
    for batch in batches:
        if batch.num_rows:
            x = _rows(batch.column(1))
            n, sums = n + len(x), x.sum(0) + (0 if sums is None else sums)
    if n:
        yield pa.RecordBatch.from_pydict({"rows": [n], "sums": [sums]},
                                         schema=pa.schema([("rows", pa.int64()), ("sums", pa.list_(pa.int64()))]))


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - sums / n: the whole part of the mean goes off exactly, the rest in double precision."""
    whole, rest = np.divmod(sums, n)
    return (x - whole).astype(np.float64) - rest / n


def _products_task(n: int, sums: np.ndarray):
    """Batches (id, vector) to the task's sum of centred products, one row (i, products) per dimension."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for lo in range(0, batch.num_rows, _ROWS):
                y = _centred(_rows(batch.column(1).slice(lo, _ROWS)), n, sums)
                total = y.T @ y + (0 if total is None else total)
        if total is not None:
            d = len(total)
            offs = np.arange(d + 1, dtype=np.int32) * d
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(d, dtype=np.int32)), pa.ListArray.from_arrays(pa.array(offs), pa.array(total.ravel()))],
                names=["i", "products"])
    return task


def _matrix(parts: DataFrame, d: int) -> np.ndarray:
    """The d x d matrix that partial rows (i, products) add up to."""
    summed = parts.groupBy("i").agg(F.array(*[F.sum(F.col("products")[k]) for k in range(d)]).alias("products")) if d <= 128 else \
        parts.select("i", F.posexplode("products")).groupBy("i", "pos").agg(F.sum("col").alias("v")) \
        .groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias("products"))
    out = np.zeros((d, d))
    for row in summed.collect():
        out[row.i] = row.products
    return (out + out.T) / 2


def eigen(a: np.ndarray, steps: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix, to double precision.

    Starts from a float32 solution; see the module's docstring.  ``steps``
    bounds the corrections, which end when they no longer move the vectors.
    """
    d = len(a)
    size = np.abs(a).max() if d else 0.0
    if size == 0:
        return np.zeros(d), np.eye(d)
    wide = a.astype(np.longdouble) / size
    x = np.linalg.eigh((a / size).astype(np.float32))[1][:, ::-1].astype(np.longdouble)
    eps = np.finfo(np.float64).eps
    norm = np.linalg.norm(a / size, 2)
    for _ in range(steps):
        r = np.eye(d) - x.T @ x
        s = x.T @ wide @ x
        values = np.diag(s) / (1 - np.diag(r))
        order = np.argsort(-values, kind="stable")
        if (order != np.arange(d)).any():
            x, values, r, s = x[:, order], values[order], r[np.ix_(order, order)], s[np.ix_(order, order)]
        off = s - np.diag(values)
        bound = 2 * (np.linalg.norm(off.astype(np.float64), 2) + norm * np.linalg.norm(r.astype(np.float64), 2))
        bound = max(bound, d * eps * norm)
        gap = values[None, :] - values[:, None]
        apart = np.abs(gap) > bound
        e = np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, 1), r / 2)
        moved = np.abs(e).max()
        x = x + x @ e
        clusters = np.flatnonzero(np.diff(np.r_[False, np.abs(np.diff(values)) <= bound, False].astype(int)))
        for lo, hi in clusters.reshape(-1, 2):
            turn = _within(wide, x[:, lo:hi + 1])
            moved = max(moved, np.abs(np.abs(turn) - np.eye(len(turn))).max()) if bound > d * eps * norm else moved
            x[:, lo:hi + 1] = x[:, lo:hi + 1] @ turn
        if moved < eps / 4:
            break
    for _ in range(2):  # what rounding has left of R, for pairs that the matrix itself hardly tells apart
        x = x + x @ (np.eye(d) - x.T @ x) / 2
    values = (x * (wide @ x)).sum(0)
    order = np.argsort(-values, kind="stable")
    return (values[order] * size).astype(np.float64), x[:, order].astype(np.float64)


def _within(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Turns the basis ``x`` of a cluster's subspace into eigenvectors: the small problem, less its mean eigenvalue."""
    gram = x.T @ x
    x = x - x @ (gram - np.eye(len(gram))) / 2
    small = x.T @ a @ x
    small = small - np.eye(len(small)) * (np.trace(small) / len(small))
    small = (small + small.T) / 2
    largest = np.abs(small).max()
    if largest == 0:
        return np.eye(len(small), dtype=np.longdouble)
    turn = np.linalg.eigh((small / largest).astype(np.float64))[1][:, ::-1].astype(np.longdouble)
    return turn + turn @ (np.eye(len(turn)) - turn.T @ turn) / 2


def _project_task(n: int, sums: np.ndarray, axes: np.ndarray, scales: np.ndarray):
    """Batches (id, vector) to (id, deviation, projections): exact squared deviation, whitened values."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = axes.shape[1]
        for batch in batches:
            for lo in range(0, batch.num_rows, _ROWS):
                part = batch.slice(lo, _ROWS)
                x = _rows(part.column(1))
                w = _centred(x, n, sums) @ axes * scales
                offs = np.arange(len(x) + 1, dtype=np.int32) * k
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(_deviations(x, n, sums), pa.int64()),
                     pa.ListArray.from_arrays(pa.array(offs), pa.array(w.ravel()))], names=["vec_id", "deviation", "whitened"])
    return task


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exact; null beyond a long."""
    whole, rest = np.divmod(sums, n)
    rough = np.abs((x - whole).astype(np.float64)).max(initial=0) + 1
    if rough * n < 2**31 and (rough * n) ** 2 * x.shape[1] < 2**62:
        z = (x - whole) * n - rest
        return (z * z).sum(1).tolist()
    big = [sum((n * a - s) ** 2 for a, s in zip(row, sums.tolist())) for row in x.tolist()]
    return [v if v < 1 << 63 else None for v in big]


def _error(found: DataFrame, live: list[int]) -> float | None:
    """Largest entry of the projections' covariance (divisor n, centred by their means) minus the identity, of components ``live``."""
    if not live:
        return None
    w = [F.col("whitened")[k] for k in live]
    first = found.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{k}") for k, c in zip(live, w)]).first()
    y = {k: c - F.lit(first[f"m{k}"]) for k, c in zip(live, w)}
    pairs = [(i, j) for i in live for j in live if i <= j]
    sums = found.agg(*[F.sum(y[i] * y[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(sums[f"c{i}_{j}"] / first["n"] - (i == j)) for i, j in pairs)


def _whiten_length(fit: DataFrame, d: int, components: int) -> DataFrame:
    """Result rows of the vectors of one length."""
    sums = fit.mapInArrow(_sums_task, "rows long, sums array<long>").select("rows", F.posexplode("sums")) \
        .groupBy("pos").agg(F.sum("rows").alias("n"), F.sum("col").alias("s")).collect()
    n, total = sums[0].n, np.zeros(d, np.int64)
    for row in sums:
        total[row.pos] = row.s
    products = fit.mapInArrow(_products_task(n, total), "i int, products array<double>")
    cov = _matrix(products, d) / n
    values, axes = eigen(cov)
    trace, k = float(np.trace(cov)), min(components, d)
    live = [i for i in range(k) if values[i] > d * np.finfo(np.float64).eps * max(values[0], 0) and values[i] > 0]
    scales = np.array([1 / np.sqrt(values[i]) if i in live else 0.0 for i in range(k)])
    found = stored(fit.mapInArrow(_project_task(n, total, axes[:, :k], scales),
                                  "vec_id long, deviation long, whitened array<double>"), f"whitened-{d}")
    error = _error(found, live)
    shares = F.array(*[F.lit(float(values[i]) / trace if i in live else 0.0) for i in range(k)])
    held = F.array(*[F.lit(i in live) for i in range(k)])
    return found.select("vec_id", "deviation", F.posexplode("whitened").alias("_at", "_w")).select(
        "vec_id", (F.col("_at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        F.when(F.get(held, F.col("_at")), F.col("_w")).alias("whitened"), F.get(shares, F.col("_at")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"))


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every vector and leading component."""
    ship_package(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    fit = rows.filter(F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < _LARGEST / SCALE)))
    lengths = [r.d for r in fit.groupBy(F.size("vector").alias("d")).count().orderBy("d").collect() if r.d > 0]
    if not lengths:
        return vectors.sparkSession.createDataFrame(
            [], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return reduce(DataFrame.union, [_whiten_length(fit.filter(F.size("vector") == d), d, components) for d in lengths])


def op13(spark, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
