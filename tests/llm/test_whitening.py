"""Whitening against plain Python and NumPy, and the eigenvector refinement on hard matrices."""

import math
import random

import numpy as np
import pytest

from paylens.llm.queries import QUERIES
from paylens.llm.whitening import eigen, whiten

COLUMNS = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def _orthogonal(rng, d):
    return np.linalg.qr(rng.standard_normal((d, d)))[0]


def _residual(a, values, x):
    """Largest error of A x = e x, and of X'X = I, in extended precision."""
    a, x = a.astype(np.longdouble), x.astype(np.longdouble)
    return float(np.abs(a @ x - x * values).max()), float(np.abs(x.T @ x - np.eye(len(a))).max())


@pytest.mark.parametrize("values", [
    np.arange(30, 0, -1.0),
    10.0 ** -np.arange(0, 15, 0.5),
    np.r_[5.0, 1 + 1e-9 * np.arange(8), 0.1 * np.ones(5)],       # near and truly equal ones
    np.r_[3.0, 2 + 1e-6, 2, 2 - 1e-6, 1 + 1e-12, 1, 0.5, 0, 0, 0],
    np.ones(12),
    np.r_[1e6, 1e6 - 1e-3, 1.0, 1e-6],
])
def test_eigenvectors_to_double_precision(values):
    for seed in range(3):
        q = _orthogonal(np.random.default_rng(seed), len(values))
        a = (q * values) @ q.T
        a = (a + a.T) / 2
        found, x = eigen(a)
        size = np.abs(values).max()
        assert (np.diff(found) <= 1e-15 * size).all()
        assert np.abs(found - np.sort(np.linalg.eigvalsh(a))[::-1]).max() < 2e-14 * size
        off, norm = _residual(a, found, x)
        assert off < 4e-16 * size * len(a) and norm < 1e-15 * len(a)


def test_near_equal_eigenvalues_are_told_apart():
    """Vectors of a pair 1e-9 apart (beyond float32) are right to what the matrix itself determines."""
    q = _orthogonal(np.random.default_rng(5), 6)
    values = np.array([2.0, 1 + 1e-9, 1, 0.5, 0.25, 0.1])
    _, x = eigen((q * values) @ q.T)
    assert np.abs(np.abs((q * x).sum(0)) - 1).max() < 1e-12


def test_awkward_matrices():
    assert eigen(np.zeros((0, 0)))[0].shape == (0,)
    assert (eigen(np.zeros((3, 3)))[0] == 0).all()
    assert eigen(np.array([[4.0]]))[0].tolist() == [4.0]
    values, x = eigen(np.diag([1.0, 3.0, 2.0]))
    assert values.tolist() == [3.0, 2.0, 1.0] and np.allclose(np.abs(x), np.eye(3)[:, [1, 2, 0]], atol=0)


def brute(vectors, components=8):
    """{(id, component): (n, deviation, whitened, explained)}, from exact integers and NumPy's solver."""
    fit = [(i, [math.floor(1024 * c) + 100000 for c in v]) for i, v in vectors
           if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    n, d = len(fit), len(fit[0][1])
    sums = [sum(v[k] for _, v in fit) for k in range(d)]
    z = np.array([[(n * v[k] - sums[k]) / n for k in range(d)] for _, v in fit])
    cov = z.T @ z / n
    values, x = np.linalg.eigh(cov)
    values, x = values[::-1], x[:, ::-1]
    out = {}
    for (i, v), row in zip(fit, z):
        dev = sum((n * v[k] - sums[k]) ** 2 for k in range(d))
        for c in range(min(components, d)):
            out[i, c + 1] = (n, dev, row @ x[:, c] / math.sqrt(values[c]), values[c] / np.trace(cov))
    return out


def _check(rows, want):
    assert {(r.vec_id, r.component) for r in rows} == set(want) and len(rows) == len(want)
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error <= 1e-9
    sign = {}
    for r in sorted(rows, key=lambda r: -abs(r.whitened)):
        n, dev, w, share = want[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, dev) and abs(r.explained - share) < 1e-12
        s = sign.setdefault(r.component, 1 if w * r.whitened > 0 else -1)
        assert abs(s * w - r.whitened) < 1e-6


def test_small_vectors_with_awkward_rows(spark):
    rnd = random.Random(4)
    rows = [(i, [rnd.gauss(0, 1 + k) + 0.5 * i / 300 for k in range(10)], 7) for i in range(300)]
    rows += [(300, None, 1), (301, [float("nan")] * 10, 1), (302, [None] + [0.0] * 9, 1), (303, [float("-inf")] + [0.0] * 9, 1)]
    df = spark.createDataFrame([(*r, 1, 2, 3.0) for r in rows], "vec_id long, embedding array<double>, i int, n int, component int, whitened double")
    out = whiten(df.repartition(5))
    assert out.columns == COLUMNS
    _check(out.collect(), brute([r[:2] for r in rows]))


def test_query_against_plain_python(spark):
    sf_dir = "/root/testdata/sf0.001"
    vectors = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    _check(QUERIES["op13_embedding_whitening"](spark, sf_dir).collect(), brute(vectors))


def test_lengths_apart_repeated_rows_null_ids_and_no_variance(spark):
    schema = "vec_id long, embedding array<double>"
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, 5.0]), (4, [0.0, 9.0]), (5, [1.0]), (6, []), (7, [2.0, 2.0, 2.0])]
    out = whiten(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.vec_id or 0, r.component, r.n) for r in out) == sorted(
        [(1, 1, 4), (1, 2, 4)] * 2 + [(0, 1, 4), (0, 2, 4), (4, 1, 4), (4, 2, 4), (5, 1, 1), (7, 1, 1), (7, 2, 1), (7, 3, 1)])
    for r in out:
        if r.vec_id in (5, 7):
            assert (r.deviation, r.whitened, r.explained, r.identity_error) == (0, None, 0.0, None)
        else:
            assert r.whitened is not None and r.identity_error < 1e-12
    line = whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(9)], schema)).collect()
    assert {r.component: r.whitened is None for r in line} == {1: False, 2: True, 3: True}
    assert all(r.identity_error < 1e-12 for r in line)
    large = whiten(spark.createDataFrame([(1, [1e12, 0.0]), (2, [-1e12, 1.0]), (3, [1e300, 0.0])], schema)).collect()
    assert {r.vec_id for r in large} == {1, 2} and all(r.deviation is None for r in large)
    assert whiten(spark.createDataFrame([], schema)).columns == COLUMNS
    assert whiten(spark.createDataFrame([], schema)).count() == 0


def test_wide_vectors_take_the_other_sum(spark):
    rng = np.random.default_rng(1)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((400, 130)) * np.linspace(3, 1, 130))]
    _check(whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).collect(), brute(rows))
