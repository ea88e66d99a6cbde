"""Whitening against numpy's eigenvectors, the polynomial against exact determinants, edge cases."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearth.llm import whitening
from hearth.llm.queries import op13_exact_whitening
from tests.conftest import SF_MID

SCHEMA = "vec_id long, embedding array<float>, n string"


def plain(vectors):
    """x, n, sums, covariance, and its eigenvalues and vectors by numpy."""
    x = np.array([[int(np.floor(1024 * float(np.float32(c)))) + 100_000 for c in v] for v in vectors])
    centred = x - x.mean(0)
    e, q = np.linalg.eigh(centred.T @ centred / len(x))
    return x, e[::-1], q[:, ::-1]


def test_against_numpy(spark):
    e = spark.read.parquet(f"{SF_MID}/embeddings.parquet").collect()
    x, values, vectors = plain([r.embedding for r in e])
    got = op13_exact_whitening(spark, SF_MID).toPandas()
    assert len(got) == 8 * len(e) and set(got.component) == set(range(1, 9)) and (got.n == len(e)).all()
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    at = {r.vec_id: i for i, r in enumerate(e)}
    row = got.vec_id.map(at).to_numpy()
    n, s = len(x), x.sum(0)
    assert (got.deviation.to_numpy() == ((n * x - s) ** 2).sum(1)[row]).all()
    k = got.component.to_numpy() - 1
    assert np.allclose(got.explained, (values / values.sum())[k], rtol=1e-10)
    want = ((x - s / n) @ vectors / np.sqrt(np.maximum(values, 1e-9)))[row, k]
    for c in range(8):
        g, w = got.whitened.to_numpy()[k == c], want[k == c]
        assert np.allclose(g, w, atol=1e-8) or np.allclose(g, -w, atol=1e-8)


def determinant(m):
    m, out = [row[:] for row in m], Fraction(1)
    for k in range(len(m)):
        p = next((r for r in range(k, len(m)) if m[r][k]), None)
        if p is None:
            return Fraction(0)
        if p != k:
            m[k], m[p], out = m[p], m[k], -out
        out *= m[k][k]
        for r in range(k + 1, len(m)):
            f = m[r][k] / m[k][k]
            m[r] = [a - f * b for a, b in zip(m[r], m[k], strict=True)]
    return out


def test_polynomial_is_exact(spark):
    rng = np.random.default_rng(4)
    for d, rank in ((1, 1), (2, 1), (6, 6), (7, 3)):
        y = rng.integers(-10**9, 10**9, (rank, d)).astype(object)
        a = y.T @ y
        poly = whitening.characteristic_polynomial(spark, a)
        assert len(poly) == d + 1 and poly[-1] == 1
        for t in (0, 3, 10**18 + 7):
            m = [[Fraction(int(t * (i == j) - a[i, j])) for j in range(d)] for i in range(d)]
            assert sum(c * t**k for k, c in enumerate(poly)) == determinant(m)
        assert whitening.roots_beyond(poly, 0) == np.linalg.matrix_rank(y.astype(float))


def poly_of(roots):
    out = [1]
    for r in roots:
        out = [a - r * b for a, b in zip([0, *out], [*out, 0], strict=True)]
    return out


@pytest.mark.parametrize("roots", [[9], [5, 5, 3, 3, 3, 0, 7], [1, 0, 0], [4, 3, 2, 1, 0], [10**20, 10**20 - 1, 1]])
def test_roots_and_null_spaces(roots):
    poly, order = poly_of(roots), sorted(roots, reverse=True)
    a = np.diag(np.array(roots, object))
    for j, want in enumerate((r for r in order if r), 1):
        root, above, size = whitening.isolate(poly, j, sum(roots))
        assert abs(root - want) <= Fraction(want, 1 << 200)
        assert (above, size) == (sum(r > want for r in roots), roots.count(want))
        basis = whitening.null_space(a, root, size)
        assert np.allclose(basis @ basis.T, np.eye(size), atol=1e-15)
        assert all(abs(v[i]) < 1e-15 for v in basis for i, r in enumerate(roots) if r != want)


def test_close_roots_keep_their_own_vectors():
    a = np.array([[10**12, 1], [1, 10**12]], object)  # 10^12 +- 1, vectors (1, 1) and (1, -1)
    poly = [10**24 - 1, -2 * 10**12, 1]
    for j, want in ((1, [1, 1]), (2, [1, -1])):
        root, above, size = whitening.isolate(poly, j, 2 * 10**12)
        v = whitening.null_space(a, root, size)[0]
        assert np.allclose(np.abs(v @ np.array(want)) / 2**0.5, 1, atol=1e-15)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [0.0, 1.0]), (None, [0.5, -0.25]), (4, None), (5, []), (7, [nan, 1.0]),
            (8, [inf, 1.0]), (9, [None, 1.0]), (10, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(*r, "c") for r in rows], SCHEMA).withColumn("whitened", F.lit("clash"))
    got = whitening.whiten(df).orderBy("vec_id", "component").collect()
    x, values, _ = plain([r[1] for r in rows[:4]])
    assert sorted((str(r.vec_id), r.component) for r in got) == sorted((str(i), c) for i in (None, 0, 1, 1) for c in (1, 2))
    dev = ((4 * x - x.sum(0)) ** 2).sum(1).tolist()
    assert {(r.vec_id, r.deviation) for r in got} == {(0, dev[0]), (1, dev[1]), (None, dev[3])}
    assert all(r.n == 4 and r.identity_error < 1e-9 for r in got)
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(df.where("vec_id = 0")).count() == 0  # one row has no variance
    equal = spark.createDataFrame([(i, [1.0, float(i % 2)], "c") for i in range(6)], SCHEMA)
    assert {r.component for r in whitening.whiten(equal).collect()} == {1}


def test_huge_entries_stay_exact(spark):
    rows = [(0, [3e38, 1.0], "c"), (1, [-3e38, 2.0], "c"), (2, [0.0, 3.5], "c")]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 6 and all(r.identity_error < 1e-4 for r in got)
    assert {r.vec_id: r.deviation for r in got} == {0: None, 1: None, 2: (3 * 3584 - (1024 + 2048 + 3584)) ** 2}


def test_products_and_limbs(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(-2**61, 2**61, (9, 3))
    df = spark.createDataFrame([(i, [int(v) for v in r]) for i, r in enumerate(y)], "vec_id long, x array<long>").repartition(3)
    s = whitening.scatter(df)
    big = y.astype(object) - whitening.SHIFT
    assert s.n == 9 and s.sums == list(big.sum(0))
    assert (s.matrix == 9 * (big.T @ big) - np.outer(big.sum(0), big.sum(0))).all()
