"""Whitening against exact fractions and numpy."""

import math

import numpy as np
import pytest

from shoebox.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, x string, c int, component int"


def slow(rows, k=4):
    """x by vec_id, n, S, deviations, eigenvalues and vectors of the covariance."""
    lengths = {}
    own = [(i, [math.floor(256 * c) for c in v]) for i, v, *_ in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    for _, x in own:
        lengths[len(x)] = lengths.get(len(x), 0) + 1
    d = max(lengths, key=lambda n: (lengths[n], n))
    own = [(i, x) for i, x in own if len(x) == d]
    fit = sorted({tuple(x) for _, x in own})
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    deviation = [sum((n * v - t) ** 2 for v, t in zip(x, s)) for _, x in own]
    z = np.array(fit, float) - np.array(s) / n
    e, u = np.linalg.eigh(z.T @ z / n)
    return own, n, s, deviation, e[::-1][:k], u[:, ::-1][:, :k], e.sum()


def made(n, d=6, seed=0):
    r = np.random.default_rng(seed)
    m = r.normal(size=(n, d)) @ np.diag(np.linspace(2, 0.2, d))
    return [(i, [float(np.float32(v)) for v in row], "x", 1, 9) for i, row in enumerate(m)]


def test_whitening_matches_a_dense_solver(spark):
    rows = made(300)
    rows += [(7, rows[7][1], None, None, None), (None, rows[3][1], "a", 2, 3), (900, None, "a", 1, 1), (901, [], "a", 1, 1), (902, [None, *[0.0] * 5], "a", 1, 1), (903, [math.nan, *[0.0] * 5], "a", 1, 1), (904, [math.inf, *[0.0] * 5], "a", 1, 1), (905, [1.0, 2.0], "a", 1, 1), (906, [-0.0, *[0.0] * 5], "b", 1, 1)]
    got = W.whiten(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    own, n, s, deviation, e, u, trace = slow(rows)
    assert len(got) == 4 * len(own) and {r.n for r in got} == {n} == {301}
    assert sorted((r.vec_id is None, r.vec_id, r.deviation) for r in got if r.component == 1) == sorted((i is None, i, v) for (i, _), v in zip(own, deviation))
    want = {(i, k + 1): float((np.array(x) - np.array(s) / n) @ u[:, k] / math.sqrt(e[k])) for i, x in own for k in range(4)}
    for k in range(1, 5):
        some = [r for r in got if r.component == k]
        sign = 1 if some[0].whitened * want[some[0].vec_id, k] > 0 else -1
        assert all(abs(r.whitened * sign - want[r.vec_id, k]) < 1e-9 for r in some)
        assert all(abs(r.explained - e[k - 1] / trace) < 1e-12 for r in some)
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9


def test_polynomial_and_roots_are_exact(spark):
    r = np.random.default_rng(1)
    x = r.integers(-1000, 1000, (40, 7))
    m = [[int(v) for v in row] for row in x.T @ x]
    polynomial = W.characteristic_polynomial(spark, m)
    assert polynomial[-1] == 1 and polynomial[-2] == -sum(m[i][i] for i in range(7))
    from fractions import Fraction

    def det(a):
        a, out = [[Fraction(v) for v in row] for row in a], Fraction(1)
        for k in range(len(a)):
            p = next((i for i in range(k, len(a)) if a[i][k]), None)
            if p is None:
                return Fraction(0)
            a[k], a[p] = a[p], a[k]
            out *= a[k][k] * (-1 if p != k else 1)
            for i in range(k + 1, len(a)):
                f = a[i][k] / a[k][k]
                a[i] = [v - f * w for v, w in zip(a[i], a[k])]
        return out

    for t in (-3, 0, 5, 10**6):
        assert W.value_at(polynomial, t) == det([[t * (i == j) - m[i][j] for j in range(7)] for i in range(7)])
    roots = [a / 2 ** (s + 1) for a, s in W.greatest_roots(polynomial, 7)]
    assert np.allclose(roots, np.linalg.eigvalsh(np.array(m, float))[::-1], rtol=1e-10)


@pytest.mark.parametrize("m", [np.diag([5, 5, 5, 2]), np.diag([7, 3, 0, 0]), np.ones((4, 4), int), np.zeros((3, 3), int), np.array([[9]]), np.kron(np.eye(3, dtype=int), np.array([[2, 1], [1, 2]]))])
def test_repeated_and_zero_roots(spark, m):
    m = [[int(v) for v in row] for row in m]
    roots = W.greatest_roots(W.characteristic_polynomial(spark, m), 4)
    want = [v for v in np.linalg.eigvalsh(np.array(m, float))[::-1][:4] if v > 1e-9]
    assert np.allclose([a / 2 ** (s + 1) for a, s in roots], want)
    vectors, values = W.null_vectors(m, roots)
    assert np.allclose(vectors @ vectors.T, np.eye(len(roots)))
    assert np.allclose(np.array(m) @ vectors.T, vectors.T * np.array([float(v) for v in values])[None])


def test_great_entries_and_few_vectors(spark):
    rows = [(k, [2.0**40 * k, -3.0, 1e-9]) for k in range(1, 6)] + [(9, [1e300, 0.0, 0.0])]
    got = W.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.component for r in got} == {1} and {r.vec_id for r in got} == {1, 2, 3, 4, 5} and {r.deviation for r in got} <= {None, 0}
    assert np.allclose(sorted(r.whitened for r in got) if got[0].whitened < got[-1].whitened else sorted(-r.whitened for r in got), [-math.sqrt(2), -math.sqrt(0.5), 0, math.sqrt(0.5), math.sqrt(2)])
    for none in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]):
        assert W.whiten(spark.createDataFrame(none, "vec_id long, embedding array<double>")).count() == 0
    one = W.whiten(spark.createDataFrame([(1, [1.0]), (2, [2.0])], "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id, abs(round(r.whitened, 9)), r.explained) for r in one) == [(1, 1.0, 1.0), (2, 1.0, 1.0)]
