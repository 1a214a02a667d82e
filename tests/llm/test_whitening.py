import math
import random
from fractions import Fraction

import numpy as np
import pytest

from holdnet.llm import whitening as wh
from holdnet.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, id string, deviation string"


def reflected(diagonal, seed=0):
    """(integer matrix H D H', exact unit eigenvectors H / |v|^2, eigenvalues) of an integer Householder matrix H."""
    rng = random.Random(seed)
    v = [rng.randint(-9, 9) or 1 for _ in diagonal]
    q = sum(c * c for c in v)
    h = np.array([[q * (i == j) - 2 * a * b for j, b in enumerate(v)] for i, a in enumerate(v)], object)
    a = h @ np.diag(np.array(diagonal, object)) @ h.T
    return a, np.array([[float(Fraction(x, q)) for x in row] for row in h]), [d * q * q for d in diagonal]


@pytest.mark.parametrize("diagonal", [
    [9, 7, 5, 3, 1, 0],
    [10**12 + k for k in range(8)],                                     # one cluster, gaps of 1e-12
    [10**24 + 1, 10**24, 10**24 - 5, 10**12 + 1, 10**12, 3, 2, 1, 0],    # clusters inside clusters
    [10**20, 10**20 - 1, 10**20 - 2, 10**20 - 10**10, 10**20 - 10**10 - 1],
    [1, -1, 10**6, -10**6, 0],
    list(range(40)),
])
def test_eigenvectors_to_double_precision(diagonal):
    a, want, values = reflected(diagonal)
    got, x, unit = wh.eigenpairs(a)
    order = sorted(range(len(values)), key=lambda k: -values[k])
    for place, k in enumerate(order):
        assert abs(got[place] * unit - values[k]) <= 1e-15 * max(map(abs, values))
        assert min(np.abs(x[:, place] - want[:, k]).max(), np.abs(x[:, place] + want[:, k]).max()) < 4e-16


def test_multiple_eigenvalues_give_an_orthonormal_basis():
    a, want, _ = reflected([7, 7, 7, 10**9, 10**9, 1, 1, 0])
    got, x, _ = wh.eigenpairs(a)
    assert np.abs(x.T @ x - np.eye(8)).max() < 1e-15
    for cols, own in (([3, 4], [0, 1]), ([0, 1, 2], [2, 3, 4]), ([5, 6], [5, 6]), ([7], [7])):
        assert np.abs(want[:, cols] @ want[:, cols].T - x[:, own] @ x[:, own].T).max() < 2e-15


def test_larger_matrix_against_numpy():
    rng = np.random.default_rng(4)
    y = rng.integers(-50, 50, (400, 120)).astype(object)
    got, x, unit = wh.eigenpairs(y.T @ y)
    values, vectors = np.linalg.eigh((y.T @ y).astype(float))
    assert np.allclose(got * unit, values[::-1], rtol=1e-12)
    assert np.abs(np.abs(x) - np.abs(vectors[:, ::-1])).max() < 1e-10
    assert np.abs(x.T @ x - np.eye(120)).max() < 2e-15


def plain(rows):
    """n, exact deviations and float64 whitening of kept rows."""
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in rows], object)
    n, s = len(x), x.sum(axis=0)
    deviations = [sum(int(c) ** 2 for c in n * row - s) for row in x]
    centred = (n * x - s).astype(float) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return n, deviations, centred, values[::-1], vectors[:, ::-1]


def rows_of(n, dim, seed=1):
    rng = random.Random(seed)
    base = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(dim)]
    return [(k, [sum(a * rng.gauss(0, 1) for a in row) / 4 for row in base]) for k in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "i", "d") for i, v in rows], SCHEMA)


def test_registered_query(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = rows_of(300, 40)
    rows += [(500, rows[0][1]), (500, rows[0][1]), (None, rows[5][1])]
    bad = [(600, None), (601, []), (602, [1.0] * 39), (603, [nan] + [1.0] * 39), (604, [-inf] + [1.0] * 39), (605, [None] + [1.0] * 39)]
    frame(spark, rows + bad).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["op11_whitening"](spark, str(tmp_path)).collect()
    n, deviations, centred, values, vectors = plain(rows)
    assert len(got) == len(rows) * 32 and {r.n for r in got} == {n}
    assert sorted(r.deviation for r in got if r.component == 1) == sorted(deviations)
    want = centred @ vectors[:, :32] / np.sqrt(values[:32])
    for c in range(32):
        own = sorted(((-1 if r.vec_id is None else r.vec_id), r.whitened) for r in got if r.component == c + 1)
        mine = np.array([w for _, w in own])
        theirs = np.array([w for _, w in sorted(((-1 if i is None else i), w) for (i, _), w in zip(rows, want[:, c], strict=True))])
        assert min(np.abs(mine - theirs).max(), np.abs(mine + theirs).max()) < 1e-9
        assert abs(next(r.explained for r in got if r.component == c + 1) - values[c] / values.sum()) < 1e-12
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-12


def test_no_variance_one_row_and_no_rows(spark):
    rows = [(1, [1.0, 5.0, 2.0]), (2, [2.0, 5.0, 4.0]), (3, [4.0, 5.0, 8.0])]  # one component of some variance
    got = wh.report(frame(spark, rows)).collect()
    assert len(got) == 9 and all((r.whitened is None) == (r.component > 1) for r in got)
    assert got[0].identity_error < 1e-12 and sum(r.explained for r in got if r.vec_id == 1) == pytest.approx(1)
    one = wh.report(frame(spark, rows[:1])).collect()
    assert len(one) == 3 and all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 for r in one)
    none = wh.report(frame(spark, []))
    assert none.count() == 0 and none.columns == wh.report(frame(spark, rows)).columns


def test_large_entries_stay_exact(spark):
    rows = [(k, [float(2 ** 40 * (k % 7)), float(2 ** 30 * (k % 3)), float(k)]) for k in range(20)]
    model = wh.fit(wh.integer_vectors(frame(spark, rows)), 3)
    n, _, _, values, _ = plain(rows)
    assert model.n == n and np.allclose(model.values, values, rtol=1e-9)
    with pytest.raises(Exception, match="2\\^62"):
        wh.integer_vectors(frame(spark, [(1, [1e30])])).collect()
