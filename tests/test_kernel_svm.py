"""The distributed dual solver against dense solutions in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from holdnet.operators import kernel_svm as ks
from holdnet.session import pin


def overlapping(n, d=6, seed=1):
    rng = np.random.default_rng(seed)
    y = np.where(rng.random(n) < 0.4, 1, -1)
    x = rng.normal(size=(n, d)) + 0.6 * y[:, None] * (rng.random(d) < 0.5)
    return x, y


def table(spark, x, y, folds=3):
    rows = [(k, int(b), k % folds, [float(v) for v in a]) for k, (a, b) in enumerate(zip(x, y, strict=True))]
    return pin(spark.createDataFrame(rows, "row long, y int, fold int, x array<double>").repartition(5))


def objective(kernel, x, y, a):
    w = a * y
    return a.sum() - 0.5 * w @ kernel(x, x) @ w


def multipliers(solution, p, n):
    out = np.zeros(n)
    for r in solution.state.select("row", F.element_at("alpha", p + 1).alias("a")).collect():
        out[r["row"]] = r["a"]
    return out


@pytest.mark.parametrize("name", ["linear", "rbf"])
def test_two_thousand_rows_against_a_dense_solution(spark, name):
    x, y = overlapping(2000)
    kernel, c = ks.Kernel(name, 1 / 6), 1.0
    found = ks.solve(table(spark, x, y), [ks.Problem(kernel, c)], 6, tol=1e-4, working=512 if name == "linear" else 256)
    assert found.violation[0] <= 1e-4 and found.rounds >= 2
    a = multipliers(found, 0, len(y))
    assert ((a >= 0) & (a <= c)).all() and abs((a * y).sum()) < 1e-9
    best = ks.pairwise(kernel(x, x), y, np.zeros(len(y)), y.astype(float), c, 1e-7, steps=2_000_000)
    assert abs(objective(kernel, x, y, a) - objective(kernel, x, y, best)) < 1e-5 * objective(kernel, x, y, best)
    k = kernel(x, x)
    free = (best > 1e-9) & (best < c - 1e-9)
    want = k @ (best * y) + (y - k @ (best * y))[free].mean()
    got = k @ (a * y) + found.bias[0]
    assert np.abs(got - want).max() < 2e-3
    scored = ks.decision(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i int, x array<double>"), "x",
                         ks.support_table(found, 0), kernel, found.bias[0], "m").collect()
    assert np.abs(np.array([r["m"] for r in sorted(scored, key=lambda r: r["i"])]) - got).max() < 1e-9


def test_problems_side_by_side_leave_their_fold_out(spark):
    x, y = overlapping(150, seed=3)
    kernels = [ks.Kernel("linear"), ks.Kernel("rbf", 0.3)]
    problems = [ks.Problem(k, c, f) for k in kernels for c in (1.0, 10.0) for f in (0, 1, 2, None)]
    found = ks.solve(table(spark, x, y), problems, 6, tol=1e-5, working=96)
    for p, problem in enumerate(problems):
        a = multipliers(found, p, len(y))
        part = np.ones(len(y), bool) if problem.fold is None else np.arange(len(y)) % 3 != problem.fold
        assert not a[~part].any()
        best = ks.pairwise(problem.kernel(x[part], x[part]), y[part], np.zeros(part.sum()), y[part].astype(float), problem.c, 1e-8, 500_000)
        want = objective(problem.kernel, x[part], y[part], best)
        assert abs(objective(problem.kernel, x[part], y[part], a[part]) - want) < 1e-5 * want


def test_blocks_of_support_vectors(spark, monkeypatch):
    x, y = overlapping(120, seed=5)
    kernel = ks.Kernel("rbf", 0.2)
    found = ks.solve(table(spark, x, y), [ks.Problem(kernel, 1.0)], 6)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i int, x array<double>")
    whole = {r["i"]: r["m"] for r in ks.decision(df, "x", ks.support_table(found, 0), kernel, 0.5, "m").collect()}
    monkeypatch.setattr(ks, "SUPPORT_ROWS", 7)
    blocks = ks.support_table(found, 0)
    assert blocks.groupBy("block").count().agg(F.max("count")).first()[0] == 7 and blocks.select("block").distinct().count() > ks.CUT
    split = {r["i"]: r["m"] for r in ks.decision(df, "x", blocks, kernel, 0.5, "m").collect()}
    assert max(abs(whole[k] - split[k]) for k in whole) < 1e-12


def test_one_class_equal_rows_and_no_rows(spark):
    x, y = np.ones((9, 2)), np.ones(9, int)
    one = ks.solve(table(spark, x, y), [ks.Problem(ks.Kernel("linear"), 1.0)], 2)
    assert one.bias == [1.0] and ks.support_table(one, 0).count() == 0
    y[:3] = -1  # equal rows of both classes: nothing to tell apart, but it ends
    same = ks.solve(table(spark, x, y), [ks.Problem(ks.Kernel("rbf", 1.0), 1.0)], 2)
    assert same.violation[0] <= ks.TOL
    none = ks.solve(table(spark, x[:0], y[:0]), [ks.Problem(ks.Kernel("linear"), 1.0)], 2)
    assert none.bias == [0.0] and none.rounds == 1
