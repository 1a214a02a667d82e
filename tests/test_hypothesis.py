import collections
import functools
import itertools
import math
import random
import statistics

import numpy as np
import pytest

from holdnet.operators import hypothesis


def sample_rows(seed=2, n1=9, n2=40):
    rnd = random.Random(seed)
    rows = [(1, float(rnd.randrange(30) + 5), f"p{i}") for i in range(n1)]
    rows += [(2, float(rnd.randrange(30)), f"s{i}") for i in range(n2)]
    return rows


def test_mann_whitney_matches_brute_force(spark):
    data = sample_rows()
    df = spark.createDataFrame(data, "sample int, value double, row_id string")
    got = hypothesis.mann_whitney(df).first()
    a = [v for s, v, _ in data if s == 1]
    b = [v for s, v, _ in data if s == 2]
    u1 = sum(1.0 if x > y else 0.5 if x == y else 0.0 for x in a for y in b)
    assert got["u1"] == u1
    allv = a + b
    n, n1, n2 = len(allv), len(a), len(b)
    ties = sum(allv.count(v) ** 3 - allv.count(v) for v in set(allv))
    sigma = math.sqrt(n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1))))
    z = (abs(u1 - n1 * n2 / 2) - 0.5) / sigma
    assert abs(got["z"] - z) < 1e-9
    assert abs(got["p_value"] - math.erfc(z / math.sqrt(2))) < 1e-10  # rounded to ten digits
    full = hypothesis.mann_whitney(df, digits=15).first()
    assert abs(full["p_value"] - math.erfc(z / math.sqrt(2))) < 1e-12


def brute_shuffle(place, keys, n):
    """The keyed permutation in plain Python."""
    high = math.ceil(math.sqrt(n))
    wide = math.ceil(n / high)
    while True:
        left, right = divmod(place, wide)
        for r, (a, b, c) in enumerate(keys):
            t = (((right, left)[r % 2] * a + b) % (2**31 - 1)) ** 2 + c
            if r % 2 == 0:
                left = (left + t % (2**31 - 1)) % high
            else:
                right = (right + t % (2**31 - 1)) % wide
        place = left * wide + right
        if place < n:
            return place


def brute_differences(data, n_iter, seed):
    n, n1 = len(data), sum(1 for s, _, _ in data if s == 1)
    m = min(n1, n - n1)
    base = sorted(v for _, v, _ in data)
    out = {}
    for it in range(1, n_iter + 1):
        keys = hypothesis.round_keys(seed, it)
        chosen = {brute_shuffle(k, keys, n) for k in range(m)}
        assert len(chosen) == m
        own = statistics.median([base[p] for p in chosen])
        rest = statistics.median([base[p] for p in range(n) if p not in chosen])
        out[it] = own - rest if n1 <= n - n1 else rest - own
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 12, 20, 101, 1600])
def test_keyed_shuffle_is_a_permutation(n):
    for it in range(30):
        keys = np.array([hypothesis.round_keys(4, it)] * n, np.int64)
        assert sorted(hypothesis.shuffled(np.arange(n), keys, n).tolist()) == list(range(n))


@pytest.mark.parametrize("n,m", [(5, 2), (6, 3), (7, 3), (8, 4), (9, 2), (12, 2)])
def test_all_sets_of_a_small_sample_come_up_evenly(n, m):
    """Chi-square of the drawn sets against equal shares, at six deviations above its mean."""
    draws = 20_000
    keys = np.array([hypothesis.round_keys(1, it) for it in range(draws)], np.int64)
    places = np.stack([hypothesis.shuffled(np.full(draws, k), keys, n) for k in range(m)], axis=1)
    sets = collections.Counter(map(frozenset, places.tolist()))
    cells = math.comb(n, m)
    assert len(sets) == cells
    chi = sum((c - draws / cells) ** 2 for c in sets.values()) * cells / draws
    assert chi < cells - 1 + 6 * math.sqrt(2 * (cells - 1))
    firsts = collections.Counter(places[:, 0].tolist())  # single places too
    assert max(abs(c - draws / n) for c in firsts.values()) < 6 * math.sqrt(draws / n)


def u_counts(n1, n2):
    """Orders per value of U by the counting recursion."""
    @functools.cache
    def count(a, b, u):
        if u < 0:
            return 0
        if a == 0 or b == 0:
            return int(u == 0)
        return count(a - 1, b, u - b) + count(a, b - 1, u)
    return [count(n1, n2, u) for u in range(n1 * n2 + 1)]


def test_exact_law_of_u_for_all_small_samples():
    for n1 in range(1, 9):
        for n2 in range(1, 9):
            counts = u_counts(n1, n2)
            assert [hypothesis.u_at_most(u, n1, n2) for u in range(n1 * n2 + 1)] == list(itertools.accumulate(counts))
    orders = collections.Counter(sum(sum(x > y for y in set(range(7)) - set(s)) for x in s) for s in itertools.combinations(range(7), 3))
    assert [orders[u] for u in range(13)] == u_counts(3, 4)
    assert hypothesis.u_at_most(5 * 200, 5, 200) == math.comb(205, 5)
    assert hypothesis.u_at_most(431, 5, 200) == sum(u_counts(5, 200)[:432])
    assert hypothesis.u_at_most(8 * 10**12, 8, 10**12) == math.comb(10**12 + 8, 8)


def test_small_samples_without_ties_use_the_exact_law(spark):
    for n1, n2, seed in ((3, 4, 1), (8, 30, 2), (1, 9, 3), (12, 8, 4)):
        values = random.Random(seed).sample(range(1000), n1 + n2)
        data = [(1 if k < n1 else 2, float(v), f"r{k}") for k, v in enumerate(values)]
        got = hypothesis.mann_whitney(spark.createDataFrame(data, "sample int, value double, row_id string"), digits=14).first()
        u1 = sum(x > y for x in values[:n1] for y in values[n1:])
        counts = u_counts(n1, n2)
        tail = sum(counts[max(u1, n1 * n2 - u1):]) / sum(counts)
        assert got["u1"] == u1 and got["p_value"] == pytest.approx(min(1.0, 2 * tail), abs=1e-13)
    tied = spark.createDataFrame([(1, 1.0, "a"), (1, 2.0, "b"), (2, 2.0, "c"), (2, 3.0, "d")], "sample int, value double, row_id string")
    got = hypothesis.mann_whitney(tied).first()  # ties: the approximation
    assert got["p_value"] == pytest.approx(math.erfc(got["z"] / math.sqrt(2)), abs=1e-9)


@pytest.mark.parametrize("n1,n2", [(9, 40), (5, 400), (300, 6), (50, 50)])
def test_permutation_median_matches_brute_force(spark, n1, n2):
    data = sample_rows(n1=n1, n2=n2)
    df = spark.createDataFrame(data, "sample int, value double, row_id string")
    n_iter, seed = 40, 3
    want = brute_differences(data, n_iter, seed)
    got = hypothesis.permutation_differences(df, n_iter=n_iter, seed=seed).collect()
    assert {r["it"]: r["diff"] for r in got} == want
    obs = statistics.median([v for s, v, _ in data if s == 1]) - statistics.median([v for s, v, _ in data if s == 2])
    one = hypothesis.permutation_median(df, n_iter=n_iter, seed=seed).first()
    assert one["observed_diff"] == obs and (one["n1"], one["n2"]) == (n1, n2)
    assert one["p_value"] == sum(d >= obs for d in want.values()) / n_iter and one["n_iter"] == n_iter


def test_counts_beyond_64_bits(spark):
    # ten billion equal values: their cube passes 2**63, as does the product of the sample sizes
    big = 10**10
    counts = spark.createDataFrame([(1.0, big, big // 2), (2.0, big, big)], "value double, c long, c1 long")
    got = hypothesis.mann_whitney_counts(counts).first()
    n1, n2, n = big // 2 + big, big // 2, 2 * big
    assert got["u1"] == big * n2 + (big // 2) * n2 / 2
    sigma = math.sqrt(n1 * n2 / 12 * ((n + 1) - (2 * (big**3 - big)) / (n * (n - 1))))
    assert got["z"] == pytest.approx((abs(got["u1"] - n1 * n2 / 2) - 0.5) / sigma)


def test_three_million_equal_values(spark):
    df = spark.range(3_000_000).selectExpr("CAST(id % 2 + 1 AS INT) AS sample", "1.0D AS value")
    got = hypothesis.mann_whitney(df).first()
    assert got["u1"] == 1_500_000**2 / 2 and got["z"] is None and got["p_value"] is None


def test_density_curve_matches_numpy(spark):
    data = sample_rows()
    df = spark.createDataFrame(data + data[:5], "sample int, value double, row_id string")
    got = {(r["sample"], r["j"]): r for r in hypothesis.density_curve(df, grid_size=101).collect()}
    for s in (1, 2):
        x = np.array([v for ss, v, _ in data + data[:5] if ss == s])
        h = x.std(ddof=1) * len(x) ** (-0.2)
        grid = np.linspace(x.min() - 3 * h, x.max() + 3 * h, 101)
        dens = np.exp(-0.5 * ((grid[:, None] - x[None, :]) / h) ** 2).sum(axis=1) / (len(x) * h * math.sqrt(2 * math.pi))
        for j in range(101):
            assert abs(got[(s, j)]["density"] - dens[j]) < 1e-9 and abs(got[(s, j)]["x"] - grid[j]) < 1e-5
        mass = np.trapezoid([got[(s, j)]["density"] for j in range(101)], grid)
        assert abs(mass - 1.0) < 0.005
