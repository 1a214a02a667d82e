"""Two-sample tests on a (sample, value, row_id) table: sample 1 = parents, 2 = subsidiaries."""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from holdnet.functions import flag
from holdnet.operators.ranks import row_numbers, running_sums

#: Sums of products of counts stay exact far beyond 64 bits.
WIDE = "decimal(38,0)"
#: The exact law of U is used if a sample has at most so many values.
SMALL = 8
#: Rounds and modulus of the keyed permutations; draws made in one task.
ROUNDS, PRIME, DRAWS_PER_TASK = 8, 2**31 - 1, 1 << 20


def mann_whitney(samples: DataFrame, alpha: float = 0.05, digits: int = 10) -> DataFrame:
    """Two-sided Mann-Whitney U test.

    Values are counted per distinct value, average ranks come from exact
    running sums over the distinct values, and U1 is computed in integers
    (2 * R1 is an integer), in 38 digits.  The p-value of the one result row is exact (:func:`u_at_most`) if a sample has
    at most ``SMALL`` values and no two values are equal, as the reference's test has it; else that of the normal
    approximation with tie and continuity correction (complementary error function).  ``z`` is
    the approximation's in either case.  One output row.
    """
    counts = samples.filter(F.col("value").isNotNull()).groupBy("value").agg(
        F.count(F.lit(1)).alias("c"), F.sum(flag(F.col("sample") == 1)).cast("long").alias("c1"))
    return mann_whitney_counts(counts, alpha, digits)


def mann_whitney_counts(counts: DataFrame, alpha: float = 0.05, digits: int = 10) -> DataFrame:
    """The same from a table of distinct values: ``value``, ``c`` rows, of them ``c1`` in sample 1."""
    cum = running_sums(counts, [], ["value"], {"_end": "c"})
    c, c1, end = (F.col(k).cast(WIDE) for k in ("c", "c1", "_end"))
    # twice the average rank of a value: 2 * before + c + 1
    agg = cum.agg(
        F.sum((c1 * (2 * (end - c) + c + 1)).cast(WIDE)).alias("two_r1"),
        F.sum("c1").alias("n1"), F.sum("c").alias("n"),
        F.sum((c * c * c - c).cast(WIDE)).alias("ties"))
    n1, n = F.col("n1").cast(WIDE), F.col("n").cast(WIDE)
    u = agg.select(
        ((F.col("two_r1") - n1 * (n1 + 1)).cast("double") / 2).alias("u1"), F.col("n1"), (F.col("n") - F.col("n1")).alias("n2"),
        n.cast("double").alias("_n"), F.col("ties").cast("double").alias("_t"))
    mu = F.col("n1").cast("double") * F.col("n2").cast("double") / 2
    sigma = F.sqrt(F.col("n1").cast("double") * F.col("n2").cast("double") / 12
                   * ((F.col("_n") + 1) - F.try_divide(F.col("_t"), F.col("_n") * (F.col("_n") - 1))))
    z = F.try_divide(F.abs(F.col("u1") - mu) - 0.5, sigma)
    tied = F.col("_t") > 0
    p_value = F.udf(lambda *row: two_sided_p(*row), "double")  # one row
    out = u.withColumn("z", z).withColumn("p_value", p_value("u1", "n1", "n2", "z", tied))
    return out.select(
        "u1", "n1", "n2", F.round("z", digits).alias("z"), F.round("p_value", digits).alias("p_value"),
        F.when(F.col("p_value") > alpha, "same_distribution").otherwise("different_distribution").alias("verdict"))


@functools.cache
def _parts_series(m: int) -> tuple[int, list[int]]:
    """(L, N) with 1 / ((1 - q)(1 - q)(1 - q^2)...(1 - q^m)) = N(q) / (1 - q^L)^(m + 1); L: least common multiple of 1 to m."""
    period = math.lcm(*range(1, m + 1))
    series = [1]
    for i in [1, *range(1, m + 1)]:  # times 1 + q^i + q^2i + ... + q^(L - i)
        grown = [0] * (len(series) + period - i)
        for v, c in enumerate(series):
            if c:
                for t in range(v, v + period, i):
                    grown[t] += c
        series = grown
    return period, series


def _partitions(v: int, m: int) -> int:
    """Partitions of all numbers up to ``v`` into parts of 1 to ``m``."""
    if v < 0:
        return 0
    period, series = _parts_series(m)
    t, r = divmod(v, period)
    return sum(series[r + s * period] * math.comb(t - s + m, m) for s in range(m + 1) if r + s * period < len(series) and t >= s)


def u_at_most(u: int, n1: int, n2: int) -> int:
    """Of the orders of n1 and n2 different values, how many have U1 <= u; exact, and as quick for any n2.

    The numbers of orders per U are the coefficients of the product over i = 1..n1 of (1 - q^(n2 + i)) / (1 - q^i).  Its
    2^n1 numerator terms shift the series of the denominator, whose coefficients are a polynomial in v for every v mod lcm(1..n1).
    """
    m, other = min(n1, n2), max(n1, n2)
    total = 0
    for chosen in range(1 << m):
        parts = [i for i in range(1, m + 1) if chosen >> (i - 1) & 1]
        total += (-1) ** len(parts) * _partitions(u - sum(parts) - len(parts) * other, m)
    return total


def two_sided_p(u1: float | None, n1: int | None, n2: int | None, z: float | None, tied: bool | None) -> float | None:
    """Two-sided p-value of one test; None if a sample is empty or all values are equal."""
    if n1 and n2 and min(n1, n2) <= SMALL and not tied:
        least = int(min(u1, n1 * n2 - u1))
        return min(1.0, float(Fraction(2 * u_at_most(least, n1, n2), math.comb(n1 + n2, n1))))
    return None if z is None else min(1.0, math.erfc(z / math.sqrt(2.0)))


def _median_expr(lo: str, hi: str) -> Column:
    return (F.col(lo) + F.col(hi)) / 2


def round_keys(seed: int, it: int) -> list[tuple[int, int, int]]:
    """Three 28-bit numbers for every round of permutation ``it``, from md5('<seed>:<it>:<round>')."""
    out = []
    for r in range(ROUNDS):
        key = hashlib.md5(f"{seed}:{it}:{r}".encode()).hexdigest()
        out.append((int(key[:7], 16), int(key[7:14], 16), int(key[14:21], 16)))
    return out


def shuffled(places: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """Where a keyed permutation of 0..n-1 puts every place; ``keys``: places x rounds x 3 (see :func:`round_keys`).

    A place is a pair (left, right) of the smallest near-square grid of n cells; the rounds in turn shift one half by a
    keyed function of the other, which is a bijection of the grid.  A place that leaves 0..n-1 goes through the
    rounds again until it is back inside, so 0..n-1 is permuted.
    """
    high = math.isqrt(n - 1) + 1
    wide = -(-n // high)
    out, todo = places.astype(np.int64), np.arange(len(places))
    while len(todo):
        left, right = np.divmod(out[todo], wide)
        for r in range(ROUNDS):
            k = keys[todo, r]
            t = ((right if r % 2 == 0 else left) * k[:, 0] + k[:, 1]) % PRIME
            t = (t * t + k[:, 2]) % PRIME
            if r % 2 == 0:
                left = (left + t) % high
            else:
                right = (right + t) % wide
        out[todo] = left * wide + right
        todo = todo[out[todo] >= n]
    return out


def relabellings(spark: SparkSession, n: int, m: int, n_iter: int, seed: int) -> DataFrame:
    """``(it, g)``: for every permutation ``it`` = 1..n_iter the m of the places 0..n-1 that it gives to the first m."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            it, k = np.divmod(b.column("id").to_numpy(), m)
            own, at = np.unique(it, return_inverse=True)
            keys = np.array([round_keys(seed, int(i) + 1) for i in own], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(it + 1), pa.array(shuffled(k, keys[at], n))], names=["it", "g"])

    rows = n_iter * m
    parts = max(1, min(rows // DRAWS_PER_TASK + 1, 100_000))
    return spark.range(0, rows, 1, parts).mapInArrow(run, "it long, g long")


def permutation_differences(samples: DataFrame, n_iter: int = 10000, seed: int = 0) -> DataFrame:
    """``(it, diff)``: median(sample 1) - median(sample 2) of every random relabelling.

    Permutation ``it`` gives the smaller sample's label to m places of the global value order (value, row_id), through a keyed
    bijection of the places (:func:`shuffled`) of its own: any set of m rows can come up.  n_iter * m rows are
    made from a range; no row is joined, hashed or sorted per permutation but these.
    The larger sample's median is read from the global value order: its k-th
    value sits at position k + #{selected i : g_i - i <= k}, where g_i is the
    global position of the i-th selected row.  Medians are (a + b) / 2 of the
    middle values.
    """
    n1, n2 = samples.agg(F.sum(flag(F.col("sample") == 1)), F.sum(flag(F.col("sample") == 2))).first()
    n1, n2 = int(n1 or 0), int(n2 or 0)
    n = n1 + n2
    if n1 == 0 or n2 == 0:
        raise ValueError("both samples need values")
    m = min(n1, n2)
    vals = row_numbers(samples.select("value", "row_id"), [], ["value", "row_id"], out="g").select(
        (F.col("g") - 1).alias("g"), "value")
    chosen = row_numbers(relabellings(samples.sparkSession, n, m, n_iter, seed), ["it"], ["g"], out="i").withColumn("i", F.col("i") - 1)
    # median of the selected set: positions (m-1)//2 and m//2 in its own order; of the rest: its k-th values,
    # k = (r-1)//2 and r//2 with r = n - m
    a, b = (m - 1) // 2, m // 2
    k1, k2 = (n - m - 1) // 2, (n - m) // 2
    t = F.col("g") - F.col("i")
    per_it = chosen.groupBy("it").agg(
        F.max(F.when(F.col("i") == a, F.col("g"))).alias("a"), F.max(F.when(F.col("i") == b, F.col("g"))).alias("b"),
        (F.lit(k1) + F.sum(flag(t <= k1))).alias("c"), (F.lit(k2) + F.sum(flag(t <= k2))).alias("d"))
    for place in "abcd":  # one value per permutation each
        per_it = per_it.join(vals.select(F.col("g").alias(place), F.col("value").alias(f"_{place}")), place)
    rest, own = _median_expr("_c", "_d"), _median_expr("_a", "_b")
    return per_it.select("it", ((own - rest) if n1 <= n2 else (rest - own)).alias("diff"))


def permutation_median(samples: DataFrame, n_iter: int = 10000, seed: int = 0) -> DataFrame:
    """One-sided permutation test of median(sample 1) - median(sample 2): p is the share of the relabellings of
    :func:`permutation_differences` whose difference is >= the observed one."""
    obs = observed_median_difference(samples).select("observed_diff").scalar()
    sizes = samples.agg(F.sum(flag(F.col("sample") == 1)).alias("n1"), F.sum(flag(F.col("sample") == 2)).alias("n2"))
    counted = permutation_differences(samples, n_iter, seed).withColumn("_ge", flag(F.col("diff") >= obs)).agg(
        F.sum("_ge").alias("_ge"), F.count(F.lit(1)).alias("n_iter"))
    return counted.select(
        obs.alias("observed_diff"), (F.col("_ge") / F.lit(float(n_iter))).alias("p_value"), "n_iter",
        sizes.select(F.col("n1").cast("long")).scalar().alias("n1"), sizes.select(F.col("n2").cast("long")).scalar().alias("n2"))


def observed_median_difference(samples: DataFrame) -> DataFrame:
    """median(sample 1) - median(sample 2), medians as (a + b) / 2 of the middle values."""
    ranked = row_numbers(samples.select("sample", "value", "row_id"), ["sample"], ["value", "row_id"], out="i")
    sizes = samples.groupBy("sample").agg(F.count(F.lit(1)).alias("_n"))
    j = ranked.join(sizes, "sample")
    mid = j.groupBy("sample").agg(
        F.max(F.when(F.col("i") == F.floor((F.col("_n") + 1) / 2), F.col("value"))).alias("_a"),
        F.max(F.when(F.col("i") == F.floor(F.col("_n") / 2) + 1, F.col("value"))).alias("_b"))
    med = mid.select("sample", _median_expr("_a", "_b").alias("med"))
    return med.agg((F.max(F.when(F.col("sample") == 1, F.col("med")))
                    - F.max(F.when(F.col("sample") == 2, F.col("med")))).alias("observed_diff"))


def density_curve(samples: DataFrame, grid_size: int = 200, digits: int = 12, reach: float = 3.0) -> DataFrame:
    """Gaussian kernel density of each sample on its own grid, from ``reach`` bandwidths below its smallest value
    to as far above its largest, so that nearly all of the mass is on the grid.

    Bandwidth: Scott's rule, std (ddof 1) * n^(-1/5).  Equal values are counted first; each different value is
    expanded to the grid (values x grid_size, linear) and summed per (sample, grid point) with partial aggregation.
    """
    v = samples.filter(F.col("value").isNotNull())
    per = v.groupBy("sample").agg(F.count(F.lit(1)).alias("_n"), F.stddev_samp("value").alias("_sd"),
                                  F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    per = per.withColumn("_h", F.col("_sd") * F.pow(F.col("_n").cast("double"), F.lit(-0.2)))
    per = per.withColumn("_from", F.col("_lo") - reach * F.col("_h"))
    per = per.withColumn("_step", (F.col("_hi") - F.col("_lo") + 2 * reach * F.col("_h")) / float(grid_size - 1))
    counted = v.groupBy("sample", "value").agg(F.count(F.lit(1)).alias("_c"))
    g = counted.join(per, "sample").select("sample", "value", "_c", "_n", "_h", "_from", "_step",
                                           F.explode(F.sequence(F.lit(0), F.lit(grid_size - 1))).alias("j"))
    g = g.withColumn("x", F.col("_from") + F.col("j") * F.col("_step"))
    term = F.col("_c") * F.exp(-0.5 * F.pow((F.col("x") - F.col("value")) / F.col("_h"), 2))
    dens = g.groupBy("sample", "j", "x", "_n", "_h").agg(F.sum(term).alias("_s"))
    return dens.select("sample", "j", F.round("x", 6).alias("x"), F.round(
        F.col("_s") / (F.col("_n") * F.col("_h") * math.sqrt(2 * math.pi)), digits).alias("density"))
