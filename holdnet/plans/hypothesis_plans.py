"""Parents vs subsidiaries: Mann-Whitney U, permutation test of medians, kernel densities."""

from __future__ import annotations

import math

from holdnet.operators import hypothesis
from holdnet.plans.catalog import register
from holdnet.sources import fixtures as fx

N_ITER = 10000
SEED = 0
GRID = 200

SAMPLES_SQL = ("smp", """
SELECT CASE WHEN ind_filial_matriz = 'M' THEN 1 ELSE 2 END AS sample, CAST(importe AS DOUBLE) AS value, nodo AS row_id
FROM nodos WHERE importe IS NOT NULL AND ind_filial_matriz IN ('M', 'F')""")


#: Tail of the normal density by Simpson's rule from z to z + 12 in steps of 1/2000.
P_SQL = """
SELECT m.*, least(1.0, 2 * (SELECT sum((CASE WHEN k = 0 OR k = 24000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END)
                                       * exp(-0.5 * pow(m.z + k / 2000.0, 2)))
                            FROM (SELECT CAST(range AS DOUBLE) AS k FROM range(0, 24001)) t) / 6000.0 / sqrt(2 * pi())) AS p
FROM mw_z m"""

MW_SQL = [SAMPLES_SQL, ("mw_cnt", """
SELECT value, count(*) AS c, sum(CASE WHEN sample = 1 THEN 1 ELSE 0 END) AS c1 FROM smp GROUP BY value"""),
    ("mw_cum", "SELECT value, c, c1, sum(c) OVER (ORDER BY value ROWS UNBOUNDED PRECEDING) AS e FROM mw_cnt"),
    ("mw_u", """
SELECT CAST(two_r1 - CAST(n1 AS HUGEINT) * (n1 + 1) AS DOUBLE) / 2 AS u1, n1, n - n1 AS n2, CAST(n AS DOUBLE) AS nn, CAST(ties AS DOUBLE) AS tt FROM (
  SELECT CAST(sum(CAST(c1 AS HUGEINT) * (2 * (e - c) + c + 1)) AS HUGEINT) AS two_r1, CAST(sum(c1) AS BIGINT) AS n1,
         CAST(sum(c) AS BIGINT) AS n, CAST(sum(CAST(c AS HUGEINT) * c * c - c) AS HUGEINT) AS ties FROM mw_cum) a"""),
    ("mw_z", """
SELECT u.*, (abs(u1 - CAST(n1 AS DOUBLE) * CAST(n2 AS DOUBLE) / 2) - 0.5)
            / sqrt(CAST(n1 AS DOUBLE) * CAST(n2 AS DOUBLE) / 12 * ((nn + 1) - tt / (nn * (nn - 1)))) AS z FROM mw_u u"""),
    ("mw_p", P_SQL)]


@register("mann_whitney", """
SELECT u1, n1, n2, round(z, 10) AS z, round(p, 10) AS p_value,
       CASE WHEN p > 0.05 THEN 'same_distribution' ELSE 'different_distribution' END AS verdict FROM mw_p""", MW_SQL)
def q_mann_whitney(spark, sf_dir):
    return hypothesis.mann_whitney(fx.samples(fx.nodos(spark, sf_dir)))


KEY_NAMES = [f"k{r}{j}" for r in range(hypothesis.ROUNDS) for j in range(3)]
KEYS_SQL = ", ".join(f"CAST('0x' || substr(md5(concat('{SEED}:', CAST(range AS VARCHAR), ':{r}')), {1 + 7 * j}, 7) AS BIGINT) AS k{r}{j}"
                     for r in range(hypothesis.ROUNDS) for j in range(3))


def _rounds_sql() -> str:
    """The rounds of the keyed permutation as nested selects over the places that are not settled yet."""
    sql = "(SELECT *, place // wide AS hi, place % wide AS lo FROM walk WHERE tries = 0 OR place >= n)"
    for r in range(hypothesis.ROUNDS):
        of, to, by = ("lo", "hi", "high") if r % 2 == 0 else ("hi", "lo", "wide")
        t = f"(({of} * k{r}0 + k{r}1) % {hypothesis.PRIME})"
        sql = f"(SELECT * REPLACE (({to} + ({t} * {t} + k{r}2) % {hypothesis.PRIME}) % {by} AS {to}) FROM {sql} r{r})"
    return sql


ROUNDS_SQL = _rounds_sql()
PERM_SQL = [SAMPLES_SQL, ("size", "SELECT count(*) AS n, least(sum(CASE WHEN sample = 1 THEN 1 ELSE 0 END), "
             "sum(CASE WHEN sample = 2 THEN 1 ELSE 0 END)) AS m FROM smp"),
            ("its", f"""
SELECT range AS it, n, CAST(m AS BIGINT) AS m, high, CAST(ceil(n / CAST(high AS DOUBLE)) AS BIGINT) AS wide, {KEYS_SQL}
FROM range(1, {N_ITER + 1}), (SELECT n, m, CAST(ceil(sqrt(n)) AS BIGINT) AS high FROM size) s"""),
            ("walk", f"""
SELECT it, range AS k, range AS place, 0 AS tries, its.* EXCLUDE (it) FROM its, LATERAL (SELECT range FROM range(0, (SELECT max(m) FROM its))) ks
UNION ALL SELECT it, k, hi * wide + lo, tries + 1, n, m, high, wide, {', '.join(KEY_NAMES)} FROM {ROUNDS_SQL} t"""),
            ("base", """
SELECT value, row_id, sample, ROW_NUMBER() OVER (ORDER BY value, row_id) - 1 AS place FROM smp"""),
            ("picked", "SELECT it, place FROM walk WHERE tries > 0 AND place < n"),
            ("perm", """
SELECT i.it, s.value, s.row_id, CASE WHEN p.place IS NULL THEN 0 ELSE 1 END AS chosen
FROM its i CROSS JOIN base s LEFT JOIN picked p ON p.it = i.it AND p.place = s.place"""),
            ("lab", """
SELECT it, value, row_id,
       CASE WHEN chosen = CASE WHEN (SELECT count(*) FROM smp WHERE sample = 1) = (SELECT m FROM size) THEN 1 ELSE 0 END
            THEN 1 ELSE 2 END AS lab
FROM perm"""),
            ("rk", """
SELECT it, lab, value, ROW_NUMBER() OVER (PARTITION BY it, lab ORDER BY value, row_id) AS i,
       count(*) OVER (PARTITION BY it, lab) AS n FROM lab"""),
            ("med", """
SELECT it, lab, (max(CASE WHEN i = (n + 1) // 2 THEN value END) + max(CASE WHEN i = n // 2 + 1 THEN value END)) / 2 AS m
FROM rk GROUP BY it, lab"""),
            ("diffs", """
SELECT it, max(CASE WHEN lab = 1 THEN m END) - max(CASE WHEN lab = 2 THEN m END) AS diff FROM med GROUP BY it"""),
            ("obs_rk", """
SELECT sample, value, ROW_NUMBER() OVER (PARTITION BY sample ORDER BY value, row_id) AS i,
       count(*) OVER (PARTITION BY sample) AS n FROM smp"""),
            ("obs", """
SELECT max(CASE WHEN sample = 1 THEN m END) - max(CASE WHEN sample = 2 THEN m END) AS d FROM (
  SELECT sample, (max(CASE WHEN i = (n + 1) // 2 THEN value END) + max(CASE WHEN i = n // 2 + 1 THEN value END)) / 2 AS m
  FROM obs_rk GROUP BY sample) t""")]


@register("permutation_median", f"""
SELECT (SELECT d FROM obs) AS observed_diff,
       CAST(sum(CASE WHEN diff >= (SELECT d FROM obs) THEN 1 ELSE 0 END) AS DOUBLE) / {float(N_ITER)!r} AS p_value,
       count(*) AS n_iter,
       (SELECT count(*) FROM smp WHERE sample = 1) AS n1, (SELECT count(*) FROM smp WHERE sample = 2) AS n2
FROM diffs""", PERM_SQL)
def q_permutation_median(spark, sf_dir):
    return hypothesis.permutation_median(fx.samples(fx.nodos(spark, sf_dir)), n_iter=N_ITER, seed=SEED)


@register("permutation_differences", "SELECT it, diff FROM diffs", PERM_SQL)
def q_permutation_differences(spark, sf_dir):
    return hypothesis.permutation_differences(fx.samples(fx.nodos(spark, sf_dir)), n_iter=N_ITER, seed=SEED)


@register("density_curve", f"""
SELECT p.sample, p.j, round(p.x, 6) AS x,
       round(sum(exp(-0.5 * pow((p.x - v.value) / p.h, 2))) / (p.n * p.h * {math.sqrt(2 * math.pi)!r}), 12) AS density
FROM (SELECT per.sample, g.j, per.lo - 3.0 * per.h + g.j * ((per.hi - per.lo + 6.0 * per.h) / {float(GRID - 1)!r}) AS x, per.n, per.h
      FROM (SELECT sample, count(*) AS n, stddev_samp(value) * pow(CAST(count(*) AS DOUBLE), -0.2) AS h,
                   min(value) AS lo, max(value) AS hi
            FROM smp GROUP BY sample) per,
           (SELECT CAST(range AS INT) AS j FROM range(0, {GRID})) g) p
JOIN smp v ON v.sample = p.sample
GROUP BY p.sample, p.j, p.x, p.n, p.h""", [SAMPLES_SQL])
def q_density_curve(spark, sf_dir):
    return hypothesis.density_curve(fx.samples(fx.nodos(spark, sf_dir)), grid_size=GRID)
