import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import NODE_SCHEMA, rows
from holdnet.operators import impute, ranks, shares, stats


def nodes(spark):
    return spark.createDataFrame([
        ("A", "G1", "M", 10.0, "s1", "small"), ("B", "G1", "F", 20.0, "s1", "small"),
        ("C", "G1", "F", None, "s2", "large"), ("D", "G2", "F", None, "s2", "small"),
        ("E", "G2", "M", None, "s3", "small"), ("F", "G3", "M", 4.0, "s1", "small"),
        ("X", None, None, None, "s3", "small")], NODE_SCHEMA)


def test_impute_three_levels(spark):
    out = {r["nodo"]: r for r in impute.impute_amount(nodes(spark)).collect()}
    assert out["C"]["importe_sinnone"] == 15.0            # group mean
    assert out["D"]["importe_sinnone"] is None            # all-null group
    assert out["D"]["importe_final"] is None              # sector s2 has no known original amount
    assert out["E"]["importe_final"] is None and out["X"]["importe_final"] is None
    # the last fallback is the mean of importe_final over the rows that have one
    finals = [r["importe_final"] for r in out.values() if r["importe_final"] is not None]
    assert abs(out["D"]["importe_final_sinnulos"] - sum(finals) / len(finals)) < 1e-12
    assert out["A"]["importe_final_sinnulos"] == 10.0


def test_group_amount_share_sums_to_one(spark):
    out = shares.group_amount_share(nodes(spark))
    tot = {r[0]: r[1] for r in out.groupBy("grupo").agg(F.sum("proporcion_importe_sobre_grupo")).collect()}
    assert abs(tot["G1"] - 1.0) < 1e-12 and abs(tot["G3"] - 1.0) < 1e-12
    assert tot["G2"] is None  # zero known amounts: undefined, not an error


def test_quantiles_match_numpy_with_hot_key(spark):
    rnd = random.Random(5)
    data = [("hot", float(rnd.randrange(50))) for _ in range(3000)]
    data += [(f"k{i % 7}", float(rnd.randrange(1000))) for i in range(400)] + [("one", 3.0)]
    df = spark.createDataFrame(data, "k string, v double")
    q = ranks.quantiles(df, ["k"], "v", [0.25, 0.5, 0.75], ["p25", "p50", "p75"])
    got = {r["k"]: (r["p25"], r["p50"], r["p75"]) for r in q.collect()}
    pdf = pd.DataFrame(data, columns=["k", "v"])
    for k, g in pdf.groupby("k"):
        want = np.percentile(g["v"].to_numpy(), [25, 50, 75])
        assert np.allclose(got[k], want), k


@pytest.mark.parametrize("ranked,buckets", [(50_000, 256), (40, 16), (3, 4)])
def test_quantiles_by_refined_histograms(spark, monkeypatch, ranked, buckets):
    monkeypatch.setattr(ranks, "RANKED", ranked)
    monkeypatch.setattr(ranks, "BUCKETS", buckets)
    rnd = random.Random(8)
    groups = {"heavy": [rnd.paretovariate(0.3) for _ in range(500)], "wide": [rnd.uniform(-1, 1) * 10.0 ** rnd.randrange(-200, 300) for _ in range(300)],
              "near": [1.0 + k * 2.0**-52 for k in range(100)], None: [float(rnd.randrange(9)) for _ in range(200)], "same": [7.0] * 50,
              "ends": [-1.7e308, 1.7e308, 0.0, 5.0, 1.0]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs] + [("none", None)], "k string, v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {r["k"]: [r[f"q{i}"] for i in range(6)] for r in ranks.quantiles(df, ["k"], "v", probs, [f"q{i}" for i in range(6)]).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        vs = sorted(vs)
        for p, q in zip(probs, got[k], strict=True):
            at = p * (len(vs) - 1)
            lo, hi = vs[math.floor(at)], vs[math.ceil(at)]
            assert q == pytest.approx(lo + (hi - lo) * (at - math.floor(at)), rel=1e-12), (k, p)


def test_running_sums_match_pandas(spark):
    rnd = random.Random(9)
    data = [(rnd.choice(["a", "a", "a", "b", None]), i, rnd.randrange(10)) for i in range(2000)]
    df = spark.createDataFrame(data, "k string, o long, w long")
    out = ranks.running_sums(df, ["k"], ["o"], {"cs": "w"}, blocks=7)
    got = {r["o"]: r["cs"] for r in out.collect()}
    pdf = pd.DataFrame(data, columns=["k", "o", "w"]).fillna({"k": "<null>"}).sort_values("o")
    pdf["cs"] = pdf.groupby("k")["w"].cumsum()
    assert got == dict(zip(pdf["o"], pdf["cs"]))
    rn = ranks.row_numbers(df, [], ["o"], out="rn")
    assert all(r["rn"] == r["o"] + 1 for r in rn.collect())


def test_group_stats_and_below_shares(spark):
    imp = impute.impute_amount(nodes(spark))
    st = stats.group_amount_stats(imp)
    got = {r["grupo"]: r for r in st.collect()}
    # G1 amounts after the group fill: 10, 20, 15
    assert got["G1"]["p25"] == 12.5 and got["G1"]["p50"] == 15.0 and got["G1"]["importe_sinnone_matriz"] == 10.0
    assert got["G3"]["std"] is None and got["G3"]["count"] == 1
    feats = {r["nodo"]: r for r in stats.node_features(imp).collect()}
    # G1: one member (A = 10) below p25 = 12.5, divided by members - 1 = 2
    assert feats["A"]["porcentaje_fact_menor_percentil_25"] == 0.5
    assert feats["F"]["porcentaje_fact_menor_percentil_25"] == 0.0   # single member: 0/0 -> 0
    assert "X" not in feats


def test_group_with_two_parents_gives_two_stat_rows(spark):
    df = spark.createDataFrame([("P", "G", "M", 1.0, "s", "small"), ("Q", "G", "M", 3.0, "s", "small")], NODE_SCHEMA)
    st = stats.group_amount_stats(impute.impute_amount(df))
    assert rows(st, "grupo", "importe_sinnone_matriz") == [("G", 1.0), ("G", 3.0)]
