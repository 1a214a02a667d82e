"""Tree SHAP against enumeration of all feature sets on MLlib's own trees."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from holdnet.operators import models, tree_shap

FEATURES = ["a", "b", "c", "d"]


def rows(spark, n=400, seed=3):
    rnd = random.Random(seed)
    data = []
    for k in range(n):
        x = [rnd.gauss(0, 1), rnd.random(), float(rnd.randrange(4)), rnd.gauss(0, 2)]
        p = 1 / (1 + math.exp(-(x[0] + (x[1] > 0.5) * (x[2] - 1.5) + 0.3 * x[3])))
        data.append((f"n{k}", *x, rnd.choice(["u", "v", "w", None]), int(rnd.random() < p)))
    return spark.createDataFrame(data, "nodo string, a double, b double, c double, d double, kind string, matriz_filia_binaria int")


def fitted(df, est, features=FEATURES):
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"),
                            est.setFeaturesCol("features").setLabelCol("matriz_filia_binaria")]).fit(df)


def worth(nodes, k, x, known):
    """Mean of the tree below node k over its training rows, features in ``known`` taken from x."""
    node = nodes[k]
    stats = node["impurityStats"]
    if node["leftChild"] < 0:
        return stats[1] / sum(stats)
    split, f = node["split"], node["split"]["featureIndex"]
    cut = split["leftCategoriesOrThreshold"]
    if f in known:
        left = x[f] in cut if split["numCategories"] >= 0 else x[f] <= cut[0]
        return worth(nodes, node["leftChild"] if left else node["rightChild"], x, known)
    return sum(sum(nodes[c]["impurityStats"]) * worth(nodes, c, x, known) for c in (node["leftChild"], node["rightChild"])) / sum(stats)


def by_enumeration(trees, x, players):
    def value(known):
        known = set(itertools.chain.from_iterable(players[p] for p in known))
        return np.mean([worth(nodes, 0, x, known) for nodes in trees.values()])
    n = len(players)
    out = []
    for j in range(n):
        rest = [p for p in range(n) if p != j]
        out.append(sum(math.factorial(s) * math.factorial(n - s - 1) / math.factorial(n) * (value({*known, j}) - value(known))
                       for s in range(n) for known in itertools.combinations(rest, s)))
    return out


@pytest.mark.parametrize("est", [
    lambda: DecisionTreeClassifier(maxDepth=5, minInstancesPerNode=3), lambda: DecisionTreeClassifier(maxDepth=12),
    lambda: RandomForestClassifier(numTrees=7, maxDepth=4, seed=5, featureSubsetStrategy="sqrt")])
def test_equal_to_enumeration_of_all_sets(spark, est, monkeypatch):
    df = rows(spark).cache()
    model = fitted(df, est())
    trees = tree_shap.node_rows(model.stages[-1])
    ones = {f: 1 for f in FEATURES}
    got = {}
    for r in tree_shap.tree_shap(model, df, FEATURES, ones, keep=["nodo"]).collect():
        got.setdefault(r["nodo"], {})[r["feature"]] = r["shap"]
        got[r["nodo"]]["score"], got[r["nodo"]]["base"] = r["score"], r["base"]
    scores = {r["nodo"]: r["score"] for r in models.predict("tree", model, df).collect()}
    for r in df.limit(40).collect():
        own = got[r["nodo"]]
        want = by_enumeration(trees, [r[f] for f in FEATURES], [[k] for k in range(4)])
        assert np.allclose([own[f] for f in FEATURES], want, atol=1e-12)
    assert all(abs(g["score"] - scores[k]) < 1e-12 for k, g in got.items()) and len(got) == 400
    assert all(abs(g["base"] + sum(g[f] for f in FEATURES) - g["score"]) < 1e-12 for g in got.values())
    monkeypatch.setattr(tree_shap, "TABLE_FEATURES", 0)  # patterns of the batch instead of tables of all patterns
    again = {(r["nodo"], r["feature"]): r["shap"] for r in tree_shap.tree_shap(model, df, FEATURES, ones, keep=["nodo"]).collect()}
    assert all(abs(again[k, f] - g[f]) < 1e-12 for k, g in got.items() for f in FEATURES)


def test_categories_count_as_one_feature_and_add_up(spark):
    df = models.encode_categories(rows(spark), ["kind"]).withColumn("conjunto", F.lit("test")).cache()
    feats = models.feature_columns(df)
    assert feats == [*FEATURES, "kind_vec"]
    model = fitted(df, RandomForestClassifier(numTrees=9, maxDepth=5, seed=2), feats)
    got = models.shap_values(df, model)
    per_row = got.groupBy("nodo").agg(F.sum("shap").alias("s"), F.first("base").alias("b"), F.first("score").alias("p"), F.count("*").alias("n"))
    own = {r["nodo"]: r["score"] for r in models.predict("forest", model, df).collect()}
    assert all(r["n"] == 5 and abs(r["b"] + r["s"] - own[r["nodo"]]) < 1e-12 and abs(r["p"] - own[r["nodo"]]) < 1e-12 for r in per_row.collect())
    assert got.filter("feature = 'kind_vec' and abs(shap) > 0").count() > 0


def test_one_class_and_no_rows(spark):
    df = rows(spark).filter("matriz_filia_binaria = 0").cache()
    model = fitted(df, DecisionTreeClassifier())
    ones = {f: 1 for f in FEATURES}
    got = tree_shap.tree_shap(model, df, FEATURES, ones)
    assert got.filter("shap <> 0 or base <> 0 or score <> 0").count() == 0 and got.count() == 4 * df.count()
    assert tree_shap.tree_shap(model, df.limit(0), FEATURES, ones).count() == 0
