import functools
import math
import random

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from holdnet import session
from holdnet.operators import evaluate, kernel_svm, models


def dense(kernel, x, y, c, to, tol=1e-9):
    """Margins of a dense dual solution for the rows ``to``, and the multipliers: plain pairwise steps until nothing violates."""
    k, a = kernel(x, x), np.zeros(len(y))
    for _ in range(200_000):
        error = y - k @ (a * y)
        up, low = np.where(y > 0, a < c, a > 0), np.where(y > 0, a > 0, a < c)
        i, j = np.where(up, error, -np.inf).argmax(), np.where(low, error, np.inf).argmin()
        if error[i] - error[j] < tol:
            break
        t = min((error[i] - error[j]) / max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12),
                c - a[i] if y[i] > 0 else a[i], a[j] if y[j] > 0 else c - a[j])
        a[i], a[j] = np.clip(a[i] + y[i] * t, 0, c), np.clip(a[j] - y[j] * t, 0, c)
    free = (a > 1e-9) & (a < c - 1e-9)
    bias = error[free].mean() if free.any() else (error[i] + error[j]) / 2
    return kernel(to, x) @ (a * y) + bias, a


def separable(spark, n=240, seed=4):
    rnd = random.Random(seed)
    data = []
    for i in range(n):
        y = 1 if i % 4 == 0 else 0
        x1 = rnd.gauss(3.0 if y else 0.0, 0.7)
        x2 = rnd.gauss(0.0, 1.0)
        data.append((f"n{i}", f"G{i % 12}", "train" if (i // 4) % 5 < 4 else "test", float(x1), float(x2), y))
    return spark.createDataFrame(data, "nodo string, grupo string, conjunto string, x1 double, x2 double, "
                                       "matriz_filia_binaria int")


def test_models_learn_a_separable_target(spark):
    df = separable(spark).cache()
    assert models.feature_columns(df) == ["x1", "x2"]
    for name in ("logistic", "tree", "forest"):
        preds = models.fit_and_predict(name, df)
        auc = evaluate.roc_auc(preds).first()["auc"]
        assert auc > 0.9, (name, auc)


def test_svm_grid_candidates_and_probabilities(spark):
    df = separable(spark).cache()
    train = df.filter(F.col("conjunto") == "train")
    model = models.fit_svm_grid(train.coalesce(1), ["x1", "x2"], folds=2)
    assert set(model.cv_scores) == {"linear_C1", "linear_C10", "rbf_C1", "rbf_C10"}
    preds = models.predict("svm_grid", model, df.filter(F.col("conjunto") == "test"))
    assert evaluate.roc_auc(preds).first()["auc"] > 0.9
    p = preds.agg(F.min("score"), F.max("score")).first()
    assert 0.0 <= p[0] <= p[1] <= 1.0


def test_saved_model_predicts_the_same(spark, tmp_path):
    df = separable(spark).cache()
    train = df.filter(F.col("conjunto") == "train")
    model = models.fit("logistic", train, ["x1", "x2"])
    path = str(tmp_path / "logistic")
    model.write().overwrite().save(path)
    a = {r["nodo"]: r["score"] for r in models.predict("logistic", model, df).collect()}
    b = {r["nodo"]: r["score"] for r in models.predict("logistic", PipelineModel.load(path), df).collect()}
    assert a == b


def values(df, cols):
    return np.array([[r[c] for c in cols] for r in df.select(*cols).collect()], dtype=float)


def test_logistic_matches_newton_solution(spark):
    train = separable(spark).filter("conjunto = 'train'").cache()
    x, y = values(train, ["x1", "x2"]), values(train, ["matriz_filia_binaria"])[:, 0]
    z = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.diag([1.0, 1.0, 0.0])  # C = 1: the sum of losses plus |w|^2 / 2
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge, z.T @ (p - y) + ridge @ w)
    model = models.fit("logistic", train, ["x1", "x2"]).stages[-1]
    assert np.allclose([*model.coefficients, model.intercept], w, atol=1e-3)


def test_tree_splits_exactly(spark):
    rnd = random.Random(2)
    data = [(f"n{k}", "G", "train", rnd.random(), 0.0, 0) for k in range(300)]
    data = [(a, b, c, x, e, int(x > 0.4217)) for a, b, c, x, e, _ in data]
    df = spark.createDataFrame(data, "nodo string, grupo string, conjunto string, x1 double, x2 double, matriz_filia_binaria int")
    tree = models.fit("tree", df, ["x1"]).stages[-1]
    below = max(x for *_, x, _, y in data if y == 0)
    above = min(x for *_, x, _, y in data if y == 1)
    assert tree.numNodes == 3 and below <= tree._call_java("rootNode").split().threshold() <= above


def test_tree_splits_exactly_between_thousands_of_values(spark):
    """Root and both children against the best Gini split over all gaps between different values."""
    rnd = random.Random(12)
    x = [(rnd.random(), rnd.gauss(0, 1)) for _ in range(3000)]
    y = [int(rnd.random() < (0.8 if 0.31 < a < 0.65 else 0.3) + (0.15 if b > 0.7 else 0)) for a, b in x]
    df = spark.createDataFrame([(f"n{k}", "G", "train", *v, c) for k, (v, c) in enumerate(zip(x, y, strict=True))],
                               "nodo string, grupo string, conjunto string, x1 double, x2 double, matriz_filia_binaria int")
    root = models.fit("tree", df, ["x1", "x2"]).stages[-1]._call_java("rootNode")

    def best(rows):
        found = []
        for f in range(2):
            order = sorted(rows, key=lambda r: x[r][f])
            ones, total = np.cumsum([y[r] for r in order]), sum(y[r] for r in order)
            n = np.arange(1, len(order) + 1)
            right_n, right_ones = len(order) - n, total - ones
            with np.errstate(divide="ignore", invalid="ignore"):
                impurity = ones * (1 - ones / n) + np.where(right_n > 0, right_ones * (1 - right_ones / right_n), 0)
            k = int(np.argmin(impurity[:-1]))
            found.append((impurity[k], f, x[order[k]][f], x[order[k + 1]][f]))
        return min(found)

    todo = [(root, list(range(3000)))]
    for node, rows in todo:
        _, f, below, above = best(rows)
        split = node.split()
        assert split.featureIndex() == f and below <= split.threshold() <= above
        if node is root:
            todo += [(node.leftChild(), [r for r in rows if x[r][f] <= below]), (node.rightChild(), [r for r in rows if x[r][f] > below])]


def test_own_prediction_is_passed_on(spark):
    # a leaf of one row of each class: the tree says 0, a threshold of 0.5 on its probability would say 1
    df = spark.createDataFrame([(f"n{k}", "G", "train", 1.0, 1.0, k % 2) for k in range(10)],
                               "nodo string, grupo string, conjunto string, x1 double, x2 double, matriz_filia_binaria int")
    preds = models.predict("tree", models.fit("tree", df, ["x1"]), df).collect()
    assert {(r["score"], r["prediction"]) for r in preds} == {(0.5, 0)}


@pytest.mark.parametrize("name", ["logistic", "tree", "forest", "svm_grid"])
def test_one_class_of_training_rows(spark, name, monkeypatch):
    monkeypatch.setattr(models, "FOREST_TREES", 5)
    df = separable(spark).filter("matriz_filia_binaria = 0")
    preds = models.predict(name, models.fit(name, df, ["x1", "x2"]), df)
    assert preds.filter("prediction <> 0 or score > 0.01").count() == 0


def test_stratified_folds(spark):
    df = separable(spark)
    per = models.stratified_folds(df, "matriz_filia_binaria", 5, 7).groupBy("_fold", "matriz_filia_binaria").count().collect()
    for y, n in ((0, 180), (1, 60)):
        assert sorted(r["count"] for r in per if r["matriz_filia_binaria"] == y) == [n // 5] * 5


def test_svm_prediction_is_the_margin_sign(spark):
    train = separable(spark).filter("conjunto = 'train'").cache()
    model = models.fit_svm_grid(train.coalesce(1), ["x1", "x2"], folds=2, cs=(1.0,))
    out = model.transform(train).select("margin", "prediction").collect()
    assert all((r["margin"] > 0) == (r["prediction"] == 1.0) for r in out)


def test_grid_accuracies_are_those_of_separate_fits(spark):
    """Every (candidate, fold) fit solved on its own by a dense solver on the driver."""
    train = separable(spark, n=100, seed=9).filter("conjunto = 'train'").cache()
    model = models.fit_svm_grid(train, ["x1", "x2"], folds=2)
    rows = models.stratified_folds(train, models.LABEL, 2, models.SVM_SEED).select("x1", "x2", "_fold", models.LABEL).collect()
    x, fold = np.array([[r["x1"], r["x2"]] for r in rows]), np.array([r["_fold"] for r in rows])
    x, y = (x - x.mean(axis=0)) / x.std(axis=0), np.array([1 if r[models.LABEL] else -1 for r in rows])
    for c in (1.0, 10.0):
        for name in ("linear", "rbf"):
            rights = []
            for f in range(2):
                a, b = x[fold != f], x[fold == f]
                kernel = kernel_svm.Kernel(name, 1 / (2 * a.var()))
                margin, _ = dense(kernel, a, y[fold != f], c, b)
                rights.append(np.mean((margin > 0) == (y[fold == f] > 0)))
            assert math.isclose(model.cv_scores[f"{name}_C{c:g}"], np.mean(rights), abs_tol=1e-12)


def test_probabilities_on_noise_are_no_worse_than_the_constant(spark):
    rnd = random.Random(8)
    data = [(f"n{k}", "G", "train" if k < 300 else "test", *[rnd.gauss(0, 1) for _ in range(6)], int(rnd.random() < 0.3)) for k in range(900)]
    df = spark.createDataFrame(data, "nodo string, grupo string, conjunto string, " + ", ".join(f"x{k} double" for k in range(6)) +
                               ", matriz_filia_binaria int")
    model = models.fit_svm_grid(df.filter("conjunto = 'train'"), [f"x{k}" for k in range(6)], cs=(10.0,))
    held = models.predict("svm_grid", model, df.filter("conjunto = 'test'")).collect()
    loss = -np.mean([math.log(r["score"] if r["label"] else 1 - r["score"]) for r in held])
    base = np.mean([r[-1] for r in data if r[2] == "train"])
    constant = -np.mean([math.log(base if r["label"] else 1 - base) for r in held])
    assert loss < constant + 0.02


def test_saved_models_predict_the_same(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(models, "FOREST_TREES", 5)
    quick = functools.partial(models.fit_svm_grid, folds=2, cs=(1.0,))
    monkeypatch.setattr(models, "fit_svm_grid", quick)
    df = separable(spark, n=100).coalesce(1).cache()
    kept = {(r["modelo"], r["nodo"]): (r["score"], r["prediction"]) for r in models.save_models(df, str(tmp_path / "m")).collect()}
    fresh = {(r["modelo"], r["nodo"]): (r["score"], r["prediction"]) for r in models.fit_all(df).collect()}
    assert set(kept) == set(fresh) and {m for m, _ in kept} == set(models.MODEL_NAMES)
    for k, (s, p) in fresh.items():
        assert kept[k][1] == p and math.isclose(kept[k][0], s, abs_tol=1e-6)


def test_evaluate_models_of_any_name(spark):
    rows = [("logistic", 1, 0.9, 1), ("logistic", 0, 0.2, 0), ("mine", 1, 0.4, 0), ("mine", 0, 0.6, 1), ("mine", 0, 0.1, 0)]
    got = {(r["modelo"], r["metrica"], r["clase"]): r["valor"] for r in models.evaluate_models(
        spark.createDataFrame(rows, "modelo string, label int, score double, prediction int")).collect()}
    assert {m for m, *_ in got} == {"logistic", "mine"}
    assert got["mine", "auc", "all"] == 0.5 and got["logistic", "auc", "all"] == 1.0
    assert got["mine", "confusion", "1_0"] == 1 and got["mine", "support", "0"] == 2 and got["logistic", "f1", "accuracy"] == 1.0


def test_learning_curve_sizes_and_valid_splits(spark):
    df = separable(spark, n=60).coalesce(1)
    got = models.learning_curve(df, "tree", sizes=(0.1, 1.0), n_splits=3).collect()
    assert sorted((r["size"], r["n_train"], r["split"]) for r in got) == [(s, k, i) for s, k in ((0.1, 3), (1.0, 30)) for i in range(3)]
    for size in (0.1, 1.0):
        part = [r for r in got if r["size"] == size]
        known = [r["train_auc"] for r in part if r["train_auc"] is not None]
        assert {r["train_valid"] for r in part} == {len(known)}
        assert part[0]["train_mean"] is None if not known else math.isclose(part[0]["train_mean"], sum(known) / len(known))


def test_learning_curve_keeps_predictions_as_one_table(spark, monkeypatch):
    """Predictions (a row per fit and company) are Parquet, not a checkpoint of rows."""
    labels = []
    monkeypatch.setattr(models, "written", lambda df, label="table": labels.append((label, df.count())) or session.written(df, label), raising=False)
    got = models.learning_curve(separable(spark, n=60).coalesce(1), "tree", sizes=(0.5, 1.0), n_splits=2).collect()
    assert len(got) == 4 and labels == [("predictions", 2 * (15 + 30) + 4 * 30)]


def test_importance_of_a_constant_feature_is_zero(spark):
    df = separable(spark).withColumn("x3", F.lit(1.0)).cache()
    df = models.encode_categories(df.withColumn("kind", F.when(F.col("x2") > 0, "a").when(F.col("x2") < -1, "b")), ["kind"])
    feats = models.feature_columns(df)
    assert feats == ["x1", "x2", "x3", "kind_vec"]
    model = models.build("tree", 1, feats).fit(df.filter("conjunto = 'train'"))
    got = {r["feature"]: r for r in models.feature_importance(df, model, "tree").collect()}
    assert got["x3"]["importance"] == 0.0 and got["x3"]["permutation_auc_drop"] == 0.0
    assert got["x1"]["importance"] > 0.5 and got["x1"]["permutation_auc_drop"] > 0.1


def test_wide_categories(spark):
    df = spark.createDataFrame([(f"n{k}", f"v{k}" if k else None) for k in range(1501)], "nodo string, sector string")
    from holdnet.operators import split
    assert len(split.one_hot(df, ["sector"]).columns) == 1501
    out = models.encode_categories(df, ["sector"]).collect()
    assert {r["sector_vec"].size for r in out} == {1500}
    assert sum(r["sector_vec"].numNonzeros() == 0 for r in out) == 1


def test_fits_of_a_learning_curve_run_few_tasks_each(spark, monkeypatch):
    """Fits that run side by side need no small partitions: each iteration of each fit is a task per partition."""
    n, built, seen = 6_000, models.build, []

    class Spy:
        def __init__(self, pipeline):
            self.pipeline = pipeline

        def fit(self, df):
            seen.append(df.rdd.getNumPartitions())
            return self.pipeline.fit(df)

    monkeypatch.setattr(models, "build", lambda *a: Spy(built(*a)))
    df = spark.range(n).select(F.concat(F.lit("C"), F.col("id")).alias("nodo"), (F.col("id") % 2).cast("int").alias(models.LABEL),
                               *[(F.col("id") % (k + 3)).cast("double").alias(f"x{k}") for k in range(8)])
    out = models.learning_curve(df, sizes=(1.0,), n_splits=2).collect()
    assert seen == [1, 1] and [r.n_train for r in out] == [n // 2] * len(out)
    assert n * 8 * 8 > models.PARTITION_BYTES
