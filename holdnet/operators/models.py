"""Parent classifiers on MLlib: logistic regression, decision tree, random forest, SVM grid search.

Settings follow the reference's scikit-learn defaults where MLlib can express
them: L2 logistic with C = 1 (regParam = 1 / n, no standardisation), a deep
tree (MLlib caps depth at 30), 500 trees of depth 3 with seed 123 and sqrt
feature sampling, and a scaled SVM searched over kernel {linear, rbf} x C {1, 10}
with 5 stratified folds by accuracy, refit, and probabilities by a logistic (Platt)
fit on the out-of-fold margins.  MLlib has only linear SVMs; ``kernel_svm`` solves
the dual with exact kernels.  Every model's own prediction is passed on: a tree's
majority class, the sign of the SVM's margin.
"""

from __future__ import annotations

import json
import math
from concurrent.futures import ThreadPoolExecutor
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, LogisticRegression, LogisticRegressionModel,
                                       RandomForestClassifier)
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StandardScalerModel, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdnet.functions import flag
from holdnet.operators import evaluate, kernel_svm, tree_shap
from holdnet.operators.ranks import row_numbers
from holdnet.session import pin, written

LABEL = "matriz_filia_binaria"
SPLIT = "conjunto"
ID = "nodo"
NON_FEATURES = {ID, "grupo", SPLIT, LABEL}
#: Fixed values of the models: names, forest size and depth, seeds, depth of the tree (MLlib's limit).
MODEL_NAMES = ["logistic", "tree", "forest", "svm_grid"]
FOREST_TREES, FOREST_DEPTH, TREE_SEED, TREE_DEPTH, SVM_SEED = 500, 3, 123, 30, 7
#: Most candidate split points per feature of the tree: it splits exactly while a feature has no more different values.
MAX_BINS = 1 << 17
#: Bytes of features in a partition of a table that is fitted.
PARTITION_BYTES = 1 << 18
#: The same where many fits run side by side and fill the cluster together.
TOGETHER_BYTES = 1 << 22


def feature_columns(df: DataFrame) -> list[str]:
    """Numeric and vector columns that are not keys, split or target."""
    kinds = ("int", "bigint", "double", "float", "smallint", "tinyint", "vector")
    return [c for c, t in df.dtypes if c not in NON_FEATURES and t in kinds]


def encode_categories(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Replace categorical columns by sparse dummy vectors ``<col>_vec`` of any width; null gives all zeros."""
    idx = category_cast(df, cols)
    hot = OneHotEncoder(inputCols=[f"{c}_idx" for c in cols], outputCols=[f"{c}_vec" for c in cols], dropLast=True)
    return hot.fit(idx).transform(idx).drop(*cols, *[f"{c}_idx" for c in cols])  # the last index stands for null


def category_cast(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Index categorical columns (most frequent value first, ties alphabetical); unseen -> extra index."""
    idx = StringIndexer(inputCols=list(cols), outputCols=[f"{c}_idx" for c in cols],
                        handleInvalid="keep", stringOrderType="frequencyDesc")
    return idx.fit(df).transform(df)


def _assembler(features: Sequence[str], out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="keep")


def _prob1(col: str = "probability"):
    """Probability of class 1; 0 if the training rows had class 0 only."""
    return F.coalesce(F.get(vector_to_array(F.col(col)), F.lit(1)), F.lit(0.0))


def _train_test(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.filter(F.col(SPLIT) == "train"), df.filter(F.col(SPLIT) == "test")


class SvmGridModel:
    """Scaler + kernel SVM (support vectors, weights, offset) chosen by 5-fold accuracy + Platt probabilities."""

    def __init__(self, features, scaler, factor, kernel, support, bias, platt, cv_scores):
        self.features, self.scaler, self.factor, self.kernel = list(features), scaler, factor, kernel
        self.support, self.bias, self.platt, self.cv_scores = support, bias, platt, cv_scores

    def _margin_frame(self, df: DataFrame) -> DataFrame:
        x = _scaled(self.scaler, self.factor, _assembler(self.features, "raw").transform(df))
        m = kernel_svm.decision(x, "scaled", self.support, self.kernel, self.bias, "margin")
        return _assembler(["margin"], "margin_vec").transform(m)

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``margin``, ``probability`` and ``prediction`` (the margin's sign, as the reference's classifier has it)."""
        out = self.platt.transform(self._margin_frame(df)).drop("prediction", "rawPrediction", "margin_vec", "raw", "scaled")
        return out.withColumn("prediction", flag(F.col("margin") > 0).cast("double"))

    def save(self, path: str) -> None:
        self.scaler.write().overwrite().save(f"{path}/scaler")
        self.support.write.mode("overwrite").parquet(f"{path}/support")
        self.platt.write().overwrite().save(f"{path}/platt")
        meta = {"features": self.features, "factor": self.factor, "kernel": self.kernel.name, "gamma": self.kernel.gamma,
                "bias": self.bias, "cv_scores": self.cv_scores}
        spark = self.support.sparkSession
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @classmethod
    def load(cls, path: str) -> SvmGridModel:
        from pyspark.sql import SparkSession
        spark = SparkSession.getActiveSession()
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        return cls(meta["features"], StandardScalerModel.load(f"{path}/scaler"), meta["factor"],
                   kernel_svm.Kernel(meta["kernel"], meta["gamma"]), spark.read.parquet(f"{path}/support"), meta["bias"],
                   LogisticRegressionModel.load(f"{path}/platt"), meta["cv_scores"])


def _scaled(scaler, factor: float, df: DataFrame) -> DataFrame:
    """``scaled``: array of the inputs in units of their population deviation (MLlib's scaler uses the sample's)."""
    return scaler.transform(df).withColumn("scaled", F.transform(vector_to_array(F.col("scaled")), lambda v: v * factor))


def stratified_folds(df: DataFrame, label: str, folds: int, seed: int) -> DataFrame:
    """``_fold``: within each class, rows in seeded hash order are dealt to the folds in turn."""
    tie = [ID] if ID in df.columns else [c for c in df.columns if c != label]
    key = F.xxhash64(F.lit(seed), *tie)
    ranked = row_numbers(df.withColumn("_h", key), [label], ["_h", *tie], out="_rk")
    return ranked.withColumn("_fold", F.pmod(F.col("_rk"), F.lit(folds))).drop("_h", "_rk")


def fit_svm_grid(train: DataFrame, features: Sequence[str], label: str = LABEL, folds: int = 5,
                 cs: Sequence[float] = (1.0, 10.0), seed: int = SVM_SEED, tol: float = kernel_svm.TOL) -> SvmGridModel:
    """Grid search over C x kernel {linear, rbf} with ``folds`` stratified folds by accuracy, refit and cross-fitted Platt.

    All fits (candidates x folds, and every candidate on all rows) are problems of one distributed dual solve
    (:mod:`kernel_svm`) with exact kernels.  The rbf width is 1 / (features x variance of a fit's scaled rows).  Every row has
    a score in the fits that left it out, so accuracies need no further pass of predictions, and the probabilities are fitted on
    the chosen candidate's out-of-fold margins, as margins of a fit's own rows are too sure.  A fold whose training rows have
    one class has no accuracy.  Ties go to the first candidate in grid order (C outer, kernel inner).
    """
    base = stratified_folds(_assembler(features, "raw").transform(train).select(
        label, "raw", *([ID] if ID in train.columns else [])), label, folds, seed)
    base = pin(base.select(label, "raw", "_fold"))
    scaler = StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True).fit(base)
    dim, n = scaler.mean.size, base.count()
    factor = math.sqrt(n / (n - 1)) if n > 1 else 1.0
    y = F.when(F.col(label) == 1, 1).otherwise(-1)
    rows = pin(sized(_scaled(scaler, factor, base).select(
        F.monotonically_increasing_id().alias("row"), y.alias("y"), F.col("_fold").cast("int").alias("fold"), F.col("scaled").alias("x")),
        n, dim))
    gammas, mixed = _widths_of_folds(rows, folds, dim)
    fits = [*range(folds), None]
    grid = [(c, kernel) for c in cs for kernel in ("linear", "rbf")]
    problems = [kernel_svm.Problem(kernel_svm.Kernel(kernel, gammas[f] if kernel == "rbf" else 0.0), float(c), f)
                for c, kernel in grid for f in fits]
    solved = kernel_svm.solve(rows, problems, dim, tol)
    margins = F.transform(F.sequence(F.lit(0), F.lit(len(problems) - 1)), lambda p: F.get("score", p) + F.get(
        F.array(*[F.lit(float(v)) for v in solved.bias]), p))
    held = solved.state.select("y", "fold", margins.alias("m"))

    def own(i: int):  # the margin that candidate i's fit without the row's fold gives it
        return F.get("m", F.col("fold") + i * len(fits))

    rights = held.groupBy("fold").agg(*[F.avg(flag((own(i) > 0) == (F.col("y") > 0))).alias(f"a{i}") for i in range(len(grid))]).collect()
    scores = {}
    for i, (c, kernel) in enumerate(grid):
        known = [r[f"a{i}"] for r in rights if mixed[r["fold"]]]
        scores[f"{kernel}_C{c:g}"] = float(sum(known) / len(known)) if known else float("nan")
    best = max(range(len(grid)), key=lambda i: (scores[f"{grid[i][1]}_C{grid[i][0]:g}"], -i))
    chosen = best * len(fits) + folds
    support = kernel_svm.support_table(solved, chosen)
    platt = _platt(held.select(flag(F.col("y") > 0).alias(label), own(best).alias("margin")), label)
    return SvmGridModel(features, scaler, factor, problems[chosen].kernel, support, solved.bias[chosen], platt, scores)


def _widths_of_folds(rows: DataFrame, folds: int, dim: int) -> tuple[dict, dict]:
    """Per left-out fold (None: none) the rbf width 1 / (dim x variance of all entries of the rest), and whether the rest has both classes."""
    x = F.aggregate("x", F.lit(0.0), lambda a, v: a + v)
    xx = F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)
    parts = rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("x"), F.sum(xx).alias("xx"),
                                     F.sum(flag(F.col("y") > 0)).alias("pos")).collect()
    gammas, mixed = {}, {}
    for f in [*range(folds), None]:
        rest = [r for r in parts if r["fold"] != f]
        n, pos = sum(r["n"] for r in rest), sum(r["pos"] for r in rest)
        entries = max(n * dim, 1)
        mean = sum(r["x"] for r in rest) / entries
        variance = sum(r["xx"] for r in rest) / entries - mean * mean
        gammas[f], mixed[f] = 1.0 / (max(dim, 1) * variance) if variance > 1e-15 else 1.0, 0 < pos < n
    return gammas, mixed


def _platt(margins: DataFrame, label: str) -> LogisticRegressionModel:
    """Logistic fit on margins with Platt's targets: (n1 + 1) / (n1 + 2) for class 1, 1 / (n0 + 2) for class 0."""
    n1, n0 = margins.agg(F.sum(flag(F.col(label) == 1)), F.sum(flag(F.col(label) == 0))).first()
    target = F.when(F.col(label) == 1, ((n1 or 0) + 1.0) / ((n1 or 0) + 2.0)).otherwise(1.0 / ((n0 or 0) + 2.0))
    sides = F.explode(F.array(F.struct(F.lit(1.0).alias(label), target.alias("w")), F.struct(F.lit(0.0).alias(label), (1 - target).alias("w"))))
    weighted = _assembler(["margin"], "margin_vec").transform(margins.select("margin", sides.alias("s")).select("margin", "s.*"))
    return LogisticRegression(featuresCol="margin_vec", labelCol=label, weightCol="w", regParam=0.0).fit(weighted)


def sized(df: DataFrame, rows: int, columns: int, partition: int = PARTITION_BYTES) -> DataFrame:
    """Few enough partitions for the table's size: iterative fits run a job over all of them again and again."""
    return df.repartition(rows * columns * 8 // partition + 1)


def build(name: str, n_train: int, features: Sequence[str], label: str = LABEL):
    """Unfitted pipeline.  The tree may split between any two values: it gets as many bins as there can be different values
    (MLlib then takes all rows to find the split points and keeps only as many bins as a feature has values)."""
    if name == "logistic":
        est = LogisticRegression(featuresCol="features", labelCol=label, regParam=1.0 / max(n_train, 1),
                                 elasticNetParam=0.0, standardization=False, maxIter=100)
    elif name == "tree":
        est = DecisionTreeClassifier(featuresCol="features", labelCol=label, maxDepth=TREE_DEPTH, seed=TREE_SEED,
                                     maxBins=max(32, min(n_train, MAX_BINS)))
    elif name == "forest":
        est = RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=FOREST_TREES, maxDepth=FOREST_DEPTH,
                                     seed=TREE_SEED, featureSubsetStrategy="sqrt")
    else:
        raise ValueError(name)
    return Pipeline(stages=[_assembler(features), est])


def fit(name: str, train: DataFrame, features: Sequence[str] | None = None, label: str = LABEL):
    features = list(features or feature_columns(train))
    if name == "svm_grid":
        return fit_svm_grid(train, features, label)
    n = train.count()
    return build(name, n, features, label).fit(sized(train, n, len(features)))


def predict(name: str, model, df: DataFrame, label: str = LABEL, keep: Sequence[str] = ()) -> DataFrame:
    """Score (probability of class 1) and the model's own prediction."""
    out = model.transform(df)
    return out.select(F.lit(name).alias("modelo"), ID, F.col(label).alias("label"),
                      _prob1().alias("score"), F.col("prediction").cast("int").alias("prediction"), *keep)


def fit_and_predict(name: str, df: DataFrame, label: str = LABEL) -> DataFrame:
    train, test = _train_test(df)
    model = fit(name, train, feature_columns(df), label)
    return predict(name, model, test, label)


def _stacked(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fit_all(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Fit the four models on the train groups and score the test groups (long table)."""
    return _stacked([fit_and_predict(name, df, label) for name in MODEL_NAMES])


def save_models(df: DataFrame, folder: str, label: str = LABEL) -> DataFrame:
    """Fit, save with MLlib writers under ``folder``, reload and score the test groups."""
    train, test = _train_test(df)
    feats = feature_columns(df)
    parts = []
    for name in MODEL_NAMES:
        model = fit(name, train, feats, label)
        path = f"{folder.rstrip('/')}/{name}"
        if name == "svm_grid":
            model.save(path)
            loaded = SvmGridModel.load(path)
        else:
            model.write().overwrite().save(path)
            loaded = PipelineModel.load(path)
        parts.append(predict(name, loaded, test, label).withColumn("path", F.lit(path)))
    return _stacked(parts)


def evaluate_models(preds: DataFrame) -> DataFrame:
    """Per ``modelo`` in the table, whatever its name: AUC, the four confusion cells and the classification report,
    as (modelo, metrica, clase, valor)."""
    by = ["modelo"]
    auc = evaluate.roc_auc(preds, by=by).select("modelo", F.lit("auc").alias("metrica"), F.lit("all").alias("clase"),
                                                F.col("auc").alias("valor"))
    cm = evaluate.confusion_matrix(preds, by=by).select(
        "modelo", F.lit("confusion").alias("metrica"),
        F.concat(F.col("label").cast("string"), F.lit("_"), F.col("prediction").cast("string")).alias("clase"),
        F.col("n").cast("double").alias("valor"))
    rep = evaluate.classification_report(preds, by=by).select("modelo", "clase", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metrica"), F.col(m).cast("double").alias("valor"))
        for m in ("precision", "recall", "f1", "support")])).alias("m")).select("modelo", "m.metrica", "clase", "m.valor")
    return auc.unionByName(cm).unionByName(rep)


def _together(jobs: Sequence, spark) -> list:
    """Independent fits submitted from a thread pool, so that they share the cluster."""
    with ThreadPoolExecutor(max_workers=max(1, min(len(jobs), spark.sparkContext.defaultParallelism))) as pool:
        return list(pool.map(lambda job: job(), jobs))


def learning_curve(df: DataFrame, name: str = "logistic", sizes: Sequence[float] = (0.1, 0.3, 0.5, 0.7, 0.9, 1.0),
                   n_splits: int = 5, seed: int = 1993, label: str = LABEL) -> DataFrame:
    """ROC-AUC on growing train subsets over random 50/50 splits; mean and population std per size.

    Split s orders rows by md5('<seed>:<s>:<id>') (exact distributed row
    numbers): the first half trains, the rest tests; the size-f subset is the
    first floor(f * train) rows of that order.  A split whose subset or test half has one class
    only has no AUC; ``train_valid`` and ``test_valid`` say how many splits the means are over.
    All fits are submitted together and all AUCs come from one table of predictions.
    """
    feats = feature_columns(df)
    half = df.count() // 2
    ranked = []
    for s in range(n_splits):
        key = F.md5(F.concat(F.lit(f"{seed}:{s}:"), F.col(ID)))
        ranked.append(sized(row_numbers(df.withColumn("_h", key), [], ["_h", ID], out="_rk"), 2 * half, len(feats),
                            TOGETHER_BYTES).cache())

    def job(s: int, f: float):
        k = max(1, int(f * half))
        sub = ranked[s].filter(F.col("_rk") <= k)
        model = fit_svm_grid(sub, feats, label) if name == "svm_grid" else build(name, k, feats, label).fit(sub)
        part = ranked[s].withColumn("part", F.when(F.col("_rk") <= k, "train").when(F.col("_rk") > half, "test")).filter(
            F.col("part").isNotNull())
        return predict(name, model, part, label, keep=["part"]).select(
            F.lit(float(f)).alias("size"), F.lit(k).alias("n_train"), F.lit(s).alias("split"), "part", "label", "score")

    jobs = [(lambda s=s, f=f: job(s, f)) for s in range(n_splits) for f in sizes]
    preds = written(_stacked(_together(jobs, df.sparkSession)), "predictions")  # a row per fit and company: as Parquet
    for r in ranked:
        r.unpersist()
    by = ["size", "n_train", "split", "part"]
    auc = evaluate.roc_auc(preds, by=by)
    rows = auc.groupBy("size", "n_train", "split").agg(*[
        F.max(F.when(F.col("part") == p, F.col("auc"))).alias(f"{p}_auc") for p in ("train", "test")])
    agg = rows.groupBy("size").agg(*[f(f"{p}_auc").alias(f"{p}_{n}") for p in ("train", "test") for n, f in (
        ("mean", F.avg), ("std", F.stddev_pop), ("valid", F.count))])
    return rows.join(agg, "size")


def feature_importance(df: DataFrame, model, name: str = "forest", label: str = LABEL, seed: int = 11) -> DataFrame:
    """Of a fitted tree model: impurity importances, and on the test groups the mean absolute SHAP value (what the reference's
    summary is ordered by) and permutation importance.

    Permutation importance is the AUC lost when one feature's values are permuted by a seeded hash order (an exact
    distributed shuffle).  All permuted tables are scored in one pass and their AUCs come from one table; the dummies of
    one category form one feature.
    """
    _, test = _train_test(df)
    feats = feature_columns(df)
    impurity = model.stages[-1].featureImportances.toArray()
    widths = _widths(test, feats)
    at = np.concatenate([[0], np.cumsum([widths[f] for f in feats])])
    orig = row_numbers(test, [], [ID], out="_pos").cache()
    tables = [orig.withColumn("which", F.lit("")).drop("_pos")]
    for j, feat in enumerate(feats):
        donor = row_numbers(test.select(ID, feat).withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:{j}:"), F.col(ID)))),
                            [], ["_h", ID], out="_pos").select("_pos", F.col(feat).alias("_v"))
        tables.append(orig.join(donor, "_pos").withColumn(feat, F.col("_v")).withColumn("which", F.lit(feat)).drop("_v", "_pos"))
    auc = evaluate.roc_auc(predict(name, model, _stacked(tables), label, keep=["which"]), by=["which"])
    weights = df.sparkSession.createDataFrame(
        [(f, float(impurity[at[j]:at[j + 1]].sum())) for j, f in enumerate(feats)], "feature string, importance double")
    auc = pin(auc)
    orig.unpersist()
    shap = tree_shap.tree_shap(model, test, feats, widths).groupBy("feature").agg(F.avg(F.abs("shap")).alias("mean_abs_shap"))
    whole = auc.filter("which = ''").select("auc").scalar()
    drops = auc.filter("which <> ''").select(F.col("which").alias("feature"), (whole - F.col("auc")).alias("permutation_auc_drop"))
    return weights.join(drops, "feature", "left").join(shap, "feature", "left")


def shap_values(df: DataFrame, model, label: str = LABEL) -> DataFrame:
    """``nodo, base, score, feature, shap`` of the test groups' rows: what each feature adds to the probability of class 1."""
    _, test = _train_test(df)
    feats = feature_columns(df)
    return tree_shap.tree_shap(model, test, feats, _widths(test, feats), keep=[ID])


def _widths(df: DataFrame, feats: Sequence[str]) -> Mapping[str, int]:
    """Values per feature: 1, or the length of a vector column."""
    kinds = dict(df.dtypes)
    vectors = [f for f in feats if kinds[f] == "vector"]
    row = df.select(*[F.size(vector_to_array(F.col(f))).alias(f) for f in vectors]).first() if vectors else {}
    return {f: row[f] if f in vectors else 1 for f in feats}
