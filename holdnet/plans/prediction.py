"""Flow C: split and encoding, metrics on scores, models (MLlib), learning curve, importance."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdnet.operators import evaluate, flags, graph, impute, models, shares, split, stats, tables
from holdnet.plans.catalog import register
from holdnet.plans.graphs import DEG0_SQL, GDC_SQL, TDC_SQL, UND_SQL
from holdnet.plans.nodes import BELOW_SQL, NPC_SQL, PCT_SQL, STATS_SQL
from holdnet.session import ensure_checkpoint_dir, pin, written
from holdnet.sources import fixtures as fx

SECTORS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "SUPPLIER"]
SIZES = ["large", "medium", "small"]


def _dummies_sql(col: str, values: list[str]) -> str:
    return ", ".join(f"CASE WHEN {col} = '{v}' THEN 1 ELSE 0 END AS {col}_{v}" for v in values)


@register("distinct_groups", "SELECT DISTINCT grupo FROM nodos")
def q_distinct_groups(spark, sf_dir):
    return split.distinct_groups(fx.nodos(spark, sf_dir))


SPLIT_SQL = ("split_units", """
SELECT unit, CASE WHEN rk <= floor((SELECT count(*) FROM (SELECT DISTINCT COALESCE(grupo, 'no_grupo') FROM nodos) c) * 0.8)
                  THEN 'train' ELSE 'test' END AS conjunto
FROM (SELECT unit, ROW_NUMBER() OVER (ORDER BY md5(concat('424:', unit)), unit) AS rk
      FROM (SELECT DISTINCT COALESCE(grupo, 'no_grupo') AS unit FROM nodos) u) r""")


@register("group_split", """
SELECT n.nodo, n.grupo, n.ind_filial_matriz, s.conjunto FROM nodos n JOIN split_units s ON COALESCE(n.grupo, 'no_grupo') = s.unit""",
          [SPLIT_SQL])
def q_group_split(spark, sf_dir):
    return split.group_split(fx.nodos(spark, sf_dir).select("nodo", "grupo", "ind_filial_matriz"))


@register("one_hot", f"""
SELECT nodo, grupo, {_dummies_sql('sector', SECTORS)}, {_dummies_sql('tamano', SIZES)} FROM nodos""")
def q_one_hot(spark, sf_dir):
    return split.one_hot(fx.nodos(spark, sf_dir).select("nodo", "grupo", "sector", "tamano"))


@register("model_table", f"""
SELECT nodo, grupo, ind_filial_matriz, CAST(importe AS DOUBLE) AS importe, situ,
       {_dummies_sql('sector', SECTORS)}, {_dummies_sql('tamano', SIZES)},
       CASE WHEN ind_filial_matriz = 'M' THEN 1 ELSE 0 END AS matriz_filia_binaria FROM nodos""")
def q_model_table(spark, sf_dir):
    return split.model_table(fx.nodos(spark, sf_dir).withColumn("importe", F.col("importe").cast("double")))


@register("category_cast", """
SELECT n.nodo, CAST(s.idx AS DOUBLE) AS sector_idx, CAST(t.idx AS DOUBLE) AS tamano_idx FROM nodos n
JOIN (SELECT sector, ROW_NUMBER() OVER (ORDER BY count(*) DESC, sector) - 1 AS idx FROM nodos GROUP BY sector) s
  ON n.sector = s.sector
JOIN (SELECT tamano, ROW_NUMBER() OVER (ORDER BY count(*) DESC, tamano) - 1 AS idx FROM nodos GROUP BY tamano) t
  ON n.tamano = t.tamano""")
def q_category_cast(spark, sf_dir):
    return models.category_cast(fx.nodos(spark, sf_dir), ["sector", "tamano"]).select("nodo", "sector_idx", "tamano_idx")


# ---- metrics on the deterministic score table -------------------------------------------------------

SCORES_SQL = ("scores", """
SELECT nodo AS row_id, CASE WHEN ind_filial_matriz = 'M' THEN 1 ELSE 0 END AS label,
       (importe_final_sinnulos - (SELECT min(importe_final_sinnulos) FROM nodos_imp))
       / NULLIF((SELECT max(importe_final_sinnulos) FROM nodos_imp) - (SELECT min(importe_final_sinnulos) FROM nodos_imp), 0)
         AS score
FROM nodos_imp""")
PRED_SQL = ("pred", "SELECT s.*, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS prediction FROM scores s")
CELLS_SQL = ("cells", """
SELECT CAST(sum(CASE WHEN label = 0 AND prediction = 0 THEN 1 ELSE 0 END) AS BIGINT) AS c00,
       CAST(sum(CASE WHEN label = 0 AND prediction = 1 THEN 1 ELSE 0 END) AS BIGINT) AS c01,
       CAST(sum(CASE WHEN label = 1 AND prediction = 0 THEN 1 ELSE 0 END) AS BIGINT) AS c10,
       CAST(sum(CASE WHEN label = 1 AND prediction = 1 THEN 1 ELSE 0 END) AS BIGINT) AS c11 FROM pred""")
SCORE_CTES = [SCORES_SQL, PRED_SQL, CELLS_SQL]


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.scores(impute.impute_amount(fx.nodos(spark, sf_dir)))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flags.threshold_predict(scores(spark, sf_dir), "score", 0.5, "prediction")


@register("threshold_predict", "SELECT row_id, label, score, prediction FROM pred", SCORE_CTES)
def q_threshold_predict(spark, sf_dir):
    return predictions(spark, sf_dir)


@register("confusion_matrix", """
SELECT * FROM (SELECT 0 AS label, 0 AS prediction, c00 AS n FROM cells UNION ALL SELECT 0, 1, c01 FROM cells
               UNION ALL SELECT 1, 0, c10 FROM cells UNION ALL SELECT 1, 1, c11 FROM cells) t""", SCORE_CTES)
def q_confusion_matrix(spark, sf_dir):
    return evaluate.confusion_matrix(predictions(spark, sf_dir))


REPORT_SQL = SCORE_CTES + [("rm", """
SELECT COALESCE(c00 / NULLIF(CAST(c00 + c10 AS DOUBLE), 0), 0.0) AS p0, COALESCE(c00 / NULLIF(CAST(c00 + c01 AS DOUBLE), 0), 0.0) AS r0,
       COALESCE(c11 / NULLIF(CAST(c11 + c01 AS DOUBLE), 0), 0.0) AS p1, COALESCE(c11 / NULLIF(CAST(c11 + c10 AS DOUBLE), 0), 0.0) AS r1,
       CAST(c00 + c01 AS DOUBLE) AS s0, CAST(c11 + c10 AS DOUBLE) AS s1,
       (c11 + c00) / NULLIF(CAST(c11 + c00 + c01 + c10 AS DOUBLE), 0) AS acc FROM cells"""),
    ("rf", """
SELECT rm.*, COALESCE(2 * p0 * r0 / NULLIF(p0 + r0, 0), 0.0) AS f0, COALESCE(2 * p1 * r1 / NULLIF(p1 + r1, 0), 0.0) AS f1
FROM rm""")]


@register("classification_report", """
SELECT '0' AS clase, round(p0, 9) AS precision, round(r0, 9) AS recall, round(f0, 9) AS f1, CAST(s0 AS BIGINT) AS support FROM rf
UNION ALL SELECT '1', round(p1, 9), round(r1, 9), round(f1, 9), CAST(s1 AS BIGINT) FROM rf
UNION ALL SELECT 'accuracy', NULL, NULL, round(acc, 9), CAST(s0 + s1 AS BIGINT) FROM rf
UNION ALL SELECT 'macro avg', round((p0 + p1) / 2, 9), round((r0 + r1) / 2, 9), round((f0 + f1) / 2, 9),
                 CAST(s0 + s1 AS BIGINT) FROM rf
UNION ALL SELECT 'weighted avg', round((p0 * s0 + p1 * s1) / NULLIF(s0 + s1, 0), 9), round((r0 * s0 + r1 * s1) / NULLIF(s0 + s1, 0), 9),
                 round((f0 * s0 + f1 * s1) / NULLIF(s0 + s1, 0), 9), CAST(s0 + s1 AS BIGINT) FROM rf""", REPORT_SQL)
def q_classification_report(spark, sf_dir):
    return evaluate.classification_report(predictions(spark, sf_dir))


ROC_SQL = SCORE_CTES + [("roc_pts", """
SELECT score AS threshold, CAST(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS pos,
       CAST(sum(CASE WHEN label <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS neg FROM scores WHERE score IS NOT NULL GROUP BY score"""),
    ("roc_cum", """
SELECT threshold, pos, neg, CAST(sum(pos) OVER (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS tp,
       CAST(sum(neg) OVER (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS fp FROM roc_pts"""),
    ("roc", """
SELECT threshold, tp, fp, tp / NULLIF(CAST((SELECT sum(pos) FROM roc_pts) AS DOUBLE), 0) AS tpr,
       fp / NULLIF(CAST((SELECT sum(neg) FROM roc_pts) AS DOUBLE), 0) AS fpr
FROM (SELECT threshold, tp, fp FROM roc_cum UNION ALL SELECT max(threshold) + 1, 0, 0 FROM roc_cum) c""")]


@register("roc_curve", "SELECT * FROM roc", ROC_SQL)
def q_roc_curve(spark, sf_dir):
    return evaluate.roc_curve(scores(spark, sf_dir))


@register("roc_auc", """
SELECT CAST(sum(CAST(neg AS HUGEINT) * (2 * tp - pos)) AS DOUBLE)
       / NULLIF(CAST(2 * CAST(sum(pos) AS HUGEINT) * CAST(sum(neg) AS HUGEINT) AS DOUBLE), 0) AS auc,
       CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg FROM roc_cum""", ROC_SQL)
def q_roc_auc(spark, sf_dir):
    return evaluate.roc_auc(scores(spark, sf_dir))


@register("best_cutoff", """
SELECT threshold, tpr, fpr, round(sqrt(fpr * fpr + (1 - tpr) * (1 - tpr)), 12) AS dist FROM roc
ORDER BY dist, threshold DESC LIMIT 1""", ROC_SQL)
def q_best_cutoff(spark, sf_dir):
    return evaluate.best_cutoff(scores(spark, sf_dir))


# ---- metrics per model on deterministic score columns ----------------------------------------------

#: Four score columns over the same rows; they stand for four models of any name.
SCORE_COLUMNS = {"mine": "score", "reverse": "1 - score", "square": "score * score", "coarse": "round(score, 1)"}
MODELS_SQL = SCORE_CTES[:1] + [
    ("mpred", " UNION ALL ".join(
        f"SELECT '{m}' AS modelo, label, {e} AS score, CASE WHEN {e} >= 0.5 THEN 1 ELSE 0 END AS prediction FROM scores"
        for m, e in SCORE_COLUMNS.items())),
    ("mcells", """
SELECT modelo, CAST(sum(CASE WHEN label = 0 AND prediction = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS c00,
       CAST(sum(CASE WHEN label = 0 AND prediction = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS c01,
       CAST(sum(CASE WHEN label = 1 AND prediction = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS c10,
       CAST(sum(CASE WHEN label = 1 AND prediction = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS c11 FROM mpred GROUP BY modelo"""),
    ("mauc", """
SELECT modelo, CAST(sum(neg * (2 * tp - pos)) AS DOUBLE) / NULLIF(CAST(2 * sum(pos) * sum(neg) AS DOUBLE), 0) AS auc FROM (
  SELECT modelo, pos, neg, sum(pos) OVER (PARTITION BY modelo ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp FROM (
    SELECT modelo, score, sum(label) AS pos, sum(1 - label) AS neg FROM mpred WHERE score IS NOT NULL GROUP BY modelo, score) g) c
GROUP BY modelo"""),
    ("mrep", """
SELECT modelo, c00 + c01 AS s0, c10 + c11 AS s1, (c00 + c11) / (c00 + c01 + c10 + c11) AS acc,
       COALESCE(c00 / NULLIF(c00 + c10, 0), 0) AS p0, COALESCE(c00 / NULLIF(c00 + c01, 0), 0) AS r0,
       COALESCE(c11 / NULLIF(c11 + c01, 0), 0) AS p1, COALESCE(c11 / NULLIF(c11 + c10, 0), 0) AS r1 FROM mcells"""),
    ("mf", """
SELECT *, s0 + s1 AS s, COALESCE(2 * p0 * r0 / NULLIF(p0 + r0, 0), 0) AS f0, COALESCE(2 * p1 * r1 / NULLIF(p1 + r1, 0), 0) AS f1 FROM mrep"""),
    ("mrows", """
SELECT modelo, '0' AS clase, p0 AS p, r0 AS r, f0 AS f, s0 AS n FROM mf
UNION ALL SELECT modelo, '1', p1, r1, f1, s1 FROM mf
UNION ALL SELECT modelo, 'accuracy', NULL, NULL, acc, s FROM mf
UNION ALL SELECT modelo, 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, s FROM mf
UNION ALL SELECT modelo, 'weighted avg', (p0 * s0 + p1 * s1) / s, (r0 * s0 + r1 * s1) / s, (f0 * s0 + f1 * s1) / s, s FROM mf""")]


@register("evaluate_scores", """
SELECT modelo, 'auc' AS metrica, 'all' AS clase, auc AS valor FROM mauc
UNION ALL SELECT modelo, 'confusion', '0_0', c00 FROM mcells UNION ALL SELECT modelo, 'confusion', '0_1', c01 FROM mcells
UNION ALL SELECT modelo, 'confusion', '1_0', c10 FROM mcells UNION ALL SELECT modelo, 'confusion', '1_1', c11 FROM mcells
UNION ALL SELECT modelo, 'precision', clase, round(p, 9) FROM mrows UNION ALL SELECT modelo, 'recall', clase, round(r, 9) FROM mrows
UNION ALL SELECT modelo, 'f1', clase, round(f, 9) FROM mrows UNION ALL SELECT modelo, 'support', clase, n FROM mrows""", MODELS_SQL)
def q_evaluate_scores(spark, sf_dir):
    base = scores(spark, sf_dir)
    long = base.select("label", F.explode(F.array(*[F.struct(F.lit(m).alias("modelo"), F.expr(e).alias("score"))
                                                    for m, e in SCORE_COLUMNS.items()])).alias("s")).select("label", "s.*")
    return models.evaluate_models(flags.threshold_predict(long, "score", 0.5, "prediction"))


# ---- models (rows-only checks) ---------------------------------------------------------------------

#: Numeric features in the order of the frame; missing values count as 0.
FEATURES = ["importe_final_sinnulos", "proporcion_importe_sobre_grupo", "percentil25", "percentil75", "menor_percentil25",
            "menor_percentil75", "porcentaje_fact_menor_percentil_25", "porcentaje_fact_menor_percentil_75",
            "conteo_relacion_mismogrupo", "porcentajedelgrupo_conelqueserelaciona", "proporcion_relaciones_congrupo_ini",
            "proporcion_relaciones_congrupo_fin", "centralidad", "centralidad_ensu_grupo"]


def company_model_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per company: billing (imputed, share of its group, percentiles of its group and shares below them),
    reach inside its group, relation shares, both centralities, and its categories and role.

    What comes from the relations is written part by part, a row per company each: a part's shuffles of relations are dropped
    before the next, so the disk holds those of the largest part, not the sum of all."""
    nodes = fx.nodos(spark, sf_dir)
    imp = impute.impute_amount(nodes)
    rel = flags.same_group_flag(fx.relaciones(spark, sf_dir, nodes))
    ends = fx.relations_raw(spark, sf_dir)  # the graphs take companies' attributes from the company table
    own = ["percentil25", "percentil75", "menor_percentil25", "menor_percentil75", "porcentaje_fact_menor_percentil_25",
           "porcentaje_fact_menor_percentil_75"]
    parts = [
        shares.group_amount_share(nodes).select("nodo", "proporcion_importe_sobre_grupo"),
        stats.node_features(imp).select("nodo", *own),
        written(shares.group_reach_share(shares.node_partner_counts(shares.same_group_partner_count(rel))).select(
            "nodo", "conteo_relacion_mismogrupo", "porcentajedelgrupo_conelqueserelaciona"), "reach"),
        shares.company_shares(rel),
        written(graph.total_degree_centrality(ends).select("nodo", "centralidad"), "degree"),
    ]
    by_group = written(graph.group_degree_centrality(graph.group_edges(tables.edge_table(ends), nodes)).select(
        "grupo", "nodo", "centralidad_ensu_grupo"), "group-degree")
    out = imp.join(by_group, ["grupo", "nodo"], "left")
    for p in parts:
        out = out.join(p, "nodo", "left")
    return out.select("nodo", "grupo", "ind_filial_matriz", "sector", "tamano", *[
        F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in FEATURES])


FRAME_SQL = (GDC_SQL + [UND_SQL, DEG0_SQL, TDC_SQL, STATS_SQL, PCT_SQL, BELOW_SQL, NPC_SQL, SPLIT_SQL, ("amount", """
SELECT nodo, importe_sinnone / NULLIF(sum(importe_sinnone) OVER (PARTITION BY grupo), 0) AS proporcion_importe_sobre_grupo
FROM nodos_imp WHERE grupo IS NOT NULL"""), ("reach", """
SELECT n.nodo, n.conteo_relacion_mismogrupo, CAST(n.conteo_relacion_mismogrupo AS DOUBLE) / s.c AS porcentajedelgrupo_conelqueserelaciona
FROM npc n LEFT JOIN (SELECT grupo, count(DISTINCT nodo) AS c FROM npc WHERE grupo IS NOT NULL GROUP BY grupo) s ON n.grupo = s.grupo"""),
    ("r_ini", "SELECT nodo_ini AS nodo, avg(relacion_entre_mismo_grupo) AS v FROM rel_flags GROUP BY nodo_ini"),
    ("r_fin", "SELECT nodo_fin AS nodo, avg(relacion_entre_mismo_grupo) AS v FROM rel_flags GROUP BY nodo_fin"),
    ("frame", """
SELECT n.nodo, n.grupo, n.ind_filial_matriz, n.sector, n.tamano, n.importe_final_sinnulos, a.proporcion_importe_sobre_grupo,
       b.percentil25, b.percentil75, b.menor_percentil25, b.menor_percentil75, b.porcentaje_fact_menor_percentil_25,
       b.porcentaje_fact_menor_percentil_75, r.conteo_relacion_mismogrupo, r.porcentajedelgrupo_conelqueserelaciona,
       ri.v AS proporcion_relaciones_congrupo_ini, rf.v AS proporcion_relaciones_congrupo_fin, t.centralidad, g.centralidad_ensu_grupo
FROM nodos_imp n LEFT JOIN amount a ON a.nodo = n.nodo
LEFT JOIN (SELECT DISTINCT nodo, percentil25, percentil75, menor_percentil25, menor_percentil75, porcentaje_fact_menor_percentil_25,
                  porcentaje_fact_menor_percentil_75 FROM below) b ON b.nodo = n.nodo
LEFT JOIN reach r ON r.nodo = n.nodo LEFT JOIN r_ini ri ON ri.nodo = n.nodo LEFT JOIN r_fin rf ON rf.nodo = n.nodo
LEFT JOIN tdc t ON t.nodo = n.nodo LEFT JOIN gdeg g ON g.grupo = n.grupo AND g.nodo = n.nodo""")])


@register("model_frame", f"""
SELECT f.nodo, f.grupo, f.sector, f.tamano, {', '.join(f'round(COALESCE(CAST({c} AS DOUBLE), 0), 8) AS {c}' for c in FEATURES)},
       CASE WHEN ind_filial_matriz = 'M' THEN 1 ELSE 0 END AS matriz_filia_binaria, s.conjunto
FROM frame f JOIN split_units s ON COALESCE(f.grupo, 'no_grupo') = s.unit""", FRAME_SQL)
def q_model_frame(spark, sf_dir):
    return split.group_split(flags.parent_flag(company_model_features(spark, sf_dir))).select(
        "nodo", "grupo", "sector", "tamano", *[F.round(c, 8).alias(c) for c in FEATURES], "matriz_filia_binaria", "conjunto")


def model_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features with sparse category vectors, target and the group split, written once: every fit, fold and
    metric reads this table (one row per company) instead of recomputing the joins."""
    table = pin(flags.parent_flag(company_model_features(spark, sf_dir)).drop("ind_filial_matriz"))
    return pin(split.group_split(models.encode_categories(table, ["sector", "tamano"])))


def _fit_query(name: str):
    def q(spark, sf_dir):
        df = model_frame(spark, sf_dir)
        return models.fit_and_predict(name, df)
    q.__name__ = f"q_fit_{name}"
    return q


for _name in models.MODEL_NAMES:
    register(f"fit_{_name}")(_fit_query(_name))


@register("fit_all")
def q_fit_all(spark, sf_dir):
    return models.fit_all(model_frame(spark, sf_dir))


@register("save_models")
def q_save_models(spark, sf_dir):
    return models.save_models(model_frame(spark, sf_dir), f"{ensure_checkpoint_dir(spark).rstrip('/')}/models-{uuid.uuid4().hex[:12]}")


@register("evaluate_models")
def q_evaluate_models(spark, sf_dir):
    return models.evaluate_models(models.fit_all(model_frame(spark, sf_dir)))


@register("learning_curve")
def q_learning_curve(spark, sf_dir):
    return models.learning_curve(model_frame(spark, sf_dir))


@register("feature_importance")
def q_feature_importance(spark, sf_dir):
    df = model_frame(spark, sf_dir)
    train = df.filter(F.col("conjunto") == "train")
    return models.feature_importance(df, models.fit("forest", train, models.feature_columns(df)))


@register("shap_values")
def q_shap_values(spark, sf_dir):
    df = model_frame(spark, sf_dir)
    train = df.filter(F.col("conjunto") == "train")
    return models.shap_values(df, models.fit("forest", train, models.feature_columns(df)))
