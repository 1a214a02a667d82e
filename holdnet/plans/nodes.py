"""Flow B: company table features (imputation, group shares, statistics, percentiles)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdnet.operators import flags, impute, shares, stats
from holdnet.operators.flags import same_group_flag
from holdnet.plans.catalog import register
from holdnet.sources import fixtures as fx

NODE_COLS = ["nodo", "grupo", "ind_filial_matriz", "importe", "sector", "tamano", "situ"]
NODE_SQL = ", ".join(c if c != "importe" else "CAST(importe AS DOUBLE) AS importe" for c in NODE_COLS)
IMP_COLS = ["media_importe_grupo", "importe_sinnone", "media_importe_sector", "importe_final", "importe_final_sinnulos"]


def nodes_double(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.nodos(spark, sf_dir).withColumn("importe", F.col("importe").cast("double"))


def imputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impute.impute_amount(fx.nodos(spark, sf_dir)).withColumn("importe", F.col("importe").cast("double"))


@register("impute_amount", f"SELECT {NODE_SQL}, {', '.join(IMP_COLS)} FROM nodos_imp")
def q_impute_amount(spark, sf_dir):
    return imputed(spark, sf_dir).select(*NODE_COLS, *IMP_COLS)


@register("fill_unknown", """
SELECT nodo, COALESCE(grupo, 'desconocido_grupo') AS grupo,
       COALESCE(ind_filial_matriz, 'desconocido_ind_filial_matriz') AS ind_filial_matriz,
       COALESCE(CAST(importe AS VARCHAR), 'desconocido_importe') AS importe,
       COALESCE(situ, 'desconocido_situ') AS situ FROM nodos""")
def q_fill_unknown(spark, sf_dir):
    n = fx.nodos(spark, sf_dir).select("nodo", "grupo", "ind_filial_matriz", "importe", "situ")
    return flags.fill_unknown(n, ["grupo", "ind_filial_matriz", "importe", "situ"])


@register("zero_fill", "SELECT nodo, COALESCE(CAST(importe AS DOUBLE), 0) AS importe FROM nodos")
def q_zero_fill(spark, sf_dir):
    return flags.zero_fill(nodes_double(spark, sf_dir).select("nodo", "importe"), ["importe"])


@register("parent_flag", """
SELECT nodo, ind_filial_matriz, CASE WHEN ind_filial_matriz = 'M' THEN 1 ELSE 0 END AS matriz_filia_binaria FROM nodos""")
def q_parent_flag(spark, sf_dir):
    return flags.parent_flag(fx.nodos(spark, sf_dir).select("nodo", "ind_filial_matriz"))


@register("group_row_count", "SELECT grupo, count(nodo) AS emp FROM nodos WHERE grupo IS NOT NULL GROUP BY grupo")
def q_group_row_count(spark, sf_dir):
    return shares.group_row_count(fx.nodos(spark, sf_dir))


@register("group_amount_share", """
SELECT i.nodo, i.grupo, i.importe_sinnone, round(t.importe_total_grupo, 4) AS importe_total_grupo,
       round(i.importe_sinnone / NULLIF(t.importe_total_grupo, 0), 9) AS proporcion_importe_sobre_grupo
FROM (SELECT nodo, grupo, importe_sinnone FROM nodos_imp) i LEFT JOIN (
  SELECT grupo, sum(importe_sinnone) AS importe_total_grupo FROM nodos_imp WHERE grupo IS NOT NULL GROUP BY grupo) t
  ON i.grupo = t.grupo""")
def q_group_amount_share(spark, sf_dir):
    return shares.group_amount_share(fx.nodos(spark, sf_dir)).select(
        "nodo", "grupo", "importe_sinnone", F.round("importe_total_grupo", 4).alias("importe_total_grupo"),
        F.round("proporcion_importe_sobre_grupo", 9).alias("proporcion_importe_sobre_grupo"))


def node_partner_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = same_group_flag(fx.relaciones(spark, sf_dir))
    return shares.node_partner_counts(shares.same_group_partner_count(rel))


NPC_SQL = ("npc", """
SELECT nodo, grupo, max(c) AS conteo_relacion_mismogrupo FROM (
  SELECT r.nodo_ini AS nodo, r.grupo_ini AS grupo, COALESCE(ci.c, 0) AS c FROM relaciones r
  LEFT JOIN (SELECT nodo_ini, count(DISTINCT nodo_fin) AS c FROM relaciones WHERE grupo_ini = grupo_fin GROUP BY nodo_ini) ci
    ON r.nodo_ini = ci.nodo_ini
  UNION ALL
  SELECT r.nodo_fin, r.grupo_fin, COALESCE(cf.c, 0) FROM relaciones r
  LEFT JOIN (SELECT nodo_fin, count(DISTINCT nodo_ini) AS c FROM relaciones WHERE grupo_ini = grupo_fin GROUP BY nodo_fin) cf
    ON r.nodo_fin = cf.nodo_fin) t
GROUP BY nodo, grupo""")


@register("group_reach_share", """
SELECT n.nodo, n.grupo, n.conteo_relacion_mismogrupo, s.conteo_empresas,
       COALESCE(CAST(n.conteo_relacion_mismogrupo AS DOUBLE) / CAST(s.conteo_empresas AS DOUBLE), 0)
         AS porcentajedelgrupo_conelqueserelaciona
FROM npc n LEFT JOIN (SELECT grupo, count(DISTINCT nodo) AS conteo_empresas FROM npc WHERE grupo IS NOT NULL
                      GROUP BY grupo) s ON n.grupo = s.grupo""", [NPC_SQL])
def q_group_reach_share(spark, sf_dir):
    return shares.group_reach_share(node_partner_counts(spark, sf_dir))


STATS_SQL = ("gstats", """
SELECT s.*, m.importe_sinnone AS importe_sinnone_matriz FROM (
  SELECT grupo, count(nodo) AS emp, count(importe_sinnone) AS count, round(avg(importe_sinnone), 6) AS mean,
         round(stddev_samp(importe_sinnone), 6) AS std, min(importe_sinnone) AS min, max(importe_sinnone) AS max,
         round(quantile_cont(importe_sinnone, 0.25), 6) AS p25, round(quantile_cont(importe_sinnone, 0.5), 6) AS p50,
         round(quantile_cont(importe_sinnone, 0.75), 6) AS p75
  FROM nodos_imp WHERE grupo IS NOT NULL GROUP BY grupo) s
JOIN (SELECT grupo, importe_sinnone FROM nodos_imp WHERE grupo IS NOT NULL AND ind_filial_matriz = 'M') m
  ON s.grupo = m.grupo""")


@register("group_amount_stats", "SELECT * FROM gstats", [STATS_SQL])
def q_group_amount_stats(spark, sf_dir):
    return stats.group_amount_stats(imputed(spark, sf_dir))


PCT_SQL = ("pct", """
SELECT i.*, g.p25 AS percentil25, g.p75 AS percentil75 FROM nodos_imp i LEFT JOIN gstats g ON i.grupo = g.grupo""")

BELOW_SQL = ("below", """
SELECT b.*, a.porcentaje_fact_menor_percentil_75, c.porcentaje_fact_menor_percentil_25 FROM (
  SELECT p.*, CASE WHEN importe_sinnone < percentil75 THEN 1 ELSE 0 END AS menor_percentil75,
              CASE WHEN importe_sinnone < percentil25 THEN 1 ELSE 0 END AS menor_percentil25
  FROM pct p WHERE grupo IS NOT NULL) b
JOIN (SELECT grupo, COALESCE(CAST(sum(CASE WHEN importe_sinnone < percentil75 THEN 1 ELSE 0 END) AS DOUBLE)
                             / CAST(NULLIF(count(*) - 1, 0) AS DOUBLE), 0) AS porcentaje_fact_menor_percentil_75
      FROM pct WHERE grupo IS NOT NULL GROUP BY grupo) a ON b.grupo = a.grupo
JOIN (SELECT grupo, COALESCE(CAST(sum(CASE WHEN importe_sinnone < percentil25 THEN 1 ELSE 0 END) AS DOUBLE)
                             / CAST(NULLIF(count(*) - 1, 0) AS DOUBLE), 0) AS porcentaje_fact_menor_percentil_25
      FROM pct WHERE grupo IS NOT NULL GROUP BY grupo) c ON b.grupo = c.grupo""")


@register("attach_percentiles", "SELECT nodo, grupo, importe_sinnone, percentil25, percentil75 FROM pct",
          [STATS_SQL, PCT_SQL])
def q_attach_percentiles(spark, sf_dir):
    imp = imputed(spark, sf_dir)
    return stats.attach_percentiles(imp, stats.group_amount_stats(imp)).select(
        "nodo", "grupo", "importe_sinnone", "percentil25", "percentil75")


def _with_percentiles(spark, sf_dir):
    imp = imputed(spark, sf_dir)
    return stats.attach_percentiles(imp, stats.group_amount_stats(imp))


@register("below_p25_share", "SELECT nodo, grupo, menor_percentil25, porcentaje_fact_menor_percentil_25 FROM below",
          [STATS_SQL, PCT_SQL, BELOW_SQL])
def q_below_p25_share(spark, sf_dir):
    return stats.below_p25_share(_with_percentiles(spark, sf_dir)).select(
        "nodo", "grupo", "menor_percentil25", "porcentaje_fact_menor_percentil_25")


@register("below_p75_share", "SELECT nodo, grupo, menor_percentil75, porcentaje_fact_menor_percentil_75 FROM below",
          [STATS_SQL, PCT_SQL, BELOW_SQL])
def q_below_p75_share(spark, sf_dir):
    return stats.below_p75_share(_with_percentiles(spark, sf_dir)).select(
        "nodo", "grupo", "menor_percentil75", "porcentaje_fact_menor_percentil_75")


NODE_FEAT = ["nodo", "grupo", "ind_filial_matriz", "importe_sinnone", "percentil25", "percentil75",
             "menor_percentil75", "porcentaje_fact_menor_percentil_75", "menor_percentil25",
             "porcentaje_fact_menor_percentil_25"]


@register("node_features", f"SELECT {', '.join(NODE_FEAT)} FROM below", [STATS_SQL, PCT_SQL, BELOW_SQL])
def q_node_features(spark, sf_dir):
    return stats.node_features(imputed(spark, sf_dir)).select(*NODE_FEAT)
