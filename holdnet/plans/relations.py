"""Flow A: relation tables, joins and relation features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdnet.operators import flags, joins, shares, tables
from holdnet.plans.catalog import register
from holdnet.session import shuffles_dropped
from holdnet.sources import fixtures as fx

REL_COLS = ["nodo_ini", "nodo_fin", "date_year_ini", "date_month_ini", "score_fin", "rel_id",
            "grupo_ini", "grupo_fin", "situ_ini", "situ_fin"]
REL_SQL = ", ".join(REL_COLS)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations -> client flags -> group client share -> same-group share."""
    rel = fx.relaciones(spark, sf_dir)
    return shares.client_and_group_shares(flags.same_group_flag(flags.client_flag(rel)))


register("flagship", f"""
SELECT r.*, gi.proporcion_cliente_ini, gf.proporcion_cliente_fin,
       si.proporcion_relaciones_congrupo_ini, sf.proporcion_relaciones_congrupo_fin
FROM rel_flags r
LEFT JOIN (SELECT grupo_ini, date_year_ini, date_month_ini,
                  CAST(sum(cliente_nocliente_ini) AS DOUBLE)/CAST(count(cliente_nocliente_ini) AS DOUBLE) AS proporcion_cliente_ini
           FROM rel_flags GROUP BY ALL) gi
  ON r.grupo_ini = gi.grupo_ini AND r.date_year_ini = gi.date_year_ini AND r.date_month_ini = gi.date_month_ini
LEFT JOIN (SELECT grupo_fin, date_year_ini, date_month_ini,
                  CAST(sum(cliente_nocliente_fin) AS DOUBLE)/CAST(count(cliente_nocliente_fin) AS DOUBLE) AS proporcion_cliente_fin
           FROM rel_flags GROUP BY ALL) gf
  ON r.grupo_fin = gf.grupo_fin AND r.date_year_ini = gf.date_year_ini AND r.date_month_ini = gf.date_month_ini
LEFT JOIN (SELECT nodo_ini, CAST(sum(relacion_entre_mismo_grupo) AS DOUBLE)/CAST(count(*) AS DOUBLE)
                  AS proporcion_relaciones_congrupo_ini FROM rel_flags GROUP BY nodo_ini) si ON r.nodo_ini = si.nodo_ini
LEFT JOIN (SELECT nodo_fin, CAST(sum(relacion_entre_mismo_grupo) AS DOUBLE)/CAST(count(*) AS DOUBLE)
                  AS proporcion_relaciones_congrupo_fin FROM rel_flags GROUP BY nodo_fin) sf ON r.nodo_fin = sf.nodo_fin
""")(flagship)

_NODE_COLS = (["nodo", "grupo", "situ"], ["nodo_ini", "grupo_ini", "situ_ini"], ["nodo_fin", "grupo_fin", "situ_fin"])


@register("node_table", """
SELECT * FROM (SELECT DISTINCT nodo_ini AS nodo, grupo_ini AS grupo, situ_ini AS situ FROM relaciones) a
UNION ALL
SELECT * FROM (SELECT DISTINCT nodo_fin AS nodo, grupo_fin AS grupo, situ_fin AS situ FROM relaciones) b
""")
def q_node_table(spark, sf_dir):
    return tables.node_table(fx.relaciones(spark, sf_dir), *_NODE_COLS)


@register("node_table_distinct", """
SELECT DISTINCT nodo_ini AS nodo, grupo_ini AS grupo, situ_ini AS situ FROM relaciones
UNION
SELECT DISTINCT nodo_fin, grupo_fin, situ_fin FROM relaciones
""")
def q_node_table_distinct(spark, sf_dir):
    return tables.node_table_distinct(fx.relaciones(spark, sf_dir), *_NODE_COLS)


EDGES_SQL = ("edges", """
SELECT src, dst, anho_mes, value, rel_id FROM (
  SELECT nodo_ini AS src, nodo_fin AS dst,
         concat(CAST(date_year_ini AS VARCHAR), lpad(CAST(date_month_ini AS VARCHAR), 2, '0')) AS anho_mes,
         score_fin AS value, rel_id,
         ROW_NUMBER() OVER (PARTITION BY nodo_ini, nodo_fin, date_year_ini, date_month_ini ORDER BY rel_id) AS rn
  FROM relaciones) t WHERE rn = 1""")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One edge per pair and month; edges carry no company attributes, so none are joined to the relations."""
    return tables.edge_table(fx.relations_raw(spark, sf_dir))


@register("edge_table", "SELECT src, dst, anho_mes, CAST(value AS DOUBLE) AS value, rel_id FROM edges", [EDGES_SQL])
def q_edge_table(spark, sf_dir):
    return edges(spark, sf_dir).withColumn("value", F.col("value").cast("double"))


@register("year_of_date", "SELECT id, cif, fechadato, substr(fechadato, 1, 4) AS fechadato_year FROM identity")
def q_year_of_date(spark, sf_dir):
    return tables.year_of_date(fx.identity(spark, sf_dir))


LATEST_BAL_SQL = ("latest_bal", """
SELECT id, clcb_ano_ejercicio, importe_balance, bal_id FROM (
  SELECT b.*, ROW_NUMBER() OVER (PARTITION BY id ORDER BY clcb_ano_ejercicio DESC, bal_id) AS rn FROM balance b
) t WHERE rn = 1""")


@register("latest_balance",
          "SELECT id, clcb_ano_ejercicio, CAST(importe_balance AS DOUBLE) AS importe_balance, bal_id FROM latest_bal",
          [LATEST_BAL_SQL])
def q_latest_balance(spark, sf_dir):
    return (tables.latest_balance(fx.balance(spark, sf_dir))
            .withColumn("importe_balance", F.col("importe_balance").cast("double")))


SELECT_COLS = ["nodo_ini", "nodo_fin", "date_year_ini", "date_month_ini", "grupo_ini", "grupo_fin"]


@register("select_features", f"SELECT {', '.join(SELECT_COLS)} FROM relaciones")
def q_select_features(spark, sf_dir):
    return tables.select_features(fx.relaciones(spark, sf_dir), SELECT_COLS)


@register("pair_month_dedup", f"""
SELECT {REL_SQL.replace('score_fin', 'CAST(score_fin AS DOUBLE) AS score_fin')} FROM (
  SELECT r.*, ROW_NUMBER() OVER (PARTITION BY nodo_ini, nodo_fin, date_year_ini, date_month_ini ORDER BY rel_id) AS rn
  FROM relaciones r) t WHERE rn = 1""")
def q_pair_month_dedup(spark, sf_dir):
    return (tables.pair_month_dedup(fx.relaciones(spark, sf_dir))
            .withColumn("score_fin", F.col("score_fin").cast("double")))


# ---- joins -------------------------------------------------------------------------------------------

PROFILE_SQL = ("profile", """
SELECT id, cif, fechadato, forma_juridica, pais, fechadato_year, date_year_ini, date_month_ini,
       clcb_ano_ejercicio, importe_balance, bal_id FROM (
  SELECT j.*, ROW_NUMBER() OVER (PARTITION BY cif, fechadato ORDER BY id, bal_id) AS rn FROM (
    SELECT i.id, i.cif, i.fechadato, l.forma_juridica, l.pais, substr(i.fechadato, 1, 4) AS fechadato_year,
           CAST(substr(i.fechadato, 1, 4) AS INT) AS date_year_ini, CAST(substr(i.fechadato, 6, 2) AS INT) AS date_month_ini,
           b.clcb_ano_ejercicio, CAST(b.importe_balance AS DOUBLE) AS importe_balance, b.bal_id
    FROM identity i JOIN legal l ON i.id = l.id LEFT JOIN latest_bal b ON i.id = b.id) j) t WHERE rn = 1""")


@register("company_profile", "SELECT * FROM profile", [LATEST_BAL_SQL, PROFILE_SQL])
def q_company_profile(spark, sf_dir):
    return joins.company_profile(fx.identity(spark, sf_dir), fx.legal(spark, sf_dir), fx.balance(spark, sf_dir))


FULL_COLS = REL_COLS + ["ind_filial_matriz_ini", "ind_filial_matriz_fin", "cif_ini", "forma_juridica_ini",
                        "importe_balance_ini", "cif_fin", "forma_juridica_fin", "importe_balance_fin"]


@register("full_relation_table", f"""
SELECT {', '.join('r.' + c for c in REL_COLS).replace('r.score_fin', 'CAST(r.score_fin AS DOUBLE) AS score_fin')},
       mi.ind_filial_matriz AS ind_filial_matriz_ini, mf.ind_filial_matriz AS ind_filial_matriz_fin,
       pi.cif AS cif_ini, pi.forma_juridica AS forma_juridica_ini, pi.importe_balance AS importe_balance_ini,
       pf.cif AS cif_fin, pf.forma_juridica AS forma_juridica_fin, pf.importe_balance AS importe_balance_fin
FROM relaciones r
LEFT JOIN nodos mi ON r.nodo_ini = mi.nodo
LEFT JOIN profile pi ON r.nodo_ini = pi.id AND r.date_year_ini = pi.date_year_ini AND r.date_month_ini = pi.date_month_ini
LEFT JOIN nodos mf ON r.nodo_fin = mf.nodo
LEFT JOIN profile pf ON r.nodo_fin = pf.id AND r.date_year_ini = pf.date_year_ini AND r.date_month_ini = pf.date_month_ini
""", [LATEST_BAL_SQL, PROFILE_SQL])
def q_full_relation_table(spark, sf_dir):
    nodes = fx.nodos(spark, sf_dir)
    profile = joins.company_profile(fx.identity(spark, sf_dir), fx.legal(spark, sf_dir), fx.balance(spark, sf_dir))
    out = joins.full_relation_table(
        fx.relaciones(spark, sf_dir, nodes, ("grupo", "situ", "ind_filial_matriz")),
        joins.profile_side(profile, "ini", ["cif", "forma_juridica", "importe_balance"]),
        joins.profile_side(profile, "fin", ["cif", "forma_juridica", "importe_balance"]), FULL_COLS)
    return out.withColumn("score_fin", F.col("score_fin").cast("double"))


@register("row_counts", """
SELECT 'roles_ini' AS paso, count(*) AS filas FROM relaciones r LEFT JOIN nodos m ON r.nodo_ini = m.nodo
UNION ALL SELECT 'roles_fin', count(*) FROM relaciones r LEFT JOIN nodos m ON r.nodo_fin = m.nodo
UNION ALL SELECT 'features_ini', count(*) FROM relaciones r
  LEFT JOIN profile p ON r.nodo_ini = p.id AND r.date_year_ini = p.date_year_ini AND r.date_month_ini = p.date_month_ini
UNION ALL SELECT 'features_fin', count(*) FROM relaciones r
  LEFT JOIN profile p ON r.nodo_fin = p.id AND r.date_year_ini = p.date_year_ini AND r.date_month_ini = p.date_month_ini
UNION ALL SELECT 'edges', count(*) FROM edges""", [LATEST_BAL_SQL, PROFILE_SQL, EDGES_SQL])
def q_row_counts(spark, sf_dir):
    """Rows after each join and of the edge table, observed while the tables are made."""
    own, counts = tables.observing_session(spark), {}
    nodes = fx.nodos(own, sf_dir)
    profile = joins.company_profile(fx.identity(own, sf_dir), fx.legal(own, sf_dir), fx.balance(own, sf_dir))
    sides = [joins.profile_side(profile, s, ["cif", "forma_juridica", "importe_balance"]) for s in ("ini", "fin")]
    rel = fx.relaciones(own, sf_dir, nodes)
    full = joins.full_relation_table(rel, *sides, FULL_COLS, *[fx.roles(own, sf_dir, s, nodes) for s in ("ini", "fin")], counts=counts)
    for made in (full, tables.edge_table(rel, counts=counts)):
        with shuffles_dropped(own):
            made.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame(list(tables.row_counts(counts).items()), "paso string, filas long")


# ---- flags -------------------------------------------------------------------------------------------

@register("client_flag", f"SELECT {REL_SQL.replace('score_fin', 'CAST(score_fin AS DOUBLE) AS score_fin')}, "
          "cliente_nocliente_ini, cliente_nocliente_fin FROM rel_flags")
def q_client_flag(spark, sf_dir):
    return flags.client_flag(fx.relaciones(spark, sf_dir)).withColumn("score_fin", F.col("score_fin").cast("double"))


@register("same_group_flag", "SELECT rel_id, nodo_ini, nodo_fin, grupo_ini, grupo_fin, relacion_entre_mismo_grupo FROM rel_flags")
def q_same_group_flag(spark, sf_dir):
    return flags.same_group_flag(fx.relaciones(spark, sf_dir)).select(
        "rel_id", "nodo_ini", "nodo_fin", "grupo_ini", "grupo_fin", "relacion_entre_mismo_grupo")


@register("no_group_label", "SELECT rel_id, COALESCE(grupo_ini, 'no_grupo') AS grupo_ini, "
          "COALESCE(grupo_fin, 'no_grupo') AS grupo_fin FROM relaciones")
def q_no_group_label(spark, sf_dir):
    return flags.no_group_label(fx.relaciones(spark, sf_dir).select("rel_id", "grupo_ini", "grupo_fin"))


# ---- relation shares ---------------------------------------------------------------------------------

GCS_SQL = ("gcs", """
SELECT r.*, gi.proporcion_cliente_ini, gf.proporcion_cliente_fin
FROM rel_flags r
LEFT JOIN (SELECT grupo_ini, date_year_ini, date_month_ini,
                  CAST(sum(cliente_nocliente_ini) AS DOUBLE)/CAST(count(cliente_nocliente_ini) AS DOUBLE) AS proporcion_cliente_ini
           FROM rel_flags GROUP BY ALL) gi
  ON r.grupo_ini = gi.grupo_ini AND r.date_year_ini = gi.date_year_ini AND r.date_month_ini = gi.date_month_ini
LEFT JOIN (SELECT grupo_fin, date_year_ini, date_month_ini,
                  CAST(sum(cliente_nocliente_fin) AS DOUBLE)/CAST(count(cliente_nocliente_fin) AS DOUBLE) AS proporcion_cliente_fin
           FROM rel_flags GROUP BY ALL) gf
  ON r.grupo_fin = gf.grupo_fin AND r.date_year_ini = gf.date_year_ini AND r.date_month_ini = gf.date_month_ini""")

PCS_SQL = ("pcs", """
SELECT g.*, pi.prop_cliente_relaciones_ini, pf.prop_cliente_relaciones_fin
FROM gcs g
LEFT JOIN (SELECT nodo_ini, date_year_ini, date_month_ini,
                  CAST(sum(cliente_nocliente_fin) AS DOUBLE)/CAST(count(cliente_nocliente_fin) AS DOUBLE) AS prop_cliente_relaciones_ini
           FROM rel_flags GROUP BY ALL) pi
  ON g.nodo_ini = pi.nodo_ini AND g.date_year_ini = pi.date_year_ini AND g.date_month_ini = pi.date_month_ini
LEFT JOIN (SELECT nodo_fin, date_year_ini, date_month_ini,
                  CAST(sum(cliente_nocliente_ini) AS DOUBLE)/CAST(count(cliente_nocliente_ini) AS DOUBLE) AS prop_cliente_relaciones_fin
           FROM rel_flags GROUP BY ALL) pf
  ON g.nodo_fin = pf.nodo_fin AND g.date_year_ini = pf.date_year_ini AND g.date_month_ini = pf.date_month_ini""")


def _rel_with_flags(spark, sf_dir):
    return flags.same_group_flag(flags.client_flag(fx.relaciones(spark, sf_dir)))


@register("group_client_share", "SELECT rel_id, nodo_ini, nodo_fin, proporcion_cliente_ini, proporcion_cliente_fin FROM gcs",
          [GCS_SQL])
def q_group_client_share(spark, sf_dir):
    return shares.group_client_share(_rel_with_flags(spark, sf_dir)).select(
        "rel_id", "nodo_ini", "nodo_fin", "proporcion_cliente_ini", "proporcion_cliente_fin")


@register("partner_client_share", """
SELECT rel_id, prop_cliente_relaciones_ini, prop_cliente_relaciones_fin FROM pcs""", [GCS_SQL, PCS_SQL])
def q_partner_client_share(spark, sf_dir):
    return shares.partner_client_share(flags.client_flag(fx.relaciones(spark, sf_dir))).select(
        "rel_id", "prop_cliente_relaciones_ini", "prop_cliente_relaciones_fin")


@register("company_features", f"""
SELECT {REL_SQL.replace('score_fin', 'CAST(score_fin AS DOUBLE) AS score_fin')}, cliente_nocliente_ini, cliente_nocliente_fin,
       relacion_entre_mismo_grupo, proporcion_cliente_ini, proporcion_cliente_fin,
       prop_cliente_relaciones_ini, prop_cliente_relaciones_fin FROM pcs""", [GCS_SQL, PCS_SQL])
def q_company_features(spark, sf_dir):
    return (shares.company_features(fx.relaciones(spark, sf_dir))
            .withColumn("score_fin", F.col("score_fin").cast("double")))


SGS_SQL = ("sgs", """
SELECT r.*, si.proporcion_relaciones_congrupo_ini, sf.proporcion_relaciones_congrupo_fin
FROM rel_flags r
LEFT JOIN (SELECT nodo_ini, CAST(sum(relacion_entre_mismo_grupo) AS DOUBLE)/CAST(count(*) AS DOUBLE)
                  AS proporcion_relaciones_congrupo_ini FROM rel_flags GROUP BY nodo_ini) si ON r.nodo_ini = si.nodo_ini
LEFT JOIN (SELECT nodo_fin, CAST(sum(relacion_entre_mismo_grupo) AS DOUBLE)/CAST(count(*) AS DOUBLE)
                  AS proporcion_relaciones_congrupo_fin FROM rel_flags GROUP BY nodo_fin) sf ON r.nodo_fin = sf.nodo_fin""")


@register("same_group_share", """
SELECT rel_id, proporcion_relaciones_congrupo_ini, proporcion_relaciones_congrupo_fin FROM sgs""", [SGS_SQL])
def q_same_group_share(spark, sf_dir):
    return shares.same_group_share(_rel_with_flags(spark, sf_dir)).select(
        "rel_id", "proporcion_relaciones_congrupo_ini", "proporcion_relaciones_congrupo_fin")


SGPC_SQL = ("sgpc", """
SELECT d.*, COALESCE(ci.c, 0) AS conteo_relacion_mismogrupo_ini, COALESCE(cf.c, 0) AS conteo_relacion_mismogrupo_fin
FROM (SELECT * FROM (SELECT s.*, ROW_NUMBER() OVER (PARTITION BY nodo_ini, nodo_fin, date_year_ini, date_month_ini
                                                    ORDER BY rel_id) AS rn FROM sgs s) t WHERE rn = 1) d
LEFT JOIN (SELECT nodo_ini, count(DISTINCT nodo_fin) AS c FROM relaciones WHERE grupo_ini = grupo_fin GROUP BY nodo_ini) ci
  ON d.nodo_ini = ci.nodo_ini
LEFT JOIN (SELECT nodo_fin, count(DISTINCT nodo_ini) AS c FROM relaciones WHERE grupo_ini = grupo_fin GROUP BY nodo_fin) cf
  ON d.nodo_fin = cf.nodo_fin""")


@register("same_group_partner_count", """
SELECT rel_id, nodo_ini, nodo_fin, conteo_relacion_mismogrupo_ini, conteo_relacion_mismogrupo_fin FROM sgpc""",
          [SGS_SQL, SGPC_SQL])
def q_same_group_partner_count(spark, sf_dir):
    return shares.same_group_partner_count(_rel_with_flags(spark, sf_dir)).select(
        "rel_id", "nodo_ini", "nodo_fin", "conteo_relacion_mismogrupo_ini", "conteo_relacion_mismogrupo_fin")


@register("relation_features", f"""
SELECT rel_id, nodo_ini, nodo_fin, date_year_ini, date_month_ini, relacion_entre_mismo_grupo,
       proporcion_relaciones_congrupo_ini, proporcion_relaciones_congrupo_fin,
       conteo_relacion_mismogrupo_ini, conteo_relacion_mismogrupo_fin FROM sgpc""", [SGS_SQL, SGPC_SQL])
def q_relation_features(spark, sf_dir):
    return shares.relation_features(_rel_with_flags(spark, sf_dir)).select(
        "rel_id", "nodo_ini", "nodo_fin", "date_year_ini", "date_month_ini", "relacion_entre_mismo_grupo",
        "proporcion_relaciones_congrupo_ini", "proporcion_relaciones_congrupo_fin",
        "conteo_relacion_mismogrupo_ini", "conteo_relacion_mismogrupo_fin")
