"""DuckDB oracle SQL.

The driver registers only the base parquet tables, so each oracle query is
prefixed with the fixture views of FIXTURES.md as CTEs.  Queries are plain
ANSI SQL written independently of the Spark code paths.
"""

from __future__ import annotations

FIXTURE_CTES: list[tuple[str, str]] = [
    ("rel_raw", """
SELECT CASE WHEN l.l_returnflag='R' THEN concat('S',CAST(l.l_suppkey AS VARCHAR(20)))
            ELSE concat('C',CAST(o.o_custkey AS VARCHAR(20))) END AS nodo_ini,
       CASE WHEN l.l_returnflag='R' THEN concat('C',CAST(o.o_custkey AS VARCHAR(20)))
            ELSE concat('S',CAST(l.l_suppkey AS VARCHAR(20))) END AS nodo_fin,
       CAST(year(o.o_orderdate) AS INT) AS date_year_ini,
       CAST(month(o.o_orderdate) AS INT) AS date_month_ini,
       CAST(l.l_quantity AS DECIMAL(18,2)) AS score_fin,
       concat(CAST(l.l_orderkey AS VARCHAR(20)),'-',CAST(l.l_linenumber AS VARCHAR(20)),'-',
              CAST(l.l_partkey AS VARCHAR(20)),'-',CAST(l.l_suppkey AS VARCHAR(20)),'-',
              CAST(CAST(l.l_quantity AS INT) AS VARCHAR(20)),'-',
              CAST(CAST(round(l.l_extendedprice*100) AS BIGINT) AS VARCHAR(20))) AS rel_id
FROM lineitem l JOIN orders o ON l.l_orderkey=o.o_orderkey"""),
    ("party", """
SELECT concat('C',CAST(c_custkey AS VARCHAR(20))) AS nodo, c_custkey AS k, c_nationkey AS nk,
       c_acctbal AS bal, c_mktsegment AS sector FROM customer
UNION ALL
SELECT concat('S',CAST(s_suppkey AS VARCHAR(20))), s_suppkey, s_nationkey, s_acctbal, 'SUPPLIER' FROM supplier"""),
    ("nodos", """
SELECT p.nodo,
       CASE WHEN p.k % 10 = 0 THEN NULL ELSE n.n_name END AS grupo,
       CASE WHEN p.k % 10 = 0 THEN NULL
            WHEN p.nk % 5 <> 0 AND ROW_NUMBER() OVER (PARTITION BY p.nk, p.k % 10 = 0 ORDER BY p.nodo) = 1 THEN 'M'
            ELSE 'F' END AS ind_filial_matriz,
       CASE WHEN p.k % 7 = 0 THEN NULL ELSE CAST(p.bal AS DECIMAL(18,2)) END AS importe,
       p.sector,
       CASE WHEN p.bal < 2500 THEN 'small' WHEN p.bal < 6000 THEN 'medium' ELSE 'large' END AS tamano,
       CASE WHEN p.k % 11 = 0 THEN NULL WHEN p.k % 3 = 0 THEN 'R' ELSE 'N' END AS situ
FROM party p JOIN nation n ON p.nk = n.n_nationkey"""),
    ("balance", """
SELECT concat('C',CAST(o_custkey AS VARCHAR(20))) AS id, CAST(year(o_orderdate) AS INT) AS clcb_ano_ejercicio,
       CAST(o_totalprice AS DECIMAL(18,2)) AS importe_balance, o_orderkey AS bal_id FROM orders"""),
    ("relaciones", """
SELECT r.*, i.grupo AS grupo_ini, f.grupo AS grupo_fin, i.situ AS situ_ini, f.situ AS situ_fin
FROM rel_raw r LEFT JOIN nodos i ON r.nodo_ini=i.nodo LEFT JOIN nodos f ON r.nodo_fin=f.nodo"""),
    ("identity", """
SELECT DISTINCT concat('C',CAST(o.o_custkey AS VARCHAR(20))) AS id, c.c_name AS cif,
       concat(CAST(year(o.o_orderdate) AS VARCHAR), '-', lpad(CAST(month(o.o_orderdate) AS VARCHAR), 2, '0'), '-01')
         AS fechadato
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey"""),
    ("legal", """
SELECT concat('C',CAST(c_custkey AS VARCHAR(20))) AS id, c_mktsegment AS forma_juridica, c_nationkey AS pais
FROM customer"""),
    ("rel_flags", """
SELECT r.*,
       CASE WHEN situ_ini = 'R' THEN 1 ELSE 0 END AS cliente_nocliente_ini,
       CASE WHEN situ_fin = 'R' THEN 1 ELSE 0 END AS cliente_nocliente_fin,
       CASE WHEN grupo_ini = grupo_fin THEN 1 ELSE 0 END AS relacion_entre_mismo_grupo
FROM relaciones r"""),
    ("nodos_imp", """
SELECT x.*, COALESCE(x.importe_final, (SELECT avg(importe_final) FROM (
           SELECT COALESCE(COALESCE(CAST(n2.importe AS DOUBLE), g2.m), s2.m) AS importe_final
           FROM nodos n2
           LEFT JOIN (SELECT grupo, CAST(sum(importe) AS DOUBLE) / NULLIF(CAST(count(importe) AS DOUBLE), 0) AS m
                      FROM nodos WHERE grupo IS NOT NULL GROUP BY grupo) g2 ON n2.grupo = g2.grupo
           LEFT JOIN (SELECT sector, CAST(sum(importe) AS DOUBLE) / NULLIF(CAST(count(importe) AS DOUBLE), 0) AS m
                      FROM nodos WHERE sector IS NOT NULL GROUP BY sector) s2 ON n2.sector = s2.sector) t))
         AS importe_final_sinnulos
FROM (
  SELECT y.*, COALESCE(y.importe_sinnone, y.media_importe_sector) AS importe_final FROM (
    SELECT n.*, g.media_importe_grupo,
           COALESCE(CAST(n.importe AS DOUBLE), g.media_importe_grupo) AS importe_sinnone,
           s.media_importe_sector
    FROM nodos n
    LEFT JOIN (SELECT grupo, CAST(sum(importe) AS DOUBLE) / NULLIF(CAST(count(importe) AS DOUBLE), 0)
                 AS media_importe_grupo FROM nodos WHERE grupo IS NOT NULL GROUP BY grupo) g ON n.grupo = g.grupo
    LEFT JOIN (SELECT sector, CAST(sum(importe) AS DOUBLE) / NULLIF(CAST(count(importe) AS DOUBLE), 0)
                 AS media_importe_sector FROM nodos WHERE sector IS NOT NULL GROUP BY sector) s
      ON n.sector = s.sector) y) x"""),
]


def with_fixtures(body: str, extra: list[tuple[str, str]] | None = None) -> str:
    """Prefix ``body`` with the fixture views (and ``extra`` CTEs that may use them)."""
    ctes = FIXTURE_CTES + list(extra or [])
    return "WITH RECURSIVE " + ",\n".join(f"{name} AS ({sql.strip()})" for name, sql in ctes) + "\n" + body.strip()
