"""Graph operators on edge tables: degree centralities, group graphs, parents and central roles.

Graphs stay as edge DataFrames; nothing is collected.  A group graph is every
edge touching a member of the group, so each edge is emitted at most twice
(once for the group of each end): linear in the number of edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdnet.functions import flag
from holdnet.operators.tables import keep_first

#: Fixed value: the label of a group without a parent.
NO_PARENT = "no_tiene_matriz"


def _centrality(deg: str, n: str | object) -> F.Column:
    """networkx degree centrality: degree / (n - 1); a one-node graph gives 1."""
    n_col = F.col(n) if isinstance(n, str) else n
    return F.when(n_col > 1, F.col(deg) / (n_col - 1)).otherwise(F.lit(1.0))


def total_degree_centrality(rel: DataFrame, src: str = "nodo_ini", dst: str = "nodo_fin") -> DataFrame:
    """Degree centrality of the undirected simple graph of all relations.

    Edges become distinct unordered pairs; a self-loop adds 2 to its node.  The
    node count is a scalar subquery, not a join.
    """
    pairs = rel.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter(
        F.col("a").isNotNull() & F.col("b").isNotNull())
    und = pairs.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
    ends = und.select(F.col("u").alias("nodo")).unionAll(und.select(F.col("v").alias("nodo")))
    deg = ends.groupBy("nodo").agg(F.count(F.lit(1)).alias("grado"))
    n = deg.agg(F.count(F.lit(1))).scalar()
    return deg.withColumn("centralidad", _centrality("grado", n))


def last_edge_values(edges: DataFrame, order: tuple[str, ...] = ("anho_mes", "rel_id")) -> DataFrame:
    """One row per directed (src, dst) carrying the value of its latest row (networkx keeps the last)."""
    cols = [c for c in order if c in edges.columns]
    last = F.max(F.struct(*cols, F.col("value").cast("double").alias("value"))) if cols else None
    if last is None:
        return edges.groupBy("src", "dst").agg(F.max(F.col("value").cast("double")).alias("value"))
    return edges.groupBy("src", "dst").agg(last.alias("_last")).select("src", "dst", "_last.value")


def _members(nodes: DataFrame, no_group: str) -> DataFrame:
    if no_group == "bucket":
        return nodes.select("nodo", F.coalesce("grupo", F.lit("no_grupo")).alias("grupo"))
    return nodes.filter(F.col("grupo").isNotNull()).select("nodo", "grupo")


def _in_groups(df: DataFrame, groups: DataFrame | None) -> DataFrame:
    """Rows of the caller's groups (a DataFrame with ``grupo``); all rows without a list."""
    return df if groups is None else df.join(groups.select("grupo").distinct(), "grupo", "left_semi")


def group_edges(edges: DataFrame, nodes: DataFrame, no_group: str = "null",
                attributes: tuple[str, ...] = ("grupo", "ind_filial_matriz"), groups: DataFrame | None = None) -> DataFrame:
    """Edges of every group graph (or of the listed groups): (grupo, src, dst, value) plus attributes of both ends.

    Both ends' attributes are joined once; an edge belongs to the group of each end, once if they are the same.
    """
    ge = last_edge_values(edges).filter(F.col("src").isNotNull() & F.col("dst").isNotNull())
    member = _members(nodes, no_group).withColumnRenamed("grupo", "_member")
    attrs = nodes.select("nodo", *attributes).join(member, "nodo", "left") if no_group == "bucket" else nodes.select(
        "nodo", *attributes, F.col("grupo").alias("_member"))
    for side in ("src", "dst"):
        ge = ge.join(attrs.select(F.col("nodo").alias(side), F.col("_member").alias(f"_{side}_member"),
                                  *[F.col(a).alias(f"{side}_{a}") for a in attributes]), side, "left")
    of = F.array_distinct(F.array_compact(F.array("_src_member", "_dst_member")))
    ge = ge.select(F.explode(of).alias("grupo"), "src", "dst", "value", *[f"{s}_{a}" for s in ("src", "dst") for a in attributes])
    return _in_groups(ge, groups)


def group_degree_centrality(gedges: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Directed degree centrality inside each group graph: (in + out) / (n_group - 1)."""
    ends = _in_groups(gedges.select("grupo", "src", "dst"), groups).select("grupo", F.explode(F.array("src", "dst")).alias("nodo"))
    deg = ends.groupBy("grupo", "nodo").agg(F.count(F.lit(1)).alias("grado_grupo"))
    sizes = deg.groupBy("grupo").agg(F.count(F.lit(1)).alias("n_grupo"))
    return (deg.join(sizes, "grupo")
            .withColumn("centralidad_ensu_grupo", _centrality("grado_grupo", "n_grupo")))


def node_centralities(nodes: DataFrame, total: DataFrame, by_group: DataFrame) -> DataFrame:
    """Company table + total centrality (left) + centrality in its own group graph (inner)."""
    t = total.select("nodo", "centralidad")
    g = by_group.select("grupo", "nodo", "centralidad_ensu_grupo")
    return nodes.join(t, "nodo", "left").join(g, ["grupo", "nodo"], "inner")


def group_parent(nodes: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Each group's parent (smallest 'M' company, Q6) or 'no_tiene_matriz'.

    With a list of ``groups`` every listed group has a row, also one without companies.
    """
    found = (nodes.filter(F.col("grupo").isNotNull()).groupBy("grupo")
             .agg(F.min(F.when(F.col("ind_filial_matriz") == "M", F.col("nodo"))).alias("matriz")))
    if groups is not None:
        found = groups.select("grupo").distinct().join(found, "grupo", "left")
    return found.select("grupo", F.coalesce("matriz", F.lit(NO_PARENT)).alias("matriz"))


def groups_with_without_parent(parents: DataFrame) -> DataFrame:
    """Per group whether it has a parent, with the number of groups of each kind."""
    flagged = parents.withColumn("con_matriz", flag(F.col("matriz") != NO_PARENT))
    n_with = flagged.agg(F.sum("con_matriz")).scalar()
    n_without = flagged.agg(F.sum(1 - F.col("con_matriz"))).scalar()
    return flagged.select("grupo", "matriz", "con_matriz",
                          n_with.alias("n_grupos_con_matriz"), n_without.alias("n_grupos_sin_matriz"))


def central_node_role(by_group: DataFrame, nodes: DataFrame) -> DataFrame:
    """Most central company of each group graph (ties: smallest id) and its class."""
    top = keep_first(by_group, ["grupo"], [F.col("centralidad_ensu_grupo").desc(), F.col("nodo")])
    attrs = nodes.select("nodo", F.col("grupo").alias("_g"), F.col("ind_filial_matriz").alias("_r"))
    j = top.join(attrs, "nodo", "left")
    same = F.col("_g") == F.col("grupo")
    clase = (F.when(F.col("grupo") == "no_grupo", "no_grupo")
             .when(same & (F.col("_r") == "M"), "mayor_centr_matriz")
             .when(same & (F.col("_r") == "F"), "mayor_centr_no_matriz(filial)")
             .otherwise("mayor_centr_nogrupo"))
    return j.select("grupo", F.col("nodo").alias("nodo_central"), "centralidad_ensu_grupo", clase.alias("clase"))
