"""Per-key shares and counts attached to every relation or company (company features,
relation features and the first node features).

All shares that one feature table needs are aggregated in a single pass over a
narrow projection of the relations: every relation is expanded to one row per
share it takes part in, pre-aggregated on the map side, and the small result is
written once.  Each share is then left-joined back, so the relations are read
twice however many shares are asked for.  Rows whose key is null are kept out of
the aggregation (they can never match the join-back, as in the reference).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdnet.functions import share
from holdnet.operators.flags import client_flag, same_group_flag
from holdnet.operators.impute import impute_amount
from holdnet.operators.tables import attach, pair_month_dedup
from holdnet.session import written

MONTH = ["date_year_ini", "date_month_ini"]
#: Rows of a share (groups by month, say) up to which it is broadcast, so that the relations stay where they are.  Longer
#: ones, a row per company, are joined by a shuffle already at a few thousand companies: disk and memory a row stay the same.
SMALL_ROWS = 5_000


@dataclass(frozen=True)
class KeyShare:
    """Share of rows with ``flag`` among the rows of each ``key`` (and month, if ``monthly``)."""
    out: str
    key: str
    flag: str
    monthly: bool


GROUP_CLIENT = [KeyShare(f"proporcion_cliente_{s}", f"grupo_{s}", f"cliente_nocliente_{s}", True) for s in ("ini", "fin")]
PARTNER_CLIENT = [KeyShare("prop_cliente_relaciones_ini", "nodo_ini", "cliente_nocliente_fin", True),
                  KeyShare("prop_cliente_relaciones_fin", "nodo_fin", "cliente_nocliente_ini", True)]
SAME_GROUP = [KeyShare(f"proporcion_relaciones_congrupo_{s}", f"nodo_{s}", "relacion_entre_mismo_grupo", False)
              for s in ("ini", "fin")]


def key_shares(df: DataFrame, shares: list[KeyShare]) -> DataFrame:
    """``(which, key, year, month, value)`` of all asked shares, from one pass over ``df``; written once."""
    none = F.lit(None).cast("int")
    parts = [F.when(F.col(s.key).isNotNull(), F.struct(
        F.lit(k).alias("which"), F.col(s.key).alias("key"),
        (F.col(MONTH[0]) if s.monthly else none).cast("int").alias("year"),
        (F.col(MONTH[1]) if s.monthly else none).cast("int").alias("month"), F.col(s.flag).alias("flag")))
        for k, s in enumerate(shares)]
    rows = df.select(F.explode(F.array_compact(F.array(*parts))).alias("r")).select("r.*")
    table = rows.groupBy("which", "key", "year", "month").agg(share(F.sum("flag"), F.count("flag")).alias("value"))
    return written(table, "shares")


def attach_shares(df: DataFrame, shares: list[KeyShare], onto: DataFrame | None = None) -> DataFrame:
    """The shares of ``df`` attached to its rows (or to those of ``onto``).

    Broadcast shares are attached last: their values need not travel with the relations to the joins of the others.
    """
    table = key_shares(df, shares)
    rows = {r.which: r["count"] for r in table.groupBy("which").count().collect()}  # one row per share
    few = {k: rows.get(k, 0) <= SMALL_ROWS for k in range(len(shares))}
    base = df if onto is None else onto
    out = base
    for k, s in sorted(enumerate(shares), key=lambda ks: few[ks[0]]):
        keys = [s.key, *MONTH] if s.monthly else [s.key]
        names = dict(zip(["key", "year", "month"], keys, strict=False))
        one = table.filter(F.col("which") == k).select(*[F.col(c).alias(n) for c, n in names.items()], F.col("value").alias(s.out))
        out = attach(out, one.hint("broadcast" if few[k] else "merge"), keys)
    return out.select(*base.columns, *[s.out for s in shares])


def _bucketed(df: DataFrame, shares: list[KeyShare], no_group: str) -> tuple[DataFrame, list[KeyShare], list[str]]:
    if no_group == "null":
        return df, shares, []
    if no_group != "bucket":
        raise ValueError("no_group must be 'null' or 'bucket'")
    grouped = {s.key: f"_{s.key}_key" for s in shares if s.key.startswith("grupo_")}
    df = df.withColumns({new: F.coalesce(F.col(old), F.lit("no_grupo")) for old, new in grouped.items()})
    return df, [KeyShare(s.out, grouped.get(s.key, s.key), s.flag, s.monthly) for s in shares], list(grouped.values())


def group_client_share(df: DataFrame, no_group: str = "null") -> DataFrame:
    """Share of client rows per (group, month) of each end, attached to each relation.

    ``no_group='null'`` reproduces the reference (rows without group get null,
    Q4); ``'bucket'`` pools them under 'no_grupo'.
    """
    src, shares, extra = _bucketed(df, GROUP_CLIENT, no_group)
    return attach_shares(src, shares).drop(*extra)


def partner_client_share(df: DataFrame) -> DataFrame:
    """Per (company, month): share of client partners on the other end."""
    return attach_shares(df, PARTNER_CLIENT)


def company_features(df: DataFrame, no_group: str = "null") -> DataFrame:
    """Client flags, same-group flag, group client shares and partner client shares."""
    src, shares, extra = _bucketed(same_group_flag(client_flag(df)), GROUP_CLIENT + PARTNER_CLIENT, no_group)
    return attach_shares(src, shares).drop(*extra)


def same_group_share(df: DataFrame) -> DataFrame:
    """Share of each company's relations (all months) that stay inside its group."""
    return attach_shares(df, SAME_GROUP)


def company_shares(df: DataFrame) -> DataFrame:
    """Per company (``nodo``): share of its relations as start and as end that stay inside its group."""
    table = key_shares(df, SAME_GROUP)
    return table.groupBy(F.col("key").alias("nodo")).agg(*[
        F.max(F.when(F.col("which") == k, F.col("value"))).alias(s.out) for k, s in enumerate(SAME_GROUP)])


def client_and_group_shares(df: DataFrame) -> DataFrame:
    """Group client shares and same-group shares of flagged relations in one pass."""
    return attach_shares(df, GROUP_CLIENT + SAME_GROUP)


COUNTS = ["conteo_relacion_mismogrupo_ini", "conteo_relacion_mismogrupo_fin"]


def _partner_counts(df: DataFrame) -> list[DataFrame]:
    """Distinct same-group partners per start (``nodo_ini``) and per end company (``nodo_fin``), written: a row per company."""
    pairs = df.filter(F.col("grupo_ini") == F.col("grupo_fin")).select("nodo_ini", "nodo_fin").distinct()
    ends = F.array(*[F.struct(F.lit(k).alias("which"), F.col(key).alias("key"), F.col(other).alias("other"))
                     for k, (key, other) in enumerate((("nodo_ini", "nodo_fin"), ("nodo_fin", "nodo_ini")))])
    table = written(pairs.select(F.explode(ends).alias("e")).select("e.*").filter("key is not null")
                    .groupBy("which", "key").agg(F.count("other").alias("n")), "partners")
    return [table.filter(F.col("which") == k).select(F.col("key").alias(key), F.col("n").alias(COUNTS[k]))
            for k, key in enumerate(("nodo_ini", "nodo_fin"))]


def same_group_partner_count(df: DataFrame, tie_break: str = "rel_id") -> DataFrame:
    """Distinct same-group partners per start and per end company, one row per pair and month.

    The distinct same-group pairs are computed once and feed both counts; the pair-month dedupe runs before the join-back,
    which gives the same rows as the reference's dedupe after it.
    """
    out = pair_month_dedup(df, tie_break)
    for counts in _partner_counts(df):  # a row per company: joined by a shuffle at every size
        out = attach(out, counts.hint("merge"), counts.columns[:1])
    return out.fillna(0, subset=COUNTS)


def relation_features(df: DataFrame, tie_break: str = "rel_id") -> DataFrame:
    """Same-group shares of all relations and partner counts, on one row per pair and month.

    A company's share and count are put together first, so the relations are shuffled once per end.  Every company of an end
    has a share row, so none of its counts is lost.
    """
    base = out = pair_month_dedup(df, tie_break)
    table, counts = key_shares(df, SAME_GROUP), _partner_counts(df)
    for k, (s, count) in enumerate(zip(SAME_GROUP, counts, strict=True)):
        one = table.filter(F.col("which") == k).select(F.col("key").alias(s.key), F.col("value").alias(s.out))
        out = attach(out, one.join(count, s.key, "left").hint("merge"), [s.key])
    return out.select(*base.columns, *[s.out for s in SAME_GROUP], *COUNTS).fillna(0, subset=COUNTS)


def group_amount_share(nodes: DataFrame) -> DataFrame:
    """Each company's part of its group's billing (amounts filled with the group mean).

    The group total of the filled amounts equals sum(known) * n / n_known, which
    is computed exactly from the decimal sum instead of re-adding doubles.
    """
    imp = impute_amount(nodes)
    tot = (nodes.filter(F.col("grupo").isNotNull()).groupBy("grupo")
           .agg((F.sum("importe").cast("double") * F.count(F.lit(1)).cast("double")
                 / F.nullif(F.count("importe"), F.lit(0)).cast("double")).alias("importe_total_grupo")))
    out = attach(imp, tot, ["grupo"])
    return out.withColumn("proporcion_importe_sobre_grupo", share(F.col("importe_sinnone"), F.col("importe_total_grupo")))


def group_reach_share(node_counts: DataFrame) -> DataFrame:
    """Same-group partners of a company over the number of companies of its group; null -> 0."""
    sizes = (node_counts.filter(F.col("grupo").isNotNull()).groupBy("grupo")
             .agg(F.count_distinct("nodo").alias("conteo_empresas")))
    out = attach(node_counts, sizes, ["grupo"])
    return (out.withColumn("porcentajedelgrupo_conelqueserelaciona",
                           share(F.col("conteo_relacion_mismogrupo"), F.col("conteo_empresas")))
            .fillna(0, subset=["porcentajedelgrupo_conelqueserelaciona"]))


def node_partner_counts(rel_features: DataFrame) -> DataFrame:
    """Company table carrying the same-group partner count under one name (Q14).

    A company seen on both sides has a start count and an end count; the larger is kept.  Both ends are taken from one
    pass over the relations.
    """
    ends = [F.struct(F.col(f"nodo_{s}").alias("nodo"), F.col(f"grupo_{s}").alias("grupo"),
                     F.col(f"conteo_relacion_mismogrupo_{s}").alias("c")) for s in ("ini", "fin")]
    return (rel_features.select(F.explode(F.array(*ends)).alias("e")).select("e.*").groupBy("nodo", "grupo")
            .agg(F.max("c").alias("conteo_relacion_mismogrupo")))


def group_row_count(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("grupo").isNotNull()).groupBy("grupo").agg(F.count("nodo").alias("emp"))
