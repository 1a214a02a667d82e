"""Group billing statistics, percentiles and below-percentile shares (node features)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdnet.functions import flag, share
from holdnet.operators.ranks import quantiles_of_counts
from holdnet.operators.tables import attach
from holdnet.session import pin

AMOUNT = "importe_sinnone"


def group_amount_stats(nodes: DataFrame, amount: str = AMOUNT, digits: int = 6) -> DataFrame:
    """Per group: company count, count/mean/std/min/p25/p50/p75/max of ``amount`` and the parent's amount.

    Reference semantics: the parent table is inner-joined, so a group without a
    parent has no row and a group with k parents has k rows.  Floating
    summaries are rounded to ``digits`` decimals.
    """
    grouped = nodes.filter(F.col("grupo").isNotNull())
    # one pass over the companies: rows per distinct (group, amount), written once, give everything but the parents
    counts = pin(grouped.groupBy("grupo", amount).agg(F.count(F.lit(1)).alias("_c"), F.count("nodo").alias("_emp"),
                                                      F.sum(flag(F.col("ind_filial_matriz") == "M")).alias("_m")))
    v, c = F.col(amount), F.when(F.col(amount).isNotNull(), F.col("_c"))
    mean = share(F.sum(c * v), F.sum(c))
    means = counts.groupBy("grupo").agg(mean.alias("_mean"), F.sum(c).alias("_n"))
    summary = counts.join(means, "grupo").groupBy("grupo").agg(
        F.sum("_emp").alias("emp"), F.coalesce(F.first("_n"), F.lit(0)).alias("count"),
        F.round(F.first("_mean"), digits).alias("mean"),
        F.round(F.sqrt(F.try_divide(F.sum(c * (v - F.col("_mean")) * (v - F.col("_mean"))),
                                    (F.first("_n") - 1).cast("double"))), digits).alias("std"),
        F.min(v).alias("min"), F.max(v).alias("max"))
    known = counts.filter(v.isNotNull())
    q = quantiles_of_counts(known, ["grupo"], amount, [0.25, 0.5, 0.75], ["p25", "p50", "p75"])
    q = q.select("grupo", *[F.round(c, digits).alias(c) for c in ("p25", "p50", "p75")])
    parents = counts.filter("_m > 0").select(
        "grupo", v.alias(f"{amount}_matriz"), F.explode(F.sequence(F.lit(1), F.col("_m").cast("int"))).alias("_k")).drop("_k")
    return summary.join(q, "grupo", "left").join(parents, "grupo", "inner")


def attach_percentiles(nodes: DataFrame, stats: DataFrame) -> DataFrame:
    """p25 and p75 of the company's group onto each company (null for groups without stats)."""
    return attach(nodes, stats.select("grupo", F.col("p25").alias("percentil25"),
                                      F.col("p75").alias("percentil75")).dropDuplicates(["grupo"]), ["grupo"])


def below_share(nodes: DataFrame, pct_col: str, flag_col: str, out: str, amount: str = AMOUNT) -> DataFrame:
    """Flag companies whose amount is below ``pct_col``; per group: flagged / (members - 1), 0 if undefined.

    Companies without a group are dropped (the reference inner-merges on group).
    """
    flagged = nodes.filter(F.col("grupo").isNotNull()).withColumn(flag_col, flag(F.col(amount) < F.col(pct_col)))
    agg = flagged.groupBy("grupo").agg(
        F.coalesce(share(F.sum(flag_col), F.count(flag_col) - 1), F.lit(0.0)).alias(out))
    return flagged.join(agg, "grupo", "inner")


def below_p25_share(nodes: DataFrame) -> DataFrame:
    return below_share(nodes, "percentil25", "menor_percentil25", "porcentaje_fact_menor_percentil_25")


def below_p75_share(nodes: DataFrame) -> DataFrame:
    return below_share(nodes, "percentil75", "menor_percentil75", "porcentaje_fact_menor_percentil_75")


def node_features(imputed_nodes: DataFrame) -> DataFrame:
    """Statistics -> percentiles -> share below p75 -> share below p25 (amounts compared with the
    percentile, Q3)."""
    stats = group_amount_stats(imputed_nodes)
    return below_p25_share(below_p75_share(attach_percentiles(imputed_nodes, stats)))
