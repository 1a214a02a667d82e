"""Billing imputation: group mean, then sector mean, then the overall mean."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdnet.functions import mean_of


def impute_amount(nodes: DataFrame, amount: str = "importe") -> DataFrame:
    """Adds ``media_importe_grupo``, ``importe_sinnone``, ``media_importe_sector``,
    ``importe_final`` and ``importe_final_sinnulos`` (all double).

    Both means are over the original amounts; the last fallback is the mean of
    ``importe_final``, evaluated as a scalar subquery (one row, no join).
    """
    by_group = (nodes.filter(F.col("grupo").isNotNull()).groupBy("grupo")
                .agg(mean_of(amount).alias("media_importe_grupo")))
    by_sector = (nodes.filter(F.col("sector").isNotNull()).groupBy("sector")
                 .agg(mean_of(amount).alias("media_importe_sector")))
    out = (nodes.join(by_group, "grupo", "left").join(by_sector, "sector", "left")
           .withColumn("importe_sinnone", F.coalesce(F.col(amount).cast("double"), F.col("media_importe_grupo")))
           .withColumn("importe_final", F.coalesce(F.col("importe_sinnone"), F.col("media_importe_sector"))))
    overall = out.agg(F.avg("importe_final")).scalar()
    return out.withColumn("importe_final_sinnulos", F.coalesce(F.col("importe_final"), overall))
