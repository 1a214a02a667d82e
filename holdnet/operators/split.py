"""Group-wise train/test split and one-hot encoding."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdnet.operators.flags import parent_flag
from holdnet.operators.ranks import row_numbers


def distinct_groups(nodes: DataFrame) -> DataFrame:
    return nodes.select("grupo").distinct()


def group_split(nodes: DataFrame, seed: int = 424, train_share: float = 0.8, out: str = "conjunto") -> DataFrame:
    """Whole groups go to 'train' (the first floor(share * groups) by a seeded hash order) or 'test'.

    Companies without a group form one more unit, 'no_grupo'.  The group order
    is an exact distributed row number (no single-task window), so millions of
    groups are fine.
    """
    unit = F.coalesce(F.col("grupo"), F.lit("no_grupo"))
    units = nodes.select(unit.alias("_unit")).distinct()
    n = units.agg(F.count(F.lit(1))).scalar()
    ranked = row_numbers(units.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col("_unit")))),
                         [], ["_h", "_unit"], out="_rk")
    share = F.lit(str(train_share)).cast("decimal(10,4)")
    chosen = ranked.select("_unit", F.when(F.col("_rk") <= F.floor(n * share), "train").otherwise("test").alias(out))
    return nodes.withColumn("_unit", unit).join(chosen, "_unit").drop("_unit")


def category_levels(df: DataFrame, cols: Sequence[str]) -> dict[str, list[str]]:
    """Distinct non-null values of the columns, sorted: the names of the dummy columns, so part of the result's schema.

    For wide categories in models use ``models.encode_categories`` (sparse vectors of any width) instead.
    """
    return {c: sorted(r[0] for r in df.select(F.col(c).cast("string")).filter(F.col(c).isNotNull()).distinct().collect())
            for c in cols}


def one_hot(df: DataFrame, cols: Sequence[str] = ("sector", "tamano"),
            levels: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """``<col>_<value>`` 0/1 columns replacing each listed column; null gives all zeros."""
    levels = dict(levels) if levels is not None else category_levels(df, cols)
    dummies = [F.when(F.col(c) == v, 1).otherwise(0).alias(f"{c}_{v}") for c in cols for v in levels[c]]
    return df.select(*[c for c in df.columns if c not in cols], *dummies)


def model_table(nodes: DataFrame, cols: Sequence[str] = ("sector", "tamano"),
                levels: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Dummies plus the binary target ``matriz_filia_binaria``."""
    return parent_flag(one_hot(nodes, cols, levels))
