"""Column expressions shared by the operators (all JVM-side, no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def flag(cond: Column) -> Column:
    """1 when ``cond`` holds, 0 when it is false or null (Python ``==`` semantics of the reference)."""
    return F.when(cond, 1).otherwise(0)


def equals_flag(col: str, value: str) -> Column:
    return flag(F.col(col) == value)


def share(num: Column, den: Column) -> Column:
    """Double ratio that is null instead of failing when the denominator is 0 (ANSI mode)."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def mean_of(col: str) -> Column:
    """Mean written as double(sum) / double(count): exact sums for decimals, null for no values."""
    return share(F.sum(col), F.count(col))


def ratio_of_flags(col: str) -> Column:
    """sum(flag) / count(flag): the reference's share of flagged rows."""
    return share(F.sum(col), F.count(col))


def unknown_label(col: str) -> Column:
    """null -> 'desconocido_<col>'; non-string columns are cast to string first."""
    return F.coalesce(F.col(col).cast("string"), F.lit(f"desconocido_{col}"))


def year_prefix(col: str) -> Column:
    return F.substring(F.col(col), 1, 4)
