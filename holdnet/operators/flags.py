"""Flags, labels and null handling on whole DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdnet.functions import equals_flag, flag, unknown_label


def client_flag(df: DataFrame, cols: Sequence[str] = ("situ_ini", "situ_fin"),
                outs: Sequence[str] = ("cliente_nocliente_ini", "cliente_nocliente_fin")) -> DataFrame:
    """1 for client status 'R', else 0 (null and unknown count as not client)."""
    return df.withColumns({o: equals_flag(c, "R") for c, o in zip(cols, outs)})


def same_group_flag(df: DataFrame, a: str = "grupo_ini", b: str = "grupo_fin",
                    out: str = "relacion_entre_mismo_grupo") -> DataFrame:
    """1 when both ends share a group; any null end gives 0."""
    return df.withColumn(out, flag(F.col(a) == F.col(b)))


def parent_flag(df: DataFrame, col: str = "ind_filial_matriz", out: str = "matriz_filia_binaria") -> DataFrame:
    return df.withColumn(out, equals_flag(col, "M"))


def no_group_label(df: DataFrame, cols: Sequence[str] = ("grupo_ini", "grupo_fin"),
                   label: str = "no_grupo") -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(label)) for c in cols})


def fill_unknown(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """null -> 'desconocido_<col>' for every listed column (the reference only fills the last, Q1)."""
    if not cols:
        return df
    return df.withColumns({c: unknown_label(c) for c in cols})


def zero_fill(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.fillna(0, subset=list(cols))


def threshold_predict(df: DataFrame, prob_col: str = "score", thr: float = 0.5,
                      out: str = "prediction") -> DataFrame:
    """1 when the probability reaches the threshold."""
    return df.withColumn(out, flag(F.col(prob_col) >= F.lit(thr)))
