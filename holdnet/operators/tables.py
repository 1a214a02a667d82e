"""Table building, projection and de-duplication (node and edge tables, balance cleaning)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from holdnet.functions import year_prefix


def _orders(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per ``keys``: the first by ``order`` (an explicit tie-break, never an arbitrary row).

    ``row_number() == 1`` is planned with a partial WindowGroupLimit before the
    shuffle, so a hot key is cut down to one row per map task first.
    """
    w = Window.partitionBy(*keys).orderBy(*_orders(order))
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def attach(df: DataFrame, agg: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left-join an aggregate back onto its rows.

    The aggregate is partial on the map side; AQE turns the join into a broadcast
    when the aggregate is small at run time, or splits skewed keys otherwise.
    Null keys never match, like the reference's joins; a null text key is
    replaced by a hash of its row for the join, so that rows without a key spread
    over all tasks instead of meeting in one.  Relations are told apart by their
    ``rel_id``: a hash of all columns would carry each of them into the join, read later or not.
    """
    first, *rest = keys
    if dict(df.dtypes)[first] != "string":
        return df.join(agg, on=list(keys), how="left")
    spread = F.concat(F.lit("\u0000"), F.xxhash64(*(["rel_id"] if "rel_id" in df.columns else df.columns)).cast("string"))
    keyed = df.withColumn("_key", F.coalesce(F.col(first), spread))
    return keyed.join(agg.withColumnRenamed(first, "_key"), on=["_key", *rest], how="left").drop("_key").select(
        *df.columns, *[c for c in agg.columns if c not in keys])


def observed(df: DataFrame, name: str, counts: dict[str, Observation] | None, where: Column | None = None) -> DataFrame:
    """``df`` with its rows (those ``where`` holds) counted as they pass, if ``counts`` is there to hold the observation.

    Give observed tables a session of their own (:func:`observing_session`): Spark 4.1 cannot ship models that were fitted
    in a session once that has observed anything, as their training summaries hold the session.
    """
    if counts is None:
        return df
    counts[name] = Observation()
    return df.observe(counts[name], F.count(F.lit(1) if where is None else F.when(where, 1)).alias("rows"))


def observing_session(spark: SparkSession) -> SparkSession:
    """A new session of the same application, with the same number of shuffle partitions and time zone."""
    own = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(key, spark.conf.get(key))
    return own


def row_counts(counts: dict[str, Observation]) -> dict[str, int]:
    """Rows per observed step, once a job over the observed table has ended (waits for it otherwise)."""
    return {name: o.get["rows"] for name, o in counts.items()}


def node_table(df: DataFrame, columns_normalized: Sequence[str], columns_ini: Sequence[str],
               columns_fin: Sequence[str]) -> DataFrame:
    """Start-side and end-side company rows, each de-duplicated, renamed by position and
    stacked by position.  A company on both sides appears twice (reference behaviour)."""
    ini = df.select(*columns_ini).dropDuplicates().select(
        *[F.col(c).alias(n) for c, n in zip(columns_ini, columns_normalized)])
    fin = df.select(*columns_fin).dropDuplicates().select(
        *[F.col(c).alias(n) for c, n in zip(columns_fin, columns_normalized)])
    return ini.union(fin)


def node_table_distinct(df: DataFrame, columns_normalized: Sequence[str], columns_ini: Sequence[str],
                        columns_fin: Sequence[str]) -> DataFrame:
    return node_table(df, columns_normalized, columns_ini, columns_fin).distinct()


def with_month_key(df: DataFrame, year: str = "date_year_ini", month: str = "date_month_ini",
                   out: str = "anho_mes") -> DataFrame:
    """``yyyyMM`` month key."""
    if out in df.columns:
        return df
    return df.withColumn(out, F.concat(F.col(year).cast("string"), F.lpad(F.col(month).cast("string"), 2, "0")))


def edge_table(df: DataFrame, columns: Sequence[str] = ("src", "dst", "anho_mes", "value", "rel_id"),
               tie_break: str = "rel_id", counts: dict[str, Observation] | None = None) -> DataFrame:
    """Rename the ends to ``src``/``dst``, project, keep one row per (src, dst, anho_mes); ``counts``: see :func:`observed`."""
    e = (with_month_key(df)
         .withColumnRenamed("nodo_ini", "src").withColumnRenamed("nodo_fin", "dst"))
    if "value" not in e.columns and "score_fin" in e.columns:
        e = e.withColumnRenamed("score_fin", "value")
    cols = list(columns)
    if tie_break not in cols:
        cols.append(tie_break)
    return observed(keep_first(e.select(*cols), ["src", "dst", "anho_mes"], [tie_break]), "edges", counts)


def year_of_date(df: DataFrame, col: str = "fechadato", out: str = "fechadato_year") -> DataFrame:
    return df.withColumn(out, year_prefix(col))


def latest_balance(bal: DataFrame, tie_break: str = "bal_id") -> DataFrame:
    """Each company's latest fiscal year, one row per (id, year).

    The reference joins the max year back and then de-duplicates; one window
    ordered by (year desc, tie-break) returns the same rows in one shuffle.
    """
    return keep_first(bal, ["id"], [F.col("clcb_ano_ejercicio").desc(), F.col(tie_break)])


def select_features(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns)


def pair_month_dedup(df: DataFrame, tie_break: str = "rel_id") -> DataFrame:
    return keep_first(df, ["nodo_ini", "nodo_fin", "date_year_ini", "date_month_ini"], [tie_break])
