"""Exact running sums and row numbers without a single-task window.

A window with no partition key (or one hot key) runs on one task.  Here the
rows are range-partitioned on (keys, order) into blocks, so a hot key spreads
over many blocks; running sums are computed inside each (block, key) and the
totals of earlier blocks of the same key are added as an offset.  The offset
table has at most (blocks x keys) rows.  All of it is plain Spark SQL; the
block assignment is written once to the checkpoint folder so every branch
(and every retry) sees the same blocks.

The order must be total inside each key (add a unique tie-break), otherwise
the split of equal rows between blocks is arbitrary.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdnet.session import pin

#: Quantiles: buckets of a histogram pass, and different values of a bracket that a window ranks.
BUCKETS, RANKED = 256, 50_000

def _cols(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
                 weights: dict[str, str | Column], blocks: int | None = None) -> DataFrame:
    """Add inclusive running sums ``{out: weight}`` inside each ``keys`` group following ``order``."""
    keys = list(keys)
    order_cols = _cols(order)
    w_named = {f"_w_{o}": (F.col(w) if isinstance(w, str) else w) for o, w in weights.items()}
    base = df.withColumns(w_named)
    # Block ids come from the range shuffle, whose bounds are sampled: a recomputation (two branches
    # of one plan, or a lost executor) could draw other bounds.  A reliable checkpoint pins them once.
    # Without a given number, AQE joins neighbouring ranges by the size of the data.
    by = [*[F.col(k) for k in keys], *order_cols]
    ranged = pin((base.repartitionByRange(blocks, *by) if blocks else base.repartitionByRange(*by))
                 .withColumn("_blk", F.spark_partition_id()))
    local_w = (Window.partitionBy("_blk", *keys).orderBy(*order_cols)
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = ranged.withColumns({f"_loc_{o}": F.sum(f"_w_{o}").over(local_w) for o in weights})
    totals = ranged.groupBy("_blk", *keys).agg(*[F.sum(f"_w_{o}").alias(f"_tot_{o}") for o in weights])
    prev = Window.partitionBy(*keys).orderBy("_blk") if keys else Window.orderBy("_blk")
    prev = prev.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("_blk").alias("_oblk"), *[F.col(k).alias(f"_ok{i}") for i, k in enumerate(keys)], *[
        F.coalesce(F.sum(f"_tot_{o}").over(prev), F.lit(0)).alias(f"_off_{o}") for o in weights])
    cond = [F.col("_blk") == F.col("_oblk")] + [F.col(k).eqNullSafe(F.col(f"_ok{i}")) for i, k in enumerate(keys)]
    joined = local.join(offsets, cond, "inner")
    out_cols = [F.col(c) for c in df.columns] + [
        (F.col(f"_loc_{o}") + F.col(f"_off_{o}")).alias(o) for o in weights]
    return joined.select(*out_cols)


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], out: str = "rn",
                blocks: int | None = None) -> DataFrame:
    """1-based row number inside ``keys`` following a total ``order``."""
    return running_sums(df, keys, order, {out: F.lit(1).cast("long")}, blocks)


def quantiles(values: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float],
              names: Sequence[str]) -> DataFrame:
    """Exact quantiles with linear interpolation (pandas/numpy default) per ``keys``; see :func:`quantiles_of_counts`."""
    counts = (values.filter(F.col(value).isNotNull()).groupBy(*keys, value)
              .agg(F.count(F.lit(1)).alias("_c")))
    return quantiles_of_counts(pin(counts), keys, value, probs, names)


def quantiles_of_counts(counts: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float],
                        names: Sequence[str]) -> DataFrame:
    """Exact quantiles per ``keys`` of rows counted per distinct (key, value) in ``_c``; best a written table.

    Selection without a sort: every wanted rank has a bracket of values, at first the group's smallest and largest.  While a
    bracket holds more than ``RANKED`` different values, one pass counts its values in buckets (partial
    aggregation) and the bracket becomes the bucket that holds the rank: one bucket a sign, then ``BUCKETS`` equal steps of the
    logarithm while the ends differ by orders of magnitude, then of the value, so a few passes do for any doubles.  What is
    left, at most ``RANKED`` values a bracket, is ranked by a window.  No group is ever collected or sorted as a whole.
    """
    keys = list(keys)
    v = F.col(value)
    counts = counts.withColumn(value, v.cast("double"))
    groups = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"), F.count(F.lit(1)).alias("_d"), F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    ranks = F.explode(F.array(*[F.struct(F.lit(i).alias("_q"), (F.lit(float(p)) * (F.col("_n") - 1)).alias("_pos"))
                                for i, p in enumerate(probs)])).alias("_t")
    brackets = groups.select(*keys, "_d", "_lo", "_hi", ranks).select(
        *keys, "_d", "_lo", "_hi", "_t._q", "_t._pos", F.explode(F.array(
            F.struct(F.lit(0).alias("_side"), F.floor("_t._pos").alias("_r")),
            F.struct(F.lit(1).alias("_side"), F.ceil("_t._pos").alias("_r")))).alias("_s")).select(
        *keys, "_d", "_lo", "_hi", "_q", "_pos", "_s._side", "_s._r")
    while (brackets.agg(F.max("_d")).first()[0] or 0) > RANKED:
        brackets = pin(_narrowed(counts, brackets, keys, value))
    inside = _inside(counts, brackets, keys, value)
    hit = _hit(brackets, inside.withColumn("_end", _running(keys, v)), keys)
    per_q = hit.groupBy(*keys, "_q", "_pos").agg(
        F.max(F.when(F.col("_side") == 0, v)).alias("_vlo"), F.max(F.when(F.col("_side") == 1, v)).alias("_vhi"))
    frac = F.col("_pos") - F.floor("_pos")
    per_q = per_q.withColumn("_qv", F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * frac)
    return per_q.groupBy(*keys).agg(*[
        F.max(F.when(F.col("_q") == i, F.col("_qv"))).alias(name) for i, name in enumerate(names)])


def _inside(counts: DataFrame, brackets: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The counted values of every different bracket: ``keys..., _lo, _hi, value, _c``."""
    spans = brackets.select(*[F.col(k).alias(f"_s{i}") for i, k in enumerate(keys)], "_lo", "_hi").distinct()
    same = [F.col(k).eqNullSafe(F.col(f"_s{i}")) for i, k in enumerate(keys)]
    return counts.join(spans, [*same, F.col(value).between(F.col("_lo"), F.col("_hi"))]).select(*keys, "_lo", "_hi", value, "_c")


def _running(keys: list[str], order: str | Column) -> Column:
    """Rows up to here inside a bracket."""
    return F.sum("_c").over(Window.partitionBy(*keys, "_lo", "_hi").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))


def _hit(brackets: DataFrame, steps: DataFrame, keys: list[str]) -> DataFrame:
    """Each bracket's rank with the step (a value or bucket with ``_c`` rows, ``_end`` up to it) that holds it."""
    on = [*keys, "_lo", "_hi"]
    right = steps.select(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(on)], *[c for c in steps.columns if c not in on])
    same = [F.col(c).eqNullSafe(F.col(f"_o{i}")) for i, c in enumerate(on)]
    holds = (F.col("_end") - F.col("_c") <= F.col("_r")) & (F.col("_r") < F.col("_end"))
    return brackets.join(right, [*same, holds]).drop(*[f"_o{i}" for i in range(len(on))])


def _narrowed(counts: DataFrame, brackets: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The brackets after one histogram pass over those that hold more than RANKED values."""
    wide = brackets.filter(F.col("_d") > RANKED)
    inside = _inside(counts, wide, keys, value)
    x, lo, hi = F.col(value), F.col("_lo"), F.col("_hi")

    def log(c: Column) -> Column:
        return F.signum(c) * F.ln(F.abs(c))

    def step(f) -> Column:  # equal steps of f; halves, so that differences stay finite
        return F.least(F.floor(F.try_divide(f(x) / 2 - f(lo) / 2, f(hi) / 2 - f(lo) / 2) * BUCKETS), F.lit(BUCKETS - 1))

    bucket = F.when(F.signum(lo) * F.signum(hi) <= 0, F.signum(x).cast("long")).when(
        F.abs(log(hi) - log(lo)) > 1, step(log)).otherwise(step(lambda c: c))
    steps = inside.groupBy(*keys, "_lo", "_hi", bucket.alias("_b")).agg(
        F.sum("_c").alias("_c"), F.count(F.lit(1)).alias("_nd"), F.min(value).alias("_nlo"), F.max(value).alias("_nhi"))
    steps = steps.withColumn("_nd", F.when(F.col("_nlo") < F.col("_nhi"), F.col("_nd")).otherwise(1))
    found = _hit(wide, steps.withColumn("_end", _running(keys, "_b")), keys)
    new = found.select(*keys, F.col("_nd").alias("_d"), F.col("_nlo").alias("_lo"), F.col("_nhi").alias("_hi"), "_q", "_pos", "_side",
                       (F.col("_r") - (F.col("_end") - F.col("_c"))).alias("_r"))
    return brackets.filter(F.col("_d") <= RANKED).unionByName(new)
