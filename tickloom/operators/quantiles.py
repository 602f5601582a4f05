"""Exact quantiles without a group in one buffer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.session import written


def weighted_quantiles(counts: DataFrame, keys: list[str], value: str, weight: str, quantiles: dict[str, float]) -> DataFrame:
    """(keys, one column per quantile, _n) of values that each count `weight` times, interpolated at rank (n - 1) * p.

    counts: one row per keys and value, or several. Values are cut by range, so that no key, however many values it has, is one task; weights are
    added up per range, ranges per key, and each rank is looked up in the range that holds it. Null values and weights below one are left out;
    null keys form their own group; keys without values give no row.
    """
    good = counts.where(F.col(value).isNotNull() & (F.col(weight) > 0)).select(*keys, F.col(value).cast("double").alias("_q"), F.col(weight).cast("long").alias("_w"))
    cuts = written(good.repartitionByRange(*keys, "_q").withColumn("_p", F.spark_partition_id()))
    key = [F.col(k) for k in keys] or [F.lit(0)]
    parts = cuts.groupBy(*keys, "_p").agg(F.sum("_w").alias("_sum"))
    upto = Window.partitionBy(*key).orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumn("_before", F.sum("_sum").over(upto) - F.col("_sum")).withColumn("_n", F.sum("_sum").over(Window.partitionBy(*key)))
    rank = lambda p: (F.col("_n") - 1) * F.lit(float(p))
    ends = [(n, f, rounded(rank(p)).cast("long")) for n, p in quantiles.items() for f, rounded in (("lo", F.floor), ("hi", F.ceil))]
    holds = lambda at, first, size: (at >= first) & (at < first + size)
    wanted = parts.where(_any([holds(at, F.col("_before"), F.col("_sum")) for _, _, at in ends]))
    a, b = cuts.alias("a"), wanted.alias("b")
    rows = a.join(F.broadcast(b), [*[F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], F.col("a._p") == F.col("b._p")]).select("a.*", "_before", "_n")
    run = Window.partitionBy(*key, "_p").orderBy("_q").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_first", F.col("_before") + F.sum("_w").over(run) - F.col("_w"))
    picked = rows.groupBy(*keys).agg(F.max("_n").alias("_n"), *[F.max(F.when(holds(at, F.col("_first"), F.col("_w")), F.col("_q"))).alias(f"_{f}_{n}") for n, f, at in ends])
    between = lambda n, p: F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * (rank(p) - F.floor(rank(p)))
    return picked.select(*keys, *[between(n, p).alias(n) for n, p in quantiles.items()], "_n")


def quantiles_of(rows: DataFrame, keys: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """weighted_quantiles of raw values, counted per value first."""
    return weighted_quantiles(rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_m")), keys, value, "_m", quantiles)


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out
