"""Cutting one hot time series into shards without changing results.

A window with a bounded frame runs per (key, shard) on the shard's own rows plus a halo; cumulative values are computed per
shard and completed with a prefix over the shards' totals. Either way no key, however hot, is one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_US = 86_400_000_000
SHARD_US = 21_600_000_000


def shard_of(t: str | Column, shard_us: int = SHARD_US) -> Column:
    return F.floor((F.col(t) if isinstance(t, str) else t) / shard_us).cast("long")


def with_halo(df: DataFrame, t: str, back_us: int = 0, ahead_us: int = 0, shard_us: int = SHARD_US) -> DataFrame:
    """df with shard and core: each row in its own shard (core) and, as a copy, in those whose rows look back or ahead to it."""
    own = shard_of(t, shard_us)
    reach = F.sequence(shard_of(F.col(t) - ahead_us, shard_us), shard_of(F.col(t) + back_us, shard_us))
    return df.where(F.col(t).isNotNull()).withColumn("shard", F.explode(reach)).withColumn("core", F.col("shard") == own)


def core(df: DataFrame) -> DataFrame:
    return df.where("core").drop("core", "shard")


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str, shard: Column) -> DataFrame:
    """df with the sum of value over the rows of its key up to itself. shard must not decrease along the order."""
    rows = df.withColumn("_v", value).withColumn("_shard", shard)
    totals = rows.groupBy(*keys, "_shard").agg(F.sum("_v").alias("_total"))
    before = F.coalesce(F.sum("_total").over(Window.partitionBy(*keys).orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select(*keys, "_shard", before.alias("_before"))
    inside = F.sum("_v").over(Window.partitionBy(*keys, "_shard").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_inside", inside).join(totals, [*keys, "_shard"], "left").withColumn(name, F.col("_before") + F.col("_inside")).drop("_v", "_shard", "_inside", "_before")


def running_max(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str, shard: Column) -> DataFrame:
    """df with the greatest value of the rows of its key up to itself. shard must not decrease along the order."""
    rows = df.withColumn("_v", value).withColumn("_shard", shard)
    tops = rows.groupBy(*keys, "_shard").agg(F.max("_v").alias("_top"))
    tops = tops.select(*keys, "_shard", F.max("_top").over(Window.partitionBy(*keys).orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    inside = F.max("_v").over(Window.partitionBy(*keys, "_shard").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_inside", inside).join(tops, [*keys, "_shard"], "left").withColumn(name, F.greatest("_before", "_inside")).drop("_v", "_shard", "_inside", "_before")


def carried(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str, shard: Column, forward: bool = False, strict: bool = False) -> DataFrame:
    """df with the last non-null value at or before each row (forward: the first at or after it; strict: not the row's own)."""
    rows = df.withColumn("_v", value).withColumn("_shard", shard)
    key = F.struct(*order, "_v")
    known = rows.where("_v is not null").groupBy(*keys, "_shard").agg((F.min(key) if forward else F.max(key)).alias("_k"))
    shards = rows.select(*keys, "_shard").distinct().join(known, [*keys, "_shard"], "left")
    # forward in descending order, as a frame that runs to the end costs all rows behind it
    turn = F.desc if forward else F.asc
    inside = F.last("_v", ignorenulls=True).over(Window.partitionBy(*keys, "_shard").orderBy(*map(turn, order)).rowsBetween(Window.unboundedPreceding, -1 if strict else 0))
    outside = F.last("_k._v", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(turn("_shard")).rowsBetween(Window.unboundedPreceding, -1))
    shards = shards.select(*keys, "_shard", outside.alias("_outside"))
    return rows.withColumn("_inside", inside).join(shards, [*keys, "_shard"], "left").withColumn(name, F.coalesce("_inside", "_outside")).drop("_v", "_shard", "_inside", "_outside")
