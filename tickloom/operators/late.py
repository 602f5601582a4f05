"""Event-time aggregates that late rows correct by retraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PERIOD_US = 300_000_000
LATENESS_US = 1_200_000_000


def late_changelog(rows: DataFrame, keys: list[str], period_us: int = PERIOD_US, lateness_us: int = LATENESS_US, slot_us: int = 60_000_000) -> DataFrame:
    """The changes of per-period aggregates as late rows arrive.

    rows: keys, event_us, arrived_us, value (nullable double). Result: keys, period_start_us, version, op, n, total, low,
    high, verdict. op +1 sets a version of the aggregate and -1 takes back the version before; version 0 is what had
    arrived at the end of the period (absent if nothing had), and each slot_us of arrivals after it makes one version.
    Summing op*n and op*total over any prefix of versions gives the aggregate of that time. Rows that arrive
    lateness_us or more after the end of the period change nothing; they are counted in rows with verdict refused and op 0.

    Rows without either time are left out; null keys form their own groups; repeated rows all count. Partial sums
    are formed before the only shuffle, and a period has at most lateness_us / slot_us + 2 of them, so that neither a hot key
    nor a burst grows a task.
    """
    end = F.col("period_start_us") + period_us
    slotted = (
        rows.where("event_us is not null and arrived_us is not null")
        .withColumn("period_start_us", F.floor(F.col("event_us") / period_us).cast("long") * period_us)
        .withColumn("slot", F.when(F.col("arrived_us") < end, 0).when(F.col("arrived_us") >= end + lateness_us, -1).otherwise(1 + F.floor((F.col("arrived_us") - end) / slot_us)).cast("int"))
    )
    parts = slotted.groupBy(*keys, "period_start_us", "slot").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.min("value").alias("low"), F.max("value").alias("high"))
    w = Window.partitionBy(*keys, "period_start_us").orderBy("slot")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    kept = F.col("slot") >= 0

    def running(f, c: str):
        return f(F.when(kept, F.col(c))).over(upto)

    state = parts.withColumn("new", F.struct(running(F.sum, "n").alias("n"), running(F.sum, "total").alias("total"), running(F.min, "low").alias("low"), running(F.max, "high").alias("high")))
    state = state.withColumn("old", F.lag("new").over(w))
    verdict = F.when(F.col("slot") < 0, "refused").when(F.col("slot") > 0, "corrected").otherwise("on_time")
    delta = lambda op, c: F.struct(F.lit(op).alias("op"), *[F.col(f"{c}.{k}").alias(k) for k in ("n", "total", "low", "high")])
    refused = F.array(F.struct(F.lit(0).alias("op"), "n", "total", "low", "high"))
    moves = F.when(F.col("slot") < 0, refused).when(F.col("old.n").isNull(), F.array(delta(1, "new"))).otherwise(F.array(delta(-1, "old"), delta(1, "new")))
    out = state.select(*keys, "period_start_us", F.col("slot").alias("version"), verdict.alias("verdict"), F.explode(moves).alias("d"))
    return out.select(*keys, "period_start_us", "version", "verdict", "d.op", "d.n", "d.total", "d.low", "d.high")


def downstream(changelog: DataFrame, keys: list[str], period_us: int) -> DataFrame:
    """The changelog's deltas added up to longer periods: the next level of the same differential flow."""
    longer = (F.floor(F.col("period_start_us") / period_us) * period_us).cast("long")
    return (
        changelog.where("op <> 0")
        .groupBy(*keys, longer.alias("period_start_us"))
        .agg(F.sum(F.col("op") * F.col("n")).alias("n"), F.sum(F.col("op") * F.col("total")).alias("total"))
    )
