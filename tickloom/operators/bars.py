"""Quotes and bars. A quote has id, source, instrument, us, bid, ask, mid, spread_bps; a series is (source, instrument)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.session import us

SERIES = ["source", "instrument"]
SECOND_US = 1_000_000
FIVE_MINUTES_US = 300_000_000


def quotes(ticks: DataFrame, *extra: str) -> DataFrame:
    """The valid quotes of market ticks: both prices and the event time known, bid above zero, ask not below bid. extra: further columns to keep."""
    mid = (F.col("bid") + F.col("ask")) / 2
    rows = ticks.where("occurred_at is not null and bid > 0 and ask >= bid and source is not null and instrument is not null")
    return rows.select("id", *SERIES, us("occurred_at").alias("us"), "bid", "ask", mid.alias("mid"), ((F.col("ask") - F.col("bid")) / mid * 10_000).alias("spread_bps"), *extra)


def bucket(t: str | Column, width_us: int) -> Column:
    return (F.floor((F.col(t) if isinstance(t, str) else t) / width_us) * width_us).cast("long")


def second_bars(q: DataFrame) -> DataFrame:
    """Active seconds only: opening and last quote, ticks, and changes of bid or ask within the second."""
    inside = Window.partitionBy(*SERIES, "bar_us").orderBy("us", "id")
    rows = q.withColumn("bar_us", bucket("us", SECOND_US)).withColumn("prev", F.lag(F.struct("bid", "ask")).over(inside))
    changed = F.col("prev").isNotNull() & ((F.col("bid") != F.col("prev.bid")) | (F.col("ask") != F.col("prev.ask")))
    first, last = (f(F.struct("us", "id", "bid", "ask", "mid")) for f in (F.min, F.max))
    bars = rows.groupBy(*SERIES, "bar_us").agg(first.alias("f"), last.alias("l"), F.count(F.lit(1)).alias("tick_count"), F.sum(changed.cast("long")).alias("quote_change_count"))
    return bars.select(*SERIES, "bar_us", F.col("f.us").alias("open_us"), F.col("f.bid").alias("open_bid"), F.col("f.ask").alias("open_ask"), F.col("f.mid").alias("open_mid"), F.col("l.bid").alias("bid"), F.col("l.ask").alias("ask"), F.col("l.mid").alias("mid"), "tick_count", "quote_change_count")


def time_bars(q: DataFrame, width_us: int = FIVE_MINUTES_US) -> DataFrame:
    """Open, high, low and close of the mid per period, the executable opening prices, and the ticks. One partial aggregate per task precedes the shuffle."""
    first, last = (f(F.struct("us", "id", "bid", "ask", "mid")) for f in (F.min, F.max))
    bars = q.groupBy(*SERIES, bucket("us", width_us).alias("bar_us")).agg(first.alias("f"), last.alias("l"), F.max("mid").alias("high"), F.min("mid").alias("low"), F.count(F.lit(1)).alias("tick_count"))
    return bars.select(*SERIES, "bar_us", F.col("f.us").alias("open_us"), F.col("f.bid").alias("open_bid"), F.col("f.ask").alias("open_ask"), F.col("f.mid").alias("open"), "high", "low", F.col("l.mid").alias("close"), F.col("l.us").alias("close_us"), "tick_count")


def roll_up(bars: DataFrame, width_us: int) -> DataFrame:
    """Bars of a longer period from shorter ones."""
    first, last = F.min(F.struct("bar_us", "open")), F.max(F.struct("bar_us", "close"))
    out = bars.groupBy(*SERIES, bucket("bar_us", width_us).alias("period_us")).agg(first.alias("f"), last.alias("l"), F.max("high").alias("high"), F.min("low").alias("low"), F.sum("tick_count").alias("tick_count"))
    return out.select(*SERIES, F.col("period_us").alias("bar_us"), F.col("f.open").alias("open"), "high", "low", F.col("l.close").alias("close"), "tick_count")


def last_completed(bars: DataFrame, width_us: int, name: str) -> DataFrame:
    """bars with the close of the last longer bar that was complete when each of them began."""
    longer = roll_up(bars, width_us).select(*SERIES, F.col("bar_us").alias("period_us"), F.col("close").alias("_close"))
    w = Window.partitionBy(*SERIES).orderBy("period_us").rowsBetween(Window.unboundedPreceding, -1)
    longer = longer.withColumn(name, F.last("_close").over(w)).drop("_close")
    return bars.withColumn("period_us", bucket("bar_us", width_us)).join(longer, [*SERIES, "period_us"], "left").drop("period_us")
