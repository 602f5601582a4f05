"""Future outcomes of decision rows, kept apart from the features they label."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.bars import SERIES
from tickloom.operators.shards import with_halo
from tickloom.operators.windows import segments

SECOND = 1_000_000


@dataclass(frozen=True)
class OutcomeConfig:
    latency_us: int = 50_000
    max_entry_delay_us: int = 5 * SECOND
    max_exit_delay_us: int = 5 * SECOND
    max_gap_us: int = 5 * SECOND
    slippage_bps: float = 0.0


def outcomes(bars: DataFrame, horizon_s: int, config: OutcomeConfig = OutcomeConfig()) -> DataFrame:
    """Per second bar: entry at the first later bar's opening quote after availability and latency, exit at the first one at or after the
    entry plus the horizon, returns gross and net of both sides, and the extreme excursions between.

    valid is false, and all values null, without such quotes within their delays or when a gap lies between. A bar is available one second
    after its start; bars: SERIES, bar_us (unique per series), open_us, open_bid, open_ask. All frames are bounded
    by latency, delays and horizon, so the windows run on shards with that halo.
    """
    c = config
    ahead = SECOND + c.latency_us + c.max_entry_delay_us + horizon_s * SECOND + c.max_exit_delay_us + 2 * SECOND
    rows = segments(bars.select(*SERIES, "bar_us", "open_us", "open_bid", "open_ask"), "bar_us", c.max_gap_us)
    rows = with_halo(rows, "bar_us", ahead_us=ahead)
    quote = F.struct("open_us", "bar_us", "open_bid", "open_ask", "segment")
    # exits belong to the entry quote, by a constant offset
    w = Window.partitionBy(*SERIES, "shard").orderBy("open_us")
    h = horizon_s * SECOND
    path = w.rangeBetween(0, h - 1)
    rows = rows.withColumn("exit", F.first(quote).over(w.rangeBetween(h, h + c.max_exit_delay_us)))
    for name, f, side in (("bid_high", F.max, "open_bid"), ("bid_low", F.min, "open_bid"), ("ask_high", F.max, "open_ask"), ("ask_low", F.min, "open_ask")):
        pick = F.greatest if f is F.max else F.least
        rows = rows.withColumn(name, pick(f(side).over(path), F.col(f"exit.{side}")))
    # entries by a merge of decisions (at the instant they may execute) and quotes
    entry = F.struct("open_us", "open_bid", "open_ask", "segment", "exit", "bid_high", "bid_low", "ask_high", "ask_low")
    rows = rows.withColumn("e", entry)
    kind, none = rows.schema["e"].dataType, F.lit(None)
    event = lambda t, o, e, bar, own: F.struct(t.alias("_t"), F.lit(o).alias("_o"), e.alias("e"), bar.alias("bar_us"), own.alias("own_segment"))
    as_quote = event(F.col("open_us"), 1, F.col("e"), none.cast("long"), none.cast("long"))
    as_decision = event(F.col("bar_us") + SECOND + c.latency_us, 0, none.cast(kind), F.col("bar_us"), F.col("segment").cast("long"))
    merged = rows.select(*SERIES, "shard", F.explode(F.when(F.col("core"), F.array(as_quote, as_decision)).otherwise(F.array(as_quote))).alias("v")).select(*SERIES, "shard", "v.*")
    nxt = F.last("e", ignorenulls=True).over(Window.partitionBy(*SERIES, "shard").orderBy(F.desc("_t"), F.desc("_o")).rowsBetween(Window.unboundedPreceding, 0))
    found = merged.withColumn("e", nxt).where("bar_us is not null")
    entered = (F.col("e.open_us") - F.col("_t") <= c.max_entry_delay_us) & (F.col("e.segment") == F.col("own_segment"))
    valid = F.coalesce(entered & (F.col("e.exit.segment") == F.col("e.segment")), F.lit(False))
    s = c.slippage_bps / 10_000
    bid, ask, xbid, xask = F.col("e.open_bid"), F.col("e.open_ask"), F.col("e.exit.open_bid"), F.col("e.exit.open_ask")
    long_in, short_in = ask * (1 + s), bid * (1 - s)
    mid, xmid = (bid + ask) / 2, (xbid + xask) / 2
    values = {
        "entry_delay_s": (F.col("e.open_us") - F.col("_t")) / SECOND, "exit_delay_s": (F.col("e.exit.open_us") - F.col("e.open_us") - h) / SECOND,
        "long_gross_bps": (xmid / mid - 1) * 10_000, "short_gross_bps": (mid / xmid - 1) * 10_000,
        "long_net_bps": (xbid * (1 - s) / long_in - 1) * 10_000, "short_net_bps": (short_in / (xask * (1 + s)) - 1) * 10_000,
        "long_mfe_bps": (F.col("e.bid_high") * (1 - s) / long_in - 1) * 10_000, "long_mae_bps": (F.col("e.bid_low") * (1 - s) / long_in - 1) * 10_000,
        "short_mfe_bps": (short_in / (F.col("e.ask_low") * (1 + s)) - 1) * 10_000, "short_mae_bps": (short_in / (F.col("e.ask_high") * (1 + s)) - 1) * 10_000,
    }
    return found.select(*SERIES, "bar_us", valid.alias("valid"), *[F.when(valid, v).alias(k) for k, v in values.items()])


def bar_outcomes(bars: DataFrame, width_us: int, steps: int, slippage_bps: float = 0.0) -> DataFrame:
    """Per bar: entry at the next bar's opening quote, exit at that of the bar `steps` later, on a path without holes."""
    w = Window.partitionBy(*SERIES).orderBy("bar_us")
    path = w.rowsBetween(1, steps)
    whole = (F.count(F.lit(1)).over(w.rowsBetween(0, steps + 1)) == steps + 2) & (F.max("bar_us").over(w.rowsBetween(0, steps + 1)) - F.col("bar_us") == (steps + 1) * width_us)
    entry, exit_ = (F.lead(F.struct("open_bid", "open_ask"), k).over(w) for k in (1, 1 + steps))
    s = slippage_bps / 10_000
    rows = bars.withColumn("e", entry).withColumn("x", exit_).withColumn("valid", whole).withColumn("hi", F.max("high").over(path)).withColumn("lo", F.min("low").over(path))
    # the first bar that reaches the extreme, found by its time
    rows = rows.withColumn("top", F.max(F.struct("high", (-F.col("bar_us")).alias("t"))).over(path))
    net_long = (F.col("x.open_bid") * (1 - s) / (F.col("e.open_ask") * (1 + s)) - 1) * 10_000
    net_short = (F.col("e.open_bid") * (1 - s) / (F.col("x.open_ask") * (1 + s)) - 1) * 10_000
    mfe = (F.col("hi") / ((F.col("e.open_bid") + F.col("e.open_ask")) / 2) - 1) * 10_000
    when = lambda v: F.when(F.col("valid"), v)
    return rows.select(*SERIES, "bar_us", "valid", when(net_long).alias("long_net_bps"), when(net_short).alias("short_net_bps"), when(mfe).alias("mfe_bps"), when(-F.col("top.t") - F.col("bar_us") - width_us).alias("to_mfe_us"))
