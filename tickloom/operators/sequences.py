"""Episodes as sequences: entry policies on the bars after an episode's start, and exits along the path from there."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.asof import asof, between
from tickloom.operators.bars import SERIES
from tickloom.operators.folds import cooldown
from tickloom.operators.windows import segments
from tickloom.session import written

SECOND = 1_000_000


@dataclass(frozen=True)
class SequenceConfig:
    hold_delays_s: tuple[int, ...] = (5, 15)
    retest_s: int = 30
    sweep_s: int = 15
    confirm_bps: float = 0.25
    retest_bps: float = 0.5
    activity: float = 1.5
    quote_efficiency: float = 0.5
    spread_shock: float = 1.5
    spread_bps: float = 8.0
    gap_us: int = 5 * SECOND
    latency_us: int = 50_000
    entry_delay_us: int = 2 * SECOND
    horizons_s: tuple[int, ...] = (60, 300, 900)
    trail_from_bps: float = 3.0
    trail_bps: float = 1.5
    slippage_bps: float = 0.5
    spacing_us: int = 960 * SECOND


def executable(bars: DataFrame, config: SequenceConfig) -> DataFrame:
    """Second bars with x: the opening quote (us, bid, ask, bar) of the first later bar from a second and the latency after the bar's start, within the entry delay and without a gap between; else null."""
    seg = segments(bars.select(*SERIES, "bar_us", "open_us", "open_bid", "open_ask"), "bar_us", config.gap_us)
    seg = written(seg)
    left = bars.join(seg.select(*SERIES, "bar_us", F.col("segment").alias("own_segment")), [*SERIES, "bar_us"]).withColumn("due", F.col("bar_us") + SECOND + config.latency_us)
    right = seg.select(*SERIES, F.col("open_us").alias("q_us"), F.col("open_bid").alias("bid"), F.col("open_ask").alias("ask"), F.col("bar_us").alias("bar"), F.col("segment").alias("seg"))
    got = asof(left, right, SERIES, "due", "q_us", ["bid", "ask", "bar", "seg"], "forward", tolerance_us=config.entry_delay_us, prefix="x_")
    quote = F.struct(F.col("x_t").alias("us"), F.col("x_bid").alias("bid"), F.col("x_ask").alias("ask"), F.col("x_bar").alias("bar"))
    return got.withColumn("x", F.when(F.col("x_seg") == F.col("own_segment"), quote)).drop("due", "own_segment", "x_t", "x_bid", "x_ask", "x_bar", "x_seg")


def episodes(starts: DataFrame, config: SequenceConfig) -> DataFrame:
    """Starts (SERIES, bar_us, side, spread_bps and any others) with an acceptable spread, spaced from the last one taken."""
    return cooldown(starts.where(F.col("spread_bps") <= config.spread_bps), SERIES, "bar_us", ["bar_us"], config.spacing_us)


def entries(starts: DataFrame, bars: DataFrame, config: SequenceConfig = SequenceConfig()) -> DataFrame:
    """(SERIES, start_us, level, policy, direction, signal_us, x): the bar at which each policy decides on an episode, with its executable quote (null if there is none).

    starts: SERIES, bar_us, side, level, tick_intensity_ratio, quote_change_count, tick_count, spread_shock_ratio, return_5s, return_30s, compression; bars: SERIES, bar_us, mid, spread_bps, x.
    hold_*: the first bar after the delay, if its mid is still beyond the level by confirm_bps; with compression, quote pressure or both returns asked of the start as well. retest_resume: after the mid
    touched the level, the first bar (also that one) back beyond it. sweep_fade: the first bar back inside the level, against the side. Bars behind a gap count no more, and a window that no bar ends decides nothing. Null values fail their rule.
    """
    c = config
    reach = (max(*c.hold_delays_s, c.retest_s, c.sweep_s) * SECOND) + c.gap_us
    spans = starts.select(*SERIES, F.col("bar_us").alias("start_us"), (F.col("bar_us") + reach).alias("until_us"), "side", "level", *[F.col(n).alias(f"s_{n}") for n in ("tick_intensity_ratio", "quote_change_count", "tick_count", "spread_shock_ratio", "return_5s", "return_30s", "compression")])
    path = between(bars.select(*SERIES, "bar_us", "mid", "spread_bps", "x"), spans, SERIES, "bar_us", "start_us", "until_us", 600 * SECOND)
    every = Window.partitionBy(*SERIES, "start_us")
    w = every.orderBy("bar_us")
    rows = path.withColumn("_gap", F.coalesce(F.col("bar_us") - F.lag("bar_us").over(w) > c.gap_us, F.lit(False)).cast("int")).withColumn("_cut", F.max("_gap").over(w)).where("_cut = 0 and bar_us > start_us")

    def at(delay: int) -> Column:
        """The first bar from start + delay on, if it comes within the gap."""
        due = F.col("start_us") + delay * SECOND
        first = F.min(F.when(F.col("bar_us") >= due, F.col("bar_us"))).over(every)
        return F.when(first - due <= c.gap_us, first)

    side, away = F.col("side"), (F.col("mid") / F.col("level") - 1) * 10_000
    tight = F.col("spread_bps") <= c.spread_bps
    beyond = away * side >= c.confirm_bps
    rows = rows.withColumns({f"_at{d}": at(d) for d in {*c.hold_delays_s, c.retest_s, c.sweep_s}})
    rows = rows.withColumn("_touch", F.min(F.when(F.abs(away) <= c.retest_bps, F.col("bar_us"))).over(every))
    inside = F.when(side > 0, F.col("mid") <= F.col("level") * (1 - c.retest_bps / 10_000)).otherwise(F.col("mid") >= F.col("level") * (1 + c.retest_bps / 10_000))
    active, pressure, calm = F.col("s_tick_intensity_ratio") >= c.activity, F.coalesce(F.col("s_return_5s"), F.lit(0.0)) * side * 10_000, F.col("s_spread_shock_ratio") <= c.spread_shock
    asked = {
        **{f"hold_{d}s": (d, F.lit(True)) for d in c.hold_delays_s},
        "compression_activity_hold": (c.hold_delays_s[0], (F.col("s_compression") <= 0.5) & active),
        "quote_pressure_hold": (c.hold_delays_s[0], active & (F.col("s_quote_change_count") / F.greatest(F.col("s_tick_count"), F.lit(1)) >= c.quote_efficiency) & (pressure >= c.confirm_bps) & calm),
        "trend_alignment_hold": (c.hold_delays_s[0], (pressure >= c.confirm_bps) & (F.coalesce(F.col("s_return_30s"), F.lit(0.0)) * side * 10_000 >= c.confirm_bps) & calm),
    }
    hits = [(name, (F.col("bar_us") == F.col(f"_at{d}")) & ok & tight & beyond, side) for name, (d, ok) in asked.items()]
    hits.append(("retest_resume", (F.col("bar_us") <= F.col(f"_at{c.retest_s}")) & (F.col("bar_us") >= F.col("_touch")) & beyond & tight, side))
    hits.append(("sweep_fade", (F.col("bar_us") <= F.col(f"_at{c.sweep_s}")) & inside & tight, -side))
    found = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(n).alias("policy"), direction.cast("int").alias("direction"))) for n, test, direction in hits]))
    signals = rows.select(*SERIES, "start_us", "level", "bar_us", "x", F.explode(found).alias("hit")).select(*SERIES, "start_us", "level", "bar_us", "x", "hit.policy", "hit.direction")
    first = signals.groupBy(*SERIES, "start_us", "level", "policy", "direction").agg(F.min(F.struct("bar_us", "x")).alias("m"))
    return first.select(*SERIES, "start_us", "level", "policy", "direction", F.col("m.bar_us").alias("signal_us"), F.col("m.x").alias("x"))


def ends(entered: DataFrame, bars: DataFrame, config: SequenceConfig = SequenceConfig()) -> DataFrame:
    """(SERIES, start_us, policy, direction, horizon_s, style, e, q): the closing quote q of each entry e at each horizon and by each style; see exits(). entered: SERIES, start_us, level, policy, direction, x."""
    c = config
    reach = max(c.horizons_s) * SECOND + c.gap_us + SECOND
    held = entered.where("x is not null").select(*SERIES, "start_us", "level", "policy", "direction", F.col("x").alias("e"), F.col("x.bar").alias("e_bar"), (F.col("x.bar") + reach).alias("until_us"))
    path = between(bars.select(*SERIES, "bar_us", "open_us", "open_bid", "open_ask", "mid", "x"), held, SERIES, "bar_us", "e_bar", "until_us", 600 * SECOND)
    keys = [*SERIES, "start_us", "policy", "direction"]
    w = Window.partitionBy(*keys).orderBy("bar_us")
    rows = path.withColumn("_gap", F.coalesce(F.col("bar_us") - F.lag("bar_us").over(w) > c.gap_us, F.lit(False)).cast("int")).withColumn("_cut", F.max("_gap").over(w)).where("_cut = 0 and bar_us > e_bar")
    long, mid = F.col("direction") > 0, (F.col("e.bid") + F.col("e.ask")) / 2
    rows = rows.withColumn("gross", (F.when(long, F.col("mid") / mid).otherwise(mid / F.col("mid")) - 1) * 10_000).withColumn("best", F.max("gross").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    crossed = F.when(long, F.col("mid") < F.col("level")).otherwise(F.col("mid") > F.col("level"))
    trailed = (F.col("best") >= c.trail_from_bps) & (F.col("gross") <= F.col("best") - c.trail_bps)
    quote = F.struct(F.col("open_us").alias("us"), F.col("open_bid").alias("bid"), F.col("open_ask").alias("ask"), F.col("bar_us").alias("bar"))
    rows = rows.withColumn("horizon_s", F.explode(F.array(*[F.lit(h) for h in c.horizons_s]))).withColumn("due", F.col("e.us") + F.col("horizon_s") * SECOND)
    rows = rows.withColumn("final", F.min(F.when(F.col("open_us") >= F.col("due"), quote)).over(Window.partitionBy(*keys, "horizon_s")))
    good = rows.where((F.col("final.us") - F.col("due") <= c.gap_us) & (F.col("bar_us") <= F.col("final.bar")))
    usable = F.col("x").isNotNull() & (F.col("x.bar") <= F.col("final.bar"))
    early = lambda test: F.min(F.when(test & usable, F.struct("bar_us", "x")))["x"]
    found = good.groupBy(*keys, "horizon_s").agg(F.first("e").alias("e"), F.first("final").alias("final"), early(crossed).alias("structural"), early(trailed).alias("trailing"))
    styles = F.explode(F.array(*[F.struct(F.lit(n).alias("style"), q.alias("q")) for n, q in (("time", F.col("final")), ("structural_or_time", F.coalesce("structural", "final")), ("trailing_or_time", F.coalesce("trailing", "final")))])).alias("s")
    return found.select(*keys, "horizon_s", "e", styles).select(*keys, "horizon_s", "e", "s.style", "s.q")


def exits(entered: DataFrame, bars: DataFrame, config: SequenceConfig = SequenceConfig()) -> DataFrame:
    """(SERIES, start_us, policy, direction, horizon_s, style, entered_us, exited_us, gross_bps, net_bps, holding_s) of entries whose horizon ends on their path.

    entered: entries() with an executable quote x; bars: SERIES, bar_us, open_us, open_bid, open_ask, mid, x. The end is the first later bar that opens a horizon after the entry, without a gap between. style time
    ends there; structural_or_time at the first bar back across the level, trailing_or_time at the first one trail_bps below its best since trail_from_bps were reached, if an executable quote follows no later than the end.
    """
    keys = [*SERIES, "start_us", "policy", "direction"]
    s, long = config.slippage_bps / 10_000, F.col("direction") > 0
    net = (F.when(long, F.col("q.bid") * (1 - s) / (F.col("e.ask") * (1 + s))).otherwise(F.col("e.bid") * (1 - s) / (F.col("q.ask") * (1 + s))) - 1) * 10_000
    return ends(entered, bars, config).select(*keys, "horizon_s", "style", F.col("e.us").alias("entered_us"), F.col("q.us").alias("exited_us"), _gross().alias("gross_bps"), net.alias("net_bps"), ((F.col("q.us") - F.col("e.us")) / SECOND).alias("holding_s"))


def _gross() -> Column:
    mid, xmid = (F.col("e.bid") + F.col("e.ask")) / 2, (F.col("q.bid") + F.col("q.ask")) / 2
    return (F.when(F.col("direction") > 0, xmid / mid).otherwise(mid / xmid) - 1) * 10_000


def pressure_events(starts: DataFrame, bars: DataFrame, config: SequenceConfig, delay_s: int = 5, wait_s: int = 5, least_bps: float = 0.25, spacing_us: int = 3660 * SECOND) -> DataFrame:
    """(SERIES, start_us, side, signal_us, pressure, activity, spread, horizon_s, style, filled, gross_bps, net_bps) of episodes with pressure behind them, at market and by a passive limit.

    starts: SERIES, bar_us, side; bars: SERIES, bar_us, open_us, open_bid, open_ask, mid, spread_bps, return_5s, tick_intensity_ratio, x. The signal is the first bar delay_s after the start; its 5-s return in the
    side's direction must reach least_bps, and such events are spaced_us apart. market enters at the signal's executable quote; passive_limit at the signal's own bid (ask for shorts) at the first bar within
    wait_s whose other side trades through it, without slippage. Without a fill or an end on the path filled is false and the results are 0.
    """
    c = config
    spans = starts.select(*SERIES, F.col("bar_us").alias("start_us"), (F.col("bar_us") + (delay_s + wait_s) * SECOND + 2 * c.gap_us).alias("until_us"), "side")
    path = between(bars.select(*SERIES, "bar_us", "open_us", "open_bid", "open_ask", "spread_bps", "return_5s", "tick_intensity_ratio", "x"), spans, SERIES, "bar_us", "start_us", "until_us", 600 * SECOND)
    every = Window.partitionBy(*SERIES, "start_us")
    w = every.orderBy("bar_us")
    rows = path.withColumn("_gap", F.coalesce(F.col("bar_us") - F.lag("bar_us").over(w) > c.gap_us, F.lit(False)).cast("int")).withColumn("_cut", F.max("_gap").over(w)).where("_cut = 0 and bar_us > start_us")
    due = F.col("start_us") + delay_s * SECOND
    rows = rows.withColumn("signal", F.min(F.when(F.col("bar_us") >= due, F.struct("bar_us", "open_us", "open_bid", "open_ask", "spread_bps", "return_5s", "tick_intensity_ratio", "x"))).over(every)).where(F.col("signal.bar_us") - due <= c.gap_us)
    after = F.col("signal.open_us") + wait_s * SECOND
    rows = rows.withColumn("_end", F.min(F.when((F.col("bar_us") > F.col("signal.bar_us")) & (F.col("open_us") >= after), F.struct("open_us", "bar_us"))).over(every))
    waiting = (F.col("bar_us") > F.col("signal.bar_us")) & (F.col("_end.open_us") - after <= c.gap_us) & (F.col("bar_us") <= F.col("_end.bar_us"))
    through = F.when(F.col("side") > 0, F.col("open_ask") < F.col("signal.open_bid")).otherwise(F.col("open_bid") > F.col("signal.open_ask"))
    quote = F.struct(F.col("open_us").alias("us"), F.col("open_bid").alias("bid"), F.col("open_ask").alias("ask"), F.col("bar_us").alias("bar"))
    one = rows.groupBy(*SERIES, "start_us", "side").agg(F.first("signal").alias("signal"), F.min(F.when(waiting & through, quote)).alias("passive"))
    pressure = F.coalesce(F.col("signal.return_5s"), F.lit(0.0)) * F.col("side") * 10_000
    ready = one.withColumn("pressure", pressure).where(F.col("pressure") >= least_bps)
    events = written(cooldown(ready, SERIES, "start_us", ["start_us"], spacing_us))
    ways = F.explode(F.array(F.struct(F.lit("market").alias("style"), F.col("signal.x").alias("x")), F.struct(F.lit("passive_limit").alias("style"), F.col("passive").alias("x")))).alias("way")
    tried = events.select(*SERIES, "start_us", "side", "signal", "pressure", ways).select(*SERIES, "start_us", "side", "signal", "pressure", "way.style", "way.x")
    closed = ends(tried.select(*SERIES, "start_us", F.lit(0.0).alias("level"), F.col("style").alias("policy"), F.col("side").alias("direction"), "x"), bars, c).where("style = 'time'").select(*SERIES, "start_us", F.col("policy").alias("style"), "direction", "horizon_s", "e", "q")
    every_h = tried.withColumn("horizon_s", F.explode(F.array(*[F.lit(h) for h in c.horizons_s]))).join(closed, [*SERIES, "start_us", "style", "horizon_s"], "left")
    s, long, passive = c.slippage_bps / 10_000, F.col("side") > 0, F.col("style") == "passive_limit"
    paid = F.when(long, F.when(passive, F.col("signal.open_bid")).otherwise(F.col("e.ask") * (1 + s))).otherwise(F.when(passive, F.col("signal.open_ask")).otherwise(F.col("e.bid") * (1 - s)))
    net = (F.when(long, F.col("q.bid") * (1 - s) / paid).otherwise(paid / (F.col("q.ask") * (1 + s))) - 1) * 10_000
    filled = F.col("q").isNotNull()
    zero = lambda v: F.when(filled, v).otherwise(0.0)
    return every_h.select(*SERIES, "start_us", "side", F.col("signal.bar_us").alias("signal_us"), "pressure", F.col("signal.tick_intensity_ratio").alias("activity"), F.col("signal.spread_bps").alias("spread"), "horizon_s", "style", filled.alias("filled"), zero(_gross()).alias("gross_bps"), zero(net).alias("net_bps"))


def matching(events: DataFrame, pressures: tuple[float, ...], activities: tuple[float, ...], spreads: tuple[float, ...]) -> DataFrame:
    """Filled events once for each combination of thresholds they pass (candidate): pressure and activity at least, spread at most. The grid is fixed and small, so each event is spread where it lies."""
    grid = F.array(*[F.struct(F.lit(f"p{p:g}_a{a:g}_s{s:g}").alias("candidate"), F.lit(float(p)).alias("p"), F.lit(float(a)).alias("a"), F.lit(float(s)).alias("s")) for p in pressures for a in activities for s in spreads])
    passed = F.filter(grid, lambda g: (F.col("pressure") >= g["p"]) & (F.col("activity") >= g["a"]) & (F.col("spread") <= g["s"]))
    return events.where("filled").withColumn("_g", F.explode(passed)).withColumn("candidate", F.concat_ws("_", "style", F.concat(F.lit("h"), F.col("horizon_s").cast("string")), "_g.candidate")).drop("_g")


def policy_report(trades: DataFrame, counts: DataFrame, eligible: DataFrame, keys: list[str], family: int = 63) -> DataFrame:
    """The measures of policies and exits: trades, abstention and rejection rates, folds and months with gains, means at three costs, the fold means' family-adjusted low, win rate, factor, holding.

    trades: keys (policy first), fold, entered_us, gross_bps, net_bps, holding_s; counts: policy, triggers, signals; eligible: one row with eligible. Folds and months are aggregated first, so no group is a buffer.
    """
    from tickloom.operators.research import family_low

    month = F.date_format(F.timestamp_micros("entered_us"), "yyyy-MM")
    by_fold = trades.groupBy(*keys, "fold").agg(F.avg("net_bps").alias("m")).groupBy(*keys).agg(F.count(F.lit(1)).alias("folds"), F.count(F.when(F.col("m") > 0, 1)).alias("good_folds"), *family_low("m", family)).drop("low_log")
    by_month = trades.groupBy(*keys, month.alias("mo")).agg(F.sum("net_bps").alias("m")).groupBy(*keys).agg(F.count(F.lit(1)).alias("months"), F.count(F.when(F.col("m") > 0, 1)).alias("good_months"), (F.greatest(F.max("m"), F.lit(0.0)) / F.nullif(F.sum(F.when(F.col("m") > 0, F.col("m")).otherwise(0.0)), F.lit(0.0))).alias("best_month_share"))
    g, n, cost = F.col("gross_bps"), F.col("net_bps"), F.col("gross_bps") - F.col("net_bps")
    own = trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trades"), F.avg(g).alias("mean_gross"), F.avg(cost).alias("mean_cost"), F.avg(n).alias("mean_net"), F.avg(g - 1.5 * cost).alias("mean_net_1_5x"), F.avg(g - 2 * cost).alias("mean_net_2x"), F.avg((n > 0).cast("double")).alias("win_rate"),
        (F.sum(F.when(n > 0, n).otherwise(0.0)) / F.nullif(F.sum(F.when(n < 0, -n).otherwise(0.0)), F.lit(0.0))).alias("profit_factor"), F.avg("holding_s").alias("mean_holding_s"),
    )
    all_ = F.nullif(eligible.scalar(), F.lit(0)).cast("double")
    rates = [(1 - F.coalesce(F.col("signals") / all_, F.lit(0.0))).alias("abstention"), (1 - F.coalesce(F.col("triggers") / all_, F.lit(0.0))).alias("policy_abstention"), F.coalesce(1 - F.col("signals") / F.nullif(F.col("triggers"), F.lit(0)), F.lit(0.0)).alias("rejection")]
    return own.join(by_fold, keys).join(by_month, keys).join(counts, keys[0]).select(*own.columns, "folds", "good_folds", "low_normal", "months", "good_months", "best_month_share", "triggers", "signals", *rates)
