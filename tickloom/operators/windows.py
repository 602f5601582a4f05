"""Causal window features. Tick-level windows run per shard with a halo; bar-level ones are bounded by the time span of a series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tickloom.operators.bars import SERIES
from tickloom.operators.classify import session_of
from tickloom.operators.shards import DAY_US, core, running_max, running_sum, shard_of, with_halo
from tickloom.session import held

SECOND = 1_000_000


def by_bar() -> WindowSpec:
    return Window.partitionBy(*SERIES).orderBy("bar_us")



def _before(w: WindowSpec, seconds: int) -> WindowSpec:
    return w.rangeBetween(-seconds * SECOND, -1)


def second_features(bars: DataFrame, horizons: tuple[int, ...] = (1, 5, 30, 60), volatility_s: int = 60, carry_s: int = 5) -> DataFrame:
    """Per active second: returns against the last bar at or before each horizon, spread against its trailing median, tick rate against its
    trailing mean, volatility of one-step returns, age of the previous bar and whether a gap begins.

    History reaches back max(horizons, volatility_s) + 1 seconds; a horizon without a bar in it gives null. The spread ratio is 1 without
    history or at a zero median; the volatility is 0 without history. The age of the previous bar may reach further back than that.
    """
    reach = (max(*horizons, volatility_s) + 1) * SECOND
    w = Window.partitionBy(*SERIES, "shard").orderBy("bar_us")
    recent = _before(w, volatility_s)
    spread = (F.col("ask") - F.col("bid")) / F.col("mid") * 10_000
    rows = with_halo(bars.withColumn("spread_bps", spread), "bar_us", back_us=2 * reach)
    rows = rows.withColumn("_prev_mid", F.lag("mid").over(w)).withColumn("_prev_us", F.lag("bar_us").over(w)).withColumn("step", F.col("mid") / F.col("_prev_mid") - 1)
    median = F.expr("percentile(spread_bps, 0.5)").over(_before(w, 60))
    rate = F.avg("tick_count").over(recent)
    # the first bar of the window contributes as a base only: its own step reaches out of the window
    squares = F.sum(F.col("step") * F.col("step")).over(w.rangeBetween(-volatility_s * SECOND, 0))
    first_step = F.first(F.col("step") * F.col("step")).over(recent)
    steps = F.count(F.lit(1)).over(recent)
    out = rows.select(
        *SERIES, "bar_us", "mid", "tick_count", "quote_change_count", "spread_bps", "shard", "core", (F.col("mid") / F.col("open_mid") - 1).alias("intrasecond_return"),
        F.when(F.coalesce(median, F.col("spread_bps")) == 0, 1.0).otherwise(F.col("spread_bps") / F.nullif(F.coalesce(median, F.col("spread_bps")), F.lit(0.0))).alias("spread_shock_ratio"),
        F.coalesce(F.col("tick_count") / rate, F.lit(1.0)).alias("tick_intensity_ratio"),
        F.when(steps == 0, 0.0).otherwise(F.sqrt(F.greatest(squares - F.coalesce(first_step, F.lit(0.0)), F.lit(0.0)) / steps)).alias("realized_volatility"),
        ((F.col("bar_us") - F.col("_prev_us")) / SECOND).alias("_near_age"),
        *[(F.col("mid") / F.last("mid").over(w.rangeBetween(-reach, -h * SECOND)) - 1).alias(f"return_{h}s") for h in horizons],
    )
    out = core(out)
    # ages beyond the halo come from the neighbouring shards
    return previous_age(out, "bar_us").withColumn("is_gap_start", F.coalesce(F.col("age_s") > carry_s, F.lit(False))).drop("_near_age")


def previous_age(rows: DataFrame, t: str, keys: list[str] = SERIES) -> DataFrame:
    """rows with age_s: seconds since the previous row of the series, null for its first. Times must be unique per series."""
    own = shard_of(t)
    lasts = rows.groupBy(*keys, own.alias("_s")).agg(F.max(t).alias("_last"))
    lasts = lasts.select(*keys, "_s", F.last("_last").over(Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    inside = F.lag(t).over(Window.partitionBy(*keys, "_s").orderBy(t))
    joined = rows.withColumn("_s", own).withColumn("_in", inside).join(lasts, [*keys, "_s"], "left")
    return joined.withColumn("age_s", (F.col(t) - F.coalesce("_in", "_carry")) / SECOND).drop("_s", "_in", "_carry")


def prior_levels(rows: DataFrame, t: str, value: str, seconds: tuple[int, ...] = (60, 300, 900, 3600)) -> DataFrame:
    """rows with the highest and lowest value of the trailing windows, the row itself and its instant excluded."""
    w = Window.partitionBy(*SERIES, "shard").orderBy(t)
    levels = [f(value).over(_before(w, s)).alias(f"prior_{n}_{s}s") for s in seconds for n, f in (("high", F.max), ("low", F.min))]
    return core(with_halo(rows, t, back_us=max(seconds) * SECOND).select("*", *levels))


def breakout(mid: str, high: str, low: str, threshold_bps: float) -> Column:
    """1 above the prior high, -1 below the prior low, by the threshold; up wins; 0 if neither."""
    up, down = (F.col(mid) / F.col(high) - 1) * 10_000, (F.col(low) / F.col(mid) - 1) * 10_000
    return F.when(up >= threshold_bps, 1).when(down >= threshold_bps, -1).otherwise(0)


def segments(rows: DataFrame, t: str, gap_us: int, order: list[str] | None = None) -> DataFrame:
    """rows with segment: how many gaps longer than gap_us lie before the row in its series. Times must be unique per series."""
    aged = previous_age(rows, t)
    return running_sum(aged, SERIES, order or [t], F.when(F.col("age_s") * SECOND > gap_us, 1).otherwise(0), "segment", shard_of(t)).drop("age_s")


def episode_starts(rows: DataFrame, t: str, state: str, gap_us: int) -> DataFrame:
    """The rows at which a non-null, non-zero state begins: another state before, a gap, or the first row. Times must be unique per series."""
    w = Window.partitionBy(*SERIES, "shard").orderBy(t)
    # a row beyond gap_us before makes an episode start whatever its state is, so the halo is gap_us
    near = with_halo(rows, t, back_us=gap_us).withColumn("_p", F.lag(state).over(w)).withColumn("_pt", F.lag(t).over(w))
    fresh = F.col("_pt").isNull() | (F.col(t) - F.col("_pt") > gap_us) | ~F.col(state).eqNullSafe(F.col("_p"))
    return core(near.where(F.col(state).isNotNull() & (F.col(state) != 0) & fresh)).drop("_p", "_pt")


def reset_average(rows: DataFrame, t: str, value: str, weight: str, gap_us: int) -> DataFrame:
    """rows with vwap: the weighted mean since the last reset (another day, another session of the day, or a gap)."""
    aged = previous_age(rows, t)
    day, session = F.floor(F.col(t) / DAY_US).cast("long"), session_of(t)
    # every reset within a day and session is a gap; day and session are part of the key, so that sums never run past a day
    keyed = running_sum(aged.withColumn("_day", day).withColumn("session", session), [*SERIES, "_day", "session"], [t], F.when(F.col("age_s") * SECOND > gap_us, 1).otherwise(0), "_run", F.lit(0).cast("long"))
    w = Window.partitionBy(*SERIES, "_day", "session", "_run").orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    return keyed.withColumn("vwap", F.sum(F.col(value) * F.greatest(F.col(weight), F.lit(1))).over(w) / F.sum(F.greatest(F.col(weight), F.lit(1))).over(w)).drop("_day", "_run", "age_s")


def session_range(bars: DataFrame, start_hour: int, end_hour: int, high: str = "high", low: str = "low") -> DataFrame:
    """bars with range_high and range_low of the day's hours [start, end) UTC, visible from the end of the hours on."""
    hour = F.floor(F.pmod(F.col("bar_us"), F.lit(DAY_US)) / 3_600_000_000)
    day = F.floor(F.col("bar_us") / DAY_US).cast("long")
    inside = (hour >= start_hour) & (hour < end_hour)
    days = bars.where(inside).groupBy(*SERIES, day.alias("_day")).agg(F.max(high).alias("range_high"), F.min(low).alias("range_low"))
    seen = hour >= end_hour
    joined = bars.withColumn("_day", day).join(days, [*SERIES, "_day"], "left")
    return joined.withColumn("range_high", F.when(seen, F.col("range_high"))).withColumn("range_low", F.when(seen, F.col("range_low"))).drop("_day")


def bar_trend(bars: DataFrame, seconds: int) -> DataFrame:
    """bars with the return over the trailing window, its path efficiency, prior high and low, and the root mean square of its bar-to-bar returns
    (the one into the window's first bar left out; 0 without any)."""
    w = by_bar()
    back = w.rangeBetween(-seconds * SECOND, -SECOND)
    full = w.rangeBetween(-seconds * SECOND, 0)
    step = F.col("close") - F.lag("close").over(w)
    square = F.pow(F.col("close") / F.lag("close").over(w) - 1, 2)
    rows = bars.withColumn("_step", step).withColumn("_sq", F.coalesce(square, F.lit(0.0)))
    base = F.first("open").over(full)
    distance = F.sum(F.abs("_step")).over(full) - F.coalesce(F.abs(F.first("_step").over(full)), F.lit(0.0))
    return rows.select(
        *bars.columns, (F.col("close") / base - 1).alias("trend_return"), F.coalesce(F.try_divide(F.abs(F.col("close") - F.first("close").over(full)), distance), F.lit(0.0)).alias("efficiency"),
        F.max("high").over(back).alias("prior_high"), F.min("low").over(back).alias("prior_low"),
        F.when(F.count(F.lit(1)).over(full) > 1, F.sqrt(F.greatest(F.sum("_sq").over(full) - F.first("_sq").over(full), F.lit(0.0)) / (F.count(F.lit(1)).over(full) - 1))).otherwise(0.0).alias("volatility"),
    )


def ema(bars: DataFrame, period: int, name: str = "ema") -> DataFrame:
    """bars with the exponential mean of the last `period` closes, seeded with the oldest of them; null before there are as many."""
    alpha = 2.0 / (period + 1)
    closes = F.collect_list("close").over(by_bar().rowsBetween(1 - period, 0))
    mean = F.aggregate(F.slice("_c", 2, period), F.element_at("_c", 1), lambda acc, x: acc + alpha * (x - acc))
    return bars.withColumn("_c", closes).withColumn(name, F.when(F.size("_c") == period, mean)).drop("_c")


def atr(bars: DataFrame, period: int, name: str = "atr") -> DataFrame:
    """bars with the mean true range of the last `period` bars; null until there is one more bar than that."""
    prev = F.lag("close").over(by_bar())
    true_range = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))
    w = by_bar().rowsBetween(1 - period, 0)
    rows = bars.withColumn("_tr", F.when(prev.isNotNull(), true_range))
    return rows.withColumn(name, F.when(F.count("_tr").over(w) == period, F.avg("_tr").over(w))).drop("_tr")


def fair_value_gaps(bars: DataFrame) -> DataFrame:
    """Three-bar gaps: the low above the high two bars before (1) or the high below the low two bars before (-1), with their zone."""
    high2, low2 = F.lag("high", 2).over(by_bar()), F.lag("low", 2).over(by_bar())
    rows = bars.withColumn("_h", high2).withColumn("_l", low2).withColumn("side", F.when(F.col("low") > F.col("_h"), 1).when(F.col("high") < F.col("_l"), -1))
    up = F.col("side") > 0
    return rows.where("side is not null").select(*SERIES, "bar_us", "side", F.when(up, F.col("_h")).otherwise(F.col("high")).alias("zone_low"), F.when(up, F.col("low")).otherwise(F.col("_l")).alias("zone_high"))


def contiguous(width_us: int, back: int, ahead: int = 0) -> Column:
    """Whether `back` bars before and `ahead` bars after a bar exist without a hole."""
    w = by_bar().rowsBetween(-back, ahead)
    return (F.count(F.lit(1)).over(w) == back + ahead + 1) & (F.max("bar_us").over(w) - F.min("bar_us").over(w) == (back + ahead) * width_us)


def shocks(bars: DataFrame, lookback: int = 48, threshold: float = 3.0) -> DataFrame:
    """Bars whose absolute return exceeds median + threshold * 1.4826 * MAD of the `lookback` absolute returns before it."""
    moved = bars.withColumn("bar_return", F.col("close") / F.lag("close").over(by_bar()) - 1).withColumn("_a", F.abs("bar_return"))
    before = by_bar().rowsBetween(-lookback, -1)

    def middle(values: Column) -> Column:
        s, n = F.array_sort(values), F.size(values)
        return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2

    rows = moved.withColumn("_h", F.collect_list("_a").over(before)).where(F.size("_h") == lookback)
    # each median once per row, not once per element of the other
    rows = held(rows, _m=middle(F.col("_h")))
    rows = held(rows, _d=middle(F.transform("_h", lambda x: F.abs(x - F.col("_m")))))
    limit = F.col("_m") + threshold * 1.4826 * F.col("_d")
    return rows.where((F.col("_d") > 0) & (F.col("_a") > limit)).select(*SERIES, "bar_us", "bar_return", F.signum("bar_return").cast("int").alias("side"))


def failed_moves(bars: DataFrame, width_us: int, later: int = 3, share: float = 0.5, least: float = 0.0) -> DataFrame:
    """Bars whose move was taken back by at least `share` within `later` contiguous bars."""
    prev, after = F.lag("close").over(by_bar()), F.lead("close", later).over(by_bar())
    rows = bars.withColumn("_p", prev).withColumn("_a", after).withColumn("_ok", contiguous(width_us, 1, later))
    move = F.col("close") - F.col("_p")
    taken = (F.col("close") - F.col("_a")) / F.nullif(move, F.lit(0.0))
    return rows.where("_ok").withColumn("retraced", taken).where((F.col("retraced") >= share) & (F.abs(move) > least)).select(*SERIES, "bar_us", F.signum(move).cast("int").alias("side"), "retraced")


def sweeps(bars: DataFrame, lookback: int = 48) -> DataFrame:
    """Bars that pierce the high or low of the `lookback` bars before and close back inside."""
    before = by_bar().rowsBetween(-lookback, -1)
    rows = bars.withColumn("_h", F.max("high").over(before)).withColumn("_l", F.min("low").over(before)).withColumn("_n", F.count(F.lit(1)).over(before)).where(F.col("_n") == lookback)
    side = F.when((F.col("high") > F.col("_h")) & (F.col("close") < F.col("_h")), -1).when((F.col("low") < F.col("_l")) & (F.col("close") > F.col("_l")), 1)
    return rows.withColumn("side", side).where("side is not null").select(*SERIES, "bar_us", "side")


def gaps(rows: DataFrame, t: str, value: str, gap_us: int) -> DataFrame:
    """Intervals without rows longer than gap_us: their ends, and the jump of the value across them in basis points."""
    from tickloom.operators.shards import carried

    prev = carried(rows.select(*SERIES, t, value), SERIES, [t], F.struct(t, value), "_p", shard_of(t), strict=True)
    out = prev.where(F.col(t) - F.col(f"_p.{t}") > gap_us)
    return out.select(*SERIES, F.col(f"_p.{t}").alias("gap_start_us"), F.col(t).alias("gap_end_us"), ((F.col(value) / F.col(f"_p.{value}") - 1) * 10_000).alias("jump_bps"))


def drawdown(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """rows with equity, its running peak (never below zero) and the drawdown from it. order begins with a time in microseconds, by which hot keys are cut."""
    shard = shard_of(order[0])
    run = running_max(running_sum(rows, keys, order, F.col(value), "equity", shard), keys, order, F.col("equity"), "_top", shard)
    return run.withColumn("peak", F.greatest(F.lit(0.0), F.col("_top"))).withColumn("drawdown", F.col("peak") - F.col("equity")).drop("_top")


def spacing(rows: DataFrame, t: str) -> DataFrame:
    """The smallest positive distance in time between rows of each series."""
    aged = previous_age(rows.select(*SERIES, t).distinct(), t)
    return aged.where("age_s > 0").groupBy(*SERIES).agg(F.min("age_s").alias("spacing_s"))


def first_edges(rows: DataFrame, t: str, side: str) -> DataFrame:
    """The first row of each day at which side turns from zero (or nothing) to a non-zero value."""
    day = F.floor(F.col(t) / DAY_US).cast("long")
    w = Window.partitionBy(*SERIES, "day").orderBy(t)
    edges = rows.withColumn("day", day).withColumn("_p", F.coalesce(F.lag(side).over(w), F.lit(0))).where((F.col(side) != 0) & (F.col("_p") == 0))
    first = F.min(F.struct(t, side)).alias("m")
    return edges.groupBy(*SERIES, "day").agg(first).select(*SERIES, "day", F.col(f"m.{t}").alias(t), F.col(f"m.{side}").alias(side))
