"""Row-level rules, result reports and selections of the research queries."""

from __future__ import annotations

from math import log, sqrt
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.asof import asof, between
from tickloom.operators.bars import SERIES
from tickloom.operators.quantiles import quantiles_of
from tickloom.operators.shards import DAY_US, carried, running_max, running_sum, shard_of
from tickloom.session import written

SECOND = 1_000_000
HOUR_US = 3_600 * SECOND


# --- rules on a row


def market_open(t: str) -> Column:
    """Whether the weekly schedule is open at an instant: from Sunday 22:00 to Friday 22:00 UTC."""
    week = F.pmod(F.col(t) + 3 * DAY_US, F.lit(7 * DAY_US))  # microseconds since Monday 00:00
    return (week < 4 * DAY_US + 22 * HOUR_US) | (week >= 6 * DAY_US + 22 * HOUR_US)


def point_features(prices: str) -> list[Column]:
    """total_return, volatility (root mean square of the steps) and momentum (their sum) of an array of prices; null for fewer than two."""
    p = F.col(prices)
    steps = F.transform(F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))), lambda x, i: x / F.get(p, i) - 1)
    n, total = F.size(p) - 1, lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)
    enough = F.size(p) >= 2
    return [F.when(enough, F.element_at(p, -1) / F.get(p, F.lit(0)) - 1).alias("total_return"), F.when(enough, F.sqrt(total(F.transform(steps, lambda x: x * x)) / n)).alias("volatility"), F.when(enough, total(steps)).alias("momentum")]


def regime(volatility: str, momentum: str) -> Column:
    """struct(regime, confidence): high_volatility, else directional, else range."""
    v, m = F.col(volatility), F.abs(F.col(momentum))
    named = lambda n, c: F.struct(F.lit(n).alias("regime"), c.alias("confidence"))
    return F.when(v > 0.002, named("high_volatility", F.least(F.lit(0.99), 0.6 + v * 20))).when(m > 0.001, named("directional", F.least(F.lit(0.95), 0.6 + m * 30))).otherwise(named("range", F.lit(0.7)))


def path_label(net: str, mfe: str, mae: str, spread: str) -> Column:
    """What a path was: a continuation, one that came back far enough for a retest, a failed sweep, or indeterminate. The later rules win over the first."""
    n, up, down = F.col(net), F.col(mfe), F.col(mae)
    retest = (n > 0) & (down < -F.greatest(F.col(spread), F.lit(1.0)))
    return F.when(retest, "retest_compatible_continuation").when((n <= 0) & (up > 0), "sweep_failure").when((n > 0) & (up > F.abs(down)), "continuation").otherwise("indeterminate")


def signed(side: str, **columns: str) -> list[Column]:
    """Columns times the side, so that positive means in its direction."""
    return [(F.col(c) * F.col(side)).alias(name) for name, c in columns.items()]


# the regime gates; a null value fails its gate
GATES = ("all", "asia_only", "london_only", "new_york_only", "tight_spread", "high_activity", "low_volatility", "high_volatility", "narrow_range", "wide_range", "trend_aligned_30s", "trend_aligned_60s", "weekday_tue_thu")


def gates(t: str, window: str, spread: str, activity: str, volatility: str, width: str, r30: str, r60: str, limit: dict[str, Column]) -> Column:
    """The gates that a row passes, as an array. limit holds the thresholds of spread, activity, volatility and width."""
    weekday = F.floor(F.pmod(F.col(t) + 3 * DAY_US, F.lit(7 * DAY_US)) / DAY_US)
    tests = (
        F.lit(True), F.col(window) == "asia", F.col(window) == "london_open", F.col(window) == "new_york_open", F.col(spread) <= limit["spread"], F.col(activity) >= limit["activity"], F.col(volatility) <= limit["volatility"], F.col(volatility) > limit["volatility"],
        F.col(width) <= limit["width"], F.col(width) > limit["width"], F.col(r30) > 0, F.col(r60) > 0, weekday.between(1, 3),
    )
    return F.array_compact(F.array(*[F.when(test, name) for name, test in zip(GATES, tests)]))


def confirmations(persistence: str, spread: str, activity: str, distance: str, r30: str, vwap: str, compression: str) -> Column:
    """The confirmation rules that a row passes, as an array: persistence, then market quality and alignment on top of it, then both with compression."""
    held = F.col(persistence) >= 0.25
    quality = held & (F.col(spread) <= 3.0) & (F.col(activity) >= 1.0) & (F.col(distance) >= 0.25)
    aligned = held & (F.col(r30) > 0) & (F.col(vwap) > 0)
    return F.array_compact(F.array(F.when(held, "persistence"), F.when(quality, "market_quality"), F.when(aligned, "alignment"), F.when(quality & aligned & (F.col(compression) <= 1.0), "full_confirmation")))


def families(trend: str, far_return: str, efficiency: str, rejection: str, displacement: str, expansion: str, zone_side: str, zone_mitigated: str) -> Column:
    """The strategy families that a row of states is a candidate for, as an array of struct(family, side, strength)."""
    t = F.coalesce(F.col(trend), F.lit(0))
    aligned = (t != 0) & (F.col(far_return) * t > 0) & (F.col(efficiency) >= 0.35)
    one = lambda test, name, side, strength: F.when(test, F.struct(F.lit(name).alias("family"), side.cast("int").alias("side"), strength.cast("double").alias("strength")))
    return F.array_compact(F.array(
        one(aligned, "trend_continuation", t, F.abs(F.col(far_return))), one(F.coalesce(F.col(rejection), F.lit(0)) != 0, "boundary_rejection", F.col(rejection), F.lit(1.0)),
        one(aligned & (F.col(displacement) >= 1.5), "displacement_persistence", t, F.col(displacement)), one(aligned & (F.col(expansion) >= 1.5), "volatility_expansion", t, F.col(expansion)),
        one(F.col(zone_mitigated) & (F.coalesce(F.col(zone_side), F.lit(0)) != 0), "fvg_retracement", F.col(zone_side), F.lit(1.0)),
    ))


def rejection(high: str, low: str, close: str, prior_high: str, prior_low: str) -> Column:
    """-1 where a bar pierces the prior high and closes below it, else 1 where it pierces the prior low and closes above it, else 0."""
    return F.when((F.col(high) > F.col(prior_high)) & (F.col(close) < F.col(prior_high)), -1).when((F.col(low) < F.col(prior_low)) & (F.col(close) > F.col(prior_low)), 1).otherwise(0)


def gap_class(discontinuity: Column, inherited: Column, longest_s: Column, short_s: int = 60) -> Column:
    """Why a path isn't whole: a hole in the bars, nothing known against it, or silences short or long."""
    return F.when(discontinuity, "bar_discontinuity").when(~inherited, "invalid_without_evidence").when(longest_s <= short_s, "short_interruption_only").otherwise("long_interruption_or_closure")


def pair_effects(side: str, entry: tuple[str, str], exit_: tuple[str, str]) -> list[Column]:
    """Of a provider's and a copier's trade: the paths of each entry with each exit in basis points, and what the copier's entry and exit changed. Null without the exits."""
    s = F.col(side)
    back = lambda e, x: s * (F.col(x) - F.col(e)) / F.col(e) * 10_000
    own, mixed, copied = back(entry[0], exit_[0]), back(entry[1], exit_[0]), back(entry[1], exit_[1])
    return [own.alias("provider_bps"), mixed.alias("copied_entry_bps"), back(entry[0], exit_[1]).alias("copied_exit_bps"), copied.alias("copied_bps"), (s * (F.col(entry[1]) - F.col(entry[0])) / F.col(entry[0]) * 10_000).alias("adverse_entry_bps"), (mixed - own).alias("entry_effect_bps"), (copied - mixed).alias("exit_effect_bps")]


def crosses_hour(start: str, end: str, hour: Column) -> Column:
    """Whether the next time it is that hour (UTC) after start comes no later than end."""
    first = F.floor(F.col(start) / DAY_US) * DAY_US + hour * HOUR_US
    return F.when(first <= F.col(start), first + DAY_US).otherwise(first) <= F.col(end)


# --- reports on results


def interval(value: str, z: float = 1.96) -> list[Column]:
    """mean, low and high of the mean's normal interval; a single value has no width."""
    v = F.col(value)
    half = z * F.coalesce(F.stddev_samp(v), F.lit(0.0)) / F.sqrt(F.count(v))
    return [F.avg(v).alias("mean"), (F.avg(v) - half).alias("low"), (F.avg(v) + half).alias("high")]


def family_low(value: str, family: int, alpha: float = 0.05) -> list[Column]:
    """Lower bounds of a mean among `family` hypotheses: by the normal quantile of alpha over the family, and by the bound sqrt(2 log family). Null below two values."""
    v, error = F.col(value), F.stddev_samp(value) / F.sqrt(F.count(value))
    z = NormalDist().inv_cdf(1 - alpha / max(family, 1))
    bound = lambda k: F.when(F.count(v) >= 2, F.avg(v) - k * error)
    return [bound(z).alias("low_normal"), bound(sqrt(2 * log(family))).alias("low_log")]


def cost_levels(gross: str, cost: str) -> list[Column]:
    """Means, totals and profit factors of results at once, one and a half and twice their cost."""
    out = []
    for name, k in (("base", 1.0), ("cost_1_5x", 1.5), ("cost_2x", 2.0)):
        v = F.col(gross) - k * F.col(cost)
        out += [F.avg(v).alias(f"mean_{name}"), (F.sum(F.when(v > 0, v).otherwise(0.0)) / F.nullif(F.sum(F.when(v < 0, -v).otherwise(0.0)), F.lit(0.0))).alias(f"factor_{name}")]
    return out


def shares(daily: DataFrame, keys: list[str], day_us: str, value: str) -> DataFrame:
    """(keys, best_day_share, top5_share, best_month_share, without_best_day, without_top5, without_best_month): how much of the positive total hangs on the best days and the best month. daily: one row per key and day."""
    month = F.date_format(F.timestamp_micros(F.col(day_us)), "yyyy-MM")
    ranked = daily.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(value), day_us)))
    up, first = F.col(value) > 0, lambda n: F.sum(F.when((F.col("_k") <= n) & (F.col(value) > 0), F.col(value)).otherwise(0.0))
    days = ranked.groupBy(*keys).agg(F.sum(value).alias("_all"), F.sum(F.when(up, F.col(value)).otherwise(0.0)).alias("_up"), first(1).alias("_one"), first(5).alias("_five"))
    months = daily.groupBy(*keys, month.alias("_m")).agg(F.sum(value).alias("_v")).groupBy(*keys).agg(F.max("_v").alias("_best"), F.sum(F.when(F.col("_v") > 0, F.col("_v")).otherwise(0.0)).alias("_mup"))
    part = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0.0))
    return days.join(months, keys).select(*keys, part("_one", "_up").alias("best_day_share"), part("_five", "_up").alias("top5_share"), part("_best", "_mup").alias("best_month_share"), (F.col("_all") - F.col("_one")).alias("without_best_day"), (F.col("_all") - F.col("_five")).alias("without_top5"), (F.col("_all") - F.col("_best")).alias("without_best_month"))


def effective_size(correlations: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, effective): n / (1 + 2 * the sum of the autocorrelations), within 1 and n."""
    total = correlations.groupBy(*keys).agg(F.sum("r").alias("_r"))
    n = F.col("n").cast("double")
    raw = n / F.nullif(1 + 2 * F.coalesce(F.col("_r"), F.lit(0.0)), F.lit(0.0))
    return sizes.join(total, keys, "left").select(*keys, "n", F.least(n, F.greatest(F.lit(1.0), F.coalesce(raw, n))).alias("effective"))


def select_best(candidates: DataFrame, keys: list[str], name: str, value: str, count: str, least: int) -> DataFrame:
    """(keys, name, value, count) of the candidate with the greatest value among those with `least` results; the first by name wins ties. Keys without one have no row."""
    good = candidates.where((F.col(count) >= least) & F.col(value).isNotNull())
    best = F.max(F.struct(F.col(value).alias("v"))).alias("_b")
    top = good.groupBy(*keys).agg(best)
    at = good.join(top, keys).where(F.col(value) == F.col("_b.v"))
    return at.groupBy(*keys).agg(F.min(F.struct(name, value, count)).alias("_m")).select(*keys, f"_m.{name}", f"_m.{value}", f"_m.{count}")


def balance_drawdown(results: DataFrame, cash: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, drawdown, drawdown_pct, balance): the greatest fall of the closed balance from its peak and as a share of the peak, where cash moves peak and balance alike.

    results: keys, us, ticket, net; cash: keys, us, ticket, amount. Cash at an instant comes before results. Running values are completed over time shards.
    """
    rows = results.select(*keys, "us", F.lit(1).alias("o"), "ticket", F.col("net").alias("net"), F.lit(0.0).alias("paid")).unionByName(cash.select(*keys, "us", F.lit(0).alias("o"), "ticket", F.lit(0.0).alias("net"), F.col("amount").cast("double").alias("paid")))
    order, shard = ["us", "o", "ticket", "net"], shard_of("us")
    run = running_sum(running_sum(rows, keys, order, F.col("net"), "won", shard), keys, order, F.col("paid"), "put_in", shard)
    run = running_max(run, keys, order, F.col("won"), "_top", shard).withColumn("top", F.greatest(F.lit(0.0), F.col("_top")))
    fall, peak = F.col("top") - F.col("won"), F.col("put_in") + F.col("top")
    return run.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("o") == 1, fall)), F.lit(0.0)).alias("drawdown"), F.max(F.when((F.col("o") == 1) & (peak > 0), fall / peak * 100)).alias("drawdown_pct"), (F.sum("net") + F.sum("paid")).alias("balance"))


def added_into_adversity(trades: DataFrame, keys: list[str], width_us: int = 30 * DAY_US) -> DataFrame:
    """(keys, additions, adverse): trades opened while an earlier one of their keys is open, and those of them at a worse price than the latest such one.

    trades: keys, ticket, side, opened, closed, price. Earlier is by opening and ticket; one that closes at the very instant is still open.
    """
    spans = trades.select(*keys, F.col("ticket").alias("p_ticket"), F.col("opened").alias("p_opened"), F.col("closed").alias("p_closed"), F.col("price").alias("p_price"))
    held = between(trades.select(*keys, "ticket", "side", "opened", "price"), spans, keys, "opened", "p_opened", "p_closed", width_us)
    earlier = held.where((F.col("p_opened") < F.col("opened")) | ((F.col("p_opened") == F.col("opened")) & (F.col("p_ticket") < F.col("ticket"))))
    last = earlier.groupBy(*keys, "ticket", "side", "price").agg(F.max(F.struct("p_opened", "p_ticket", "p_price")).alias("m"))
    return last.groupBy(*keys).agg(F.count(F.lit(1)).alias("additions"), F.count(F.when(F.col("side") * (F.col("price") - F.col("m.p_price")) < 0, 1)).alias("adverse"))


def invalid_reasons(bars: DataFrame, width_us: int, steps: int, gap: Column) -> DataFrame:
    """bars with reason: why the path of `steps` bars from the next one on isn't whole - no next bar, an end beyond the data, else the first flagged gap or missing bar on it - or null."""
    w = Window.partitionBy(*SERIES).orderBy("bar_us")
    step = F.when(gap, "flagged_gap").when(F.col("bar_us") - F.lag("bar_us").over(w) != width_us, "missing_bar")
    rows = bars.withColumn("_r", step)
    path = w.rowsBetween(1, steps + 1)
    first = F.first("_r", ignorenulls=True).over(path)
    ahead = F.count(F.lit(1)).over(path)
    return rows.withColumn("reason", F.when(ahead == 0, "entry_unavailable").when(ahead <= steps, "exit_beyond_data").otherwise(first)).drop("_r")


def live_entries(signals: DataFrame, quotes: DataFrame, keys: list[str], age_us: int, delay_us: int) -> DataFrame:
    """signals (keys, at, seen) with the freshest quote from at to seen (q_t, q_bid, q_ask), if it is no older than age_us when seen and the signal no older than delay_us."""
    got = asof(signals, quotes, keys, "seen", "us", ["bid", "ask"], prefix="q_")
    fits = (F.col("seen") - F.col("at") <= delay_us) & (F.col("q_t") >= F.col("at")) & (F.col("seen") - F.col("q_t") <= age_us)
    return got.withColumns({c: F.when(fits, F.col(c)) for c in ("q_t", "q_bid", "q_ask")})


def checked_join(features: DataFrame, labels: DataFrame, key: str, t: str) -> DataFrame:
    """Features joined to labels by key. A key that repeats on either side, or whose times differ, raises when its row is computed."""
    once = lambda df, n: df.groupBy(key).agg(F.count(F.lit(1)).alias(n), F.first(F.struct(*[c for c in df.columns if c != key])).alias(f"{n}_row"))
    both = once(features, "_f").join(once(labels, "_l"), key)
    sound = (F.col("_f") == 1) & (F.col("_l") == 1) & F.col(f"_f_row.{t}").eqNullSafe(F.col(f"_l_row.{t}"))
    checked = both.withColumn("_ok", F.when(sound, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("features and labels disagree on "), F.col(key).cast("string"))).cast("boolean"))).where("_ok")
    return checked.select(key, "_f_row.*", *[F.col(f"_l_row.{c}").alias(c) for c in labels.columns if c not in (key, t)])


def session_policies(rows: DataFrame, side: str, failure_s: int = 300, activity: float = 1.5) -> DataFrame:
    """The decisions of four policies on a day's breakout states: (SERIES, bar_us, policy, direction).

    rows: SERIES, day, bar_us, side, return_5s, tick_intensity_ratio. At the first bar of a breakout: immediate, momentum_confirmed (the 5-s return agrees)
    and activity_confirmed (and the ticks come faster). At the bar where the state falls back to zero within failure_s of the breakout: a fade of it. A
    change of side without zero between is no new breakout. Days begin afresh.
    """
    keys, w = [*SERIES, "day"], Window.partitionBy(*SERIES, "day").orderBy("bar_us")
    was = F.coalesce(F.lag(side).over(w), F.lit(0))
    seen = rows.withColumn("_was", was).withColumn("_edge", (F.col(side) != 0) & (F.col("_was") == 0))
    seen = seen.withColumn("_at", F.max(F.when(F.col("_edge"), F.col("bar_us"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    with_it = F.coalesce(F.col("return_5s") * F.col(side) > 0, F.lit(False))
    fades = (F.col(side) == 0) & (F.col("_was") != 0) & (F.col("bar_us") - F.col("_at") <= failure_s * SECOND)
    one = lambda test, name, direction: F.when(test, F.struct(F.lit(name).alias("policy"), direction.cast("int").alias("direction")))
    found = F.array_compact(F.array(one(F.col("_edge"), "immediate_breakout", F.col(side)), one(F.col("_edge") & with_it, "momentum_confirmed", F.col(side)), one(F.col("_edge") & with_it & (F.col("tick_intensity_ratio") >= activity), "activity_confirmed", F.col(side)), one(fades, "false_breakout_fade", -F.col("_was"))))
    return seen.select(*keys, "bar_us", F.explode(found).alias("p")).select(*keys, "bar_us", "p.*")


def provider_paths(trades: DataFrame, value: str = "mae_bps") -> DataFrame:
    """One row: trades, median and worst excursion, the order statistic at a twentieth (index int(n / 20) - 1, at least 0), shares of quick exits and runners."""
    rows = written(trades)
    n = rows.groupBy().agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("worst"), F.avg((F.col("holding_s") <= 60).cast("double")).alias("quick_ratio"), F.avg((F.col("holding_s") >= 900).cast("double")).alias("runner_ratio"))
    half = quantiles_of(rows, [], value, {"median": 0.5}).select("median")
    total = n.first()["n"]
    rank = max(0, int(total * 0.05) - 1)
    low = quantiles_of(rows, [], value, {"low": rank / (total - 1) if total > 1 else 0.0}).select("low") if total else None
    out = n.withColumn("median", half.scalar())
    return out.withColumn("low", low.scalar() if low is not None else F.lit(None).cast("double"))


def previous(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """rows with the value of the row before in its keys, over time shards of order[0]."""
    return carried(rows, keys, order, value, name, shard_of(order[0]), strict=True)
