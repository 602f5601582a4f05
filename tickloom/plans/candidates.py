"""Candidate queries: states and families on completed bars, regime gates per fold, ledgers of candidates, gap classes and feasibility, with their DuckDB statements."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators import asof, bars, folds, metrics, outcomes, paths, research, windows
from tickloom.operators.metrics import quantized
from tickloom.operators.quantiles import quantiles_of
from tickloom.plans import labs, market
from tickloom.plans.labs_sql import FEATURES, KEPT, _out, summary
from tickloom.plans.market import FIVE, S, five, quotes, seconds
from tickloom.plans.market_sql import _STATE, B5, S1, Q, W, qz
from tickloom.plans.sequence_lab import _FO, END, FOLDS, START
from tickloom.session import us, written
from tickloom.sources import files

SECOND = 1_000_000
MINUTE = 60 * SECOND
# steps of three, twelve and forty-eight base bars; bars here are of a minute, as the quotes of an instrument last some hours a day
STEPS = (3 * MINUTE, 12 * MINUTE, 48 * MINUTE)


def _minute_bars(spark, d) -> DataFrame:
    """One-minute bars of each instrument over all sources."""
    return bars.time_bars(quotes(spark, d).withColumn("source", F.lit("all")), MINUTE)


def states(base: DataFrame) -> DataFrame:
    """Base bars with what the last completed longer bars say: displacement of the short one in its average ranges, trend of the middle one (two exponential means), return over two of the long ones, and of the base itself
    path efficiency, volatility expansion and rejection at the range of the long step. Nothing of a bar that is still forming is used."""
    w = windows.by_bar()
    rolled = [bars.roll_up(base, k) for k in STEPS]
    short = windows.atr(rolled[0], 14).withColumn("displacement", F.abs(F.col("close") - F.col("open")) / F.nullif(F.col("atr"), F.lit(0.0)))
    middle = windows.ema(windows.ema(rolled[1], 12, "fast"), 26, "slow").withColumn("trend", F.coalesce(F.signum(F.col("fast") - F.col("slow")), F.lit(0.0)).cast("int"))
    long = rolled[2].withColumn("far_return", (F.col("close") / F.lag("open").over(w) - 1) * 10_000)
    rows = base
    for table, width, columns in ((short, STEPS[0], ["displacement"]), (middle, STEPS[1], ["trend"]), (long, STEPS[2], ["far_return"])):
        at = F.lead("bar_us").over(w)
        # what a longer bar says holds for the base bars of the next one that has any, and until another is complete
        known = table.select(*S, at.alias("period"), *columns).where("period is not null")
        rows = rows.withColumn("period", bars.bucket("bar_us", width)).join(known, [*S, "period"], "left").drop("period")
    slow = windows.bar_trend(base, STEPS[2] // SECOND).select(*S, "bar_us", "prior_high", "prior_low", F.col("volatility").alias("slow_volatility"))
    quick = windows.bar_trend(base, 360).select(*S, "bar_us", "efficiency", "volatility")
    rows = rows.join(slow, [*S, "bar_us"]).join(quick, [*S, "bar_us"])
    rows = rows.withColumn("rejection", research.rejection("high", "low", "close", "prior_high", "prior_low")).withColumn("expansion", F.col("volatility") / F.nullif(F.col("slow_volatility"), F.lit(0.0)))
    return rows.select(*S, "bar_us", "displacement", "trend", "far_return", "efficiency", "expansion", "rejection")


def win12_states(spark, d):
    """States on completed bars, for each minute of each instrument."""
    rows = states(_minute_bars(spark, d))
    return rows.select("instrument", "bar_us", "trend", "rejection", *[quantized(c, 5).alias(c) for c in ("displacement", "far_return", "efficiency", "expansion")])


def win17_shocks_288(spark, d):
    """Shocks against the 288 bars before, on minute bars of each instrument."""
    return windows.shocks(_minute_bars(spark, d), 288).select("instrument", "bar_us", quantized("bar_return", 9).alias("bar_return"), "side")


def win19_sweeps_48(spark, d):
    """Sweeps of the 48-bar range that close back inside, on minute bars of each instrument."""
    return windows.sweeps(_minute_bars(spark, d), 48).select("instrument", "bar_us", "side")


def _family_rows(spark, d) -> DataFrame:
    """(SERIES, bar_us, family, side, strength) at each rising edge of a family, 96 minutes apart from the last one taken."""
    none = F.lit(None).cast("int")
    rows = written(states(_minute_bars(spark, d)).withColumn("zone_side", none).withColumn("zone_mitigated", F.lit(False)))
    w = windows.by_bar()
    found = rows.withColumn("f", research.families("trend", "far_return", "efficiency", "rejection", "displacement", "expansion", "zone_side", "zone_mitigated"))
    names = F.transform("f", lambda x: x["family"])
    found = found.withColumn("_was", F.coalesce(F.lag(names).over(w), F.array().cast("array<string>")))
    edges = found.select(*S, "bar_us", "_was", F.explode("f").alias("hit")).where(~F.array_contains("_was", F.col("hit.family"))).select(*S, "bar_us", "hit.family", "hit.side", "hit.strength")
    return folds.cooldown(edges, [*S, "family"], "bar_us", ["bar_us"], 96 * MINUTE)


def sim13_family_episodes(spark, d):
    """Episodes of the strategy families: rising edges, and after one taken none of its family for 96 minutes."""
    return _family_rows(spark, d).select("instrument", "bar_us", "family", "side", quantized("strength", 5).alias("strength"))


def lab14_tournament(spark, d):
    """Families against horizons: episodes, those without a valid outcome, and what the others made."""
    base = written(_minute_bars(spark, d))
    hits = written(_family_rows(spark, d))
    out = None
    for steps in (1, 5, 15, 30):
        labels = outcomes.bar_outcomes(base, MINUTE, steps, 0.5).where("valid").select(*S, "bar_us", "long_net_bps", "short_net_bps")
        part = hits.join(labels, [*S, "bar_us"], "left").select("family", F.lit(steps).alias("steps"), F.when(F.col("side") > 0, F.col("long_net_bps")).otherwise(F.col("short_net_bps")).alias("net"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("family", "steps").agg(F.count(F.lit(1)).alias("episodes"), F.count(F.when(F.col("net").isNull(), 1)).alias("invalid"), quantized(F.avg("net"), 4).alias("mean"), quantized(F.avg((F.col("net") > 0).cast("double")), 5).alias("win_rate"))


def _fold_parts(spark, rows: DataFrame, start: str, end: str) -> DataFrame:
    f = metrics.folds(spark, START, END, FOLDS).select("fold", us(start).alias("_a"), (us(end) - 1).alias("_z"), F.lit(1).alias("_one"))
    return asof.between(rows.withColumn("_one", F.lit(1)), f, ["_one"], "bar_us", "_a", "_z", 86_400 * SECOND).drop("_one", "_a", "_z")


def lab08_regime_gates(spark, d):
    """Thirteen regime gates on breakout episodes: thresholds are the medians of each fold's training part, results those of its test part."""
    b = written(seconds(spark, d))
    starts = market._starts(b)
    f = windows.second_features(b).select(*S, "bar_us", "spread_bps", "tick_intensity_ratio", "realized_volatility", "return_30s", "return_60s")
    width = windows.prior_levels(b.select(*S, "bar_us", "mid"), "bar_us", "mid", (300,)).select(*S, "bar_us", ((F.col("prior_high_300s") - F.col("prior_low_300s")) / F.col("mid") * 10_000).alias("width"))
    labels = outcomes.outcomes(b, 30, labs.LOOSE).where("valid").select(*S, "bar_us", "long_net_bps", "short_net_bps")
    hour = F.floor(F.pmod(F.col("bar_us"), F.lit(86_400 * SECOND)) / (3_600 * SECOND))
    rows = starts.join(f, [*S, "bar_us"]).join(width, [*S, "bar_us"]).join(labels, [*S, "bar_us"])
    rows = written(rows.select(*S, "bar_us", "spread_bps", "tick_intensity_ratio", "realized_volatility", "width", *research.signed("side", r30="return_30s", r60="return_60s"), F.when(hour < 7, "asia").when(hour < 12, "london_open").otherwise("new_york_open").alias("window"), F.when(F.col("side") > 0, F.col("long_net_bps")).otherwise(F.col("short_net_bps")).alias("net")))
    train = written(_fold_parts(spark, rows, "train_start", "train_end"))
    limits = None
    for c in ("spread_bps", "tick_intensity_ratio", "realized_volatility", "width"):
        one = quantiles_of(train, ["fold"], c, {f"m_{c}": 0.5}).drop("_n")
        limits = one if limits is None else limits.join(one, "fold")
    test = _fold_parts(spark, rows, "test_start", "test_end").join(limits, "fold")
    passed = research.gates("bar_us", "window", "spread_bps", "tick_intensity_ratio", "realized_volatility", "width", "r30", "r60", {"spread": F.col("m_spread_bps"), "activity": F.col("m_tick_intensity_ratio"), "volatility": F.col("m_realized_volatility"), "width": F.col("m_width")})
    each = test.select("fold", "net", F.explode(passed).alias("gate"))
    by_fold = each.groupBy("gate", "fold").agg(F.avg("net").alias("m")).groupBy("gate").agg(F.count(F.lit(1)).alias("folds"), F.count(F.when(F.col("m") > 0, 1)).alias("good_folds"), *research.family_low("m", len(research.GATES))).drop("low_normal")
    own = each.groupBy("gate").agg(F.count(F.lit(1)).alias("n"), F.avg("net").alias("mean"))
    return own.join(by_fold, "gate").select("gate", "n", quantized("mean", 4).alias("mean"), "folds", "good_folds", quantized("low_log", 3).alias("low"))


def _candidates(spark, d) -> DataFrame:
    """Bars at which the close leaves the trailing hour's range: (SERIES, bar_us, side)."""
    rows = windows.bar_trend(five(spark, d), 3600).withColumn("side", windows.breakout("close", "prior_high", "prior_low", 0.0))
    return rows.where("prior_high is not null and side <> 0").select(*S, "bar_us", "side")


def sim19_ledger(spark, d):
    """Each candidate with its result two bars on, or why it has none."""
    b = written(five(spark, d))
    why = research.invalid_reasons(b, FIVE, 2, F.col("tick_count") < 2).select(*S, "bar_us", "reason")
    labels = outcomes.bar_outcomes(b, FIVE, 2).select(*S, "bar_us", "valid", "long_net_bps", "short_net_bps")
    rows = _candidates(spark, d).join(why, [*S, "bar_us"], "left").join(labels, [*S, "bar_us"], "left")
    reason = F.coalesce(F.col("reason"), F.when(~F.coalesce("valid", F.lit(False)), "invalid_other"))
    net = F.when(F.col("side") > 0, F.col("long_net_bps")).otherwise(F.col("short_net_bps"))
    return rows.select(*S, "bar_us", "side", reason.alias("reason"), quantized(F.when(reason.isNull(), net), 4).alias("net_bps"))


def lab16_robustness(spark, d):
    """Candidates with a result, one at a time: results at three costs, and those by the half of the period, by side."""
    rows = written(sim19_ledger(spark, d).where("reason is null").withColumn("until", F.col("bar_us") + 3 * FIVE))
    taken = folds.without_overlap(rows, S, "bar_us", "until", ["bar_us"]).withColumn("gross", F.col("net_bps") + 2.0).withColumn("cost", F.lit(2.0))
    out = taken.groupBy("side").agg(F.count(F.lit(1)).alias("n"), *research.cost_levels("gross", "cost"), F.avg(F.when(F.col("bar_us") < 1_761_523_200 * SECOND, F.col("net_bps"))).alias("first_half"), F.avg(F.when(F.col("bar_us") >= 1_761_523_200 * SECOND, F.col("net_bps"))).alias("second_half"))
    return out.select("side", "n", *[quantized(c, 3).alias(c) for c in out.columns if c not in ("side", "n")])


CALENDAR = files.Calendar("UTC", date(2025, 10, 14), date(2025, 11, 12), ((6, 22 * 3600, 22 * 3600), (0, 22 * 3600, 22 * 3600), (1, 22 * 3600, 22 * 3600), (2, 22 * 3600, 22 * 3600), (3, 22 * 3600, 22 * 3600)), ())


def lab19_gap_semantics(spark, d):
    """Silences of more than two minutes: what the calendar says of them, whether five-minute bars are missing in them, and how long they are."""
    gaps = windows.gaps(seconds(spark, d), "bar_us", "mid", 120 * SECOND)
    judged = files.classify_spans(gaps, CALENDAR, "gap_start_us", "gap_end_us")
    length = (F.col("gap_end_us") - F.col("gap_start_us")) / SECOND
    hole = F.floor(F.col("gap_end_us") / FIVE) - F.floor(F.col("gap_start_us") / FIVE) > 1
    kind = research.gap_class(hole, F.lit(True), length, 240)
    return judged.groupBy("market", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.max(length).alias("longest_s"), quantized(F.avg("jump_bps"), 3).alias("mean_jump"))


def lab04_feasibility(spark, d):
    """Breakouts of two ranges at three horizons: what going with them, against them or with hindsight would have made at four slippages. Only episodes whose every horizon is valid count."""
    b = written(seconds(spark, d))
    horizons = (30, 60, 300)
    levels = windows.prior_levels(b.select(*S, "bar_us", "mid"), "bar_us", "mid", (60, 300))
    starts = None
    for window in (60, 300):
        rows = levels.withColumn("side", windows.breakout("mid", f"prior_high_{window}s", f"prior_low_{window}s", 1.0)).select(*S, "bar_us", "side")
        one = windows.episode_starts(rows, "bar_us", "side", 60 * SECOND).withColumn("level_s", F.lit(window))
        starts = one if starts is None else starts.unionByName(one)
    rows = written(starts)
    for h in horizons:
        labels = outcomes.outcomes(b, h, labs.LOOSE).where("valid").select(*S, "bar_us", F.struct(F.lit(h).alias("horizon_s"), F.col("long_gross_bps").alias("g"), F.col("long_net_bps").alias("l"), F.col("short_net_bps").alias("s")).alias(f"h{h}"))
        rows = rows.join(labels, [*S, "bar_us"])
    each = rows.select("level_s", "side", F.explode(F.array(*[f"h{h}" for h in horizons])).alias("o"), ).select("level_s", "side", "o.*").withColumn("slip", F.explode(F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 1.0)])))
    cost = lambda c: ((F.col(c) / 10_000 + 1) * (1 - F.col("slip") / 10_000) / (1 + F.col("slip") / 10_000) - 1) * 10_000
    up = F.col("side") > 0
    models = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), g.alias("gross"), v.alias("net")) for n, g, v in (("continuation", F.col("g") * F.col("side"), F.when(up, cost("l")).otherwise(cost("s"))), ("reversal", -F.col("g") * F.col("side"), F.when(up, cost("s")).otherwise(cost("l"))), ("hindsight", F.abs("g"), F.greatest(cost("l"), cost("s"))))])).alias("m")
    out = each.select("level_s", "horizon_s", "slip", models).select("level_s", "horizon_s", "slip", "m.*").groupBy("level_s", "horizon_s", "model", "slip").agg(F.count(F.lit(1)).alias("n"), F.avg("gross").alias("gross"), F.avg("net").alias("net"), F.avg((F.col("net") > 0).cast("double")).alias("win_rate"))
    return out.select("level_s", "horizon_s", "model", "slip", "n", *[quantized(c, 4).alias(c) for c in ("gross", "net", "win_rate")])


def lab12_confirmation(spark, d):
    """Staged results of the kept episodes by the confirmation rule they pass."""
    b = written(seconds(spark, d))
    kept = written(folds.cooldown(market._starts(b), S, "bar_us", ["bar_us"], 900 * SECOND))
    f = windows.second_features(b).select(*S, "bar_us", "spread_bps", "tick_intensity_ratio", "return_30s")
    levels = windows.prior_levels(b.select(*S, "bar_us", "mid"), "bar_us", "mid", (60, 300))
    mean = windows.reset_average(b.select(*S, "bar_us", "mid", "tick_count"), "bar_us", "mid", "tick_count", 300 * SECOND).select(*S, "bar_us", "vwap")
    rows = kept.join(f, [*S, "bar_us"]).join(levels, [*S, "bar_us"]).join(mean, [*S, "bar_us"]).withColumn("due", F.col("bar_us") + 6 * SECOND)
    later = asof.asof(rows, b.select(*S, F.col("bar_us").alias("t"), F.col("mid").alias("m")), S, "due", "t", ["m"], "forward", tolerance_us=60 * SECOND, prefix="x_")
    side = F.col("side")
    level = F.when(side > 0, F.col("prior_high_300s")).otherwise(F.col("prior_low_300s"))
    rules = research.confirmations("persistence", "spread_bps", "tick_intensity_ratio", "distance", "r30", "above", "squeeze")
    judged = later.select(
        *S, (F.col("bar_us") + SECOND).alias("start_us"), "side", (side * (F.col("x_m") - F.col("mid")) / F.col("mid") * 10_000).alias("persistence"), "spread_bps", "tick_intensity_ratio", (side * (F.col("mid") / level - 1) * 10_000).alias("distance"),
        (F.col("return_30s") * side).alias("r30"), ((F.col("mid") / F.col("vwap") - 1) * side).alias("above"), ((F.col("prior_high_60s") - F.col("prior_low_60s")) / F.nullif(F.col("prior_high_300s") - F.col("prior_low_300s"), F.lit(0.0))).alias("squeeze"),
    ).withColumn("rules", rules).withColumn("episode", F.pmod(F.xxhash64(*S, "start_us"), F.lit(1 << 62)))
    judged = written(judged)
    results = paths.staged_variants(judged.select("episode", *S, "start_us", "side"), quotes(spark, d), S, {"single_fixed": labs.VARIANTS["single_fixed"]})
    out = judged.select("episode", F.explode(F.concat(F.array(F.lit("none")), "rules")).alias("rule")).join(results, "episode")
    return labs._metrics(out, ["rule"], "net_bps")


_ROLL = lambda name, k: f"{name} as (select instrument, cast(floor(bar_us / {k}) as bigint) * {k} as p_us, first(open order by bar_us) as open, max(high) as high, min(low) as low, last(close order by bar_us) as close from m1 group by 1, 2)"
_WI = "partition by instrument order by bar_us"
_WP = "partition by instrument order by p_us"
_EMA = lambda n: f"case when count(*) over (w rows {n - 1} preceding) = {n} then " + " + ".join(f"lag(close, {k}) over w * {((2 / (n + 1)) * ((n - 1) / (n + 1)) ** k if k < n - 1 else ((n - 1) / (n + 1)) ** (n - 1))!r}" for k in range(n)) + " end"


def _trend(s: int, name: str) -> str:
    return f"""{name} as (select instrument, bar_us, max(high) over p as ph, min(low) over p as pl, abs(close - first_value(close) over f) as net, sum(abs(step)) over f - coalesce(abs(first_value(step) over f), 0) as dist, case when count(*) over f > 1 then sqrt(greatest(sum(sq) over f - first_value(sq) over f, 0) / (count(*) over f - 1)) else 0 end as vol
  from ms window f as ({_WI} range between {s}000000 preceding and current row), p as ({_WI} range between {s}000000 preceding and 1000000 preceding))"""


_STATES = f"""{Q}, m1 as materialized (select instrument, cast(floor(us / 60000000) as bigint) * 60000000 as bar_us, first(mid order by us, id) as open, max(mid) as high, min(mid) as low, last(mid order by us, id) as close, first(bid order by us, id) as open_bid, first(ask order by us, id) as open_ask from (select * replace ('all' as source) from q) group by all),
{_ROLL('ra', STEPS[0])}, {_ROLL('rb', STEPS[1])}, {_ROLL('rc', STEPS[2])},
ta as (select *, case when lag(close) over ({_WP}) is not null then greatest(high - low, abs(high - lag(close) over ({_WP})), abs(low - lag(close) over ({_WP}))) end as tr from ra),
sa as (select instrument, lead(p_us) over ({_WP}) as p_us, abs(close - open) / nullif(case when count(tr) over ({_WP} rows 13 preceding) = 14 then avg(tr) over ({_WP} rows 13 preceding) end, 0) as displacement from ta),
sb as (select instrument, lead(p_us) over w as p_us, cast(coalesce(sign({_EMA(12)} - ({_EMA(26)})), 0) as integer) as trend from rb window w as ({_WP})),
sc as (select instrument, lead(p_us) over ({_WP}) as p_us, (close / lag(open) over ({_WP}) - 1) * 10000 as far from rc),
ms as (select *, close - lag(close) over ({_WI}) as step, coalesce(pow(close / lag(close) over ({_WI}) - 1, 2), 0) as sq from m1), {_trend(2880, 'tl')}, {_trend(360, 'tq')},
stt as materialized (select m1.instrument, m1.bar_us, displacement, trend, far, coalesce(tq.net / nullif(tq.dist, 0), 0) as eff, tq.vol / nullif(tl.vol, 0) as exp_, case when m1.high > tl.ph and m1.close < tl.ph then -1 when m1.low < tl.pl and m1.close > tl.pl then 1 else 0 end as rej
  from m1 left join sa on sa.instrument = m1.instrument and sa.p_us = cast(floor(m1.bar_us / {STEPS[0]}) as bigint) * {STEPS[0]} left join sb on sb.instrument = m1.instrument and sb.p_us = cast(floor(m1.bar_us / {STEPS[1]}) as bigint) * {STEPS[1]}
  left join sc on sc.instrument = m1.instrument and sc.p_us = cast(floor(m1.bar_us / {STEPS[2]}) as bigint) * {STEPS[2]} join tl on tl.instrument = m1.instrument and tl.bar_us = m1.bar_us join tq on tq.instrument = m1.instrument and tq.bar_us = m1.bar_us)"""
_AL = "coalesce(trend, 0) <> 0 and far * trend > 0 and eff >= 0.35"
_FAM = f"""{_STATES}, sn as (select *, row_number() over ({_WI}) as rn from stt),
fr as (select instrument, bar_us, rn, 'trend_continuation' as family, trend as side, abs(far) as strength from sn where {_AL} union all select instrument, bar_us, rn, 'boundary_rejection', rej, 1.0 from sn where rej <> 0
  union all select instrument, bar_us, rn, 'displacement_persistence', trend, displacement from sn where {_AL} and displacement >= 1.5 union all select instrument, bar_us, rn, 'volatility_expansion', trend, exp_ from sn where {_AL} and exp_ >= 1.5),
fe2 as (select a.*, row_number() over (partition by a.instrument, a.family order by a.bar_us) as i from fr a anti join (select instrument, family, rn + 1 as rn from fr) b on a.instrument = b.instrument and a.family = b.family and a.rn = b.rn),
fc(instrument, family, i, last, keep) as (select instrument, family, i, bar_us, true from fe2 where i = 1 union all select o.instrument, o.family, o.i, case when o.bar_us >= fc.last + {96 * MINUTE} then o.bar_us else fc.last end, o.bar_us >= fc.last + {96 * MINUTE} from fc join fe2 o on o.instrument = fc.instrument and o.family = fc.family and o.i = fc.i + 1),
fh as materialized (select fe2.* from fe2 join fc using (instrument, family, i) where keep)"""
_MOUT = ", ".join(f"o{k} as (select instrument, bar_us, {k} as steps, (lead(open_bid, {k + 1}) over w * 0.99995 / (lead(open_ask, 1) over w * 1.00005) - 1) * 10000 as lg, (lead(open_bid, 1) over w * 0.99995 / (lead(open_ask, {k + 1}) over w * 1.00005) - 1) * 10000 as sh, lead(bar_us, {k + 1}) over w - bar_us = {(k + 1) * MINUTE} as ok from m1 window w as ({_WI}))" for k in (1, 5, 15, 30))
_GATES = {
    "all": "true", "asia_only": "win = 'asia'", "london_only": "win = 'london_open'", "new_york_only": "win = 'new_york_open'", "tight_spread": "sp <= m_sp", "high_activity": "intensity >= m_in", "low_volatility": "vol <= m_vol", "high_volatility": "vol > m_vol",
    "narrow_range": "width <= m_w", "wide_range": "width > m_w", "trend_aligned_30s": "r30 * side > 0", "trend_aligned_60s": "r60 * side > 0", "weekday_tue_thu": "floor((bar_us + 259200000000) % 604800000000 / 86400000000) between 1 and 3",
}
_TRAIN = "ft as (select k + 1 as fold, epoch_us(timestamp '2025-10-12') as a, epoch_us(timestamp '2025-10-12') + (10 + 3 * k) * 86400000000 as z from range(0, 20) r(k))"
_LED = f"""{B5}, tr as (select source, instrument, bar_us, close, max(high) over p as ph, min(low) over p as pl from b window p as ({W} range between 3600000000 preceding and 1000000 preceding)),
cn as (select source, instrument, bar_us, case when (close / ph - 1) * 10000 >= 0 then 1 when (pl / close - 1) * 10000 >= 0 then -1 end as side from tr where ph is not null),
rs as (select *, case when tick_count < 2 then 'flagged_gap' when bar_us - lag(bar_us) over w <> 300000000 then 'missing_bar' end as r, count(*) over (partition by source, instrument order by bar_us rows between 1 following and 3 following) as ahead from b window w as ({W})),
lb as (select source, instrument, bar_us, case when ahead = 0 then 'entry_unavailable' when ahead <= 2 then 'exit_beyond_data' else coalesce(lead(r, 1) over w, lead(r, 2) over w, lead(r, 3) over w) end as reason, (lead(open_bid, 3) over w / lead(open_ask, 1) over w - 1) * 10000 as lg, (lead(open_bid, 1) over w / lead(open_ask, 3) over w - 1) * 10000 as sh from rs window w as ({W})),
lg as materialized (select cn.*, reason, case when reason is null then {qz('case when side > 0 then lg else sh end', 4)} end as net from cn join lb using (source, instrument, bar_us) where side is not null)"""
_HALF = ", ".join(f"{qz(f'avg(gross - {k} * 2.0)', 3)} as mean_{n}, {qz(f'sum(case when gross - {k} * 2.0 > 0 then gross - {k} * 2.0 else 0 end) / nullif(sum(case when gross - {k} * 2.0 < 0 then {k} * 2.0 - gross else 0 end), 0)', 3)} as factor_{n}" for n, k in (("base", 1.0), ("cost_1_5x", 1.5), ("cost_2x", 2.0)))


def _start(s: int) -> str:
    return f"""z{s} as (select source, instrument, bar_us, mid, max(mid) over r as hi, min(mid) over r as lo from s window r as ({W} range between {s}000000 preceding and 1 preceding)),
y{s} as (select source, instrument, bar_us, case when (mid / hi - 1) * 10000 >= 1 then 1 when (lo / mid - 1) * 10000 >= 1 then -1 else 0 end as side from z{s}),
e{s} as (select {s} as level_s, source, instrument, bar_us, side from (select *, lag(side) over w as ps, lag(bar_us) over w as pt from y{s} window w as ({W})) where side <> 0 and (pt is null or bar_us - pt > 60000000 or side <> ps))"""


def _outg(h: int) -> str:
    """_out with the gross of the long side as well."""
    return _out(h, 30, 30, 60).replace("(eb / x_ask - 1) * 10000 as short_net", "(eb / x_ask - 1) * 10000 as short_net, ((x_bid + x_ask) / 2 / ((eb + ea) / 2) - 1) * 10000 as gross")


_SLIP = lambda c: f"(({c} / 10000 + 1) * (1 - slip / 10000) / (1 + slip / 10000) - 1) * 10000"
_CONF = f"""with recursive {KEPT}, {FEATURES}, ag as (select *, bar_us - lag(bar_us) over ({W}) as age, cast(floor(bar_us / 86400000000) as bigint) as day, floor((bar_us % 86400000000) / 3600000000) as h from s),
ak as (select *, case when h >= 21 then 4 when h >= 16 then 3 when h >= 12 then 2 when h >= 7 then 1 else 0 end as ses from ag), ar as (select *, sum(case when age > 300000000 then 1 else 0 end) over (partition by source, instrument, day, ses order by bar_us rows unbounded preceding) as run from ak),
av as (select source, instrument, bar_us, sum(mid * tick_count) over v / sum(tick_count) over v as vwap from ar window v as (partition by source, instrument, day, ses, run order by bar_us rows unbounded preceding)),
lv as (select source, instrument, bar_us, max(mid) over r3 as h3, min(mid) over r3 as l3, max(mid) over r6 as h6, min(mid) over r6 as l6 from s window r3 as ({W} range between 300000000 preceding and 1 preceding), r6 as ({W} range between 60000000 preceding and 1 preceding)),
jn as (select ep.*, fe.mid, sp, intensity, r30, vwap, h3, l3, h6, l6 from ep join fe on fe.source = ep.source and fe.instrument = ep.instrument and fe.bar_us = start_us - 1000000 join av on av.source = fe.source and av.instrument = fe.instrument and av.bar_us = fe.bar_us join lv on lv.source = fe.source and lv.instrument = fe.instrument and lv.bar_us = fe.bar_us),
pe as (select jn.*, case when x.bar_us - (start_us + 5000000) <= 60000000 then side * (x.mid - jn.mid) / jn.mid * 10000 end as pers from jn asof left join s x on jn.source = x.source and jn.instrument = x.instrument and jn.start_us + 5000000 <= x.bar_us),
ql as (select *, coalesce(pers >= 0.25, false) as held, coalesce(pers >= 0.25 and sp <= 3 and intensity >= 1 and side * (mid / case when side > 0 then h3 else l3 end - 1) * 10000 >= 0.25, false) as quality, coalesce(pers >= 0.25 and r30 * side > 0 and (mid / vwap - 1) * side > 0, false) as aligned, coalesce((h6 - l6) / nullif(h3 - l3, 0) <= 1, false) as tight from pe),
ru as (select source, instrument, start_us, side, unnest(list_filter(['none', case when held then 'persistence' end, case when quality then 'market_quality' end, case when aligned then 'alignment' end, case when quality and aligned and tight then 'full_confirmation' end], lambda x: x is not null)) as rule from ql),
pth as (select ep.*, q.us, case when side > 0 then q.ask else q.bid end as into_, case when side > 0 then q.bid else q.ask end as out_, row_number() over (partition by ep.source, ep.instrument, start_us order by q.us, q.id) as rn from ep join q on ep.source = q.source and ep.instrument = q.instrument and q.us between start_us and start_us + 332000000),
p1 as (select *, max(into_) filter (where rn = 1) over k as e_into, min(us) over k as e_us from pth window k as (partition by source, instrument, start_us)), p2 as (select *, side * (out_ - e_into) / e_into * 10000 as move from p1),
p3 as (select *, move <= -12 or (us - e_us >= 15000000 and move <= -6) or us >= e_us + 300000000 as done from p2), p4 as (select source, instrument, start_us, arg_min(move, rn) as net from p3 where done group by all)
select {summary('rule', 'net')} from ru join p4 using (source, instrument, start_us) group by rule"""

_M1 = _STATES[: _STATES.index(",\n" + _ROLL("ra", STEPS[0]))]
ORACLE = {
    "win17_shocks_288": f"""with {_M1}, rr as (select *, close / lag(close) over ({_WI}) - 1 as ret, row_number() over ({_WI}) as i from m1), jj as (select a.instrument, a.i, a.bar_us, a.ret, median(abs(z.ret)) as m, count(z.ret) as n from rr a join rr z on a.instrument = z.instrument and z.i between a.i - 288 and a.i - 1 group by all),
kk as (select jj.instrument, jj.bar_us, jj.ret, jj.m, median(abs(abs(z.ret) - jj.m)) as d from jj join rr z on jj.instrument = z.instrument and z.i between jj.i - 288 and jj.i - 1 where jj.n = 288 group by all) select instrument, bar_us, {qz('ret', 9)} as bar_return, cast(sign(ret) as integer) as side from kk where d > 0 and abs(ret) > m + 3.0 * 1.4826 * d""",
    "win19_sweeps_48": f"with {_M1}, ww as (select *, max(high) over w as h, min(low) over w as l, count(*) over w as n from m1 window w as ({_WI} rows between 48 preceding and 1 preceding)) select instrument, bar_us, case when high > h and close < h then -1 else 1 end as side from ww where n = 48 and ((high > h and close < h) or (low < l and close > l))",
    "win12_states": f"with {_STATES} select instrument, bar_us, trend, rej as rejection, {qz('displacement', 5)} as displacement, {qz('far', 5)} as far_return, {qz('eff', 5)} as efficiency, {qz('exp_', 5)} as expansion from stt",
    "sim13_family_episodes": f"with recursive {_FAM} select instrument, bar_us, family, side, {qz('strength', 5)} as strength from fh",
    "lab14_tournament": f"with recursive {_FAM}, {_MOUT}, oo as (select * from o1 union all select * from o5 union all select * from o15 union all select * from o30), r as (select family, steps, case when ok then case when side > 0 then lg else sh end end as net from fh join oo using (instrument, bar_us)) select family, steps, count(*) as episodes, count(*) - count(net) as invalid, {qz('avg(net)', 4)} as mean, {qz('avg(case when net > 0 then 1.0 when net <= 0 then 0.0 end)', 5)} as win_rate from r group by family, steps",
    "lab08_regime_gates": f"""with {_STATE}, {FEATURES}, {_out(30, 30, 30, 60)}, {_FO}, {_TRAIN}, wd as (select source, instrument, bar_us, (hi - lo) / mid * 10000 as width from p),
rw as materialized (select e.bar_us, e.side, sp, intensity, vol, width, r30, r60, case when (e.bar_us % 86400000000) < 25200000000 then 'asia' when (e.bar_us % 86400000000) < 43200000000 then 'london_open' else 'new_york_open' end as win, case when side > 0 then long_net else short_net end as net from e join fe using (source, instrument, bar_us) join wd using (source, instrument, bar_us) join v30 using (source, instrument, bar_us)),
md as (select fold, median(sp) as m_sp, median(intensity) as m_in, median(vol) as m_vol, median(width) as m_w from ft join rw on bar_us >= a and bar_us < z group by fold), te as (select rw.*, fo.fold, m_sp, m_in, m_vol, m_w from rw join fo on bar_us >= a and bar_us < z join md on md.fold = fo.fold),
ga as ({" union all ".join(f"select '{g}' as gate, fold, net from te where {c}" for g, c in _GATES.items())}), bf as (select gate, count(*) as folds, count(*) filter (where m > 0) as good_folds, case when count(*) >= 2 then avg(m) - sqrt(2 * ln(13)) * stddev_samp(m) / sqrt(count(*)) end as low from (select gate, fold, avg(net) as m from ga group by all) group by gate)
select gate, n, {qz('mean', 4)} as mean, folds, good_folds, {qz('low', 3)} as low from (select gate, count(*) as n, avg(net) as mean from ga group by gate) join bf using (gate)""",
    "sim19_ledger": f"with {_LED} select source, instrument, bar_us, side, reason, net as net_bps from lg",
    "lab16_robustness": f"""with recursive {_LED}, o as (select *, net + 2.0 as gross, row_number() over ({W}) as i from lg where reason is null), g(source, instrument, i, until, keep) as (select source, instrument, i, bar_us + 900000000, true from o where i = 1
  union all select o.source, o.instrument, o.i, case when o.bar_us >= g.until then o.bar_us + 900000000 else g.until end, o.bar_us >= g.until from g join o on o.source = g.source and o.instrument = g.instrument and o.i = g.i + 1)
select side, count(*) as n, {_HALF}, {qz('avg(case when bar_us < 1761523200000000 then net end)', 3)} as first_half, {qz('avg(case when bar_us >= 1761523200000000 then net end)', 3)} as second_half from o join g using (source, instrument, i) where keep group by side""",
    "lab19_gap_semantics": f"""with {S1}, gz as (select * from (select *, lag(bar_us) over ({W}) as pt, lag(mid) over ({W}) as pm from s) where bar_us - pt > 120000000),
ds as (select epoch_us(d) + 79200000000 as a, epoch_us(d) + 165600000000 as z from range(timestamp '2025-10-13', timestamp '2025-11-13', interval 1 day) r(d) where dayofweek(d) <= 4),
sp as (select a, z, sum(f) over (order by a) as g from (select *, case when a = lag(z) over (order by a) then 0 else 1 end as f from ds)), op as (select min(a) as a, max(z) as z from sp group by g),
k as (select *, case when pt < epoch_us(timestamp '2025-10-14') or bar_us > epoch_us(timestamp '2025-11-12') then 'out_of_range' when exists (select 1 from op where op.a <= pt and bar_us <= op.z) then 'open' else 'closed' end as market, case when floor(bar_us / 300000000) - floor(pt / 300000000) > 1 then 'bar_discontinuity' when (bar_us - pt) / 1000000 <= 240 then 'short_interruption_only' else 'long_interruption_or_closure' end as kind from gz)
select market, kind, count(*) as n, max((bar_us - pt) / 1000000) as longest_s, {qz('avg((mid / pm - 1) * 10000)', 3)} as mean_jump from k group by market, kind""",
    "lab04_feasibility": f"""with {S1}, {_start(60)}, {_start(300)}, {_outg(30)}, {_outg(60)}, {_outg(300)}, st as (select * from e60 union all select * from e300),
al as (select st.*, unnest([{{'h': 30, 'g': v30.gross, 'l': v30.long_net, 's': v30.short_net}}, {{'h': 60, 'g': v60.gross, 'l': v60.long_net, 's': v60.short_net}}, {{'h': 300, 'g': v300.gross, 'l': v300.long_net, 's': v300.short_net}}]) as o from st join v30 using (source, instrument, bar_us) join v60 using (source, instrument, bar_us) join v300 using (source, instrument, bar_us)),
sl as (select level_s, side, o.h as h, o.g as g, o.l as l, o.s as s_, slip from al cross join (values (0.0::double), (0.25::double), (0.5::double), (1.0::double)) v(slip)), nn as (select *, {_SLIP('l')} as nl, {_SLIP('s_')} as ns from sl),
mo as (select level_s, h, slip, 'continuation' as model, g * side as gross, case when side > 0 then nl else ns end as net from nn union all select level_s, h, slip, 'reversal', -g * side, case when side > 0 then ns else nl end from nn union all select level_s, h, slip, 'hindsight', abs(g), greatest(nl, ns) from nn)
select level_s, h as horizon_s, model, slip, count(*) as n, {qz('avg(gross)', 4)} as gross, {qz('avg(net)', 4)} as net, {qz('avg(case when net > 0 then 1.0 else 0.0 end)', 4)} as win_rate from mo group by all""",
    "lab12_confirmation": _CONF,
}
QUERIES = {f.__name__: f for f in (win12_states, win17_shocks_288, win19_sweeps_48, sim13_family_episodes, lab14_tournament, lab08_regime_gates, sim19_ledger, lab16_robustness, lab19_gap_semantics, lab04_feasibility, lab12_confirmation)}
