"""Queries over quotes and news, with their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.operators import asof, bars, classify, folds, outcomes, upsert, windows
from tickloom.operators.metrics import quantized
from tickloom.operators.quantiles import quantiles_of
from tickloom.session import load, us, written

S = bars.SERIES
FIVE = bars.FIVE_MINUTES_US
MINUTE = 60_000_000


def quotes(spark: SparkSession, d: str) -> DataFrame:
    return bars.quotes(load(spark, d, "market_ticks"))


def five(spark: SparkSession, d: str) -> DataFrame:
    return bars.time_bars(quotes(spark, d))


def seconds(spark: SparkSession, d: str) -> DataFrame:
    return bars.second_bars(quotes(spark, d))


def _qz(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: quantized(c, digits) for c in columns})


def agg01_second_bars(spark, d):
    return seconds(spark, d).drop("open_mid")


def agg02_five_minute_bars(spark, d):
    return five(spark, d).drop("close_us")


def agg04_completed_bars(spark, d):
    rows = bars.last_completed(five(spark, d), 3 * FIVE, "m15_close")
    return bars.last_completed(rows, 12 * FIVE, "h1_close").select(*S, "bar_us", "m15_close", "h1_close")


def win01_second_features(spark, d):
    rows = windows.second_features(seconds(spark, d)).drop("tick_count", "quote_change_count", "spread_bps", "mid")
    return _qz(rows, "intrasecond_return", "spread_shock_ratio", "tick_intensity_ratio", "return_1s", "return_5s", "return_30s", "return_60s", "realized_volatility", digits=8)


def win03_prior_levels(spark, d):
    return windows.prior_levels(seconds(spark, d).select(*S, "bar_us", "mid"), "bar_us", "mid").drop("mid")


def win04_reset_average(spark, d):
    rows = windows.reset_average(seconds(spark, d).select(*S, "bar_us", "mid", "tick_count"), "bar_us", "mid", "tick_count", 300_000_000)
    return rows.select(*S, "bar_us", "session", quantized((F.col("mid") / F.col("vwap") - 1) * 10_000, 4).alias("distance_bps"))


def win05_session_range(spark, d):
    return windows.session_range(five(spark, d), 0, 8).select(*S, "bar_us", "range_high", "range_low")


def win06_bar_trend(spark, d):
    rows = windows.bar_trend(five(spark, d), 3600).select(*S, "bar_us", "trend_return", "efficiency", "prior_high", "prior_low", "volatility")
    return _qz(rows, "trend_return", "efficiency", "volatility")


def win07_segments(spark, d):
    return windows.segments(seconds(spark, d).select(*S, "bar_us"), "bar_us", 30_000_000)


def win08_episode_starts(spark, d):
    return _starts(seconds(spark, d))


def _starts(second_bars: DataFrame) -> DataFrame:
    rows = windows.prior_levels(second_bars.select(*S, "bar_us", "mid"), "bar_us", "mid", (300,))
    rows = rows.withColumn("side", windows.breakout("mid", "prior_high_300s", "prior_low_300s", 1.0))
    return windows.episode_starts(rows.select(*S, "bar_us", "side"), "bar_us", "side", 60_000_000)


def win10_ema(spark, d):
    return _qz(windows.ema(five(spark, d), 6).select(*S, "bar_us", "ema"), "ema")


def win11_atr(spark, d):
    return _qz(windows.atr(five(spark, d), 6).select(*S, "bar_us", "atr"), "atr")


def win13_fair_value_gaps(spark, d):
    return windows.fair_value_gaps(five(spark, d))


def win14_contiguous(spark, d):
    return five(spark, d).select(*S, "bar_us", windows.contiguous(FIVE, 2).alias("whole"))


def win17_shocks(spark, d):
    return _qz(windows.shocks(five(spark, d), 12), "bar_return", digits=9)


def win18_failed_moves(spark, d):
    return _qz(windows.failed_moves(five(spark, d), FIVE), "retraced")


def win19_sweeps(spark, d):
    return windows.sweeps(five(spark, d), 12)


def win21_gaps(spark, d):
    return _qz(windows.gaps(seconds(spark, d), "bar_us", "mid", 120_000_000), "jump_bps")


def win22_drawdown(spark, d):
    step = F.coalesce(F.col("close") / F.lag("close").over(windows.by_bar()) - 1, F.lit(0.0))
    rows = windows.drawdown(five(spark, d).withColumn("step", quantized(step, 7)), S, ["bar_us"], "step")
    return _qz(rows.groupBy(*S).agg(F.max("drawdown").alias("max_drawdown"), F.max("peak").alias("peak")), "max_drawdown", "peak", digits=5)


def win23_spacing(spark, d):
    return windows.spacing(seconds(spark, d), "bar_us")


def win24_first_edges(spark, d):
    rows = windows.bar_trend(five(spark, d), 3600).withColumn("side", windows.breakout("close", "prior_high", "prior_low", 1.0))
    return windows.first_edges(rows.select(*S, "bar_us", "side"), "bar_us", "side")


def sim09_cooldown(spark, d):
    return folds.cooldown(win08_episode_starts(spark, d), S, "bar_us", ["bar_us"], 900_000_000)


def sim01_outcomes(spark, d):
    rows = outcomes.outcomes(seconds(spark, d), 30)
    return _qz(rows, *[c for c in rows.columns if c.endswith(("_bps", "_s"))])


def sim02_bar_outcomes(spark, d):
    return _qz(outcomes.bar_outcomes(five(spark, d), FIVE, 2), "long_net_bps", "short_net_bps", "mfe_bps")


def sim08_backtest(spark, d):
    """A single-position backtest of the episode starts of each series."""
    intents = sim09_cooldown(spark, d).select(*S, (F.col("bar_us") + 1_000_000).alias("us"), "side", F.lit(0.5).alias("stop"), F.lit(1.0).alias("target"))
    return _qz(folds.backtest(quotes(spark, d), intents, S), "net_bps")


def _news(spark, d):
    rows = load(spark, d, "news_events").where("occurred_at is not null and instrument is not null").select("event_key", "instrument", us("occurred_at").alias("t"), us("received_at").alias("received"), "reaction_eligible", "headline")
    kept = upsert.collapse(rows, ["event_key"], "received", "t").select("event_key")
    first = rows.groupBy("event_key").agg(F.min(F.struct("received", "t", "instrument", "reaction_eligible", "headline")).alias("m")).select("event_key", "m.*")
    return first.join(kept, "event_key", "left_semi")


def _by_instrument(spark, d):
    """One quote per instrument and instant: the greatest id."""
    q = quotes(spark, d).groupBy("instrument", "us").agg(F.max(F.struct("id", "mid")).alias("m"))
    return q.select("instrument", "us", "m.id", "m.mid")


def join16_earliest(spark, d):
    return _news(spark, d).select("event_key", "received", "t")


def join04_asof_backward(spark, d):
    return asof.asof(_news(spark, d).select("event_key", "instrument", "t"), _by_instrument(spark, d), ["instrument"], "t", "us", ["id", "mid"])


def join05_asof_forward(spark, d):
    return asof.asof(_news(spark, d).select("event_key", "instrument", "t"), _by_instrument(spark, d), ["instrument"], "t", "us", ["id", "mid"], direction="forward", tolerance_us=60_000_000)


def join18_reactions(spark, d):
    """Mid before each eligible event and after five delays, and the move between them."""
    q = _by_instrument(spark, d)
    events = _news(spark, d).where("reaction_eligible").select("event_key", "instrument", "t")
    before = asof.asof(events, q, ["instrument"], "t", "us", ["mid"], tolerance_us=60_000_000, prefix="before_")
    spread = before.withColumn("window_s", F.explode(F.array(*[F.lit(w) for w in (5, 30, 60, 300, 900)]))).withColumn("target", F.col("t") + F.col("window_s") * 1_000_000)
    after = asof.asof(spread, q, ["instrument"], "target", "us", ["mid"], direction="forward", tolerance_us=60_000_000, prefix="after_")
    rows = after.where("before_mid is not null and after_mid is not null")
    return rows.select("event_key", "window_s", "before_t", "after_t", quantized((F.col("after_mid") / F.col("before_mid") - 1) * 10_000).alias("return_bps"))


def join13_path_extrema(spark, d):
    """Extremes of the quotes within a minute after each event."""
    spans = _news(spark, d).select("event_key", "instrument", F.col("t").alias("a"), (F.col("t") + MINUTE).alias("b"))
    got = asof.between(quotes(spark, d).select("instrument", "us", "bid", "ask"), spans, ["instrument"], "us", "a", "b", width_us=5 * MINUTE)
    return got.groupBy("event_key").agg(F.count(F.lit(1)).alias("n"), F.max("bid").alias("high_bid"), F.min("ask").alias("low_ask"))


def join19_near_news(spark, d):
    """Episode starts within the half hour before or the quarter after an event of their instrument."""
    spans = _news(spark, d).select("instrument", (F.col("t") - 15 * MINUTE).alias("a"), (F.col("t") + 30 * MINUTE).alias("b"))
    return asof.between(win08_episode_starts(spark, d), spans, ["instrument"], "bar_us", "a", "b", how="left_semi").select(*S, "bar_us", "side")


def join20_overlaps(spark, d):
    """Gaps and news windows of one instrument that overlap."""
    gaps = windows.gaps(seconds(spark, d), "bar_us", "mid", 120_000_000).select(*S, "gap_start_us", "gap_end_us")
    spans = _news(spark, d).select("event_key", "instrument", F.col("t").alias("a"), (F.col("t") + 15 * MINUTE).alias("b"))
    return asof.overlaps(gaps, spans, ["instrument"], ("gap_start_us", "gap_end_us"), ("a", "b")).select("source", "instrument", "gap_start_us", "event_key")


def join22_missing_bars(spark, d):
    """Five-minute periods without a bar between a series' first and last of a day."""
    day = F.floor(F.col("bar_us") / 86_400_000_000).cast("long")
    have = five(spark, d).select(*S, "bar_us")
    spans = have.groupBy(*S, day.alias("day")).agg(F.min("bar_us").alias("a"), F.max("bar_us").alias("b"))
    wanted = spans.select(*S, F.explode(F.sequence("a", "b", F.lit(FIVE).cast("long"))).alias("bar_us"))
    return wanted.join(have, [*S, "bar_us"], "left_anti")


def agg34_feed_report(spark, d):
    """Per source: quotes, spreads at three quantiles, and the longest silence."""
    q = quotes(spark, d)
    rows = quantiles_of(q, ["source"], "spread_bps", {"p50": 0.5, "p95": 0.95, "p99": 0.99}).select("source", F.col("_n").alias("n"), *[quantized(c).alias(c) for c in ("p50", "p95", "p99")])
    silent = windows.previous_age(q.select(*S, "us").distinct(), "us").groupBy("source").agg(F.max("age_s").alias("longest_gap_s"))
    return rows.join(silent, "source")


def agg36_news_quality(spark, d):
    return load(spark, d, "news_events").groupBy("event_type", "timing_quality").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_key").alias("keys"), F.count(F.when(F.col("instrument").isNull(), 1)).alias("without_instrument"))


def prj02_sessions(spark, d):
    return quotes(spark, d).groupBy(classify.session_of("us").alias("session"), classify.level_of("spread_bps", 1.0, 3.0).alias("spread_level")).agg(F.count(F.lit(1)).alias("n"))


def prj19_relevance(spark, d):
    rows = classify.relevance(load(spark, d, "news_events").select("event_key", "headline").distinct(), "headline")
    return rows.select("event_key", F.array_join("reasons", ",").alias("reasons"), "score")


def prj26_quality_issues(spark, d):
    rows = quotes(spark, d).join(load(spark, d, "market_ticks").select("id", "source_sequence"), "id")
    return classify.quality_issues(rows, S, "us", "spread_bps", "source_sequence", 20.0, 300_000_000)


def prj26_arrival_issues(spark, d):
    """All four rules of tick quality in order of arrival."""
    rows = bars.quotes(load(spark, d, "market_ticks"), "source_sequence")
    return classify.arrival_issues(rows, S, "us", "spread_bps", "source_sequence", 20.0, 300_000_000)


def breakout_report(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: breakout episodes by instrument and side, with the outcome half a minute later."""
    bars_ = written(seconds(spark, d))
    starts = _starts(bars_)
    labels = outcomes.outcomes(bars_, 30).select(*S, "bar_us", "valid", "long_net_bps", "short_net_bps")
    rows = starts.join(labels, [*S, "bar_us"]).withColumn("net", F.when(F.col("side") > 0, F.col("long_net_bps")).otherwise(F.col("short_net_bps")))
    return rows.groupBy("instrument", "side").agg(F.count(F.lit(1)).alias("episodes"), F.count("net").alias("valid"), quantized(F.avg("net"), 4).alias("mean_net_bps"))


NAMES = (
    agg01_second_bars, agg02_five_minute_bars, agg04_completed_bars, win01_second_features, win03_prior_levels, win04_reset_average, win05_session_range, win06_bar_trend, win07_segments, win08_episode_starts,
    win10_ema, win11_atr, win13_fair_value_gaps, win14_contiguous, win17_shocks, win18_failed_moves, win19_sweeps, win21_gaps, win22_drawdown, win23_spacing, win24_first_edges, sim09_cooldown, sim01_outcomes, sim02_bar_outcomes, sim08_backtest,
    join16_earliest, join04_asof_backward, join05_asof_forward, join18_reactions, join13_path_extrema, join19_near_news, join20_overlaps, join22_missing_bars, agg34_feed_report, agg36_news_quality, prj02_sessions, prj19_relevance, prj26_quality_issues, prj26_arrival_issues, breakout_report,
)
QUERIES = {f.__name__: f for f in NAMES}
