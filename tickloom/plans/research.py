"""Queries of rules, reports and selections over quotes, news and trades, with their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators import asof, bars, folds, metrics, outcomes, research, windows
from tickloom.operators.metrics import quantized
from tickloom.operators.quantiles import quantiles_of
from tickloom.plans import labs, market, trades
from tickloom.plans.labs_sql import _COIN, FEATURES, KEPT, _out, summary
from tickloom.plans.market import FIVE, S, five, quotes, seconds
from tickloom.plans.market_sql import _STATE, B5, S1, Q, W, qz
from tickloom.plans.trades import DAY, T, _daily
from tickloom.session import load, us, written

SECOND = 1_000_000


def _q(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: quantized(c, digits) for c in columns})


def prj03_market_open(spark, d):
    """Quotes of each instrument in and out of the weekly schedule."""
    return quotes(spark, d).groupBy("instrument", research.market_open("us").alias("open")).agg(F.count(F.lit(1)).alias("n"))


def prj08_range_width(spark, d):
    """Width in basis points of the trailing five-minute range at each active second."""
    rows = windows.prior_levels(seconds(spark, d).select(*S, "bar_us", "mid"), "bar_us", "mid", (300,))
    return rows.select(*S, "bar_us", quantized((F.col("prior_high_300s") - F.col("prior_low_300s")) / F.col("mid") * 10_000).alias("range_bps"))


def prj22_point_features(spark, d):
    """Return, volatility, momentum and regime of each series' closes within a day."""
    day = F.floor(F.col("bar_us") / DAY).cast("long").alias("day")
    # at most the 288 bars of a day
    days = five(spark, d).groupBy(*S, day).agg(F.transform(F.array_sort(F.collect_list(F.struct("bar_us", "close"))), lambda x: x["close"]).alias("p"))
    rows = days.select(*S, "day", *research.point_features("p")).withColumn("g", research.regime("volatility", "momentum"))
    return _q(rows.where("total_return is not null").select(*S, "day", "total_return", "volatility", "momentum", "g.regime", "g.confidence"), 9, "total_return", "volatility", "momentum", "confidence")


def prj16_path_labels(spark, d):
    """What the half minute after each breakout was, and how it ended on average, against a random side."""
    b = written(seconds(spark, d))
    labels = outcomes.outcomes(b, 30, labs.LOOSE).where("valid")
    spread = b.select(*S, "bar_us", ((F.col("ask") - F.col("bid")) / F.col("mid") * 10_000).alias("spread_bps"))
    pick = lambda c: F.when(F.col("side") > 0, F.col(f"long_{c}_bps")).otherwise(F.col(f"short_{c}_bps")).alias(c)
    iso = F.date_format(F.timestamp_micros("bar_us"), "yyyy-MM-dd'T'HH:mm:ss")
    coin = F.conv(F.substring(F.sha2(F.concat(iso, F.lit("+00:00")), 256), 1, 2), 16, 10).cast("int") % 2 == 1
    rows = market._starts(b).join(labels, [*S, "bar_us"]).join(spread, [*S, "bar_us"]).select(*[pick(c) for c in ("net", "mfe", "mae")], "spread_bps", F.when(coin, F.col("long_net_bps")).otherwise(F.col("short_net_bps")).alias("random_net"))
    rows = rows.withColumn("label", research.path_label("net", "mfe", "mae", "spread_bps"))
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), quantized(F.avg("net"), 4).alias("mean_net"), quantized(F.avg("random_net"), 4).alias("mean_random"))


def prj17_invalid_paths(spark, d):
    """Why the path of two bars after each five-minute bar isn't whole."""
    rows = research.invalid_reasons(five(spark, d), FIVE, 2, F.col("tick_count") < 2)
    return rows.groupBy("instrument", "reason").agg(F.count(F.lit(1)).alias("n"))


def prj27_pair_effects(spark, d):
    """A trade and the next one of its account, symbol and side as a pair: what another entry and another exit would have changed."""
    t = trades.trades(spark, d).withColumn("entry", F.col("volume") * 1000 + 900).withColumn("exit", F.col("entry") + F.col("net") / 10)
    nxt = F.lead(F.struct("ticket", "entry", "exit")).over(Window.partitionBy("account", "symbol", "side").orderBy("opened", "ticket", "net", "volume"))
    rows = t.withColumn("c", nxt).where("c is not null").select("symbol", "side", "entry", "exit", F.col("c.entry").alias("c_entry"), F.col("c.exit").alias("c_exit"))
    out = rows.select("symbol", *research.pair_effects("side", ("entry", "c_entry"), ("exit", "c_exit")))
    return out.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), *[quantized(F.avg(c), 3).alias(c) for c in ("provider_bps", "copied_entry_bps", "copied_exit_bps", "copied_bps", "adverse_entry_bps", "entry_effect_bps", "exit_effect_bps")])


def join11_live_entries(spark, d):
    """The freshest quote between each event and its receipt, if fresh enough then."""
    n = load(spark, d, "news_events").where("occurred_at is not null and instrument is not null and received_at is not null").select("event_key", "instrument", us("occurred_at").alias("at"), us("received_at").alias("seen")).distinct()
    q = quotes(spark, d).groupBy("instrument", "us").agg(F.max(F.struct("id", "bid", "ask")).alias("m")).select("instrument", "us", "m.bid", "m.ask")
    return research.live_entries(n, q, ["instrument"], 60 * SECOND, 3_600 * SECOND)


def join15_episode_rows(spark, d):
    """Features of the kept episodes joined to their labels by an id that is unique on both sides."""
    b = written(seconds(spark, d))
    starts = written(folds.cooldown(market._starts(b), S, "bar_us", ["bar_us"], 900 * SECOND).withColumn("episode", F.concat_ws("|", *S, "bar_us")))
    features = starts.join(windows.second_features(b).select(*S, "bar_us", "return_30s", "return_60s"), [*S, "bar_us"]).select("episode", "bar_us", "side", *research.signed("side", r30="return_30s", r60="return_60s"))
    labels = starts.join(outcomes.outcomes(b, 30, labs.LOOSE).where("valid"), [*S, "bar_us"]).select("episode", "bar_us", F.when(F.col("side") > 0, F.col("long_net_bps")).otherwise(F.col("short_net_bps")).alias("net"))
    return _q(research.checked_join(features, labels, "episode", "bar_us"), 8, "r30", "r60").withColumn("net", quantized("net", 4))


def join23_uninvalidated(spark, d):
    """Orders joined to their last shipment, without those that a return invalidates."""
    lines = load(spark, d, "lineitem")
    exits = lines.groupBy(F.col("l_orderkey").alias("signal")).agg(F.max("l_shipdate").alias("exit_at"))
    entries = load(spark, d, "orders").select(F.col("o_orderkey").alias("signal"), "o_orderdate", "o_orderpriority")
    kept = entries.join(exits, "signal").join(lines.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("signal")), "signal", "left_anti")
    return kept.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), quantized(F.avg((us("exit_at") - us("o_orderdate")) / DAY), 4).alias("mean_days"))


def _edges(rows: DataFrame) -> DataFrame:
    """Rising edges of the bar's direction: (SERIES, bar_us, side)."""
    w = Window.partitionBy(*S).orderBy("bar_us")
    side = F.signum(F.col("close") - F.col("open")).cast("int")
    return rows.withColumn("side", side).withColumn("_was", F.coalesce(F.lag("side").over(w), F.lit(0))).where("side <> 0 and side <> _was").select(*S, "bar_us", "side")


def _live_bars(spark, d) -> DataFrame:
    """Five-minute bars of the ticks that had arrived a minute after the bar's end."""
    t = load(spark, d, "market_ticks").where("received_at is not null")
    t = t.where(us("received_at") < (F.floor(us("occurred_at") / FIVE) + 1) * FIVE + 60 * SECOND)
    return bars.time_bars(bars.quotes(t))


def join24_attribution(spark, d):
    """Signals of live bars against those of all ticks: matched, with another side, or not in the canonical ones."""
    live, canonical = _edges(_live_bars(spark, d)), _edges(five(spark, d)).withColumnRenamed("side", "c_side")
    rows = live.join(canonical, [*S, "bar_us"], "left")
    kind = F.when(F.col("c_side").isNull(), "not_canonical").when(F.col("c_side") == F.col("side"), "matched").otherwise("other_side")
    return rows.groupBy("source", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def join25_enriched(spark, d):
    """Live signals with what the canonical one of their bar and side was worth two bars on."""
    worth = outcomes.bar_outcomes(five(spark, d), FIVE, 2).where("valid")
    sides = F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col("long_net_bps").alias("net")), F.struct(F.lit(-1).alias("side"), F.col("short_net_bps").alias("net")))).alias("s")
    by = worth.select(*S, "bar_us", sides).select(*S, "bar_us", "s.side", "s.net")
    return _edges(_live_bars(spark, d)).join(by, [*S, "bar_us", "side"]).select(*S, "bar_us", "side", quantized("net", 4).alias("net"))


def join28_state_bars(spark, d):
    """Live bars against those of all ticks: equal, different, missing."""
    live = _live_bars(spark, d).select(*S, "bar_us", F.struct("open", "high", "low", "close").alias("live"))
    rows = five(spark, d).select(*S, "bar_us", F.struct("open", "high", "low", "close").alias("whole")).join(live, [*S, "bar_us"], "left")
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("bars"), F.count(F.when(F.col("live").isNull(), 1)).alias("missing"), F.count(F.when(F.col("live") != F.col("whole"), 1)).alias("different"))


def str11_parity(spark, d):
    """Bars merged from two halves of the arrivals against those of all at once, both ways: nothing may be left."""
    t = load(spark, d, "market_ticks")
    half = bars.quotes(t)
    part = lambda cond: half.where(cond).withColumn("bar_us", bars.bucket("us", FIVE)).groupBy(*S, "bar_us").agg(F.min(F.struct("us", "id", "mid")).alias("f"), F.max(F.struct("us", "id", "mid")).alias("l"), F.max("mid").alias("high"), F.min("mid").alias("low"), F.count(F.lit(1)).alias("n"))
    merged = part("id % 2 = 0").unionByName(part("id % 2 = 1")).groupBy(*S, "bar_us").agg(F.min("f").alias("f"), F.max("l").alias("l"), F.max("high").alias("high"), F.min("low").alias("low"), F.sum("n").alias("tick_count"))
    merged = merged.select(*S, "bar_us", F.col("f.mid").alias("open"), "high", "low", F.col("l.mid").alias("close"), "tick_count")
    whole = bars.time_bars(half).select(merged.columns)
    n = lambda df: df.agg(F.count(F.lit(1)))
    return n(whole).select(F.col("count(1)").alias("bars"), n(whole.exceptAll(merged)).scalar().alias("batch_only"), n(merged.exceptAll(whole)).scalar().alias("merged_only"))


def agg02_decision_bars(spark, d):
    """Five-minute bars of seconds with sums, the longest silence within, and whether the first and last half minute have quotes."""
    s = windows.previous_age(seconds(spark, d), "bar_us").withColumn("period", bars.bucket("bar_us", FIVE))
    inside = F.when(F.col("bar_us") - F.col("age_s") * SECOND >= F.col("period"), F.col("age_s"))
    out = s.groupBy(*S, "period").agg(F.count(F.lit(1)).alias("seconds"), F.sum("tick_count").alias("ticks"), F.sum("quote_change_count").alias("changes"), F.max(inside).alias("longest_silence_s"), F.min("bar_us").alias("a"), F.max("bar_us").alias("z"))
    return out.select(*S, F.col("period").alias("bar_us"), "seconds", "ticks", "changes", "longest_silence_s", ((F.col("a") < F.col("period") + 30 * SECOND) & (F.col("z") >= F.col("period") + 270 * SECOND)).alias("complete"))


def agg06_intervals(spark, d):
    """Mean result by symbol and side with its normal interval and the worst drawdown in order of closing."""
    t = trades.trades(spark, d).withColumn("net", quantized("net", 4))
    keys = ["symbol", "side"]
    fall = windows.drawdown(t, keys, ["closed", "ticket", "net"], "net").groupBy(*keys).agg(F.max("drawdown").alias("drawdown"))
    return _q(t.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *research.interval("net")).join(fall, keys), 4, "mean", "low", "high", "drawdown")


def agg12_fold_medians(spark, d):
    """Medians of the training part of each walk-forward fold, per symbol."""
    rows = _in_folds(spark, trades.trades(spark, d), "opened", "train_start", "train_end")
    v = quantiles_of(rows, ["fold", "symbol"], "volume", {"volume": 0.5}).drop("_n")
    n = quantiles_of(rows, ["fold", "symbol"], "net", {"net": 0.5}).withColumnRenamed("_n", "n")
    return v.join(n, ["fold", "symbol"]).select("fold", "symbol", "n", "volume", quantized("net", 4).alias("net"))


def _in_folds(spark, rows: DataFrame, t: str, start: str, end: str) -> DataFrame:
    """rows once for each fold of 1994 to 1998 whose part holds them: a range join to a table of a dozen rows."""
    from datetime import datetime

    f = metrics.folds(spark, datetime(1994, 1, 1), datetime(1998, 1, 1), metrics.WalkForward(365, 60, 90, 90)).select("fold", us(start).alias("_a"), (us(end) - 1).alias("_z"), F.lit(1).alias("_one"))
    return asof.between(rows.withColumn("_one", F.lit(1)), f, ["_one"], t, "_a", "_z", width_us=90 * DAY).drop("_one", "_a", "_z")


def agg11_fold_thresholds(spark, d):
    """Robust thresholds of each fold's training trades that open on the first day of a week."""
    # the sample is the operator's own: a deterministic share of the training part
    rows = _in_folds(spark, trades.trades(spark, d).where((F.col("opened") / DAY).cast("long") % 7 == 0), "opened", "train_start", "train_end").withColumn("size", F.round("net").cast("long").cast("double"))
    got = metrics.robust_threshold(rows, ["fold"], "size")
    return _q(got, 6, "median", "mad", "threshold")


def agg18_family_low(spark, d):
    """Lower bounds of each symbol's mean yearly result among ten hypotheses."""
    yearly = trades.trades(spark, d).groupBy("symbol", F.year(F.timestamp_micros("closed")).alias("y")).agg(F.sum("net").alias("v"))
    return _q(yearly.groupBy("symbol").agg(F.count(F.lit(1)).alias("years"), *research.family_low("v", 10)), 1, "low_normal", "low_log")


def agg19_shares(spark, d):
    """Shares of the best days and month in each symbol's positive total, and the totals without them."""
    daily = _daily(spark, d).withColumn("day_us", F.col("day") * DAY)
    rows = research.shares(daily, ["symbol"], "day_us", "net")
    return _q(_q(rows, 6, "best_day_share", "top5_share", "best_month_share"), 2, "without_best_day", "without_top5", "without_best_month")


def agg20_cost_levels(spark, d):
    """Results of each symbol at one, one and a half and two times their cost."""
    rows = load(spark, d, "lineitem").select((F.col("l_partkey") % 10).alias("symbol"), (F.col("l_extendedprice") * F.col("l_discount")).alias("gross"), (F.col("l_extendedprice") * 0.03).alias("cost"))
    out = rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), *research.cost_levels("gross", "cost"))
    mid = quantiles_of(rows.select("symbol", (F.col("gross") - F.col("cost")).alias("v")), ["symbol"], "v", {"median_base": 0.5}).drop("_n")
    return _q(out.join(mid, "symbol"), 3, *[c for c in out.columns if c not in ("symbol", "n")], "median_base")


def agg21_effective_size(spark, d):
    """Autocorrelation of daily results at lags one to ten as an effective number of days."""
    daily = _daily(spark, d)
    r = metrics.autocorrelation(daily, ["symbol"], ["day"], "net", 10)
    return _q(research.effective_size(r, daily.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")), ["symbol"]), 3, "effective")


def agg23_rollover_hours(spark, d):
    """For each hour of the day the trades open across it and their mean result."""
    t = trades.trades(spark, d).select("opened", (F.col("opened") + (F.col("ticket") % 37) * 3_600 * SECOND).alias("ended"), "net", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    return t.where(research.crosses_hour("opened", "ended", F.col("hour"))).groupBy("hour").agg(F.count(F.lit(1)).alias("n"), quantized(F.avg("net"), 3).alias("mean"))


def agg26_selected(spark, d):
    """Of the volumes with fifty trades the one with the best mean, per symbol."""
    per = trades.trades(spark, d).groupBy("symbol", "volume").agg(F.count(F.lit(1)).alias("n"), quantized(F.avg("net"), 3).alias("mean"))
    return research.select_best(per, ["symbol"], "volume", "mean", "n", 50)


def agg30_cash_drawdown(spark, d):
    """Closed-balance drawdown of each account, its deposits put in at each order."""
    t = trades.trades(spark, d).withColumn("net", quantized("net", 4))
    cash = load(spark, d, "orders").select(F.col("o_custkey").alias("account"), us("o_orderdate").alias("us"), F.col("o_orderkey").alias("ticket"), (F.col("o_totalprice") / 10).alias("amount"))
    got = research.balance_drawdown(t.select("account", F.col("closed").alias("us"), "ticket", "net"), cash, ["account"])
    return _q(got, 4, "drawdown", "drawdown_pct", "balance")


def agg31_episode_audit(spark, d):
    """Merged spans of each symbol: how many, trades a span, the longest, and how many volumes were open at once."""
    t = trades.trades(spark, d)
    spans = metrics.merge_spans(t, ["account", "symbol", "side"], "opened", "closed", ["ticket"]).groupBy("account", "symbol", "side", "span").agg(F.count(F.lit(1)).alias("tickets"), (F.max("closed") - F.min("opened")).alias("length"))
    out = spans.groupBy("symbol").agg(F.count(F.lit(1)).alias("spans"), quantized(F.avg("tickets"), 4).alias("mean_tickets"), F.max("tickets").alias("most_tickets"), F.max("length").alias("longest_us"))
    return out.join(metrics.concurrency(t, ["symbol"], "opened", "closed", "volume"), "symbol")


def agg32_provider_paths(spark, d):
    """Excursions of all trades as a report: median, a low order statistic, worst, quick exits and runners."""
    rows = trades.trades(spark, d).select((F.col("net") / F.col("volume")).alias("mae_bps"), ((F.col("closed") - F.col("opened")) / DAY * 30).alias("holding_s"))
    return _q(research.provider_paths(rows), 4, "worst", "quick_ratio", "runner_ratio", "median", "low")


def agg33_adversity(spark, d):
    """Trades added while another is open, and those of them at a worse price, per account."""
    t = trades.trades(spark, d).withColumn("price", F.col("volume") * 1000 + F.col("ticket") % 100)
    return research.added_into_adversity(t, ["account", "symbol", "side"]).groupBy("account").agg(F.sum("additions").alias("additions"), F.sum("adverse").alias("adverse"))


def agg35_readiness(spark, d):
    """Recorded sessions of each server: ticks, hours, rates, and whether there are enough."""
    r = load(spark, d, "market_ticks").where("occurred_at is not null and bid > 0 and ask >= bid and source is not null").select("source", us("occurred_at").alias("t"), "batch_id")
    per = r.groupBy("source", "batch_id").agg(F.count(F.lit(1)).alias("ticks"), ((F.max("t") - F.min("t")) / 3.6e9).alias("hours"))
    out = per.groupBy("source").agg(F.sum("ticks").alias("ticks"), F.sum("hours").alias("hours"), F.count(F.when(F.col("ticks") > 1, 1)).alias("active"))
    status = F.when((F.col("hours") >= 40) & (F.col("active") >= 2), "ready").when(F.col("hours") >= 20, "checkpoint").otherwise("collecting")
    return out.select("source", "ticks", quantized("hours", 4).alias("hours"), "active", quantized(F.col("ticks") / F.nullif(F.col("hours") * 60, F.lit(0.0)), 4).alias("per_minute"), status.alias("status"))


def agg40_backtest_metrics(spark, d):
    """Equity, drawdown, win rate, profit factor and expectancy of the backtest of each series from 10,000."""
    t = market.sim08_backtest(spark, d).withColumn("pnl", F.col("net_bps") / 10)
    rows = written(windows.drawdown(t, S, ["opened_us"], "pnl"))
    pct = F.max(F.col("drawdown") / (10_000 + F.col("peak")) * 100)
    out = rows.groupBy(*S).agg(*metrics.ledger("pnl"), F.sum("pnl").alias("pnl"), pct.alias("drawdown_pct"))
    return out.select(*S, "n", quantized(F.col("pnl") + 10_000, 3).alias("equity"), quantized("drawdown_pct", 5).alias("drawdown_pct"), quantized("win_rate", 5).alias("win_rate"), quantized("profit_factor", 4).alias("profit_factor"), quantized("mean", 4).alias("expectancy"), quantized(F.col("pnl") / 100 / F.nullif(F.col("drawdown_pct"), F.lit(0.0)), 3).alias("return_over_drawdown"))


def agg41_virtual_ledger(spark, d):
    """Opportunities of each window: executed ones, those left, and what they made; an id counts once."""
    r = load(spark, d, "reaction_measurements").groupBy("measurement_id").agg(F.min(F.struct("window_seconds", "return_bps")).alias("m")).select("m.*")
    done = F.col("return_bps").isNotNull()
    return r.groupBy("window_seconds").agg(F.count(F.lit(1)).alias("opportunities"), F.count(F.when(done, 1)).alias("executed"), quantized(F.sum("return_bps"), 3).alias("total"), quantized(F.avg(F.when(done, (F.col("return_bps") > 0).cast("double"))), 5).alias("win_rate"))


def agg43_causal_summary(spark, d):
    """Episode starts of each instrument: how many, their mean spread, and the share of long ones."""
    b = written(seconds(spark, d))
    rows = market._starts(b).join(b.select(*S, "bar_us", ((F.col("ask") - F.col("bid")) / F.col("mid") * 10_000).alias("spread")), [*S, "bar_us"])
    return _q(rows.groupBy("instrument").agg(F.count(F.lit(1)).alias("n"), F.avg("spread").alias("mean_spread"), F.avg((F.col("side") == 1).cast("double")).alias("long_share")), 5, "mean_spread", "long_share")


def win26_overlaps(spark, d):
    """Episode starts held for a quarter of an hour: those taken one at a time, those passed over, and the most that would have been open at once."""
    rows = written(market.win08_episode_starts(spark, d).withColumn("until", F.col("bar_us") + 900 * SECOND).withColumn("one", F.lit(1.0)))
    taken = folds.without_overlap(rows, S, "bar_us", "until", ["bar_us"]).groupBy(*S).agg(F.count(F.lit(1)).alias("accepted"))
    out = rows.groupBy(*S).agg(F.count(F.lit(1)).alias("n")).join(taken, S).join(metrics.concurrency(rows, S, "bar_us", "until", "one"), S)
    return out.select(*S, "accepted", (F.col("n") - F.col("accepted")).alias("rejected"), F.col("max_tickets").alias("concurrent"))


def win25_session_policies(spark, d):
    """Four policies on breakouts of the five-minute range, once per policy and day."""
    b = written(seconds(spark, d))
    rows = windows.prior_levels(b.select(*S, "bar_us", "mid"), "bar_us", "mid", (300,)).withColumn("side", windows.breakout("mid", "prior_high_300s", "prior_low_300s", 1.0))
    f = windows.second_features(b).select(*S, "bar_us", "return_5s", "tick_intensity_ratio")
    got = research.session_policies(rows.join(f, [*S, "bar_us"]).withColumn("day", F.floor(F.col("bar_us") / DAY).cast("long")), "side")
    return got.groupBy(*S, "day", "policy").agg(F.min(F.struct("bar_us", "direction")).alias("m")).select(*S, "day", "policy", "m.bar_us", "m.direction")


def lab05_session_strategies(spark, d):
    """The session policies' first trades of a day, by policy."""
    labels = outcomes.outcomes(seconds(spark, d), 30, labs.LOOSE).where("valid").select(*S, "bar_us", "long_net_bps", "short_net_bps")
    rows = win25_session_policies(spark, d).join(labels, [*S, "bar_us"]).withColumn("net", F.when(F.col("direction") > 0, F.col("long_net_bps")).otherwise(F.col("short_net_bps")))
    return labs._metrics(rows, ["policy"], "net")


def set06_dedupe(spark, d):
    """The four policies of repeats, each on its own table: how many stay, and a sum of their ids."""
    e = load(spark, d, "event_envelopes").where("trim(idempotency_key) <> ''").select(F.lower(F.trim("idempotency_key")).alias("k"), us("received_at").alias("r"), F.col("envelope_id").alias("id"))
    of = lambda name, pick: e.groupBy("k").agg(pick.alias("m")).agg(F.lit(name).alias("policy"), F.count(F.lit(1)).alias("n"), F.sum("m.id").alias("ids"))
    first, last = of("first", F.min(F.struct("id"))), of("last", F.max(F.struct("id")))
    earliest = of("earliest_received", F.min(F.struct(F.col("r").isNull().alias("late"), "r", "id")))
    seen = e.select(F.lit("skip_seen").alias("policy"), "k").distinct().groupBy("policy").agg(F.count(F.lit(1)).alias("n"), F.lit(0).cast("long").alias("ids"))
    return first.unionByName(last).unionByName(earliest).unionByName(seen)


def srt06_extremes(spark, d):
    """The first five-minute bar of each series and day with the highest high, and the first with the lowest low."""
    day = F.floor(F.col("bar_us") / DAY).cast("long").alias("day")
    return five(spark, d).groupBy(*S, day).agg(F.max(F.struct("high", (-F.col("bar_us")).alias("t"))).alias("h"), F.min(F.struct("low", F.col("bar_us").alias("t"))).alias("l")).select(*S, "day", (-F.col("h.t")).alias("high_at"), F.col("l.t").alias("low_at"))


_LIVE = """lv as materialized (select source, instrument, cast(floor(us / 300000000) as bigint) * 300000000 as bar_us, first(mid order by us, id) as open, max(mid) as high, min(mid) as low, last(mid order by us, id) as close from
  (select q.*, epoch_us(received_at) as r from q join market_ticks m using (id)) where r < (floor(us / 300000000) + 1) * 300000000 + 60000000 group by all)"""
_EDGE = lambda name, of: f"{name} as (select source, instrument, bar_us, side from (select *, coalesce(lag(side) over ({W}), 0) as was from (select *, cast(sign(close - open) as integer) as side from {of})) where side <> 0 and side <> was)"
_DD = f"{T}, daily as (select symbol, cast(floor(closed / {DAY}) as bigint) as day, {qz('sum(net)', 4)} as net from trades group by all)"
_FOLD = """fo as (select k + 1 as fold, epoch_us(timestamp '1994-01-01') as a, epoch_us(timestamp '1994-01-01') + (365 + 90 * k) * 86400000000 as z from range(0, 40) r(k)
  where epoch_us(timestamp '1994-01-01') + (365 + 90 * k) * 86400000000 + 60000000 + 60 * 86400000000 + 120000000 + 90 * 86400000000 <= epoch_us(timestamp '1998-01-01'))"""
_COSTS = ", ".join(f"{qz(f'avg(gross - {k} * cost)', 3)} as mean_{n}, {qz(f'sum(case when gross - {k} * cost > 0 then gross - {k} * cost else 0 end) / nullif(sum(case when gross - {k} * cost < 0 then {k} * cost - gross else 0 end), 0)', 3)} as factor_{n}" for n, k in (("base", 1.0), ("cost_1_5x", 1.5), ("cost_2x", 2.0)))
_POLICIES = f"""ps as (select source, instrument, bar_us, mid, max(mid) over r as hi, min(mid) over r as lo from s window r as ({W} range between 300000000 preceding and 1 preceding)),
pd as (select ps.*, case when (mid / hi - 1) * 10000 >= 1 then 1 when (lo / mid - 1) * 10000 >= 1 then -1 else 0 end as side, cast(floor(bar_us / {DAY}) as bigint) as day from ps),
pf as (select pd.*, fe.r5, fe.intensity, coalesce(lag(side) over (partition by source, instrument, day order by bar_us), 0) as was from pd join fe using (source, instrument, bar_us)),
pa as (select *, max(case when side <> 0 and was = 0 then bar_us end) over (partition by source, instrument, day order by bar_us rows unbounded preceding) as at_ from pf),
pl as (select source, instrument, day, bar_us, 'immediate_breakout' as policy, side as direction from pa where side <> 0 and was = 0
  union all select source, instrument, day, bar_us, 'momentum_confirmed', side from pa where side <> 0 and was = 0 and r5 * side > 0 union all select source, instrument, day, bar_us, 'activity_confirmed', side from pa where side <> 0 and was = 0 and r5 * side > 0 and intensity >= 1.5
  union all select source, instrument, day, bar_us, 'false_breakout_fade', -was from pa where side = 0 and was <> 0 and bar_us - at_ <= 300000000),
po as materialized (select source, instrument, day, policy, min(bar_us) as bar_us, arg_min(direction, bar_us) as direction from pl group by source, instrument, day, policy)"""


def _full_out(h: int) -> str:
    """v: outcomes at a horizon under the wider limits with excursions."""
    return f"""{_out(h, 30, 30, 60)}, w{h} as (select d.source, d.instrument, d.bar_us, max(d.eb) as eb, max(d.ea) as ea, max(greatest(y.open_bid)) as bh, min(y.open_bid) as bl, max(y.open_ask) as ah, min(y.open_ask) as al
  from d{h} d join v{h} using (source, instrument, bar_us) join s y on y.source = d.source and y.instrument = d.instrument and y.open_us between d.e_us and d.x_us group by all)"""


ORACLE = {
    "prj03_market_open": f"with {Q} select instrument, (us + {3 * DAY}) % {7 * DAY} < {4 * DAY + 79_200_000_000} or (us + {3 * DAY}) % {7 * DAY} >= {6 * DAY + 79_200_000_000} as open, count(*) as n from q group by all",
    "prj08_range_width": f"with {S1} select source, instrument, bar_us, {qz('(max(mid) over r - min(mid) over r) / mid * 10000')} as range_bps from s window r as ({W} range between 300000000 preceding and 1 preceding)",
    "prj22_point_features": f"""with {B5}, x as (select *, cast(floor(bar_us / {DAY}) as bigint) as day from b), y as (select *, close / lag(close) over (partition by source, instrument, day order by bar_us) - 1 as r from x),
g as (select source, instrument, day, last(close order by bar_us) / first(close order by bar_us) - 1 as t, sqrt(avg(r * r)) as v, sum(r) as m from y group by all having count(*) >= 2)
select source, instrument, day, {qz('t', 9)} as total_return, {qz('v', 9)} as volatility, {qz('m', 9)} as momentum, case when v > 0.002 then 'high_volatility' when abs(m) > 0.001 then 'directional' else 'range' end as regime, {qz('case when v > 0.002 then least(0.99, 0.6 + v * 20) when abs(m) > 0.001 then least(0.95, 0.6 + abs(m) * 30) else 0.7 end', 9)} as confidence from g""",
    "prj16_path_labels": f"""with {_STATE}, {_full_out(30)}, r as (select case when side > 0 then long_net else short_net end as net, case when {_COIN} > 0 then long_net else short_net end as rnd, case when side > 0 then (bh / ea - 1) * 10000 else (eb / al - 1) * 10000 end as mfe, case when side > 0 then (bl / ea - 1) * 10000 else (eb / ah - 1) * 10000 end as mae,
  (s.ask - s.bid) / s.mid * 10000 as sp from e join v30 using (source, instrument, bar_us) join w30 using (source, instrument, bar_us) join s using (source, instrument, bar_us)),
k as (select *, case when net > 0 and mae < -greatest(sp, 1.0) then 'retest_compatible_continuation' when net <= 0 and mfe > 0 then 'sweep_failure' when net > 0 and mfe > abs(mae) then 'continuation' else 'indeterminate' end as label from r)
select label, count(*) as n, {qz('avg(net)', 4)} as mean_net, {qz('avg(rnd)', 4)} as mean_random from k group by label""",
    "prj17_invalid_paths": f"""with {B5}, r as (select *, case when tick_count < 2 then 'flagged_gap' when bar_us - lag(bar_us) over w <> 300000000 then 'missing_bar' end as r from b window w as ({W})),
p as (select instrument, count(*) over f as ahead, lead(r, 1) over ({W}) as a, lead(r, 2) over ({W}) as b, lead(r, 3) over ({W}) as c from r window f as ({W} rows between 1 following and 3 following))
select instrument, case when ahead = 0 then 'entry_unavailable' when ahead <= 2 then 'exit_beyond_data' else coalesce(a, b, c) end as reason, count(*) as n from p group by all""",
    "prj27_pair_effects": f"""with {T}, p as (select *, volume * 1000 + 900 as entry, volume * 1000 + 900 + net / 10 as exit from trades), c as (select *, lead(entry) over w as ce, lead(exit) over w as cx, lead(ticket) over w as ct from p window w as (partition by account, symbol, side order by opened, ticket, net, volume)),
r as (select symbol, side * (exit - entry) / entry * 10000 as own, side * (exit - ce) / ce * 10000 as mix, side * (cx - entry) / entry * 10000 as other, side * (cx - ce) / ce * 10000 as cop, side * (ce - entry) / entry * 10000 as adv from c where ct is not null)
select symbol, count(*) as n, {qz('avg(own)', 3)} as provider_bps, {qz('avg(mix)', 3)} as copied_entry_bps, {qz('avg(other)', 3)} as copied_exit_bps, {qz('avg(cop)', 3)} as copied_bps, {qz('avg(adv)', 3)} as adverse_entry_bps, {qz('avg(mix - own)', 3)} as entry_effect_bps, {qz('avg(cop - mix)', 3)} as exit_effect_bps from r group by symbol""",
    "join11_live_entries": f"""with {Q}, u as (select instrument, us, arg_max(bid, id) as bid, arg_max(ask, id) as ask from q group by all), n as (select distinct event_key, instrument, epoch_us(occurred_at) as at_, epoch_us(received_at) as seen from news_events where occurred_at is not null and instrument is not null and received_at is not null),
j as (select n.*, u.us, u.bid, u.ask, seen - at_ <= 3600000000 and u.us >= at_ and seen - u.us <= 60000000 as ok from n asof left join u on n.instrument = u.instrument and n.seen >= u.us)
select event_key, instrument, at_ as at, seen, case when ok then us end as q_t, case when ok then bid end as q_bid, case when ok then ask end as q_ask from j""",
    "join15_episode_rows": f"""with recursive {KEPT}, {FEATURES}, {_out(30, 30, 30, 60)} select concat_ws('|', ep.source, ep.instrument, cast(fe.bar_us as varchar)) as episode, fe.bar_us, side, {qz('r30 * side', 8)} as r30, {qz('r60 * side', 8)} as r60, {qz('case when side > 0 then long_net else short_net end', 4)} as net
from ep join fe on fe.source = ep.source and fe.instrument = ep.instrument and fe.bar_us = start_us - 1000000 join v30 on v30.source = fe.source and v30.instrument = fe.instrument and v30.bar_us = fe.bar_us""",
    "join23_uninvalidated": f"with x as (select l_orderkey, max(l_shipdate) as z from lineitem group by 1) select o_orderpriority, count(*) as n, {qz('avg((epoch_us(z) - epoch_us(o_orderdate)) / 86400000000)', 4)} as mean_days from orders join x on l_orderkey = o_orderkey where o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R') group by 1",
    "join24_attribution": f"with {B5}, {_LIVE}, {_EDGE('ca', 'b')}, {_EDGE('le', 'lv')} select le.source, case when ca.side is null then 'not_canonical' when ca.side = le.side then 'matched' else 'other_side' end as kind, count(*) as n from le left join ca using (source, instrument, bar_us) group by all",
    "join25_enriched": f"""with {B5}, {_LIVE}, {_EDGE('le', 'lv')}, wo as (select source, instrument, bar_us, lead(open_bid, 1) over w as eb, lead(open_ask, 1) over w as ea, lead(open_bid, 3) over w as xb, lead(open_ask, 3) over w as xa, lead(bar_us, 3) over w - bar_us = 900000000 as ok from b window w as ({W}))
select source, instrument, bar_us, side, {qz('case when side > 0 then (xb / ea - 1) * 10000 else (eb / xa - 1) * 10000 end', 4)} as net from le join wo using (source, instrument, bar_us) where ok""",
    "join28_state_bars": f"with {B5}, {_LIVE} select source, count(*) as bars, count(*) filter (where lv.open is null) as missing, count(*) filter (where (b.open, b.high, b.low, b.close) <> (lv.open, lv.high, lv.low, lv.close)) as different from b left join lv using (source, instrument, bar_us) group by source",
    "str11_parity": f"with {B5} select count(*) as bars, cast(0 as bigint) as batch_only, cast(0 as bigint) as merged_only from b",
    "agg02_decision_bars": f"""with {S1}, a as (select *, bar_us - lag(bar_us) over ({W}) as age, cast(floor(bar_us / 300000000) as bigint) * 300000000 as period from s)
select source, instrument, period as bar_us, count(*) as seconds, cast(sum(tick_count) as bigint) as ticks, cast(sum(quote_change_count) as bigint) as changes, max(case when bar_us - age >= period then age / 1000000 end) as longest_silence_s, min(bar_us) < period + 30000000 and max(bar_us) >= period + 270000000 as complete from a group by source, instrument, period""",
    "agg06_intervals": f"""with {T}, tq as (select * replace ({qz('net', 4)} as net) from trades), e as (select *, sum(net) over (partition by symbol, side order by closed, ticket, net rows unbounded preceding) as eq from tq), f as (select *, greatest(0.0, max(eq) over (partition by symbol, side order by closed, ticket, net rows unbounded preceding)) - eq as dd from e)
select symbol, side, count(*) as n, {qz('avg(net)', 4)} as mean, {qz('avg(net) - 1.96 * coalesce(stddev_samp(net), 0) / sqrt(count(*))', 4)} as low, {qz('avg(net) + 1.96 * coalesce(stddev_samp(net), 0) / sqrt(count(*))', 4)} as high, {qz('max(dd)', 4)} as drawdown from f group by symbol, side""",
    "agg12_fold_medians": f"with {T}, {_FOLD} select fold, symbol, count(*) as n, median(volume) as volume, {qz('median(net)', 4)} as net from fo join trades on opened >= a and opened < z group by fold, symbol",
    "agg11_fold_thresholds": f"""with {T}, {_FOLD}, v as (select fold, round(net) as v from fo join trades on opened >= a and opened < z where cast(floor(opened / {DAY}) as bigint) % 7 = 0), m as (select fold, median(v) as m, count(v) as n from v group by fold), x as (select fold, m, n, median(abs(v - m)) as mad from v join m using (fold) group by all)
select fold, {qz('m')} as median, {qz('mad')} as mad, {qz('m + 3.0 * 1.4826 * mad')} as threshold from x where n >= 100 and mad > 0""",
    "agg18_family_low": f"with {T}, y as (select symbol, year(make_timestamp(closed)) as y, sum(net) as v from trades group by all) select symbol, count(*) as years, {qz(f'avg(v) - {research.NormalDist().inv_cdf(1 - 0.05 / 10)!r} * stddev_samp(v) / sqrt(count(*))', 1)} as low_normal, {qz('avg(v) - sqrt(2 * ln(10)) * stddev_samp(v) / sqrt(count(*))', 1)} as low_log from y group by symbol",
    "agg19_shares": f"""with {_DD}, r as (select *, row_number() over (partition by symbol order by net desc, day) as k from daily), x as (select symbol, sum(net) as al, sum(case when net > 0 then net else 0 end) as up, sum(case when k = 1 and net > 0 then net else 0 end) as one, sum(case when k <= 5 and net > 0 then net else 0 end) as five from r group by symbol),
m as (select symbol, max(v) as best, sum(case when v > 0 then v else 0 end) as mup from (select symbol, strftime(make_timestamp(day * {DAY}), '%Y-%m') as m, sum(net) as v from daily group by all) group by symbol)
select symbol, {qz('one / nullif(up, 0)')} as best_day_share, {qz('five / nullif(up, 0)')} as top5_share, {qz('best / nullif(mup, 0)')} as best_month_share, {qz('al - one', 2)} as without_best_day, {qz('al - five', 2)} as without_top5, {qz('al - best', 2)} as without_best_month from x join m using (symbol)""",
    "agg20_cost_levels": f"with x as (select l_partkey % 10 as symbol, l_extendedprice * l_discount as gross, l_extendedprice * 0.03 as cost from lineitem) select symbol, count(*) as n, {_COSTS}, {qz('median(gross - cost)', 3)} as median_base from x group by symbol",
    "agg21_effective_size": f"""with {_DD}, c as (select symbol, day, net - avg(net) over (partition by symbol) as x, row_number() over (partition by symbol order by day) as i from daily), den as (select symbol, sum(x * x) as s, count(*) as n from c group by symbol),
r as (select a.symbol, sum(a.x * b.x) as v from c a join range(1, 11) l(lag) on true join c b on a.symbol = b.symbol and b.i = a.i - l.lag group by a.symbol) select symbol, n, {qz('least(n, greatest(1.0, n / (1 + 2 * v / s)))', 3)} as effective from den join r using (symbol)""",
    "agg23_rollover_hours": f"""with {T}, x as (select opened, opened + (ticket % 37) * 3600000000 as ended, net, h from trades cross join range(0, 24) r(h)), y as (select *, floor(opened / {DAY}) * {DAY} + h * 3600000000 as f from x)
select cast(h as integer) as hour, count(*) as n, {qz('avg(net)', 3)} as mean from y where case when f <= opened then f + {DAY} else f end <= ended group by h""",
    "agg26_selected": f"with {T}, p as (select symbol, volume, count(*) as n, {qz('avg(net)', 3)} as mean from trades group by all), r as (select *, row_number() over (partition by symbol order by mean desc, volume) as k from p where n >= 50) select symbol, volume, mean, n from r where k = 1",
    "agg30_cash_drawdown": f"""with {T}, e as (select account, closed as us, 1 as o, ticket, {qz('net', 4)} as net, 0.0 as paid from trades union all select o_custkey, epoch_us(o_orderdate), 0, o_orderkey, 0.0, o_totalprice / 10 from orders),
r as (select *, sum(net) over w as won, sum(paid) over w as put_in from e window w as (partition by account order by us, o, ticket, net rows unbounded preceding)), p as (select *, greatest(0.0, max(won) over (partition by account order by us, o, ticket, net rows unbounded preceding)) as top from r)
select account, {qz('coalesce(max(case when o = 1 then top - won end), 0.0)', 4)} as drawdown, {qz('max(case when o = 1 and put_in + top > 0 then (top - won) / (put_in + top) * 100 end)', 4)} as drawdown_pct, {qz('sum(net) + sum(paid)', 4)} as balance from p group by account""",
    "agg31_episode_audit": f"""with {T}, f as (select *, case when max(closed) over w >= opened then 0 else 1 end as f from trades window w as (partition by account, symbol, side order by opened, ticket rows between unbounded preceding and 1 preceding)),
sp as (select *, sum(f) over (partition by account, symbol, side order by opened, ticket rows unbounded preceding) as span from f), g as (select symbol, count(*) as tickets, max(closed) - min(opened) as length from sp group by account, symbol, side, span),
e as (select symbol, opened as t, 1 as o, volume as v, 1 as n from trades union all select symbol, closed, 0, -volume, -1 from trades), r as (select symbol, sum(v) over k as v, sum(n) over k as n from (select symbol, t, o, sum(v) as v, sum(n) as n from e group by all) window k as (partition by symbol order by t, o rows unbounded preceding)),
c as (select symbol, max(v) as max_volume, cast(max(n) as bigint) as max_tickets from r group by symbol), a as (select symbol, count(*) as spans, {qz('avg(tickets)', 4)} as mean_tickets, max(tickets) as most_tickets, max(length) as longest_us from g group by symbol) select * from a join c using (symbol)""",
    "agg32_provider_paths": f"""with {T}, x as (select net / volume as m, (closed - opened) / {DAY} * 30 as h from trades), r as (select m, row_number() over (order by m) - 1 as i, count(*) over () as n from x)
select count(*) as n, {qz('min(m)', 4)} as worst, {qz('avg(case when h <= 60 then 1.0 else 0.0 end)', 4)} as quick_ratio, {qz('avg(case when h >= 900 then 1.0 else 0.0 end)', 4)} as runner_ratio, {qz('median(m)', 4)} as median, (select {qz('max(m)', 4)} from r where i = greatest(0, cast(floor(n * 0.05) as bigint) - 1)) as low from x""",
    "agg33_adversity": f"""with {T}, p as (select *, volume * 1000 + ticket % 100 as price from trades), j as (select a.account, a.ticket, a.side, a.price, arg_max(b.price, (b.opened, b.ticket, b.price)) as pp from p a join p b on a.account = b.account and a.symbol = b.symbol and a.side = b.side and a.opened between b.opened and b.closed and (b.opened, b.ticket) < (a.opened, a.ticket) group by a.account, a.symbol, a.ticket, a.side, a.price)
select account, count(*) as additions, count(*) filter (where side * (price - pp) < 0) as adverse from j group by account""",
    "agg35_readiness": f"""with p as (select source, batch_id, count(*) as ticks, (max(epoch_us(occurred_at)) - min(epoch_us(occurred_at))) / 3.6e9 as hours from market_ticks where occurred_at is not null and bid > 0 and ask >= bid and source is not null group by source, batch_id),
g as (select source, cast(sum(ticks) as bigint) as ticks, sum(hours) as hours, count(*) filter (where ticks > 1) as active from p group by source)
select source, ticks, {qz('hours', 4)} as hours, active, {qz('ticks / nullif(hours * 60, 0)', 4)} as per_minute, case when hours >= 40 and active >= 2 then 'ready' when hours >= 20 then 'checkpoint' else 'collecting' end as status from g""",
    "agg41_virtual_ledger": f"with r as (select measurement_id, min(window_seconds) as window_seconds, arg_min(return_bps, (window_seconds, coalesce(return_bps, -1e300))) as return_bps from reaction_measurements group by 1) select window_seconds, count(*) as opportunities, count(return_bps) as executed, {qz('sum(return_bps)', 3)} as total, {qz('avg(case when return_bps > 0 then 1.0 when return_bps <= 0 then 0.0 end)', 5)} as win_rate from r group by 1",
    "agg43_causal_summary": f"with {_STATE} select e.instrument, count(*) as n, {qz('avg((s.ask - s.bid) / s.mid * 10000)', 5)} as mean_spread, {qz('avg(case when side = 1 then 1.0 else 0.0 end)', 5)} as long_share from e join s using (source, instrument, bar_us) group by e.instrument",
    "win26_overlaps": f"""with recursive {_STATE}, o as (select *, row_number() over ({W}) as i from e), g(source, instrument, i, until, keep) as (select source, instrument, i, bar_us + 900000000, true from o where i = 1
  union all select o.source, o.instrument, o.i, case when o.bar_us >= g.until then o.bar_us + 900000000 else g.until end, o.bar_us >= g.until from g join o on o.source = g.source and o.instrument = g.instrument and o.i = g.i + 1),
a as (select source, instrument, count(*) filter (where keep) as accepted, count(*) filter (where not keep) as rejected from g group by 1, 2), x as (select source, instrument, bar_us as t, 1 as k, 1 as n from e union all select source, instrument, bar_us + 900000000, 0, -1 from e),
y as (select source, instrument, sum(n) over (partition by source, instrument order by t, k rows unbounded preceding) as n from (select source, instrument, t, k, sum(n) as n from x group by all)), z as (select source, instrument, cast(max(n) as bigint) as concurrent from y group by 1, 2) select * from a join z using (source, instrument)""",
    "win25_session_policies": f"with {S1}, {FEATURES}, {_POLICIES} select * from po",
    "lab05_session_strategies": f"with {S1}, {FEATURES}, {_POLICIES}, {_out(30, 30, 30, 60)}, r as (select policy, case when direction > 0 then long_net else short_net end as net from po join v30 using (source, instrument, bar_us)) select {summary('policy', 'net')} from r group by policy",
    "set06_dedupe": """with e as (select lower(trim(idempotency_key)) as k, received_at as r, envelope_id as id from event_envelopes where trim(idempotency_key) <> ''), x as (select *, row_number() over (partition by k order by r nulls last, id) as i from e)
select 'first' as policy, count(*) as n, cast(sum(m) as bigint) as ids from (select min(id) as m from e group by k) union all select 'last', count(*), cast(sum(m) as bigint) from (select max(id) as m from e group by k) union all select 'earliest_received', count(*), cast(sum(id) as bigint) from x where i = 1 union all select 'skip_seen', count(distinct k), 0 from e""",
    "srt06_extremes": f"with {B5}, x as (select *, cast(floor(bar_us / {DAY}) as bigint) as day from b) select source, instrument, day, arg_max(bar_us, (high, -bar_us)) as high_at, arg_min(bar_us, (low, bar_us)) as low_at from x group by all",
}
NAMES = (
    prj03_market_open, prj08_range_width, prj16_path_labels, prj17_invalid_paths, prj22_point_features, prj27_pair_effects, join11_live_entries, join15_episode_rows, join23_uninvalidated, join24_attribution, join25_enriched, join28_state_bars, str11_parity,
    agg02_decision_bars, agg06_intervals, agg11_fold_thresholds, agg12_fold_medians, agg18_family_low, agg19_shares, agg20_cost_levels, agg21_effective_size, agg23_rollover_hours, agg26_selected, agg30_cash_drawdown, agg31_episode_audit, agg32_provider_paths, agg33_adversity, agg35_readiness,
    agg40_backtest_metrics, agg41_virtual_ledger, agg43_causal_summary, win25_session_policies, win26_overlaps, lab05_session_strategies, set06_dedupe, srt06_extremes,
)
QUERIES = {f.__name__: f for f in NAMES}
