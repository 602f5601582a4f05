"""Composed research queries: baselines, slices, shocks, path management, staged positions, signal trades, latency, matching, due diligence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.operators import asof, bars, classify, folds, metrics, outcomes, paths, windows
from tickloom.operators.metrics import quantized
from tickloom.operators.quantiles import quantiles_of
from tickloom.plans import market, trades
from tickloom.plans.market import FIVE, S, five, quotes, seconds
from tickloom.operators.shards import carried, shard_of
from tickloom.session import cut, held, written

SECOND = 1_000_000
# sessions here tick every few seconds, so delays and gaps are wider than the defaults
LOOSE = outcomes.OutcomeConfig(max_entry_delay_us=30 * SECOND, max_exit_delay_us=30 * SECOND, max_gap_us=60 * SECOND)


def _episodes(spark: SparkSession, d: str) -> DataFrame:
    starts = market.sim09_cooldown(spark, d).select(*S, "side", (F.col("bar_us") + SECOND).alias("start_us"))
    return starts.withColumn("episode", F.pmod(F.xxhash64(*S, "start_us"), F.lit(1 << 62)))


def _metrics(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    return metrics.summary(rows, keys, value).select(*keys, "n", *[quantized(c, 4).alias(c) for c in ("mean", "median", "win_rate", "profit_factor")])


def lab01_baselines(spark, d):
    """Momentum, reversion, compression breakout and a hash-random side at a decision a minute, by part of the day."""
    f = windows.second_features(seconds(spark, d))
    iso = F.date_format(F.timestamp_micros("bar_us"), "yyyy-MM-dd'T'HH:mm:ss")
    coin = F.when(F.conv(F.substring(F.sha2(F.concat(iso, F.lit("+00:00")), 256), 1, 2), 16, 10).cast("int") % 2 == 1, 1).otherwise(-1)
    sign = F.signum("return_60s").cast("int")
    squeeze = F.when((F.col("tick_intensity_ratio") >= 1.5) & (F.col("spread_shock_ratio") <= 1.5) & (F.abs("return_5s") > F.greatest("realized_volatility", F.lit(1e-12))), F.signum("return_5s").cast("int")).otherwise(0)
    sides = F.array(*[F.struct(F.lit(n).alias("strategy"), c.alias("side")) for n, c in (("random", coin), ("momentum", sign), ("reversion", -sign), ("compression_breakout", F.when(sign.isNull() | (sign == 0), 0).otherwise(squeeze)))])
    decisions = f.select(*S, "bar_us", F.explode(sides).alias("s")).select(*S, "bar_us", "s.strategy", "s.side").where("side <> 0")
    spaced = folds.cooldown(decisions, [*S, "strategy"], "bar_us", ["bar_us"], 60 * SECOND)
    labels = outcomes.outcomes(seconds(spark, d), 30, LOOSE).where("valid").select(*S, "bar_us", "long_net_bps", "short_net_bps")
    rows = spaced.join(labels, [*S, "bar_us"]).withColumn("net", F.when(F.col("side") > 0, F.col("long_net_bps")).otherwise(F.col("short_net_bps"))).withColumn("session", classify.session_of("bar_us"))
    return _metrics(rows, ["strategy", "session"], "net")


def lab02_slices(spark, d):
    """Breakout episodes by slice."""
    starts = market.win08_episode_starts(spark, d)
    f = windows.second_features(seconds(spark, d)).select(*S, "bar_us", "spread_shock_ratio", "tick_intensity_ratio")
    labels = outcomes.outcomes(seconds(spark, d), 30, LOOSE).where("valid").select(*S, "bar_us", "long_net_bps", "short_net_bps")
    rows = starts.join(f, [*S, "bar_us"]).join(labels, [*S, "bar_us"]).withColumn("net", F.when(F.col("side") > 0, F.col("long_net_bps")).otherwise(F.col("short_net_bps")))
    rows = rows.select("net", "bar_us", classify.session_of("bar_us").alias("session"), classify.level_of("spread_shock_ratio", 0.8, 1.2).alias("spread"), classify.level_of("tick_intensity_ratio", 0.8, 1.2).alias("activity"))
    out = metrics.slices(rows, ["session", "spread", "activity"], "net")
    return out.select("dimension", "level", "n", *[quantized(c, 4).alias(c) for c in ("mean", "median", "win_rate", "profit_factor")])


# The fixed family of 252 policies: waits, pullbacks, holding seconds, stops and targets.
FAMILY = ([0, 5, 15, 30], [0.0, 0.5, 1.0], [60, 180, 300, 900], [4.0, 8.0, 12.0], [4.0, 8.0, 12.0])
# The staged factorial: entries in stages or one, a runner for 900 s or a fixed hold of 300 s.
VARIANTS = {f"{'staged' if staged else 'single'}_{'runner' if runner else 'fixed'}": paths.Staging(hold_s=900 if runner else 300, staged=staged, runner=runner) for staged in (False, True) for runner in (False, True)}


def lab07_path_management(spark, d):
    """Every policy of the fixed family of 252 on every episode."""
    return _metrics(paths.manage(_episodes(spark, d), quotes(spark, d), S, paths.policy_grid(spark, *FAMILY)), ["policy", "reason"], "net_bps")


SHOCK_HORIZONS, SHOCK_SPACING_S = (30, 60, 300), 300


def _shock_exits(spark: SparkSession, d: str, shocks: DataFrame) -> DataFrame:
    """(SERIES, bar_us, e, x30, x60, x300): the entry and exit quotes of outcomes() under LOOSE, from the quotes near shocks only; an exit that isn't valid is null."""
    ahead = 4 * SECOND + LOOSE.latency_us + LOOSE.max_entry_delay_us + max(SHOCK_HORIZONS) * SECOND + LOOSE.max_exit_delay_us
    spans = shocks.select(*S, F.col("bar_us").alias("shock_us"), (F.col("bar_us") + ahead).alias("until_us"))
    near = asof.between(quotes(spark, d).select(*S, bars.bucket("us", SECOND).alias("bar_us"), "us", "id", "bid", "ask"), spans, S, "bar_us", "shock_us", "until_us")
    path = near.groupBy(*S, "shock_us", "bar_us").agg(F.min(F.struct("us", "id", "bid", "ask")).alias("q"))
    every = Window.partitionBy(*S, "shock_us")
    w = every.orderBy("bar_us")
    # nothing behind a gap is reached
    whole = path.withColumn("gap", F.coalesce(F.col("bar_us") - F.lag("bar_us").over(w) > LOOSE.max_gap_us, F.lit(False))).withColumn("cut_off", F.max("gap").over(w)).where("not cut_off")
    due = F.col("shock_us") + SECOND + LOOSE.latency_us
    entered = whole.withColumn("e", F.min(F.when(F.col("q.us") >= due, F.col("q"))).over(every)).where(F.col("e.us") - due <= LOOSE.max_entry_delay_us)
    wait = F.col("q.us") - F.col("e.us")
    exits = [F.min(F.when((wait >= h * SECOND) & (wait <= h * SECOND + LOOSE.max_exit_delay_us), F.col("q"))).alias(f"x{h}") for h in SHOCK_HORIZONS]
    return entered.groupBy(*S, F.col("shock_us").alias("bar_us")).agg(F.min("e").alias("e"), *exits)


def lab09_shocks(spark, d):
    """Second-level shocks beyond each series' robust threshold, at least 300 s apart: continued, faded or abstained by what the tape showed, and what
    four policies made of them at three horizons.

    The threshold is over all returns of the series, zeros as well. n counts the shocks of an action, trades those that the policy takes and whose
    outcome is valid. Rows after a gap count like others, as series here tick more slowly than the five seconds that make one.
    """
    f = cut(windows.second_features(seconds(spark, d)).where("return_5s is not null").select(*S, "bar_us", "return_1s", "return_5s", "spread_shock_ratio", "tick_intensity_ratio", F.abs("return_5s").alias("size")))
    limits = metrics.robust_threshold(f, S, "size", 4.0, 30)
    beyond = f.join(limits.select(*S, "threshold"), S).where("size > threshold")
    shocks = cut(folds.cooldown(beyond, S, "bar_us", ["bar_us"], SHOCK_SPACING_S * SECOND))
    recent, calm = F.coalesce("return_1s", F.lit(0.0)), F.col("spread_shock_ratio") <= 1.2
    back = (F.col("return_5s") * recent < 0) & (F.abs(recent) >= 0.25 * F.col("size"))
    action = F.when(calm & back, "fade").when(calm & (F.col("return_5s") * recent > 0) & (F.col("tick_intensity_ratio") >= 1), "continue").otherwise("abstain")
    side = F.signum("return_5s").cast("int")
    iso = F.date_format(F.timestamp_micros("bar_us"), "yyyy-MM-dd'T'HH:mm:ss")
    coin = F.when(F.conv(F.substring(F.sha2(F.concat(iso, F.lit("+00:00")), 256), 1, 2), 16, 10).cast("int") % 2 == 1, 1).otherwise(-1)
    judged = F.when(action == "fade", -side).when(action == "continue", side).otherwise(0)
    policies = F.array(*[F.struct(F.lit(n).alias("policy"), c.alias("direction")) for n, c in (("classified", judged), ("fade_all", -side), ("continue_all", side), ("random_direction", coin))])
    exits = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon_s"), F.col(f"x{h}").alias("x")) for h in SHOCK_HORIZONS]))
    tried = shocks.select(*S, "bar_us", "size", action.alias("action"), policies.alias("ways")).join(_shock_exits(spark, d, shocks), [*S, "bar_us"], "left")
    rows = tried.select("instrument", "size", "action", "e", F.explode("ways").alias("way"), *[f"x{h}" for h in SHOCK_HORIZONS]).select("instrument", "size", "action", "e", "way.*", exits.alias("exit")).select("*", "exit.*")
    long, mid, xmid = F.col("direction") > 0, (F.col("e.bid") + F.col("e.ask")) / 2, (F.col("x.bid") + F.col("x.ask")) / 2
    values = {"gross": (xmid / mid, mid / xmid), "net": (F.col("x.bid") / F.col("e.ask"), F.col("e.bid") / F.col("x.ask"))}
    result = lambda kind: (F.when(long, values[kind][0]).when(F.col("direction") < 0, values[kind][1]) - 1) * 10_000
    out = rows.groupBy("instrument", "action", "policy", "horizon_s").agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("size"), F.count(result("net")).alias("trades"), F.avg(result("gross")).alias("gross"), F.avg(result("net")).alias("net"))
    return out.select("instrument", "action", "policy", "horizon_s", "n", quantized(F.col("size") * 10_000, 4).alias("mean_size_bps"), "trades", quantized("gross", 4).alias("mean_gross_bps"), quantized("net", 4).alias("mean_net_bps"))


def lab11_staged(spark, d):
    """All four variants of staged positions on every episode, by how they ended."""
    return _metrics(paths.staged_variants(_episodes(spark, d), quotes(spark, d), S, VARIANTS), ["variant", "reason", "partial"], "net_bps")


def lab13_matched_trades(spark, d):
    """Trades of two groups of accounts matched one to one by symbol and side, over all accounts; the pairs by symbol."""
    t = held(trades.trades(spark, d), odd=F.col("account") % 2)
    keyed = lambda o: t.where(F.col("odd") == o).select("symbol", "side", F.col("opened").alias("t"), "ticket")
    got = folds.match_one_to_one(keyed(0), keyed(1), ["symbol", "side"], "t", "ticket", trades.DAY)
    return quantiles_of(got.select("symbol", F.abs("lag_us").alias("lag")), ["symbol"], "lag", {"median_lag_us": 0.5}).select("symbol", F.col("_n").alias("pairs"), "median_lag_us")


def lab22_signal_trades(spark, d):
    """Rising edges of a bar trend traded one position at a time."""
    b = windows.bar_trend(windows.ema(five(spark, d), 6), 1800)
    active = (F.col("close") > F.col("ema")) & (F.col("trend_return") > 0) & (F.col("efficiency") > 0.2)
    w = Window.partitionBy(*S).orderBy("bar_us")
    edges = b.where("ema is not null").withColumn("on", active).withColumn("was", F.coalesce(F.lag("on").over(w), F.lit(False))).where("on and not was").select(*S, (F.col("bar_us") + FIVE).alias("us"), F.lit(1).alias("side"))
    q = quotes(spark, d).groupBy(*S, "us").agg(F.max(F.struct("id", "bid", "ask")).alias("m")).select(*S, "us", "m.bid", "m.ask")
    got = paths.signal_trades(edges, q, S, 900 * SECOND, 60 * SECOND)
    return got.select(*S, "us", "side", "entered_us", "exited_us", "boundary_valid", quantized("net_bps").alias("net_bps"))


def lab17_latency_replay(spark, d):
    """The signal trades again with five latencies."""
    t = written(lab22_signal_trades(spark, d)).select(*S, F.xxhash64(*S, "us").alias("trade"), "side", F.col("entered_us").alias("entry_us"), F.col("exited_us").alias("exit_us"))
    q = written(quotes(spark, d).groupBy(*S, "us").agg(F.max(F.struct("id", "bid", "ask")).alias("m")).select(*S, "us", "m.bid", "m.ask"))
    got = paths.latency_replay(t, q, S, [50_000, 250_000, SECOND, 5 * SECOND, 60 * SECOND], 30 * SECOND)
    return got.groupBy("latency_us", "reason").agg(F.count(F.lit(1)).alias("n"), quantized(F.avg("gross_bps"), 4).alias("mean_bps"))


def lab24_due_diligence(spark, d):
    """Per account: trades, result, profit factor, worst drawdown, most open at once, and the share of volume rises after losses."""
    t = trades.trades(spark, d)
    order = ["closed", "ticket", "net", "volume"]
    before = carried(t.withColumn("net", quantized("net", 4)), ["account"], order, F.struct("net", "volume"), "prev", shard_of("closed"), strict=True)
    rows = cut(windows.drawdown(before, ["account"], order, "net"))
    own = rows.groupBy("account").agg(F.max("drawdown").alias("drawdown"), F.avg(F.when(F.col("prev.net") < 0, (F.col("volume") > F.col("prev.volume")).cast("double"))).alias("escalation"))
    out = metrics.summary(rows, ["account"], "net").join(own, "account").join(metrics.concurrency(t, ["account"], "opened", "closed", "volume"), "account")
    return out.select("account", "n", quantized(quantized(F.col("mean") * F.col("n"), 4) / F.col("n"), 3).alias("mean"), quantized("median", 5).alias("median"), *[quantized(c, 3).alias(c) for c in ("win_rate", "profit_factor", "escalation")], quantized("drawdown", 4).alias("drawdown"), "max_volume", "max_tickets")


def sim10_zones(spark, d):
    b = five(spark, d)
    return paths.zones(b, windows.fair_value_gaps(b), S)


def agg17_bootstrap(spark, d):
    daily = trades._daily(spark, d)
    return metrics.bootstrap(daily, ["symbol"], ["day"], "net", 500, 20, 20260809).select("symbol", quantized("low", 4).alias("low"), quantized("high", 4).alias("high"))


def agg25_ridge(spark, d):
    """A ridge fit of a trade's result on its size and length, scored on every trade and averaged by symbol."""
    t = trades.trades(spark, d).withColumn("days", (F.col("closed") - F.col("opened")) / trades.DAY)
    model = metrics.ridge(t, ["volume", "days", "side"], "net")
    return t.groupBy("symbol").agg(quantized(F.avg(metrics.ridge_score(model)), 3).alias("predicted"), quantized(F.avg("net"), 3).alias("actual"))


def job01_folds(spark, d):
    """Trades per walk-forward fold: a range join to a small table of test windows."""
    from datetime import datetime

    from tickloom.session import us

    f = metrics.folds(spark, datetime(1994, 1, 1), datetime(1998, 1, 1), metrics.WalkForward(365, 60, 90, 90)).select("fold", us("test_start").alias("a"), (us("test_end") - 1).alias("z"), F.lit(1).alias("k"))
    from tickloom.operators.asof import between

    t = trades.trades(spark, d).withColumn("k", F.lit(1))
    return between(t, f, ["k"], "opened", "a", "z", width_us=30 * trades.DAY).groupBy("fold").agg(F.count(F.lit(1)).alias("n"), quantized(F.sum("net"), 2).alias("net"))


_Z = """z as materialized (select *, row_number() over (partition by source, instrument order by bar_us) as i, case when low > lag(high, 2) over w then 1 when high < lag(low, 2) over w then -1 end as zs,
  case when low > lag(high, 2) over w then lag(high, 2) over w when high < lag(low, 2) over w then high end as zl, case when low > lag(high, 2) over w then low when high < lag(low, 2) over w then lag(low, 2) over w end as zh from b window w as (partition by source, instrument order by bar_us)),
y as (select *, count(zs) over (partition by source, instrument order by bar_us rows unbounded preceding) as n from z),
x as (select *, first_value(zs) over r as s0, first_value(zl) over r as l0, first_value(zh) over r as h0, first_value(i) over r as i0 from y window r as (partition by source, instrument, n order by i)),
v as (select *, i - i0 as age, max(case when close >= l0 and close <= h0 then 1 else 0 end) over (partition by source, instrument, n order by i rows unbounded preceding) = 1 as m from x)"""


def _sql() -> dict[str, str]:
    from tickloom.plans.market_sql import B5

    alive = lambda c: f"case when s0 is not null and age <= 20 then {c} end"
    return {"sim10_zones": f"with {B5}, {_Z} select source, instrument, bar_us, {alive('s0')} as side, {alive('l0')} as zone_low, {alive('h0')} as zone_high, cast({alive('age')} as integer) as age, {alive('m')} as mitigated from v"}


ORACLE = _sql()
QUERIES = {f.__name__: f for f in (lab01_baselines, lab02_slices, lab07_path_management, lab09_shocks, lab11_staged, lab13_matched_trades, lab17_latency_replay, lab22_signal_trades, lab24_due_diligence, sim10_zones, agg17_bootstrap, agg25_ridge, job01_folds)}
