"""Sequence queries: entries, exits and the walk-forward report over breakout episodes, with their DuckDB statements."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators import asof, metrics, sequences, windows
from tickloom.operators.metrics import quantized
from tickloom.operators.research import NormalDist
from tickloom.plans.labs_sql import FEATURES
from tickloom.plans.market import S, seconds
from tickloom.plans.market_sql import S1, W, qz
from tickloom.session import us, written

SECOND = 1_000_000
# series here tick every few seconds, so gaps and delays are wider than the defaults
LOOSE = sequences.SequenceConfig(gap_us=60 * SECOND, entry_delay_us=30 * SECOND)
# the quotes' span and folds that fit it
START, END, FOLDS = datetime(2025, 10, 12), datetime(2025, 11, 16), metrics.WalkForward(10, 3, 3, 3, 300, 300)


def _rows(spark, d) -> tuple[DataFrame, DataFrame]:
    """(bars, starts): second bars with spread and executable quote, and the spaced breakout episodes with what is known at their start."""
    b = written(seconds(spark, d))
    bars = written(sequences.executable(b, LOOSE).withColumn("spread_bps", (F.col("ask") - F.col("bid")) / F.col("mid") * 10_000))
    levels = windows.prior_levels(b.select(*S, "bar_us", "mid"), "bar_us", "mid", (60, 300)).withColumn("side", windows.breakout("mid", "prior_high_300s", "prior_low_300s", 1.0))
    begun = windows.episode_starts(levels, "bar_us", "side", 60 * SECOND)
    f = windows.second_features(b).select(*S, "bar_us", "spread_bps", "tick_count", "quote_change_count", "tick_intensity_ratio", "spread_shock_ratio", "return_5s", "return_30s")
    squeeze = (F.col("prior_high_60s") - F.col("prior_low_60s")) / F.nullif(F.col("prior_high_300s") - F.col("prior_low_300s"), F.lit(0.0))
    rows = begun.join(f, [*S, "bar_us"]).withColumn("level", F.when(F.col("side") > 0, F.col("prior_high_300s")).otherwise(F.col("prior_low_300s"))).withColumn("compression", squeeze)
    return bars, written(sequences.episodes(_in_tests(spark, rows), LOOSE))


def _in_tests(spark, rows: DataFrame) -> DataFrame:
    """rows within the test part of a walk-forward fold, with its number and end; a range join to a table of a few rows."""
    f = metrics.folds(spark, START, END, FOLDS).select("fold", us("test_start").alias("_a"), (us("test_end") - 1).alias("_z"), us("test_end").alias("test_end"), F.lit(1).alias("_one"))
    return asof.between(rows.withColumn("_one", F.lit(1)), f, ["_one"], "bar_us", "_a", "_z", 86_400 * SECOND).drop("_one", "_a", "_z")


def sim05_episodes(spark, d):
    """Breakout episodes in test windows, 960 s apart."""
    return _rows(spark, d)[1].select(*S, "bar_us", "side", "fold", "level")


def sim03_entries(spark, d):
    """What each entry policy makes of each episode."""
    bars, starts = _rows(spark, d)
    got = sequences.entries(starts, bars, LOOSE)
    return got.select(*S, "start_us", "policy", "direction", "signal_us", F.col("x.us").alias("entry_us"), F.col("x.bid").alias("entry_bid"), F.col("x.ask").alias("entry_ask"))


def _trades(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    bars, starts = _rows(spark, d)
    of = starts.select(*S, F.col("bar_us").alias("start_us"), "fold", "test_end")
    found = written(sequences.entries(starts, bars, LOOSE).join(of, [*S, "start_us"]))
    entered = found.where("x is not null and x.us < test_end")
    done = sequences.exits(entered, bars, LOOSE).join(of, [*S, "start_us"])
    counts = found.groupBy("policy").agg(F.count(F.lit(1)).alias("triggers"), F.count(F.when(F.col("x").isNotNull() & (F.col("x.us") < F.col("test_end")), 1)).alias("signals"))
    return done, counts, starts.agg(F.count(F.lit(1)))


def sim04_exits(spark, d):
    """Where each entry ends by three styles at three horizons."""
    rows = _trades(spark, d)[0]
    return rows.select(*S, "start_us", "policy", "horizon_s", "style", "entered_us", "exited_us", quantized("gross_bps", 4).alias("gross_bps"), quantized("net_bps", 4).alias("net_bps"))


def lab03_sequences(spark, d):
    """The sequence lab: every policy and exit over the folds' test windows."""
    done, counts, eligible = _trades(spark, d)
    out = sequences.policy_report(written(done), counts, eligible, ["policy", "horizon_s", "style"])
    return out.select("policy", "horizon_s", "style", "trades", "folds", "good_folds", "months", "good_months", "triggers", "signals", *[quantized(c, 3).alias(c) for c in ("mean_gross", "mean_cost", "mean_net", "mean_net_1_5x", "mean_net_2x", "low_normal", "win_rate", "profit_factor", "mean_holding_s", "best_month_share", "abstention", "policy_abstention", "rejection")])


def _pressure(spark, d) -> DataFrame:
    b = written(seconds(spark, d))
    f = windows.second_features(b).select(*S, "bar_us", "return_5s", "tick_intensity_ratio")
    bars = written(sequences.executable(b, LOOSE).withColumn("spread_bps", (F.col("ask") - F.col("bid")) / F.col("mid") * 10_000).join(f, [*S, "bar_us"]))
    levels = windows.prior_levels(b.select(*S, "bar_us", "mid"), "bar_us", "mid", (300,)).withColumn("side", windows.breakout("mid", "prior_high_300s", "prior_low_300s", 1.0))
    return sequences.pressure_events(windows.episode_starts(levels.select(*S, "bar_us", "side"), "bar_us", "side", 60 * SECOND), bars, LOOSE, wait_s=30)


def sim17_pressure_events(spark, d):
    """Breakouts with pressure behind them, at market and by a passive limit, at three horizons."""
    rows = _pressure(spark, d)
    return rows.select(*S, "start_us", "side", "signal_us", quantized("pressure", 6).alias("pressure"), quantized("activity", 6).alias("activity"), "horizon_s", "style", "filled", quantized("gross_bps", 4).alias("gross_bps"), quantized("net_bps", 4).alias("net_bps"))


GRID = ((0.25, 0.5, 1.0, 2.0), (0.0, 1.0, 1.5), (2.0, 4.0, 8.0))


def lab10_quote_pressure(spark, d):
    """Nested walk-forward: of each fold's training events the thresholds, style and horizon with the best mean among those with ten events, and what they make of the test events."""
    from tickloom.operators.research import select_best

    rows = written(sequences.matching(_pressure(spark, d), *GRID).withColumn("bar_us", F.col("signal_us")).withColumn("net", quantized("net_bps", 4)))
    parts = metrics.folds(spark, START, END, FOLDS)
    part = lambda a, z: asof.between(rows.withColumn("_one", F.lit(1)), parts.select("fold", us(a).alias("_a"), (us(z) - 1).alias("_z"), F.lit(1).alias("_one")), ["_one"], "bar_us", "_a", "_z", 86_400 * SECOND)
    mean = quantized(quantized(F.sum("net"), 4) / F.count(F.lit(1)), 4)
    best = select_best(part("train_start", "train_end").groupBy("fold", "candidate").agg(F.count(F.lit(1)).alias("n"), mean.alias("mean")), ["fold"], "candidate", "mean", "n", 10)
    test = part("test_start", "test_end").groupBy("fold", "candidate").agg(F.count(F.lit(1)).alias("test_n"), mean.alias("test_mean"))
    return best.join(test, ["fold", "candidate"], "left").select("fold", "candidate", "n", "mean", F.coalesce("test_n", F.lit(0)).alias("test_n"), "test_mean")


_K = "source, instrument, start_us"
_FO = """fo as (select k + 1 as fold, a, a + 3 * 86400000000 as z from (select k, epoch_us(timestamp '2025-10-12') + (10 + 3 * k) * 86400000000 + 300000000 + 3 * 86400000000 + 300000000 as a from range(0, 20) r(k)) where a + 3 * 86400000000 <= epoch_us(timestamp '2025-11-16'))"""
_BASE = f"""{S1}, {FEATURES}, {_FO}, sg0 as (select *, bar_us - lag(bar_us) over ({W}) as age from s), sg as materialized (select *, (ask - bid) / mid * 10000 as spread, sum(case when age > 60000000 then 1 else 0 end) over ({W} rows unbounded preceding) as seg from sg0),
xx as (select a.source, a.instrument, a.bar_us, a.seg, b.open_us as x_us, b.open_bid as x_bid, b.open_ask as x_ask, b.bar_us as x_bar, b.seg as x_seg from sg a asof left join sg b on a.source = b.source and a.instrument = b.instrument and a.bar_us + 1050000 <= b.open_us),
bx as materialized (select sg.*, case when x_seg = sg.seg and x_us - (sg.bar_us + 1050000) <= 30000000 then x_us end as x_us, x_bid, x_ask, x_bar from sg join xx using (source, instrument, bar_us)),
lv as (select source, instrument, bar_us, mid, max(mid) over r3 as h3, min(mid) over r3 as l3, max(mid) over r6 as h6, min(mid) over r6 as l6 from s window r3 as ({W} range between 300000000 preceding and 1 preceding), r6 as ({W} range between 60000000 preceding and 1 preceding)),
sd as (select *, case when (mid / h3 - 1) * 10000 >= 1 then 1 when (l3 / mid - 1) * 10000 >= 1 then -1 else 0 end as side from lv),
be as (select * from (select *, lag(side) over ({W}) as ps, lag(bar_us) over ({W}) as pt from sd) where side <> 0 and (pt is null or bar_us - pt > 60000000 or side <> ps)),
bf as (select be.*, fold, z as test_end, sp, shock, intensity, r5, r30, tick_count, quote_change_count, case when side > 0 then h3 else l3 end as level, (h6 - l6) / nullif(h3 - l3, 0) as squeeze from be join fe using (source, instrument, bar_us) join fo on be.bar_us >= a and be.bar_us < z where sp <= 8),
od as (select *, row_number() over ({W}) as i from bf), cd(source, instrument, i, last, keep) as (select source, instrument, i, bar_us, true from od where i = 1
  union all select od.source, od.instrument, od.i, case when od.bar_us >= cd.last + 960000000 then od.bar_us else cd.last end, od.bar_us >= cd.last + 960000000 from cd join od on od.source = cd.source and od.instrument = cd.instrument and od.i = cd.i + 1),
es as materialized (select od.* exclude (bar_us), bar_us as start_us from od join cd using (source, instrument, i) where keep),
p0 as (select es.source, es.instrument, es.start_us, es.side, es.level, bx.bar_us, bx.mid, bx.spread, bx.x_us, bx.x_bid, bx.x_ask, bx.x_bar, es.shock, es.intensity, es.r5, es.r30, es.tick_count, es.quote_change_count, es.squeeze
  from es join bx on bx.source = es.source and bx.instrument = es.instrument and bx.bar_us between start_us and start_us + 90000000 and bx.seg = (select seg from sg where sg.source = es.source and sg.instrument = es.instrument and sg.bar_us = es.start_us)),
p1 as (select *, (mid / level - 1) * 10000 as away, {", ".join(f"min(bar_us) filter (where bar_us >= start_us + {d}000000) over (partition by {_K}) as f{d}" for d in (5, 15, 30))} from p0 where bar_us > start_us),
p2 as (select *, spread <= 8 as tight, away * side >= 0.25 as beyond, {", ".join(f"case when f{d} - start_us - {d}000000 <= 60000000 then f{d} end as a{d}" for d in (5, 15, 30))}, min(bar_us) filter (where abs(away) <= 0.5) over (partition by {_K}) as touch, coalesce(r5, 0) * side * 10000 as pressure from p1),
hit as (select *, 'hold_5s' as policy, side as direction from p2 where bar_us = a5 and tight and beyond union all select *, 'hold_15s', side from p2 where bar_us = a15 and tight and beyond
  union all select *, 'compression_activity_hold', side from p2 where bar_us = a5 and tight and beyond and squeeze <= 0.5 and intensity >= 1.5
  union all select *, 'quote_pressure_hold', side from p2 where bar_us = a5 and tight and beyond and intensity >= 1.5 and quote_change_count / greatest(tick_count, 1) >= 0.5 and pressure >= 0.25 and shock <= 1.5
  union all select *, 'trend_alignment_hold', side from p2 where bar_us = a5 and tight and beyond and pressure >= 0.25 and coalesce(r30, 0) * side * 10000 >= 0.25 and shock <= 1.5
  union all select *, 'retest_resume', side from p2 where bar_us <= a30 and bar_us >= touch and beyond and tight
  union all select *, 'sweep_fade', -side from p2 where bar_us <= a15 and tight and case when side > 0 then mid <= level * (1 - 0.5 / 10000) else mid >= level * (1 + 0.5 / 10000) end),
en as materialized (select {_K}, level, policy, direction, bar_us as signal_us, x_us, case when x_us is not null then x_bid end as x_bid, case when x_us is not null then x_ask end as x_ask, case when x_us is not null then x_bar end as x_bar from hit qualify row_number() over (partition by {_K}, policy order by bar_us) = 1)"""
_EXITS = f"""{_BASE}, et as materialized (select en.*, fold, test_end from en join es using ({_K})),
q0 as (select e.{_K.replace(', ', ', e.')}, e.level, e.policy, e.direction, e.x_us as e_us, e.x_bid as e_bid, e.x_ask as e_ask, e.x_bar as e_bar, b.bar_us, b.open_us, b.open_bid, b.open_ask, b.mid, b.x_us, b.x_bid, b.x_ask, b.x_bar
  from et e join bx b on b.source = e.source and b.instrument = e.instrument and b.bar_us > e.x_bar and b.bar_us <= e.x_bar + 961000000 and b.seg = (select seg from sg where sg.source = e.source and sg.instrument = e.instrument and sg.bar_us = e.x_bar) where e.x_us < test_end),
q1 as (select *, (case when direction > 0 then mid / ((e_bid + e_ask) / 2) else (e_bid + e_ask) / 2 / mid end - 1) * 10000 as gross from q0),
q2 as (select *, max(gross) over (partition by {_K}, policy order by bar_us rows unbounded preceding) as best from q1),
q3 as (select *, min(bar_us) filter (where open_us >= e_us + h * 1000000) over (partition by {_K}, policy, h) as f_bar from q2 cross join (values (60), (300), (900)) v(h)),
q4 as (select *, max(open_us) filter (where bar_us = f_bar) over w as f_us, max(open_bid) filter (where bar_us = f_bar) over w as f_bid, max(open_ask) filter (where bar_us = f_bar) over w as f_ask from q3 window w as (partition by {_K}, policy, h)),
q5 as (select *, case when direction > 0 then mid < level else mid > level end as crossed, best >= 3 and gross <= best - 1.5 as trailed from q4 where f_us - (e_us + h * 1000000) <= 60000000 and bar_us <= f_bar),
q6 as (select {_K}, policy, direction, h, any_value(e_us) as e_us, any_value(e_bid) as e_bid, any_value(e_ask) as e_ask, any_value(f_us) as f_us, any_value(f_bid) as f_bid, any_value(f_ask) as f_ask,
  {", ".join(f"arg_min({c}, bar_us) filter (where {t} and x_us is not null and x_bar <= f_bar) as {n}_{c}" for n, t in (("s", "crossed"), ("t", "trailed")) for c in ("x_us", "x_bid", "x_ask"))} from q5 group by {_K}, policy, direction, h),
q7 as ({" union all ".join(f"select {_K}, policy, direction, h, '{n}' as style, e_us, e_bid, e_ask, {u} as q_us, {b} as q_bid, {a} as q_ask from q6" for n, u, b, a in (("time", "f_us", "f_bid", "f_ask"), ("structural_or_time", "coalesce(s_x_us, f_us)", "case when s_x_us is null then f_bid else s_x_bid end", "case when s_x_us is null then f_ask else s_x_ask end"), ("trailing_or_time", "coalesce(t_x_us, f_us)", "case when t_x_us is null then f_bid else t_x_bid end", "case when t_x_us is null then f_ask else t_x_ask end")))}),
q8 as materialized (select *, (case when direction > 0 then (q_bid + q_ask) / (e_bid + e_ask) else (e_bid + e_ask) / (q_bid + q_ask) end - 1) * 10000 as g, (case when direction > 0 then q_bid * (1 - 0.5 / 10000) / (e_ask * (1 + 0.5 / 10000)) else e_bid * (1 - 0.5 / 10000) / (q_ask * (1 + 0.5 / 10000)) end - 1) * 10000 as n from q7)"""
_Z = NormalDist().inv_cdf(1 - 0.05 / 63)
ORACLE = {
    "sim05_episodes": f"with recursive {_BASE} select source, instrument, start_us as bar_us, side, cast(fold as integer) as fold, level from es",
    "sim03_entries": f"with recursive {_BASE} select {_K}, policy, direction, signal_us, x_us as entry_us, x_bid as entry_bid, x_ask as entry_ask from en",
    "sim04_exits": f"with recursive {_EXITS} select {_K}, policy, h as horizon_s, style, e_us as entered_us, q_us as exited_us, {qz('g', 4)} as gross_bps, {qz('n', 4)} as net_bps from q8",
    "lab03_sequences": f"""with recursive {_EXITS}, tr as (select q8.*, fold, strftime(make_timestamp(e_us), '%Y-%m') as mo from q8 join es using ({_K})),
bo as (select policy, h, style, count(*) as folds, count(*) filter (where m > 0) as good_folds, case when count(*) >= 2 then avg(m) - {_Z!r} * stddev_samp(m) / sqrt(count(*)) end as low from (select policy, h, style, fold, avg(n) as m from tr group by all) group by all),
bm as (select policy, h, style, count(*) as months, count(*) filter (where m > 0) as good_months, greatest(max(m), 0) / nullif(sum(case when m > 0 then m else 0 end), 0) as share from (select policy, h, style, mo, sum(n) as m from tr group by all) group by all),
ow as (select policy, h, style, count(*) as trades, avg(g) as a, avg(g - n) as b, avg(n) as c, avg(g - 1.5 * (g - n)) as d, avg(g - 2 * (g - n)) as e, avg(case when n > 0 then 1.0 else 0.0 end) as w, sum(case when n > 0 then n else 0 end) / nullif(sum(case when n < 0 then -n else 0 end), 0) as f, avg((q_us - e_us) / 1000000) as hold from tr group by all),
ct as (select policy, count(*) as triggers, count(*) filter (where x_us < test_end) as signals from et group by policy), el as (select count(*) as al from es)
select policy, h as horizon_s, style, trades, folds, good_folds, months, good_months, triggers, signals, {qz('a', 3)} as mean_gross, {qz('b', 3)} as mean_cost, {qz('c', 3)} as mean_net, {qz('d', 3)} as mean_net_1_5x, {qz('e', 3)} as mean_net_2x, {qz('low', 3)} as low_normal, {qz('w', 3)} as win_rate, {qz('f', 3)} as profit_factor, {qz('hold', 3)} as mean_holding_s, {qz('share', 3)} as best_month_share,
  {qz('1 - signals / al', 3)} as abstention, {qz('1 - triggers / al', 3)} as policy_abstention, {qz('1 - signals / triggers', 3)} as rejection from ow join bo using (policy, h, style) join bm using (policy, h, style) join ct using (policy) cross join el""",
}
_BX = _BASE[: _BASE.index("lv as (select")]
_PRESSURE = f"""{_BX}
lw as (select source, instrument, bar_us, mid, max(mid) over r as hi, min(mid) over r as lo from s window r as ({W} range between 300000000 preceding and 1 preceding)), ls as (select source, instrument, bar_us, case when (mid / hi - 1) * 10000 >= 1 then 1 when (lo / mid - 1) * 10000 >= 1 then -1 else 0 end as side from lw),
pb as (select source, instrument, bar_us as start_us, side from (select *, lag(side) over ({W}) as ps, lag(bar_us) over ({W}) as pt from ls) where side <> 0 and (pt is null or bar_us - pt > 60000000 or side <> ps)),
h0 as (select pb.*, bx.bar_us, bx.open_us, bx.open_bid, bx.open_ask, bx.x_us, bx.x_bid, bx.x_ask, bx.x_bar, bx.spread, fe.r5, fe.intensity from pb join bx on bx.source = pb.source and bx.instrument = pb.instrument and bx.bar_us > start_us and bx.bar_us <= start_us + 155000000 and bx.seg = (select seg from sg where sg.source = pb.source and sg.instrument = pb.instrument and sg.bar_us = start_us)
  join fe on fe.source = bx.source and fe.instrument = bx.instrument and fe.bar_us = bx.bar_us),
h1 as (select *, min(bar_us) filter (where bar_us >= start_us + 5000000) over (partition by source, instrument, start_us) as sb from h0),
h2 as (select *, {", ".join(f"max({c}) filter (where bar_us = sb) over (partition by source, instrument, start_us) as g_{c}" for c in ("open_us", "open_bid", "open_ask", "spread", "r5", "intensity", "x_us", "x_bid", "x_ask", "x_bar"))} from h1 where sb - start_us - 5000000 <= 60000000),
h3 as (select *, min(open_us) filter (where bar_us > sb and open_us >= g_open_us + 30000000) over (partition by source, instrument, start_us) as end_us from h2),
h4 as (select source, instrument, start_us, side, sb, any_value(g_open_bid) as lb, any_value(g_open_ask) as la, any_value(g_spread) as spread, any_value(g_intensity) as activity, coalesce(any_value(g_r5), 0) * side * 10000 as pressure, any_value(g_x_us) as x_us, any_value(g_x_bid) as x_bid, any_value(g_x_ask) as x_ask, any_value(g_x_bar) as x_bar,
  {", ".join(f"arg_min({c}, bar_us) filter (where bar_us > sb and end_us - g_open_us - 30000000 <= 60000000 and open_us <= end_us and case when side > 0 then open_ask < g_open_bid else open_bid > g_open_ask end) as p_{c}" for c in ("open_us", "open_bid", "open_ask", "bar_us"))} from h3 group by source, instrument, start_us, side, sb),
h5 as (select *, row_number() over (partition by source, instrument order by start_us) as i from h4 where pressure >= 0.25), hc(source, instrument, i, last, keep) as (select source, instrument, i, start_us, true from h5 where i = 1
  union all select o.source, o.instrument, o.i, case when o.start_us >= hc.last + 3660000000 then o.start_us else hc.last end, o.start_us >= hc.last + 3660000000 from hc join h5 o on o.source = hc.source and o.instrument = hc.instrument and o.i = hc.i + 1),
h6 as materialized (select h5.* from h5 join hc using (source, instrument, i) where keep),
h7 as materialized (select source, instrument, start_us, side, sb, lb, la, spread, activity, pressure, 'market' as style, x_us as e_us, x_bid as e_bid, x_ask as e_ask, x_bar as e_bar from h6 union all select source, instrument, start_us, side, sb, lb, la, spread, activity, pressure, 'passive_limit', p_open_us, p_open_bid, p_open_ask, p_bar_us from h6),
h8 as (select h7.source, h7.instrument, h7.start_us, h7.style, h, min(b.open_us) as q_us, arg_min(b.open_bid, b.open_us) as q_bid, arg_min(b.open_ask, b.open_us) as q_ask from h7 cross join (values (60), (300), (900)) v(h) join bx b on b.source = h7.source and b.instrument = h7.instrument and b.bar_us > e_bar and b.bar_us <= e_bar + 961000000 and b.open_us >= e_us + h * 1000000
  and b.seg = (select seg from sg where sg.source = h7.source and sg.instrument = h7.instrument and sg.bar_us = h7.e_bar) where e_us is not null group by all),
h9 as (select h7.*, v.h, case when q_us - (e_us + v.h * 1000000) <= 60000000 then q_us end as q_us, q_bid, q_ask from h7 cross join (values (60), (300), (900)) v(h) left join h8 on h8.source = h7.source and h8.instrument = h7.instrument and h8.start_us = h7.start_us and h8.style = h7.style and h8.h = v.h),
pv as materialized (select *, q_us is not null as filled, case when q_us is not null then (case when side > 0 then (q_bid + q_ask) / (e_bid + e_ask) else (e_bid + e_ask) / (q_bid + q_ask) end - 1) * 10000 else 0 end as g,
  case when q_us is not null then (case when side > 0 then q_bid * 0.99995 / (case when style = 'market' then e_ask * 1.00005 else lb end) else (case when style = 'market' then e_bid * 0.99995 else la end) / (q_ask * 1.00005) end - 1) * 10000 else 0 end as n from h9)"""
ORACLE |= {
    "sim17_pressure_events": f"with recursive {_PRESSURE} select source, instrument, start_us, side, sb as signal_us, {qz('pressure', 6)} as pressure, {qz('activity', 6)} as activity, h as horizon_s, style, filled, {qz('g', 4)} as gross_bps, {qz('n', 4)} as net_bps from pv",
    "lab10_quote_pressure": f"""with recursive {_PRESSURE}, gd as (select * from (values {", ".join(f"('p{p:g}', {p}::double)" for p in GRID[0])}) a(pn, p) cross join (values {", ".join(f"('a{a:g}', {a}::double)" for a in GRID[1])}) b(an, a) cross join (values {", ".join(f"('s{x:g}', {x}::double)" for x in GRID[2])}) c(sn, sx)),
mt as (select pv.sb, style || '_h' || h || '_' || pn || '_' || an || '_' || sn as candidate, {qz('n', 4)} as net from pv join gd on pressure >= p and activity >= a and spread <= sx where filled),
fp as (select k + 1 as fold, epoch_us(timestamp '2025-10-12') as ta, epoch_us(timestamp '2025-10-12') + (10 + 3 * k) * 86400000000 as tz from range(0, 20) r(k)),
tn as (select fold, candidate, count(*) as n, {qz('(' + qz('sum(net)', 4) + ') / count(*)', 4)} as mean from mt join fp on sb >= ta and sb < tz group by all), bs as (select *, row_number() over (partition by fold order by mean desc, candidate) as k from tn where n >= 10 and fold in (select fold from fo)),
ts as (select fold, candidate, count(*) as test_n, {qz('(' + qz('sum(net)', 4) + ') / count(*)', 4)} as test_mean from mt join fo on sb >= a and sb < z group by all)
select cast(bs.fold as integer) as fold, bs.candidate, n, mean, coalesce(test_n, 0) as test_n, test_mean from bs left join ts using (fold, candidate) where k = 1""",
}
QUERIES = {f.__name__: f for f in (sim17_pressure_events, lab10_quote_pressure, sim03_entries, sim04_exits, sim05_episodes, lab03_sequences)}
