"""DuckDB statements for the queries of market.py."""

from __future__ import annotations

from tickloom.operators.classify import RELEVANCE, SESSIONS


def qz(x: str, n: int = 6) -> str:
    return f"floor(({x}) * {10**n} + 0.5) / {float(10**n)}"


Q = """q as materialized (select id, source, instrument, epoch_us(occurred_at) as us, bid, ask, (bid + ask) / 2 as mid, (ask - bid) / ((bid + ask) / 2) * 10000 as spread_bps from market_ticks
  where occurred_at is not null and bid > 0 and ask >= bid and source is not null and instrument is not null)"""
B5 = f"""{Q}, b as materialized (select source, instrument, cast(floor(us / 300000000) as bigint) * 300000000 as bar_us, first(us order by us, id) as open_us, first(bid order by us, id) as open_bid, first(ask order by us, id) as open_ask,
  first(mid order by us, id) as open, max(mid) as high, min(mid) as low, last(mid order by us, id) as close, count(*) as tick_count from q group by all)"""
S1 = f"""{Q}, c as (select *, cast(floor(us / 1000000) as bigint) * 1000000 as bar_us from q),
l as (select *, lag(bid) over w as pb, lag(ask) over w as pa from c window w as (partition by source, instrument, bar_us order by us, id)),
s as materialized (select source, instrument, bar_us, first(us order by us, id) as open_us, first(bid order by us, id) as open_bid, first(ask order by us, id) as open_ask, first(mid order by us, id) as open_mid,
  last(bid order by us, id) as bid, last(ask order by us, id) as ask, last(mid order by us, id) as mid, count(*) as tick_count, cast(sum(case when bid <> pb or ask <> pa then 1 else 0 end) as bigint) as quote_change_count from l group by source, instrument, bar_us)"""
W = "partition by source, instrument order by bar_us"
NEWS = """n as materialized (select event_key, received, t, instrument, reaction_eligible from (select event_key, epoch_us(received_at) as received, epoch_us(occurred_at) as t, instrument, reaction_eligible,
  row_number() over (partition by event_key order by received_at, occurred_at, instrument) as k from news_events where occurred_at is not null and instrument is not null) where k = 1)"""
I = f"{Q}, i as materialized (select instrument, us, arg_max(mid, id) as mid, max(id) as id from q group by instrument, us)"

_STATE = f"""{S1}, p as (select source, instrument, bar_us, mid, max(mid) over r as hi, min(mid) over r as lo from s window r as ({W} range between 300000000 preceding and 1 preceding)),
st as (select source, instrument, bar_us, case when (mid / hi - 1) * 10000 >= 1 then 1 when (lo / mid - 1) * 10000 >= 1 then -1 else 0 end as side from p),
e as materialized (select source, instrument, bar_us, side from (select *, lag(side) over w as ps, lag(bar_us) over w as pt from st window w as ({W})) where side <> 0 and (pt is null or bar_us - pt > 60000000 or side <> ps))"""


def _out(h: int) -> str:
    return f"""{S1}, a as (select *, bar_us - lag(bar_us) over ({W}) as age from s), g as materialized (select *, sum(case when age > 5000000 then 1 else 0 end) over ({W} rows unbounded preceding) as seg from a),
x as materialized (select a.*, b.open_us as x_us, b.open_bid as x_bid, b.open_ask as x_ask, b.seg as x_seg from g a asof left join g b on a.source = b.source and a.instrument = b.instrument and a.open_us + {h}000000 <= b.open_us),
p as materialized (select x.source, x.instrument, x.bar_us, max(y.open_bid) as bh, min(y.open_bid) as bl, max(y.open_ask) as ah, min(y.open_ask) as al from x join g y on x.source = y.source and x.instrument = y.instrument and y.open_us between x.open_us and x.x_us
  where x.x_us is not null and x.x_us <= x.open_us + {h + 5}000000 group by all),
d as (select d.source, d.instrument, d.bar_us, d.seg, d.bar_us + 1050000 as due, e.bar_us as e_bar, e.open_us as e_us, e.open_bid as eb, e.open_ask as ea, e.seg as e_seg, e.x_us, e.x_bid, e.x_ask, e.x_seg
  from g d asof left join x e on d.source = e.source and d.instrument = e.instrument and d.bar_us + 1050000 <= e.open_us),
v as (select d.*, p.bh, p.bl, p.ah, p.al, coalesce(d.e_us - d.due <= 5000000 and d.e_seg = d.seg and d.x_seg = d.e_seg and d.x_us <= d.e_us + {h + 5}000000, false) as valid
  from d left join p on d.source = p.source and d.instrument = p.instrument and d.e_bar = p.bar_us)"""


def _when(x: str) -> str:
    return f"case when valid then {qz(x)} end"


_SESSION = "case " + " ".join(f"when h >= {first} then '{name}'" for first, name in reversed(SESSIONS)) + " end"
_REASONS = "concat_ws(',', " + ", ".join(f"case when regexp_matches(t, '{'|'.join(words)}') then '{name}' end" for name, words in RELEVANCE.items()) + ")"
_FOUND = " + ".join(f"cast(regexp_matches(t, '{'|'.join(words)}') as integer)" for words in RELEVANCE.values())

ORACLE = {
    "agg01_second_bars": f"with {S1} select * exclude (open_mid) from s",
    "agg02_five_minute_bars": f"with {B5} select * from b",
    "agg04_completed_bars": f"""with {B5}, m as (select source, instrument, k, lag(c) over (partition by source, instrument order by k) as m15_close from (select source, instrument, floor(bar_us / 900000000) as k, last(close order by bar_us) as c from b group by all)),
h as (select source, instrument, k, lag(c) over (partition by source, instrument order by k) as h1_close from (select source, instrument, floor(bar_us / 3600000000) as k, last(close order by bar_us) as c from b group by all))
select b.source, b.instrument, b.bar_us, m15_close, h1_close from b join m on b.source = m.source and b.instrument = m.instrument and m.k = floor(bar_us / 900000000) join h on b.source = h.source and b.instrument = h.instrument and h.k = floor(bar_us / 3600000000)""",
    "win01_second_features": f"""with {S1}, f as (select *, (ask - bid) / mid * 10000 as sp, lag(bar_us) over ({W}) as pu, mid / lag(mid) over ({W}) - 1 as step from s),
g as (select *, case when count(*) over r = 0 then 0.0 else sqrt(greatest(sum(step * step) over (w range between 60000000 preceding and current row) - coalesce(first_value(step * step) over r, 0.0), 0.0) / count(*) over r) end as vol, median(sp) over (w range between 60000000 preceding and 1 preceding) as med, avg(tick_count) over (w range between 60000000 preceding and 1 preceding) as rate,
  {", ".join(f"last_value(mid) over (w range between 61000000 preceding and {h}000000 preceding) as m{h}" for h in (1, 5, 30, 60))} from f window w as ({W}), r as (w range between 60000000 preceding and 1 preceding))
select source, instrument, bar_us, {qz('vol', 8)} as realized_volatility, {qz('mid / open_mid - 1', 8)} as intrasecond_return, {qz('case when coalesce(med, sp) = 0 then 1.0 else sp / coalesce(med, sp) end', 8)} as spread_shock_ratio, {qz('coalesce(tick_count / rate, 1.0)', 8)} as tick_intensity_ratio,
  {", ".join(f"{qz(f'mid / m{h} - 1', 8)} as return_{h}s" for h in (1, 5, 30, 60))}, (bar_us - pu) / 1000000 as age_s, coalesce((bar_us - pu) / 1000000 > 5, false) as is_gap_start from g""",
    "win03_prior_levels": f"with {S1} select source, instrument, bar_us, " + ", ".join(f"{f}(mid) over ({W} range between {s}000000 preceding and 1 preceding) as prior_{n}_{s}s" for s in (60, 300, 900, 3600) for n, f in (("high", "max"), ("low", "min"))) + " from s",
    "win04_reset_average": f"""with {S1}, a as (select *, bar_us - lag(bar_us) over ({W}) as age, cast(floor(bar_us / 86400000000) as bigint) as day, floor((bar_us % 86400000000) / 3600000000) as h from s),
k as (select *, {_SESSION} as session from a), r as (select *, sum(case when age > 300000000 then 1 else 0 end) over (partition by source, instrument, day, session order by bar_us rows unbounded preceding) as run from k)
select source, instrument, bar_us, session, {qz('(mid / (sum(mid * tick_count) over v / sum(tick_count) over v) - 1) * 10000', 4)} as distance_bps from r window v as (partition by source, instrument, day, session, run order by bar_us rows unbounded preceding)""",
    "win05_session_range": f"""with {B5}, x as (select *, floor(bar_us / 86400000000) as day, floor((bar_us % 86400000000) / 3600000000) as h from b), r as (select source, instrument, day, max(high) as rh, min(low) as rl from x where h < 8 group by all)
select x.source, x.instrument, x.bar_us, case when h >= 8 then rh end as range_high, case when h >= 8 then rl end as range_low from x left join r using (source, instrument, day)""",
    "win06_bar_trend": f"""with {B5}, s as (select *, close - lag(close) over ({W}) as step, coalesce(pow(close / lag(close) over ({W}) - 1, 2), 0) as sq from b),
t as (select *, case when count(*) over f > 1 then sqrt(greatest(sum(sq) over f - first_value(sq) over f, 0) / (count(*) over f - 1)) else 0 end as vol, first_value(open) over f as fo, first_value(close) over f as fc, sum(abs(step)) over f - coalesce(abs(first_value(step) over f), 0) as dist, max(high) over p as prior_high, min(low) over p as prior_low
  from s window f as ({W} range between 3600000000 preceding and current row), p as ({W} range between 3600000000 preceding and 1000000 preceding))
select source, instrument, bar_us, {qz('close / fo - 1')} as trend_return, {qz('coalesce(abs(close - fc) / nullif(dist, 0), 0)')} as efficiency, {qz('vol')} as volatility, prior_high, prior_low from t""",
    "win07_segments": f"with {S1}, a as (select *, bar_us - lag(bar_us) over ({W}) as age from s) select source, instrument, bar_us, cast(sum(case when age > 30000000 then 1 else 0 end) over ({W} rows unbounded preceding) as bigint) as segment from a",
    "win08_episode_starts": f"with {_STATE} select * from e",
    "win11_atr": f"""with {B5}, p as (select *, lag(close) over ({W}) as pc from b), t as (select *, case when pc is not null then greatest(high - low, abs(high - pc), abs(low - pc)) end as tr from p)
select source, instrument, bar_us, case when count(tr) over w = 6 then {qz('avg(tr) over w')} end as atr from t window w as ({W} rows 5 preceding)""",
    "win10_ema": f"""with {B5}, l as (select source, instrument, bar_us, """ + ", ".join(f"lag(close, {k}) over w as c{k}" for k in range(6)) + f""" from b window w as ({W}))
select source, instrument, bar_us, {qz(' + '.join(f'c{k} * {(2 / 7) * (5 / 7) ** k if k < 5 else (5 / 7) ** 5!r}' for k in range(6)))} as ema from l""",
    "win13_fair_value_gaps": f"""with {B5}, l as (select *, lag(high, 2) over w as h2, lag(low, 2) over w as l2 from b window w as ({W}))
select source, instrument, bar_us, case when low > h2 then 1 else -1 end as side, case when low > h2 then h2 else high end as zone_low, case when low > h2 then low else l2 end as zone_high from l where low > h2 or high < l2""",
    "win14_contiguous": f"with {B5} select source, instrument, bar_us, coalesce(bar_us - lag(bar_us, 2) over ({W}) = 600000000, false) as whole from b",
    "win17_shocks": f"""with {B5}, r as (select *, close / lag(close) over ({W}) - 1 as ret, row_number() over ({W}) as i from b), j as (select a.source, a.instrument, a.i, a.bar_us, a.ret, median(abs(z.ret)) as m, count(z.ret) as n from r a join r z on a.source = z.source and a.instrument = z.instrument and z.i between a.i - 12 and a.i - 1 group by all),
k as (select j.source, j.instrument, j.bar_us, j.ret, j.m, median(abs(abs(z.ret) - j.m)) as d from j join r z on j.source = z.source and j.instrument = z.instrument and z.i between j.i - 12 and j.i - 1 where j.n = 12 group by all)
select source, instrument, bar_us, {qz('ret', 9)} as bar_return, cast(sign(ret) as integer) as side from k where d > 0 and abs(ret) > m + 3.0 * 1.4826 * d""",
    "win18_failed_moves": f"""with {B5}, l as (select *, lag(close) over w as p, lead(close, 3) over w as a, lead(bar_us, 3) over w - lag(bar_us) over w as span from b window w as ({W}))
select source, instrument, bar_us, cast(sign(close - p) as integer) as side, {qz('(close - a) / (close - p)')} as retraced from l where span = 1200000000 and close <> p and (close - a) / (close - p) >= 0.5""",
    "win19_sweeps": f"""with {B5}, l as (select *, max(high) over w as h, min(low) over w as l, count(*) over w as n from b window w as ({W} rows between 12 preceding and 1 preceding))
select source, instrument, bar_us, case when high > h and close < h then -1 else 1 end as side from l where n = 12 and ((high > h and close < h) or (low < l and close > l))""",
    "win21_gaps": f"with {S1}, z as (select *, lag(bar_us) over w as pt, lag(mid) over w as pm from s window w as ({W})) select source, instrument, pt as gap_start_us, bar_us as gap_end_us, {qz('(mid / pm - 1) * 10000')} as jump_bps from z where bar_us - pt > 120000000",
    "win22_drawdown": f"""with {B5}, s as (select *, {qz(f'coalesce(close / lag(close) over ({W}) - 1, 0)', 7)} as step from b), e as (select *, sum(step) over ({W} rows unbounded preceding) as eq from s),
p as (select *, greatest(0.0, max(eq) over ({W} rows unbounded preceding)) as peak from e) select source, instrument, {qz('max(peak - eq)', 5)} as max_drawdown, {qz('max(peak)', 5)} as peak from p group by source, instrument""",
    "win23_spacing": f"with {S1}, z as (select source, instrument, bar_us - lag(bar_us) over ({W}) as g from s) select source, instrument, min(g) / 1000000 as spacing_s from z where g > 0 group by source, instrument",
    "win24_first_edges": f"""with {B5}, t as (select *, max(high) over p as ph, min(low) over p as pl from b window p as ({W} range between 3600000000 preceding and 1000000 preceding)),
s as (select source, instrument, bar_us, cast(floor(bar_us / 86400000000) as bigint) as day, case when (close / ph - 1) * 10000 >= 1 then 1 when (pl / close - 1) * 10000 >= 1 then -1 else 0 end as side from t),
e as (select *, coalesce(lag(side) over (partition by source, instrument, day order by bar_us), 0) as ps from s), r as (select *, row_number() over (partition by source, instrument, day order by bar_us) as k from e where side <> 0 and ps = 0)
select source, instrument, day, bar_us, side from r where k = 1""",
    "sim09_cooldown": f"""with recursive {_STATE}, o as (select *, row_number() over ({W}) as i from e), f(source, instrument, i, last, bar_us, side, keep) as (
  select source, instrument, i, bar_us, bar_us, side, true from o where i = 1
  union all select o.source, o.instrument, o.i, case when o.bar_us >= f.last + 900000000 then o.bar_us else f.last end, o.bar_us, o.side, o.bar_us >= f.last + 900000000 from f join o on o.source = f.source and o.instrument = f.instrument and o.i = f.i + 1)
select source, instrument, bar_us, side from f where keep""",
    "sim01_outcomes": f"""with {_out(30)} select source, instrument, bar_us, valid, {_when('(e_us - due) / 1000000')} as entry_delay_s, {_when('(x_us - e_us - 30000000) / 1000000')} as exit_delay_s,
  {_when('((x_bid + x_ask) / (eb + ea) - 1) * 10000')} as long_gross_bps, {_when('((eb + ea) / (x_bid + x_ask) - 1) * 10000')} as short_gross_bps, {_when('(x_bid / ea - 1) * 10000')} as long_net_bps, {_when('(eb / x_ask - 1) * 10000')} as short_net_bps,
  {_when('(bh / ea - 1) * 10000')} as long_mfe_bps, {_when('(bl / ea - 1) * 10000')} as long_mae_bps, {_when('(eb / al - 1) * 10000')} as short_mfe_bps, {_when('(eb / ah - 1) * 10000')} as short_mae_bps from v""",
    "sim02_bar_outcomes": f"""with {B5}, l as (select *, lead(open_bid, 1) over w as eb, lead(open_ask, 1) over w as ea, lead(open_bid, 3) over w as xb, lead(open_ask, 3) over w as xa, coalesce(lead(bar_us, 3) over w - bar_us = 900000000, false) as valid, lead(high, 1) over w as h1, lead(high, 2) over w as h2 from b window w as ({W}))
select source, instrument, bar_us, valid, {_when('(xb / ea - 1) * 10000')} as long_net_bps, {_when('(eb / xa - 1) * 10000')} as short_net_bps, {_when('(greatest(h1, h2) / ((eb + ea) / 2) - 1) * 10000')} as mfe_bps, cast(case when valid then case when h1 >= h2 then 0 else 300000000 end end as bigint) as to_mfe_us from l""",
    "join16_earliest": f"with {NEWS} select event_key, received, t from n",
    "join04_asof_backward": f"with {I}, {NEWS} select event_key, n.instrument, n.t, i.us as r_t, i.id as r_id, i.mid as r_mid from n asof left join i on n.instrument = i.instrument and n.t >= i.us",
    "join05_asof_forward": f"""with {I}, {NEWS}, j as (select event_key, n.instrument, n.t, i.us, i.id, i.mid from n asof left join i on n.instrument = i.instrument and n.t <= i.us)
select event_key, instrument, t, case when us - t <= 60000000 then us end as r_t, case when us - t <= 60000000 then id end as r_id, case when us - t <= 60000000 then mid end as r_mid from j""",
    "join18_reactions": f"""with {I}, {NEWS}, b as (select event_key, n.instrument, n.t, i.us as before_t, i.mid as before_mid from n asof join i on n.instrument = i.instrument and n.t >= i.us where reaction_eligible),
w as (select b.*, window_s, t + window_s * 1000000 as target from b join (values (5), (30), (60), (300), (900)) v(window_s) on true where t - before_t <= 60000000),
a as (select w.*, i.us as after_t, i.mid as after_mid from w asof join i on w.instrument = i.instrument and w.target <= i.us)
select event_key, window_s, before_t, after_t, {qz('(after_mid / before_mid - 1) * 10000')} as return_bps from a where after_t - target <= 60000000""",
    "join13_path_extrema": f"with {Q}, {NEWS} select event_key, count(*) as n, max(bid) as high_bid, min(ask) as low_ask from n join q on n.instrument = q.instrument and q.us >= n.t and q.us <= n.t + 60000000 group by event_key",
    "join19_near_news": f"with {_STATE}, {NEWS} select source, e.instrument, bar_us, side from e where exists (select 1 from n where n.instrument = e.instrument and e.bar_us between n.t - 900000000 and n.t + 1800000000)",
    "join20_overlaps": f"""with {S1}, {NEWS}, z as (select *, lag(bar_us) over ({W}) as pt from s), g as (select source, instrument, pt as gap_start_us, bar_us as gap_end_us from z where bar_us - pt > 120000000)
select source, g.instrument, gap_start_us, event_key from g join n on n.instrument = g.instrument and gap_start_us < n.t + 900000000 and n.t < gap_end_us""",
    "join22_missing_bars": f"""with {B5}, r as (select source, instrument, floor(bar_us / 86400000000) as day, min(bar_us) as a, max(bar_us) as z from b group by all), w as (select source, instrument, unnest(range(a, z + 1, 300000000)) as bar_us from r)
select source, instrument, bar_us from w anti join b using (source, instrument, bar_us)""",
    "agg34_feed_report": f"""with {Q}, g as (select source, max(gap) / 1000000 as longest_gap_s from (select source, us - lag(us) over (partition by source, instrument order by us) as gap from q) group by source)
select source, count(*) as n, {qz('quantile_cont(spread_bps, 0.5)')} as p50, {qz('quantile_cont(spread_bps, 0.95)')} as p95, {qz('quantile_cont(spread_bps, 0.99)')} as p99, max(longest_gap_s) as longest_gap_s from q join g using (source) group by source""",
    "agg36_news_quality": "select event_type, timing_quality, count(*) as n, count(distinct event_key) as keys, count(*) filter (where instrument is null) as without_instrument from news_events group by all",
    "prj02_sessions": f"with {Q}, x as (select floor((us % 86400000000) / 3600000000) as h, case when spread_bps < 1 then 'low' when spread_bps < 3 then 'medium' else 'high' end as spread_level from q) select {_SESSION} as session, spread_level, count(*) as n from x group by all",
    "prj19_relevance": f"with x as (select distinct event_key, headline, lower(coalesce(headline, '')) as t from news_events) select event_key, {_REASONS} as reasons, case when ({_FOUND}) = 0 then 0.0 else floor(least(1.0, least(1.0, 0.25 + 0.18 * ({_FOUND})) + case when regexp_matches(t, 'gold|xau|bullion') then 0.25 else 0 end) * 1000 + 0.5) / 1000.0 end as score from x",
    "prj26_quality_issues": f"""with {Q}, x as (select q.*, m.source_sequence as n from q join market_ticks m using (id)), y as (select *, row_number() over (partition by source, instrument, us, n order by id) as k, us - lag(us) over (partition by source, instrument order by us, id) as g from x)
select id, 'duplicate' as issue from y where k > 1 and n is not null union all select id, 'wide_spread' from y where spread_bps > 20 union all select id, 'time_gap' from y where g > 300000000""",
    "breakout_report": f"""with {_out(30)}, p5 as (select source, instrument, bar_us, mid, max(mid) over r as hi, min(mid) over r as lo from s window r as ({W} range between 300000000 preceding and 1 preceding)),
st as (select source, instrument, bar_us, case when (mid / hi - 1) * 10000 >= 1 then 1 when (lo / mid - 1) * 10000 >= 1 then -1 else 0 end as side from p5),
e as (select * from (select *, lag(side) over w as ps, lag(bar_us) over w as pt from st window w as ({W})) where side <> 0 and (pt is null or bar_us - pt > 60000000 or side <> ps)),
j as (select e.instrument, e.side, case when valid then case when side > 0 then (x_bid / ea - 1) * 10000 else (eb / x_ask - 1) * 10000 end end as net from e join v using (source, instrument, bar_us))
select instrument, side, count(*) as episodes, count(net) as valid, {qz('avg(net)', 4)} as mean_net_bps from j group by instrument, side""",
}
