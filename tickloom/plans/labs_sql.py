"""DuckDB statements for the research queries of labs.py and the folds of market.py."""

from __future__ import annotations

from tickloom.plans.market_sql import _STATE, B5, S1, Q, W, qz

SER = "partition by source, instrument"

# the kept episode starts of sim09_cooldown; statements with it begin with "with recursive"
KEPT = f"""{_STATE}, o as (select *, row_number() over ({W}) as i from e), kf(source, instrument, i, last, bar_us, side, keep) as (
  select source, instrument, i, bar_us, bar_us, side, true from o where i = 1
  union all select o.source, o.instrument, o.i, case when o.bar_us >= kf.last + 900000000 then o.bar_us else kf.last end, o.bar_us, o.side, o.bar_us >= kf.last + 900000000 from kf join o on o.source = kf.source and o.instrument = kf.instrument and o.i = kf.i + 1),
ep as materialized (select source, instrument, side, bar_us + 1000000 as start_us from kf where keep)"""


def path(reach_us: int) -> str:
    """pth: the quotes of each episode's series within its reach, with their place rn."""
    return f"""pth as materialized (select ep.*, q.us, q.id, q.bid, q.ask, case when side > 0 then q.ask else q.bid end as into_, case when side > 0 then q.bid else q.ask end as out_, row_number() over (partition by ep.source, ep.instrument, start_us order by q.us, q.id) as rn
  from ep join q on ep.source = q.source and ep.instrument = q.instrument and q.us between start_us and start_us + {reach_us})"""


EK = "source, instrument, start_us"


def summary(keys: str, value: str, digits: int = 4) -> str:
    v = value
    return f"""{keys}, count({v}) as n, {qz(f'avg({v})', digits)} as mean, {qz(f'median({v})', digits)} as median, {qz(f'avg(case when {v} > 0 then 1.0 else 0.0 end)', digits)} as win_rate,
  {qz(f'sum(case when {v} > 0 then {v} else 0 end) / nullif(sum(case when {v} < 0 then -{v} else 0 end), 0)', digits)} as profit_factor"""


_LAB07 = f"""with recursive {KEPT}, {path(960_000_000)},
f as (select {EK}, any_value(side) as side, min(us) as f_us, any_value((bid + ask) / 2) filter (where rn = 1) as mid from pth group by {EK}),
g as (select * from (values (0), (5), (15), (30)) w(wait) cross join (values (0.0, '0'), (0.5, '0.5'), (1.0, '1')) p(pull, pn) where (wait = 0) = (pull = 0)),
en as materialized (select p.source, p.instrument, p.start_us, wait, pull, pn, min(p.rn) as e_rn from pth p join f using ({EK}) cross join g
  where p.us >= f_us + 50000 and p.us <= f_us + (case when wait > 0 then wait else 2 end) * 1000000 and (pull = 0 or p.side * (mid - into_) / mid * 10000 >= pull) group by all),
x as materialized (select en.*, a.us as e_us, p.rn, p.us, p.side * (p.out_ - a.into_) / a.into_ * 10000 as gross from en join pth a on a.source = en.source and a.instrument = en.instrument and a.start_us = en.start_us and a.rn = e_rn
  join pth p on p.source = en.source and p.instrument = en.instrument and p.start_us = en.start_us and p.rn >= e_rn),
hs as (select {EK}, wait, pull, stop, min(rn) filter (where gross <= -stop) as s_rn from x cross join (values (4), (8), (12)) v(stop) group by all),
ht as (select {EK}, wait, pull, target, min(rn) filter (where gross >= target) as t_rn from x cross join (values (4), (8), (12)) v(target) group by all),
hh as (select {EK}, wait, pull, hold, min(rn) filter (where us >= e_us + hold * 1000000) as h_rn from x cross join (values (60), (180), (300), (900)) v(hold) group by all),
d as (select en.*, stop, target, hold, s_rn, t_rn, h_rn, least(s_rn, t_rn, h_rn) as rn from en join hs using ({EK}, wait, pull) join ht using ({EK}, wait, pull) join hh using ({EK}, wait, pull)),
r as (select 'w' || d.wait || '_p' || d.pn || '_h' || hold || '_s' || stop || '_t' || target as policy, case when d.s_rn = d.rn then 'stop' when d.t_rn = d.rn then 'target' else 'time' end as reason, x.gross as net
  from d join x on x.source = d.source and x.instrument = d.instrument and x.start_us = d.start_us and x.wait = d.wait and x.pull = d.pull and x.rn = d.rn)
select {summary('policy, reason', 'net')} from r group by policy, reason"""

_LAB11 = f"""with recursive {KEPT}, {path(932_000_000)},
v as (select *, min(us) over k as due from pth cross join (values ('single_fixed', false, false, 300), ('single_runner', false, true, 900), ('staged_fixed', true, false, 300), ('staged_runner', true, true, 900)) t(variant, staged, runner, hold) window k as (partition by variant, {EK})),
e0 as (select *, min(rn) filter (where us between due and due + 2000000) over k as e_rn from v window k as (partition by variant, {EK})),
e1 as (select *, max(into_) filter (where rn = e_rn) over k as e_into, max(us) filter (where rn = e_rn) over k as e_us from e0 window k as (partition by variant, {EK})),
m as (select *, side * (out_ - e_into) / e_into * 10000 as move from e1 where rn >= e_rn),
a0 as (select *, min(rn) filter (where staged and move <= -4) over k as r1 from m window k as (partition by variant, {EK})),
a1 as (select *, max(into_) filter (where rn = r1) over k as p1, min(rn) filter (where staged and move <= -8 and rn > r1) over k as r2 from a0 window k as (partition by variant, {EK})),
a2 as (select *, max(into_) filter (where rn = r2) over k as p2 from a1 window k as (partition by variant, {EK})),
b as (select *, 1 + cast(coalesce(rn >= r1, false) as integer) + cast(coalesce(rn >= r2, false) as integer) as tickets,
  move + case when rn >= r1 then side * (out_ - p1) / p1 * 10000 else 0 end + case when rn >= r2 then side * (out_ - p2) / p2 * 10000 else 0 end as total from a2),
cv as (select *, total / tickets as value from b),
pk as (select *, max(value) over (partition by variant, {EK} order by rn rows unbounded preceding) as peak, min(rn) filter (where runner and value >= 8) over (partition by variant, {EK}) as h_rn from cv),
hv as (select *, max(value) filter (where rn = h_rn) over (partition by variant, {EK}) as h_value,
  case when value <= -12 then 'basket_stop' when us - e_us >= 15000000 and move <= -6 then 'quick_failure' end as lost, case when rn >= h_rn and peak - value >= 6 then 'trailing' when us >= e_us + hold * 1000000 then 'time' end as won from pk),
dn as (select *, min(rn) filter (where lost is not null or won is not null) over (partition by variant, {EK}) as d_rn from hv),
r as (select variant, coalesce(lost, won) as reason, coalesce(case when lost is null then rn >= h_rn else rn > h_rn end, false) as partial, h_value, value from dn where rn = d_rn),
n as (select variant, reason, partial, case when partial then (h_value + value) / 2 else value end as net from r)
select {summary('variant, reason, partial', 'net')} from n group by variant, reason, partial"""

# u: ticks of a series with one row per instant, the greatest id
_B5U = f"{B5}, u as materialized (select source, instrument, us, arg_max(bid, id) as bid, arg_max(ask, id) as ask from q group by all)"
_SIGNALS = f"""{_B5U}, l as (select *, {", ".join(f"lag(close, {k}) over w as c{k}" for k in range(6))}, close - lag(close) over w as step, count(*) over w as k from b window w as ({W})),
t as (select *, {' + '.join(f'c{k} * {(2 / 7) * (5 / 7) ** k if k < 5 else (5 / 7) ** 5!r}' for k in range(6))} as ema, close / first_value(open) over f - 1 as ret, abs(close - first_value(close) over f) as net, sum(abs(step)) over f - coalesce(abs(first_value(step) over f), 0) as dist
  from l window f as ({W} range between 1800000000 preceding and current row)),
ac as (select *, close > ema and ret > 0 and coalesce(net / nullif(dist, 0), 0) > 0.2 as on_ from t where ema is not null),
ed as (select source, instrument, bar_us + 300000000 as us, 1 as side from (select *, coalesce(lag(on_) over ({W}), false) as was from ac) where on_ and not was),
en as (select ed.*, u.us as e_t, u.bid as e_bid, u.ask as e_ask from ed asof join u on ed.source = u.source and ed.instrument = u.instrument and ed.us <= u.us where u.us - ed.us <= 60000000),
ex as materialized (select en.*, u.us as x_t, u.bid as x_bid, u.ask as x_ask, row_number() over (partition by en.source, en.instrument order by en.us) as i from en asof join u on en.source = u.source and en.instrument = u.instrument and en.e_t + 900000000 <= u.us),
gr(source, instrument, i, until, keep) as (select source, instrument, i, x_t, true from ex where i = 1
  union all select ex.source, ex.instrument, ex.i, case when ex.us >= gr.until then ex.x_t else gr.until end, ex.us >= gr.until from gr join ex on ex.source = gr.source and ex.instrument = gr.instrument and ex.i = gr.i + 1),
sg as materialized (select ex.source, ex.instrument, ex.us, side, e_t as entered_us, x_t as exited_us, x_t - (e_t + 900000000) <= 60000000 as boundary_valid, {qz('(x_bid / e_ask - 1) * 10000 * side')} as net_bps from ex join gr using (source, instrument, i) where keep)"""

_LAB17 = f"""with recursive {_SIGNALS}, lt as (select sg.*, v.lat, entered_us + v.lat as e_due, exited_us + v.lat as x_due from sg cross join (values (50000), (250000), (1000000), (5000000), (60000000)) v(lat)),
le as (select lt.*, case when u.us - e_due <= 30000000 then u.us end as le_t, u.ask as le_ask from lt asof left join u on lt.source = u.source and lt.instrument = u.instrument and lt.e_due <= u.us),
lx as (select le.*, case when u.us - x_due <= 30000000 then u.us end as lx_t, u.bid as lx_bid from le asof left join u on le.source = u.source and le.instrument = u.instrument and le.x_due <= u.us),
r as (select cast(lat as bigint) as latency_us, case when le_t is null then 'no_entry_quote' when lx_t is null then 'no_exit_quote' end as reason, case when le_t is not null and lx_t is not null then (lx_bid / le_ask - 1) * 10000 end as g from lx)
select latency_us, reason, count(*) as n, {qz('avg(g)', 4)} as mean_bps from r group by all"""

_SIM08 = f"""with recursive {KEPT}, tk as materialized (select source, instrument, us, id, bid, ask, row_number() over ({SER} order by us, id) as rn, count(*) over ({SER}) as last_rn, min(us) over ({SER}) as first_us from q),
op as (select ep.source, ep.instrument, start_us as asked, side, min(rn) as o_rn from ep join tk on ep.source = tk.source and ep.instrument = tk.instrument and tk.us >= start_us + 250000 where start_us >= first_us group by all),
pl as (select op.*, tk.us as o_us, case when side > 0 then ask else bid end as entry from op join tk on op.source = tk.source and op.instrument = tk.instrument and tk.rn = o_rn qualify row_number() over (partition by op.source, op.instrument, o_rn order by asked) = 1),
lm as (select *, entry - case when side > 0 then 0.5 else 1.0 end as low, entry + case when side > 0 then 1.0 else 0.5 end as high from pl),
hit as (select lm.source, lm.instrument, o_rn, min(tk.rn) as x_rn from lm join tk on lm.source = tk.source and lm.instrument = tk.instrument and tk.rn > o_rn and (case when side > 0 then bid else ask end <= low or case when side > 0 then bid else ask end >= high) group by all),
sp as materialized (select lm.*, x_rn, coalesce(x_rn, 1000000000000) as until, row_number() over (partition by lm.source, lm.instrument order by lm.o_rn) as i from lm left join hit using (source, instrument, o_rn)),
gr(source, instrument, i, until, keep) as (select source, instrument, i, until, true from sp where i = 1
  union all select sp.source, sp.instrument, sp.i, case when sp.o_rn >= gr.until then sp.until else gr.until end, sp.o_rn >= gr.until from gr join sp on sp.source = gr.source and sp.instrument = gr.instrument and sp.i = gr.i + 1),
r as (select sp.*, tk.us as closed_us, case when side > 0 then bid else ask end as exit from sp join gr using (source, instrument, i) join tk on tk.source = sp.source and tk.instrument = sp.instrument and tk.rn = coalesce(x_rn, last_rn) where keep)
select source, instrument, o_us as opened_us, side, entry, closed_us, exit, case when x_rn is null then 'end' when (side > 0 and exit <= low) or (side < 0 and exit >= high) then 'stop' else 'target' end as reason, {qz('side * (exit / entry - 1) * 10000')} as net_bps from r"""

_JOIN17 = """with recursive r as (select o_custkey % 97 as symbol, epoch_us(o_orderdate) as t, cast(o_orderkey as varchar) as k, o_custkey % 2 as odd from orders),
p as materialized (select a.symbol, a.k as lk, b.k as rk, b.t - a.t as lag, row_number() over (partition by a.symbol order by abs(b.t - a.t), a.t, a.k, b.k) as i from r a join r b on a.symbol = b.symbol and a.odd = 0 and b.odd = 1 and abs(b.t - a.t) <= 172800000000),
g(symbol, i, used, lk, rk, lag, taken) as (
  select symbol, i, ['l' || lk, 'r' || rk], lk, rk, lag, true from p where i = 1
  union all select p.symbol, p.i, case when list_has_any(used, ['l' || p.lk, 'r' || p.rk]) then used else used || ['l' || p.lk, 'r' || p.rk] end, p.lk, p.rk, p.lag, not list_has_any(used, ['l' || p.lk, 'r' || p.rk]) from g join p on p.symbol = g.symbol and p.i = g.i + 1)
select symbol, lk as left_ticket, rk as right_ticket, lag as lag_us from g where taken"""

_JOB01 = """with f as (select k + 1 as fold, epoch_us(timestamp '1994-01-01') + (365 + 90 * k) * 86400000000 + 60000000 + 60 * 86400000000 + 120000000 as a from range(0, 40) r(k)),
w as (select fold, a, a + 90 * 86400000000 as z from f where a + 90 * 86400000000 <= epoch_us(timestamp '1998-01-01'))"""


def _out(h: int, entry: int, exit_: int, gap: int) -> str:
    """v: outcomes of second bars at a horizon under wider delays and gaps, with what they need only."""
    return f"""a{h} as (select *, bar_us - lag(bar_us) over ({W}) as age from s), g{h} as materialized (select *, sum(case when age > {gap}000000 then 1 else 0 end) over ({W} rows unbounded preceding) as seg from a{h}),
x{h} as materialized (select a.*, b.open_us as x_us, b.open_bid as x_bid, b.open_ask as x_ask, b.seg as x_seg from g{h} a asof left join g{h} b on a.source = b.source and a.instrument = b.instrument and a.open_us + {h}000000 <= b.open_us),
d{h} as (select d.source, d.instrument, d.bar_us, d.seg, d.bar_us + 1050000 as due, e.open_us as e_us, e.open_bid as eb, e.open_ask as ea, e.seg as e_seg, e.x_us, e.x_bid, e.x_ask, e.x_seg
  from g{h} d asof left join x{h} e on d.source = e.source and d.instrument = e.instrument and d.bar_us + 1050000 <= e.open_us),
v{h} as materialized (select source, instrument, bar_us, (x_bid / ea - 1) * 10000 as long_net, (eb / x_ask - 1) * 10000 as short_net from d{h} where coalesce(e_us - due <= {entry}000000 and e_seg = seg and x_seg = e_seg and x_us <= e_us + {h + exit_}000000, false))"""


FEATURES = f"""fe0 as (select *, (ask - bid) / mid * 10000 as sp, mid / lag(mid) over ({W}) - 1 as step from s),
fe as materialized (select source, instrument, bar_us, mid, tick_count, quote_change_count, sp, case when coalesce(median(sp) over r60, sp) = 0 then 1.0 else sp / coalesce(median(sp) over r60, sp) end as shock, coalesce(tick_count / avg(tick_count) over r60, 1.0) as intensity,
  case when count(*) over r60 = 0 then 0.0 else sqrt(greatest(sum(step * step) over c60 - coalesce(first_value(step * step) over r60, 0.0), 0.0) / count(*) over r60) end as vol,
  {", ".join(f"mid / last_value(mid) over (w range between 61000000 preceding and {h}000000 preceding) - 1 as r{h}" for h in (1, 5, 30, 60))}
  from fe0 window w as ({W}), r60 as (w range between 60000000 preceding and 1 preceding), c60 as (w range between 60000000 preceding and current row))"""

_SESSION = "case when h >= 21 then 'maintenance_or_late' when h >= 16 then 'new_york' when h >= 12 then 'london_new_york_overlap' when h >= 7 then 'london' else 'asia' end"
_COIN = "case when (instr('0123456789abcdef', substr(sha256(strftime(make_timestamp(bar_us), '%Y-%m-%dT%H:%M:%S') || '+00:00'), 2, 1)) - 1) % 2 = 1 then 1 else -1 end"
_LEVEL = lambda c: f"case when {c} < 0.8 then 'low' when {c} < 1.2 then 'medium' else 'high' end"

_LAB01 = f"""with recursive {S1}, {FEATURES}, {_out(30, 30, 30, 60)},
z as (select source, instrument, bar_us, unnest([{{'strategy': 'random', 'side': {_COIN}}}, {{'strategy': 'momentum', 'side': cast(sign(r60) as integer)}}, {{'strategy': 'reversion', 'side': -cast(sign(r60) as integer)}},
  {{'strategy': 'compression_breakout', 'side': case when r60 is null or r60 = 0 then 0 when intensity >= 1.5 and shock <= 1.5 and abs(r5) > greatest(vol, 1e-12) then cast(sign(r5) as integer) else 0 end}}]) as k from fe),
y as materialized (select source, instrument, bar_us, k.strategy as strategy, k.side as side from z where k.side <> 0),
nx as materialized (select a.source, a.instrument, a.strategy, a.bar_us, a.side, b.bar_us as nxt from y a asof left join y b on a.source = b.source and a.instrument = b.instrument and a.strategy = b.strategy and a.bar_us + 60000000 <= b.bar_us),
ch(source, instrument, strategy, bar_us, side, nxt) as (select * from nx where bar_us = (select min(bar_us) from y where y.source = nx.source and y.instrument = nx.instrument and y.strategy = nx.strategy)
  union all select nx.* from ch join nx on nx.source = ch.source and nx.instrument = ch.instrument and nx.strategy = ch.strategy and nx.bar_us = ch.nxt),
r as (select strategy, case when side > 0 then long_net else short_net end as net, floor((bar_us % 86400000000) / 3600000000) as h from ch join v30 using (source, instrument, bar_us)),
q1 as (select strategy, {_SESSION} as session, net from r)
select {summary('strategy, session', 'net')} from q1 group by strategy, session"""

_LAB02 = f"""with {_STATE}, {FEATURES}, {_out(30, 30, 30, 60)},
r as (select case when side > 0 then long_net else short_net end as net, {_SESSION} as session, {_LEVEL('shock')} as spread, {_LEVEL('intensity')} as activity from (select *, floor((bar_us % 86400000000) / 3600000000) as h from e join fe using (source, instrument, bar_us) join v30 using (source, instrument, bar_us))),
lv as (select unnest([{{'d': 'overall', 'l': 'all'}}, {{'d': 'session', 'l': session}}, {{'d': 'spread', 'l': spread}}, {{'d': 'activity', 'l': activity}}]) as k, net from r)
select {summary('k.d as dimension, k.l as level', 'net')} from lv group by k.d, k.l"""

_GRID = f"""with r0 as (select source, instrument, cast(floor(epoch_us(occurred_at) / 60000000) as bigint) as slot, epoch_us(occurred_at) as us, id, bid, ask from market_ticks where source is not null and instrument is not null and occurred_at is not null and bid is not null and ask is not null),
rd as materialized (select source, instrument, slot, max(us) as us, arg_max(bid, (us, id)) as bid, arg_max(ask, (us, id)) as ask from r0 group by all),
sp as (select distinct source, batch_no, instrument, cast(ceil(epoch_us(opened_at) / 60000000) as bigint) as first, cast(floor(epoch_us(closed_at) / 60000000) as bigint) - 1 as last from feed_sessions where source is not null and instrument is not null),
kn as (select sp.source, sp.instrument, sp.batch_no, rd.slot, rd.us, rd.bid, rd.ask from sp join rd on sp.source = rd.source and sp.instrument = rd.instrument and rd.slot between first - 1 and last + 1 where last >= first),
nb as (select *, lag(slot) over w as ps, lag(us) over w as pu, lag(bid) over w as pb, lag(ask) over w as pa, lead(slot) over w as ns, lead(us) over w as nu, lead(bid) over w as nbid, lead(ask) over w as na from kn window w as (partition by source, instrument, batch_no order by slot)),
cl as (select source, instrument, batch_no, slot, us, bid, ask, case when slot - ps <= 16 then pu end as pu, pb, pa, case when ns - slot <= 16 then nu end as nu, nbid, na, ns from nb),
dv as (select *, (bid - pb) / (us - pu) as b0, (nbid - bid) / (nu - us) as b1, (ask - pa) / (us - pu) as a0, (na - ask) / (nu - us) as a1, 2.0 * (nu - us) + (us - pu) as w0, (nu - us) + 2.0 * (us - pu) as w1 from cl),
sl as materialized (select source, instrument, batch_no, slot, us, bid, ask, {", ".join(f"case when pu is null and nu is null then 0.0 when pu is null then {c}1 when nu is null then {c}0 when {c}0 * {c}1 <= 0 then 0.0 else (w0 + w1) / (w0 / {c}0 + w1 / {c}1) end as d{c}" for c in "ba")} from dv),
gr as (select source, instrument, batch_no, unnest(range(first, last + 1)) as slot from sp where last >= first),
lf as (select gr.*, l.slot as ls, l.us as lu, l.bid as lb, l.ask as la, l.db as ldb, l.da as lda from gr asof left join sl l on gr.source = l.source and gr.instrument = l.instrument and gr.batch_no = l.batch_no and gr.slot >= l.slot),
rt as (select lf.*, r.slot as rs, r.us as ru, r.bid as rb, r.ask as ra, r.db as rdb, r.da as rda from lf asof left join sl r on lf.source = r.source and lf.instrument = r.instrument and lf.batch_no = r.batch_no and lf.slot < r.slot),
st as (select *, case when ls = slot then 'observed' when rs - ls - 1 <= 15 then 'filled' else 'gap' end as status, (slot * 60000000 - lu) / cast(ru - lu as double) as t, cast(ru - lu as double) as h from rt)
select source, instrument, batch_no, slot * 60000000 as slot_start_us, status, {", ".join(qz(f"case status when 'observed' then l{c} when 'filled' then (1 + 2 * t) * (1 - t) * (1 - t) * l{c} + t * (1 - t) * (1 - t) * h * ld{c} + t * t * (3 - 2 * t) * r{c} + t * t * (t - 1) * h * rd{c} end") + f" as {n}" for c, n in (("b", "bid"), ("a", "ask")))} from st"""

_ARRIVAL = f"""with {Q}, x as (select q.*, m.source_sequence as n from q join market_ticks m using (id)), y as (select *, row_number() over (partition by source, instrument, us, n order by id) as k, lag(us) over (partition by source, instrument order by id) as p from x)
select id, 'duplicate' as issue from y where k > 1 and n is not null union all select id, 'wide_spread' from y where spread_bps > 20 union all select id, 'out_of_order' from y where us < p union all select id, 'time_gap' from y where us - p > 300000000"""


def _due(trades: str) -> str:
    w = "partition by account order by closed, ticket, net, volume"
    return f"""with {trades.replace("trades as (", "raw as (")}, trades as (select * replace ({qz('net', 4)} as net) from raw), a as (select *, lag(net) over ({w}) as pn, lag(volume) over ({w}) as pv, sum(net) over ({w} rows unbounded preceding) as eq from trades),
b as (select *, greatest(0.0, max(eq) over ({w} rows unbounded preceding)) - eq as dd from a),
e as (select account, opened as t, 1 as o, volume as v, 1 as n from trades union all select account, closed, 0, -volume, -1 from trades),
r as (select account, sum(v) over k as v, sum(n) over k as n from (select account, t, o, sum(v) as v, sum(n) as n from e group by all) window k as (partition by account order by t, o rows unbounded preceding)),
c as (select account, max(v) as max_volume, cast(max(n) as bigint) as max_tickets from r group by account),
m as (select {summary('account', 'net', 3).replace(qz('avg(net)', 3), qz('(' + qz('sum(net)', 4) + ') / count(net)', 3)).replace(qz('median(net)', 3), qz('median(net)', 5))}, {qz('max(dd)', 4)} as drawdown, {qz('avg(case when pn < 0 then case when volume > pv then 1.0 else 0.0 end end)', 3)} as escalation from b group by account)
select m.*, max_volume, max_tickets from m join c using (account)"""


_LAB09 = f"""with recursive {S1}, {FEATURES}, f9 as (select source, instrument, bar_us, r1, r5, shock, intensity, abs(r5) as size from fe where r5 is not null),
m9 as (select source, instrument, median(size) as m, count(*) as n from f9 group by all), a9 as (select source, instrument, m, n, median(abs(size - m)) as mad from f9 join m9 using (source, instrument) group by all),
b9 as (select f9.*, row_number() over (partition by source, instrument order by bar_us) as i from f9 join a9 using (source, instrument) where n >= 30 and mad > 0 and size > m + 4.0 * 1.4826 * mad),
c9(source, instrument, i, last, keep) as (select source, instrument, i, bar_us, true from b9 where i = 1 union all select o.source, o.instrument, o.i, case when o.bar_us >= c9.last + 300000000 then o.bar_us else c9.last end, o.bar_us >= c9.last + 300000000 from c9 join b9 o on o.source = c9.source and o.instrument = c9.instrument and o.i = c9.i + 1),
h9 as materialized (select b9.*, cast(sign(r5) as integer) as side, {_COIN} as coin from b9 join c9 using (source, instrument, i) where keep),
p9 as (select h9.source, h9.instrument, h9.bar_us as k, s.bar_us as z, s.open_us, s.open_bid, s.open_ask, s.bar_us - lag(s.bar_us) over (partition by h9.source, h9.instrument, h9.bar_us order by s.bar_us) as gap from h9 join s on s.source = h9.source and s.instrument = h9.instrument and s.bar_us between h9.bar_us and h9.bar_us + 364050000),
q9 as (select *, max(case when gap > 60000000 then 1 else 0 end) over (partition by source, instrument, k order by z rows unbounded preceding) as cut from p9),
e9 as (select *, min(open_us) filter (where open_us >= k + 1050000) over (partition by source, instrument, k) as e_us from q9 where cut = 0),
x9 as (select source, instrument, k, arg_min(open_bid, open_us) filter (where open_us = e_us) as eb, arg_min(open_ask, open_us) filter (where open_us = e_us) as ea,
  {", ".join(f"arg_min({c}, open_us) filter (where open_us - e_us between {h}000000 and {h + 30}000000) as {n}{h}" for h in (30, 60, 300) for c, n in (("open_bid", "b"), ("open_ask", "a")))} from e9 where e_us - (k + 1050000) <= 30000000 group by source, instrument, k),
t9 as (select h9.*, eb, ea, b30, a30, b60, a60, b300, a300, case when shock <= 1.2 and r5 * coalesce(r1, 0) < 0 and abs(coalesce(r1, 0)) >= 0.25 * size then 'fade' when shock <= 1.2 and r5 * coalesce(r1, 0) > 0 and intensity >= 1 then 'continue' else 'abstain' end as action from h9 left join x9 on x9.source = h9.source and x9.instrument = h9.instrument and x9.k = h9.bar_us),
w9 as (select instrument, size, action, eb, ea, unnest([{{'p': 'classified', 'd': case action when 'fade' then -side when 'continue' then side else 0 end}}, {{'p': 'fade_all', 'd': -side}}, {{'p': 'continue_all', 'd': side}}, {{'p': 'random_direction', 'd': coin}}]) as w, b30, a30, b60, a60, b300, a300 from t9),
v9 as (select instrument, size, action, eb, ea, w.p as policy, w.d as d, unnest([{{'h': 30, 'b': b30, 'a': a30}}, {{'h': 60, 'b': b60, 'a': a60}}, {{'h': 300, 'b': b300, 'a': a300}}]) as x from w9),
r9 as (select instrument, size, action, policy, x.h as h, case when d > 0 then (((x.b + x.a) / 2) / ((eb + ea) / 2) - 1) * 10000 when d < 0 then (((eb + ea) / 2) / ((x.b + x.a) / 2) - 1) * 10000 end as g, case when d > 0 then (x.b / ea - 1) * 10000 when d < 0 then (eb / x.a - 1) * 10000 end as n from v9)
select instrument, action, policy, h as horizon_s, count(*) as n, {qz('avg(size) * 10000', 4)} as mean_size_bps, count(n) as trades, {qz('avg(g)', 4)} as mean_gross_bps, {qz('avg(n)', 4)} as mean_net_bps from r9 group by instrument, action, policy, h"""


def _ridge(trades: str) -> str:
    """Three standardised features: with the intercept apart the normal equations are three by three, solved by determinants."""
    d = lambda c: "{0} * ({4} * {8} - {5} * {7}) - {1} * ({3} * {8} - {5} * {6}) + {2} * ({3} * {7} - {4} * {6})".format(*c)
    a = ["(aa + 1)", "ab", "ac", "ab", "(bb + 1)", "bc", "ac", "bc", "(cc + 1)"]
    swap = lambda k: [("ya", "yb", "yc")[i // 3] if i % 3 == k else x for i, x in enumerate(a)]
    return f"""with {trades}, x as (select symbol, net, volume * 1.0 as f1, (closed - opened) / 86400000000 as f2, side * 1.0 as f3 from trades), st as (select avg(f1) as m1, stddev_pop(f1) as s1, avg(f2) as m2, stddev_pop(f2) as s2, avg(f3) as m3, stddev_pop(f3) as s3, avg(net) as my from x),
z as (select symbol, net, my, (f1 - m1) / s1 as a, (f2 - m2) / s2 as b, (f3 - m3) / s3 as c from x cross join st), g as (select sum(a * a) as aa, sum(a * b) as ab, sum(a * c) as ac, sum(b * b) as bb, sum(b * c) as bc, sum(c * c) as cc, sum(a * net) as ya, sum(b * net) as yb, sum(c * net) as yc from z),
w as (select ({d(swap(0))}) / ({d(a)}) as w1, ({d(swap(1))}) / ({d(a)}) as w2, ({d(swap(2))}) / ({d(a)}) as w3 from g)
select symbol, {qz('avg(my + a * w1 + b * w2 + c * w3)', 3)} as predicted, {qz('avg(net)', 3)} as actual from z cross join w group by symbol"""


def _metrics40() -> str:
    head, tail = _SIM08.rsplit("\nselect source", 1)
    return f"""{head}, bt as (select source{tail}), bp as (select *, net_bps / 10 as pnl, sum(net_bps / 10) over w as eq from bt window w as (partition by source, instrument order by opened_us rows unbounded preceding)),
bk as (select *, greatest(0.0, max(eq) over (partition by source, instrument order by opened_us rows unbounded preceding)) as peak from bp),
bg as (select source, instrument, count(*) as n, sum(pnl) as total, max((peak - eq) / (10000 + peak) * 100) as dd, avg(case when pnl > 0 then 1.0 else 0.0 end) as w, sum(case when pnl > 0 then pnl else 0 end) / nullif(sum(case when pnl < 0 then -pnl else 0 end), 0) as f, avg(pnl) as m from bk group by source, instrument)
select source, instrument, n, {qz('total + 10000', 3)} as equity, {qz('dd', 5)} as drawdown_pct, {qz('w', 5)} as win_rate, {qz('f', 4)} as profit_factor, {qz('m', 4)} as expectancy, {qz('total / 100 / nullif(dd, 0)', 3)} as return_over_drawdown from bg"""


def statements() -> dict[str, str]:
    from tickloom.plans.trades import T

    return {
        "lab01_baselines": _LAB01,
        "lab02_slices": _LAB02,
        "lab07_path_management": _LAB07,
        "lab09_shocks": _LAB09,
        "lab11_staged": _LAB11,
        "agg25_ridge": _ridge(T),
        "lab17_latency_replay": _LAB17,
        "lab22_signal_trades": f"with recursive {_SIGNALS} select * from sg",
        "lab24_due_diligence": _due(T),
        "sim08_backtest": _SIM08,
        "agg40_backtest_metrics": _metrics40(),
        "join17_matched": _JOIN17,
        "job01_folds": f"{_JOB01}, {T} select fold, count(*) as n, {qz('sum(net)', 2)} as net from w join trades on opened >= a and opened <= z - 1 group by fold",
        "p7_grid": _GRID,
        "prj26_arrival_issues": _ARRIVAL,
    }


ORACLE = statements()
