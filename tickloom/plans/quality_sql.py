"""DuckDB statements for the queries of quality.py that SQL can express."""

from __future__ import annotations

from tickloom.operators.rowparse import RECORDER_COLUMNS

_ROWS4 = """
with rows as (
  select 'market_ticks' as table_name, source, instrument as series, epoch_us(occurred_at) as e, epoch_us(received_at) as r, (bid + ask) / 2 as v from market_ticks where occurred_at is not null and received_at is not null
  union all
  select 'event_envelopes', source, kind, epoch_us(occurred_at), epoch_us(received_at), null from event_envelopes where occurred_at is not null and received_at is not null
),
timed as (select *, cast(floor(e / 300000000) as bigint) * 300000000 as period_start_us, r - (cast(floor(e / 300000000) as bigint) + 1) * 300000000 as late from rows)
"""

_UUID = "regexp_replace(lower(regexp_replace(event_id, '^\\s+|\\s+$', '', 'g')), '^urn:uuid:|[{}-]', '', 'g')"

_P5 = f"""
with recursive
ticks as (
  select id, source, received_at, cast(regexp_extract(source_sequence, '^\\s*(\\d+)\\s*:\\s*(\\d+)\\s*$', 1) as bigint) as b, cast(regexp_extract(source_sequence, '^\\s*(\\d+)\\s*:\\s*(\\d+)\\s*$', 2) as bigint) as n
  from market_ticks where regexp_matches(source_sequence, '^\\s*\\d+\\s*:\\s*\\d+\\s*$') and source is not null
),
ranked as (select id, row_number() over (partition by source, b, n order by received_at nulls last, id) as k from ticks),
env as materialized (select envelope_id as id, received_at, {_UUID} as ev, nullif(lower(regexp_replace(idempotency_key, '^\\s+|\\s+$', '', 'g')), '') as k from event_envelopes),
links as materialized (
  select a.id as x, b.id as y from env a join env b on a.ev = b.ev where a.id <> b.id
  union select a.id, b.id from env a join env b on a.k = b.k where a.id <> b.id
),
reach as (select distinct x, x as y from links union select r.x, l.y from reach r join links l on r.y = l.x),
grouped as (select x, min(y) as root from reach group by x),
placed as (select e.id, row_number() over (partition by g.root order by e.received_at nulls last, e.id) as k from env e join grouped g on e.id = g.x)
select 'market_ticks' as table_name, id as row_key from ranked where k > 1
union all select 'event_envelopes', id from placed where k > 1
"""

_FIELDS6 = f"""
with lines as (select line_id, file_name, line_no, regexp_replace(line, '\\r$', '') as t from recorder_lines),
bare as (select line_id, file_name, line_no, t, case when starts_with(t, chr(65279)) then substr(t, 2) else t end as b from lines),
kept as (
  select line_id, file_name, line_no, t, regexp_full_match(t, '(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*') as fine
  from bare where b <> '' and b <> '{",".join(RECORDER_COLUMNS)}'
),
cut as (select *, case when fine then regexp_extract_all(t || ',', '("(?:[^"]|"")*"|[^",]*),', 1) end as f from kept),
named as (
  select line_id, file_name, line_no, fine, len(f) as width,
    {", ".join(f"case when len(f) = 12 then case when starts_with(f[{i + 1}], '{chr(34)}') then replace(substr(f[{i + 1}], 2, length(f[{i + 1}]) - 2), '{chr(34) * 2}', '{chr(34)}') else f[{i + 1}] end end as {c}" for i, c in enumerate(RECORDER_COLUMNS))}
  from cut
),
judged as (
  select *, case when not fine then 'quoting' when width <> 12 then 'column_count' when record_type not in ('tick', 'heartbeat') then 'record_type'
    when not coalesce(case when regexp_full_match(bid, ' *[+-]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:[eE][+-]?[0-9]+)? *') then try_cast(trim(bid) as double) end > 0, false) then 'bid'
    when not coalesce(case when regexp_full_match(ask, ' *[+-]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:[eE][+-]?[0-9]+)? *') then try_cast(trim(ask) as double) end > 0, false) then 'ask' end as reason
  from named
)
"""

ORACLE = {
    "p4_found": _ROWS4 + "select distinct table_name, source, series, period_start_us, case when late >= 1200000000 then 'refused' else 'corrected' end as verdict from timed where late >= 0",
    "p4_hourly": _ROWS4 + "select table_name, source, series, cast(floor(period_start_us / 3600000000) as bigint) * 3600000000 as period_start_us, count(*) as n from timed where late < 1200000000 group by all",
    "p5_found": _P5,
    "p6_found": _FIELDS6 + "select line_id, reason from judged where reason is not null",
    "p6_records": _FIELDS6 + "select line_id, file_name, line_no, record_type, received_utc, server_time, try_cast(trim(monotonic_ms) as bigint) as monotonic_ms, session_id, source_sequence, broker, server, symbol, "
    "try_cast(trim(bid) as double) as bid, try_cast(trim(ask) as double) as ask, try_cast(trim(spread_points) as double) as spread_points from judged where reason is null",
    "p4_changelog": _ROWS4
    + """, parts as (select table_name, source, series, period_start_us, case when late < 0 then 0 when late >= 1200000000 then -1 else 1 + cast(floor(late / 60000000) as integer) end as version, count(*) as n, sum(v) as total, min(v) as low, max(v) as high from timed group by all),
run as (select *, sum(case when version >= 0 then n end) over u as rn, sum(case when version >= 0 then total end) over u as rt, min(case when version >= 0 then low end) over u as rl, max(case when version >= 0 then high end) over u as rh
  from parts window u as (partition by table_name, source, series, period_start_us order by version rows unbounded preceding)),
old as (select *, lag(rn) over w as pn, lag(rt) over w as pt, lag(rl) over w as pl, lag(rh) over w as ph from run window w as (partition by table_name, source, series, period_start_us order by version)),
moves as (
  select table_name, source, series, period_start_us, version, 'refused' as verdict, 0 as op, n, total, low, high from old where version < 0
  union all select table_name, source, series, period_start_us, version, case when version > 0 then 'corrected' else 'on_time' end, 1, cast(rn as bigint), rt, rl, rh from old where version >= 0
  union all select table_name, source, series, period_start_us, version, case when version > 0 then 'corrected' else 'on_time' end, -1, cast(pn as bigint), pt, pl, ph from old where version >= 0 and pn is not null)
select table_name, source, series, period_start_us, version, verdict, op, n, case when abs(total * 1000) < 9e15 then floor(total * 1000 + 0.5) / 1000.0 else total end as total, low, high from moves""",
    "p7_found": """
with slots as (
  select source, instrument, unnest(range(cast(ceil(epoch_us(opened_at) / 60000000) as bigint), cast(floor(epoch_us(closed_at) / 60000000) as bigint))) as slot from feed_sessions
),
seen as (select distinct source, instrument, cast(floor(epoch_us(occurred_at) / 60000000) as bigint) as slot from market_ticks where bid is not null and ask is not null and occurred_at is not null)
select distinct source, instrument, slot * 60000000 as slot_start_us from slots anti join seen using (source, instrument, slot)
""",
}
