"""Queries over trades (orders joined to lineitem) and other relational tables, with their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.operators import asof, folds, metrics
from tickloom.operators.metrics import quantized
from tickloom.session import load, us

DAY = 86_400_000_000

T = """trades as (
  select o_custkey as account, l_partkey % 10 as symbol, case when l_returnflag = 'R' then -1 else 1 end as side, epoch_us(o_orderdate) as opened, epoch_us(l_shipdate) as closed,
    l_quantity as volume, l_extendedprice * (l_discount - 0.05) as net, l_orderkey * 10 + l_linenumber as ticket
  from lineitem join orders on l_orderkey = o_orderkey where l_shipdate >= o_orderdate
)"""


def trades(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "lineitem").join(load(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).where("l_shipdate >= o_orderdate")
    return rows.select(
        F.col("o_custkey").alias("account"), (F.col("l_partkey") % 10).alias("symbol"), F.when(F.col("l_returnflag") == "R", -1).otherwise(1).alias("side"), us("o_orderdate").alias("opened"), us("l_shipdate").alias("closed"),
        F.col("l_quantity").alias("volume"), (F.col("l_extendedprice") * (F.col("l_discount") - 0.05)).alias("net"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ticket"),
    )


def agg05_daily(spark, d):
    return trades(spark, d).groupBy("symbol", F.floor(F.col("closed") / DAY).cast("long").alias("day")).agg(quantized(F.sum("net"), 4).alias("net"), F.count(F.lit(1)).alias("n"))


def _daily(spark, d):
    return trades(spark, d).groupBy("symbol", F.floor(F.col("closed") / DAY).cast("long").alias("day")).agg(quantized(F.sum("net"), 4).alias("net"))


def agg13_slices(spark, d):
    s = metrics.slices(trades(spark, d).withColumn("net", quantized("net", 4)), ["symbol", "side"], "net")
    return s.select("dimension", "level", "n", quantized("mean", 4).alias("mean"), quantized("median", 4).alias("median"), quantized("win_rate").alias("win_rate"), quantized("profit_factor").alias("profit_factor"))


def agg19_concentration(spark, d):
    c = metrics.concentration(_daily(spark, d), ["symbol"], "day", "net")
    return c.select("symbol", *[quantized(x, 3).alias(x) for x in ("total", "best_day", "top5", "without_best")])


def agg21_autocorrelation(spark, d):
    return metrics.autocorrelation(_daily(spark, d), ["symbol"], ["day"], "net", 5).select("symbol", "lag", quantized("r", 5).alias("r"))


def agg22_underwater(spark, d):
    return metrics.underwater(_daily(spark, d), ["symbol"], ["day"], "net")


def agg28_merged_spans(spark, d):
    m = metrics.merge_spans(trades(spark, d), ["account", "symbol", "side"], "opened", "closed", ["ticket"])
    return m.groupBy("account", "symbol", "side", "span").agg(F.min("opened").alias("opened"), F.max("closed").alias("closed"), F.count(F.lit(1)).alias("tickets"), F.sum("volume").alias("volume")).drop("span")


def agg29_concurrency(spark, d):
    return metrics.concurrency(trades(spark, d), ["account"], "opened", "closed", "volume")


def agg30_balance_drawdown(spark, d):
    upto = Window.partitionBy("symbol").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    run = _daily(spark, d).withColumn("balance", F.sum("net").over(upto)).withColumn("peak", F.greatest(F.lit(0.0), F.max("balance").over(upto)))
    return run.groupBy("symbol").agg(quantized(F.max(F.col("peak") - F.col("balance")), 3).alias("drawdown"), F.count(F.lit(1)).alias("days"))


def agg10_threshold(spark, d):
    t = metrics.robust_threshold(trades(spark, d).withColumn("size", F.round("net").cast("long").cast("double")), ["symbol"], "size")
    return t.select("symbol", quantized("median").alias("median"), quantized("mad").alias("mad"), quantized("threshold").alias("threshold"))


def sim11_without_overlap(spark, d):
    got = folds.without_overlap(trades(spark, d).select("account", "opened", "closed", "ticket"), ["account"], "opened", "closed", ["opened", "ticket", "closed"])
    return got.select("account", "ticket")


def sim09_cooldown_orders(spark, d):
    rows = load(spark, d, "orders").select(F.col("o_custkey").alias("account"), us("o_orderdate").alias("t"), F.col("o_orderkey").alias("ticket"))
    return folds.cooldown(rows, ["account"], "t", ["t", "ticket"], 90 * DAY).select("account", "ticket")


def join17_matched(spark, d):
    rows = load(spark, d, "orders").select((F.col("o_custkey") % 97).alias("symbol"), us("o_orderdate").alias("t"), F.col("o_orderkey").alias("ticket"), (F.col("o_custkey") % 2).alias("odd"))
    got = folds.match_one_to_one(rows.where("odd = 0").drop("odd"), rows.where("odd = 1").drop("odd"), ["symbol"], "t", "ticket", 2 * DAY)
    return got.select("symbol", "left_ticket", "right_ticket", "lag_us")


def join12_orders_in_windows(spark, d):
    windows = load(spark, d, "events").where("event_type = 'purchase'").select(F.col("event_id").alias("window_id"), us("ts").alias("a"), (us("ts") + 3_600_000_000).alias("b"))
    points = load(spark, d, "events").select("user_id", us("ts").alias("t"), "value")
    got = asof.between(points.withColumn("k", F.lit(1)), windows.withColumn("k", F.lit(1)), ["k"], "t", "a", "b")
    return got.groupBy("window_id").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("high"), F.min("value").alias("low"))


def join23_anti(spark, d):
    return load(spark, d, "customer").join(load(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_mktsegment")


def set02_shared_parts(spark, d):
    by_brand = load(spark, d, "lineitem").join(load(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_suppkey", "p_brand").distinct()
    pairs = by_brand.alias("x").join(by_brand.alias("y"), "l_suppkey").where("x.p_brand < y.p_brand")
    return pairs.groupBy(F.col("x.p_brand").alias("a"), F.col("y.p_brand").alias("b")).agg(F.count(F.lit(1)).alias("suppliers"))


def set03_except(spark, d):
    urgent, low = (load(spark, d, "orders").where(F.col("o_orderpriority").startswith(p)).select("o_custkey").distinct() for p in ("1", "5"))
    return urgent.subtract(low).withColumn("side", F.lit("urgent_only")).unionByName(low.subtract(urgent).withColumn("side", F.lit("low_only")))


def srt05_top_days(spark, d):
    w = Window.partitionBy("symbol").orderBy(F.desc("net"), "day")
    return _daily(spark, d).withColumn("k", F.row_number().over(w)).where("k <= 5").select("symbol", "day", "net", "k")


def star_revenue(spark, d):
    """A six-way star join with the filters at the scans."""
    rows = load(spark, d, "lineitem").where("l_discount between 0.02 and 0.08").join(load(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(load(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(load(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_name", "n_name").agg(quantized(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 1).alias("revenue"), F.count_distinct("o_orderkey").alias("orders"))


QZ = lambda x, n=6: f"floor(({x}) * {10**n} + 0.5) / {float(10**n)}"
_DAILY = f"{T}, daily as (select symbol, cast(floor(closed / {DAY}) as bigint) as day, {QZ('sum(net)', 4)} as net from trades group by all)"
_LEDGER = "count(v) as n, {mean} as mean, {median} as median, {win} as win_rate, {pf} as profit_factor"

ORACLE = {
    "agg05_daily": f"with {T} select symbol, cast(floor(closed / {DAY}) as bigint) as day, {QZ('sum(net)', 4)} as net, count(*) as n from trades group by all",
    "agg13_slices": f"""with {T}, v as (select symbol, side, {QZ('net', 4)} as v from trades), long as (
  select 'overall' as dimension, 'all' as level, v from v union all select 'symbol', cast(symbol as varchar), v from v union all select 'side', cast(side as varchar), v from v)
select dimension, level, count(*) as n, {QZ('avg(v)', 4)} as mean, {QZ('median(v)', 4)} as median, {QZ('avg(case when v > 0 then 1.0 else 0.0 end)')} as win_rate,
  {QZ('sum(case when v > 0 then v else 0 end) / nullif(sum(case when v < 0 then -v else 0 end), 0)')} as profit_factor from long group by all""",
    "agg19_concentration": f"""with {_DAILY}, r as (select *, row_number() over (partition by symbol order by net desc, day) as k from daily)
select symbol, {QZ('sum(net)', 3)} as total, {QZ('max(net)', 3)} as best_day, {QZ('sum(case when k <= 5 and net > 0 then net else 0 end)', 3)} as top5, {QZ('sum(net) - max(net)', 3)} as without_best from r group by symbol""",
    "agg21_autocorrelation": f"""with {_DAILY}, c as (select symbol, day, net - avg(net) over (partition by symbol) as x, row_number() over (partition by symbol order by day) as i from daily),
den as (select symbol, sum(x * x) as s from c group by symbol)
select a.symbol, cast(l.lag as integer) as lag, {QZ('sum(a.x * b.x) / max(d.s)', 5)} as r from c a join range(1, 6) l(lag) on true join c b on a.symbol = b.symbol and b.i = a.i - l.lag join den d on d.symbol = a.symbol group by a.symbol, l.lag""",
    "agg22_underwater": f"""with {_DAILY}, e as (select symbol, day, sum(net) over (partition by symbol order by day rows unbounded preceding) as e from daily),
p as (select *, greatest(0.0, coalesce(max(e) over (partition by symbol order by day rows between unbounded preceding and 1 preceding), 0.0)) as p from e),
g as (select *, e < p as u, sum(case when e < p then 0 else 1 end) over (partition by symbol order by day rows unbounded preceding) as g from p),
n as (select symbol, g, sum(case when u then 1 else 0 end) as n from g group by symbol, g)
select symbol, cast(max(n) as bigint) as longest from n group by symbol""",
    "agg28_merged_spans": f"""with {T}, f as (select *, case when max(closed) over w >= opened then 0 else 1 end as f from trades window w as (partition by account, symbol, side order by opened, ticket rows between unbounded preceding and 1 preceding)),
s as (select *, sum(f) over (partition by account, symbol, side order by opened, ticket rows unbounded preceding) as span from f)
select account, symbol, side, min(opened) as opened, max(closed) as closed, count(*) as tickets, sum(volume) as volume from s group by account, symbol, side, span""",
    "agg29_concurrency": f"""with {T}, e as (select account, opened as t, 1 as o, volume as v, 1 as n from trades union all select account, closed, 0, -volume, -1 from trades),
r as (select account, sum(v) over w as v, sum(n) over w as n from (select account, t, o, sum(v) as v, sum(n) as n from e group by all) window w as (partition by account order by t, o rows unbounded preceding))
select account, max(v) as max_volume, cast(max(n) as bigint) as max_tickets from r group by account""",
    "agg30_balance_drawdown": f"""with {_DAILY}, e as (select symbol, day, sum(net) over (partition by symbol order by day rows unbounded preceding) as b from daily),
p as (select *, greatest(0.0, max(b) over (partition by symbol order by day rows unbounded preceding)) as p from e) select symbol, {QZ('max(p - b)', 3)} as drawdown, count(*) as days from p group by symbol""",
    "agg10_threshold": f"""with {T}, v as (select symbol, round(net) as v from trades), m as (select symbol, median(v) as m, count(v) as n from v group by symbol), d as (select v.symbol, m, n, median(abs(v - m)) as mad from v join m using (symbol) group by all)
select symbol, {QZ('m')} as median, {QZ('mad')} as mad, {QZ('m + 3.0 * 1.4826 * mad')} as threshold from d where n >= 100 and mad > 0""",
    "sim11_without_overlap": f"""with recursive {T}, o as (select account, opened, closed, ticket, row_number() over (partition by account order by opened, ticket, closed) as i from trades),
f(account, i, until, ticket, keep) as (
  select account, i, closed, ticket, true from o where i = 1
  union all select o.account, o.i, case when o.opened >= f.until then o.closed else f.until end, o.ticket, o.opened >= f.until from f join o on o.account = f.account and o.i = f.i + 1)
select account, ticket from f where keep""",
    "sim09_cooldown_orders": f"""with recursive o as (select o_custkey as account, epoch_us(o_orderdate) as t, o_orderkey as ticket, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as i from orders),
f(account, i, last, ticket, keep) as (
  select account, i, t, ticket, true from o where i = 1
  union all select o.account, o.i, case when o.t >= f.last + {90 * DAY} then o.t else f.last end, o.ticket, o.t >= f.last + {90 * DAY} from f join o on o.account = f.account and o.i = f.i + 1)
select account, ticket from f where keep""",
    "join12_orders_in_windows": """with w as (select event_id as window_id, epoch_us(ts) as a, epoch_us(ts) + 3600000000 as b from events where event_type = 'purchase'), p as (select epoch_us(ts) as t, value from events)
select window_id, count(*) as n, max(value) as high, min(value) as low from w join p on t >= a and t <= b group by window_id""",
    "join23_anti": "select c_custkey, c_mktsegment from customer anti join orders on c_custkey = o_custkey",
    "set02_shared_parts": """with b as (select distinct l_suppkey, p_brand from lineitem join part on l_partkey = p_partkey) select x.p_brand as a, y.p_brand as b, count(*) as suppliers from b x join b y using (l_suppkey) where x.p_brand < y.p_brand group by all""",
    "set03_except": """with u as (select distinct o_custkey from orders where o_orderpriority like '1%'), l as (select distinct o_custkey from orders where o_orderpriority like '5%')
select o_custkey, 'urgent_only' as side from (select * from u except select * from l) union all select o_custkey, 'low_only' from (select * from l except select * from u)""",
    "srt05_top_days": f"with {_DAILY}, r as (select *, row_number() over (partition by symbol order by net desc, day) as k from daily) select symbol, day, net, cast(k as integer) as k from r where k <= 5",
    "star_revenue": f"""select r_name, n_name, {QZ('sum(l_extendedprice * (1 - l_discount))', 1)} as revenue, count(distinct o_orderkey) as orders from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
  join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where l_discount between 0.02 and 0.08 group by r_name, n_name""",
}
QUERIES = {f.__name__: f for f in (agg05_daily, agg13_slices, agg19_concentration, agg21_autocorrelation, agg22_underwater, agg28_merged_spans, agg29_concurrency, agg30_balance_drawdown, agg10_threshold, sim11_without_overlap, sim09_cooldown_orders, join17_matched, join12_orders_in_windows, join23_anti, set02_shared_parts, set03_except, srt05_top_days, star_revenue)}
