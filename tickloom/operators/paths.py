"""What happens to a position along the quotes after its signal: managed exits, staged entries, occupancy, latency."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.operators.asof import asof, between
from tickloom.operators.folds import without_overlap

SECOND = 1_000_000


def side_price(side: str, bid: str, ask: str, opening: bool) -> Column:
    """The executable price of a side: buys open at ask and close at bid, sells the other way round."""
    long = ask if opening else bid
    short = bid if opening else ask
    return F.when(F.col(side) > 0, F.col(long)).otherwise(F.col(short))


def policy_grid(spark: SparkSession, waits: list[int], pulls: list[float], holds: list[int], stops: list[float], targets: list[float]) -> DataFrame:
    """All combinations in which a pullback goes with a wait and none with none; a fixed, small table."""
    rows = [(f"w{w}_p{p:g}_h{h}_s{s:g}_t{t:g}", w, float(p), h, float(s), float(t)) for w in waits for p in pulls for h in holds for s in stops for t in targets if (p == 0) == (w == 0)]
    return spark.createDataFrame(rows, "policy string, wait_s int, pull_bps double, hold_s int, stop_bps double, target_bps double")


def quote_paths(episodes: DataFrame, quotes: DataFrame, keys: list[str], reach_us: int) -> DataFrame:
    """One row per episode and quote of its series in [start, start + reach_us]. episodes: episode, keys, start_us, side."""
    spans = episodes.select("episode", *keys, "start_us", (F.col("start_us") + reach_us).alias("until_us"), "side")
    return between(quotes.select(*keys, "us", "id", "bid", "ask"), spans, keys, "us", "start_us", "until_us", width_us=max(reach_us, 60 * SECOND))


def manage(episodes: DataFrame, quotes: DataFrame, keys: list[str], policies: DataFrame, latency_us: int = 50_000, max_delay_s: int = 2, slippage_bps: float = 0.0) -> DataFrame:
    """Per episode and policy: entry at once or on a pullback while waiting, then stop, target or time, whichever quote comes first.

    Returns are relative to the entry price; costs are two slippages. A policy without entry, or whose exit has no quote in the path, gives
    no row. A path is held only while it is judged; entries differ by wait and pullback alone, and each one's first stops, targets and
    times serve all its policies. Null sides give no row.
    """
    last = policies.agg(F.max(F.greatest("wait_s", F.lit(max_delay_s)) + F.col("hold_s"))).first()[0] or 0
    paths = quote_paths(episodes.dropna(subset=["episode", "side"]), quotes, keys, (last + 30) * SECOND).select("episode", "side", "us", "id", "bid", "ask")
    # the grid is a fixed table of policies, known to every task
    grid = policies.select("policy", "wait_s", "pull_bps", "hold_s", "stop_bps", "target_bps").toPandas()
    entries = [(wait, pull, own["policy"].tolist(), *[np.unique(own[c].to_numpy(), return_inverse=True) for c in ("stop_bps", "target_bps", "hold_s")]) for (wait, pull), own in grid.groupby(["wait_s", "pull_bps"])]
    schema = "episode long, policy string, entered_us long, exited_us long, reason string, gross_bps double, net_bps double"

    def judged(episode: int, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        side, us, bid, ask = rows["side"].iloc[0], *[rows[c].to_numpy() for c in ("us", "bid", "ask")]
        price, out = (ask, bid) if side > 0 else (bid, ask)
        mid = (bid[0] + ask[0]) / 2
        gain = side * (mid - price) / mid * 10_000
        start = np.searchsorted(us, us[0] + latency_us, "left")
        for wait, pull, names, (stops, s), (targets, t), (holds, h) in entries:
            end = np.searchsorted(us, us[0] + (wait if wait > 0 else max_delay_s) * SECOND, "right")
            fits = np.arange(start, end) if pull == 0 else start + np.flatnonzero(gain[start:end] >= pull)
            if not len(fits):
                continue
            e = fits[0]
            gross = side * (out[e:] - price[e]) / price[e] * 10_000
            n = len(gross)
            first = lambda hit: hit.argmax() if hit.any() else n
            stop = np.array([first(gross <= -x) for x in stops])[s]
            target = np.array([first(gross >= x) for x in targets])[t]
            time = np.searchsorted(us[e:], us[e] + holds.astype("int64") * SECOND, "left")[h]
            at = np.minimum(np.minimum(stop, target), time)
            done = at < n
            if not done.any():
                continue
            at = at[done]
            reason = np.where(stop[done] == at, "stop", np.where(target[done] == at, "target", "time"))
            yield pd.DataFrame({"episode": episode, "policy": [x for x, d in zip(names, done) if d], "entered_us": us[e], "exited_us": us[e:][at], "reason": reason, "gross_bps": gross[at], "net_bps": gross[at] - 2 * slippage_bps})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []
        for pdf in batches:
            out: list[pd.DataFrame] = []
            ids = pdf["episode"].to_numpy()
            cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1), len(pdf)]
            for a, z in zip(cuts[:-1], cuts[1:]):
                if a == z:
                    continue
                if rest and rest[0]["episode"].iloc[0] != ids[a]:
                    out += judged(rest[0]["episode"].iloc[0], pd.concat(rest))
                    rest = []
                rest.append(pdf.iloc[a:z])
            if out:
                yield pd.concat(out, ignore_index=True)
        if rest:
            yield from judged(rest[0]["episode"].iloc[0], pd.concat(rest))

    return paths.repartition("episode").sortWithinPartitions("episode", "us", "id").mapInPandas(run, schema)


@dataclass(frozen=True)
class Staging:
    delay_s: int = 0
    max_delay_s: int = 2
    hold_s: int = 60
    stages_bps: tuple[float, ...] = (4.0, 8.0)
    basket_stop_bps: float = 12.0
    failure_s: int = 15
    failure_bps: float = 6.0
    partial_bps: float = 8.0
    trail_bps: float = 6.0
    slippage_bps: float = 0.0
    staged: bool = True
    runner: bool = True


def staged_positions(episodes: DataFrame, quotes: DataFrame, keys: list[str], config: Staging = Staging()) -> DataFrame:
    """(episode, gross_bps, net_bps, tickets, partial, reason): staged entries on adverse moves, a basket stop, an early exit for quick failures,
    half taken at a target and the rest trailed. Episodes without entry or exit give no row."""
    return staged_variants(episodes, quotes, keys, {"": config}).drop("variant")


def staged_variants(episodes: DataFrame, quotes: DataFrame, keys: list[str], variants: dict[str, Staging]) -> DataFrame:
    """staged_positions of each variant, with its name as variant, in one pass over the paths. All variants see the longest variant's path.

    Everything is a first hit on the path: the entry, then each stage (the first quote after the stage before at which the first ticket is down by the
    stage's step), the half taken (the first quote at which the mean result of the tickets so far reaches its target), and the exit, the first quote
    with any reason. Of several reasons at one quote the basket stop counts before the quick failure, that before the trailing stop, and time last.
    A quote at which the position is stopped or fails takes no half. Windows hold one episode's path, which its reach bounds.
    """
    reach = max(c.delay_s + c.max_delay_s + c.hold_s + 30 for c in variants.values())
    kinds = F.array(*[F.struct(F.lit(name).alias("variant"), *[F.lit(getattr(c, f)).alias(f) for f in ("delay_s", "max_delay_s", "hold_s", "basket_stop_bps", "failure_s", "failure_bps", "partial_bps", "trail_bps", "slippage_bps", "runner")], F.array(*[F.lit(float(b)) for b in (c.stages_bps if c.staged else ())]).cast("array<double>").alias("steps")) for name, c in variants.items()])
    path = Window.partitionBy("variant", "episode")
    upto = path.orderBy("us", "id").rowsBetween(Window.unboundedPreceding, 0)
    first = lambda test, *more: F.min(F.when(test, F.struct("us", "id", *more))).over(path)
    at = F.struct("us", "id")
    place = lambda hit: F.struct(F.col(f"{hit}.us").alias("us"), F.col(f"{hit}.id").alias("id"))
    since = lambda hit: F.col(hit).isNotNull() & (at >= place(hit))
    result = lambda price: F.col("side") * (F.col("out") - price) / price * 10_000

    rows = quote_paths(episodes.dropna(subset=["episode", "side"]), quotes, keys, reach * SECOND).select("episode", "side", "us", "id", side_price("side", "bid", "ask", True).alias("into"), side_price("side", "bid", "ask", False).alias("out"), F.explode(kinds).alias("v"))
    rows = rows.select("*", "v.*").drop("v").withColumn("due", F.min("us").over(path) + F.col("delay_s") * SECOND)
    rows = rows.withColumn("entry", first(F.col("us").between(F.col("due"), F.col("due") + F.col("max_delay_s") * SECOND), "into")).where(since("entry"))
    rows = rows.withColumn("move", result(F.col("entry.into")))
    tickets, total, before = F.lit(1), F.col("move"), None
    for k in range(max(len(c.stages_bps) if c.staged else 0 for c in variants.values())):
        down = F.col("move") <= -F.get("steps", F.lit(k))
        rows = rows.withColumn(f"stage{k}", first(down if before is None else down & F.col(before).isNotNull() & (at > place(before)), "into"))
        before = f"stage{k}"
        tickets, total = tickets + since(before).cast("int"), total + F.when(since(before), result(F.col(f"{before}.into"))).otherwise(0.0)
    rows = rows.withColumn("tickets", tickets).withColumn("value", total / F.col("tickets"))
    rows = rows.withColumn("peak", F.max("value").over(upto)).withColumn("half", first(F.col("runner") & (F.col("value") >= F.col("partial_bps")), "value"))
    lost = F.when(F.col("value") <= -F.col("basket_stop_bps"), "basket_stop").when((F.col("us") - F.col("entry.us") >= F.col("failure_s") * SECOND) & (F.col("move") <= -F.col("failure_bps")), "quick_failure")
    won = F.when(since("half") & (F.col("peak") - F.col("value") >= F.col("trail_bps")), "trailing").when(F.col("us") >= F.col("entry.us") + F.col("hold_s") * SECOND, "time")
    rows = rows.withColumn("lost", lost).withColumn("reason", F.coalesce("lost", won)).withColumn("done", first(F.col("reason").isNotNull())).where(at == F.col("done"))
    partial = F.coalesce(F.when(F.col("lost").isNull(), since("half")).otherwise(F.col("half").isNotNull() & (at > place("half"))), F.lit(False))
    gross = F.when(F.col("partial"), (F.col("half.value") + F.col("value")) / 2).otherwise(F.col("value"))
    return rows.withColumn("partial", partial).select("variant", "episode", gross.alias("gross_bps"), (gross - 2 * F.col("tickets") * F.col("slippage_bps")).alias("net_bps"), "tickets", "partial", "reason")


def signal_trades(signals: DataFrame, quotes: DataFrame, keys: list[str], hold_us: int, max_delay_us: int) -> DataFrame:
    """Trades of signals (keys, us, side): first quote after the signal, first after the holding time, one position at a time per series.

    Signals without an entry quote in max_delay_us, or without any exit quote, make no trade; boundary_valid says whether the exit came in time.
    """
    entered = asof(signals, quotes, keys, "us", "us", ["bid", "ask"], "forward", tolerance_us=max_delay_us, prefix="e_").where("e_t is not null").withColumn("due", F.col("e_t") + hold_us)
    left = asof(entered, quotes, keys, "due", "us", ["bid", "ask"], "forward", prefix="x_").where("x_t is not null")
    single = without_overlap(left, keys, "us", "x_t", ["us", "side"])
    entry, exit_ = side_price("side", "e_bid", "e_ask", True), side_price("side", "x_bid", "x_ask", False)
    return single.select(*keys, "us", "side", F.col("e_t").alias("entered_us"), F.col("x_t").alias("exited_us"), (F.col("x_t") - F.col("due") <= max_delay_us).alias("boundary_valid"), ((exit_ / entry - 1) * 10_000 * F.col("side")).alias("net_bps"))


def latency_replay(trades: DataFrame, quotes: DataFrame, keys: list[str], latencies_us: list[int], max_delay_us: int) -> DataFrame:
    """Each trade (keys, trade, side, entry_us, exit_us) executed with each latency: prices at the first quotes from then on, or the reason why not."""
    grid = trades.withColumn("latency_us", F.explode(F.array(*[F.lit(x).cast("long") for x in latencies_us]))).withColumn("e_due", F.col("entry_us") + F.col("latency_us")).withColumn("x_due", F.col("exit_us") + F.col("latency_us"))
    hit = asof(asof(grid, quotes, keys, "e_due", "us", ["bid", "ask"], "forward", tolerance_us=max_delay_us, prefix="e_"), quotes, keys, "x_due", "us", ["bid", "ask"], "forward", tolerance_us=max_delay_us, prefix="x_")
    reason = F.when(F.col("e_t").isNull(), "no_entry_quote").when(F.col("x_t").isNull(), "no_exit_quote")
    gross = F.when(F.col("side") > 0, F.col("x_bid") / F.col("e_ask") - 1).otherwise(F.col("e_bid") / F.col("x_ask") - 1) * 10_000
    return hit.select("trade", "side", "latency_us", reason.alias("reason"), F.when(reason.isNull(), gross).alias("gross_bps"))


def zones(bars: DataFrame, gaps: DataFrame, keys: list[str], expiry: int = 20) -> DataFrame:
    """bars with the latest gap zone before them (side, low, high), its age in bars, and whether a close has since been inside; null after expiry bars."""
    w = Window.partitionBy(*keys).orderBy("bar_us")
    marked = bars.select(*keys, "bar_us", "close").join(gaps.select(*keys, "bar_us", F.struct("side", "zone_low", "zone_high").alias("z")), [*keys, "bar_us"], "left")
    rows = marked.withColumn("i", F.row_number().over(w)).withColumn("n", F.count("z").over(w)).withColumn("zone", F.last("z", ignorenulls=True).over(w))
    run = Window.partitionBy(*keys, "n").orderBy("i")
    inside = (F.col("close") >= F.col("zone.zone_low")) & (F.col("close") <= F.col("zone.zone_high"))
    aged = rows.withColumn("age", F.col("i") - F.min("i").over(run)).withColumn("mitigated", F.max(inside.cast("int")).over(run) == 1)
    alive = F.col("zone").isNotNull() & (F.col("age") <= expiry)
    return aged.select(*keys, "bar_us", *[F.when(alive, F.col(c)).alias(n) for c, n in (("zone.side", "side"), ("zone.zone_low", "zone_low"), ("zone.zone_high", "zone_high"), ("age", "age"), ("mitigated", "mitigated"))])
