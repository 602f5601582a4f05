"""Order-dependent selections: greedy cooldown, greedy non-overlap, one-to-one matching, and a backtest's single position.

Each is a fold over one ordered group. Groups are first cut where the fold's state is known to reset, so that a hot key becomes many
independent groups; a group then streams through its task in order, with a state of a few numbers.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tickloom.operators.asof import asof
from tickloom.operators.shards import SHARD_US, carried, core, running_sum, shard_of, with_halo
from tickloom.session import cut


def ordered_fold(rows: DataFrame, keys: list[str], order: list[str], step: Callable[[object, tuple], tuple[object, bool]], inputs: list[str]) -> DataFrame:
    """The rows that step keeps: step(state, values of inputs) -> (state, keep), in order, from state None in each group."""
    schema = rows.schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, group = None, object()
        for pdf in batches:
            keep = np.zeros(len(pdf), bool)
            groups = zip(*[pdf[k].tolist() for k in keys])
            for i, (g, values) in enumerate(zip(groups, zip(*[pdf[c].tolist() for c in inputs]))):
                if g != group:
                    state, group = None, g
                state, keep[i] = step(state, values)
            yield pdf[keep]

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def _islands(rows: DataFrame, keys: list[str], start: str, reach: str, order: list[str]) -> DataFrame:
    """rows with _island: rows whose start is not before every earlier reach of their keys begin a new one."""
    # the latest reach so far, within shards and carried over them
    own = shard_of(start)
    tops = rows.groupBy(*keys, own.alias("_s")).agg(F.max(reach).alias("_m"))
    tops = tops.select(*keys, "_s", F.max("_m").over(Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    inside = F.max(reach).over(Window.partitionBy(*keys, "_s").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("_s", own).withColumn("_in", inside).join(tops, [*keys, "_s"], "left").withColumn("_far", F.greatest("_in", "_before")).drop("_s", "_in", "_before")
    return running_sum(marked, keys, order, F.when(F.col("_far").isNull() | (F.col(start) >= F.col("_far")), 1).otherwise(0), "_island", shard_of(start)).drop("_far")


def cooldown(rows: DataFrame, keys: list[str], t: str, order: list[str], wait_us: int) -> DataFrame:
    """Of each key the first row, and then each that lies at least wait_us after the last one kept.

    A row with no other within wait_us before it is kept whatever came before; the fold starts afresh there. Null keys or times are left out.
    """
    good = rows.dropna(subset=[*keys, t]).withColumn("_reach", F.col(t) + wait_us)
    parts = _islands(good, keys, t, "_reach", order)

    def step(last, values):
        return (values[0], True) if last is None or values[0] >= last + wait_us else (last, False)

    return ordered_fold(parts, [*keys, "_island"], order, step, [t]).drop("_island", "_reach")


def without_overlap(rows: DataFrame, keys: list[str], start: str, end: str, order: list[str]) -> DataFrame:
    """Greedy selection of spans: a span is taken if it starts at or after the end of the last one taken."""
    good = rows.dropna(subset=[*keys, start, end])
    parts = _islands(good, keys, start, end, order)

    def step(until, values):
        return (values[1], True) if until is None or values[0] >= until else (until, False)

    return ordered_fold(parts, [*keys, "_island"], order, step, [start, end]).drop("_island")


def _greedy_pairs(rows: list[tuple[int, int, str]], tolerance_us: int) -> Iterator[tuple[int, str, int, str]]:
    """Greedy pairs of one island: rows (time, side, ticket) in order of time and ticket, at each time one side only.

    The closest open pair always lies next to each other among the times that still have rows, so a heap of neighbours is enough.
    """
    times, sides, queues = [], [], []
    for t, side, ticket in rows:
        if not times or times[-1] != t:
            times.append(t)
            sides.append(side)
            queues.append(deque())
        queues[-1].append(ticket)
    before, after = list(range(-1, len(times) - 1)), [*range(1, len(times)), -1]
    heap: list[tuple[int, int, int]] = []

    def meet(i: int, j: int) -> None:
        if i >= 0 and j >= 0 and sides[i] != sides[j] and times[j] - times[i] <= tolerance_us:
            left = i if sides[i] == 0 else j
            heappush(heap, (times[j] - times[i], times[left], left))

    for i in range(len(times) - 1):
        meet(i, i + 1)
    while heap:
        lag, t, i = heappop(heap)
        # a left time may have right rows at the same distance on both sides; their tickets are taken in order
        near = [j for j in (before[i], after[i]) if j >= 0 and sides[j] == 1 and abs(times[j] - t) == lag and queues[j]]
        while queues[i] and near:
            j = min(near, key=lambda n: queues[n][0])
            yield t, queues[i].popleft(), times[j], queues[j].popleft()
            near = [n for n in near if queues[n]]
        for x in {i, before[i], after[i]} - {-1}:
            if not queues[x]:
                p, n = before[x], after[x]
                if p >= 0:
                    after[p] = n
                if n >= 0:
                    before[n] = p
                meet(p, n)


def match_one_to_one(left: DataFrame, right: DataFrame, keys: list[str], t: str, ticket: str, tolerance_us: int) -> DataFrame:
    """(keys, left_t, left_ticket, right_t, right_ticket, lag_us): greedy pairing within the tolerance, closest first.

    Pairs are taken in order of |lag|, left time, left and right ticket; each row is used once. Rows of one instant are paired first, by their
    rank of ticket on each side, which is what the order makes of them; so no instant's rows are multiplied with each other. What is left has
    one side at each instant. It is cut wherever no pair of left and right within the tolerance would cross, and each island is
    matched on its own, in time and memory of its rows. Null keys, times or tickets are left out.
    """
    side = lambda df, s: df.dropna(subset=[*keys, t, ticket]).select(*keys, F.col(t).cast("long").alias("_t"), F.col(ticket).cast("string").alias("_k"), F.lit(s).alias("_side"))
    both = side(left, 0).unionByName(side(right, 1)).withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "_t", "_side").orderBy("_k")))
    met = cut(both.groupBy(*keys, "_t", "_n").agg(F.max(F.when(F.col("_side") == 0, F.col("_k"))).alias("_left"), F.max(F.when(F.col("_side") == 1, F.col("_k"))).alias("_right")))
    at_once = met.where("_left is not null and _right is not null").select(*keys, F.col("_t").alias("left_t"), F.col("_left").alias("left_ticket"), F.col("_t").alias("right_t"), F.col("_right").alias("right_ticket"), F.lit(0).cast("long").alias("lag_us"))
    rest = met.where("_left is null or _right is null").select(*keys, "_t", "_n", F.when(F.col("_left").isNull(), 1).otherwise(0).alias("_side"), F.coalesce("_left", "_right").alias("_k"))
    # reach: just past the last row of the other side that a row could still pair with
    near = with_halo(rest, "_t", ahead_us=tolerance_us, shard_us=max(SHARD_US, tolerance_us))
    ahead = Window.partitionBy(*keys, "shard").orderBy("_t").rangeBetween(1, max(tolerance_us, 1))
    last = lambda s: F.max(F.when(F.col("_side") == s, F.col("_t"))).over(ahead)
    reach = F.coalesce(F.when(F.col("_side") == 0, last(1)).otherwise(last(0)) + 1, F.col("_t"))
    chained = _islands(core(near.withColumn("_reach", reach)), keys, "_t", "_reach", ["_t", "_n"])
    schema = ", ".join(f"{k} {both.schema[k].dataType.simpleString()}" for k in keys) + ", left_t long, left_ticket string, right_t long, right_ticket string, lag_us long"
    names = [*keys, "left_t", "left_ticket", "right_t", "right_ticket", "lag_us"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, rows = None, []

        def pairs() -> list[tuple]:
            # a row alone on its island has no partner
            return [(*group[:-1], t, a, u, b, u - t) for t, a, u, b in _greedy_pairs(rows, tolerance_us)] if len(rows) > 1 else []

        for pdf in batches:
            out = []
            for g, row in zip(zip(*[pdf[k].tolist() for k in [*keys, "_island"]]), zip(*[pdf[c].tolist() for c in ("_t", "_side", "_k")])):
                if g != group:
                    out += pairs()
                    group, rows = g, []
                rows.append(row)
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame(pairs(), columns=names)

    by = [*keys, "_island"]
    return at_once.unionByName(chained.repartition(*by).sortWithinPartitions(*by, "_t", "_n").mapInPandas(run, schema))


def backtest(ticks: DataFrame, intents: DataFrame, keys: list[str], latency_us: int = 250_000, slippage: float = 0.0) -> DataFrame:
    """Trades of a single position per key: (keys, opened_us, side, entry, closed_us, exit, reason, net_bps).

    ticks: keys, us, id, bid, ask; intents: keys, us, side (1/-1), stop, target (distances). An intent becomes executable latency_us later, at the
    first tick from then on, if no position is open after that tick's own exits; else it lapses. So does one with another side, a stop or target that
    isn't above zero, from before the first tick, or executable only after the last one. Of intents for one tick the earliest counts (then the larger side, stop and target).
    A position closes at the first later tick at which its stop (checked first) or target is reached; what is open at the end closes there. Fills are at ask for
    buys and bid for sells, worsened by slippage (a share of the price). Rows with a null key, time or price are left out.

    No series is one task: each intent's exit is looked for in the shard of its entry, then in the first later shard whose extremes reach its stop or
    target. What remains is to choose the spans that don't overlap, a fold over intents.
    """
    good = ticks.dropna(subset=[*keys, "us", "id", "bid", "ask"]).select(*keys, F.col("us").cast("long").alias("us"), F.col("id").cast("long").alias("id"), "bid", "ask")
    ends = good.groupBy(*keys).agg(F.min("us").alias("_first"), F.max(F.struct("us", "id", "bid", "ask")).alias("_end"))
    valid = intents.where((F.abs("side") == 1) & (F.col("stop") > 0) & (F.col("target") > 0)).select(*keys, F.col("us").cast("long").alias("at"), F.col("side").cast("int").alias("side"), F.col("stop").cast("double").alias("stop"), F.col("target").cast("double").alias("target"))
    valid = valid.join(ends, keys).where("at >= _first").withColumn("due", F.col("at") + latency_us)
    opened = asof(valid, good, keys, "due", "us", ["id", "bid", "ask"], "forward", prefix="o_").where("o_t is not null")
    long, sign = F.col("side") > 0, F.lit(slippage)
    entry = F.when(long, F.col("o_ask") * (1 + sign)).otherwise(F.col("o_bid") * (1 - sign))
    # of the intents for one tick only the first can get it
    order = F.struct("at", -F.col("side"), -F.col("stop"), -F.col("target"))
    first = Window.partitionBy(*keys, "o_t").orderBy(order)
    placed = opened.withColumn("_k", F.row_number().over(first)).where("_k = 1").withColumn("entry", entry)
    placed = placed.withColumn("low", F.col("entry") - F.when(long, F.col("stop")).otherwise(F.col("target"))).withColumn("high", F.col("entry") + F.when(long, F.col("target")).otherwise(F.col("stop")))
    placed = cut(placed.select(*keys, "at", "side", "entry", "low", "high", F.col("o_t").alias("o_us"), "o_id", "_end", shard_of("o_t").alias("_shard")))

    sharded = good.withColumn("_shard", shard_of("us"))
    near = _first_hits(placed, sharded, keys)
    found, open_ = near.where("x_us is not null"), near.where("x_us is null").drop("x_us", "x_id", "x_bid", "x_ask")
    extremes = sharded.groupBy(*keys, "_shard").agg(F.min("bid").alias("bl"), F.max("bid").alias("bh"), F.min("ask").alias("al"), F.max("ask").alias("ah"))
    reached = F.when(F.col("side") > 0, (F.col("bl") <= F.col("low")) | (F.col("bh") >= F.col("high"))).otherwise((F.col("al") <= F.col("low")) | (F.col("ah") >= F.col("high")))
    later = open_.alias("p").join(extremes.withColumnRenamed("_shard", "_far"), keys).where((F.col("_far") > F.col("_shard")) & reached).groupBy(*keys, "o_us").agg(F.min("_far").alias("_far"))
    further = open_.join(later, [*keys, "o_us"], "left")
    second = _first_hits(further.where("_far is not null").withColumn("_shard", F.col("_far")).drop("_far"), sharded, keys)
    rest = further.where("_far is null").drop("_far").withColumns({f"x_{c}": F.lit(None).cast(t) for c, t in (("us", "long"), ("id", "long"), ("bid", "double"), ("ask", "double"))})
    spans = found.unionByName(second).unionByName(rest)
    # what never closes holds the position for good
    never = F.col("x_us").isNull()
    spans = spans.withColumn("_until", F.when(never, (1 << 62)).otherwise(F.col("x_us"))).withColumn("_until_id", F.when(never, (1 << 62)).otherwise(F.col("x_id"))).withColumn("_reach", F.col("_until") + 1)

    def step(until, values):
        start, end = values[:2], values[2:]
        return (end, True) if until is None or start >= until else (until, False)

    parts = _islands(spans, keys, "o_us", "_reach", ["o_us"])
    taken = ordered_fold(parts, [*keys, "_island"], ["o_us"], step, ["o_us", "o_id", "_until", "_until_id"])
    out = lambda c: F.when(F.col("x_us").isNull(), F.col(f"_end.{c}")).otherwise(F.col(f"x_{c}"))
    exit_ = F.when(long, out("bid") * (1 - sign)).otherwise(out("ask") * (1 + sign))
    stopped = F.when(long, F.col("x_bid") <= F.col("low")).otherwise(F.col("x_ask") >= F.col("high"))
    reason = F.when(F.col("x_us").isNull(), "end").when(stopped, "stop").otherwise("target")
    return taken.select(*keys, F.col("o_us").alias("opened_us"), "side", "entry", out("us").alias("closed_us"), exit_.alias("exit"), reason.alias("reason"), (F.col("side") * (exit_ / F.col("entry") - 1) * 10_000).alias("net_bps"))


def _first_hits(spans: DataFrame, sharded: DataFrame, keys: list[str]) -> DataFrame:
    """spans (o_us, o_id, side, low, high, _shard) with the first tick of their shard, after (o_us, o_id), at which the executable price leaves (low, high)."""
    schema = StructType([*spans.schema.fields, *[StructField(f"x_{c}", sharded.schema[c].dataType) for c in ("us", "id", "bid", "ask")]])

    def find(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values(["us", "id"])
        us, ids, bid, ask = (right[c].to_numpy() for c in ("us", "id", "bid", "ask"))
        hits = np.full(len(left), -1)
        for n, (o_us, o_id, side, low, high) in enumerate(zip(*[left[c].tolist() for c in ("o_us", "o_id", "side", "low", "high")])):
            price = bid if side > 0 else ask
            at = int(np.searchsorted(us, o_us, "left"))
            while at < len(us) and us[at] == o_us and ids[at] <= o_id:
                at += 1
            size = 256
            while at < len(us):
                part = price[at : at + size]
                out = (part <= low) | (part >= high)
                if out.any():
                    hits[n] = at + int(out.argmax())
                    break
                at, size = at + size, size * 2
        some = hits >= 0
        return left.assign(**{f"x_{c}": pd.Series(np.where(some, v[hits], 0), index=left.index).astype(kind).where(some) for c, v, kind in (("us", us, "Int64"), ("id", ids, "Int64"), ("bid", bid, "float64"), ("ask", ask, "float64"))} if len(us) else {f"x_{c}": None for c in ("us", "id", "bid", "ask")})

    by = [*keys, "_shard"]
    own = sharded.join(spans.select(*by).distinct(), by, "left_semi")
    return spans.groupBy(*by).cogroup(own.groupBy(*by)).applyInPandas(find, schema)
