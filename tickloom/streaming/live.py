"""Structured Streaming counterparts of the batch operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickloom.session import us
from tickloom.sources.sinks import append_new

SERIES = ["source", "instrument"]


def live_bars(ticks: DataFrame, width: str = "5 minutes", late: str = "20 minutes") -> DataFrame:
    """Streaming bars: equal to the batch bars once a period is past the watermark. ticks: occurred_at, id, bid, ask and the series."""
    good = ticks.where("occurred_at is not null and bid > 0 and ask >= bid").withColumn("mid", (F.col("bid") + F.col("ask")) / 2)
    point = F.struct(us("occurred_at").alias("us"), "id", "mid")
    bars = good.withWatermark("occurred_at", late).groupBy(*SERIES, F.window("occurred_at", width)).agg(F.min(point).alias("f"), F.max(point).alias("l"), F.max("mid").alias("high"), F.min("mid").alias("low"), F.count(F.lit(1)).alias("tick_count"))
    return bars.select(*SERIES, us(F.col("window.start")).alias("bar_us"), F.col("f.mid").alias("open"), "high", "low", F.col("l.mid").alias("close"), "tick_count")


def without_repeats(rows: DataFrame, keys: list[str], event_time: str, late: str = "1 day") -> DataFrame:
    """Each message once; copies are known for as long as the watermark lets them come."""
    return rows.withWatermark(event_time, late).dropDuplicatesWithinWatermark(keys)


CHANGES = "table_key string, period_start_us long, version long, op int, n long, total double, low double, high double"
STATE = "periods map<long,struct<version:long,n:long,total:double,low:double,high:double>>"


def late_changes(rows: DataFrame, period_us: int = 300_000_000, lateness_us: int = 1_200_000_000, disorder: str = "35 days") -> DataFrame:
    """The streaming retraction flow: table_key, event_us, arrived_us, value in; -1 and +1 changes of the periods' aggregates out.

    State is keyed by (table_key, hour of the event), so that a hot key is spread over its hours, and holds a version, a count, a sum and the extremes per
    period. A batch's rows of a period make one version; they are folded as they come, never held together. Rows past the cut-off give a change with op 0. The watermark is on
    the arrival: rows may be processed out of its order by `disorder` (files replayed in any order need their whole span, a live feed an hour), and state of an hour goes
    when no row could still come in time, so none is ever counted afresh.
    """
    hour_us = 3_600_000_000
    hour = F.floor(F.col("event_us") / hour_us).cast("long").alias("hour")

    def fold(into: dict, pdf: pd.DataFrame) -> None:
        for period, part in pdf.groupby("period")["value"].agg(["size", "sum", "min", "max"]).iterrows():
            n, total, low, high = into.get(period, (0, 0.0, float("inf"), float("-inf")))
            into[period] = (n + int(part["size"]), total + float(part["sum"]), min(low, float(part["min"])), max(high, float(part["max"])))

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = {int(k): tuple(v.values()) if isinstance(v, dict) else tuple(v) for k, v in dict(state.get[0]).items()} if state.exists else {}
        fresh: dict[int, tuple] = {}
        refused: dict[int, tuple] = {}
        for pdf in batches:
            pdf = pdf.assign(period=(pdf["event_us"] // period_us) * period_us)
            late = pdf["arrived_us"] >= pdf["period"] + period_us + lateness_us
            fold(refused, pdf[late])
            fold(fresh, pdf[~late])
        out = [(key[0], int(p), -1, 0, *v) for p, v in refused.items()]
        for period, (n, total, low, high) in fresh.items():
            period = int(period)
            version = -1
            if period in held:
                version, *old = held[period]
                out.append((key[0], period, version + 1, -1, *old))
                n, total, low, high = n + old[0], total + old[1], min(low, old[2]), max(high, old[3])
            out.append((key[0], period, version + 1, 1, n, total, low, high))
            held[period] = (version + 1, n, total, low, high)
        state.update((held,))
        due = ((int(key[1]) + 1) * hour_us + period_us + lateness_us) // 1000
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["table_key", "period_start_us", "version", "op", "n", "total", "low", "high"])

    keyed = rows.where("event_us is not null and arrived_us is not null").select("table_key", "event_us", "arrived_us", F.coalesce("value", F.lit(0.0)).alias("value"), hour, F.timestamp_micros("arrived_us").alias("arrived"))
    return keyed.withWatermark("arrived", disorder).groupBy("table_key", "hour").applyInPandasWithState(update, CHANGES, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def live_cooldown(rows: DataFrame, key: str, t: str, wait_us: int) -> DataFrame:
    """Signals kept by the greedy cooldown, with the last kept time as state. Batches must come in event order, as replayed files do."""

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for v in sorted(v for pdf in batches for v in pdf[t].tolist()):
            if last is None or v >= last + wait_us:
                out.append((k[0], v))
                last = v
        if last is not None:
            state.update((int(last),))
        yield pd.DataFrame(out, columns=[key, t])

    return rows.where(F.col(t).isNotNull()).groupBy(key).applyInPandasWithState(update, f"{key} string, {t} long", "last long", "append", GroupStateTimeout.NoTimeout)


def append_stream(rows: DataFrame, path: str, keys: list[str], checkpoint: str) -> StreamingQuery:
    """Writes what is new by keys to a table; a batch that is run again after a failure adds nothing."""
    return rows.writeStream.foreachBatch(lambda batch, _: append_new(batch, path, keys)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replay(rows: DataFrame, t: str, order: list[str]):
    """Rows in event order on the driver, one partition at a time: a deterministic replay on a monotone clock."""
    last = None
    for row in rows.orderBy(t, *order).toLocalIterator(prefetchPartitions=True):
        if last is not None and row[t] < last:
            raise ValueError("the replay clock went back")
        last = row[t]
        yield row
