"""Irregular readings onto a regular grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLOT_US = 60_000_000
MAX_GAP_SLOTS = 15
SHARD_SLOTS = 360


def _slope(prev: str, here: str, nxt: str, value: str) -> Column:
    """Shape-preserving derivative at a reading: weighted harmonic mean of the secants, zero at an extremum, the one secant at an end."""
    h0, h1 = F.col(f"{here}.us") - F.col(f"{prev}.us"), F.col(f"{nxt}.us") - F.col(f"{here}.us")
    d0, d1 = (F.col(f"{here}.{value}") - F.col(f"{prev}.{value}")) / h0, (F.col(f"{nxt}.{value}") - F.col(f"{here}.{value}")) / h1
    w0, w1 = 2 * h1 + h0, h1 + 2 * h0
    inner = F.when(d0 * d1 <= 0, 0.0).otherwise((w0 + w1) / (w0 / F.nullif(d0, F.lit(0.0)) + w1 / F.nullif(d1, F.lit(0.0))))
    return F.when(F.col(prev).isNull() & F.col(nxt).isNull(), 0.0).when(F.col(prev).isNull(), d1).when(F.col(nxt).isNull(), d0).otherwise(F.coalesce(inner, F.lit(0.0)))


def _hermite(left: str, right: str, t: Column, value: str) -> Column:
    h = (F.col(f"{right}.us") - F.col(f"{left}.us")).cast("double")
    s = (t - F.col(f"{left}.us")) / h
    return (
        (1 + 2 * s) * (1 - s) * (1 - s) * F.col(f"{left}.{value}")
        + s * (1 - s) * (1 - s) * h * F.col(f"{left}.d_{value}")
        + s * s * (3 - 2 * s) * F.col(f"{right}.{value}")
        + s * s * (s - 1) * h * F.col(f"{right}.d_{value}")
    )


def regular_grid(ticks: DataFrame, sessions: DataFrame, slot_us: int = SLOT_US, max_gap_slots: int = MAX_GAP_SLOTS, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """(source, instrument, batch_no, slot_start_us, bid, ask, status) for each whole slot inside a session.

    ticks: source, instrument, us, id, bid, ask; sessions: source, batch_no, instrument, opened_us, closed_us. A slot's reading is
    its last tick with both prices (ties by id); status is observed. A slot without one is filled from the
    monotone cubic (Fritsch-Carlson slopes) through the readings around it, evaluated at the slot's start; it is
    marked gap, with null prices, where no reading stands on both sides or more than max_gap_slots slots in a row are empty.
    A cubic never runs across such a gap, so its slopes are taken from its own segment.

    Ticks are reduced to one reading per slot before the shuffle, so that a hot instrument is no larger than its time span.
    Sessions are cut into shards of shard_slots; each shard also gets the readings of a halo of 2 * max_gap_slots + 2
    slots on each side, all that its own slots can depend on, so the result is the same for any shard size. Null keys or
    times, and sessions without a whole slot, give nothing; repeated sessions count once.
    """
    readings = (
        ticks.where("source is not null and instrument is not null and us is not null and bid is not null and ask is not null")
        .groupBy("source", "instrument", F.floor(F.col("us") / slot_us).cast("long").alias("slot"))
        .agg(F.max(F.struct("us", "id", "bid", "ask")).alias("r"))
    )
    first, last = F.ceil(F.col("opened_us") / slot_us).cast("long"), (F.floor(F.col("closed_us") / slot_us) - 1).cast("long")
    spans = sessions.select("source", "batch_no", "instrument", first.alias("first"), last.alias("last")).where("source is not null and instrument is not null and last >= first").distinct()
    # two steps, so that a long session never becomes one long array
    chunks = spans.withColumn("chunk", F.explode(F.sequence(F.floor((F.col("first") - 1) / shard_slots), F.floor((F.col("last") + 1) / shard_slots))))
    lo, hi = F.greatest(F.col("first") - 1, F.col("chunk") * shard_slots), F.least(F.col("last") + 1, (F.col("chunk") + 1) * shard_slots - 1)
    slots = chunks.withColumn("slot", F.explode(F.sequence(lo.cast("long"), hi.cast("long"))))
    whole = (F.col("slot") >= F.col("first")) & (F.col("slot") <= F.col("last"))
    grid = slots.withColumn("whole", whole).select("source", "batch_no", "instrument", "slot", "whole").join(readings, ["source", "instrument", "slot"], "left").where("whole or r is not null")

    halo = 2 * max_gap_slots + 2
    own = F.floor(F.col("slot") / shard_slots).cast("long")
    around = F.sequence(F.floor((F.col("slot") - halo) / shard_slots).cast("long"), F.floor((F.col("slot") + halo) / shard_slots).cast("long"))
    shard = F.when(F.col("r").isNull(), F.array(own)).otherwise(around)
    sharded = grid.withColumn("shard", F.explode(shard)).withColumn("known", F.col("r").isNotNull()).repartition("source", "batch_no", "instrument", "shard")

    keys = ["source", "batch_no", "instrument", "shard"]
    among = Window.partitionBy(*keys, "known").orderBy("slot")
    near = lambda other: F.when(F.abs(F.col(f"{other}.slot") - F.col("slot")) <= max_gap_slots + 1, F.col(f"{other}.r"))
    knots = (
        sharded.withColumn("at", F.struct("slot", "r")).withColumn("lagged", F.lag("at").over(among)).withColumn("led", F.lead("at").over(among)).withColumn("p", near("lagged")).withColumn("q", near("led"))
        .withColumn("knot", F.when(F.col("known"), F.struct("slot", F.col("r.us").alias("us"), F.col("r.bid").alias("bid"), F.col("r.ask").alias("ask"), _slope("p", "r", "q", "bid").alias("d_bid"), _slope("p", "r", "q", "ask").alias("d_ask"))))
    )
    w = Window.partitionBy(*keys).orderBy("slot")
    placed = knots.withColumn("left", F.last("knot", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("right", F.last("knot", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, -1)))
    start = F.col("slot") * slot_us
    between = F.coalesce(F.col("right.slot") - F.col("left.slot") - 1 <= max_gap_slots, F.lit(False))
    status = F.when(F.col("known"), "observed").when(between, "filled").otherwise("gap")
    out = placed.where((F.col("shard") == own) & F.col("whole")).withColumn("status", status)
    price = lambda c: F.when(F.col("known"), F.col(f"r.{c}")).when(F.col("status") == "filled", _hermite("left", "right", start, c)).alias(c)
    return out.select("source", "instrument", "batch_no", start.alias("slot_start_us"), price("bid"), price("ask"), "status")
