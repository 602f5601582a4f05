"""Queries p1, p2 and p4 to p7: the core's data-quality operators over the quote pipeline's tables."""

from __future__ import annotations

from zoneinfo import available_timezones

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.operators import grid, late, rowparse, spikes, timestamps, upsert
from tickloom.operators.metrics import quantized
from tickloom.operators.quantiles import quantiles_of
from tickloom.session import cut, fits_broadcast, held, load, us, written


def _small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it is small enough, else as it is."""
    return F.broadcast(df) if fits_broadcast(df) else df


# --- p1 -------------------------------------------------------------------------------------------------------------


def _clock(df: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """df with the wall clock of its source or server; unknown ones get a null zone."""
    clocks = sources.select(F.col(key).alias("_k"), F.col("clock_zone").alias("zone"), F.col("clock_shift_hours").alias("shift_hours"), (F.col("date_order") == "mdy").alias("month_first")).where("_k is not null").dropDuplicates(["_k"])
    return df.join(_small(clocks), df[key] == F.col("_k"), "left").drop("_k")


def _zone_table(sources: DataFrame) -> timestamps.ZoneTable:
    """The zone names in use, as far as the zone database knows them: no more than it has."""
    names = [r[0] for r in sources.select("clock_zone").where(F.col("clock_zone").isin(*sorted(available_timezones()))).distinct().collect()]
    return timestamps.zone_table([*names, "UTC"])


def _tick_choice(twice: DataFrame, certain: DataFrame, ticks: DataFrame, sessions: DataFrame, block: int = 1024) -> DataFrame:
    """Of tick texts whose wall time occurs twice, the instant that fits the neighbours by number in the batch, the session and the row's arrival."""
    keys = twice.where("b is not null").select("source", "b").distinct()
    known = held(ticks.where("occurred_at is not null and source_sequence is not null").select("source", "source_sequence", us("occurred_at").alias("at")), q=upsert.sequence_pair("source_sequence")).where("q is not null").select("source", "q.b", "q.n", "at")
    known = known.unionByName(certain.where("b is not null").select("source", "b", "n", F.col("lo").alias("at")))
    known = known.join(_small(keys), ["source", "b"], "left_semi").groupBy("source", "b", "n").agg(F.min("at").alias("at"), F.max("at").alias("top")).withColumn("blk", F.floor(F.col("n") / block))
    # blocks of numbers, so that no batch, however long, is one task; the blocks' bounds carry over
    bounds = known.groupBy("source", "b", "blk").agg(F.min("at").alias("first"), F.max("top").alias("last"))
    asked = twice.where("b is not null").select("source", "b", F.floor(F.col("n") / block).alias("blk")).distinct()
    over = Window.partitionBy("source", "b").orderBy("blk")
    bounds = bounds.unionByName(asked.withColumns({"first": F.lit(None).cast("long"), "last": F.lit(None).cast("long")})).groupBy("source", "b", "blk").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    bounds = bounds.select("source", "b", "blk", F.max("last").over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("p0"), F.min("first").over(over.rowsBetween(1, Window.unboundedFollowing)).alias("n0"))
    # copies of a message ask once
    rows = twice.where("b is not null").select("source", "b", "n").distinct().withColumns({"at": F.lit(None).cast("long"), "top": F.lit(None).cast("long"), "blk": F.floor(F.col("n") / block), "asks": F.lit(True)})
    inside = Window.partitionBy("source", "b", "blk").orderBy("n")
    rows = known.withColumn("asks", F.lit(False)).unionByName(rows.select("source", "b", "n", "at", "top", "blk", "asks"))
    rows = rows.withColumn("p1", F.max("top").over(inside.rangeBetween(Window.unboundedPreceding, -1))).withColumn("n1", F.min("at").over(inside.rangeBetween(1, Window.unboundedFollowing))).where("asks")
    near = rows.join(bounds, ["source", "b", "blk"], "left").select("source", "b", "n", F.greatest("p0", "p1").alias("prev"), F.least("n0", "n1").alias("next"))
    spans = sessions.select("source", F.col("batch_no").alias("b"), us("opened_at").alias("opened"), us("closed_at").alias("closed")).where("source is not null and b is not null").groupBy("source", "b").agg(F.min("opened").alias("opened"), F.max("closed").alias("closed"))
    # rows without a number: the arrival of their neighbours in the ingest batch stands in for a missing arrival
    lost = twice.where("arrived is null and batch_id is not null").select("source", "batch_id").distinct()
    mates = ticks.select("source", "batch_id", us("received_at").alias("mate")).join(_small(lost), ["source", "batch_id"], "left_semi").groupBy("source", "batch_id").agg(F.min("mate").alias("mate"))
    full = twice.join(near, ["source", "b", "n"], "left").join(spans, ["source", "b"], "left").join(mates, ["source", "batch_id"], "left")
    low, high, seen = F.coalesce("prev", "opened"), F.coalesce("next", "closed"), F.coalesce("arrived", "mate")

    def cost(c: str):
        zero = F.lit(0).cast("long")
        return F.greatest(F.coalesce(low - F.col(c), zero), zero) + F.greatest(F.coalesce(F.col(c) - high, zero), zero)

    lag = lambda c: F.coalesce(F.abs(seen - F.col(c)), F.lit(0).cast("long"))
    later = (cost("hi") < cost("lo")) | ((cost("hi") == cost("lo")) & (lag("hi") < lag("lo")))
    return full.select("id", F.when(later, F.col("hi")).otherwise(F.col("lo")).alias("utc_us"))


def p1_conversions(spark: SparkSession, d: str) -> DataFrame:
    """Time texts of each table and field: how many there are, how many denote an instant, and the version of the zone table that converted them."""
    table = _zone_table(load(spark, d, "feed_sources"))
    found = p1_found(spark, d).groupBy("table_name", "field").agg(F.count(F.lit(1)).alias("converted"))
    n = lambda t, f, c: load(spark, d, t).agg(F.lit(t).alias("table_name"), F.lit(f).alias("field"), F.count(c).alias("texts"))
    texts = n("market_ticks", "occurred_at", "occurred_at_text").unionByName(n("recorder_rows", "received_utc", "received_utc")).unionByName(n("recorder_rows", "server_time", "server_time"))
    return texts.join(found, ["table_name", "field"], "left").na.fill(0, ["converted"]).withColumn("zone_version", F.lit(table.version))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    ticks, sources, recorder = load(spark, d, "market_ticks"), load(spark, d, "feed_sources"), load(spark, d, "recorder_rows")
    table = _zone_table(sources)
    pair = upsert.sequence_pair("source_sequence")
    texts = ticks.where("occurred_at_text is not null").select("id", "source", "batch_id", F.col("occurred_at_text").alias("text"), pair.alias("q"), us("received_at").alias("arrived")).withColumn("b", F.col("q.b")).withColumn("n", F.col("q.n")).drop("q")
    parsed = cut(timestamps.parse_texts(_clock(texts, sources, "source"), table).where("lo is not null"))
    certain, twice = parsed.where("lo = hi"), parsed.where("lo < hi")
    chosen = _tick_choice(twice, certain, ticks, load(spark, d, "feed_sessions"))
    of_ticks = certain.select("id", F.col("lo").alias("utc_us")).unionByName(chosen)
    of_ticks = of_ticks.select(F.lit("market_ticks").alias("table_name"), F.col("id").alias("row_key"), F.lit("occurred_at").alias("field"), "utc_us")

    rows = recorder.select("record_id", "server", "session_id", "monotonic_ms", "received_utc", "server_time")
    sides = rows.select("*", F.explode(F.array(F.struct(F.lit("received_utc").alias("field"), F.col("received_utc").alias("text")), F.struct(F.lit("server_time").alias("field"), F.col("server_time").alias("text")))).alias("s")).select("record_id", "server", "session_id", "monotonic_ms", "s.field", "s.text").where("text is not null")
    sides = _clock(sides, sources, "server")
    utc = F.col("field") == "received_utc"
    sides = sides.withColumn("zone", F.when(utc, "UTC").otherwise(F.col("zone"))).withColumn("shift_hours", F.when(utc, 0).otherwise(F.col("shift_hours")))
    parsed = cut(timestamps.parse_texts(sides, table).where("lo is not null").select("record_id", "server", "session_id", "monotonic_ms", "field", "lo", "hi"))
    certain, twice = parsed.where("lo = hi"), parsed.where("lo < hi")
    # the row's other time first; else the session's clock, by its monotonic reading
    own = certain.groupBy("record_id").agg(F.max("lo").alias("own"))
    of = ["server", "session_id"]
    near = written(certain.join(_small(twice.where("session_id is not null and server is not null").select(*of).distinct()), of, "left_semi").select(*of, "lo", (F.col("lo") - F.col("monotonic_ms") * 1000).alias("base")))
    clock = quantiles_of(near, of, "lo", {"middle": 0.5}).drop("_n").join(quantiles_of(near, of, "base", {"base": 0.5}).drop("_n"), of, "left")
    guess = F.coalesce(F.col("own"), F.col("base") + F.col("monotonic_ms") * 1000, F.col("middle"))
    fitted = twice.join(own, "record_id", "left").join(clock, ["server", "session_id"], "left")
    later = F.coalesce(F.abs(F.col("hi") - guess) < F.abs(F.col("lo") - guess), F.lit(False))
    chosen = fitted.select("record_id", "field", F.when(later, F.col("hi")).otherwise(F.col("lo")).alias("utc_us"))
    of_rows = certain.select("record_id", "field", F.col("lo").alias("utc_us")).unionByName(chosen)
    of_rows = of_rows.select(F.lit("recorder_rows").alias("table_name"), F.col("record_id").alias("row_key"), "field", "utc_us")
    return of_ticks.unionByName(of_rows)


# --- p2 -------------------------------------------------------------------------------------------------------------


def _quotes(spark: SparkSession, d: str) -> DataFrame:
    pair = upsert.sequence_pair("source_sequence")
    rows = load(spark, d, "market_ticks").where("occurred_at is not null and bid is not null and ask is not null")
    return held(rows.select("id", "source", "instrument", us("occurred_at").alias("t"), "bid", "ask", "source_sequence"), q=pair).select("id", "source", "instrument", "t", "bid", "ask", F.col("q.b").alias("b"), F.col("q.n").alias("n"))


def p2_flags(spark: SparkSession, d: str) -> DataFrame:
    return spikes.flag_quotes(_quotes(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    quotes = spikes.flag_quotes(_quotes(spark, d)).select(F.lit("market_ticks").alias("table_name"), F.col("id").alias("row_key"))
    readings = load(spark, d, "recorder_rows").select("record_id", "server", "symbol", "spread_points")
    spreads = spikes.flag_readings(readings, ["server", "symbol"], "spread_points", "record_id").select(F.lit("recorder_rows").alias("table_name"), F.col("record_id").alias("row_key"))
    return quotes.unionByName(spreads)


# --- p4 -------------------------------------------------------------------------------------------------------------

P4_KEYS = ["table_name", "source", "series"]


def _changes(spark: SparkSession, d: str, slot_us: int) -> DataFrame:
    ticks = load(spark, d, "market_ticks").select(F.lit("market_ticks").alias("table_name"), "source", F.col("instrument").alias("series"), us("occurred_at").alias("event_us"), us("received_at").alias("arrived_us"), ((F.col("bid") + F.col("ask")) / 2).alias("value"))
    envelopes = load(spark, d, "event_envelopes").select(F.lit("event_envelopes").alias("table_name"), "source", F.col("kind").alias("series"), us("occurred_at").alias("event_us"), us("received_at").alias("arrived_us"), F.lit(None).cast("double").alias("value"))
    return late.late_changelog(ticks.unionByName(envelopes), P4_KEYS, slot_us=slot_us)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    changes = _changes(spark, d, 60_000_000).where("verdict <> 'on_time'")
    return changes.select(*P4_KEYS[:1], "source", "series", "period_start_us", "verdict").distinct()


def p4_changelog(spark: SparkSession, d: str) -> DataFrame:
    return _changes(spark, d, 60_000_000).withColumn("total", quantized("total", 3))


def p4_hourly(spark: SparkSession, d: str) -> DataFrame:
    """Hourly row counts that follow from the five-minute changes alone."""
    return late.downstream(_changes(spark, d, 60_000_000), P4_KEYS, 3_600_000_000).select(*P4_KEYS, "period_start_us", F.col("n").cast("long").alias("n"))


# --- p5 -------------------------------------------------------------------------------------------------------------


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pair = upsert.sequence_pair("source_sequence")
    ticks = held(load(spark, d, "market_ticks").select("id", "source", "source_sequence", us("received_at").alias("received")).where("source is not null and source_sequence is not null"), q=pair).where("q is not null")
    ticks = ticks.select("id", "source", F.col("q.b").alias("b"), F.col("q.n").alias("n"), "received")
    of_ticks = upsert.superseded(ticks, ["source", "b", "n"], "received", "id").select(F.lit("market_ticks").alias("table_name"), F.col("id").alias("row_key"))
    rows = load(spark, d, "event_envelopes").select("envelope_id", upsert.canonical_uuid("event_id").alias("event"), upsert.canonical_key("idempotency_key").alias("key"), us("received_at").alias("received"))
    linked = upsert.linked_messages(rows, "event", "key").select("envelope_id", "message", "received")
    of_envelopes = upsert.superseded(linked, ["message"], "received", "envelope_id").select(F.lit("event_envelopes").alias("table_name"), F.col("envelope_id").alias("row_key"))
    return of_ticks.unionByName(of_envelopes)


# --- p6 -------------------------------------------------------------------------------------------------------------


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return rowparse.rejected(rowparse.parse_lines(load(spark, d, "recorder_lines")))


def p6_records(spark: SparkSession, d: str) -> DataFrame:
    return rowparse.records(rowparse.parse_lines(load(spark, d, "recorder_lines")))


# --- p7 -------------------------------------------------------------------------------------------------------------


def p7_grid(spark: SparkSession, d: str) -> DataFrame:
    """The whole grid with its prices: where the cubic shows."""
    return _grid(spark, d).withColumn("bid", quantized("bid")).withColumn("ask", quantized("ask"))


def _grid(spark: SparkSession, d: str) -> DataFrame:
    ticks = load(spark, d, "market_ticks").select("source", "instrument", us("occurred_at").alias("us"), "id", "bid", "ask")
    sessions = load(spark, d, "feed_sessions").select("source", "batch_no", "instrument", us("opened_at").alias("opened_us"), us("closed_at").alias("closed_us"))
    return grid.regular_grid(ticks, sessions)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark, d).where("status <> 'observed'").select("source", "instrument", "slot_start_us").distinct()


QUERIES = {f.__name__: f for f in (p1_found, p1_conversions, p2_found, p2_flags, p4_found, p4_changelog, p4_hourly, p5_found, p6_found, p6_records, p7_found, p7_grid)}
