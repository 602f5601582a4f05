"""Queries p3 and p8 to p10, with the DuckDB statements of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import leakage, mixing, nearest, truncation
from tickloom.session import load, us


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    ticks = load(spark, d, "market_ticks").where("occurred_at is not null and bid is not null and ask is not null").select(F.col("instrument").alias("entity"), us("occurred_at").alias("t"), F.col("id").alias("rid"))
    side = lambda df, name, key, t, tol: df.select(F.lit(name).alias("left_table"), F.col(key).cast("string").alias("left_key"), F.col("instrument").alias("entity"), us(t).alias("t"), F.lit(tol).cast("long").alias("tol"))
    news = side(load(spark, d, "news_events"), "news_events", "event_key", "occurred_at", 30_000_000)
    reactions = side(load(spark, d, "reaction_measurements"), "reaction_measurements", "measurement_id", "before_time", 2_000_000)
    return nearest.nearest_by_time(news.unionByName(reactions).where("left_key is not null"), ticks)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("left_table", "left_key", F.col("rid").alias("tick_id")).distinct()


def p3_lags(spark: SparkSession, d: str) -> DataFrame:
    """Each pairing with its distance in time."""
    return _pairs(spark, d).select("left_table", "left_key", F.col("t").alias("left_us"), F.col("rid").alias("tick_id"), F.col("distance").alias("distance_us"))


def p8_passages(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(load(spark, d, "documents"), load(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_passages(spark, d).select("doc_id", "item_id")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(*mixing.prepared(load(spark, d, "documents"), load(spark, d, "mix_targets")))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    sized, rated = mixing.prepared(load(spark, d, "documents"), load(spark, d, "mix_targets"))
    return mixing.shares(mixing.mix(sized, rated), rated)


def p10_judged(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(load(spark, d, "documents"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_judged(spark, d).where("cut").select("doc_id").distinct()


def p10_sources(spark: SparkSession, d: str) -> DataFrame:
    return truncation.by_source(p10_judged(spark, d))


QUERIES = {f.__name__: f for f in (p3_found, p3_lags, p8_found, p8_passages, p9_mix, p9_shares, p10_found, p10_judged, p10_sources)}

_TICKS = "select instrument, epoch_us(occurred_at) as us, id from market_ticks where occurred_at is not null and bid is not null and ask is not null and instrument is not null"

_PAIRS = f"""
with ticks as ({_TICKS}),
lefts as (
  select distinct 'news_events' as left_table, event_key as left_key, instrument, epoch_us(occurred_at) as t, 30000000 as tol from news_events
  union all
  select distinct 'reaction_measurements', cast(measurement_id as varchar), instrument, epoch_us(before_time), 2000000 from reaction_measurements
),
ranked as (
  select l.left_table, l.left_key, l.t, m.id, abs(m.us - l.t) as distance, row_number() over (partition by l.left_table, l.left_key, l.t order by abs(m.us - l.t), m.id) as k
  from lefts l join ticks m on m.instrument = l.instrument and m.us >= l.t - l.tol and m.us <= l.t + l.tol
  where l.left_key is not null
)
"""

# Word folding, tokenizers and the hazard test have no SQL form; tests/llm holds them against brute force.
ORACLE = {
    "p3_found": _PAIRS + "select distinct left_table, left_key, id as tick_id from ranked where k = 1",
    "p3_lags": _PAIRS + "select left_table, left_key, t as left_us, id as tick_id, distance as distance_us from ranked where k = 1",
}
