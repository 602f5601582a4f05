"""Row-level classes and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000
# Ids per shard where rows are taken in order of arrival.
ARRIVAL_SHARD = 1_000_000

# First hour (UTC) of each part of the trading day, and its label.
SESSIONS = ((0, "asia"), (7, "london"), (12, "london_new_york_overlap"), (16, "new_york"), (21, "maintenance_or_late"))
# Keyword groups of news relevance, and how a text's groups make its score.
RELEVANCE = {
    "gold": ("gold", "xau", "bullion"),
    "federal_reserve": ("federal reserve", "fomc", "fed chair", "interest rate"),
    "inflation": ("inflation", "cpi", "pce", "consumer price"),
    "employment": ("nonfarm", "payroll", "unemployment", "jobs report"),
    "usd_yields": ("dollar", "dxy", "treasury", "bond yield"),
    "geopolitics": ("war", "missile", "sanction", "ceasefire", "invasion", "conflict"),
    "systemic_risk": ("bank failure", "banking crisis", "default", "debt ceiling"),
    "physical_demand": ("central bank gold", "gold reserve", "china gold", "india gold"),
}
SCORE_BASE, SCORE_PER_GROUP, SCORE_FOR_GOLD = 0.25, 0.18, 0.25


def session_of(t: str) -> Column:
    """The part of the UTC day that an instant in microseconds lies in."""
    hour = F.floor(F.pmod(F.col(t), F.lit(24 * HOUR_US)) / HOUR_US)
    out = F.lit(SESSIONS[0][1])
    for first, label in SESSIONS[1:]:
        out = F.when(hour >= first, label).otherwise(out)
    return out


def level_of(value: str, low: float, high: float) -> Column:
    return F.when(F.col(value) < low, "low").when(F.col(value) < high, "medium").otherwise("high")


def relevance(rows: DataFrame, text: str) -> DataFrame:
    """rows with reasons (the keyword groups found in the text, in order) and score: 0 without any, else growing with their number, at most 1. Null texts have none."""
    lower = F.lower(F.coalesce(F.col(text), F.lit("")))
    found = [F.when(lower.rlike("|".join(words)), name) for name, words in RELEVANCE.items()]
    rows = rows.withColumn("reasons", F.array_compact(F.array(*found)))
    capped = F.least(F.lit(1.0), F.lit(SCORE_BASE) + F.lit(SCORE_PER_GROUP) * F.size("reasons"))
    score = F.least(F.lit(1.0), capped + F.when(F.array_contains("reasons", "gold"), SCORE_FOR_GOLD).otherwise(0.0))
    return rows.withColumn("score", F.when(F.size("reasons") == 0, 0.0).otherwise(F.round(score, 3)))


def quality_issues(ticks: DataFrame, keys: list[str], t: str, spread: str, number: str, wide: float, gap_us: int) -> DataFrame:
    """One row per quality issue of a tick: duplicate (same time and number seen before), wide_spread, time_gap (to the tick before)."""
    same = Window.partitionBy(*keys, t, number).orderBy("id")
    rows = ticks.withColumn("_k", F.row_number().over(same))
    from tickloom.operators.shards import carried, shard_of

    rows = carried(rows, keys, [t, "id"], F.col(t), "_prev", shard_of(t), strict=True)
    issue = lambda test, name: F.when(test, name)
    issues = F.array_compact(F.array(issue((F.col("_k") > 1) & F.col(number).isNotNull(), "duplicate"), issue(F.col(spread) > wide, "wide_spread"), issue(F.col(t) - F.col("_prev") > gap_us, "time_gap")))
    return rows.select("id", F.explode(issues).alias("issue"))


def arrival_issues(ticks: DataFrame, keys: list[str], t: str, spread: str, number: str, wide: float, gap_us: int) -> DataFrame:
    """One row per quality issue of a tick in order of arrival (id): duplicate (same time and number arrived before), wide_spread, and against the
    tick that arrived before it in its series out_of_order (an earlier time) or time_gap (a later one by more than gap_us).

    The tick before comes from shards of ids, carried over their ends, so no series is one task.
    """
    from tickloom.operators.shards import carried, shard_of

    rows = ticks.withColumn("_k", F.row_number().over(Window.partitionBy(*keys, t, number).orderBy("id")))
    rows = carried(rows, keys, ["id"], F.col(t), "_prev", shard_of("id", ARRIVAL_SHARD), strict=True)
    issues = F.array_compact(F.array(F.when((F.col("_k") > 1) & F.col(number).isNotNull(), "duplicate"), F.when(F.col(spread) > wide, "wide_spread"), F.when(F.col(t) < F.col("_prev"), "out_of_order"), F.when(F.col(t) - F.col("_prev") > gap_us, "time_gap")))
    return rows.select("id", F.explode(issues).alias("issue"))
