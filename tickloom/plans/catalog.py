"""All queries of the core library by name, with their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tickloom.plans import candidates, exchange, labs, labs_sql, market, market_sql, quality, quality_sql, research, sequence_lab, trades

MODULES = [quality, market, trades, labs, exchange, research, sequence_lab, candidates]
SQL_MODULES = [quality_sql, market_sql, trades, labs, labs_sql, exchange, research, sequence_lab, candidates]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: text for m in SQL_MODULES for name, text in m.ORACLE.items()}


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return market.breakout_report(spark, d)
