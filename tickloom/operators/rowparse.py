"""Separation of the text lines that don't parse from the valid records, with the reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.session import held

# The columns of a recorder file, in order.
RECORDER_COLUMNS = ("record_type", "received_utc", "server_time", "monotonic_ms", "session_id", "source_sequence", "broker", "server", "symbol", "bid", "ask", "spread_points")
# The record types of a recorder file.
RECORD_TYPES = ("tick", "heartbeat")

BOM = "﻿"
NUMBER = r"^ *[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)? *\z"


def quoting_broken(line: Column) -> Column:
    """Whether a double quote of the line opens inside a field, is left open, or closes before anything but a comma or the end."""
    parts = F.split(line, '"', -1)
    last = F.size(parts) - 1

    def outside_wrong(part: Column, i: Column) -> Column:
        opens = (i == last) | part.endswith(",") | (part == "")
        closes = (i == 0) | part.startswith(",") | (part == "")
        return (i % 2 == 0) & ~(opens & closes)

    return F.contains(line, F.lit('"')) & ((last % 2 != 0) | F.exists(F.transform(parts, outside_wrong), lambda wrong: wrong))


def fields_of(line: Column) -> Column:
    """The fields of a line whose quoting is right, as an array of texts without their quotes."""
    hidden = F.array_join(F.transform(F.split(line, '"', -1), lambda p, i: F.when(i % 2 == 1, F.replace(F.replace(p, F.lit("\x01"), F.lit("\x01a")), F.lit(","), F.lit("\x01b"))).otherwise(F.replace(p, F.lit("\x01"), F.lit("\x01a")))), '"')

    def bare(field: Column) -> Column:
        inner = F.when(field.startswith('"'), F.replace(field.substr(F.lit(2), F.length(field) - 2), F.lit('""'), F.lit('"'))).otherwise(field)
        return F.replace(F.replace(inner, F.lit("\x01b"), F.lit(",")), F.lit("\x01a"), F.lit("\x01"))

    return F.when(F.contains(line, F.lit('"')), F.transform(F.split(hidden, ",", -1), bare)).otherwise(F.split(line, ",", -1))


def positive_number(text: Column) -> Column:
    """Whether the text is a finite decimal number above zero; false for null."""
    value = F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))
    return F.coalesce((value > 0) & (value < float("inf")), F.lit(False))


def parse_lines(lines: DataFrame, columns: tuple[str, ...] = RECORDER_COLUMNS, types: tuple[str, ...] = RECORD_TYPES) -> DataFrame:
    """line_id, file_name, line_no, one nullable text per column, and errors: the reasons against the line in order.

    lines: line_id, file_name, line_no, line. A valid record has an empty errors array, so that both sides split from one pass.
    A line with broken quoting or a wrong number of columns has that one error and null fields. Headers (with or without a
    byte-order mark) and empty or null lines are left out; a trailing carriage return isn't part of a line. Nothing shuffles.
    """
    header = ",".join(columns)
    text = F.regexp_replace("line", r"\r\z", "")
    bare = F.when(text.startswith(BOM), F.substr(text, F.lit(2))).otherwise(text)
    rows = lines.select("line_id", "file_name", "line_no", text.alias("text"), bare.alias("bare")).where((F.col("bare") != "") & (F.col("bare") != header)).drop("bare")
    rows = held(held(rows, quoting=quoting_broken(F.col("text"))), fields=F.when(~F.col("quoting"), fields_of(F.col("text"))))
    rows = rows.withColumn("fits", F.coalesce(F.size("fields") == len(columns), F.lit(False)))
    rows = rows.select("line_id", "file_name", "line_no", "quoting", "fits", *[F.when(F.col("fits"), F.get("fields", F.lit(i))).alias(c) for i, c in enumerate(columns)])
    checks = [F.when(~F.col("record_type").isin(*types), "record_type"), *[F.when(~positive_number(F.col(c)), c) for c in ("bid", "ask")]]
    errors = F.when(F.col("quoting"), F.array(F.lit("quoting"))).when(~F.col("fits"), F.array(F.lit("column_count"))).otherwise(F.array_compact(F.array(*checks)))
    return held(rows, errors=errors).drop("quoting", "fits")


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.size("errors") > 0).select("line_id", F.element_at("errors", 1).alias("reason"))


def records(parsed: DataFrame) -> DataFrame:
    """The valid records with typed numbers; fields that a rule doesn't cover become null where they don't cast."""
    number = lambda c, kind: F.trim(F.col(c)).try_cast(kind).alias(c)
    typed = {"monotonic_ms": "long", "bid": "double", "ask": "double", "spread_points": "double"}
    return parsed.where(F.size("errors") == 0).select("line_id", "file_name", "line_no", *[number(c, typed[c]) if c in typed else F.col(c) for c in RECORDER_COLUMNS])
