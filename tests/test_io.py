"""Readers, sinks, streams and the catalogue."""

from __future__ import annotations

import json
import os
from datetime import datetime, timezone

import pytest

from tickloom.operators import bars, late
from tickloom.plans import catalog
from tickloom.session import data_dir, us
from tickloom.sources import files, sinks
from tickloom.streaming import live


def micros(*parts):
    return int(datetime(*parts, tzinfo=timezone.utc).timestamp()) * 1_000_000


def test_tick_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿occurred_at,bid,ask\n2026-01-05T00:00:00Z,100,100.5\n2026-01-05T00:00:01Z,x,100\n2026-01-05T00:00:02+02:00,100,99\nbad,1,2\n")
    rows = files.read_ticks(spark, tmp_path / "a.csv", "s", "X").orderBy("row").collect()
    assert [r["errors"] for r in rows] == [[], ["price"], ["crossed"], ["timestamp"]] and rows[0]["us"] == micros(2026, 1, 5)
    (tmp_path / "b.csv").write_text("DATE;TIME;BID;ASK\n2026.07.05;12:00:00;1;2\n")
    assert files.read_ticks(spark, tmp_path / "b.csv", "s", "X", "Europe/Berlin").first()["us"] == micros(2026, 7, 5, 10)
    (tmp_path / "c.csv").write_text("occurred_at,price\n1,2\n")
    with pytest.raises(ValueError):
        files.read_ticks(spark, tmp_path / "c.csv", "s", "X")


def test_days_sides_and_order(spark, tmp_path):
    ticks = spark.createDataFrame([(i, micros(2026, 1, 5 + i % 2) + i, "s", "X", 1.0, 2.0) for i in range(6)], "row long, us long, source string, instrument string, bid double, ask double")
    files.write_days(ticks, tmp_path / "days")
    assert spark.read.parquet(str(tmp_path / "days")).where("day = 6").count() == 3
    report = files.order_report(ticks, 1_000_000).first()
    assert (report["rows"], report["out_of_order"], report["gaps"]) == (6, 2, 3)
    side = lambda rows: spark.createDataFrame(rows, "us long, price double")
    got = files.merge_sides(side([(1, 5.0), (2, 5.0), (3, 1.0)]), side([(1, 4.0), (3, 2.0), (4, 1.0)])).orderBy("us").collect()
    assert [r["problem"] for r in got] == [None, "missing_side", "crossed", "missing_side"]


def test_trade_files(spark, tmp_path):
    (tmp_path / "t.csv").write_text("Ticket,Symbol,Type,Lots,Open Time,Open Price,Close Time,Close Price,Profit,Swap\n1,xauusd,Buy,0.1,2026.01.05 10:00:00,100,2026.01.05 11:00:00,\"1,101\",5,-1\n1,xauusd,Buy,0.1,2026.01.05 10:00:00,100,2026.01.05 11:00:00,101,9,0\n2,x,hold,1,2026.01.05 10:00:00,1,2026.01.05 09:00:00,1,1,0\n")
    rows = files.read_trades(spark, tmp_path / "t.csv", "UTC").orderBy("row").collect()
    assert [(r["ticket"], r["net"], r["errors"]) for r in rows] == [("1", 4.0, []), ("2", 1.0, ["side", "order"])] and rows[0]["exit_price"] == 1101.0
    (tmp_path / "h.csv").write_text("Time;Type;Volume;Symbol;Price;Time;Price;Commission;Swap;Profit\n2026.01.05 10:00:00;Balance;;;;;;;;500\n2026.01.05 10:00:00;Buy;0.1;X;100;2026.01.05 11:00:00;101;-1;0;5\n2026.01.05 10:00:00;Buy Stop;0.1;X;100;;;;;\n")
    trades, cash, other = files.read_account_history(spark, tmp_path / "h.csv", 2)
    assert trades.first()["opened_us"] == micros(2026, 1, 5, 8) and cash.first()["amount"] == 500.0 and [r["type"] for r in other.collect()] == ["Buy Stop"]


def test_news_payloads(spark):
    body = json.dumps({"articles": [{"url": "u", "title": "Gold", "seendate": "20260105T101500Z", "domain": "d"}, {"title": None}]})
    got = files.news_articles(spark.createDataFrame([(body,), ("{broken",), (None,)], "payload string")).collect()
    assert len(got) == 1 and got[0]["occurred_us"] == micros(2026, 1, 5, 10, 15)
    series = json.dumps({"observations": [{"date": "2026-01-01", "value": "3.5", "realtime_start": "2026-02-01"}, {"date": "2026-02-01", "value": "."}]})
    assert [r["value"] for r in files.series_observations(spark.createDataFrame([(series,)], "payload string"), "CPI").collect()] == [3.5]


def test_publish_is_content_addressed_and_leaves_nothing_behind(spark, tmp_path):
    build = lambda: spark.range(5)
    one = sinks.publish(build, tmp_path, "x", ["b", "a"], {"k": 1}, labels_included=False)
    assert sinks.publish(lambda: pytest.fail("built again"), tmp_path, "x", ["a", "b"], {"k": 1}) == one
    assert sinks.open_dataset(spark, tmp_path, one, labels_included=False).count() == 5
    with pytest.raises(ValueError):
        sinks.open_dataset(spark, tmp_path, one, labels_included=True)
    with pytest.raises(ValueError):
        sinks.open_dataset(spark, tmp_path, one | {"data": "../.."})
    with pytest.raises(ZeroDivisionError):
        sinks.publish(lambda: spark.range(1 // 0), tmp_path, "x", ["c"], {})
    assert not list(tmp_path.glob("*.partial"))


def test_registry_chain(tmp_path):
    registry = sinks.Registry(tmp_path / "r.jsonl")
    first = registry.register("r1", "f", ["d"], 4)
    assert registry.register("r1", "f", ["d"], 4) == first and first["alpha_each"] == 0.0125
    registry.register("r2", "f", ["d"], 1)
    text = registry.path.read_text().replace('"hypotheses": 4', '"hypotheses": 3')
    registry.path.write_text(text)
    with pytest.raises(ValueError):
        registry.records()


def test_append_new_twice(spark, tmp_path):
    batch = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    assert sinks.append_new(batch, str(tmp_path / "t"), ["k"]) == 2 and sinks.append_new(batch, str(tmp_path / "t"), ["k"]) == 0


def test_streaming_bars_equal_batch_bars(spark, tmp_path):
    src = f"{data_dir('sf0.001')}/market_ticks.parquet"
    raw = spark.read.parquet(src).where("occurred_at is not null and bid > 0 and ask >= bid").orderBy("occurred_at")
    raw.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(raw.schema).parquet(str(tmp_path / "in"))
    q = live.live_bars(stream, late="400 days").writeStream.format("memory").queryName("bars").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    got = spark.table("bars").select("source", "instrument", "bar_us", "open", "high", "low", "close", "tick_count")
    want = bars.time_bars(bars.quotes(raw)).select(*got.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_streaming_retractions_add_up_to_the_batch_result(spark, tmp_path):
    src = spark.read.parquet(f"{data_dir('sf0.001')}/event_envelopes.parquet")
    rows = src.select(src.source.alias("table_key"), us("occurred_at").alias("event_us"), us("received_at").alias("arrived_us"), src.envelope_id.cast("double").alias("value"))
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = live.late_changes(stream).writeStream.format("memory").queryName("changes").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(180)
    got = {(r["k"], r["p"]): r["n"] for r in spark.sql("select table_key k, period_start_us p, sum(op * n) n from changes where op <> 0 group by all").collect()}
    batch = late.downstream(late.late_changelog(rows, ["table_key"]), ["table_key"], 300_000_000)
    assert got == {(r["table_key"], r["period_start_us"]): r["n"] for r in batch.collect()}


def test_every_oracle_has_its_query():
    assert set(catalog.oracles()) <= set(catalog.queries())


def test_core_does_not_import_llm():
    import pathlib
    import re

    root = pathlib.Path(catalog.__file__).resolve().parents[1]
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert not re.search(r"\bllm\b", path.read_text()), path


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con, folder = duckdb.connect(), data_dir("sf0.001")
    con.execute("set timezone = 'UTC'")
    for path in sorted(os.listdir(folder)):
        con.execute(f"create view {path.removesuffix('.parquet')} as select * from '{folder}/{path}'")
    return con


def table(rows, columns):
    """Rows as sorted tuples in order of the columns' names; whole doubles as integers, nan as null."""
    plain = lambda v: None if v is None or v != v else int(v) if isinstance(v, float) and v == int(v) else v
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


@pytest.mark.parametrize("name", ["p4_found", "p5_found", "p6_found", "p7_grid", "breakout_report", "sim08_backtest", "src12_ingest", "src22_recorder_files", "agg33_adversity", "lab16_robustness"])
def test_queries_equal_their_statements(spark, duck, name):
    got = catalog.queries()[name](spark, data_dir("sf0.001"))
    want = duck.execute(catalog.oracles()[name])
    columns = [c[0] for c in want.description]
    rows = table(want.fetchall(), columns)
    assert sorted(columns) == sorted(got.columns) and table(map(tuple, got.collect()), got.columns) == rows and rows


def test_instants_lie_in_their_sessions_time(spark):
    rows = catalog.queries()["p1_found"](spark, data_dir("sf0.001")).collect()
    texts = spark.read.parquet(f"{data_dir('sf0.001')}/recorder_rows.parquet").select("record_id", "received_utc", "server_time").collect()
    have = {(r["record_id"], f) for r in texts for f in ("received_utc", "server_time") if r[f]}
    found = {(r["row_key"], r["field"]): r["utc_us"] for r in rows if r["table_name"] == "recorder_rows"}
    assert found and set(found) <= have and all(micros(2025, 9, 1) < t < micros(2026, 1, 1) for t in found.values())
    both = [(found[k, "received_utc"], found[k, "server_time"]) for k, f in found if f == "received_utc" and (k, "server_time") in found]
    near = sum(abs(a - b) < 3_600_000_000 for a, b in both)
    assert near > 0.9 * len(both)


def test_days_are_replaced_one_by_one(spark, tmp_path):
    day = lambda d: spark.createDataFrame([(micros(2026, 1, d) + i, 1.0 * d) for i in range(5)], "us long, bid double")
    files.write_days(day(5), tmp_path / "d")
    files.write_days(day(6), tmp_path / "d")
    files.write_days(day(6).limit(2), tmp_path / "d")
    back = {r["day"]: r["count"] for r in spark.read.parquet(str(tmp_path / "d")).groupBy("day").count().collect()}
    assert back == {5: 5, 6: 2}


def test_history_is_imported_whole_or_not_at_all(spark, tmp_path):
    (tmp_path / "a.csv").write_text("occurred_at,bid,ask\n2026-01-05T00:00:00Z,1,2\n2026-01-05T00:00:02Z,1,2\n2026-01-05T00:00:01Z,1,2\n")
    (tmp_path / "b.csv").write_text("occurred_at,bid,ask\n2026-01-05T00:00:00Z,1,2\n2026-01-05T00:00:01Z,1\n2026-01-05T00:00:02Z,1,2,3\n")
    for name, why in (("a", "ordered"), ("b", "column_count")):
        with pytest.raises(ValueError, match=why):
            files.import_history(files.read_ticks(spark, tmp_path / f"{name}.csv", "s", "X"), tmp_path / "out")
    assert not (tmp_path / "out").exists()
    rows = {r["row"]: list(r["errors"]) for r in files.read_ticks(spark, tmp_path / "b.csv", "s", "X").collect()}
    assert rows == {2: [], 3: ["column_count"], 4: ["column_count"]}


def test_lines_are_numbered_by_file(spark, tmp_path):
    for name, n in (("a", 5), ("b", 40_000)):
        (tmp_path / f"{name}.txt").write_text("".join(f"{name}{i}\n" for i in range(1, n + 1)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        lines = files.numbered_lines(spark, f"{tmp_path}/*.txt").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(lines) == 40_005 and all(r["line"][1:] == str(r["file_line"]) for r in lines)


def test_trade_aliases_and_refusals(spark, tmp_path):
    (tmp_path / "t.csv").write_text("trade_id,item,action,lot,time,price,close_time,price_close,p_l,comm\n7,x,1,0.5,2026-01-05 10:00:00,2,2026-01-05 11:00:00,3,4,-1\n8,x,0,0.5,2026-01-05 10:00:00,2,,,,\n9,x,0,0.5,2026-01-05 10:00:00,2,2026-01-05 11:00:00,,1,\n")
    rows = {r["ticket"]: r for r in files.read_trades(spark, tmp_path / "t.csv", "+02:00", account="alias 123456").collect()}
    assert (rows["7"]["side"], rows["7"]["net"], rows["7"]["opened_us"], rows["7"]["duration_s"], rows["7"]["errors"]) == ("sell", 3.0, micros(2026, 1, 5, 8), 3600.0, [])
    assert rows["8"]["errors"] == [] and rows["9"]["errors"] == ["price"]
    with pytest.raises(ValueError, match="account number"):
        files.read_trades(spark, tmp_path / "t.csv", "UTC", account="123456")
    (tmp_path / "u.csv").write_text("ticket,symbol\n1,x\n")
    with pytest.raises(ValueError, match="lacks"):
        files.read_trades(spark, tmp_path / "u.csv", "UTC")


def test_calendars_and_macro_events(spark, tmp_path):
    body = {"timezone": "UTC", "effective_from": "2026-01-05", "effective_to_exclusive": "2026-01-10", "weekly_open_windows": [{"weekday": d, "start": "00:00", "end": "00:00"} for d in range(4)], "closed_intervals": [{"start": "2026-01-06T10:00:00Z", "end": "2026-01-06T11:00:00Z"}], "source_url": "https://x", "source_sha256": "a" * 64, "verified": True}
    (tmp_path / "c.json").write_text(json.dumps(body))
    calendar = files.read_calendar(spark, tmp_path / "c.json")
    h = lambda d, x: micros(2026, 1, d) + x * 3_600_000_000
    spans = spark.createDataFrame([(1, h(5, 23), h(6, 2)), (2, h(6, 9), h(6, 10)), (3, h(6, 9), h(6, 10) + 1), (4, h(8, 23), h(9, 1)), (5, h(4, 23), h(5, 1)), (6, h(9, 1), h(9, 2))], "n int, a long, z long")
    assert {r["n"]: r["market"] for r in files.classify_spans(spans, calendar, "a", "z").collect()} == {1: "open", 2: "open", 3: "closed", 4: "closed", 5: "out_of_range", 6: "closed"}
    (tmp_path / "c.json").write_text(json.dumps(body | {"verified": False}))
    with pytest.raises(ValueError):
        files.read_calendar(spark, tmp_path / "c.json")


def test_new_lines_leave_an_unfinished_one(spark, tmp_path):
    path = tmp_path / "a.txt"
    path.write_text("h\n1\n2")
    none = spark.createDataFrame([], "file string, lines long")
    lines, cursors = files.new_lines(spark, str(path), none)
    assert sorted(r["line"] for r in lines.collect()) == ["1", "h"]
    cursors = spark.createDataFrame(cursors.collect(), "file string, lines long")
    path.write_text("h\n1\n2\n3\n")
    lines, _ = files.new_lines(spark, str(path), cursors)
    assert sorted(r["line"] for r in lines.collect()) == ["2", "3"]


def test_payloads_and_pruning(spark, tmp_path):
    one = sinks.archive_payload(spark, tmp_path, "news", micros(2026, 1, 5), b"{}")
    assert sinks.archive_payload(spark, tmp_path, "news", micros(2026, 1, 5), b"{}") == one and "2026/01/05" in one and json.loads((tmp_path / one.removeprefix(f"{tmp_path}/")).with_suffix(".json.manifest").read_text())["bytes"] == 2
    rows = spark.createDataFrame([("a", "p1", 5, 9), ("a", "p2", 7, 1), ("a", "p3", 7, 1), ("b", "q", 0, 0)], "name string, path string, rows long, size long")
    assert {r["path"] for r in sinks.prunable(rows).where("keep").collect()} == {"p3", "q"}
