"""Queries over readers, sinks and streams: tables go out as files of the formats the readers know, into the shared folder, and come back."""

from __future__ import annotations

import json
import uuid
from datetime import date, datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.operators import bars, rowparse
from tickloom.operators.metrics import quantized

from tickloom.plans.market_sql import B5, Q, qz
from tickloom.plans.quality_sql import _FIELDS6
from tickloom.plans.trades import T, trades
from tickloom.session import SharedFiles, ensure_checkpoint_dir, load, us, written
from tickloom.sources import files, sinks
from tickloom.streaming import live

S = bars.SERIES


def _folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/files-{uuid.uuid4().hex}"


def _ticks(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "market_ticks").where("occurred_at is not null")


def _iso(column: str = "occurred_at"):
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def src01_tick_files(spark, d):
    """Ticks as comma-separated files with ISO times, read back with a verdict a row."""
    out = _folder(spark)
    _ticks(spark, d).select(_iso().alias("Occurred_At"), "bid", "ask", "instrument", "source", "source_sequence").write.option("header", True).csv(out)
    rows = files.read_ticks(spark, f"{out}/*.csv", "none", "none")
    return rows.select("us", "instrument", "source", "source_sequence", "bid", "ask", F.array_join("errors", ",").alias("errors"))


def src02_date_time_files(spark, d):
    """Ticks as semicolon files with date and time columns on a clock two hours ahead, prices in hundredths."""
    out, at = _folder(spark), F.timestamp_micros(us("occurred_at") + 7_200_000_000)
    _ticks(spark, d).where("bid > 0 and ask >= bid").select(F.date_format(at, "yyyy.MM.dd").alias("DATE"), F.date_format(at, "HH:mm:ss.SSS").alias("TIME"), (F.col("bid") * 100).alias("BID"), (F.col("ask") * 100).alias("ASK"), "instrument", "source").write.option("header", True).option("sep", ";").csv(out)
    rows = files.read_ticks(spark, f"{out}/*.csv", "none", "none", "+02:00", price_scale=0.01)
    return rows.where(F.size("errors") == 0).select("us", "instrument", "source", quantized("bid").alias("bid"), quantized("ask").alias("ask"))


def src03_history(spark, d):
    """One series after the other as an ordered history file, imported by day after all rows passed; days as they are read back."""
    out, root = _folder(spark), _folder(spark)
    good = _ticks(spark, d).where("bid > 0 and ask >= bid and bid < 1e9 and ask < 1e9 and source is not null and instrument is not null")
    rows = good.select(_iso().alias("occurred_at"), "bid", "ask", "instrument", "source", F.col("id").cast("string").alias("source_sequence"))
    rows.repartition("source", "instrument").sortWithinPartitions("source", "instrument", "occurred_at", "source_sequence").write.option("header", True).csv(out)
    files.import_history(files.read_ticks(spark, f"{out}/*.csv", "none", "none"), root)
    back = spark.read.parquet(root)
    return back.groupBy("instrument", F.make_date("year", "month", "day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.max("us").alias("last_us"), F.max("bid").alias("high"))


def src04_order_report(spark, d):
    """Order, repeats and gaps of each source's ticks in order of arrival."""
    rows = _ticks(spark, d).where("bid > 0 and ask >= bid and source is not null and instrument is not null").select("source", "instrument", F.col("id").alias("row"), us("occurred_at").alias("us"), "bid", "ask")
    return files.order_report(rows, 60_000_000)


def src09_sides(spark, d):
    """The sides of the quotes, one an instant, as two exports, the bid one with holes, merged by time."""
    out = _folder(spark)
    one = _ticks(spark, d).where("bid > 0 and ask >= bid").groupBy(us("occurred_at").alias("us")).agg(F.max(F.struct("id", "bid", "ask")).alias("m"))
    for side in ("bid", "ask"):
        kept = one.where(F.col("us") % 7 != 0) if side == "bid" else one
        kept.select(_iso(F.timestamp_micros("us")).alias("Etc/UTC"), *[F.col(f"m.{side}").alias(c) for c in ("Open", "High", "Low", "Close")], F.lit(1).alias("Volume")).write.option("header", True).csv(f"{out}/{side}")
    return files.read_sides(spark, f"{out}/ask/*.csv", f"{out}/bid/*.csv")


MADE_UP = {"provider": "made-up", "read_only": True}


def _batches(spark, d) -> str:
    """The ticks as six-hour batches, each a CSV with its manifest. Of every ten batches the third's row count, the fifth's hash and the seventh's contract are wrong."""
    out, shared, six = _folder(spark), SharedFiles(spark), 21_600_000_000
    rows = _ticks(spark, d).where("bid > 0 and ask >= bid").withColumn("part", F.floor(us("occurred_at") / six))
    one = F.lit(1)
    export = rows.select("part", _iso().alias("occurred_at"), "bid", "ask", one.alias("bid_volume"), one.alias("ask_volume"), F.col("id").alias("source_sequence"))
    export.repartition("part").sortWithinPartitions("part", "occurred_at", "source_sequence").write.partitionBy("part").option("header", True).csv(out)
    got = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True).load(out).select(F.regexp_extract("path", r"part=(\d+)/", 1).cast("long").alias("part"), "path", F.sha2("content", 256).alias("sha"))
    iso = lambda t: datetime.fromtimestamp(t / 1e6, timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%fZ")
    # as many as there are quarters of a day
    for n, r in enumerate(got.join(rows.groupBy("part").count(), "part").orderBy("part").collect()):
        manifest = {**MADE_UP, "provider": "another" if n % 10 == 6 else "made-up", "csv": r["path"].split(f"/{out.rsplit('/', 1)[1]}/")[1], "rows": r["count"] + (n % 10 == 2), "sha256": r["sha"][::-1] if n % 10 == 4 else r["sha"], "start_utc": iso(r["part"] * six), "end_utc_exclusive": iso((r["part"] + 1) * six)}
        shared.write(f"{out}/b{n:05d}.manifest.json", json.dumps(manifest).encode())
    return out


def src11_batches(spark, d):
    """Discovery of batch files: the verdict on each."""
    return files.discover_batches(spark, _batches(spark, d), MADE_UP).select("name", "start_us", "end_us", "rows", "problem")


def src12_ingest(spark, d):
    """Ticks of the sound batches within an interval that begins in the first and ends in the last one."""
    root = _batches(spark, d)
    found = written(files.discover_batches(spark, root, MADE_UP))
    a, z = found.agg(F.min("start_us"), F.max("end_us")).first()
    rows = files.ingest_batches(spark, root, found, "made-up", "XAUUSD", a + 3_600_000_000, z - 3_600_000_000)
    return rows.where(F.size("errors") == 0).select("us", F.col("source_sequence").cast("long").alias("id"), "bid", "ask")


def src16_trades(spark, d):
    """Trades as a history file with the names a terminal gives, some rows spoilt, read back with a verdict a row."""
    out = _folder(spark)
    t, at = trades(spark, d), lambda c: F.date_format(F.timestamp_micros(c), "yyyy.MM.dd HH:mm:ss")
    side = F.when(F.col("ticket") % 97 == 0, "hold").when(F.col("side") > 0, "Buy").otherwise("sell")
    rows = t.select(F.col("ticket").alias("Trade ID"), F.concat(F.lit("s"), F.col("symbol").cast("string")).alias("Item"), side.alias("Action"), F.when(F.col("ticket") % 89 == 0, 0.0).otherwise(F.col("volume")).alias("Lot"), at("opened").alias("Open Time"), F.format_number(F.col("volume") * 1000 + 0.5, 2).alias("Price"), at(F.when(F.col("ticket") % 83 == 0, F.col("opened") - 86_400_000_000).otherwise(F.col("closed"))).alias("Close Time"), F.lit(10.0).alias("Close Price"), F.col("net").alias("P/L"), F.lit("a, b").alias("Comment"))
    # every row twice, as far as its ticket goes
    rows.unionByName(rows.withColumn("P/L", F.lit(0.0)).where(F.col("Trade ID") % 5 == 0)).repartition(1).sortWithinPartitions("Trade ID", F.desc(F.abs("P/L"))).write.option("header", True).option("quoteAll", True).csv(out)
    got = files.read_trades(spark, f"{out}/*.csv", "UTC", "provider_master", "provider", "provider")
    return got.select(F.col("ticket").cast("long").alias("ticket"), "symbol", "side", "volume", "opened_us", "closed_us", "entry_price", quantized("net", 3).alias("net"), "duration_s", F.array_join("errors", ",").alias("errors"))


def src19_copy_trades(spark, d):
    """Trades as one provider's file with offset times, some rows spoilt, read back with a verdict a row."""
    out, t = _folder(spark), trades(spark, d)
    at = lambda c: F.date_format(F.timestamp_micros(F.col(c) + 7_200_000_000), "yyyy-MM-dd'T'HH:mm:ss'+02:00'")
    t.select(F.lit("p1").alias("provider_id"), at("opened").alias("opened_at"), F.when(F.col("ticket") % 71 == 0, "soon").otherwise(at("closed")).alias("closed_at"), F.col("ticket").cast("string").alias("symbol"), F.when(F.col("ticket") % 73 == 0, "hold").when(F.col("side") > 0, "Buy").otherwise("sell").alias("side"), "volume", F.col("net").alias("net_profit")).write.option("header", True).csv(out)
    got = files.read_copy_trades(spark, f"{out}/*.csv")
    return got.select(F.col("symbol").cast("long").alias("ticket"), "opened_us", "closed_us", "side", "volume", quantized("net_profit", 3).alias("net"), F.array_join("errors", ",").alias("errors"))


def src14_archive(spark, d):
    """The sound batches archived twice by day of their start: what is in the archive."""
    root, archive = _batches(spark, d), _folder(spark)
    found = written(files.discover_batches(spark, root, MADE_UP))
    files.archive_batches(spark, root, found, archive)
    paths = files.archive_batches(spark, root, found, archive)
    return spark.createDataFrame([(p.removeprefix(f"{archive}/").rsplit("/", 1)[0], p.rsplit("/", 1)[1]) for p in paths], "day string, name string")


def join27_prefixes(spark, d):
    """Recorder files against a snapshot of their first lines, two of whose files were changed."""
    live, old = _recorder_files(spark, d), _folder(spark)
    rows = files.numbered_lines(spark, f"{live}/*/*.txt").withColumn("file_name", F.regexp_extract("file", r"file_name=([^/]*)/", 1))
    n = F.max("file_line").over(Window.partitionBy("file_name"))
    half = rows.withColumn("n", n).where(F.col("file_line") <= F.floor(F.col("n") / 2)).withColumn("value", F.when(F.col("file_line") % 50 == 7, F.concat("line", F.lit("x"))).otherwise(F.col("line")))
    half.repartition("file_name").sortWithinPartitions("file_name", "file_line").select("file_name", "value").write.partitionBy("file_name").text(old)
    got = files.prefix_differences(spark, f"{old}/*/*.txt", f"{live}/*/*.txt")
    return got.withColumn("name", F.regexp_extract("name", "file_name=(.*)", 1))


def str06_standing(spark, d):
    """Orders as signals, those of one priority invalidated twice: what stands, by priority."""
    path = f"{_folder(spark)}/events"
    signals = load(spark, d, "orders").select(F.col("o_orderkey").alias("signal_id"), "o_orderpriority")
    wrong = signals.where(F.col("o_orderpriority").startswith("3"))
    sinks.invalidate(wrong, path, "wrong priority")
    again = sinks.invalidate(wrong, path, "once more")
    return sinks.standing(signals, path).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.lit(again).cast("long").alias("again"))


def str13_health(spark, d):
    """Each source's feed as it stood at one instant."""
    rows = load(spark, d, "market_ticks").where("source is not null").select("source", us("received_at").alias("t"))
    return sinks.health(rows, ["source"], "t", 1_762_900_000_000_000, 600)


def src20_account_history(spark, d):
    """An account history with repeated column names at UTC+2: trades, cash flows and other orders counted and added up."""
    out = _folder(spark)
    t, at = trades(spark, d), lambda c: F.date_format(F.timestamp_micros(F.col(c) + 7_200_000_000), "yyyy.MM.dd HH:mm:ss")
    kind = F.when(F.col("ticket") % 11 == 0, "Balance").when(F.col("ticket") % 13 == 0, "Buy Stop").when(F.col("side") > 0, "Buy").otherwise("Sell")
    t.select(at("opened"), kind, "volume", F.concat(F.lit("s"), F.col("symbol").cast("string")), F.lit(1.5), at("closed"), F.lit(1.6), F.lit(-1.0), F.lit(0.5), "net").toDF(*[f"c{i}" for i in range(10)]).write.option("header", False).option("sep", ";").csv(out)
    got, cash, other = files.read_account_history(spark, out, 2)
    part = lambda df, name, value, first: df.agg(F.lit(name).alias("kind"), F.count(F.lit(1)).alias("n"), quantized(F.sum(value), 2).alias("total"), F.min(first).alias("first_us"))
    return part(got, "trades", F.col("profit"), "opened_us").unionByName(part(cash, "cash", F.col("amount"), "us")).unionByName(part(other, "other", F.lit(0.0), F.lit(None).cast("long")))


def _recorder_files(spark, d) -> str:
    out = _folder(spark)
    rows = load(spark, d, "recorder_lines").where("line is not null").select("file_name", "line_no", "line_id", F.col("line").alias("value"))
    rows.repartition("file_name").sortWithinPartitions("file_name", "line_no", "line_id").select("file_name", "value").write.partitionBy("file_name").text(out)
    return out


def src22_recorder_files(spark, d):
    """Recorder files as they lie on disk, with each line's number in its file and the first reason against it."""
    parsed = files.read_recorder(spark, f"{_recorder_files(spark, d)}/*/*.txt")
    name = F.regexp_extract("file_name", r"file_name=([^/]*)/", 1)
    return parsed.select(name.alias("file_name"), "line_no", "record_type", "symbol", F.element_at(F.concat("errors", F.array(F.lit(""))), 1).alias("reason"))


def src23_curated_quotes(spark, d):
    """The curated copy of the recorder's valid ticks: of a session and sequence number the last line."""
    parsed = rowparse.records(files.read_recorder(spark, f"{_recorder_files(spark, d)}/*/*.txt")).where("record_type = 'tick'")
    rows = parsed.withColumn("file_name", F.regexp_extract("file_name", r"file_name=([^/]*)/", 1)).where("session_id <> '' and source_sequence <> ''")
    return files.latest_rows(rows.select("session_id", "source_sequence", "file_name", "line_no", "symbol", "bid", "ask"), ["session_id", "source_sequence"], ["file_name", "line_no"])


def src22_last_seen(spark, d):
    """Per recorder file the last valid row's session and symbol."""
    got = files.last_seen(files.read_recorder(spark, f"{_recorder_files(spark, d)}/*/*.txt"))
    return got.select(F.regexp_extract("file_name", r"file_name=([^/]*)/", 1).alias("file_name"), "line_no", "session_id", "symbol")


def src26_quote_counters(spark, d):
    """Per recorder file: valid ticks, repeated ones (same session and number) and invalid lines."""
    parsed = written(files.read_recorder(spark, f"{_recorder_files(spark, d)}/*/*.txt").withColumn("file_name", F.regexp_extract("file_name", r"file_name=([^/]*)/", 1)))
    good = parsed.where("size(errors) = 0 and record_type = 'tick'")
    same = good.groupBy("file_name", "session_id", "source_sequence").agg(F.count(F.lit(1)).alias("n"))
    counts = same.groupBy("file_name").agg(F.sum("n").alias("ticks"), F.sum(F.col("n") - 1).alias("repeated"))
    return parsed.groupBy("file_name").agg(F.count(F.when(F.size("errors") > 0, 1)).alias("invalid")).join(counts, "file_name", "left").na.fill(0)


def src27_new_lines(spark, d):
    """What a second look at the recorder files finds beyond the first two hundred lines of each."""
    path = f"{_recorder_files(spark, d)}/*/*.txt"
    _, ends = files.new_lines(spark, path, spark.createDataFrame([], "file string, lines long"))
    lines, _ = files.new_lines(spark, path, ends.withColumn("lines", F.least("lines", F.lit(200))))
    return lines.groupBy(F.regexp_extract("file", r"file_name=([^/]*)/", 1).alias("file_name")).agg(F.count(F.lit(1)).alias("n"), F.max("file_line").alias("last_line"))


def src30_news_payloads(spark, d):
    """News as payloads of twenty articles each, taken apart again."""
    n = load(spark, d, "news_events").where("headline is not null and occurred_at is not null")
    article = F.struct(F.col("event_key").alias("url"), F.col("headline").alias("title"), F.date_format("occurred_at", "yyyyMMdd'T'HHmmss'Z'").alias("seendate"), F.col("source").alias("domain"), "language", F.col("source_country").alias("sourcecountry"))
    bodies = n.groupBy(F.pmod(F.xxhash64("event_key"), F.lit(20)).alias("part")).agg(F.to_json(F.struct(F.collect_list(article).alias("articles"))).alias("payload"))
    return files.news_articles(bodies).select("event_key", "title", "occurred_us", "source", "language", "source_country")


def src31_series(spark, d):
    """Daily totals as a macro series with a missing value a week, taken apart again."""
    daily = trades(spark, d).groupBy(F.to_date(F.timestamp_micros("closed")).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    seen = F.struct(F.date_format("day", "yyyy-MM-dd").alias("date"), F.when(F.dayofweek("day") == 1, ".").otherwise(F.col("n").cast("string")).alias("value"), F.date_format(F.date_add("day", 1), "yyyy-MM-dd").alias("realtime_start"), F.lit("9999-12-31").alias("realtime_end"))
    bodies = daily.groupBy(F.year("day").alias("y")).agg(F.to_json(F.struct(F.collect_list(seen).alias("observations"))).alias("payload"))
    return files.series_observations(bodies, "TRADES").select("event_key", F.col("date").cast("string").alias("date"), "value")


def src32_macro_calendar(spark, d):
    """News as a macro calendar, some rows against its rules: the verdict on each event, and the coverage."""
    out = _folder(spark)
    n = load(spark, d, "news_events").where("occurred_at is not null").groupBy("event_key").agg(F.min(us("occurred_at")).alias("t"))
    k = F.conv(F.substring(F.md5("event_key"), 1, 2), 16, 10).cast("int")
    iso = lambda c: F.date_format(F.timestamp_micros(c), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = n.select(F.col("event_key").alias("event_id"), F.when(k % 17 == 0, "gdp").when(k % 2 == 0, "cpi").otherwise("employment_situation").alias("event_family"), iso(F.col("t")).alias("scheduled_at_utc"), iso(F.col("t") + F.when(k % 13 == 0, -60_000_000).otherwise(5_000_000)).alias("released_at_utc"), iso(F.col("t") - F.when(k % 11 == 0, -9_000_000).otherwise(86_400_000_000)).alias("consensus_as_of_utc"), F.lit(2.5).alias("consensus"), F.lit(2.7).alias("initial_actual"), F.lit("%").alias("unit"), F.when(k % 19 == 0, "http://x").otherwise("https://x").alias("source_url"), F.sha2("event_key", 256).alias("snapshot_sha256"))
    rows.write.option("header", True).csv(out)
    events = files.read_macro_calendar(spark, f"{out}/*.csv")
    return events.select("event_id", "event_family", "released_us", F.array_join("errors", ",").alias("errors"))


def agg37_macro_coverage(spark, d):
    """Coverage of an event calendar by family, of the events that keep the rules."""
    n = load(spark, d, "news_events").where("occurred_at is not null").groupBy("event_key").agg(F.min(us("occurred_at")).alias("released_us"))
    k = F.conv(F.substring(F.md5("event_key"), 1, 2), 16, 10).cast("int")
    rows = n.select("released_us", F.when(k % 2 == 0, "cpi").otherwise("employment_situation").alias("event_family"), F.when(k % 7 == 0, F.array(F.lit("vintage"))).otherwise(F.array().cast("array<string>")).alias("errors"))
    return files.macro_coverage(rows)


CALENDAR = files.Calendar("America/New_York", date(2025, 10, 14), date(2025, 11, 12), tuple((w, 18 * 3600, 17 * 3600) for w in (6, 0, 1, 2, 3)), ((1_761_652_800_000_000, 1_761_667_200_000_000),))


def join21_calendar(spark, d):
    """Five-minute periods of each instrument's quotes against a session calendar across a change of clocks."""
    spans = bars.time_bars(bars.quotes(load(spark, d, "market_ticks"))).select("instrument", "bar_us").distinct()
    judged = files.classify_spans(spans.withColumn("z", F.col("bar_us") + 300_000_000), CALENDAR, "bar_us", "z")
    return judged.groupBy("instrument", "market").agg(F.count(F.lit(1)).alias("n"), F.min("bar_us").alias("first_us"))


def src35_calendar_file(spark, d):
    """A calendar file read and laid out as its open spans."""
    out = f"{_folder(spark)}/calendar.json"
    body = {"calendar_id": "made-up", "timezone": "America/New_York", "effective_from": "2025-10-14", "effective_to_exclusive": "2025-11-12", "weekly_open_windows": [{"weekday": w, "start": "18:00", "end": "17:00"} for w in (6, 0, 1, 2, 3)], "verified": True, "source_url": "https://example.org", "source_sha256": "0" * 64}
    SharedFiles(spark).write(out, json.dumps(body).encode())
    spans = files.read_calendar(spark, out).open_spans()
    return spark.createDataFrame([(a, z) for a, z in spans], "open_us long, close_us long")


def src38_ledger(spark, d):
    """A JSON-lines ledger written and read under its schema."""
    out = _folder(spark)
    load(spark, d, "event_envelopes").select("envelope_id", "kind", "source", "schema_version").write.json(out)
    return files.ledger(spark, out, "envelope_id long, kind string, source string, schema_version int")


def src28_snapshots(spark, d):
    """Archived files by content: how many differ and how many bytes they hold, written twice."""
    out = _folder(spark)
    for n in (1, 2):
        load(spark, d, "nation").select(F.concat_ws(",", "n_nationkey", "n_name").alias("value")).repartition(1).sortWithinPartitions("value").write.text(f"{out}/{n}")
    got = files.snapshots(spark, out, "*.txt")
    return got.agg(F.count(F.lit(1)).alias("files"), F.count_distinct("sha256").alias("contents"), F.sum("size").alias("bytes"))


def snk01_published(spark, d):
    """Five-minute bars as a content-addressed dataset, published twice and opened by its manifest."""
    root = _folder(spark)
    build = lambda: bars.time_bars(bars.quotes(load(spark, d, "market_ticks")))
    sinks.publish(build, root, "bars", ["market_ticks"], {"width": 300}, labels_included=False)
    manifest = sinks.publish(lambda: 1 / 0, root, "bars", ["market_ticks"], {"width": 300}, labels_included=False)
    return sinks.open_dataset(spark, root, manifest, labels_included=False).drop("close_us")


def snk02_outcomes(spark, d):
    """Bar outcomes of three horizons as one dataset with a folder per horizon."""
    from tickloom.operators import outcomes

    root = _folder(spark)
    five = written(bars.time_bars(bars.quotes(load(spark, d, "market_ticks"))))
    manifest = sinks.publish_outcomes(lambda steps: outcomes.bar_outcomes(five, 300_000_000, steps), [1, 2, 4], root, ["bars"], {"slippage": 0})
    rows = sinks.open_dataset(spark, root, manifest, labels_included=True)
    return rows.groupBy("horizon_s").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("valid"), 1)).alias("valid"), quantized(F.avg("long_net_bps"), 3).alias("mean"))


def snk07_curated(spark, d):
    """Ticks of each series and number, the last arrival, by day."""
    rows = _ticks(spark, d).where("source_sequence is not null and source is not null").select("source", "source_sequence", us("received_at").alias("received"), "id", "bid", "ask", us("occurred_at").alias("us"))
    kept = files.latest_rows(rows.where("received is not null"), ["source", "source_sequence"], ["received", "id"])
    return kept.groupBy("source", F.floor(F.col("us") / 86_400_000_000).cast("long").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


def snk09_inserted(spark, d):
    """Envelopes inserted by key in overlapping batches, one of them twice: one row a key."""
    path = f"{_folder(spark)}/events"
    rows = load(spark, d, "event_envelopes").where("trim(idempotency_key) <> ''").select(F.lower(F.trim("idempotency_key")).alias("key"), "kind")
    for part in (0, 1, 1, 2):
        sinks.append_new(rows.where(F.pmod(F.crc32("key"), F.lit(3)) <= part).select("key"), path, ["key"])
    return spark.read.parquet(path)


def snk12_registry(spark, d):
    """Experiments of each instrument in a hash-chained register: their share of the error, and all hypotheses together."""
    import tempfile

    names = [r[0] for r in load(spark, d, "feed_sessions").select("instrument").where("instrument is not null").distinct().orderBy("instrument").collect()]
    with tempfile.TemporaryDirectory() as folder:  # the register is the driver's own file
        register = sinks.Registry(f"{folder}/r.jsonl")
        for n, name in enumerate(names, 1):
            register.register(name, "sessions", ["feed_sessions"], n)
        register.register(names[0], "sessions", ["feed_sessions"], 99)
        rows = [(r["sequence"], r["report_id"], r["hypotheses"], r["alpha_each"]) for r in register.records()]
    df = spark.createDataFrame(rows, "sequence long, report_id string, hypotheses long, alpha_each double")
    return df.select("sequence", "report_id", "hypotheses", quantized("alpha_each", 9).alias("alpha_each"), F.sum("hypotheses").over(Window.partitionBy()).alias("total"))


def snk13_prunable(spark, d):
    """Which snapshots of each source may go: all but the one with most rows, then most bytes."""
    rows = load(spark, d, "feed_sessions").select(F.col("source").alias("name"), F.concat_ws("/", "instrument", F.col("batch_no").cast("string")).alias("path"), F.length("instrument").cast("long").alias("rows"), F.col("batch_no").cast("long").alias("size"))
    return sinks.prunable(rows)


def _stream(spark: SparkSession, rows: DataFrame, parts: int = 3):
    """rows as a stream of files, one a batch, in order of their first column."""
    src = _folder(spark)
    rows.repartitionByRange(parts, rows.columns[0]).sortWithinPartitions(rows.columns[0]).write.parquet(src)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(src)


def _drained(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gives until it has no more input."""
    out, mark = _folder(spark), _folder(spark)
    if mode == "complete":
        query = stream.writeStream.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).outputMode(mode)
    else:
        query = stream.writeStream.format("parquet").option("path", out).outputMode(mode)
    query.option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def str03_live_bars(spark, d):
    """Streaming five-minute bars of all ticks."""
    rows = _ticks(spark, d).where("source is not null and instrument is not null").select("occurred_at", "id", "bid", "ask", *S)
    return _drained(spark, live.live_bars(_stream(spark, rows), late="400 days"), "complete")


def str05_late_changes(spark, d):
    """Streaming retractions of five-minute counts in order of arrival: what the changes of each source add up to, and what was refused."""
    rows = load(spark, d, "event_envelopes").where("occurred_at is not null and received_at is not null").select(us("received_at").alias("arrived_us"), us("occurred_at").alias("event_us"), F.coalesce("source", F.lit("")).alias("table_key"), F.lit(1.0).alias("value"))
    got = _drained(spark, live.late_changes(_stream(spark, rows)))
    return got.groupBy("table_key").agg(F.sum(F.when(F.col("op") != 0, F.col("op") * F.col("n"))).alias("n"), F.coalesce(F.sum(F.when(F.col("op") == 0, F.col("n"))), F.lit(0)).alias("refused"))


def str09_live_cooldown(spark, d):
    """Streaming cooldown of ten minutes over each source's envelopes in event order."""
    rows = load(spark, d, "event_envelopes").where("occurred_at is not null and source is not null").select(us("occurred_at").alias("us"), "source")
    return _drained(spark, live.live_cooldown(_stream(spark, rows, 1), "source", "us", 600_000_000))


def str12_appended(spark, d):
    """A stream of envelope keys appended once each to a table."""
    path = f"{_folder(spark)}/keys"
    rows = load(spark, d, "event_envelopes").where("trim(idempotency_key) <> ''").select("envelope_id", F.lower(F.trim("idempotency_key")).alias("key"))
    live.append_stream(_stream(spark, rows).select("key"), path, ["key"], _folder(spark)).awaitTermination()
    return spark.read.parquet(path)


_VALID = "bid > 0 and ask > 0 and bid < 'inf'::double and ask < 'inf'::double"
_K = "('0x' || substr(md5(event_key), 1, 2))::int"
_RECORDER = _FIELDS6.replace("from recorder_lines)", "from recorder_lines where line is not null)").replace("select line_id, file_name, line_no,", "select line_id, file_name, row_number() over (partition by file_name order by line_no, line_id) as line_no,", 1)
# New York's clock goes back on the second of November 2025
_SPANS = """lc as (select epoch_us(d) + 64800000000 as al, epoch_us(d) + 147600000000 as zl from range(timestamp '2025-10-13', timestamp '2025-11-13', interval 1 day) r(d) where dayofweek(d) <= 4),
cal as (select al + case when al < epoch_us(timestamp '2025-11-02 02:00:00') then 14400000000 else 18000000000 end as a, zl + case when zl < epoch_us(timestamp '2025-11-02 02:00:00') then 14400000000 else 18000000000 end as z from lc)"""
_PARTS = "p as (select epoch_us(occurred_at) as us, id, bid, ask, cast(floor(epoch_us(occurred_at) / 21600000000) as bigint) as part from market_ticks where occurred_at is not null and bid > 0 and ask >= bid), n as (select part, row_number() over (order by part) - 1 as n from (select distinct part from p)), k as (select p.*, n.n from p join n using (part))"

ORACLE = {
    "src01_tick_files": f"select epoch_us(occurred_at) as us, coalesce(nullif(instrument, ''), 'none') as instrument, coalesce(nullif(source, ''), 'none') as source, coalesce(trim(source_sequence), '') as source_sequence, bid, ask, concat_ws(',', case when not coalesce({_VALID}, false) then 'price' end, case when ask < bid then 'crossed' end) as errors from market_ticks where occurred_at is not null",
    "src02_date_time_files": f"select cast(floor(epoch_us(occurred_at) / 1000) as bigint) * 1000 as us, coalesce(instrument, 'none') as instrument, coalesce(source, 'none') as source, {qz('bid')} as bid, {qz('ask')} as ask from market_ticks where occurred_at is not null and bid > 0 and ask >= bid and {_VALID}",
    "src03_history": "select instrument, strftime(occurred_at, '%Y-%m-%d') as day, count(*) as n, max(epoch_us(occurred_at)) as last_us, max(bid) as high from market_ticks where occurred_at is not null and bid > 0 and ask >= bid and bid < 1e9 and ask < 1e9 and source is not null and instrument is not null group by all",
    "src04_order_report": "with x as (select epoch_us(occurred_at) - lag(epoch_us(occurred_at)) over w as g, bid = lag(bid) over w and ask = lag(ask) over w as same from market_ticks where occurred_at is not null and bid > 0 and ask >= bid and source is not null and instrument is not null window w as (partition by source, instrument order by id)) select count(*) as rows, count(*) filter (where g < 0) as out_of_order, count(*) filter (where g = 0 and same) as duplicates, count(*) filter (where g > 60000000) as gaps, max(g) as longest_gap_us from x",
    "src09_sides": "with o as (select epoch_us(occurred_at) as us, arg_max(bid, id) as bid, arg_max(ask, id) as ask from market_ticks where occurred_at is not null and bid > 0 and ask >= bid group by 1) select us, case when us % 7 <> 0 then bid end as bid, ask, case when us % 7 = 0 then 'missing_side' end as problem from o",
    "src11_batches": f"with {_PARTS} select 'b' || lpad(cast(n as varchar), 5, '0') || '.manifest.json' as name, part * 21600000000 as start_us, (part + 1) * 21600000000 as end_us, count(*) + case when n % 10 = 2 then 1 else 0 end as rows, case n % 10 when 2 then 'rows' when 4 then 'checksum' when 6 then 'contract' end as problem from k group by n, part",
    "src12_ingest": f"with {_PARTS} select us, id, bid, ask from k where n % 10 not in (2, 4, 6) and us >= (select min(part) from n) * 21600000000 + 3600000000 and us < (select max(part) + 1 from n) * 21600000000 - 3600000000",
    "src16_trades": f"""with {T}, one as (select * from trades qualify row_number() over (partition by ticket order by abs(net) desc) = 1) select ticket, 'S' || symbol as symbol, case when ticket % 97 = 0 then null when side > 0 then 'buy' else 'sell' end as side, case when ticket % 89 = 0 then 0.0 else volume end as volume, opened as opened_us, case when ticket % 83 = 0 then opened - 86400000000 else closed end as closed_us,
  volume * 1000 + 0.5 as entry_price, {qz('net', 3)} as net, (case when ticket % 83 = 0 then -86400000000 else closed - opened end) / 1000000 as duration_s, concat_ws(',', case when ticket % 97 = 0 then 'side' end, case when ticket % 89 = 0 then 'volume' end, case when ticket % 83 = 0 then 'order' end) as errors from one""",
    "src19_copy_trades": f"""with {T} select ticket, opened as opened_us, case when ticket % 71 <> 0 then closed end as closed_us, case when ticket % 73 = 0 then 'hold' when side > 0 then 'buy' else 'sell' end as side, volume, {qz('net', 3)} as net, concat_ws(',', case when ticket % 71 = 0 then 'times' end, case when ticket % 73 = 0 then 'side' end) as errors from trades""",
    "src14_archive": f"with {_PARTS} select strftime(make_timestamp(part * 21600000000), '%Y/%m/%d') as day, 'b' || lpad(cast(n as varchar), 5, '0') || '.manifest.json' as name from n where n % 10 not in (2, 4, 6)",
    "join27_prefixes": "with l as (select file_name, row_number() over (partition by file_name order by line_no, line_id) as k, count(*) over (partition by file_name) as n from recorder_lines where line is not null) select file_name as name, count(*) as lines, 0 as missing, count(*) filter (where k % 50 = 7) as different from l where k <= floor(n / 2) group by file_name",
    "str06_standing": "select o_orderpriority, count(*) as n, 0 as again from orders where o_orderpriority not like '3%' group by 1",
    "str13_health": "with x as (select source, count(*) as rows, max(epoch_us(received_at)) as latest_us from market_ticks where source is not null group by source) select *, greatest((1762900000000000 - latest_us) / 1000000, 0) as age_s, case when latest_us is null then 'empty' when (1762900000000000 - latest_us) / 1000000 > 600 then 'stale' else 'healthy' end as status from x",
    "src20_account_history": f"""with {T}, k as (select *, case when ticket % 11 = 0 then 'cash' when ticket % 13 = 0 then 'other' else 'trades' end as kind from trades)
select kind, count(*) as n, {qz("case when kind = 'other' then 0.0 else sum(net) end", 2)} as total, case when kind <> 'other' then min(opened) end as first_us from k group by kind""",
    "src22_recorder_files": _RECORDER + "select file_name, line_no, record_type, symbol, coalesce(reason, '') as reason from judged",
    "src23_curated_quotes": _RECORDER + "select session_id, source_sequence, max_by(file_name, (file_name, line_no)) as file_name, max_by(line_no, (file_name, line_no)) as line_no, max_by(symbol, (file_name, line_no)) as symbol, max_by(try_cast(trim(bid) as double), (file_name, line_no)) as bid, max_by(try_cast(trim(ask) as double), (file_name, line_no)) as ask from judged where reason is null and record_type = 'tick' and session_id <> '' and source_sequence <> '' group by session_id, source_sequence",
    "src22_last_seen": _RECORDER + "select file_name, max(line_no) as line_no, max_by(session_id, line_no) as session_id, max_by(symbol, line_no) as symbol from judged where reason is null group by file_name",
    "src26_quote_counters": _RECORDER + ", g as (select file_name, session_id, source_sequence, count(*) as n from judged where reason is null and record_type = 'tick' group by all), c as (select file_name, cast(sum(n) as bigint) as ticks, cast(sum(n - 1) as bigint) as repeated from g group by file_name) select file_name, count(reason) as invalid, coalesce(any_value(ticks), 0) as ticks, coalesce(any_value(repeated), 0) as repeated from judged left join c using (file_name) group by file_name",
    "src27_new_lines": "with n as (select file_name, count(*) as n from recorder_lines where line is not null group by file_name) select file_name, n - 200 as n, n as last_line from n where n > 200",
    "src30_news_payloads": "with n as (select event_key as url, headline as title, strftime(occurred_at, '%Y%m%dT%H%M%SZ') as seen, cast(floor(epoch_us(occurred_at) / 1000000) as bigint) * 1000000 as occurred_us, source, language, source_country from news_events where headline is not null and headline <> '' and occurred_at is not null) select 'gdelt:' || sha256(url || '|' || seen || '|' || title) as event_key, title, occurred_us, coalesce(source, 'gdelt') as source, language, source_country from n",
    "src31_series": f"with {T}, dd as (select cast(make_timestamp(closed) as date) as day, count(*) as n from trades group by 1) select 'TRADES:' || strftime(day, '%Y-%m-%d') || ':' || strftime(day + 1, '%Y-%m-%d') as event_key, strftime(day, '%Y-%m-%d') as date, cast(n as double) as value from dd where dayofweek(day) <> 0",
    "src32_macro_calendar": f"""with n as (select event_key, min(epoch_us(occurred_at)) as t, {_K} as k from news_events where occurred_at is not null group by event_key), e as (select *, case when k % 17 = 0 then 'gdp' when k % 2 = 0 then 'cpi' else 'employment_situation' end as f, cast(floor(t / 1000000) as bigint) * 1000000 as s,
  cast(floor((t + case when k % 13 = 0 then -60000000 else 5000000 end) / 1000000) as bigint) * 1000000 as r, cast(floor((t - case when k % 11 = 0 then -9000000 else 86400000000 end) / 1000000) as bigint) * 1000000 as c from n)
select event_key as event_id, f as event_family, r as released_us, concat_ws(',', case when f = 'gdp' then 'family' end, case when c >= r then 'vintage' end, case when r < s then 'release' end, case when k % 19 = 0 then 'source' end) as errors from e""",
    "agg37_macro_coverage": f"""with n as (select event_key, min(epoch_us(occurred_at)) as t, {_K} as k from news_events where occurred_at is not null group by event_key)
select count(*) filter (where k % 7 <> 0) as events, count(distinct floor(t / 86400000000)) filter (where k % 7 <> 0) as release_dates, count(*) filter (where k % 7 <> 0 and k % 2 = 0) as cpi, count(*) filter (where k % 7 <> 0 and k % 2 = 1) as employment_situation, bool_and(k % 7 <> 0) as valid,
  bool_and(k % 7 <> 0) and count(*) filter (where k % 7 <> 0) >= 20 and least(count(*) filter (where k % 7 <> 0 and k % 2 = 0), count(*) filter (where k % 7 <> 0 and k % 2 = 1)) >= 8 as enough from n""",
    "src35_calendar_file": f"with {_SPANS} select a as open_us, z as close_us from cal",
    "join21_calendar": f"""with {B5}, {_SPANS}, p as (select distinct instrument, bar_us as x, bar_us + 300000000 as y from b),
j as (select p.*, case when x < epoch_us(timestamp '2025-10-14 04:00:00') or y > epoch_us(timestamp '2025-11-12 05:00:00') then 'out_of_range' when x < 1761667200000000 and y > 1761652800000000 then 'closed' when exists (select 1 from cal where a <= x and y <= z) then 'open' else 'closed' end as market from p)
select instrument, market, count(*) as n, min(x) as first_us from j group by instrument, market""",
    "src38_ledger": "select envelope_id, kind, source, schema_version from event_envelopes",
    "src28_snapshots": "select 2 as files, 1 as contents, cast(2 * sum(length(n_nationkey || ',' || n_name) + 1) as bigint) as bytes from nation",
    "snk01_published": f"with {B5} select * from b",
    "snk02_outcomes": f"""with {B5}, """ + ", ".join(f"h{k} as (select {k} as horizon_s, coalesce(lead(bar_us, {k + 1}) over w - bar_us = {(k + 1) * 300000000}, false) as valid, (lead(open_bid, {k + 1}) over w / lead(open_ask, 1) over w - 1) * 10000 as net from b window w as (partition by source, instrument order by bar_us))" for k in (1, 2, 4)) + f" select horizon_s, count(*) as n, count(*) filter (where valid) as valid, {qz('avg(case when valid then net end)', 3)} as mean from (select * from h1 union all select * from h2 union all select * from h4) group by horizon_s",
    "snk07_curated": "with r as (select *, row_number() over (partition by source, source_sequence order by received_at desc, id desc) as k from market_ticks where occurred_at is not null and source_sequence is not null and source is not null and received_at is not null) select source, cast(floor(epoch_us(occurred_at) / 86400000000) as bigint) as day, count(*) as n, cast(sum(id) as bigint) as ids from r where k = 1 group by all",
    "snk09_inserted": "select distinct lower(trim(idempotency_key)) as key from event_envelopes where trim(idempotency_key) <> ''",
    "snk12_registry": f"with n as (select instrument as report_id, row_number() over (order by instrument) as sequence from (select distinct instrument from feed_sessions where instrument is not null)) select sequence, report_id, sequence as hypotheses, {qz('0.05 / sequence', 9)} as alpha_each, cast(sum(sequence) over () as bigint) as total from n",
    "snk13_prunable": "with s as (select source as name, concat_ws('/', instrument, cast(batch_no as varchar)) as path, cast(length(instrument) as bigint) as rows, cast(batch_no as bigint) as size from feed_sessions) select *, row_number() over (partition by name order by rows desc, size desc, path desc) = 1 as keep from s",
    "str03_live_bars": f"with {Q} select source, instrument, cast(floor(us / 300000000) as bigint) * 300000000 as bar_us, first(mid order by us, id) as open, max(mid) as high, min(mid) as low, last(mid order by us, id) as close, count(*) as tick_count from q group by all",
    "str05_late_changes": "with r as (select coalesce(source, '') as table_key, epoch_us(received_at) - (cast(floor(epoch_us(occurred_at) / 300000000) as bigint) + 1) * 300000000 as late from event_envelopes where occurred_at is not null and received_at is not null) select table_key, nullif(count(*) filter (where late < 1200000000), 0) as n, count(*) filter (where late >= 1200000000) as refused from r group by table_key",
    "str09_live_cooldown": """with recursive y as (select source, epoch_us(occurred_at) as us from event_envelopes where occurred_at is not null and source is not null), nx as materialized (select a.source, a.us, (select min(b.us) from y b where b.source = a.source and b.us >= a.us + 600000000) as nxt from (select distinct source, us from y) a),
f(source, us, nxt) as (select source, min(us), min_by(nxt, us) from nx group by source union all select nx.source, nx.us, nx.nxt from f join nx on nx.source = f.source and nx.us = f.nxt) select source, us from f""",
    "str12_appended": "select distinct lower(trim(idempotency_key)) as key from event_envelopes where trim(idempotency_key) <> ''",
}
NAMES = (
    src01_tick_files, src02_date_time_files, src03_history, src04_order_report, src09_sides, src11_batches, src12_ingest, src16_trades, src14_archive, src19_copy_trades, join27_prefixes, str06_standing, str13_health, src20_account_history, src22_recorder_files, src22_last_seen, src23_curated_quotes, src26_quote_counters, src27_new_lines, src28_snapshots, src30_news_payloads, src31_series, src32_macro_calendar, src35_calendar_file, src38_ledger,
    snk01_published, snk02_outcomes, snk07_curated, snk09_inserted, snk12_registry, snk13_prunable, agg37_macro_coverage, join21_calendar, str03_live_bars, str05_late_changes, str09_live_cooldown, str12_appended,
)
QUERIES = {f.__name__: f for f in NAMES}
