"""The data-quality operators on small inputs with known answers and against brute force."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import grid, late, rowparse, spikes, timestamps, upsert

UTC = timezone.utc


def micros(*parts: int) -> int:
    return int(datetime(*parts, tzinfo=UTC).timestamp()) * 1_000_000


# --- time texts


def parsed(spark, rows):
    table = timestamps.zone_table([r[1] for r in rows if r[1]] + ["UTC"])
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, text string, zone string, shift_hours int, month_first boolean")
    got = {r["i"]: (r["lo"], r["hi"]) for r in timestamps.parse_texts(df, table).collect()}
    return [got.get(i) or (None, None) for i in range(len(rows))]


@pytest.mark.parametrize(
    "text, want",
    [
        ("2025.10.18 06:35:58", micros(2025, 10, 18, 6, 35, 58)), ("18/10/2025 06:37:36", micros(2025, 10, 18, 6, 37, 36)), ("2025-10-13T00:19:47.147", micros(2025, 10, 13, 0, 19, 47) + 147_000),
        ("2025-10-13T04:13:25.870371Z", micros(2025, 10, 13, 4, 13, 25) + 870_371), ("10 Nov 2025 02:08:56,142", micros(2025, 11, 10, 2, 8, 56) + 142_000), ("2025-10-13 02:37:06 EDT", micros(2025, 10, 13, 6, 37, 6)),
        ("20251012 233434444", micros(2025, 10, 12, 23, 34, 34) + 444_000), ("Fri, 07 Nov 2025 01:27:26 +0200", micros(2025, 11, 6, 23, 27, 26)), ("2025-11-12 08:33:27.226659+09:00", micros(2025, 11, 11, 23, 33, 27) + 226_659),
        ("1760325208", 1760325208_000000), ("1760338251621", 1760338251621_000), ("1760340006181455", 1760340006181455), ("1760358702.741", 1760358702_741000), ('"2025.10.13 18:27"', micros(2025, 10, 13, 18, 27)), ("\t2025.10.13 18:27:01  ", micros(2025, 10, 13, 18, 27, 1)),
    ],
)
def test_shapes(spark, text, want):
    assert parsed(spark, [(text, "UTC", 0, False)]) == [(want, want)]


def test_texts_that_are_no_instant(spark):
    bad = ["", "  ", "n/a", "null", "-", "0", "0000.00.00 00:00:00", "1970.01.01 00:00:00", "2025.02.30 01:17:26", "2025.13.16 22:36:03", "2025.10.30 25:28:71", "2025-10-13 10:00:00 XYZ", "10/13/2025 13:00:00 AM", "x" * 100_000, None]
    assert parsed(spark, [(t, "UTC", 0, False) for t in bad]) == [(None, None)] * len(bad)


def test_month_first_and_half_days(spark):
    got = parsed(spark, [("10/12/2025 11:18:23 PM", "UTC", 0, True), ("10/12/2025 12:18:23 AM", "UTC", 0, True), ("10/12/2025 11:18:23", "UTC", 0, False)])
    assert [g[0] for g in got] == [micros(2025, 10, 12, 23, 18, 23), micros(2025, 10, 12, 0, 18, 23), micros(2025, 12, 10, 11, 18, 23)]


def test_wall_clocks(spark):
    rows = [("2025.10.26 02:30:00", "Europe/Berlin", 0, False), ("2025.03.30 02:30:00", "Europe/Berlin", 0, False), ("2025.11.02 08:30:00", "America/New_York", 7, False), ("2025.07.01 12:00:00", "Europe/Berlin", 0, False), ("2025.07.01 12:00:00", "No/Where", 0, False), ("2025.07.01 12:00:00", None, 0, False)]
    got = parsed(spark, rows)
    assert got[0] == (micros(2025, 10, 26, 0, 30), micros(2025, 10, 26, 1, 30))
    assert got[1] == (None, None)  # the clock jumps over it
    assert got[2] == (micros(2025, 11, 2, 5, 30), micros(2025, 11, 2, 6, 30))
    assert got[3] == (micros(2025, 7, 1, 10),) * 2
    assert got[4] == got[5] == (None, None)


def test_zone_table_equals_zoneinfo():
    rng = random.Random(5)
    for zone in ("Europe/Helsinki", "America/Chicago", "Asia/Kolkata", "Africa/Casablanca"):
        table = timestamps.zone_table([zone])
        for _ in range(300):
            at = datetime(1990, 1, 1, tzinfo=UTC) + timedelta(seconds=rng.randrange(40 * 365 * 86_400))
            want = int(at.astimezone(ZoneInfo(zone)).utcoffset().total_seconds()) * 1_000_000
            assert table.offset_at(zone, np.array([int(at.timestamp()) * 1_000_000]))[0] == want


# --- spikes


def session(n=200, seed=1):
    rng = random.Random(seed)
    bid = [100 + 0.0]
    for _ in range(n - 1):
        bid.append(round(bid[-1] + rng.choice([-0.02, -0.01, 0.01, 0.02]), 2))
    return bid


def flagged(spark, bids, asks=None, numbers=None, **kw):
    asks = asks or [round(b + 0.05, 2) for b in bids]
    numbers = numbers or list(range(1, len(bids) + 1))
    rows = [(i, "s", "X", i * 1_000_000, b, a, 1, n) for i, (b, a, n) in enumerate(zip(bids, asks, numbers))]
    df = spark.createDataFrame(rows, "id long, source string, instrument string, t long, bid double, ask double, b long, n long")
    return {r["id"]: r for r in spikes.flag_quotes(df, **kw).collect()}


def test_spike_that_comes_back_and_move_that_stays(spark):
    bids = session()
    bids[50] += 1.5
    for i in range(80, 88):
        bids[i] -= 2.0
    for i in range(140, 200):
        bids[i] += 3.0
    bids = [round(b, 2) for b in bids]
    assert {i for i, r in flagged(spark, bids).items() if r["spike"]} == {50, *range(80, 88)}


def test_stuck_placeholder_and_crossed(spark):
    bids = session()
    for i in range(30, 55):
        bids[i] = bids[30]
    for i in range(100, 110):
        bids[i] = bids[100]
    asks = [round(b + 0.05, 2) for b in bids]
    bids[70], asks[75], bids[76], asks[90] = 0.0, 999999.0, -1.0, round(bids[90] - 0.01, 2)
    got = flagged(spark, bids, asks)
    assert {i for i, r in got.items() if r["stuck"]} == set(range(30, 55))
    assert {70, 75, 76} <= {i for i, r in got.items() if r["placeholder"]} and got[90]["crossed"]


def test_repeats_of_a_message_share_its_verdict_and_do_not_make_a_stretch(spark):
    bids = session()
    numbers = list(range(1, 201))
    for i in range(60, 85):  # one message, delivered again and again
        bids[i], numbers[i] = bids[60], numbers[60]
    bids[120] += 2.0
    bids[121], numbers[121] = bids[120], numbers[120]
    got = flagged(spark, [round(b, 2) for b in bids], numbers=numbers)
    assert set(got) == {120, 121}


def test_shards_do_not_change_the_verdicts(spark):
    bids = session(3000, 4)
    for i in (500, 1200, 1201, 2400):
        bids[i] = round(bids[i] + 2, 2)
    for i in range(995, 1025):
        bids[i] = bids[995]
    whole = flagged(spark, bids)
    cut = flagged(spark, bids, shard_rows=400, halo_rows=150, bucket_us=20_000_000)
    assert set(whole) == set(cut) and {500, 1200, 1201, 2400, *range(995, 1025)} == set(whole)


def test_a_move_that_stays_may_wander(spark):
    bids = session()
    for i in range(100, 200):
        bids[i] = round(bids[i] - 0.36 + (0.06 if i % 3 else 0.0), 2)  # between 15 and 24 usual moves below
    bids[40] = round(bids[40] + 0.5, 2)
    assert {i for i, r in flagged(spark, bids).items() if r["spike"]} == {40}


def test_copies_of_a_row_are_judged_together(spark):
    bids = session()
    bids[50] = round(bids[50] + 2, 2)
    rows = [(i, "s", "X", i * 1_000_000, b, round(b + 0.05, 2), 1, i + 1) for i, b in enumerate(bids)]
    rows += [(1000 + k, *rows[50][1:]) for k in range(3000)] + [(9000 + k, *rows[60][1:]) for k in range(3000)] + [(20_000, *rows[50][1:6], None, None)]
    df = spark.createDataFrame(rows, "id long, source string, instrument string, t long, bid double, ask double, b long, n long")
    want = {50, 20_000, *range(1000, 4000)}
    for kw in ({}, {"shard_rows": 60, "halo_rows": 40, "bucket_us": 5_000_000}):
        assert {r["id"] for r in spikes.flag_quotes(df, **kw).collect()} == want


def test_moves_that_grow_and_buckets_larger_than_a_shard(spark):
    rng = np.random.default_rng(3)
    n = 12_000
    steps = rng.normal(0, 0.01, n)
    steps[n // 2 :] *= 20
    bids = np.round(100 + np.cumsum(steps), 4)
    bids[2500] += 0.4
    bids[9500] += 8.0
    bids[4000:4030] = bids[4000]
    want = {2500, 9500, *range(4000, 4030)}
    # the last two put all rows in one bucket, ten and forty times a shard
    for kw in ({}, {"shard_rows": 3000}, {"shard_rows": 1200, "bucket_us": 10**13}, {"shard_rows": 300, "bucket_us": 10**13}):
        assert set(flagged(spark, bids.tolist(), (bids + 0.05).tolist(), **kw)) == want, kw


def test_a_hot_bucket_is_cut_by_rank(spark):
    rows = [("s", "X", 5, i % 7, float(i), i) for i in range(500)]
    df = spark.createDataFrame(rows, "source string, instrument string, bucket long, t long, n double, id long")
    ranked = spikes._ranked(df, ["source", "instrument", "bucket"], ["t", "n", "id"], 9).collect()
    assert [r["id"] for r in sorted(ranked, key=lambda r: r["rank"])] == [r[5] for r in sorted(rows, key=lambda r: (r[3], r[4], r[5]))]
    assert sorted(r["rank"] for r in ranked) == list(range(500))


def test_vanished_against_run_lengths():
    rng = np.random.default_rng(8)
    for _ in range(60):
        x = np.repeat(rng.integers(0, 3, 40), rng.integers(1, 30, 40)).astype(float)
        edges = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
        lengths = np.diff(np.append(edges, len(x)))
        assert (spikes.vanished(x) == np.repeat(lengths >= 20, lengths)).all()


def test_spikes_without_rows_and_with_nulls(spark):
    schema = "id long, source string, instrument string, t long, bid double, ask double, b long, n long, core string"
    assert spikes.flag_quotes(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, None, "X", 1, 1.0, 2.0, 1, 1, "x"), (2, "s", "X", None, 1.0, 2.0, 1, 1, "x"), (3, "s", "X", 5, None, 2.0, None, None, "x"), (4, "s", "X", 5, float("nan"), 2.0, None, None, "x"), (5, "s", "X", 6, 3.0, 2.0, None, None, "x")]
    assert {r["id"] for r in spikes.flag_quotes(spark.createDataFrame(rows, schema)).collect()} == {4, 5}


def test_readings(spark):
    rows = [(i, "a", v) for i, v in enumerate([10.0, 11.0, 12.0, 10.0, 51.0, 53.0, 1.9, 2.3, 0.0, -4.0, None])]
    df = spark.createDataFrame([*rows, (20, None, 5.0), (21, None, -5.0)], "id long, k string, v double")
    assert {r["id"] for r in spikes.flag_readings(df, ["k"], "v", "id").collect()} == {5, 6, 8, 9, 21}  # the usual value is 10.5


def test_readings_against_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for i in range(3000):
        drift = 3.0 if 800 < i < 1600 else 1.0  # a level that stays off for long is not unusual enough
        rows.append((i, rng.choice(["a", "b", None]), round(drift * rng.uniform(8, 14) * rng.choice([1] * 30 + [9, 0.1, 5.5, 0.19, 0, -1]), 3)))
    df = spark.createDataFrame(rows, "id long, k string, v double")
    middle = {k: float(np.median([v for _, g, v in rows if g == k and v > 0])) for k in ("a", "b", None)}
    want = {i for i, k, v in rows if v <= 0 or v > 5 * middle[k] or v < middle[k] / 5}
    for shard in (100_000, 250):
        assert {r["id"] for r in spikes.flag_readings(df, ["k"], "v", "id", shard_rows=shard).collect()} == want
    assert spikes.flag_readings(df.where("false"), ["k"], "v", "id").count() == 0


# --- late events


def test_changelog_retracts_and_adds(spark):
    p = 300
    rows = [("a", 10, 20, 1.0), ("a", 11, 299, 2.0), ("a", 12, 310, 4.0), ("a", 13, 450, 8.0), ("a", 14, 1500, 16.0), ("a", None, 5, 1.0), (None, 10, 400, 3.0)]
    df = spark.createDataFrame(rows, "k string, event_us long, arrived_us long, value double")
    got = late.late_changelog(df, ["k"], p, 1200, 60).collect()
    a = sorted((r["version"], r["op"], r["n"], r["total"]) for r in got if r["k"] == "a")
    assert a == [(-1, 0, 1, 16.0), (0, 1, 2, 3.0), (1, -1, 2, 3.0), (1, 1, 3, 7.0), (3, -1, 3, 7.0), (3, 1, 4, 15.0)]
    assert [(r["version"], r["op"], r["n"]) for r in got if r["k"] is None] == [(2, 1, 1)]
    total = {r["k"]: r["n"] for r in late.downstream(late.late_changelog(df, ["k"], p, 1200, 60), ["k"], 3600).collect()}
    assert total == {"a": 4, None: 1}


# --- repeated messages


def test_components_against_union_find(spark):
    rng = random.Random(9)
    edges = [(f"v{rng.randrange(120)}", f"v{rng.randrange(120)}") for _ in range(90)] + [(f"c{i}", f"c{i + 1}") for i in range(60)] + [("hub", f"h{i}") for i in range(200)] + [(None, "x"), ("x", "x")]
    parent: dict[str, str] = {}

    def find(v):
        parent.setdefault(v, v)
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        if a and b and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    want = {v: find(v) for v in parent if find(v) != v}
    got = {r["v"]: r["root"] for r in upsert.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == want


def test_linked_messages(spark):
    u = "5a846498-8b27-8488-04ec-8d94a0abd28e"
    rows = [(1, u, "k1", 5), (2, u.upper(), "K1 ", 4), (3, "urn:uuid:" + u, "k2", 9), (4, "{" + u[:-1] + "f}", " k2", 1), (5, None, "k2", 2), (6, None, None, 1), (7, None, None, 1), (8, "other", "", 1), (9, None, "lone", 3), (10, None, "LONE", 3), (11, "other", "\t", None)]
    df = spark.createDataFrame(rows, "id long, e string, k string, received long").select("id", upsert.canonical_uuid("e").alias("e"), upsert.canonical_key("k").alias("k"), "received")
    linked = upsert.linked_messages(df, "e", "k").select("id", "message", "received")
    groups: dict[str, set] = {}
    for r in linked.collect():
        groups.setdefault(r["message"], set()).add(r["id"])
    assert groups.pop(None) == {6, 7} and sorted(map(sorted, groups.values())) == [[1, 2, 3, 4, 5], [8, 11], [9, 10]]
    dropped = upsert.superseded(linked, ["message"], "received", "id")
    assert {r["id"] for r in dropped.collect()} == {1, 2, 3, 5, 11, 10}


def test_sequence_pair(spark):
    texts = ["1:1", "000001:0000013", " 9 : 72 ", "0:0", "a:1", "", None, "1:2:3", "1:99999999999999999999"]
    got = [r["p"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string").orderBy("i").select(upsert.sequence_pair("s").alias("p")).collect()]
    assert [tuple(p) if p else None for p in got] == [(1, 1), (1, 13), (9, 72), (0, 0), None, None, None, None, None]


def test_bucket_store_is_idempotent(spark, tmp_path):
    store = upsert.BucketStore(spark, str(tmp_path / "store"), ["key"], "received", "id", buckets=4)
    schema = "id long, key string, received long"
    one, two = spark.createDataFrame([(1, "a", 5), (2, "b", 6), (3, None, 1)], schema), spark.createDataFrame([(4, "a", 3), (5, "c", 9), (6, "c", 9)], schema)
    store.upsert(one, 1)
    store.upsert(two, 2)
    store.upsert(one, 1)
    want = {2, 3, 4, 5}
    assert {r["id"] for r in store.read().collect()} == want
    assert {r["id"] for r in store.compact(str(tmp_path / "next")).read().collect()} == want


def test_a_hot_identifier_is_one_row_per_file(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, "hot" if rng.random() < 0.5 else f"k{rng.randrange(40)}", rng.choice([None, rng.randrange(50)])) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, key string, received long").repartition(6)
    store = upsert.BucketStore(spark, str(tmp_path / "store"), ["key"], "received", "id", buckets=4)
    store.upsert(df.where("id < 2000"), "a")
    store.upsert(df.where("id >= 2000"), "b")
    store.upsert(df.where("id >= 2000"), "b")
    assert store._runs().where("key = 'hot' and not _lost").count() <= 12
    first = {}
    for i, k, r in rows:
        first[k] = min(first.get(k, (True, 0, 0)), (r is None, r or 0, i)) if k in first else (r is None, r or 0, i)
    stay = {v[2] for v in first.values()}
    assert {r["id"] for r in store.read().collect()} == stay
    assert sorted(r["id"] for r in store.dropped().collect()) == sorted({i for i, _, _ in rows} - stay)
    small = store.compact(str(tmp_path / "small"))
    assert {r["id"] for r in small.read().collect()} == stay and small.dropped().count() == 0


# --- rows that fail to parse


def field_list(line):
    """The fields by a character loop, or None for broken quoting."""
    fields, i, n = [], 0, len(line)
    while True:
        if i < n and line[i] == '"':
            i, value = i + 1, ""
            while True:
                if i >= n:
                    return None
                if line[i] == '"':
                    if i + 1 < n and line[i + 1] == '"':
                        value, i = value + '"', i + 2
                        continue
                    i += 1
                    break
                value, i = value + line[i], i + 1
            if i < n and line[i] != ",":
                return None
        else:
            j = i
            while j < n and line[j] != ",":
                if line[j] == '"':
                    return None
                j += 1
            value, i = line[i:j], j
        fields.append(value)
        if i >= n:
            return fields
        i += 1


def test_quoting_and_fields_against_a_character_loop(spark):
    rng = random.Random(11)
    lines = ["".join(rng.choice('a,"" \x01b,') for _ in range(rng.randrange(0, 14))) for _ in range(1500)] + ['"a""b",c', '""', '"",', '"a"b', '"' * 4, "x" * 200_000, '"' + "y," * 100_000 + '"']
    df = spark.createDataFrame(list(enumerate(lines)), "i int, line string")
    got = {r["i"]: r for r in df.select("i", rowparse.quoting_broken(F.col("line")).alias("bad"), F.when(~rowparse.quoting_broken(F.col("line")), rowparse.fields_of(F.col("line"))).alias("f")).collect()}
    for i, line in enumerate(lines):
        want = field_list(line)
        assert got[i]["bad"] == (want is None), line
        assert got[i]["f"] == want, line


def test_reasons(spark):
    good = "tick,a,b,1,s,2,br,sv,X,{},{},3"
    header = ",".join(rowparse.RECORDER_COLUMNS)
    lines = {1: header, 2: rowparse.BOM + header, 3: "", 4: "\r", 5: None, 6: good.format("1.5", "1.6"), 7: good.format(" +1e2 ", "2.E1") + "\r", 8: good.format("0", "1"), 9: good.format("1", "-1"), 10: good.format("nan", "inf"), 11: good.format("1", "inf"), 12: good.replace("tick", "Tick").format("x", "y"), 13: "a,b", 14: good.format('"1', "2"), 15: '"tick"' + good[4:].format('"1"', "2"), 16: header + "\r", 17: good.format("1_0", "1"), 18: good.format("1\n", "1")}
    df = spark.createDataFrame([(i, "f", i, t, "x") for i, t in lines.items()], "line_id long, file_name string, line_no int, line string, text string")
    out = rowparse.parse_lines(df)
    assert {r["line_id"]: r["reason"] for r in rowparse.rejected(out).collect()} == {8: "bid", 9: "ask", 10: "bid", 11: "ask", 12: "record_type", 13: "column_count", 14: "quoting", 17: "bid", 18: "bid"}
    assert {r["line_id"]: (r["bid"], r["ask"]) for r in rowparse.records(out).collect()} == {6: (1.5, 1.6), 7: (100.0, 20.0), 15: (1.0, 2.0)}


# --- regular grid


def grid_rows(spark, ticks, sessions, **kw):
    t = spark.createDataFrame(ticks, "source string, instrument string, us long, id long, bid double, ask double")
    s = spark.createDataFrame(sessions, "source string, batch_no long, instrument string, opened_us long, closed_us long")
    return sorted((r["slot_start_us"], r["status"], r["bid"]) for r in grid.regular_grid(t, s, slot_us=60, **kw).collect())


def test_grid_marks_fills_and_leaves_long_gaps(spark):
    at = [65, 130, 185, 420, 490, 1800]
    ticks = [("s", "X", t, i, float(i), i + 1.0) for i, t in enumerate(at)] + [("s", "X", 300, 99, None, 1.0), ("s", "Y", 310, 98, 5.0, 5.0), (None, "X", 10, 97, 1.0, 1.0)]
    got = grid_rows(spark, ticks, [("s", 1, "X", 30, 1900), ("s", 1, "X", 30, 1900), ("s", 2, "X", 5000, 5050)], max_gap_slots=5)
    status = {t: s for t, s, _ in got}
    assert min(status) == 60 and max(status) == 1800 and len(got) == 30
    assert {t for t, s in status.items() if s == "observed"} == {60, 120, 180, 420, 480, 1800}
    assert {t for t, s in status.items() if s == "filled"} == {240, 300, 360}
    values = [b for t, s, b in got if 180 <= t <= 420]
    assert values == sorted(values) and 2.0 <= values[0] and values[-1] <= 3.0  # shape preserving
    assert all(b is None for _, s, b in got if s == "gap")


def test_grid_shards_do_not_change_it(spark):
    rng = random.Random(2)
    ticks = [("s", "X", t, i, 100 + rng.random(), 101.0) for i, t in enumerate(sorted(rng.sample(range(0, 20_000), 220)))]
    one = grid_rows(spark, ticks, [("s", 1, "X", 100, 19_500)], max_gap_slots=4)
    many = grid_rows(spark, ticks, [("s", 1, "X", 100, 19_500)], max_gap_slots=4, shard_slots=13)
    assert one == many and any(s == "filled" for _, s, _ in one)


def test_grid_of_nothing(spark):
    assert grid_rows(spark, [], []) == []
