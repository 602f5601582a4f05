"""Bars, windows, joins, folds and outcomes: known values, causality, and invariance under shards."""

from __future__ import annotations

import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tickloom.operators import asof, bars, classify, folds, metrics, outcomes, shards, windows

S = 1_000_000
BASE = int(datetime(2026, 7, 1, tzinfo=timezone.utc).timestamp()) * S


def quote_frame(spark, points, spread=0.5):
    rows = [(i, "s", "X", BASE + int(t * S), float(b), b + spread) for i, (t, b) in enumerate(points)]
    df = spark.createDataFrame(rows, "id long, source string, instrument string, us long, bid double, ask double")
    return df.withColumn("mid", (F.col("bid") + F.col("ask")) / 2).withColumn("spread_bps", (F.col("ask") - F.col("bid")) / F.col("mid") * 10_000)


def collected(df, *order):
    return df.orderBy(*order).collect()


def test_second_bars_and_features(spark):
    b = bars.second_bars(quote_frame(spark, [(0, 100), (0.5, 101), (1, 102), (5, 200)]))
    rows = collected(b, "bar_us")
    assert len(rows) == 3 and rows[0]["tick_count"] == 2 and rows[0]["mid"] == 101.25 and (rows[0]["open_bid"], rows[0]["open_ask"]) == (100.0, 100.5) and rows[0]["quote_change_count"] == 1
    f = collected(windows.second_features(b), "bar_us")
    assert f[1]["return_1s"] == pytest.approx(102.25 / 101.25 - 1) and f[1]["return_5s"] is None and not f[2]["is_gap_start"]
    assert f[0]["age_s"] is None and f[2]["age_s"] == 4.0


def test_future_rows_change_no_feature(spark):
    rng = random.Random(1)
    points = [(i * 0.7, round(100 + rng.gauss(0, 0.1), 3)) for i in range(400)]
    early = lambda pts: {r["bar_us"]: r for r in windows.second_features(bars.second_bars(quote_frame(spark, pts))).collect()}
    before, after = early(points), early([*points, (300, 9e5)])
    assert all(after[t] == row for t, row in before.items())
    levels = lambda pts: {r["bar_us"]: r for r in windows.prior_levels(bars.second_bars(quote_frame(spark, pts)).select("source", "instrument", "bar_us", "mid"), "bar_us", "mid").collect()}
    before, after = levels(points), levels([*points, (300, 9e5)])
    assert all(after[t] == row for t, row in before.items())


def test_shards_do_not_change_windows(spark, monkeypatch):
    rng = random.Random(2)
    points = [(i * 1.3 + (200 if i > 150 else 0), round(100 + rng.gauss(0, 0.3), 3)) for i in range(300)]
    b = bars.second_bars(quote_frame(spark, points))

    def run():
        state = windows.prior_levels(b.select("source", "instrument", "bar_us", "mid"), "bar_us", "mid", (60,)).withColumn("side", windows.breakout("mid", "prior_high_60s", "prior_low_60s", 1.0))
        starts = windows.episode_starts(state.select("source", "instrument", "bar_us", "side"), "bar_us", "side", 30 * S)
        parts = [windows.second_features(b), windows.segments(b.select("source", "instrument", "bar_us"), "bar_us", 5 * S), starts, folds.cooldown(starts, ["source", "instrument"], "bar_us", ["bar_us"], 20 * S), outcomes.outcomes(b, 10), windows.gaps(b, "bar_us", "mid", 5 * S)]
        rounded = lambda row: [round(v, 9) if isinstance(v, float) else v for v in row]  # noqa: E731 - sums over other frames differ in the last bits
        return [sorted(map(str, map(rounded, p.collect()))) for p in parts]

    whole = run()
    for f in (shards.shard_of, shards.with_halo):
        assert f.__defaults__[-1] == shards.SHARD_US
    small = 37 * S
    monkeypatch.setattr(shards.shard_of, "__defaults__", (small,))
    monkeypatch.setattr(shards.with_halo, "__defaults__", (0, 0, small))
    assert run() == whole


def test_structural_levels_and_breakout(spark):
    rows = spark.createDataFrame([("s", "X", BASE + i * S, 100.0 + i) for i in range(3)], "source string, instrument string, t long, mid double")
    got = collected(windows.prior_levels(rows, "t", "mid", (2,)).withColumn("side", windows.breakout("mid", "prior_high_2s", "prior_low_2s", 1.0)), "t")
    assert [r["prior_high_2s"] for r in got] == [None, 100.0, 101.0] and got[2]["side"] == 1


def test_outcomes_known_values(spark):
    b = bars.second_bars(quote_frame(spark, [(i, 100 + i) for i in range(5)]))
    c = outcomes.OutcomeConfig(max_exit_delay_us=0)
    shifted = b.withColumn("open_us", F.col("bar_us") + 100_000)
    got = collected(outcomes.outcomes(shifted, 2, c), "bar_us")
    assert [r["valid"] for r in got] == [True, True, False, False, False]
    assert got[0]["long_net_bps"] == pytest.approx((103 / 101.5 - 1) * 1e4) and got[0]["short_net_bps"] == pytest.approx((101 / 103.5 - 1) * 1e4)
    assert got[0]["entry_delay_s"] == pytest.approx(0.05) and got[0]["long_gross_bps"] == pytest.approx((103.25 / 101.25 - 1) * 1e4)
    gap = bars.second_bars(quote_frame(spark, [(0, 100), (1, 100), (10, 100), (11, 100)]))
    assert not any(r["valid"] for r in outcomes.outcomes(gap, 5).collect())


def test_ema_and_completed_bars(spark):
    rows = [("s", "X", i * 300 * S, c, c, c, c, 1) for i, c in enumerate([1.0, 2.0, 3.0])]
    b = spark.createDataFrame(rows, "source string, instrument string, bar_us long, open double, high double, low double, close double, tick_count long")
    assert [r["ema"] for r in collected(windows.ema(b, 2), "bar_us")] == [None, pytest.approx(5 / 3), pytest.approx(8 / 3)]
    seeded = collected(windows.ema(b, 3), "bar_us")[2]["ema"]
    assert seeded == pytest.approx(1 + 0.5 * (2 - 1) + 0.5 * (3 - 1.5))
    long = spark.createDataFrame([("s", "X", i * 300 * S, 100.0, 100.0, 100.0, 100.0 if i < 12 else 999.0, 1) for i in range(13)], b.schema)
    got = collected(bars.last_completed(long, 3600 * S, "h1"), "bar_us")
    assert got[11]["h1"] is None and got[12]["h1"] == 100.0


def test_asof_against_brute_force(spark):
    rng = random.Random(4)
    left = [(i, rng.choice(["a", "b", None]), rng.choice([None, *range(0, 100_000_000_000, 997_000_003)])) for i in range(250)]
    right = [(rng.choice(["a", "b", None]), rng.randrange(0, 100) * 997_000_003, i) for i in range(120)]
    ls, rs = spark.createDataFrame(left, "i int, k string, t long"), spark.createDataFrame(right, "k string, u long, v int")
    for direction, strict, tol in (("backward", False, None), ("forward", False, None), ("backward", True, 5_000_000_000), ("forward", True, None)):
        want = {}
        for i, k, t in left:
            ok = [(u, v) for kk, u, v in right if k and kk == k and t is not None and ((u < t if strict else u <= t) if direction == "backward" else (u > t if strict else u >= t))]
            best = (max(ok) if direction == "backward" else min(ok)) if ok else None
            want[i] = best[1] if best and (tol is None or abs(best[0] - t) <= tol) else None
        got = {r["i"]: r["r_v"] for r in asof.asof(ls, rs, ["k"], "t", "u", ["v"], direction, strict, tol).collect()}
        assert got == want, (direction, strict)


def test_between_and_overlaps_against_brute_force(spark):
    rng = random.Random(6)
    points = [(i, rng.choice("ab"), rng.randrange(1000)) for i in range(200)]
    spans = [(j, rng.choice("ab"), a := rng.randrange(1000), a + rng.randrange(-5, 120)) for j in range(60)]
    p = spark.createDataFrame(points, "i int, k string, t long")
    q = spark.createDataFrame(spans, "j int, k string, a long, z long")
    got = {(r["i"], r["j"]) for r in asof.between(p, q, ["k"], "t", "a", "z", width_us=50).collect()}
    assert got == {(i, j) for i, k, t in points for j, kk, a, z in spans if k == kk and a <= t <= z}
    other = q.selectExpr("j as m", "k", "a as b0", "z as b1")
    got = sorted((r["j"], r["m"]) for r in asof.overlaps(q, other, ["k"], ("a", "z"), ("b0", "b1"), width_us=50).collect())
    assert got == sorted((i, j) for i, k, a, z in spans for j, kk, b, y in spans if k == kk and a < z and b < y and a < y and b < z)


def test_folds_against_loops(spark):
    rng = random.Random(8)
    rows = [(rng.choice("ab"), rng.randrange(5000) * S, i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, t long, i int")
    want, last = set(), {}
    for k, t, i in sorted(rows, key=lambda r: (r[1], r[2])):
        if k not in last or t >= last[k] + 60 * S:
            want.add(i)
            last[k] = t
    assert {r["i"] for r in folds.cooldown(df, ["k"], "t", ["t", "i"], 60 * S).collect()} == want
    spans = df.withColumn("z", F.col("t") + (F.col("i") % 90) * S)
    want, last = set(), {}
    for k, t, i in sorted(rows, key=lambda r: (r[1], r[2])):
        if k not in last or t >= last[k]:
            want.add(i)
            last[k] = t + i % 90 * S
    assert {r["i"] for r in folds.without_overlap(spans, ["k"], "t", "z", ["t", "i"]).collect()} == want
    assert folds.cooldown(df.where("false"), ["k"], "t", ["t", "i"], S).count() == 0


def test_one_to_one_matching(spark):
    schema = "symbol string, t long, ticket string"
    p = spark.createDataFrame([("X", 0, "p1"), ("X", 10 * S, "p2"), ("Y", 0, "p3"), (None, 0, "p4")], schema)
    c = spark.createDataFrame([("X", S, "c1"), ("X", 11 * S, "c2"), ("X", 2 * S, "c3"), ("Z", 0, "c4")], schema)
    got = {(r["left_ticket"], r["right_ticket"]): r["lag_us"] for r in folds.match_one_to_one(p, c, ["symbol"], "t", "ticket", 5 * S).collect()}
    assert got == {("p1", "c1"): S, ("p2", "c2"): S}


def test_matching_against_the_greedy_loop(spark):
    rng = random.Random(12)
    make = lambda n, s: [(rng.choice("XY"), rng.randrange(0, 400), f"{s}{i:03d}") for i in range(n)]
    left, right = make(80, "p"), make(90, "c")
    pool = sorted((abs(t - u), t, a, b) for k, t, a in left for kk, u, b in right if k == kk and abs(t - u) <= 6)
    used, want = set(), set()
    for _, _, a, b in pool:
        if a not in used and b not in used:
            used |= {a, b}
            want.add((a, b))
    schema = "symbol string, t long, ticket string"
    got = folds.match_one_to_one(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["symbol"], "t", "ticket", 6)
    assert {(r["left_ticket"], r["right_ticket"]) for r in got.collect()} == want


def test_backtest_stop_target_and_end(spark):
    q = quote_frame(spark, [(0, 100), (1, 101), (2, 104), (3, 103), (4, 99), (5, 98)], 0.0).select("source", "instrument", "us", "id", "bid", "ask")
    i = spark.createDataFrame([("s", "X", BASE + int(0.1 * S), 1, 2.0, 3.0), ("s", "X", BASE + int(2.1 * S), 1, 2.0, 9.0), ("s", "X", BASE + int(4.1 * S), -1, 5.0, 5.0)], "source string, instrument string, us long, side int, stop double, target double")
    got = collected(folds.backtest(q, i, ["source", "instrument"]), "opened_us")
    assert [(r["entry"], r["exit"], r["reason"]) for r in got] == [(101.0, 104.0, "target"), (103.0, 99.0, "stop"), (98.0, 98.0, "end")]


def test_backtest_takes_the_next_intent_at_the_tick_that_closes(spark):
    q = quote_frame(spark, [(0, 100), (1, 100), (2, 95), (3, 95), (4, 95)], 0.0).select("source", "instrument", "us", "id", "bid", "ask")
    schema = "source string, instrument string, us long, side int, stop double, target double"
    i = spark.createDataFrame([("s", "X", BASE, 1, 2.0, 9.0), ("s", "X", BASE + int(1.2 * S), -1, 2.0, 2.0), ("s", "X", BASE - 5 * S, 1, 1.0, 1.0), ("s", "X", BASE + 3 * S, 1, -1.0, 1.0), ("s", "X", BASE + 60 * S, 1, 1.0, 1.0)], schema)
    got = collected(folds.backtest(q, i, ["source", "instrument"]), "opened_us")
    assert [((r["opened_us"] - BASE) // S, r["side"], r["entry"], r["exit"], r["reason"]) for r in got] == [(1, 1, 100.0, 95.0, "stop"), (2, -1, 95.0, 95.0, "end")]


def test_backtest_against_a_loop(spark, monkeypatch):
    rng = random.Random(31)
    prices, b = [], 100.0
    for n in range(900):
        b = round(b + rng.gauss(0, 0.05), 3)
        prices.append((n * 7 // 3, b))  # several ticks share a second
    q = quote_frame(spark, prices, 0.02).select("source", "instrument", "us", "id", "bid", "ask")
    made = [(BASE + rng.randrange(-10, 2200) * S + rng.randrange(S), rng.choice([-1, 1, 1, 0]), rng.choice([0.1, 0.2, 0.4, 0.0]), rng.choice([0.1, 0.2, 0.5])) for _ in range(250)]
    i = spark.createDataFrame([("s", "X", *m) for m in made], "source string, instrument string, us long, side int, stop double, target double")
    ticks = [(BASE + t * S, n, p, p + 0.02) for n, (t, p) in enumerate(prices)]
    want, pending, position = [], sorted(made), None
    for us, _, bid, ask in ticks:
        if position:
            o, side, entry, stop, target = position
            price = bid if side > 0 else ask
            if side * (price - entry) <= -stop + 1e-12 or side * (price - entry) >= target - 1e-12:
                want.append((o, side, us, price))
                position = None
        while pending and pending[0][0] + 250_000 <= us:
            at, side, stop, target = pending.pop(0)
            if at >= ticks[0][0] and position is None and side and stop > 0 and target > 0:
                position = (us, side, ask if side > 0 else bid, stop, target)
    if position:
        want.append((position[0], position[1], ticks[-1][0], ticks[-1][2] if position[1] > 0 else ticks[-1][3]))
    for width in (None, 300 * S):
        if width:
            monkeypatch.setattr(shards.shard_of, "__defaults__", (width,))
        got = [(r["opened_us"], r["side"], r["closed_us"], r["exit"]) for r in collected(folds.backtest(q, i, ["source", "instrument"]), "opened_us")]
        assert [g[:3] for g in got] == [w[:3] for w in want] and len(got) > 20
        assert all(g[3] == pytest.approx(w[3]) for g, w in zip(got, want))


def test_metrics(spark):
    assert metrics.block_interval([2.0] * 100, 200, 10, 1) == (2.0, 2.0) and metrics.block_interval([], 10, 5, 1) == (0.0, 0.0)
    assert metrics.block_interval([1.0, 2.0, 5.0, 3.0], 300, 3, 7) == metrics.block_interval([1.0, 2.0, 5.0, 3.0], 300, 3, 7)
    got = metrics.folds(spark, datetime(2026, 1, 1), datetime(2026, 1, 31), metrics.WalkForward(10, 3, 3, 3, 60, 120)).orderBy("fold").collect()
    assert len(got) == 5 and (got[2]["train_end"] - got[0]["train_start"]).days == 16 and (got[0]["validation_start"] - got[0]["train_end"]).seconds == 60 and (got[0]["test_start"] - got[0]["validation_end"]).seconds == 120
    rows = spark.createDataFrame([(float(x), float(2 * x + 1), None if x == 3 else 1.0) for x in range(50)], "x double, y double, c double")
    model = metrics.ridge(rows, ["x", "c"], "y", 1e-9)
    assert all(abs(r["p"] - r["y"]) < 1e-6 for r in rows.select("y", metrics.ridge_score(model).alias("p")).collect())
    boot = metrics.bootstrap(spark.createDataFrame([("a", i, 1.5) for i in range(30)], "k string, d int, v double"), ["k"], ["d"], "v", 100, 5).collect()
    assert [tuple(r) for r in boot] == [("a", 1.5, 1.5)]


def test_relevance_and_sessions(spark):
    df = spark.createDataFrame([("Gold rises as FOMC meets",), ("weather",), (None,), ("Dollar and CPI",)], "t string")
    got = [(r["score"], r["reasons"]) for r in classify.relevance(df, "t").collect()]
    assert got == [(pytest.approx(0.86), ["gold", "federal_reserve"]), (0.0, []), (0.0, []), (pytest.approx(0.61), ["inflation", "usd_yields"])]
    hours = spark.createDataFrame([(h * 3600 * S,) for h in (0, 7, 12, 16, 21)], "t long").select(classify.session_of("t").alias("s"))
    assert [r["s"] for r in hours.collect()] == ["asia", "london", "london_new_york_overlap", "new_york", "maintenance_or_late"]
