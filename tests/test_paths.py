"""Managed positions against plain loops."""

from __future__ import annotations

import random

import pytest

from tickloom.operators import paths

S = 1_000_000


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(21)
    rows, price = [], 100.0
    for i in range(900):
        price = round(price + rng.gauss(0, 0.02), 3)
        rows.append(("X", i * S + rng.randrange(S), i, price, round(price + 0.01, 3)))
    quotes = spark.createDataFrame(rows, "k string, us long, id long, bid double, ask double")
    starts = [(n, "X", rng.randrange(800) * S, rng.choice([-1, 1])) for n in range(25)] + [(99, "Y", 0, 1), (98, "X", 10**12, 1)]
    return rows, starts, quotes, spark.createDataFrame(starts, "episode long, k string, start_us long, side int")


def test_manage(spark, case):
    rows, starts, quotes, episodes = case
    grid = paths.policy_grid(spark, [0, 10], [0.0, 1.0], [20], [3.0, 6.0], [3.0])
    assert grid.count() == 4
    want = {}
    for e, k, at, side in starts:
        path = [r for r in rows if r[0] == k and r[1] >= at]
        for policy, wait, pull, hold, stop, target in grid.collect():
            if not path:
                continue
            mid = (path[0][3] + path[0][4]) / 2
            deadline = path[0][1] + (wait or 2) * S
            entry = next(((i, r[4] if side > 0 else r[3]) for i, r in enumerate(path) if path[0][1] + 50_000 <= r[1] <= deadline and (pull == 0 or side * (mid - (r[4] if side > 0 else r[3])) / mid * 1e4 >= pull)), None)
            if entry is None:
                continue
            for r in path[entry[0] :]:
                gross = side * ((r[3] if side > 0 else r[4]) - entry[1]) / entry[1] * 1e4
                reason = "stop" if gross <= -stop else "target" if gross >= target else "time" if r[1] >= path[entry[0]][1] + hold * S else None
                if reason:
                    want[e, policy] = (r[1], reason)
                    break
    got = {(r["episode"], r["policy"]): (r["exited_us"], r["reason"]) for r in paths.manage(episodes, quotes, ["k"], grid).collect()}
    assert got == want and len(want) > 40


def test_staged_positions_end_once(spark, case):
    _, _, quotes, episodes = case
    got = paths.staged_positions(episodes, quotes, ["k"]).collect()
    assert len({r["episode"] for r in got}) == len(got) >= 20
    assert {r["reason"] for r in got} <= {"basket_stop", "quick_failure", "trailing", "time"} and all(1 <= r["tickets"] <= 3 for r in got)
    plain = paths.staged_positions(episodes, quotes, ["k"], paths.Staging(staged=False, runner=False, basket_stop_bps=1e9, failure_bps=1e9, hold_s=20)).collect()
    assert {r["reason"] for r in plain} == {"time"} and all(r["tickets"] == 1 and not r["partial"] for r in plain)


def test_staged_known_path(spark):
    path = [(0, 100.0), (1, 99.955), (2, 99.91), (3, 100.0), (4, 100.15), (5, 100.05), (6, 101.0)]
    quotes = spark.createDataFrame([("X", t * S, i, p, p) for i, (t, p) in enumerate(path)], "k string, us long, id long, bid double, ask double")
    episodes = spark.createDataFrame([(1, "X", 0, 1)], "episode long, k string, start_us long, side int")
    r = paths.staged_positions(episodes, quotes, ["k"]).first()
    prices = [100.0, 99.955, 99.91]
    value = lambda p: sum((p - q) / q * 1e4 for q in prices) / 3
    assert r["tickets"] == 3 and r["partial"] and r["reason"] == "trailing"
    assert r["gross_bps"] == pytest.approx(value(100.15) / 2 + value(100.05) / 2)


def test_signal_trades_and_latency(spark):
    quotes = spark.createDataFrame([("X", t * S, 100.0 + t, 100.5 + t) for t in (0, 1, 10, 11, 30)], "k string, us long, bid double, ask double")
    signals = spark.createDataFrame([("X", 0, 1), ("X", 5 * S, 1), ("X", 12 * S, 1)], "k string, us long, side int")
    got = paths.signal_trades(signals, quotes, ["k"], 10 * S, 5 * S).collect()
    assert [(r["us"], r["entered_us"], r["exited_us"], r["boundary_valid"]) for r in got] == [(0, 0, 10 * S, True)]
    t = spark.createDataFrame([("X", 1, 1, 0, 10 * S)], "k string, trade int, side int, entry_us long, exit_us long")
    out = {r["latency_us"]: (r["reason"], r["gross_bps"]) for r in paths.latency_replay(t, quotes, ["k"], [0, S, 3 * S], 2 * S).collect()}
    assert out[0] == (None, pytest.approx((110 / 100.5 - 1) * 1e4)) and out[3 * S][0] == "no_entry_quote"


def test_zones_expire_and_mitigate(spark):
    bars = spark.createDataFrame([("X", i, float(c)) for i, c in enumerate([5, 5, 9, 7, 9, 9, 9])], "k string, bar_us long, close double")
    gaps = spark.createDataFrame([("X", 2, 1, 6.0, 8.0)], "k string, bar_us long, side int, zone_low double, zone_high double")
    got = paths.zones(bars, gaps, ["k"], expiry=3).orderBy("bar_us").collect()
    assert [r["age"] for r in got] == [None, None, 0, 1, 2, 3, None] and [r["mitigated"] for r in got] == [None, None, False, True, True, True, None]
