"""Lab queries on small tables, against plain loops."""

from __future__ import annotations

import random
from collections import defaultdict
from datetime import UTC, datetime, timedelta
from statistics import median

import pytest

from tickloom.operators import classify, folds
from tickloom.plans import labs, market

S = 1_000_000
DAY = 86_400 * S


def greedy(left, right, tolerance):
    """Pairs of (key, time, ticket) rows by the order of the reference: |lag|, left time, left and right ticket."""
    pool = sorted((abs(u - t), t, a, b, i, j, u - t) for i, (k, t, a) in enumerate(left) for j, (kk, u, b) in enumerate(right) if k == kk and abs(u - t) <= tolerance)
    used, out = (set(), set()), []
    for *_, i, j, lag in pool:
        if i not in used[0] and j not in used[1]:
            used[0].add(i)
            used[1].add(j)
            out.append((left[i], right[j], lag))
    return out


@pytest.mark.parametrize("seed, span, tolerance", [(1, 12, 1), (2, 60, 3), (3, 500, 7), (4, 25, 25)])
def test_matching_with_many_rows_of_one_instant(spark, seed, span, tolerance):
    rng = random.Random(seed)
    make = lambda n, s: [(rng.choice("XY"), rng.randrange(span), f"{s}{x}") for x in rng.sample(range(1000), n)]
    left, right = make(150, ""), make(120, "")
    schema = "symbol string, t long, ticket string"
    got = folds.match_one_to_one(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["symbol"], "t", "ticket", tolerance).collect()
    assert sorted((r["symbol"], r["left_t"], r["left_ticket"], r["right_t"], r["right_ticket"], r["lag_us"]) for r in got) == sorted((*a, *b[1:], lag) for a, b, lag in greedy(left, right, tolerance))


def test_lab13_matches_by_symbol_and_side_over_all_accounts(spark, tmp_path):
    rng = random.Random(5)
    start = datetime(1995, 1, 1)
    orders = [(o, rng.randrange(1, 900), start + timedelta(days=rng.randrange(40))) for o in range(1, 200)]
    lines = [(o, n, rng.randrange(1, 60), rng.choice("RAN"), at + timedelta(days=rng.randrange(-3, 30)), 1.0, 100.0, 0.04) for o, _, at in orders for n in range(1, rng.randrange(2, 5))]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber long, l_partkey long, l_returnflag string, l_shipdate timestamp, l_quantity double, l_extendedprice double, l_discount double").write.parquet(str(tmp_path / "lineitem.parquet"))
    by = {o: (c, at) for o, c, at in orders}
    sides: dict[int, list] = defaultdict(list)
    for o, n, part, flag, shipped, *_ in lines:
        account, at = by[o]
        if shipped >= at:
            sides[account % 2].append(((part % 10, -1 if flag == "R" else 1), (at - start).days * DAY, str(o * 10 + n)))
    pairs = greedy(sides[0], sides[1], DAY)
    lags = defaultdict(list)
    for (key, *_), _, lag in pairs:
        lags[key[0]].append(abs(lag))
    got = {r["symbol"]: (r["pairs"], r["median_lag_us"]) for r in labs.lab13_matched_trades(spark, str(tmp_path)).collect()}
    assert got == {k: (len(v), median(v)) for k, v in lags.items()} and {p[0][0][1] for p in pairs} == {-1, 1}


def robust(values, k):
    center = median(values)
    return center + k * 1.4826 * median(abs(v - center) for v in values)


def test_lab09_judges_all_seconds_and_spaces_shocks(spark, tmp_path):
    """A quote a second, so that return_5s is against five rows before; shocks everywhere in the minute."""
    rng = random.Random(9)
    start, mids = 1_760_000_040, [100.0]
    for i in range(1, 2400):
        mids.append(round(mids[-1] * (1 + rng.gauss(0, 1e-5) + (rng.choice([-1, 1]) * 3e-3 if i % 97 == 0 else 0)), 6))
    rows = [(i, datetime.fromtimestamp(start + i, UTC), m - 0.01, m + 0.01, "s", "X") for i, m in enumerate(mids)]
    spark.createDataFrame(rows, "id long, occurred_at timestamp, bid double, ask double, source string, instrument string").write.parquet(str(tmp_path / "market_ticks.parquet"))
    mid = [((b + a) / 2) for _, _, b, a, *_ in rows]
    back = {i: mid[i] / mid[i - 5] - 1 for i in range(5, len(mid))}
    limit, last, kept = robust([abs(v) for v in back.values()], 4.0), -(10**9), []
    for i, v in back.items():
        if abs(v) > limit and i - last >= 300:
            last = i
            kept.append(i)
    assert len(kept) >= 6 and any((start + i) % 60 >= 20 for i in kept)
    got = labs.lab09_shocks(spark, str(tmp_path)).collect()
    assert {(r["policy"], r["horizon_s"]) for r in got} == {(p, h) for p in ("classified", "fade_all", "continue_all", "random_direction") for h in (30, 60, 300)}
    for h in (30, 60, 300):
        # entry at the first quote from a second and the latency on, exit h later
        nets = []
        for i in kept:
            if i + 2 + h < len(rows):
                (eb, ea), (xb, xa) = rows[i + 2][2:4], rows[i + 2 + h][2:4]
                nets.append((xb / ea - 1 if back[i] > 0 else eb / xa - 1) * 10_000)
        own = [r for r in got if r["policy"] == "continue_all" and r["horizon_s"] == h]
        assert sum(r["n"] for r in own) == len(kept) and sum(r["trades"] for r in own) == len(nets)
        assert sum(r["mean_net_bps"] * r["trades"] for r in own if r["trades"]) == pytest.approx(sum(nets), abs=1e-3 * len(nets))
        assert all(r["trades"] == 0 for r in got if r["policy"] == "classified" and r["action"] == "abstain")


@pytest.fixture(scope="module")
def breakouts(spark, tmp_path_factory):
    """A quote every two seconds for three hours, with jumps that start episodes."""
    rng, folder = random.Random(3), tmp_path_factory.mktemp("breakouts")
    at, mid, rows = 1_760_000_400, 100.0, []
    for i in range(5400):
        mid = round(mid * (1 + rng.gauss(0, 6e-5) + (rng.choice([-1, 1]) * 1e-3 if i % 400 == 399 else 0)), 6)
        rows.append((i, datetime.fromtimestamp(at + 2 * i, UTC), mid - 0.002, mid + 0.002, "s", "X"))
    spark.createDataFrame(rows, "id long, occurred_at timestamp, bid double, ask double, source string, instrument string").write.parquet(str(folder / "market_ticks.parquet"))
    starts = [(r["start_us"], r["side"]) for r in labs._episodes(spark, str(folder)).collect()]
    assert len(starts) >= 5
    return str(folder), [((at + 2 * i) * S, b, a) for i, (_, _, b, a, *_) in enumerate(rows)], starts


def test_lab07_runs_the_whole_family(spark, breakouts):
    folder, quotes, starts = breakouts
    family = [(w, p, h, s, t) for w in (0, 5, 15, 30) for p in (0.0, 0.5, 1.0) for h in (60, 180, 300, 900) for s in (4.0, 8.0, 12.0) for t in (4.0, 8.0, 12.0) if (p == 0) == (w == 0)]
    assert len(family) == 252
    want = defaultdict(list)
    for at, side in starts:
        path = [q for q in quotes if at <= q[0] <= at + 960 * S]
        for w, p, h, s, t in family if path else []:
            mid, first = (path[0][1] + path[0][2]) / 2, path[0][0]
            price = lambda q: q[2] if side > 0 else q[1]
            entry = next((i for i, q in enumerate(path) if first + 50_000 <= q[0] <= first + (w or 2) * S and (p == 0 or side * (mid - price(q)) / mid * 10_000 >= p)), None)
            for q in path[entry:] if entry is not None else []:
                cost = price(path[entry])
                gross = side * ((q[1] if side > 0 else q[2]) - cost) / cost * 10_000
                reason = "stop" if gross <= -s else "target" if gross >= t else "time" if q[0] >= path[entry][0] + h * S else None
                if reason:
                    want[f"w{w}_p{p:g}_h{h}_s{s:g}_t{t:g}", reason].append(gross)
                    break
    got = {(r["policy"], r["reason"]): (r["n"], r["mean"]) for r in labs.lab07_path_management(spark, folder).collect()}
    assert got == {k: (len(v), pytest.approx(sum(v) / len(v), abs=1e-3)) for k, v in want.items()} and len({k for k, _ in got}) > 200


def test_lab11_runs_all_variants(spark, breakouts):
    folder, quotes, starts = breakouts
    want = defaultdict(list)
    for at, side in starts:
        path = [q for q in quotes if at <= q[0] <= at + 932 * S]
        for staged in (False, True) if path else ():
            for runner in (False, True):
                entries, peak, banked, weight, end = [path[0][2] if side > 0 else path[0][1]], float("-inf"), 0.0, 1.0, path[0][0] + (900 if runner else 300) * S
                for us, bid, ask in path:
                    out, reason = bid if side > 0 else ask, None
                    move = side * (out - entries[0]) / entries[0] * 10_000
                    if staged and len(entries) < 3 and move <= -(4.0, 8.0)[len(entries) - 1]:
                        entries.append(ask if side > 0 else bid)
                    value = sum(side * (out - x) / x * 10_000 for x in entries) / len(entries)
                    if value <= -12:
                        reason = "basket_stop"
                    elif us - path[0][0] >= 15 * S and move <= -6:
                        reason = "quick_failure"
                    else:
                        peak = max(peak, value)
                        if runner and weight == 1.0 and value >= 8:
                            banked, weight = value / 2, 0.5
                        reason = "trailing" if runner and weight < 1 and peak - value >= 6 else "time" if us >= end else None
                    if reason:
                        want[f"{'staged' if staged else 'single'}_{'runner' if runner else 'fixed'}", reason, weight < 1].append(banked + weight * value)
                        break
    got = {(r["variant"], r["reason"], r["partial"]): (r["n"], r["mean"]) for r in labs.lab11_staged(spark, folder).collect()}
    assert got == {k: (len(v), pytest.approx(sum(v) / len(v), abs=1e-3)) for k, v in want.items()} and len({k for k, *_ in got}) == 4


def test_prj26_arrival_issues_follow_the_order_of_ids(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(classify, "ARRIVAL_SHARD", 50)
    rng, start, rows = random.Random(26), 1_760_000_000, []
    for i in rng.sample(range(2000), 700):
        at = start + i * 20 + rng.choice([0, 0, 0, -90, 500])
        rows.append((i, datetime.fromtimestamp(at, UTC), 100.0, 100.0 + rng.choice([0.01, 0.5]), "s", rng.choice("XY"), rng.choice([None, str(i), str(i)])))
    last = max(rows)
    rows += [(2000 + n, last[1], 100.0, 100.01, "s", last[5], "7") for n in range(3)]
    spark.createDataFrame(rows, "id long, occurred_at timestamp, bid double, ask double, source string, instrument string, source_sequence string").write.parquet(str(tmp_path / "market_ticks.parquet"))
    want, seen, before = set(), set(), {}
    for i, at, bid, ask, _, k, n in sorted(rows, key=lambda r: r[0]):
        if n is not None and (k, at, n) in seen:
            want.add((i, "duplicate"))
        seen.add((k, at, n))
        if (ask - bid) / ((ask + bid) / 2) * 10_000 > 20:
            want.add((i, "wide_spread"))
        if k in before and at < before[k]:
            want.add((i, "out_of_order"))
        elif k in before and (at - before[k]).total_seconds() > 300:
            want.add((i, "time_gap"))
        before[k] = at
    got = [(r["id"], r["issue"]) for r in market.prj26_arrival_issues(spark, str(tmp_path)).collect()]
    assert set(got) == want and len(got) == len(want) and {x for _, x in want} == {"duplicate", "wide_spread", "out_of_order", "time_gap"}
