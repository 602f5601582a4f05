"""Exact quantiles against numpy."""

from __future__ import annotations

import random

import numpy as np

from tickloom.operators.quantiles import quantiles_of, weighted_quantiles


def test_quantiles_against_numpy(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "a", "a", "b", None]), float(rng.choice([rng.randrange(50), rng.random() * 1e6])), "x") for _ in range(4000)] + [("c", 7.5, "x"), ("d", None, "x")]
    df = spark.createDataFrame(rows, "k string, v double, _p string")
    wanted = {"q25": 0.25, "q50": 0.5, "q99": 0.99, "top": 1.0}
    got = {r["k"]: r for r in quantiles_of(df, ["k"], "v", wanted).collect()}
    assert set(got) == {"a", "b", "c", None}
    for k, r in got.items():
        values = [v for g, v, _ in rows if g == k and v is not None]
        assert r["_n"] == len(values)
        for name, p in wanted.items():
            assert r[name] == np.quantile(values, p) or abs(r[name] - np.quantile(values, p)) < 1e-9 * abs(r[name])
    whole = quantiles_of(df, [], "v", {"m": 0.5}).first()
    assert abs(whole["m"] - np.median([v for _, v, _ in rows if v is not None])) < 1e-9


def test_weights_ties_and_no_rows(spark):
    df = spark.createDataFrame([("a", 1.0, 3), ("a", 2.0, 1), ("a", 2.0, 2), ("a", 9.0, 0), ("a", None, 5)], "k string, v double, m int")
    r = weighted_quantiles(df, ["k"], "v", "m", {"mid": 0.5}).first()
    assert (r["mid"], r["_n"]) == (1.5, 6)
    assert weighted_quantiles(df.where("false"), ["k"], "v", "m", {"mid": 0.5}).count() == 0
