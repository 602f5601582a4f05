"""Implausible quotes and readings, judged against what is normal for their own source."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.quantiles import weighted_quantiles
from tickloom.session import cut, fits_broadcast, written

# Numbers that feeds send where they have no price.
PLACEHOLDERS = (9999.0, 99999.0, 999999.0, 9999999.0, 99999999.0, 999999999.0, 65535.0, 2147483647.0, 4294967295.0)

BUCKET_US = 600_000_000
SHARD_ROWS = 100_000
HALO_ROWS = 2_000

SCORE = 14.0  # standardised innovation; some twenty usual moves
MAX_RUN = 10  # quotes after which a move counts as one that stays
STUCK_RUN = 20
# what is usual for a quote: the moves within REACH quotes on both sides, and no less than the usual ones just before or after it
REACH, NEAR, LEAST = 1_024, 256, 128
# quotes within which an unnumbered row looks for the session around it
SEARCH = 500


def usual_moves(x: np.ndarray, reach: int = REACH, near: int = NEAR, least: int = LEAST) -> np.ndarray:
    """For each value the usual move around it: the median of the non-zero moves within reach values on both sides, or that of the near values
    on one side if it is larger (with at least so many moves). It follows a source whose moves grow or shrink; nan where nothing moves."""
    if len(x) < 2:
        return np.full(len(x), np.nan)
    moves = np.abs(np.diff(x, prepend=x[0]))
    moves[moves == 0] = np.nan
    s = pd.Series(moves)
    if len(x) <= reach:  # every window holds the whole series
        known = moves[~np.isnan(moves)]
        around = np.full(len(x), np.median(known) if len(known) else np.nan)
    else:
        around = s.rolling(2 * reach + 1, center=True, min_periods=1).median().to_numpy()
    if len(x) <= least:
        return around
    before = s.rolling(near, min_periods=least).median().to_numpy()
    after = s[::-1].rolling(near, min_periods=least).median().to_numpy()[::-1]
    return np.fmax(around, np.fmax(before, after))


def filter_level(x: np.ndarray, moves: np.ndarray, score: float = SCORE, max_run: int = MAX_RUN) -> np.ndarray:
    """Flags of a local-level Kalman filter over one session's prices.

    The noise variances follow the usual quote-to-quote move at each quote. A quote whose standardised innovation exceeds score is flagged
    and doesn't update the level, and so are the ones after it until the price has come at least half the way back. If it does so within max_run
    quotes the flags stay; if it doesn't, it was a move: the flags go and the filter starts again on the new level. Quotes that are off when the
    session ends didn't come back and aren't flagged. Where nothing moves nothing is flagged.
    """
    n = len(x)
    out = np.zeros(n, bool)
    if n < 3:
        return out
    variances = ((moves / 0.6745) ** 2).tolist()
    limit = score * score
    level, p = float(np.median(x[:11])), None
    values, i, held, restarted, back = x.tolist(), 0, -1, -1, 0.0
    while i < n:
        sigma2 = variances[i]
        if not sigma2 > 0:
            level, p, held = values[i], None, -1
            i += 1
            continue
        q, r = sigma2 / 2, sigma2 / 4
        v = values[i] - level
        prior = (r if p is None else p) + q
        s = prior + r
        if v * v > limit * s or held >= 0 and abs(v) > back:
            if held < 0:
                held, back = i, abs(v) / 2
            if i - held >= max_run:
                out[held : i + 1] = False
                if held > restarted:
                    restarted, level, i = held, float(np.median(x[held : i + 1])), held - 1
                else:
                    level = values[i]
                held, p = -1, None
            else:
                out[i] = True
        else:
            k = prior / s
            level += k * v
            p = prior * (1 - k)
            held = -1
        i += 1
    if held >= 0:
        out[held:] = False
    return out


def vanished(x: np.ndarray, run: int = STUCK_RUN) -> np.ndarray:
    """Whether each value lies where the variance of the innovations vanishes.

    The filter is the local-level one without observation noise, whose forecast is the last value. Over run - 1 innovations their
    mean square is zero exactly if run values are equal; all values of such a window are stuck.
    """
    out = np.zeros(len(x), bool)
    if len(x) < run:
        return out
    innovations = np.diff(x)
    innovations[np.isnan(innovations)] = np.inf
    variance = np.lib.stride_tricks.sliding_window_view(innovations * innovations, run - 1).mean(axis=1)
    gone = np.flatnonzero(variance == 0)
    steps = np.zeros(len(x) + 1, np.int64)
    np.add.at(steps, gone, 1)
    np.add.at(steps, gone + run, -1)
    return np.cumsum(steps[:-1]) > 0


def _middles(x: np.ndarray, reach: int = REACH) -> np.ndarray:
    """The median of the non-nan values within reach of each."""
    if len(x) <= reach:
        known = x[~np.isnan(x)]
        return np.full(len(x), np.median(known) if len(known) else 0.0)
    return pd.Series(x).rolling(2 * reach + 1, center=True, min_periods=1).median().fillna(0.0).to_numpy()


def judge_session(bid: np.ndarray, ask: np.ndarray) -> dict[str, np.ndarray]:
    """Flags by reason for the different quotes of one session in time order. Each depends on at most REACH quotes and the filter's memory on either side."""
    n = len(bid)
    finite = np.isfinite(bid) & np.isfinite(ask)
    positive = finite & (bid > 0) & (ask > 0)
    middle = _middles(np.where(positive, (bid + ask) / 2, np.nan))
    off = lambda x: np.isin(x, PLACEHOLDERS) & (np.abs(x - middle) > middle / 2)
    placeholder = ~positive | off(bid) | off(ask)
    crossed = finite & ~placeholder & (ask < bid)
    usable = np.flatnonzero(~placeholder)
    spike = np.zeros(n, bool)
    for x in (bid[usable], ask[usable]):
        spike[usable] |= filter_level(x, usual_moves(x))
    return {"placeholder": placeholder, "crossed": crossed, "spike": spike, "stuck": vanished(bid) | vanished(ask)}


_FIELDS = ("source string", "instrument string", "t long", "bid double", "ask double", "b double", "n double", "id long", "copies long")


def _judge(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["t", "n", "id"], kind="stable").reset_index(drop=True)
    given, pdf = pdf, pdf.assign(b=pdf["b"].where(pdf["b"] >= 0), n=pdf["n"].where(pdf["n"] >= 0))
    session = pdf["b"].ffill(limit=SEARCH).bfill(limit=SEARCH).fillna(-1).to_numpy()
    same = pdf["b"].notna() & pdf["n"].notna()
    # one message is one quote; rows without a number are the same quote if time and prices agree
    named = pd.util.hash_pandas_object(pdf[["b", "n"]].fillna(-1.0), index=False)
    priced = pd.util.hash_pandas_object(pdf[["t", "bid", "ask"]], index=False)
    alias = pd.Series(named.to_numpy(), index=priced.to_numpy())[same.to_numpy()]
    alias = alias[~alias.index.duplicated()]
    quote = np.where(same, named, alias.reindex(priced.to_numpy()).fillna(0).to_numpy(np.uint64))
    quote = np.where(~same & (quote == 0), priced, quote)
    # a session is contiguous in time, so its first row places it
    reasons = {k: np.zeros(len(pdf), bool) for k in ("placeholder", "crossed", "spike", "stuck")}
    order = np.argsort(session, kind="stable")
    bid, ask = pdf["bid"].to_numpy(), pdf["ask"].to_numpy()
    for rows in np.split(order, np.flatnonzero(np.diff(session[order])) + 1):
        codes, first = np.unique(quote[rows], return_index=True)
        first = np.sort(first)
        code_of = {c: i for i, c in enumerate(quote[rows][first].tolist())}
        place = np.fromiter((code_of[c] for c in quote[rows].tolist()), np.int64, len(rows))
        kept = rows[first]
        for reason, flags in judge_session(bid[kept], ask[kept]).items():
            reasons[reason][rows] = flags[place]
    # a repeated row that carries other prices is judged on these as well
    reasons["placeholder"] |= ~(np.isfinite(bid) & np.isfinite(ask) & (bid > 0) & (ask > 0))
    reasons["crossed"] |= (ask < bid) & ~reasons["placeholder"]
    hit = pdf["core"].to_numpy(bool) & np.logical_or.reduce(list(reasons.values()))
    return given.loc[hit, [f.split()[0] for f in _FIELDS]].assign(**{k: v[hit] for k, v in reasons.items()})


def _ranked(rows: DataFrame, keys: list[str], order: list[str], partitions: int) -> DataFrame:
    """rows with rank, counted from 0 in each keys by order, without a task that holds a whole key: rows are cut by range, numbered in each range, and the ranges' counts added up."""
    cuts = rows.repartitionByRange(max(partitions, 1), *keys, *order).sortWithinPartitions(*keys, *order)
    numbered = written(cuts.withColumn("_i", F.monotonically_increasing_id()).withColumn("_p", F.shiftright("_i", 33)))
    parts = numbered.groupBy(*keys, "_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(*keys, "_p", "_first", before.alias("_before"))
    return numbered.join(parts, [*keys, "_p"]).withColumn("rank", F.col("_before") + F.col("_i") - F.col("_first")).drop("_i", "_p", "_first", "_before")


def _shards(position: Column, upto: Column, shard_rows: int, halo_rows: int) -> Column:
    """The shards that need rows at these positions of their series: their own, and those within the halo."""
    zero = F.lit(0).cast("long")
    return F.sequence(F.greatest(F.floor((position - halo_rows) / shard_rows).cast("long"), zero), F.floor((upto + halo_rows) / shard_rows).cast("long"))


def flag_quotes(quotes: DataFrame, shard_rows: int = SHARD_ROWS, halo_rows: int = HALO_ROWS, bucket_us: int = BUCKET_US) -> DataFrame:
    """(id, placeholder, crossed, spike, stuck) of the implausible quotes.

    quotes: id, source, instrument, t (microseconds), bid, ask (all not null), b, n (session and number; null where unknown: such a
    row belongs to the session of the last numbered row within SEARCH rows before it, else of the next one). Per source, instrument and session: a price
    that isn't positive and finite or is a placeholder; ask below bid; a price off the level of the Kalman filter that comes back within ten quotes;
    stretches of twenty or more different quotes over which the innovations of bid or ask have no variance. Rows of one message are judged once and share
    the verdict. Rows with a null in a required column are left out; ties in time go by number and id.

    Every verdict depends on a bounded number of quotes on both sides (REACH for what is usual, the filter's memory, which a constant gain
    forgets within some sixty quotes, and the runs), never on a whole session. So a series is cut into shards of about shard_rows, each with at least
    halo_rows of its neighbours' rows on both sides, and the verdicts don't depend on where the cuts lie; halo_rows must exceed that reach. Counts per
    ten minutes place the rows of ordinary buckets; a bucket with more than an eighth of a shard is cut by the exact rank of its rows.
    Rows equal in everything but the id are judged as one before they are grouped, so that copies of a row, however many, don't fill a shard.
    """
    keys = ["source", "instrument"]
    same = [*keys, "t", "bid", "ask", "b", "n"]
    rows = quotes.select("id", *keys, "t", "bid", "ask", F.coalesce(F.col("b").cast("double"), F.lit(-1.0)).alias("b"), F.coalesce(F.col("n").cast("double"), F.lit(-1.0)).alias("n"))
    rows = rows.where(" and ".join(f"{c} is not null" for c in ("id", *keys, "t", "bid", "ask")))
    rows = rows.withColumn("bucket", F.floor(F.col("t") / bucket_us).cast("long"))
    once = lambda df: df.groupBy(*same, "bucket").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
    # how many different quotes a bucket holds, near enough to place ordinary buckets
    counts = cut(rows.groupBy(*keys, "bucket").agg(F.approx_count_distinct(F.xxhash64(*same), 0.05).alias("m")))
    hot = counts.where(F.col("m") > shard_rows / 8).select(*keys, "bucket")
    ranked = None
    if not hot.isEmpty():
        mine = once(rows.join(_small(hot), [*keys, "bucket"], "left_semi"))
        total = counts.where(F.col("m") > shard_rows / 8).agg(F.sum("m")).first()[0]
        ranked = _ranked(mine, [*keys, "bucket"], ["t", "n", "id"], -(-total // shard_rows))
        exact = ranked.groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("exact"))
        counts = counts.join(exact, [*keys, "bucket"], "left").select(*keys, "bucket", F.coalesce("exact", "m").alias("m"), F.col("exact").isNotNull().alias("hot"))
    else:
        counts = counts.withColumn("hot", F.lit(False))
    upto = F.sum("m").over(Window.partitionBy(*keys).orderBy("bucket"))
    plan = cut(counts.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("m")))
    own = F.floor(F.col("before") / shard_rows).cast("long")
    # a bucket serves the shards from the one that still needs its last rows to the one that needs its first
    ordinary = _small(plan.where("not hot").select(*keys, "bucket", own.alias("own"), F.explode(_shards(F.col("before"), F.col("upto"), shard_rows, halo_rows)).alias("shard")))
    if ranked is None:
        spread = once(rows).join(ordinary, [*keys, "bucket"])
    else:
        spread = once(rows.join(_small(hot), [*keys, "bucket"], "left_anti")).join(ordinary, [*keys, "bucket"])
        at = F.col("before") + F.col("rank")
        cores = ranked.join(_small(plan.where("hot").select(*keys, "bucket", "before")), [*keys, "bucket"])
        cores = cores.withColumn("own", F.floor(at / shard_rows).cast("long")).withColumn("shard", F.explode(_shards(at, at, shard_rows, halo_rows)))
        spread = spread.unionByName(cores.drop("rank", "before"))
    spread = spread.withColumn("core", F.col("shard") == F.col("own")).drop("bucket", "own")
    reasons = ["placeholder", "crossed", "spike", "stuck"]
    judged = cut(spread.groupBy(*keys, "shard").applyInPandas(_judge, ", ".join([*_FIELDS, *(f"{r} boolean" for r in reasons)])))
    # verdicts on copies go back to all their rows
    copied = _small(judged.where("copies > 1").select(*same, *reasons))
    return judged.where("copies = 1").select("id", *reasons).unionByName(rows.join(copied, same).select("id", *reasons))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if fits_broadcast(df) else df


READING_SCORE = 3.0  # standardised innovation of a reading's logarithm
READING_GAIN = 0.1


def filter_readings(logs: np.ndarray, usual: float, scale: float, score: float = READING_SCORE, gain: float = READING_GAIN) -> np.ndarray:
    """Flags of a local-level Kalman filter in its steady state over the logarithms of one series, from its usual value on.

    A reading whose innovation exceeds score times scale is flagged and doesn't move the level; the level stays within that of the usual value.
    """
    out, level, limit = np.zeros(len(logs), bool), usual, score * scale
    for i, x in enumerate(logs.tolist()):
        v = x - level
        if abs(v) > limit:
            out[i] = True
        else:
            level = min(max(level + gain * v, usual - limit), usual + limit)
    return out


def flag_readings(rows: DataFrame, keys: list[str], value: str, order: str, factor: float = 5.0, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """rows whose value is not positive, or beyond factor times or below a factor-th of the usual value of their keys, with that usual value.

    A Kalman filter per keys runs over the logarithms of the positive finite values by `order` (a unique number) and flags what departs from its
    forecast by more than half the logarithm of factor; its level stays as near to the usual value, so all that lies beyond factor is flagged. Flagged
    values are then held against the usual value itself: the exact median of the positive finite values. Other values are flagged as they are. Null
    values are never flagged; null keys form their own group. A hot series is cut by `order`, each piece starting from the usual value.
    """
    v = F.col(value)
    good = (v > 0) & (v < float("inf"))
    bad = rows.where(v.isNotNull() & ~good)
    usual = weighted_quantiles(rows.where(good).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_m")), keys, value, "_m", {"usual": 0.5})
    left, right = rows.alias("l"), _small(usual).alias("u")
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"u.{k}")) for k in keys]
    known = rows.where(good).alias("l").join(right, on).select("l.*", "usual")
    half = float(np.log(factor)) / 2
    schema = known.schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        logs = np.log(pdf[value].to_numpy(float))
        out = filter_readings(logs, float(np.log(pdf["usual"].iloc[0])), half / READING_SCORE)
        return pdf[out].drop(columns=["_series", "_slot"])

    flagged = known.withColumn("_series", F.xxhash64(*keys)).withColumn("_slot", F.floor(F.col(order) / shard_rows)).groupBy("_series", "_slot").applyInPandas(run, schema)
    exact = (v > factor * F.col("usual")) | (v < F.col("usual") / factor)
    return flagged.where(exact).unionByName(bad.alias("l").join(right, on, "left").select("l.*", "usual"))
