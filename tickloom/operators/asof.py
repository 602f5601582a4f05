"""As-of, interval and band joins over time, without nested loops and without one task per hot key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.shards import SHARD_US, shard_of

HOUR_US = 3_600_000_000


def asof(left: DataFrame, right: DataFrame, keys: list[str], left_t: str, right_t: str, columns: list[str], direction: str = "backward", strict: bool = False, tolerance_us: int | None = None, prefix: str = "r_") -> DataFrame:
    """left with the columns of the nearest right row at or before (backward) or at or after (forward) it in the same keys.

    strict leaves out right rows at the very instant. Right rows beyond tolerance_us give nulls, as does the lack of any. Of right rows at
    one instant the one with the greatest columns counts (forward: the smallest). Left rows with a null key or time
    are kept with nulls. Both sides are merged and sorted once per (keys, shard). With a
    tolerance right rows near a border are copied to the next shard; without one each shard is given what it would carry from its neighbours.
    """
    forward = direction == "forward"
    value = F.struct(F.col(right_t).alias("t"), *columns)
    has = " and ".join(f"`{k}` is not null" for k in keys)
    # at one instant the right row comes before the left one going backward, after it going forward; strict turns that round
    rank = (1 if forward else 0) if not strict else (0 if forward else 1)
    ls = left.withColumn("_row", F.struct(*left.columns))
    rights = right.where(has).where(F.col(right_t).isNotNull()).select(*keys, F.col(right_t).alias("_t"), F.lit(2 * rank).alias("_o"), value.alias("_r"), F.lit(None).cast(ls.schema["_row"].dataType).alias("_row"))
    fold = (F.min if forward else F.max)("_r").alias("_r")
    rights = rights.groupBy(*keys, "_t", "_o").agg(fold).withColumn("_row", F.lit(None).cast(ls.schema["_row"].dataType))
    good = has + f" and `{left_t}` is not null"
    lefts = ls.where(good).select(*keys, F.col(left_t).alias("_t"), F.lit(1).alias("_o"), F.lit(None).cast(rights.schema["_r"].dataType).alias("_r"), "_row")
    if tolerance_us is None:
        both, ends = _filled(rights.select(lefts.columns), lefts, keys, forward)
    else:
        # nothing further than the tolerance counts: right rows near a border also go to the next shard
        width = max(SHARD_US, tolerance_us)
        reach = (F.col("_t") - tolerance_us, F.col("_t")) if forward else (F.col("_t"), F.col("_t") + tolerance_us)
        spread = rights.select(lefts.columns).withColumn("_shard", F.explode(F.sequence(*[shard_of(e, width) for e in reach])))
        both, ends = spread.unionByName(lefts.withColumn("_shard", shard_of("_t", width))), None
    # forward in descending order: a frame that grows costs a step a row, one that runs to the end costs all rows behind
    w = Window.partitionBy(*keys, "_shard").orderBy(*[F.desc(c) if forward else F.asc(c) for c in ("_t", "_o")])
    found = F.last("_r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    merged = both.withColumn("_found", found).where("_row is not null")
    if ends is not None:
        beyond = F.col("_shard") < F.col("_edge") if forward else F.col("_shard") > F.col("_edge")
        merged = merged.join(ends, keys, "left").withColumn("_found", F.coalesce("_found", F.when(beyond, F.col("_end"))))
    near = F.lit(True) if tolerance_us is None else F.abs(F.col("_found.t") - F.col("_t")) <= tolerance_us
    names = [F.when(near, F.col(f"_found.{c}")).alias(prefix + c) for c in ["t", *columns]]
    out = merged.select("_row.*", *names)
    rest = left.where(f"not ({good})")
    return out.unionByName(rest.select("*", *[F.lit(None).cast(out.schema[prefix + c].dataType).alias(prefix + c) for c in ["t", *columns]]))


def _filled(rights: DataFrame, lefts: DataFrame, keys: list[str], forward: bool) -> tuple[DataFrame, DataFrame]:
    """Both sides with shards, each shard up to the next one with right rows given what it would carry; and what holds beyond the last such shard of a key.

    Fillers are one row per key and empty shard of the right side's time span. The left side is read once.
    """
    rights = rights.withColumn("_shard", shard_of("_t"))
    edge = F.struct("_t", "_o", "_r")
    known = rights.groupBy(*keys, "_shard").agg((F.min(edge) if forward else F.max(edge)).alias("_k"))
    by = Window.partitionBy(*keys).orderBy("_shard")
    if forward:
        steps, at, order = F.sequence(F.lag("_shard").over(by), F.col("_shard") - 1), (F.col("_shard") + 1) * SHARD_US, 9
    else:
        steps, at, order = F.sequence(F.col("_shard") + 1, F.lead("_shard").over(by)), F.col("_shard") * SHARD_US - 1, -1
    fillers = known.withColumn("_steps", steps).where("_steps is not null").select(*keys, F.explode("_steps").alias("_shard"), F.col("_k._r").alias("_r"))
    fillers = fillers.select(*keys, at.cast("long").alias("_t"), F.lit(order).alias("_o"), "_r", F.lit(None).cast(lefts.schema["_row"].dataType).alias("_row"), "_shard")
    ends = known.groupBy(*keys).agg((F.min if forward else F.max)(F.struct("_shard", "_k")).alias("_e")).select(*keys, F.col("_e._shard").alias("_edge"), F.col("_e._k._r").alias("_end"))
    return rights.unionByName(fillers).unionByName(lefts.withColumn("_shard", shard_of("_t"))), ends


def between(points: DataFrame, intervals: DataFrame, keys: list[str], t: str, start: str, end: str, width_us: int = HOUR_US, how: str = "inner") -> DataFrame:
    """points joined to the intervals [start, end] of their keys that hold them.

    Intervals are cut into buckets of width_us and both sides meet on (keys, bucket): a hash or merge join that no hot key overloads.
    Intervals with a null bound or end before start hold nothing. Column names other than keys must differ.
    """
    cut = intervals.where(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(end) >= F.col(start))).withColumn("_b", F.explode(F.sequence(shard_of(start, width_us), shard_of(end, width_us))))
    inside = points.withColumn("_b", shard_of(t, width_us)).alias("p")
    on = [F.col(f"p.{k}") == F.col(f"i.{k}") for k in [*keys, "_b"]]
    cond = (F.col(t) >= F.col(start)) & (F.col(t) <= F.col(end))
    joined = inside.join(cut.alias("i"), [*on, cond], how)
    if how in ("left_semi", "left_anti"):
        return joined.drop("_b")
    extra = [c for c in intervals.columns if c not in keys]
    return joined.select("p.*", *[F.col(f"i.{c}") for c in extra]).drop("_b")


def overlaps(a: DataFrame, b: DataFrame, keys: list[str], a_span: tuple[str, str], b_span: tuple[str, str], width_us: int = HOUR_US) -> DataFrame:
    """Pairs of half-open intervals of the same keys that overlap; each pair once, found in the bucket where the overlap begins."""
    cut = lambda df, s: df.where(F.col(s[1]) > F.col(s[0])).withColumn("_b", F.explode(F.sequence(shard_of(s[0], width_us), shard_of(F.col(s[1]) - 1, width_us))))
    x, y = cut(a, a_span).alias("x"), cut(b, b_span).alias("y")
    begin = F.greatest(F.col(f"x.{a_span[0]}"), F.col(f"y.{b_span[0]}"))
    cond = (F.col(f"x.{a_span[0]}") < F.col(f"y.{b_span[1]}")) & (F.col(f"y.{b_span[0]}") < F.col(f"x.{a_span[1]}")) & (F.col("x._b") == shard_of(begin, width_us))
    joined = x.join(y, [*[F.col(f"x.{k}") == F.col(f"y.{k}") for k in [*keys, "_b"]], cond])
    return joined.select("x.*", *[F.col(f"y.{c}") for c in b.columns if c not in keys]).drop("_b")
