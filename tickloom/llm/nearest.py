"""Pairing of records with the nearest record in time of the same entity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.session import fits_broadcast

BLOCK_US = 600_000_000


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two-pointer merge over rows sorted by (entity, block, t, kind, rid); kind 0 is the right side, 1 the left.

    Between batches it holds the last right row and the left rows that still wait for their next right row.
    """
    tail: pa.Table | None = None
    end = object()
    source = iter(batches)
    while True:
        batch = next(source, end)
        if batch is end:
            if tail is None or not tail.num_rows:
                return
            table = tail
        else:
            table = pa.Table.from_batches([batch])
            if tail is not None:
                table = pa.concat_tables([tail, table])
        n = table.num_rows
        if not n:
            continue
        table = table.combine_chunks()
        entity = table["entity"].chunk(0).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        block, t, kind, rid, tol = (table[c].chunk(0).to_numpy(zero_copy_only=False) for c in ("block", "t", "kind", "rid", "tol"))
        new = np.empty(n, bool)
        new[0] = True
        new[1:] = (entity[1:] != entity[:-1]) | (block[1:] != block[:-1])
        group = np.cumsum(new)
        right = kind == 0
        start = right.copy()
        start[1:] &= ~(right[:-1] & ~new[1:] & (t[1:] == t[:-1]))  # of equal times only the smallest id, which comes first
        at = np.arange(n)
        before = np.maximum.accumulate(np.where(start, at, -1))
        after = np.minimum.accumulate(np.where(start, at, n)[::-1])[::-1]
        left = np.flatnonzero(~right)
        b, a = before[left], after[left]
        known = np.ones(len(left), bool) if batch is end else (a < n) | (group[left] != group[-1])
        has_b = (b >= 0) & (group[b] == group[left])
        has_a = (a < n) & (group[np.minimum(a, n - 1)] == group[left])
        far = np.iinfo(np.int64).max
        db = np.where(has_b, t[left] - t[b], far)
        da = np.where(has_a, t[np.minimum(a, n - 1)] - t[left], far)
        ib, ia = rid[b], rid[np.minimum(a, n - 1)]
        take_a = (da < db) | ((da == db) & (ia < ib))
        distance, chosen = np.where(take_a, da, db), np.where(take_a, ia, ib)
        out = known & (distance <= tol[left])
        rows = left[out]
        yield pa.RecordBatch.from_arrays(
            [table["left_table"].chunk(0).take(pa.array(rows)), table["left_key"].chunk(0).take(pa.array(rows)), pa.array(t[rows]), pa.array(chosen[out].astype(np.int64)), pa.array(distance[out].astype(np.int64))],
            names=["left_table", "left_key", "t", "rid", "distance"],
        )
        if batch is end:
            return
        wait = left[~known]
        last = before[n - 1]
        keep = wait if last < 0 or group[last] != group[-1] else np.concatenate([[last], wait])
        tail = table.take(pa.array(keep, pa.int64()))


def nearest_by_time(left: DataFrame, right: DataFrame, block_us: int = BLOCK_US, broadcast_keys: int | None = None) -> DataFrame:
    """(left_table, left_key, t, rid, distance): of each left row the nearest right row of its entity.

    left: left_table, left_key, entity, t, tol (microseconds); right: entity, t, rid. The tolerance is inclusive; before
    or after count alike; at equal distance the smallest rid wins. Rows with a null entity, time or id never pair; equal left
    rows give one row; an empty side gives no rows.

    Entities are cut into time blocks, so that no entity, however hot, becomes one task; a left row goes to every block
    its tolerance touches. Right rows of blocks without left rows are dropped before the shuffle when the blocks in use
    are few enough to broadcast (by bytes, or broadcast_keys rows; counted first); else all right rows are shuffled, as narrow rows. Equal left rows, and
    right rows of one instant, become one before that, so that copies never pile up in a block.
    """
    lo, hi = (F.floor((F.col("t") + s * F.col("tol")) / block_us).cast("long") for s in (-1, 1))
    lefts = (
        left.select("left_table", F.col("left_key").cast("string").alias("left_key"), "entity", F.col("t").cast("long").alias("t"), F.col("tol").cast("long").alias("tol"))
        .where("entity is not null and t is not null and tol >= 0")
        .select("left_table", "left_key", "entity", "t", "tol", F.explode(F.sequence(lo, hi)).alias("block"))
    )
    rights = right.select("entity", F.col("t").cast("long").alias("t"), F.col("rid").cast("long").alias("rid")).where("entity is not null and t is not null and rid is not null").withColumn("block", F.floor(F.col("t") / block_us).cast("long"))
    lefts = lefts.distinct()
    used = lefts.select("entity", "block").distinct()
    if fits_broadcast(used, broadcast_keys):
        rights = rights.join(F.broadcast(used), ["entity", "block"], "left_semi")
    rights = rights.groupBy("entity", "block", "t").agg(F.min("rid").alias("rid"))
    columns = ["entity", "block", "t", "kind", "rid", "tol", "left_table", "left_key"]
    both = (
        rights.select("entity", "block", "t", F.lit(0).alias("kind"), "rid", F.lit(0).cast("long").alias("tol"), F.lit(None).cast("string").alias("left_table"), F.lit(None).cast("string").alias("left_key"))
        .unionByName(lefts.select("entity", "block", "t", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("rid"), "tol", "left_table", "left_key"))
        .select(*columns)
        .repartition("entity", "block")
        .sortWithinPartitions("entity", "block", "t", "kind", "rid")
    )
    pairs = both.mapInArrow(_merge, "left_table string, left_key string, t long, rid long, distance long")
    best = pairs.groupBy("left_table", "left_key", "t").agg(F.min(F.struct("distance", "rid")).alias("m"))
    return best.select("left_table", "left_key", "t", F.col("m.rid").alias("rid"), F.col("m.distance").alias("distance"))
