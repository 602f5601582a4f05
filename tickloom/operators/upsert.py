"""One copy of each message: idempotent upsert by identifier and the compaction that collapses equal identifiers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from tickloom.session import cut, ensure_checkpoint_dir, fits_broadcast, ship


def sequence_pair(column: str) -> Column:
    """The two numbers of 'batch:number' as struct(b, n), whatever the padding; null when it isn't such a text."""
    shape = r"^\s*0*(\d{1,18})\s*:\s*0*(\d{1,18})\s*$"
    ok = F.col(column).rlike(shape)
    return F.when(ok, F.struct(*[F.regexp_extract(column, shape, i).cast("long").alias(k) for i, k in ((1, "b"), (2, "n"))]))


def canonical_uuid(column: str) -> Column:
    """A UUID's 32 digits in lower case, from any of its usual spellings; other non-blank texts as they are, trimmed and in lower case; blank as null."""
    text = F.lower(F.regexp_replace(column, r"^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+$", ""))
    digits = F.regexp_replace(F.regexp_replace(text, "^urn:uuid:", ""), r"[{}\-]", "")
    return F.when(digits.rlike("^[0-9a-f]{32}$"), digits).when(text != "", text)


def canonical_key(column: str) -> Column:
    """A key without case and surrounding white space; blank as null."""
    text = F.lower(F.regexp_replace(column, r"^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+$", ""))
    return F.when(text != "", text)


def collapse(rows: DataFrame, keys: list[str], received: str, row_key: str) -> DataFrame:
    """(keys, keep, copies): of each identifier the row that stays - the earliest received, then the smallest row_key.

    One hash aggregation, for when the rows to drop aren't asked for. Null received comes last.
    """
    order = F.struct(F.col(received).isNull().alias("late"), F.col(received).alias("r"), F.col(row_key).alias("k"))
    return rows.groupBy(*keys).agg(F.min(order).alias("m"), F.count(F.lit(1)).alias("copies")).select(*keys, F.col("m.k").alias("keep"), "copies")


def superseded(rows: DataFrame, keys: list[str], received: str, row_key: str) -> DataFrame:
    """The rows that do not stay, with keys, received and row_key: rows go into a bucket store as one batch, and its compaction names what it drops."""
    spark = rows.sparkSession
    store = BucketStore(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/store-{uuid.uuid4().hex}", keys, received, row_key)
    store.upsert(rows.select(*dict.fromkeys([*keys, received, row_key])).dropna(subset=keys), 0)
    return store.dropped()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(v, root): the connected component of each vertex of edges(a, b), named by its smallest vertex.

    Alternates large-star and small-star steps until nothing changes, logarithmically many rounds for chains.
    Minima are grouped with partial aggregation and joined back, so no neighbourhood is ever collected; each round is written to the
    shared checkpoint folder. Nulls and loops add nothing.
    """
    edges = cut(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        edges = cut(small.where("a <> b").distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("root"))


def linked_messages(rows: DataFrame, first: str, second: str) -> DataFrame:
    """rows with a column message: equal for rows that share `first` or `second`, directly or through other rows.

    Rows with both null have a null message. Only identifiers that meet more than one partner enter the component search;
    where one first goes with one second, the first names the message.
    """
    pairs = rows.where(F.col(first).isNotNull() & F.col(second).isNotNull()).select(F.concat(F.lit("1"), first).alias("a"), F.concat(F.lit("2"), second).alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    a_many = pairs.groupBy("a").count().where("count > 1").select("a")
    b_many = pairs.groupBy("b").count().where("count > 1").select("b")
    hard = pairs.join(a_many, "a", "left_semi").unionByName(pairs.join(b_many, "b", "left_semi").select("a", "b", "n")).select("a", "b").distinct()
    hard = cut(hard)
    # an identifier with one partner may hang on a partner with many: it is then in hard by way of that partner
    roots = components(hard) if not hard.isEmpty() else hard.select(F.col("a").alias("v"), F.col("b").alias("root"))
    roots = cut(roots.unionByName(roots.select(F.col("root").alias("v"), "root")).distinct())
    lone = rows.where(F.col(first).isNull() & F.col(second).isNotNull())
    named = rows.where(F.col(first).isNotNull()).withColumn("_v", F.concat(F.lit("1"), first))
    partner = pairs.groupBy(F.col("b").alias("_b")).agg(F.min("a").alias("_a"))
    lone = lone.withColumn("_b", F.concat(F.lit("2"), second)).join(partner, "_b", "left").withColumn("_v", F.coalesce("_a", "_b")).drop("_a", "_b")
    linked = _with_roots(named.unionByName(lone), roots.withColumnRenamed("v", "_v")).withColumn("message", F.coalesce("root", "_v")).drop("_v", "root")
    none = rows.where(F.col(first).isNull() & F.col(second).isNull()).withColumn("message", F.lit(None).cast("string"))
    return linked.unionByName(none)


def _with_roots(rows: DataFrame, roots: DataFrame, hot: int = 100_000) -> DataFrame:
    """rows with the root of their vertex _v. Vertices with more than `hot` rows never meet in one task: their few roots are broadcast."""
    if fits_broadcast(roots):
        return rows.join(F.broadcast(roots), "_v", "left")
    many = cut(rows.groupBy("_v").agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > hot).select("_v"))
    few = roots.join(F.broadcast(many), "_v", "left_semi")
    crowded = rows.join(F.broadcast(many), "_v", "left_semi").join(F.broadcast(few), "_v", "left")
    return crowded.unionByName(rows.join(F.broadcast(many), "_v", "left_anti").join(roots, "_v", "left"))


class BucketStore:
    """Messages under a path as runs of hash buckets sorted by identifier; equal identifiers collapse on compaction.

    A run is named by its batch: writing a batch again replaces its run, so redelivery of a whole batch changes nothing. Each task of an upsert
    sorts its rows by bucket, identifier, received (null last) and row_key and walks through them once: the first row of an identifier stays, the
    others are marked lost. So a run's file holds at most one standing row per identifier, and a hot identifier costs the merge one row per file.
    The merge brings the standing rows of all runs together by bucket and identifier, in the same order, and walks through them once more: the
    first stays, the rest is lost. No rows are joined back, as both walks say what they drop. Rows with a null identifier always stand.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], received: str, row_key: str, buckets: int = 64) -> None:
        self.spark, self.path, self.keys, self.received, self.row_key, self.buckets = spark, path.rstrip("/"), keys, received, row_key, buckets

    def _order(self) -> list[Column]:
        return [F.col("_bucket"), *[F.col(k) for k in self.keys], F.col(self.received).asc_nulls_last(), F.col(self.row_key)]

    def upsert(self, batch: DataFrame, batch_id: int | str) -> None:
        keys = self.keys
        ship(self.spark)

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last = None
            for b in batches:
                if not b.num_rows:
                    continue
                table = pa.Table.from_batches([b]).select(keys)
                ahead = pa.concat_tables([last, table]) if last is not None else table
                columns = [c.combine_chunks() for c in ahead.columns]
                same = np.ones(ahead.num_rows - 1, bool)
                for c in columns:
                    same &= pc.fill_null(pc.equal(c.slice(1), c.slice(0, len(c) - 1)), False).to_numpy(zero_copy_only=False)
                lost = same if last is not None else np.concatenate([[False], same])
                last = table.slice(table.num_rows - 1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lost)], names=[*b.schema.names, "_lost"])

        bucket = F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int")
        ordered = batch.withColumn("_bucket", bucket).sortWithinPartitions(*self._order())
        schema = StructType([*ordered.schema.fields, StructField("_lost", BooleanType())])
        ordered.mapInArrow(walk, schema).write.mode("overwrite").parquet(f"{self.path}/run={batch_id}")

    def _runs(self) -> DataFrame:
        return self.spark.read.option("basePath", self.path).parquet(f"{self.path}/run=*").drop("run")

    def _merged(self) -> DataFrame:
        """The standing rows of all runs with their place among those of their identifier."""
        w = Window.partitionBy("_bucket", *self.keys).orderBy(F.col(self.received).asc_nulls_last(), self.row_key)
        return self._runs().where("not _lost").dropna(subset=self.keys).withColumn("_place", F.row_number().over(w))

    def dropped(self) -> DataFrame:
        """The rows that are lost, in a run or against another one."""
        return self._runs().where("_lost").drop("_bucket", "_lost").unionByName(self._merged().where("_place > 1").drop("_bucket", "_lost", "_place"))

    def read(self) -> DataFrame:
        """One row per identifier, also before compaction, and the rows without one."""
        nulls = self._runs().where(" or ".join(f"`{k}` is null" for k in self.keys))
        return self._merged().where("_place = 1").drop("_bucket", "_lost", "_place").unionByName(nulls.drop("_bucket", "_lost"))

    def compact(self, to: str) -> "BucketStore":
        """A new store at another path with one run that holds one row per identifier; the old one stays until it is deleted."""
        new = BucketStore(self.spark, to, self.keys, self.received, self.row_key, self.buckets)
        new.upsert(self.read(), 0)
        return new
