"""Datasets with identity: content-addressed writes, hash-chained records, idempotent appends."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from datetime import datetime, timezone
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.session import SharedFiles, written


def _digest(value: object) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, default=str).encode()).hexdigest()


def dataset_id(prefix: str, sources: list[str], config: dict) -> str:
    """An id that depends on what goes in only: the sources' ids and the configuration."""
    return f"{prefix}-{_digest({'sources': sorted(sources), 'config': config})[:16]}"


def publish(build: Callable[[], DataFrame], root: str | Path, prefix: str, sources: list[str], config: dict, partition_by: list[str] | None = None, **flags: object) -> dict:
    """Writes a dataset under its id and returns its manifest; an existing one is returned unbuilt.

    Data goes to <id>.partial and is renamed when whole; a failure leaves nothing behind. flags (such as labels_included) go into the manifest. The root may be
    on any file system of the session.
    """
    name = dataset_id(prefix, sources, config)
    spark = SparkSession.active()
    files, home, staging = SharedFiles(spark), f"{root}/{name}", f"{root}/{name}.partial"
    if files.exists(f"{home}/manifest.json"):
        return json.loads(files.read(f"{home}/manifest.json"))
    files.delete(staging)
    try:
        df = build()
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{staging}/data")
        rows = spark.read.parquet(f"{staging}/data").count()
        manifest = {"dataset_id": name, "sources": sorted(sources), "config": config, "columns": df.columns, "rows": rows, "data": "data", **flags}
        files.write(f"{staging}/manifest.json", json.dumps(manifest, indent=2, sort_keys=True, default=str).encode())
        files.rename(staging, home)
        return manifest
    except BaseException:
        files.delete(staging)
        raise


def publish_episodes(features: Callable[[], DataFrame], labels: Callable[[], DataFrame], root: str | Path, sources: list[str], config: dict) -> tuple[dict, dict]:
    """Features and labels of episodes as two datasets, so that what is known at the time and what comes after never share a file."""
    return publish(features, root, "episode-features", sources, config, labels_included=False), publish(labels, root, "episode-labels", sources, config, labels_included=True)


def publish_outcomes(build: Callable[[int], DataFrame], horizons: list[int], root: str | Path, sources: list[str], config: dict) -> dict:
    """Outcomes of several horizons as one dataset with a folder per horizon_s."""

    def whole() -> DataFrame:
        parts = [build(h).withColumn("horizon_s", F.lit(h)) for h in horizons]
        return reduce(DataFrame.unionByName, parts)

    return publish(whole, root, "outcomes", sources, config | {"horizons": horizons}, ["horizon_s"], labels_included=True)


def open_dataset(spark: SparkSession, root: str | Path, manifest: dict, **required: object) -> DataFrame:
    """The data of a manifest, after its flags are as required; a path that leaves the dataset's folder is refused."""
    for flag, value in required.items():
        if manifest.get(flag) != value:
            raise ValueError(f"{manifest['dataset_id']}: {flag} must be {value}")
    if ".." in Path(manifest["data"]).parts or Path(manifest["data"]).is_absolute():
        raise ValueError("dataset path leaves its folder")
    return spark.read.parquet(f"{root}/{manifest['dataset_id']}/{manifest['data']}")


def archive_payload(spark: SparkSession, root: str | Path, source: str, received_us: int, payload: bytes) -> str:
    """A raw payload under its day and hash, with a manifest beside it; the same payload again changes nothing."""
    digest = hashlib.sha256(payload).hexdigest()
    day = datetime.fromtimestamp(received_us / 1e6, timezone.utc).strftime("%Y/%m/%d")
    path, files = f"{root}/{source}/{day}/{digest[:16]}.json", SharedFiles(spark)
    if not files.exists(f"{path}.manifest"):
        files.write(path, payload)
        files.write(f"{path}.manifest", json.dumps({"source": source, "received_us": received_us, "sha256": digest, "bytes": len(payload)}, sort_keys=True).encode())
    return path


def prunable(snapshots: DataFrame) -> DataFrame:
    """snapshots (name, path, rows, size) with keep: of each name the one with most rows, then the largest, then the last path. What isn't kept may go."""
    best = snapshots.groupBy("name").agg(F.max(F.struct("rows", "size", "path")).alias("_b")).select("name", F.col("_b.path").alias("_p"))
    return snapshots.join(best, "name").withColumn("keep", F.col("path") == F.col("_p")).drop("_p")


class Registry:
    """An append-only JSON-lines file whose records each carry the hash of the one before."""

    def __init__(self, path: str | Path) -> None:
        self.path = Path(path)

    def records(self) -> list[dict]:
        """All records, after the chain is verified."""
        lines = self.path.read_text().splitlines() if self.path.exists() else []
        out, last = [], None
        for i, line in enumerate(lines, 1):
            record = json.loads(line)
            body = {k: v for k, v in record.items() if k != "record_hash"}
            if record["sequence"] != i or record["previous_hash"] != last or record["record_hash"] != _digest(body):
                raise ValueError(f"record {i} breaks the chain")
            last = record["record_hash"]
            out.append(record)
        return out

    def register(self, report_id: str, family: str, datasets: list[str], hypotheses: int, alpha: float = 0.05) -> dict:
        """Appends a record with its share of the family-wise error; a known report is returned as it is."""
        if hypotheses <= 0 or not 0 < alpha < 1:
            raise ValueError("hypotheses must be positive and alpha between zero and one")
        known = self.records()
        for record in known:
            if record["report_id"] == report_id:
                return record
        body = {
            "sequence": len(known) + 1, "recorded_at": datetime.now(timezone.utc).isoformat(), "report_id": report_id, "family": family, "datasets": datasets,
            "hypotheses": hypotheses, "alpha": alpha, "alpha_each": alpha / hypotheses, "previous_hash": known[-1]["record_hash"] if known else None,
        }
        record = body | {"record_hash": _digest(body)}
        self.path.parent.mkdir(parents=True, exist_ok=True)
        with self.path.open("a") as f:
            f.write(json.dumps(record, sort_keys=True) + "\n")
        return record


def append_new(batch: DataFrame, path: str, keys: list[str], day: str | None = None) -> int:
    """Appends the rows whose keys the table doesn't hold yet, one per key; returns how many. Safe to repeat with the same batch, for one writer at a time.

    With day (a column that goes with the keys, such as the event's date) the table is partitioned by it and only the days of the batch are read. Null keys equal each other.
    """
    spark = batch.sparkSession
    fresh = batch.dropDuplicates(keys)
    if SharedFiles(spark).exists(path):
        known = spark.read.parquet(path)
        if day:
            days = [r[0] for r in batch.select(day).distinct().limit(367).collect()]
            known = known.where(F.col(day).isin(days)) if len(days) <= 366 and None not in days else known
        on = [F.col(f"f.{k}").eqNullSafe(F.col(f"k.{k}")) for k in keys]
        fresh = fresh.alias("f").join(known.select(*keys).alias("k"), on, "left_anti")
    fresh = written(fresh)
    n = fresh.count()
    if n:
        writer = fresh.write.mode("append")
        (writer.partitionBy(day) if day else writer).parquet(path)
    return n


def invalidate(signals: DataFrame, events: str, reason: str) -> int:
    """Appends an invalidation for each signal id that has none; nothing is ever deleted. A blank reason raises. Returns how many were new."""
    if not reason.strip():
        raise ValueError("an invalidation needs a reason")
    return append_new(signals.select("signal_id").withColumn("reason", F.lit(reason.strip())), events, ["signal_id"])


def standing(signals: DataFrame, events: str) -> DataFrame:
    """The signals without an invalidation."""
    spark = signals.sparkSession
    return signals.join(spark.read.parquet(events).select("signal_id").distinct(), "signal_id", "left_anti") if SharedFiles(spark).exists(events) else signals


def health(rows: DataFrame, keys: list[str], t: str, now_us: int, stale_s: int = 120) -> DataFrame:
    """(keys, rows, latest_us, age_s, status) of a feed: its last row's age against now, stale beyond stale_s, empty without any time."""
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.max(t).alias("latest_us"))
    age = F.greatest((F.lit(now_us) - F.col("latest_us")) / 1_000_000, F.lit(0.0))
    return out.select(*keys, "rows", "latest_us", age.alias("age_s"), F.when(F.col("latest_us").isNull(), "empty").when(age > stale_s, "stale").otherwise("healthy").alias("status"))


def write_report(report: dict, root: str | Path, name: str) -> Path:
    """A JSON report beside its own hash."""
    path = Path(root) / f"{name}.json"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(report | {"artifact_sha256": _digest(report)}, indent=2, sort_keys=True, default=str))
    return path
