"""Session building, table loading and lineage cutting shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(cpus: int | str = "*", app: str = "tickloom", **conf: str) -> SparkSession:
    """A local session with the settings the operators are tuned for; a cluster's own session works as well."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.parquet.compression.codec": "zstd",
        "spark.ui.enabled": "false",
    }
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    return builder.config(map=base | conf).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per context, so that their Python workers find it wherever the driver runs."""
    sc = spark.sparkContext
    if getattr(sc, "_tickloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="tickloom-code-")) / "tickloom_code.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._tickloom_shipped = True


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written tables.

    A folder already named by the cluster (spark.checkpoint.dir or setCheckpointDir) is used as it is. Only a local
    master, where driver and executors are one machine, gets a temporary folder; elsewhere a missing setting is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tickloom-checkpoint-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder, its lineage cut there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


class SharedFiles:
    """Small files of any file system the session knows, by the Hadoop API: what a local path is for one machine, these are for a cluster."""

    def __init__(self, spark: SparkSession) -> None:
        self.sc = spark.sparkContext

    def _at(self, path: str | Path):
        p = self.sc._jvm.org.apache.hadoop.fs.Path(str(path))
        return p.getFileSystem(self.sc._jsc.hadoopConfiguration()), p

    def exists(self, path: str | Path) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def read(self, path: str | Path) -> bytes:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(self.sc._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write(self, path: str | Path, data: bytes) -> None:
        """Writes beside the path and renames, so that readers see the old or the new file."""
        fs, p = self._at(path)
        draft = self._at(f"{path}.{uuid.uuid4().hex}.partial")[1]
        stream = fs.create(draft, True)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()
        fs.delete(p, False)
        if not fs.rename(draft, p):
            raise OSError(f"could not write {path}")

    def rename(self, old: str | Path, new: str | Path) -> None:
        (fs, a), (_, b) = self._at(old), self._at(new)
        fs.mkdirs(b.getParent())
        if not fs.rename(a, b):
            raise OSError(f"could not rename {old}")

    def delete(self, path: str | Path) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)


def us(column: str | Column) -> Column:
    """Microseconds since the epoch of a timestamp column, with or without time zone."""
    return F.unix_micros((F.col(column) if isinstance(column, str) else column).cast("timestamp"))


def held(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once per row.

    The optimizer copies an expression to each place that uses it, filters among them. A generator in between keeps costly ones single.
    """
    return df.withColumn("_held", F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))).select("*", "_held.*").drop("_held")


# What a table may take on every executor and the driver to be broadcast.
BROADCAST_BYTES = 32 << 20


def row_bytes(df: DataFrame) -> int:
    """What a row of df takes in a broadcast table, at most, if its texts are short: a fixed overhead, 8 bytes a number, 48 a text, 16 fields' worth an array."""
    size = {"string": 48, "binary": 48, "array": 128, "struct": 128, "map": 128}
    return 48 + sum(size.get(f.dataType.typeName(), 8) for f in df.schema.fields)


def fits_broadcast(df: DataFrame, rows: int | None = None) -> bool:
    """Whether df takes at most BROADCAST_BYTES (or has at most `rows` rows), found without reading much more than that."""
    bound = BROADCAST_BYTES // row_bytes(df) if rows is None else rows
    return df.limit(bound + 1).count() <= bound


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: lineage cut as by cut(), but in columns and compressed."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def data_dir(scale: str) -> str:
    return os.path.join(os.environ.get("TICKLOOM_DATA", "/root/testdata"), scale)
