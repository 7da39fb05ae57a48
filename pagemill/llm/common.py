"""Helpers that the operators share: tables, shared folder, lineage cuts, word hashes."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of ``documents``, as a Java and DuckDB pattern; ``bytes.split()`` cuts at the same six characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows and bytes of one Arrow batch: bounds what a Python worker holds of whole texts at once.
BATCH_ROWS, BATCH_BYTES = 4096, 4 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches and make sure that checkpoints go to a shared folder."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    shared_folder(spark)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a scratch folder only for a local session that names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="llm-ckpt-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once and read it from there: later steps don't depend on executors' disks."""
    prepare(df.sparkSession)
    return df.checkpoint()


class Stored:
    """A DataFrame written as Parquet to the shared folder; ``read`` reads it, ``drop`` deletes the files."""

    def __init__(self, df: DataFrame):
        self.spark = prepare(df.sparkSession)
        self.path = f"{shared_folder(self.spark).rstrip('/')}/llm-{uuid.uuid4()}"
        df.write.parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, most: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` rows; else as it is, for a shuffle join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def crc32_mod(column: str, n: int):
    """crc32 of a column as text, mod ``n``: the folds of the classifiers (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finisher on uint64: every output bit depends on every input bit."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def lean(run):
    """``run`` for mapInArrow, after which the worker gives freed memory back: workers live on for later tasks."""
    def wrapped(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass
    return wrapped


class Memo(dict):
    """A bounded cache of a pure function: it starts anew when it is full, so results never depend on it."""

    def __init__(self, make, most: int = 400_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        self[key] = value = self.make(key)
        return value
