"""Scratch tables and small helpers shared by the training-data operators.

Intermediate tables are cut from their lineage by writing them to the shared
folder that the session names in ``spark.checkpoint.dir``. A lost executor then
only costs the tasks that read the table, never the stages that made it.
"""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a local master may do without, and gets one under /tmp."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="emberlog-", dir="/tmp"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return f"file://{_local[0]}"


def remove_local(path: str) -> None:
    """At the driver's end its tables go; a store that isn't mounted is left to the cluster's own cleaning."""
    if path.startswith(("file:", "/")):
        shutil.rmtree("/" + path.removeprefix("file:").lstrip("/"), ignore_errors=True)


class Scratch:
    """Tables of one run in a folder of its own below the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(remove_local, self.root)
        self._n = 0

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def save(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        """Write and read again; with ``partition_by`` the folder is split by that column."""
        path = self.path(name)
        writer = df.write.partitionBy(partition_by) if partition_by else df.write
        writer.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for t in tables:
            p = jvm.org.apache.hadoop.fs.Path(t.scratch_path)
            p.getFileSystem(conf).delete(p, True)


def release_memory() -> None:
    """Give freed memory back at the end of a task, as an executor's idle Python workers stay."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def unused_name(name: str, *frames: DataFrame) -> str:
    """A column name that none of the tables has, in any case."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else; texts of ASCII alone take the fast path."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_train(doc_id: Column) -> Column:
    """Rows that a classifier may learn from: crc32 of the id as text, modulo 4, is not 2."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 != 2
