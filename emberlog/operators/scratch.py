"""Written intermediate tables, in the shared folder that the session names in spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a local master may do without, and gets one under /tmp."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="emberlog-ops-", dir="/tmp"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def remove_local(path: str) -> None:
    """At the driver's end its tables go; a store that isn't mounted is left to the cluster's own cleaning."""
    if path.startswith(("file:", "/")):
        shutil.rmtree("/" + path.removeprefix("file:").lstrip("/"), ignore_errors=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written and read again: its plan is cut and its rows no longer move between partitions."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(remove_local, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of the versions v1, v2, ... of a table below folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(path)]
    return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit())


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
