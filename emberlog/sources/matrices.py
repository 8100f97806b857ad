"""Matrix files and archive members as Spark data sources.

``npy``: a two-dimensional .npy file, or a folder of parts, each with a file of keys beside it.
A file is read in ranges of rows, by seeking: a row's place follows from the header and the
row's size. ``zip_lines``: the text lines of an archive's members, one partition for each
member. Files are opened through pyarrow's file systems, where the tasks run.
"""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Rows of a partition, and of a batch within it.
SPLIT_BYTES, BATCH_ROWS = 64 << 20, 10_000


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path of a URI, or of a local path."""
    return fs.FileSystem.from_uri(uri if ":" in uri.split("/")[0] else f"file://{uri}")


def header_of(store: fs.FileSystem, path: str) -> tuple[tuple[int, ...], np.dtype, int]:
    """Shape, type and the data's offset of a .npy file in row order."""
    with store.open_input_file(path) as f:
        head = io.BytesIO(f.read(min(f.size(), 1 << 16)))
    version = np.lib.format.read_magic(head)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, fortran, dtype = read(head)
    if fortran and len(shape) > 1:
        raise ValueError(f"{path} is in column order")
    if dtype.hasobject:
        raise ValueError(f"{path} holds objects")
    return shape, dtype, head.tell()


def rows_of(store: fs.FileSystem, path: str, first: int, last: int) -> np.ndarray:
    shape, dtype, offset = header_of(store, path)
    width = dtype.itemsize * int(np.prod(shape[1:], dtype=np.int64))
    with store.open_input_file(path) as f:
        raw = f.read_at((last - first) * width, offset + first * width)
    return np.frombuffer(raw, dtype).reshape(last - first, *shape[1:])


@dataclass
class RowRange(InputPartition):
    path: str
    keys: str | None
    first: int
    last: int


class NpyReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.uri = options["path"]
        self.columns = [int(c) for c in options["columns"].split(",")] if options.get("columns") else None
        self.stride = int(options.get("stride", 0))

    def partitions(self) -> list[RowRange]:
        store, path = opened(self.uri)
        if store.get_file_info(path).type == fs.FileType.Directory:
            names = sorted(i.path for i in store.get_file_info(fs.FileSelector(path)) if i.base_name.startswith("features-"))
            files = [(n, n.replace("/features-", "/keys-")) for n in names]
        else:
            files = [(path, None)]
        out = []
        for name, keys in files:
            shape, dtype, _ = header_of(store, name)
            if len(shape) != 2:
                raise ValueError(f"{name} has {len(shape)} dimensions")
            if self.columns and max(self.columns) >= shape[1]:
                raise ValueError(f"{name} has {shape[1]} columns")
            if keys and header_of(store, keys)[0] != (shape[0],):
                raise ValueError(f"{keys} has other rows than {name}")
            step = self.stride or max(1, SPLIT_BYTES // max(1, dtype.itemsize * shape[1]))
            out += [RowRange(name, keys, a, min(a + step, shape[0])) for a in range(0, shape[0], step)]
        return out

    def read(self, partition: RowRange | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's one partition of nothing
            return
        store, _ = opened(self.uri)
        for a in range(partition.first, partition.last, BATCH_ROWS):
            b = min(a + BATCH_ROWS, partition.last)
            x = rows_of(store, partition.path, a, b).astype(np.float64)
            x = x[:, self.columns] if self.columns else x
            keys = rows_of(store, partition.keys, a, b).astype(np.int64) if partition.keys else np.arange(a, b)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(keys), lists], names=["key", "features"])


@dataclass
class PartWritten(WriterCommitMessage):
    name: str | None


class NpyWriter(DataSourceArrowWriter):
    """A part for each task, written aside and renamed when all tasks are done."""

    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.uri, self.overwrite, self.run = options["path"], overwrite, uuid.uuid4().hex[:8]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> PartWritten:
        batches = [b for b in iterator if b.num_rows]
        if not batches:
            return PartWritten(None)
        table = pa.Table.from_batches(batches)
        keys = table.column("key").to_numpy().astype(np.int64)
        widths = {len(v) for v in table.column("features")}
        if len(widths) > 1:
            raise ValueError("rows of different widths are no matrix")
        x = table.column("features").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(keys), -1)
        store, path = opened(self.uri)
        store.create_dir(path, recursive=True)
        name = f"{self.run}-{uuid.uuid4().hex[:12]}"
        for kind, values in (("features", x), ("keys", keys)):
            held = io.BytesIO()
            np.save(held, values)
            with store.open_output_stream(f"{path}/.{kind}-{name}.npy") as f:
                f.write(held.getvalue())
        return PartWritten(name)

    def commit(self, messages: list[PartWritten | None]) -> None:
        store, path = opened(self.uri)
        store.create_dir(path, recursive=True)
        done = {m.name for m in messages if m and m.name}
        for i in store.get_file_info(fs.FileSelector(path)):
            own = i.base_name.startswith((".features-" + self.run, ".keys-" + self.run))
            if own and i.base_name.split("-", 1)[1].removesuffix(".npy") in done:
                continue
            if own or self.overwrite:  # parts of tasks that were run again, or of an earlier table
                store.delete_file(i.path)
        for name in sorted(done):
            for kind in ("keys", "features"):
                store.move(f"{path}/.{kind}-{name}.npy", f"{path}/{kind}-{name}.npy")

    def abort(self, messages: list[PartWritten | None]) -> None:
        store, path = opened(self.uri)
        for m in messages:
            for kind in ("keys", "features") if m and m.name else ():
                store.delete_file(f"{path}/.{kind}-{m.name}.npy")


class NpySource(DataSource):
    """key long, features array<double>. Options: columns (numbers, comma-joined), stride (rows of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "key long, features array<double>"

    def reader(self, schema: StructType) -> NpyReader:
        return NpyReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> NpyWriter:
        return NpyWriter(dict(self.options), overwrite)


@dataclass
class Member(InputPartition):
    member: str


class ZipReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.uri = options["path"]
        self.members = [m for m in options.get("members", "").split(",") if m]

    def partitions(self) -> list[Member]:
        store, path = opened(self.uri)
        with store.open_input_file(path) as f, zipfile.ZipFile(f) as z:
            there = [i.filename for i in z.infolist() if not i.is_dir()]
        if missing := sorted(set(self.members) - set(there)):
            raise FileNotFoundError(f"{self.uri} has no member {', '.join(missing)}")
        return [Member(m) for m in self.members or there]

    def read(self, partition: Member | None) -> Iterator[tuple]:
        if partition is None:
            return
        store, path = opened(self.uri)
        with store.open_input_file(path) as f, zipfile.ZipFile(f) as z, z.open(partition.member) as raw:
            for k, line in enumerate(io.TextIOWrapper(raw, "utf-8", errors="replace", newline="\n")):
                yield partition.member, k, line.rstrip("\n").removesuffix("\r")


class ZipLinesSource(DataSource):
    """member string, line_no long, line string. Option members: names, comma-joined; one that is missing is an error."""

    @classmethod
    def name(cls) -> str:
        return "zip_lines"

    def schema(self) -> str:
        return "member string, line_no long, line string"

    def reader(self, schema: StructType) -> ZipReader:
        return ZipReader(dict(self.options))


def registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(NpySource)
    spark.dataSource.register(ZipLinesSource)
    return spark


def read_matrix(spark: SparkSession, path: str, columns: list[int] | None = None, stride: int | None = None) -> DataFrame:
    reader = registered(spark).read.format("npy")
    if columns:
        reader = reader.option("columns", ",".join(map(str, columns)))
    return (reader.option("stride", str(stride)) if stride else reader).load(path)


def write_matrix(rows: DataFrame, key: str, path: str, features: str = "features") -> None:
    """A folder of parts with their keys; what was there is replaced."""
    registered(rows.sparkSession)
    rows.select(F.col(key).cast("long").alias("key"), F.col(features).cast("array<double>").alias("features")).write.format("npy").mode("overwrite").save(path)


def zip_lines(spark: SparkSession, path: str, members: list[str] | None = None) -> DataFrame:
    reader = registered(spark).read.format("zip_lines")
    return (reader.option("members", ",".join(members)) if members else reader).load(path)
