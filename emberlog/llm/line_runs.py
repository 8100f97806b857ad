"""Line deduplication over levelled sorted runs of line hashes (DataFrame operations only).

A *run* is a table of line hashes that were first seen in one batch, in buckets by hash
and sorted by hash within a bucket. A new batch, which has the same buckets and order, is
merge-anti-joined with one run after the other; nothing is shuffled or sorted for that.
Hashes that no run holds form the batch's own run on level 0; the others are the batch's
increments, kept in levels of their own. When a level has ``fanout`` tables they are merged
bucket by bucket (a full outer merge join) into one a level higher, so a batch meets
O(log batches) runs. Hashes of different runs are disjoint. Every hash carries the number
of documents that hold the line and the largest doc_id among them; both are additive over
batches because a document belongs to one batch.

Defined results of edge cases: a null or empty text is one empty line; a null doc_id
is one document of its own that sorts below every other; rows that repeat a doc_id
count as one document and lose the same lines; with no input there is no output;
columns of the input stay, but for those named like an output, which are replaced.
"""

from __future__ import annotations

import math
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_SPACE, Scratch, ascii_lower, shuffle_partitions, unused_name

KEY = ["h1", "h2"]
#: Hashes of a bucket, about.
BUCKET_ROWS = 1_000_000


@contextmanager
def bucket_order(spark: SparkSession):
    """Spark trusts the order within buckets of one file, as those of runs are."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Buckets:
    """Tables of hashes with one number of buckets, sorted by hash, in the scratch folder."""

    def __init__(self, spark: SparkSession, scratch: Scratch, n: int):
        self.spark, self.scratch, self.n = spark, scratch, n

    def save(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        path = self.scratch.path(name)
        table = "_".join(path.replace("-", "_").split("/")[-2:])
        writer = df.write.format("parquet").option("path", path).bucketBy(self.n, *KEY).sortBy(*KEY)
        with bucket_order(self.spark):
            (writer.partitionBy(partition_by) if partition_by else writer).saveAsTable(table)
        out = self.spark.table(table)
        out.bucket_table = table
        out.scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {t.bucket_table}")
        self.scratch.drop(*tables)


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two sorted tables of hashes to one; counts are added."""
    b = b.select(*KEY, F.col("n").alias("n_b"), F.col("last").alias("last_b")).hint("merge")
    both = a.join(b, KEY, "full_outer")
    return both.select(*KEY, (F.coalesce("n", F.lit(0)) + F.coalesce("n_b", F.lit(0))).alias("n"), F.greatest("last", "last_b").alias("last"))


class Levels:
    """Tables by level; as soon as a level has ``fanout`` of them they become one of the next level."""

    def __init__(self, buckets: Buckets, fanout: int, name: str):
        self.buckets, self.fanout, self.name = buckets, fanout, name
        self.levels: list[list[DataFrame]] = []

    def tables(self) -> list[DataFrame]:
        return [t for level in self.levels for t in level]

    def add(self, table: DataFrame, level: int = 0) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        held = self.levels[level]
        held.append(table)
        if len(held) >= self.fanout:
            whole = self.buckets.save(reduce(merged, held), self.name)
            self.levels[level] = []
            self.buckets.drop(*(t for t in held if not getattr(t, "is_batch", False)))
            self.add(whole, level + 1)


class LineRuns:
    """The runs, and the increments of hashes seen before."""

    def __init__(self, buckets: Buckets, fanout: int = 2):
        self.buckets = buckets
        self.runs, self.again = Levels(buckets, fanout, "run"), Levels(buckets, fanout, "again")

    def fresh(self, batch: DataFrame) -> DataFrame:
        """The batch's hashes that no run holds."""
        return reduce(lambda left, run: left.join(run.select(*KEY).hint("merge"), KEY, "left_anti"), self.runs.tables(), batch)

    def add(self, batch: DataFrame) -> None:
        """batch: one row (hash, n, last) for each hash of the new batch, in buckets."""
        if not self.runs.tables():
            batch.is_batch = True
            self.runs.add(batch)
            return
        fresh = self.buckets.save(self.fresh(batch), "run")
        self.again.add(self.buckets.save(batch.join(fresh.select(*KEY).hint("merge"), KEY, "left_anti"), "again"))
        self.runs.add(fresh)

    def counts(self) -> DataFrame:
        """(hash, n, last) over all batches: a hash is in one run, and in increments."""

        def whole(run: DataFrame) -> DataFrame:
            for k, more in enumerate(self.again.tables()):
                run = run.join(more.select(*KEY, F.col("n").alias(f"n{k}"), F.col("last").alias(f"last{k}")).hint("merge"), KEY, "left")
                run = run.select(*KEY, (F.col("n") + F.coalesce(f"n{k}", F.lit(0))).alias("n"), F.greatest("last", f"last{k}").alias("last"))
            return run

        return reduce(DataFrame.union, map(whole, self.runs.tables()))


def _long_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc id, text hash, position, line hash) of the lines whose key is long enough."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = docs.select(
        F.col("doc_id").alias("doc"), F.xxhash64(text).alias("th"), F.posexplode(F.split(ascii_lower(text), "\n")).alias("pos", "line")
    )
    key = F.btrim("line", F.lit(ASCII_SPACE))
    return lines.withColumn("key", key).where(F.length("key") >= min_chars).select(
        "doc", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2")
    )


def dedup_lines(spark: SparkSession, docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 4, fanout: int = 2) -> DataFrame:
    """Drop long lines that ``min_docs`` documents or more hold, but for those in the largest doc_id.

    Adds n_lines, n_dropped and replaces text by the lines that stay.
    """
    scratch = Scratch(spark, "line-runs")
    lines = scratch.save(_long_lines(docs, min_chars), "lines")
    per_doc = lines.select(*KEY, "doc").distinct()
    batch = F.pmod(F.xxhash64("doc"), F.lit(batches)).cast("int").alias("batch")
    stats = per_doc.groupBy(*KEY, batch).agg(F.count("*").alias("n"), F.max("doc").alias("last"))
    buckets = Buckets(spark, scratch, max(shuffle_partitions(spark), math.ceil(lines.count() / BUCKET_ROWS)))
    stats = buckets.save(stats.repartition(buckets.n, *KEY), "batches", "batch")
    runs = LineRuns(buckets, fanout)
    for b in range(batches):
        runs.add(stats.where(F.col("batch") == b).select(*KEY, "n", "last"))
    # written, so that both sides of the join below are plain exchanges, which AQE splits where a line is very common
    with bucket_order(spark):
        common = scratch.save(runs.counts().where(F.col("n") >= min_docs).select(*KEY, "last"), "common")
    buckets.drop(stats, *(t for t in runs.runs.tables() + runs.again.tables() if hasattr(t, "bucket_table")))
    of_doc, of_text, own_text, drop = (unused_name(n, docs) for n in ("of_doc", "of_text", "own_text", "drop"))
    drops = (
        lines.join(common, KEY).where(~F.col("doc").eqNullSafe(F.col("last")))
        .groupBy(F.col("doc").alias(of_doc), F.col("th").alias(of_text)).agg(F.collect_set("pos").alias(drop))
    )
    text = F.coalesce(F.col("text"), F.lit(""))
    joined = docs.withColumn(own_text, F.xxhash64(text)).join(
        drops, F.col("doc_id").eqNullSafe(F.col(of_doc)) & (F.col(own_text) == F.col(of_text)), "left"
    )
    all_lines = F.split(text, "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col(drop))
    # an outer lambda holds the split lines, so that they aren't split again for each position
    kept_text = F.get(F.transform(F.array(all_lines), lambda ls: F.array_join(F.transform(kept, lambda p: F.get(ls, p)), "\n")), F.lit(0))
    return joined.withColumns({
        "n_lines": F.size(all_lines).cast("long"),
        "n_dropped": F.coalesce(F.size(drop), F.lit(0)).cast("long"),
        "text": F.when(F.col(drop).isNull(), F.col("text")).otherwise(kept_text),
    }).drop(own_text, of_doc, of_text, drop)
