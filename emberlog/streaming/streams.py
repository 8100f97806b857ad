"""The log operators on unbounded input, with Structured Streaming.

Windows and sessions by event time; rows later than the watermark are dropped, which the
batch operators don't do. Operators that depend on the rows' order are in ordered_streams.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scratch import remove_local, shared_folder


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream, with the columns of the canonical table."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    raw = spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet")
    return raw.select(
        F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("timestamp"), F.col("event_type").alias("event_id"), F.col("user_id").cast("string").alias("node"),
        (F.col("event_type") == "error").cast("int").alias("label"), F.coalesce("value", F.lit(0.0)).alias("score"),
    )


def tumbling_counts(stream: DataFrame, width: str, late: str = "1 hour", origin: str | None = None) -> DataFrame:
    """Events and alerts of each window; ``origin`` shifts windows to begin at the first event's offset."""
    window = F.window("timestamp", width, startTime=origin) if origin else F.window("timestamp", width)
    counts = stream.withWatermark("timestamp", late).groupBy(window.alias("w")).agg(F.count("*").alias("n_events"), F.sum("label").alias("n_alerts"))
    return counts.select(F.col("w.start").alias("start"), "n_events", "n_alerts")


def session_incidents(stream: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """Incidents by gaps in time (a gap of exactly the limit merges), as in batch without entities."""
    keyed = stream.withColumn("stream", F.col("timestamp").isNotNull())  # one stream; Spark wants a key beside the session
    found = keyed.withWatermark("timestamp", late).groupBy("stream", F.session_window("timestamp", gap).alias("w")).agg(F.count("*").alias("n_anomalies"), F.max("score").alias("peak"), F.max("timestamp").alias("end"))
    return found.select(F.col("w.start").alias("start"), "end", "n_anomalies", F.round("peak", 6).alias("peak"))


def best_by_signature(stream: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Stream dedup: the highest score of each (node, template) and day, with the number of rows."""
    grouped = stream.withWatermark("timestamp", late).groupBy(F.window("timestamp", width).alias("w"), "node", "event_id")
    best = grouped.agg(F.max(F.struct("score", (-F.col("seq")).alias("s"))).alias("best"), F.count("*").alias("dedup_n"))
    return best.select(F.col("w.start").alias("start"), "node", "event_id", (-F.col("best.s")).alias("seq"), F.col("best.score").alias("score"), "dedup_n")


def run_to_table(out: DataFrame, mode: str) -> DataFrame:
    """Run a streaming query over what is there, and return its whole result."""
    spark = out.sparkSession
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex[:12]}"

    atexit.register(remove_local, root)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    query = out.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{root}/state").foreachBatch(keep).start()
    query.awaitTermination()
    got = spark.read.schema(out.schema).option("basePath", f"{root}/out").parquet(f"{root}/out")
    if mode == "complete":  # each batch is the whole result
        rows = spark.read.parquet(f"{root}/out")
        last = rows.agg(F.max("batch")).first()[0]
        return rows.where(F.col("batch") == last).drop("batch")
    return got.select(*out.columns)
