"""Stateful operators over streams in event-time order.

Rows wait in Spark's state store until the watermark has passed them, each under a key of
its own, so that they are spread over all tasks. Rows behind the watermark are dropped by
Spark, which counts them in the query's progress. A micro-batch hands on the rows that
became due; all of them are after those of earlier micro-batches, so an operator orders
them by ranges (operators/ordered.py), as in batch, and carries a small versioned table from
one micro-batch to the next: what comes out doesn't depend on how rows were dealt to files
or micro-batches. A version is named by its micro-batch; one that is repeated starts from
the version before its own.

A stream that ends is closed by a heartbeat, a row with a time and nothing else, which moves
the watermark past everything that waits.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.ordered import in_ranges, with_decay_by, with_previous, with_running_sum
from ..operators.scratch import delete, remove_local, shared_folder, versions, written
from ..operators.thresholds import trailing_run

#: Time of the heartbeat that closes a stream.
CLOSING = "2250-01-01 00:00:00"
ORDER = ["micros", "seq"]


class InOrder:
    """An operator over the rows of ``held`` that the watermark has passed: micros, seq, score and entity."""

    schema = ""

    def __init__(self, stream: DataFrame, late: str) -> None:
        rows = stream.withWatermark("timestamp", late).groupBy("timestamp", "seq", "node", "score")
        self.held = rows.agg(F.count("*").cast("int").alias("n"))  # rows alike in all of these share a key

    def due(self, batch: DataFrame) -> DataFrame:
        rows = batch.where("seq IS NOT NULL")  # heartbeats have no number
        return rows.select(F.unix_micros("timestamp").alias("micros"), "seq", "score", F.col("node").alias("entity"), F.explode(F.array_repeat(F.lit(0), F.col("n"))).alias("copy")).drop("copy")

    def released(self, rows: DataFrame, folder: str, number: int) -> DataFrame:
        """What goes out for the rows of micro-batch ``number``; the state after them goes to ``folder``."""
        raise NotImplementedError

    def passed(self, spark: SparkSession, folder: str, watermark: int) -> DataFrame | None:
        """What the watermark alone, in microseconds, lets out."""
        return None


def _alike(spark: SparkSession, schema: StructType | str, n: int, values: Mapping = {}) -> DataFrame:  # noqa: B006
    """``n`` rows with these values and else NULL, from Spark itself: createDataFrame passes rows, even none, through Python workers on the executors."""
    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return spark.range(0, n, 1, 1).select(*[F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in fields])


def _before(spark: SparkSession, folder: str, number: int | None, schema: str) -> DataFrame | None:
    """The state before micro-batch ``number``, or the last one."""
    there = [v for v in versions(spark, folder) if number is None or v < number]
    return spark.read.schema(schema).parquet(f"{folder}/v{there[-1]}") if there else None


def _keep(state: DataFrame, folder: str, number: int) -> None:
    """The state after micro-batch ``number``; it and the one before stay."""
    spark = state.sparkSession
    state.write.mode("overwrite").parquet(f"{folder}/v{number}")
    for old in [v for v in versions(spark, folder) if v < number][:-1]:
        delete(spark, f"{folder}/v{old}")


class TrailingThreshold(InOrder):
    """Flags by the quantile of the last ``window`` scores, fitted after ``calib`` rows and every ``stride`` rows from there."""

    schema = "seq long, i long, flag boolean, thr double"

    def __init__(self, stream: DataFrame, late: str, calib: int, window: int, stride: int, q: float) -> None:
        super().__init__(stream, late)
        self.args = (calib, window, stride, "quantile", q)

    def released(self, rows, folder, number):
        return trailing_run(rows.select("micros", "seq", "score"), ORDER, folder, str(number), *self.args).select("seq", "i", "flag", "thr")


class Decay(InOrder):
    """The decayed count of a key's earlier events; the state is one row for each key, its last time and the count after it."""

    schema = "node string, seq long, excitation double"
    state = "entity string, micros long, a double"

    def __init__(self, stream: DataFrame, late: str, beta: float) -> None:
        super().__init__(stream, late)
        self.beta = beta

    def released(self, rows, folder, number):
        spark = rows.sparkSession
        rows = rows.select("entity", "micros", "seq", F.lit(1.0).alias("weight"))
        carried = _before(spark, folder, number, self.state)
        if carried is not None:  # a key's past is one event before its others, with the weight of all
            rows = rows.unionByName(carried.withColumnRenamed("a", "weight"), allowMissingColumns=True)
        found = written(with_decay_by(rows, "entity", "micros", ORDER, "weight", self.beta / 1e6, "excitation"), "decayed")
        last = F.max_by(F.struct("micros", (F.col("excitation") + F.col("weight")).alias("a")), F.struct(*ORDER))
        _keep(found.groupBy("entity").agg(last.alias("last")).select("entity", "last.*"), folder, number)
        return found.where("seq IS NOT NULL").select(F.col("entity").alias("node"), "seq", "excitation")


class Incidents(InOrder):
    """Incidents as they close: by a gap in time longer than the limit, or by a change of entity. The state is the last one."""

    schema = "incident_no long, start timestamp_ntz, end timestamp_ntz, entity string, n_anomalies long, peak double, first_seq long"
    state = "no long, start long, end long, entity string, n long, peak double, first_seq long, open boolean"

    def __init__(self, stream: DataFrame, late: str, gap_seconds: float, same_entity: bool) -> None:
        super().__init__(stream, late)
        self.gap, self.same_entity = round(gap_seconds * 1e6), same_entity

    def _closed(self, found: DataFrame) -> DataFrame:
        at = lambda c: F.expr(f"timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(`{c}` / 1000000BD as decimal(18, 6))) AS `{c}`")
        return found.select(F.col("no").alias("incident_no"), at("start"), at("end"), "entity", F.col("n").alias("n_anomalies"), "peak", "first_seq")

    def released(self, rows, folder, number):
        spark = rows.sparkSession
        carried = _before(spark, folder, number, self.state)
        last = carried.first() if carried is not None else None  # one row
        end, entity, no = (last["end"] if last.open else None, last.entity, last.no) if last else (None, None, 0)
        placed = with_previous(in_ranges(rows, ORDER), ORDER, {"before": "micros", "entity_before": "entity"})
        first = F.col("before").isNull()
        before = F.coalesce("before", F.lit(end).cast("long"))
        new = before.isNull() | (F.col("micros") - before > self.gap)
        if self.same_entity:
            new |= ~F.col("entity").eqNullSafe(F.when(first, F.lit(entity).cast("string")).otherwise(F.col("entity_before")))
        numbered = with_running_sum(placed.withColumn("new", new.cast("long")), ORDER, F.col("new"), "no").withColumn("no", F.col("no") + no)
        at = F.struct(*ORDER)
        peak = F.max(F.nanvl("score", F.lit(None).cast("double"))).alias("peak")
        found = numbered.groupBy("no").agg(
            F.min("micros").alias("start"), F.max("micros").alias("end"), F.min_by("entity", at).alias("entity"), F.count("*").alias("n"), peak, F.min_by("seq", at).alias("first_seq")
        )
        if last and last.open:  # it goes on, or closes
            both = carried.drop("open").unionByName(found).groupBy("no")
            found = both.agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("entity", "end").alias("entity"), F.sum("n").alias("n"), F.max("peak").alias("peak"), F.min_by("first_seq", "end").alias("first_seq"))
        found = written(found, "incidents")
        top = found.agg(F.max("no")).first()[0]
        _keep(found.where(F.col("no") == top).withColumn("open", F.lit(True)), folder, number)
        return self._closed(found.where(F.col("no") < top))

    def passed(self, spark, folder, watermark):
        there = versions(spark, folder)
        last = _before(spark, folder, None, self.state)
        row = last.first() if last is not None else None
        if row is None or not row.open or watermark < row["end"] + self.gap:  # rows to come are after the watermark
            return None
        held = _alike(spark, self.state, 1, row.asDict())
        held.withColumn("open", F.lit(False)).write.mode("overwrite").parquet(f"{folder}/v{there[-1]}")
        return self._closed(held)


def rolling_threshold(stream: DataFrame, calib: int, window: int, stride: int, q: float, late: str = "1 hour") -> InOrder:
    """seq, i, flag and thr of the rows of one stream after the first ``calib``, as in batch."""
    return TrailingThreshold(stream, late, calib, window, stride, q)


def decay_by_node(stream: DataFrame, beta: float, late: str = "1 hour") -> InOrder:
    """Each node's decayed count of its earlier events."""
    return Decay(stream, late, beta)


def incident_stream(stream: DataFrame, gap_seconds: float = 30.0, same_entity: bool = False, late: str = "1 hour") -> InOrder:
    """The incidents of a stream of anomalies, each once it is closed; numbers count from 1 in time order."""
    return Incidents(stream, late, gap_seconds, same_entity)


@contextmanager
def _state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Timers and lists need the store that keeps state on disk."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def run_to_end(stream: DataFrame, build: Callable[[DataFrame], InOrder], progress: list | None = None) -> DataFrame:
    """Run ``build(stream)`` over what is there, close the stream with a heartbeat and return the whole result.

    progress: gets the progress of each micro-batch.
    """
    spark = stream.sparkSession
    root = f"{shared_folder(spark)}/ordered-{uuid.uuid4().hex[:12]}"
    atexit.register(remove_local, root)
    _alike(spark, stream.schema, 0).write.parquet(f"{root}/beats")
    beats = spark.readStream.schema(stream.schema).parquet(f"{root}/beats")
    operator = build(stream.unionByName(beats))

    def keep(batch: DataFrame, number: int) -> None:
        rows = written(operator.due(batch), "due")
        out = _alike(spark, operator.schema, 0) if rows.isEmpty() else operator.released(spark.read.schema(rows.schema).parquet(*rows.inputFiles()), f"{root}/carried", number)
        out.write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    def run(name: str) -> None:
        with _state_on_disk(spark):
            query = operator.held.writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{root}/state").foreachBatch(keep).start()
        query.awaitTermination()
        if progress is not None:
            progress.extend(query.recentProgress)
        mark = query.lastProgress and query.lastProgress["eventTime"].get("watermark")
        if mark:
            micros = round((datetime.fromisoformat(mark) - datetime(1970, 1, 1, tzinfo=UTC)).total_seconds() * 1e6)
            if (out := operator.passed(spark, f"{root}/carried", micros)) is not None:
                out.write.parquet(f"{root}/out/batch={name}")

    run("reached")
    _alike(spark, stream.schema, 1, {"timestamp": CLOSING}).write.mode("append").parquet(f"{root}/beats")
    run("closed")
    return spark.read.schema(operator.schema).option("basePath", f"{root}/out").parquet(f"{root}/out").select(*StructType.fromDDL(operator.schema).names)
