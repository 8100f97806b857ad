"""Checks and exploration series of an event table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import seconds_of
from .ordered import in_ranges, with_previous


def gaps(df: DataFrame, order: Sequence[str], ts: str = "timestamp") -> DataFrame:
    """df with the seconds since the row before, in the given order."""
    ranged = in_ranges(df.withColumn("micros", F.unix_micros(F.col(ts).cast("timestamp"))), order)
    out = with_previous(ranged, order, {"micros_before": "micros"})
    return out.withColumn("gap", (F.col("micros") - F.col("micros_before")) / F.lit(1e6)).drop("micros_before", "range_no")


def null_cells(df: DataFrame, columns: Sequence[str]) -> F.Column:
    """Cells that are NULL, empty text or not a number."""
    kinds = dict(df.dtypes)
    total = F.lit(0)
    for c in columns:
        bad = F.col(c).isNull()
        if kinds[c] == "string":
            bad = bad | (F.col(c) == "")
        if kinds[c] in ("double", "float"):
            bad = bad | F.isnan(c)
        total = total + F.count_if(bad)
    return total


def quality_report(df: DataFrame, order: Sequence[str], keys: str, ts: str = "timestamp") -> DataFrame:
    """One row of checks; ``keys`` is the column with the array of keys that a line names."""
    cells = [c for c in df.columns if c != keys]
    base = df.agg(
        F.count("*").alias("n_rows"), F.min(ts).alias("time_start"), F.max(ts).alias("time_end"), F.countDistinct("event_id").alias("n_templates"),
        null_cells(df, cells).alias("null_cells"), F.bool_and(F.unix_micros(F.col(ts).cast("timestamp")) % 1_000_000 == 0).alias("seconds_only"),
        F.count_if(F.size(keys) == 0).alias("lines_without_key"), (F.count("*") - F.count_distinct(F.coalesce("content", F.lit("\x00null")))).alias("duplicate_content"),
    )
    distinct = df.select([F.col(c) if c != keys else F.concat_ws(" ", c).alias(c) for c in df.columns]).distinct().agg(F.count("*").alias("distinct_rows"))
    gap = gaps(df.select(*dict.fromkeys([*order, ts])), order, ts).agg(
        F.count_if(F.col("gap") < 0).alias("times_going_backwards"), F.bround(F.avg((F.col("gap") == 0).cast("double")), 4).alias("tie_fraction")
    )
    sizes = df.select(F.explode(keys).alias("key")).where(F.length("key") > 0).groupBy("key").agg(F.count("*").alias("n"))
    per_key = sizes.agg(
        F.count("*").alias("n_keys"), F.coalesce(F.median("n"), F.lit(0.0)).alias("median_events_per_key"), F.coalesce(F.max("n"), F.lit(0)).alias("max_events_per_key"),
        F.bround(F.avg((F.col("n") == 1).cast("double")), 4).alias("fraction_single_event_keys"),
    )
    # every part is one row
    out = base.crossJoin(distinct).crossJoin(gap).crossJoin(per_key)
    span = F.unix_micros(F.col("time_end").cast("timestamp")) - F.unix_micros(F.col("time_start").cast("timestamp"))
    return out.withColumns({"exact_duplicate_rows": F.col("n_rows") - F.col("distinct_rows"), "span_seconds": span / F.lit(1e6), "time_monotonic": F.col("times_going_backwards") == 0}).drop("distinct_rows")


def quality_flags(report: DataFrame) -> DataFrame:
    """(check, value, flag) of the rules that a reader should see."""
    c = F.col
    rows = F.array(
        F.struct(F.lit("single_event_keys").alias("check"), c("fraction_single_event_keys").alias("value"), F.coalesce(c("fraction_single_event_keys") > 0.5, F.lit(False)).alias("flag")),
        F.struct(F.lit("coarse_time").alias("check"), c("tie_fraction").alias("value"), (c("seconds_only") & F.coalesce(c("tie_fraction") > 0, F.lit(False))).alias("flag")),
        F.struct(F.lit("unsorted").alias("check"), c("times_going_backwards").cast("double").alias("value"), (c("times_going_backwards") > 0).alias("flag")),
        F.struct(F.lit("null_cells").alias("check"), c("null_cells").cast("double").alias("value"), (c("null_cells") > 0).alias("flag")),
        F.struct(F.lit("duplicate_rows").alias("check"), c("exact_duplicate_rows").cast("double").alias("value"), (c("exact_duplicate_rows") > 0).alias("flag")),
    )
    return report.select(F.explode(rows).alias("r")).select("r.check", "r.value", "r.flag")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent values, ties by value."""
    return value_counts(df, column).orderBy(F.desc("n"), column).limit(k)


def per_minute(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Events of every calendar minute from the first to the last, with the empty ones."""
    counts = df.groupBy(F.date_trunc("minute", F.col(ts).cast("timestamp")).alias("minute")).agg(F.count("*").alias("n"))
    ends = counts.agg(F.min("minute").alias("a"), F.max("minute").alias("b"))
    every = ends.select(F.explode(F.expr("sequence(a, b, interval 1 minute)")).alias("minute"))
    return every.join(counts, "minute", "left").select("minute", F.coalesce("n", F.lit(0)).alias("n"))


def fano_factor(per: DataFrame) -> DataFrame:
    """Variance over mean of the counts."""
    return per.agg(F.try_divide(F.var_samp("n"), F.avg("n")).alias("fano"), F.count("*").alias("minutes"))


def gap_histogram(gapped: DataFrame, bins: int = 50) -> DataFrame:
    """Equal bins of log10 of the positive gaps; the last one is closed."""
    logs = gapped.where("gap > 0").select(F.log10("gap").alias("x"))
    ends = logs.agg(F.min("x").alias("a"), F.max("x").alias("b"))
    bin_no = F.least(F.floor(F.coalesce(F.try_divide((F.col("x") - F.col("a")) * bins, F.col("b") - F.col("a")), F.lit(0.0))), F.lit(bins - 1))
    return logs.crossJoin(F.broadcast(ends)).groupBy(bin_no.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def unit_histogram(rows: DataFrame, column: str, first: int = 0) -> DataFrame:
    """(value, n) for each whole number from ``first`` to the largest value of a column of counts; numbers that don't occur have 0."""
    found = rows.where(F.col(column) >= first).groupBy(F.col(column).cast("long").alias("value")).agg(F.count("*").alias("n"))
    last = found.agg(F.max("value")).first()[0]
    every = rows.sparkSession.range(first, first if last is None else last + 1).withColumnRenamed("id", "value")
    return every.join(found, "value", "left").select("value", F.coalesce("n", F.lit(0)).alias("n"))


def same_count(events: DataFrame, template: str, labels: DataFrame) -> DataFrame:
    """Whether a template occurs exactly once for each labelled key: n_events, n_labels, equal."""
    n = events.agg(F.count_if(F.col("event_id") == template).alias("n_events"))
    # both are one row
    return n.crossJoin(labels.agg(F.count("*").alias("n_labels"))).withColumn("equal", F.col("n_events") == F.col("n_labels"))
