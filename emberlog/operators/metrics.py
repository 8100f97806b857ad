"""Evaluation of scored, labelled rows. A score is worse the higher it is."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordered import in_ranges, with_running_sum


def by_score(scored: DataFrame, parts: Sequence[str] = ()) -> DataFrame:
    """Rows and positives of each distinct score: all that average precision needs."""
    return scored.groupBy(*parts, "score").agg(F.count("*").alias("n"), F.sum("label").alias("tp"))


def pr_curve(scored: DataFrame) -> DataFrame:
    """threshold, precision and recall at each distinct score, ties together."""
    groups = by_score(scored).withColumn("down", -F.col("score"))
    ranged = in_ranges(groups, ["down"])
    ran = with_running_sum(with_running_sum(ranged, ["down"], F.col("n"), "cum_n"), ["down"], F.col("tp"), "cum_tp")
    total = F.broadcast(groups.agg(F.sum("tp").alias("positives")))
    out = ran.crossJoin(total).where("positives > 0")
    return out.select(F.col("score").alias("threshold"), (F.col("cum_tp") / F.col("cum_n")).alias("precision"), (F.col("cum_tp") / F.col("positives")).alias("recall"), (F.col("tp") / F.col("positives")).alias("gain"))


def average_precision(scored: DataFrame) -> DataFrame:
    """One row: the sum of precision times the gain in recall."""
    return pr_curve(scored).agg(F.sum(F.col("precision") * F.col("gain")).alias("pr_auc"))


def operating_point(scored: DataFrame, order: Sequence[str], target_recall: float = 0.9) -> DataFrame:
    """The smallest set of top rows that reaches the recall; ties of a score by ``order``, row by row."""
    keys = ["down", *order]
    ranged = in_ranges(scored.withColumn("down", -F.col("score")), keys)
    ran = with_running_sum(with_running_sum(ranged, keys, F.lit(1), "k"), keys, F.col("label"), "tp")
    total = ranged.agg(F.sum("label").alias("positives"), F.count("*").alias("n")).first()
    positives = int(total["positives"] or 0)
    if positives == 0:
        raise ValueError("no positive rows, so no recall to fix")
    reached = ran.where((F.col("tp") / positives >= target_recall) | (F.col("k") == total["n"]))
    row = reached.agg(F.min_by(F.struct("k", "tp", "score"), "k").alias("r")).select("r.*")
    return row.select(
        F.lit(float(target_recall)).alias("target_recall"), F.col("score").alias("threshold"), (F.col("tp") / positives).alias("recall"), (F.col("tp") / F.col("k")).alias("precision"),
        F.col("tp").cast("long").alias("tp"), (F.col("k") - F.col("tp")).cast("long").alias("fp"), (F.lit(positives) - F.col("tp")).cast("long").alias("fn"),
    )


def span_days(scored: DataFrame, ts: str) -> DataFrame:
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    return scored.agg(F.greatest((F.max(micros) - F.min(micros)) / F.lit(86400e6), F.lit(1e-9)).alias("days"))


def false_alarms_per_day(scored: DataFrame, order: Sequence[str], ts: str = "timestamp", target_recall: float = 0.9) -> DataFrame:
    """The operating point and its false positives over the days that the rows span."""
    point = operating_point(scored, order, target_recall)
    return point.crossJoin(span_days(scored, ts)).withColumn("fa_per_day", F.col("fp") / F.col("days")).drop("days")


def with_time_bin(rows: DataFrame, bins: int, ts: str = "timestamp") -> DataFrame:
    """bin (from 1) of equal width in time, the last closed, with its start and days."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    ends = F.broadcast(rows.agg(F.min(micros).alias("t0"), F.max(micros).alias("t1")))
    number = F.least(F.floor(F.coalesce(F.try_divide((micros - F.col("t0")) * bins, F.col("t1") - F.col("t0")), F.lit(0.0))), F.lit(bins - 1)).cast("int")
    width = (F.col("t1") - F.col("t0")) / F.lit(float(bins))
    out = rows.crossJoin(ends).withColumn("bin", number + 1)
    start = F.timestamp_micros((F.col("t0") + width * (F.col("bin") - 1)).cast("long"))
    return out.withColumns({"bin_start": start, "bin_days": F.greatest(width / F.lit(86400e6), F.lit(1e-9))}).drop("t0", "t1")


def _positives(flag: Column, label: int) -> Column:
    return F.count_if(flag & (F.col("label") == label))


def drift_report(scored: DataFrame, order: Sequence[str], bins: int = 4, target_recall: float = 0.9, ts: str = "timestamp") -> DataFrame:
    """Per time bin, with the threshold fixed once over all rows: size, rate, average precision, recall, false alarms a day."""
    threshold = F.broadcast(operating_point(scored, order, target_recall).select("threshold"))
    binned = with_time_bin(scored, bins, ts).crossJoin(threshold)
    flag = F.col("score") >= F.col("threshold")
    base = binned.groupBy("bin").agg(
        F.min("bin_start").alias("start"), F.count("*").alias("n"), F.avg("label").alias("anomaly_rate"), F.sum("label").alias("positives"),
        (_positives(flag, 1) / F.greatest(F.sum("label"), F.lit(1))).alias("recall_at_thr"), (_positives(flag, 0) / F.first("bin_days")).alias("fa_per_day"),
    )
    keys = ["bin", "down"]
    groups = in_ranges(by_score(binned, ["bin"]).withColumn("down", -F.col("score")), keys)
    sums = groups.groupBy("bin").agg(F.sum("n").alias("bin_n"), F.sum("tp").alias("bin_tp"))
    earlier = W.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    # one row for each bin: what stands before it in the order of all
    before = F.broadcast(sums.select("bin", *[F.coalesce(F.sum(f"bin_{c}").over(earlier), F.lit(0)).alias(f"before_{c}") for c in ("n", "tp")]))
    ran = with_running_sum(with_running_sum(groups, keys, F.col("n"), "all_n"), keys, F.col("tp"), "all_tp").join(before, "bin")
    ran = ran.withColumns({f"cum_{c}": F.col(f"all_{c}") - F.col(f"before_{c}") for c in ("n", "tp")})
    ap = ran.groupBy("bin").agg(F.sum(F.col("tp") * F.col("cum_tp") / F.col("cum_n")).alias("raw"))
    out = base.join(ap, "bin")
    auc = F.when((F.col("positives") > 0) & (F.col("positives") < F.col("n")), F.try_divide("raw", "positives"))
    return out.select("bin", "start", "n", "anomaly_rate", auc.alias("pr_auc"), "recall_at_thr", "fa_per_day")


def threshold_stability(flagged: DataFrame, bins: int = 6, ts: str = "timestamp") -> DataFrame:
    """Per time bin of rows (flag, label, thr): flagged rate, recall, false alarms a day, median threshold."""
    binned = with_time_bin(flagged, bins, ts)
    return binned.groupBy("bin").agg(
        F.avg(F.col("flag").cast("double")).alias("flagged_rate"), (_positives(F.col("flag"), 1) / F.greatest(F.count_if(F.col("label") == 1), F.lit(1))).alias("recall"),
        (_positives(F.col("flag"), 0) / F.first("bin_days")).alias("fa_per_day"), F.median("thr").alias("threshold"),
    )


def swing(stability: DataFrame) -> DataFrame:
    return stability.agg((F.max("fa_per_day") / F.greatest(F.min("fa_per_day"), F.lit(1.0))).alias("swing"))


def largest_atom(scored: DataFrame) -> DataFrame:
    """The share of the most frequent score among the normal rows."""
    return scored.where("label = 0").groupBy("score").agg(F.count("*").alias("n")).agg((F.max("n") / F.sum("n")).alias("share"))


def ablation_verdict(lift: Column) -> Column:
    return F.when(lift > 0.005, "helps").when(F.abs(lift) <= 0.005, "no material effect").otherwise("hurts")


def as_records(row: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(metric, value) of the columns of a one-row frame: the records of a result file."""
    return row.unpivot([], [F.col(c).cast("double").alias(c) for c in columns], "metric", "value") if columns else row.limit(0)


def compared(new: DataFrame, old: DataFrame) -> DataFrame:
    """Two results side by side, by metric; either may lack one."""
    both = new.withColumnRenamed("value", "new").join(old.withColumnRenamed("value", "old"), "metric", "full")
    return both.withColumn("change", F.col("new") - F.col("old"))
