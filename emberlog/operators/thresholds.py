"""Alert thresholds: fixed quantile, peaks over threshold, and their trailing forms."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import in_ranges, quantile, with_position
from .scratch import versions, written


def log_floor(raw: Column) -> Column:
    return F.ln(F.greatest(raw, F.lit(1e-12)))


def fixed_threshold(scores: DataFrame, q: float) -> DataFrame:
    return quantile(scores, "score", 1.0 - q, "z")


def tail(n: Column, mean: Column, var: Column) -> tuple[Column, Column]:
    """Shape and scale of the generalised Pareto tail by moments; exponential below ten excesses or where moments fail."""
    ok = (n >= 10) & (var > 0) & (mean > 0)
    gamma = F.lit(0.5) * (F.lit(1.0) - F.try_divide(mean * mean, var))
    sigma = mean * (F.lit(1.0) - gamma)
    good = ok & (sigma > 0)
    return F.when(good, gamma).otherwise(0.0), F.when(good, sigma).otherwise(F.greatest(F.coalesce(mean, F.lit(1e-12)), F.lit(1e-12)))


def level(t: Column, gamma: Column, sigma: Column, peaks: Column, n: Column, q: float) -> Column:
    """What is exceeded with probability q; t where there are no peaks."""
    r = F.try_divide(F.lit(float(q)) * n, peaks)
    curved = t + F.try_divide(sigma, gamma) * (F.pow(r, -gamma) - 1.0)
    return F.when(peaks == 0, t).when(r <= 0, F.lit(float("inf"))).when(F.abs(gamma) < 1e-8, t + sigma * F.ln(1.0 / r)).otherwise(curved)


def pot_by(scores: DataFrame, parts: Sequence[str], q: float, init_level: float) -> DataFrame:
    """z, t, gamma, sigma and n_peaks for each group."""
    if parts:  # groups of a stated size
        base = scores.groupBy(*parts).agg(F.expr(f"percentile(score, {init_level!r})").alias("t"), F.count("*").alias("n"))
    else:  # all rows, in ranges
        base = quantile(scores, "score", init_level, "t").crossJoin(scores.agg(F.count("*").alias("n")))
    with_t = scores.join(base.select(*parts, "t"), list(parts)) if parts else scores.crossJoin(F.broadcast(base.select("t")))
    over = with_t.where(F.col("score") > F.col("t")).withColumn("x", F.col("score") - F.col("t")).groupBy(*parts)
    over = over.agg(F.count("*").alias("n_peaks"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    out = base.join(over, list(parts), "left") if parts else base.crossJoin(over)
    out = out.withColumn("n_peaks", F.coalesce("n_peaks", F.lit(0)))
    gamma, sigma = tail(F.col("n_peaks"), F.col("m"), F.col("v"))
    out = out.withColumns({"gamma": gamma, "sigma": sigma})
    z = level(F.col("t"), F.col("gamma"), F.col("sigma"), F.col("n_peaks"), F.col("n"), q)
    return out.select(*parts, z.alias("z"), "t", "gamma", "sigma", F.col("n_peaks").cast("long").alias("n_peaks"))


def pot_threshold(scores: DataFrame, q: float, init_level: float = 0.98) -> DataFrame:
    return pot_by(scores, [], q, init_level)


class SortedWindow:
    """The scores of a count window, kept sorted while rows enter and leave."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = np.sort(values)

    def move(self, new: np.ndarray, old: np.ndarray) -> None:
        """old: values that are in the window, each as often as it leaves."""
        old, new = np.sort(old), np.sort(new)
        same_before = np.arange(len(old)) - np.searchsorted(old, old)
        kept = np.delete(self.values, np.searchsorted(self.values, old) + same_before)
        self.values = np.insert(kept, np.searchsorted(kept, new), new)

    def quantile(self, p: float) -> float:
        """Linear between the two values around it."""
        if not len(self.values):
            return np.nan
        at = p * (len(self.values) - 1)
        low, high = self.values[int(np.floor(at))], self.values[int(np.ceil(at))]
        part = at - np.floor(at)  # from the nearer end, as numpy does
        return float(low) if low == high else float(high - (high - low) * (1 - part) if part >= 0.5 else low + (high - low) * part)

    def peaks(self, q: float, init_level: float) -> float:
        """The level that is exceeded with probability q, by the tail over the initial level."""
        t = self.quantile(init_level)
        over = self.values[np.searchsorted(self.values, t, "right") :] - t
        if not len(over):
            return t
        mean, var = float(over.mean()), float(over.var())
        gamma, sigma = 0.0, max(mean, 1e-12)
        if len(over) >= 10 and var > 0 and mean > 0 and (bent := mean * (1 - 0.5 * (1 - mean * mean / var))) > 0:
            gamma, sigma = 0.5 * (1 - mean * mean / var), bent
        r = q * len(self.values) / len(over)
        if r <= 0:
            return np.inf
        return t + sigma * np.log(1 / r) if abs(gamma) < 1e-8 else t + sigma / gamma * (r**-gamma - 1)


def _block(calib: int, window: int, stride: int, kind: str, q: float, init_level: float, rows: int, own_from: int, fields: list[str]):
    """The rows of a block of the order, after those that its first windows hold, to thresholds and flags of its own rows."""

    def fitted(held: SortedWindow) -> float:
        return held.quantile(1.0 - q) if kind == "quantile" else held.peaks(q, init_level)

    def run(key, table):
        table = table.sort_by("pos")
        pos = table.column("pos").to_numpy()
        x = table.column("score").cast(pa.float64()).to_numpy()
        base, first = int(pos[0]), max(key[0].as_py() * rows, own_from, calib)
        own = table.slice(min(max(first - base, 0), len(pos)))
        at = own.column("pos").to_numpy() - calib
        z = np.zeros(0)
        k0 = 0
        if len(at):
            k0, k1 = int(at[0]) // stride, (int(at[-1]) + 1) // stride
            z, held, a, b = np.empty(k1 - k0 + 1), None, 0, 0
            for k in range(k0, k1 + 1):
                end = calib + k * stride - base
                start = max(0, end - window)
                if held is None or start > b:
                    held = SortedWindow(x[start:end][~np.isnan(x[start:end])])
                else:
                    new, old = x[b:end], x[a:start]
                    held.move(new[~np.isnan(new)], old[~np.isnan(old)])
                a, b = start, end
                z[k - k0] = fitted(held)
        score = own.column("score").cast(pa.float64()).to_numpy()
        limit, after = z[at // stride - k0], z[(at + 1) // stride - k0]
        unknown = np.isnan(limit) | np.isnan(score)
        out = own.select(fields)
        for name, column in (("i", pa.array(at, pa.int64())), ("flag", pa.array(score > limit, pa.bool_(), mask=unknown)), ("thr", pa.array(after, pa.float64(), mask=np.isnan(after)))):
            out = out.append_column(name, column)
        return out

    return run


def _trailing(placed: DataFrame, own_from: int, fields: list[str], calib: int, window: int, stride: int, kind: str, q: float, init_level: float, block_rows: int | None) -> DataFrame:
    """placed: rows with ``pos``; those from own_from on come out."""
    before = window + stride  # rows that a block's first threshold may see
    rows = max(block_rows or 8 * before, before)
    own = F.expr(f"pos div {rows}")
    blocks = F.when(F.col("pos") >= (own + 1) * rows - before, F.array(own, own + 1)).otherwise(F.array(own))
    kinds = {f.name: f.dataType.simpleString() for f in placed.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in fields) + ", i long, flag boolean, thr double"
    name = "block_no"
    while name in placed.columns:
        name += "_"
    return placed.withColumn(name, F.explode(blocks)).groupBy(name).applyInArrow(_block(calib, window, stride, kind, q, init_level, rows, own_from, fields), schema)


def trailing(
    scores: DataFrame, order: Sequence[str], calib: int, window: int, stride: int, kind: str, q: float, init_level: float = 0.95, block_rows: int | None = None
) -> DataFrame:
    """Rows after the first ``calib`` with the threshold that decides them (flag) and the one after them (thr).

    The threshold number k is fitted on the ``window`` scores before row k * stride, the
    calibration rows among them; NULL scores have a place but no value. The order is cut into
    blocks of ``block_rows`` rows, and a block also gets the rows that its first windows hold,
    so that each row moves about once. In a block the window is a sorted array in which
    rows are inserted and deleted, a stride at a time.
    """
    placed = with_position(in_ranges(scores, order), order).drop("range_no")
    return _trailing(placed, 0, scores.columns, calib, window, stride, kind, q, init_level, block_rows)


STATE = "run string, seen long, pos long, score double"


def trailing_run(
    scores: DataFrame, order: Sequence[str], folder: str, run: str, calib: int, window: int, stride: int, kind: str, q: float, init_level: float = 0.95, block_rows: int | None = None
) -> DataFrame:
    """trailing() of a stream that comes in runs: the rows of this run, as if all runs were one.

    The state is a versioned table below ``folder``: the rows that later windows can see, of
    which there are window + stride at most, and the number of rows so far. A version is written
    aside and renamed, so that it is there as a whole or not at all. It names its run: a run
    that is repeated starts from the version before its own and leaves the table as it is.
    The last two versions are kept.
    """
    spark = scores.sparkSession
    there = versions(spark, folder)
    read = lambda v: spark.read.schema(STATE).parquet(f"{folder}/v{v}")
    repeated = bool(there) and read(there[-1]).first().run == run
    base = there[:-1] if repeated else there
    seen, held = 0, None
    if base:
        state = read(base[-1])
        seen, held = state.first().seen, state.where("pos IS NOT NULL").select("pos", "score")
    fields = scores.columns
    placed = with_position(in_ranges(scores, order), order).drop("range_no").withColumn("pos", F.col("pos") + seen)
    if held is not None:
        placed = placed.unionByName(held, allowMissingColumns=True)
    placed = written(placed, "placed")
    if not repeated:
        total = placed.agg(F.max("pos")).first()[0]
        total = seen if total is None else total + 1
        tail = placed.where(F.col("pos") >= total - window - stride).select("pos", F.col("score").cast("double").alias("score"))
        rows = spark.range(1).select(F.lit(None).cast("long").alias("pos"), F.lit(None).cast("double").alias("score")).union(tail)
        number = (there[-1] if there else 0) + 1
        aside = f"{folder}/.v{number}-{uuid.uuid4().hex[:8]}"
        rows.select(F.lit(run).alias("run"), F.lit(total).cast("long").alias("seen"), "pos", "score").write.parquet(aside)
        path = spark._jvm.org.apache.hadoop.fs.Path
        fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(path(f"{folder}/v{number}")) or not fs.rename(path(aside), path(f"{folder}/v{number}")):
            raise RuntimeError(f"another run has written version {number} of {folder}")
        for old in there[:-1]:
            fs.delete(path(f"{folder}/v{old}"), True)
    return _trailing(placed, seen, fields, calib, window, stride, kind, q, init_level, block_rows)


def rolling_quantile(scores: DataFrame, order: Sequence[str], calib: int = 20_000, window: int = 20_000, stride: int = 500, q: float = 0.02) -> DataFrame:
    return trailing(scores, order, calib, window, stride, "quantile", q)


def adaptive_pot(scores: DataFrame, order: Sequence[str], calib: int = 20_000, window: int = 20_000, stride: int = 500, q: float = 1e-3, init_level: float = 0.95) -> DataFrame:
    return trailing(scores, order, calib, window, stride, "pot", q, init_level)


def fixed_flags(scores: DataFrame, order: Sequence[str], calib: int, q: float) -> DataFrame:
    """The calibration quantile, held for the rest of the stream."""
    placed = with_position(in_ranges(scores, order), order).drop("range_no").withColumn("i", F.col("pos") - calib)
    z = F.broadcast(fixed_threshold(placed.where("i < 0"), q).withColumnRenamed("z", "thr"))
    return placed.where("i >= 0").crossJoin(z).withColumn("flag", F.col("score") > F.col("thr")).drop("pos")
