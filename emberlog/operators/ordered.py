"""Operators over one global order, without one task for all rows.

Rows are dealt out by ranges of the order and written with the number of their range.
What crosses a range (how many rows came before, the row before, the decayed state) is
one small row for each range; those rows are combined and joined back by broadcast,
which is bounded by the number of partitions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import written

PART = "range_no"


def in_ranges(df: DataFrame, order: Sequence[str], rows: int | None = None) -> DataFrame:
    """df with the number of each row's range; ``order`` must be unique to be repeatable. rows: the most, about, of a range."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(n, -(-df.count() // rows)) if rows else n
    return written(df.repartitionByRange(n, *order).withColumn(PART, F.spark_partition_id()), "ranges")


def _before(ranges: DataFrame) -> DataFrame:
    """ranges: one row for each range, of which there are as many as partitions."""
    return F.broadcast(ranges)


def with_position(ranged: DataFrame, order: Sequence[str], name: str = "pos") -> DataFrame:
    """The 0-based position in the global order."""
    sizes = ranged.groupBy(PART).agg(F.count("*").alias("size"))
    base = sizes.select(PART, (F.sum("size").over(W.orderBy(PART)) - F.col("size")).alias("base"))
    own = F.row_number().over(W.partitionBy(PART).orderBy(*order))
    return ranged.withColumn(name, own).join(_before(base), PART).withColumn(name, (F.col(name) + F.col("base") - 1).cast("long")).drop("base")


def with_place_in(df: DataFrame, key: str, order: Sequence[str], name: str = "place") -> DataFrame:
    """The 0-based position of each row among the rows of its key, without one task for a key.

    Rows are in ranges by key and order, so only the keys at the borders of ranges are in
    several of them; how many of their rows earlier ranges hold is one row for each border.
    """
    ranged = in_ranges(df, [key, *order])
    sizes = ranged.groupBy(PART, key).agg(F.count("*").alias("size"))
    ends = ranged.groupBy(PART).agg(F.min(F.struct(key)).alias("first"), F.max(F.struct(key)).alias("last"))
    at_border = sizes.join(_before(ends), PART).where(F.struct(key).eqNullSafe(F.col("first")) | F.struct(key).eqNullSafe(F.col("last")))
    base = F.sum("size").over(W.partitionBy(key).orderBy(PART)) - F.col("size")
    borders = at_border.select(F.struct(F.col(PART).alias("range"), F.col(key).alias("key"), base.alias("base")).alias(border := f"{name}_border")).where(f"{border}.base > 0")
    own = F.row_number().over(W.partitionBy(PART, key).orderBy(*order))
    here = (F.col(PART) == F.col(f"{border}.range")) & F.col(key).eqNullSafe(F.col(f"{border}.key"))
    out = ranged.withColumn(name, own).join(_before(borders), here, "left")
    return out.withColumn(name, (F.col(name) + F.coalesce(f"{border}.base", F.lit(0)) - 1).cast("long")).drop(border, PART)


#: Accuracy of the approximate quantiles that bracket an exact one: their ranks are off by a part in so many of the rows.
BRACKET = 10_000


def quantile(df: DataFrame, column: str, p: float, name: str) -> DataFrame:
    """One row with the quantile at p, linear between the two rows around it; NULLs are left out.

    Two approximate quantiles bracket it; the rows below the bracket are counted and those in
    it sorted. Equal values are spread over ranges, and a bracket of one value needs no order.
    """
    values = written(df.select(F.col(column).alias("v")).where(F.col(column).isNotNull()), "values")
    around = [max(p - 2 / BRACKET, 0.0), min(p + 2 / BRACKET, 1.0)]
    n, ends = values.agg(F.count("*"), F.percentile_approx("v", around, BRACKET)).first()
    at = p * max(n - 1, 0)
    low, high = int(np.floor(at)), int(np.ceil(at))
    below, some = 0, values
    if n:
        first, last = (F.lit(e).cast(values.schema["v"].dataType) for e in ends)
        inside = values.where((F.col("v") >= first) & (F.col("v") <= last))
        below, met = values.agg(F.count_if(F.col("v") < first), F.count_if((F.col("v") >= first) & (F.col("v") <= last))).first()
        if below <= low and high < below + met:
            if ends[0] == ends[1]:
                return values.sparkSession.range(1).select(first.cast("double").alias(name))
            some = inside
        else:  # the bracket doesn't hold it
            below = 0
    some = some.withColumn("tie", F.xxhash64(F.monotonically_increasing_id()))
    placed = with_position(in_ranges(some, ["v", "tie"]), ["v", "tie"]).where(F.col("pos").isin(low - below, high - below))
    # one or two rows
    weight = F.lit(1.0) if low == high else F.when(F.col("pos") == low - below, high - at).otherwise(at - low)
    return placed.agg(F.sum(F.col("v") * weight).alias(name))


def with_running_sum(ranged: DataFrame, order: Sequence[str], value: Column, name: str) -> DataFrame:
    """The sum of value up to and with each row."""
    sums = ranged.groupBy(PART).agg(F.sum(value).alias("part_sum"))
    base = sums.select(PART, (F.sum("part_sum").over(W.orderBy(PART)) - F.col("part_sum")).alias("base"))
    own = F.sum(value).over(W.partitionBy(PART).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return ranged.withColumn(name, own).join(_before(base), PART).withColumn(name, F.col(name) + F.col("base")).drop("base")


def with_previous(ranged: DataFrame, order: Sequence[str], columns: dict[str, str]) -> DataFrame:
    """columns: new name -> column whose value in the row before is wanted."""
    last = ranged.groupBy(PART).agg(F.max_by(F.struct(*[F.col(c).alias(k) for k, c in columns.items()]), F.struct(*order)).alias("last"))
    edge = last.select(PART, F.lag("last").over(W.orderBy(PART)).alias("edge"))
    own = W.partitionBy(PART).orderBy(*order)
    first = F.row_number().over(own) == 1
    out = ranged.withColumns({k: F.lag(c).over(own) for k, c in columns.items()} | {"is_first": first}).join(_before(edge), PART, "left")
    return out.withColumns({k: F.when(F.col("is_first"), F.col(f"edge.{k}")).otherwise(F.col(k)) for k in columns}).drop("edge", "is_first")


def decayed_counts(t: np.ndarray, beta: float, carried: float = 0.0, weight: np.ndarray | None = None) -> np.ndarray:
    """For each time the sum of exp(-beta (t - s)) over the times s before it, in one pass over blocks; ``carried`` is the sum at the first time.

    ``weight``: what each time counts, if not 1.

    A block spans so little time that the exponentials can be summed directly; what went
    before it is one decayed number.
    """
    out = np.zeros(len(t))
    weight = np.ones(len(t)) if weight is None else weight
    a = 0
    while a < len(t):
        b = max(a + 1, int(np.searchsorted(t, t[a] + 300.0 / beta, "right")))
        x = np.exp(beta * (t[a:b] - t[a]))
        before = np.concatenate([[0.0], np.cumsum(x * weight[a:b])[:-1]])
        out[a:b] = (carried + before) / x
        if b < len(t):
            carried = (out[b - 1] + weight[b - 1]) * np.exp(-beta * (t[b] - t[b - 1]))
        a = b
    return out


def with_excitation(ranged: DataFrame, time: str, order: Sequence[str], betas: dict[str, float]) -> DataFrame:
    """Adds, for each name, the decayed count of all earlier rows; ``time`` in seconds.

    The recursion A' = exp(-beta d) (1 + A) composes, so ranges are computed apart, batch
    by batch with a carried state, and a range's last state decays into the ranges after it.
    """
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranged.schema) + "".join(f", {k} double" for k in betas)

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, last, state = None, 0.0, {}
        for batch in batches:
            for number, pdf in batch.groupby(PART, sort=True):  # batches hold ranges in order
                t = pdf[time].to_numpy(float)
                if number != of:
                    of, last, state = number, t[0], dict.fromkeys(betas, 0.0)
                counts = {k: decayed_counts(t, b, state[k] * np.exp(-b * (t[0] - last))) for k, b in betas.items()}
                last, state = t[-1], {k: c[-1] + 1.0 for k, c in counts.items()}
                yield pdf.assign(**counts)

    n = int(ranged.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = written(ranged.repartition(n, PART).sortWithinPartitions(PART, *order).mapInPandas(local, fields), "excitation")
    ends = own.groupBy(PART).agg(F.min(time).alias("first"), F.max(time).alias("last"), *[F.max_by(k, F.struct(*order)).alias(k) for k in betas]).orderBy(PART).collect()
    state, rows, before = dict.fromkeys(betas, 0.0), [], None
    for r in ends:  # one row for each partition
        rows.append((r[PART], float(before) if before is not None else float(r["first"]), *state.values()))
        for k, b in betas.items():
            held = state[k] * np.exp(-b * (r["last"] - before)) if before is not None else 0.0
            state[k] = float(held + r[k] + 1.0)
        before = r["last"]
    schema = f"{PART} int, since double" + "".join(f", s_{k} double" for k in betas)
    carry = own.sparkSession.createDataFrame(rows, schema)
    out = own.join(_before(carry), PART)
    added = {k: F.col(k) + F.col(f"s_{k}") * F.exp(-F.lit(float(b)) * (F.col(time) - F.col("since"))) for k, b in betas.items()}
    return out.withColumns(added).drop("since", *[f"s_{k}" for k in betas])


def with_decay_by(df: DataFrame, key: str, time: str, order: Sequence[str], weight: str, beta: float, name: str) -> DataFrame:
    """Adds the decayed sum of the weights of the key's earlier rows; ``time`` and ``beta`` in one unit.

    Rows are in ranges by key and order, computed apart with a carried state; only the key at
    a border is in several ranges, and its state there, one row for each range, decays into
    the next ones.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, key, *order).sortWithinPartitions(key, *order).withColumn(PART, F.spark_partition_id())
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema) + f", {name} double"

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, last, state = None, 0, 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            t, w = batch.column(time).to_numpy(zero_copy_only=False), batch.column(weight).to_numpy(zero_copy_only=False)
            runs = pa.compute.run_end_encode(pa.compute.dictionary_encode(batch.column(key), null_encoding="encode").indices).run_ends.to_numpy()
            number = batch.column(PART).to_numpy(zero_copy_only=False)
            cuts = np.union1d(runs, np.flatnonzero(np.diff(number)) + 1)
            out, a = np.empty(len(t)), 0
            keys = batch.column(key).take(pa.array(np.concatenate([[0], cuts[:-1]]))).to_pylist()
            for own, b in zip(keys, cuts.tolist(), strict=True):
                here = (int(number[a]), own)
                carried = state * np.exp(-beta * (t[a] - last)) if here == of else 0.0
                out[a:b] = decayed_counts((t[a:b] - t[a]).astype(float), beta, carried, w[a:b])
                of, last, state, a = here, t[b - 1], out[b - 1] + w[b - 1], b
            yield batch.append_column(name, pa.array(out))

    own = written(ranged.mapInArrow(local, schema), "decay")
    last = F.max_by(F.struct(F.col(key).alias("key"), F.col(time).alias("since"), (F.col(name) + F.col(weight)).alias("state")), F.struct(key, *order))
    ends = own.groupBy(PART).agg(F.min(F.struct(F.col(key).alias("key"))).alias("first"), last.alias("last")).orderBy(PART).collect()
    rows, before = [], None
    for r in ends:  # one row for each partition
        state = r["last"]["state"]
        if before and before["key"] == r["first"]["key"]:
            rows.append((r[PART], before["key"], before["since"], before["state"]))
            if r["last"]["key"] == before["key"]:
                state += before["state"] * float(np.exp(-beta * (r["last"]["since"] - before["since"])))
        before = {"key": r["last"]["key"], "since": r["last"]["since"], "state": state}
    border = own.sparkSession.createDataFrame([(r,) for r in rows], f"border struct<range: int, key: {ranged.schema[key].dataType.simpleString()}, since: {ranged.schema[time].dataType.simpleString()}, state: double>")
    here = (F.col(PART) == F.col("border.range")) & F.col(key).eqNullSafe(F.col("border.key"))
    added = F.col("border.state") * F.exp(F.lit(-beta) * (F.col(time) - F.col("border.since")))
    out = own.join(_before(border), here, "left").withColumn(name, F.col(name) + F.coalesce(added, F.lit(0.0)))
    return out.drop("border", PART)
