"""Key sessions, count features and the temporal split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import in_ranges, with_place_in, with_position


def explode_keys(events: DataFrame, keys: str, key: str = "block_id") -> DataFrame:
    """A row for each key that a line names; lines without one are left out."""
    return events.withColumn(key, F.explode(keys)).where(F.length(key) > 0).drop(keys)


def key_sessions(lines: DataFrame, key: str, order: Sequence[str], ts: str = "timestamp") -> DataFrame:
    """Of each key: its event ids in the input's order, first and last time, and size."""
    ordered = F.array_sort(F.collect_list(F.struct(*order, F.col("event_id").alias("session_event"))))
    return lines.groupBy(key).agg(
        F.transform(ordered, lambda x: x["session_event"]).alias("event_seq"), F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("n_events")
    )


def key_segments(lines: DataFrame, key: str, order: Sequence[str], most: int = 10_000, ts: str = "timestamp") -> DataFrame:
    """key_sessions() for keys of any size: a key's events in segments of ``most``, numbered from 0 in order."""
    placed = with_place_in(lines, key, order).withColumn("segment_no", F.expr(f"place div {most}"))
    ordered = F.array_sort(F.collect_list(F.struct("place", F.col("event_id").alias("session_event"))))
    return placed.groupBy(key, "segment_no").agg(
        F.transform(ordered, lambda x: x["session_event"]).alias("event_seq"), F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("n_events")
    )


def session_meta(lines: DataFrame, key: str, ts: str = "timestamp") -> DataFrame:
    return lines.groupBy(key).agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("n_events"))


def vocabulary(lines: DataFrame, limit: int = 10_000) -> list[str]:
    """The distinct event ids in ascending order: the columns of the count matrix. More than the limit is an error."""
    found = sorted(r[0] for r in lines.select("event_id").where("event_id IS NOT NULL").distinct().limit(limit + 1).collect())
    if len(found) > limit:
        raise ValueError(f"more than {limit} event ids: not a vocabulary of templates")
    return found


def count_matrix(lines: DataFrame, key: str, vocab: Sequence[str]) -> DataFrame:
    """A column for each event id of the vocabulary, with the key's count of it."""
    wide = lines.groupBy(key).pivot("event_id", list(vocab)).agg(F.count(F.lit(1)))
    return wide.na.fill(0, list(vocab))


def count_vectors(lines: DataFrame, key: str, vocab: Sequence[str]) -> DataFrame:
    """The counts as one array in the vocabulary's order: a plan of fixed width for any vocabulary."""
    pairs = lines.groupBy(key, "event_id").agg(F.count("*").alias("n")).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("event_id", "n"))).alias("m"))
    names = F.array(*[F.lit(v) for v in vocab])
    return pairs.select(key, F.transform(names, lambda v: F.coalesce(F.try_element_at("m", v), F.lit(0)).cast("double")).alias("features"))


def labeled(sessions: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Sessions with a label; those without one are left out (the vocabulary is fixed before)."""
    return sessions.join(labels, key, "left").where("label IS NOT NULL")


def temporal_split(meta: DataFrame, key: str, train_frac: float = 0.7, rounded: bool = True) -> DataFrame:
    """split = train for the first n * train_frac sessions by start, then key; that number is rounded half to even, or cut."""
    if not 0 < train_frac < 1:
        raise ValueError("train_frac must lie between 0 and 1")
    ranged = in_ranges(meta, ["start", key])
    share = ranged.count() * train_frac
    n_train = round(share) if rounded else int(share)
    placed = with_position(ranged, ["start", key])
    return placed.withColumn("split", F.when(F.col("pos") < n_train, "train").otherwise("test")).drop("pos", "range_no")


def split_summary(split: DataFrame) -> DataFrame:
    """Sizes, the start of the last training session (NULL without one), and rates of both sides."""
    train, test = F.col("split") == "train", F.col("split") == "test"
    rates = split.agg(
        F.count_if(train).alias("n_train"), F.count_if(test).alias("n_test"), F.max(F.when(train, F.col("start"))).alias("boundary"),
        F.avg(F.when(train, F.col("label"))).alias("train_rate"), F.avg(F.when(test, F.col("label"))).alias("test_rate"),
    )
    return rates.withColumn("rate_ratio", F.try_divide("test_rate", "train_rate"))


#: The bounds of the size classes, each closed on the right.
SIZE_BOUNDS = (0, 10, 20, 30, 50, 300)


def size_class(n: Column) -> Column:
    out = F.lit(None).cast("string")
    for a, b in zip(SIZE_BOUNDS[:-1], SIZE_BOUNDS[1:], strict=True):
        out = F.when((n > a) & (n <= b), F.lit(f"({a}, {b}]")).otherwise(out)
    return out


def rate_by_size(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy(size_class(F.col("n_events")).alias("size")).agg(F.avg("label").alias("rate"), F.count("*").alias("n"))
