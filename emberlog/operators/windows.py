"""Fixed windows from the first event on: content counts, timing features, labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import in_ranges, with_excitation
from .quality import top_values

BETAS = (1.0, 1 / 30)


def with_window(events: DataFrame, window_s: float = 60.0, ts: str = "timestamp") -> DataFrame:
    """Adds t_sec, the seconds since the first event, and win, the window that holds it."""
    start = events.agg(F.min(F.unix_micros(F.col(ts).cast("timestamp"))).alias("t0"))
    # one row
    secs = (F.unix_micros(F.col(ts).cast("timestamp")) - F.col("t0")) / F.lit(1e6)
    return events.crossJoin(F.broadcast(start)).withColumn("t_sec", secs).withColumn("win", F.floor(F.col("t_sec") / window_s)).drop("t0")


def window_meta(windowed: DataFrame, ts: str = "timestamp") -> DataFrame:
    """The windows that hold an event: start, size, and whether any event is labelled."""
    return windowed.groupBy("win").agg(F.min(ts).alias("start"), F.count("*").alias("n_events"), F.max("label").alias("label"))


def vocabulary_of(events: DataFrame, k: int) -> list[str]:
    return [r[0] for r in top_values(events, "event_id", k).collect()]


def train_vocabulary(events: DataFrame, order: Sequence[str], k: int, train_frac: float = 0.7) -> list[str]:
    """The most frequent ids of the first int(train_frac * n) events in order."""
    from .ordered import with_position

    ranged = in_ranges(events.select(*dict.fromkeys([*order, "event_id"])), order)
    return vocabulary_of(with_position(ranged, order).where(F.col("pos") < int(ranged.count() * train_frac)), k)


def content_features(windowed: DataFrame, vocab: Sequence[str]) -> DataFrame:
    """A count for each id of the vocabulary, in its order; windows without any are zero rows."""
    counts = [F.count_if(F.col("event_id") == v).alias(v) for v in vocab]
    return windowed.groupBy("win").agg(F.count("*").alias("n_events"), *counts).drop("n_events") if vocab else windowed.select("win").distinct()


def column_names(betas: Sequence[float]) -> dict[str, float]:
    return {f"{b:.4g}": b for b in betas}


def timing_features(windowed: DataFrame, order: Sequence[str], betas: Sequence[float] = BETAS) -> DataFrame:
    """Mean and maximum of the excitation at the window's events by decay, and their number.

    The excitation runs over the whole stream, and an event's own is not in it.
    """
    names = {f"exc_{k}".replace(".", "_").replace("-", "m").replace("+", ""): b for k, b in column_names(betas).items()}
    excited = with_excitation(in_ranges(windowed.select(*dict.fromkeys([*order, "t_sec", "win"])), order), "t_sec", order, names)
    aggs = []
    for shown, name in zip(column_names(betas), names, strict=True):
        aggs += [F.avg(name).alias(f"exc_mean_{shown}"), F.max(name).alias(f"exc_max_{shown}")]
    return excited.groupBy("win").agg(*aggs, F.count("*").alias("n_events"))


def window_features(events: DataFrame, order: Sequence[str], window_s: float = 60.0, top_k: int = 50, betas: Sequence[float] = BETAS, vocab: Sequence[str] | None = None) -> DataFrame:
    """Meta, content and timing of each window in one row."""
    windowed = with_window(events, window_s)
    vocab = vocabulary_of(events, top_k) if vocab is None else vocab
    content = content_features(windowed, vocab)
    timing = timing_features(windowed, order, betas).drop("n_events")
    out = window_meta(windowed).join(content, "win", "left").join(timing, "win", "left")
    filled = {c: F.coalesce(F.col(f"`{c}`"), F.lit(0)) for c in vocab} | {c: F.coalesce(F.col(f"`{c}`"), F.lit(0.0)) for c in timing.columns if c != "win"}
    return out.select([filled[c].alias(c) if c in filled else F.col(c) for c in out.columns])
