"""Streams against their rules, with rows that come too late."""

import os
import random
from datetime import datetime as D
from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlog.operators import ordered, triage
from emberlog.operators.ordered import decayed_counts
from emberlog.streaming import ordered_streams, streams

SCHEMA = "seq long, timestamp timestamp, event_id string, node string, label int, score double"


def stream_of(spark, folder, batches):
    """A stream that reads one file a trigger, in this order."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/{k}")
        for name in os.listdir(f"{folder}/{k}"):
            if name.endswith(".parquet"):
                os.makedirs(f"{folder}/in", exist_ok=True)
                os.rename(f"{folder}/{k}/{name}", f"{folder}/in/{k}.parquet")
                os.utime(f"{folder}/in/{k}.parquet", (1_000_000 + k, 1_000_000 + k))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def row(seq, minute, node="a", score=1.0, label=0):
    return (seq, D(2024, 1, 1) + timedelta(minutes=minute), "e", node, label, score)


def test_rows_behind_the_watermark_are_dropped(spark, tmp_path):
    batches = [[row(1, 5), row(2, 30)], [row(3, 600), row(4, 45)], [row(6, 620)], [row(5, 10), row(9, 630)], [row(7, 2000)], [row(8, 2001)], [row(10, 2002)]]
    out = streams.run_to_table(streams.tumbling_counts(stream_of(spark, tmp_path, batches), "1 hour", "2 hours"), "append")
    got = {(r.start - D(2024, 1, 1)).total_seconds() / 3600: r.n_events for r in out.collect()}
    assert got == {0.0: 3, 10.0: 3}  # row 4 comes before the watermark has moved; row 5 comes after it and is dropped


def test_dedup_keeps_the_best_of_a_day(spark, tmp_path):
    batches = [[row(1, 5, score=1.0), row(2, 6, score=3.0), row(3, 7, "b")], [row(4, 8, score=3.0), row(5, 1500, score=9.0)]]
    got = sorted((r.node, r.seq, r.score, r.dedup_n) for r in streams.run_to_table(streams.best_by_signature(stream_of(spark, tmp_path, batches)), "complete").collect())
    assert got == [("a", 2, 3.0, 3), ("a", 5, 9.0, 1), ("b", 3, 1.0, 1)]


def test_session_gap_of_the_limit_merges(spark, tmp_path):
    batches = [[row(1, 0), row(2, 30)], [row(3, 61)]]
    got = sorted((r.n_anomalies for r in streams.run_to_table(streams.session_incidents(stream_of(spark, tmp_path, batches), "30 minutes"), "complete").collect()))
    assert sum(got) == 3 and len(got) == 2


def shuffled(rows, seed, most):
    """Rows dealt to batches out of order, none by more than ``most`` minutes behind the largest time before its batch."""
    rnd, left, out, top = random.Random(seed), sorted(rows, key=lambda r: r[1]), [], None
    while left:
        batch = []
        for _ in range(rnd.randint(5, 14)):
            ahead = [r for r in left if r[1] - left[0][1] <= timedelta(minutes=most / 2)]
            if left:
                batch.append(left.pop(left.index(rnd.choice(ahead))))
        rnd.shuffle(batch)
        out.append(batch)
        top = max([r[1] for r in batch] + ([top] if top else []))
    return out


def test_decay_out_of_order_is_that_of_batch(spark, tmp_path):
    rows = [row(k, k * (k % 3 + 1), "ab"[k % 2]) for k in range(40)]
    batches = shuffled(rows, 3, 60)
    assert [r for b in batches for r in b] != sorted(rows, key=lambda r: r[1])
    out = ordered_streams.run_to_end(stream_of(spark, tmp_path, batches), lambda s: ordered_streams.decay_by_node(s, 0.001, "1 hour")).collect()
    got = {r.seq: r.excitation for r in out}
    assert len(out) == 40
    for node in "ab":
        own = sorted((r for r in rows if r[3] == node), key=lambda r: (r[1], r[0]))
        want = decayed_counts(np.array([r[1].timestamp() for r in own]), 0.001)
        assert np.allclose([got[r[0]] for r in own], want)


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    batches = [[row(1, 0), row(2, 10)], [row(3, 500)], [row(4, 505)], [row(5, 20), row(6, 510)], [row(7, 600)]]
    progress = []
    out = ordered_streams.run_to_end(stream_of(spark, tmp_path, batches), lambda s: ordered_streams.decay_by_node(s, 0.01, "30 minutes"), progress).collect()
    assert sorted(r.seq for r in out) == [1, 2, 3, 4, 6, 7]
    assert sum(op.numRowsDroppedByWatermark for p in progress for op in p.stateOperators) == 1


def plain_thresholds(rows, calib, window, stride, q):
    scores, z, want = [], float("nan"), []
    for k, r in enumerate(rows):
        flag = k >= calib and r[5] > z
        scores.append(r[5])
        if k + 1 >= calib and (k + 1 - calib) % stride == 0:
            z = float(np.quantile(scores[-window:], 1 - q))
        if k >= calib:
            want.append((r[0], k - calib, flag, z))
    return want


def test_thresholds_are_those_of_the_plain_rule_in_any_batches(spark, tmp_path):
    rows = [row(k, k, score=float(k * 37 % 101)) for k in range(60)]
    out = ordered_streams.run_to_end(stream_of(spark, tmp_path, shuffled(rows, 5, 30)), lambda s: ordered_streams.rolling_threshold(s, 10, 8, 5, 0.2, "30 minutes"))
    assert [tuple(r) for r in out.orderBy("seq").collect()] == plain_thresholds(rows, 10, 8, 5, 0.2)


def plain_incidents(rows, gap, same):
    out = []
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        if out and (r[1] - out[-1][2]).total_seconds() <= gap and (not same or r[3] == out[-1][3]):
            no, start, _, entity, n, peak, first = out[-1]
            out[-1] = (no, start, r[1], entity, n + 1, max(peak, r[5]), first)
        else:
            out.append((len(out) + 1, r[1], r[1], r[3], 1, r[5], r[0]))
    return out


@pytest.mark.parametrize("same", [False, True])
def test_incidents_close_by_gap_or_change_of_entity(spark, tmp_path, same):
    rnd, at, rows = random.Random(4), 0, []
    for k in range(50):
        at += rnd.choice([0, 1, 2, 5, 6])
        rows.append(row(k, at, rnd.choice("aab") if k % 7 else None, score=rnd.random()))
    build = lambda s: ordered_streams.incident_stream(s, 300.0, same, "30 minutes")
    out = ordered_streams.run_to_end(stream_of(spark, tmp_path, shuffled(rows, 6, 30)), build)
    assert [tuple(r) for r in out.orderBy("incident_no").collect()] == plain_incidents(rows, 300, same)


def test_closed_incidents_equal_those_of_batch(spark, tmp_path):
    """The online operator against correlate() over the same rows."""
    rows = [row(k, k * k % 97 + k, "ab"[k % 5 == 0], score=float(k)) for k in range(40)]
    out = ordered_streams.run_to_end(stream_of(spark, tmp_path, [rows]), lambda s: ordered_streams.incident_stream(s, 120.0, True, "1 hour"))
    batch = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("node", "entity")
    want = triage.correlate(batch, 120.0, True).groupBy("incident_no").agg(F.count("*").alias("n"), F.min("timestamp").alias("start"), F.max("timestamp").alias("end"))
    assert sorted((r.incident_no, r.n_anomalies, r.start, r.end) for r in out.collect()) == sorted((r.incident_no, r.n, r.start, r.end) for r in want.collect())


def test_rows_of_one_stream_wait_under_keys_of_their_own(spark, tmp_path):
    """One stream's rows, like rows among them, are not the state of one key."""
    rows = [row(k // 2, k // 2, score=float(k // 2)) for k in range(40)]
    progress = []
    out = ordered_streams.run_to_end(stream_of(spark, tmp_path, [rows]), lambda s: ordered_streams.rolling_threshold(s, 10, 8, 5, 0.2, "30 minutes"), progress).collect()
    assert sorted(r.i for r in out) == list(range(30)) and sorted(r.seq for r in out) == [k // 2 for k in range(10, 40)]
    assert max(op.numRowsTotal for p in progress for op in p.stateOperators) >= 20
    assert {op.operatorName for p in progress for op in p.stateOperators} == {"stateStoreSave"}


def test_a_node_over_several_ranges_decays_across_them(spark):
    """One node has most rows, so ranges cut it; null and small nodes lie beside it."""
    rnd = random.Random(1)
    rows = [(k, rnd.randrange(10**9), rnd.choice([None, "a"] + ["b"] * 30), rnd.choice([1.0, 1.0, 2.5])) for k in range(600)]
    table = spark.createDataFrame(rows, "seq long, micros long, node string, w double")
    got = ordered.with_decay_by(table, "node", "micros", ["micros", "seq"], "w", 1e-8, "x").collect()
    assert len(got) == 600
    for r in got:
        want = sum(w * np.exp(-1e-8 * (r.micros - m)) for s, m, node, w in rows if node == r.node and (m, s) < (r.micros, r.seq))
        assert abs(r.x - want) < 1e-9 * max(1, want)


def test_alerts_of_one_stream_wait_under_keys_of_their_own(spark, tmp_path):
    progress = []
    rows = [row(k, 5 * k, "ab"[k > 6], score=float(k)) for k in range(12)]
    out = ordered_streams.run_to_end(stream_of(spark, tmp_path, [rows]), lambda s: ordered_streams.incident_stream(s, 300.0, True, "10 minutes"), progress).collect()
    assert sorted((r.incident_no, r.n_anomalies, r.first_seq, r.peak) for r in out) == [(1, 7, 0, 6.0), (2, 5, 7, 11.0)]
    assert {op.operatorName for p in progress for op in p.stateOperators} == {"stateStoreSave"}


def test_incidents_take_no_python_on_the_executors(spark, tmp_path, monkeypatch):
    """Neither rows nor the state between micro-batches pass through a Python worker, whose memory grew with the waiting alerts."""
    rows = [row(k, 5 * k, "ab"[k > 6], score=float(k)) for k in range(12)] + [row(12, 900, "b", score=1.5), row(13, 1100, None, score=float("nan"))]
    stream = stream_of(spark, tmp_path, [rows[:9], rows[9:13], rows[13:]])
    monkeypatch.setattr(spark.sparkContext, "pythonExec", str(tmp_path / "no-python"))
    out = ordered_streams.run_to_end(stream, lambda s: ordered_streams.incident_stream(s, 300.0, True, "10 minutes")).orderBy("incident_no").collect()
    assert [(r.incident_no, r.n_anomalies, r.entity, r.first_seq, r.peak) for r in out] == [(1, 7, "a", 0, 6.0), (2, 5, "b", 7, 11.0), (3, 1, "b", 12, 1.5), (4, 1, None, 13, None)]
