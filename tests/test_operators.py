"""Small frames with exact answers, seeded simulations with tolerances, and error paths."""

from datetime import datetime as D

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from emberlog.functions import scalars as S
from emberlog.operators import detectors, hawkes, metrics, ordered, quality, sessions, templates, thresholds, triage, windows
from emberlog.sources import logs


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


EVENTS = [(0, D(2008, 11, 9, 20, 35, 15), "E1", ["blk_1"], "t1", "INFO", "a"), (1, D(2008, 11, 9, 20, 35, 16), "E2", ["blk_1", "blk_2"], "t2", "INFO", "b"), (2, D(2008, 11, 9, 20, 35, 18), "E1", [], "t1", "WARN", "c")]
EVENTS_SCHEMA = "seq long, timestamp timestamp_ntz, event_id string, block_ids array<string>, template string, level string, content string"


def test_key_pattern(spark):
    rows = [("added to blk_7128370237687728475 size blk_7128370237687728475",), ("delete blk_-1608999687919862906",), ("no block here",)]
    got = [r[0] for r in frame(spark, rows, "c string").select(S.keys_in(F.col("c"))).collect()]
    assert got == [["blk_7128370237687728475"], ["blk_-1608999687919862906"], []]


def test_compact_and_micro_times(spark):
    got = frame(spark, [("081109", "203515"), ("081109", "35515")], "d string, t string").select(S.compact_timestamp(F.col("d"), F.col("t"))).collect()
    assert [r[0] for r in got] == [D(2008, 11, 9, 20, 35, 15), D(2008, 11, 9, 3, 55, 15)]
    rows = [("-", "2005-06-03-15.42.50.675872", "E1", "t", "n", "c", "INFO", "x"), ("KERNDTLB", "2005-06-04-08.01.02.000123", "E1", "t", "n", "c", "INFO", "x"), ("-", "GARBAGE", "E1", "t", "n", "c", "INFO", "x")]
    out = logs.canonical_nodes(frame(spark, rows, "Label string, Time string, EventId string, EventTemplate string, Node string, Component string, Level string, Content string")).orderBy("timestamp").collect()
    assert [r.label for r in out] == [0, 1] and out[0].timestamp.microsecond == 675872
    with pytest.raises(NotImplementedError):
        logs.log_format("other")


def test_formats_csv_and_json(spark, tmp_path):
    line = "081109 203615 148 INFO dfs.DataNode$PacketResponder: PacketResponder 1 for block blk_38865049064139660 ends"
    row = logs.parse_lines(frame(spark, [(line,), ("other",)], "line string"), logs.log_format("HDFS")).collect()
    assert len(row) == 1 and (row[0].Date, row[0].Pid, row[0].Level, row[0].Component) == ("081109", "148", "INFO", "dfs.DataNode$PacketResponder") and row[0].Content.startswith("PacketResponder 1")
    (tmp_path / "s.csv").write_text('LineId,Date,Time,Level,Component,Content,EventId,EventTemplate\n1,081109,000515,INFO,c,"says ""blk_1"", ok",E1,t\n')
    csv = logs.read_structured(spark, str(tmp_path / "s.csv"), "LineId Date Time Level Component Content EventId EventTemplate".split())
    got = logs.canonical_blocks(csv).first()
    assert got.timestamp == D(2008, 11, 9, 0, 5, 15) and got.block_ids == ["blk_1"] and got.content == 'says "blk_1", ok'
    (tmp_path / "l.csv").write_text("BlockId,Label\na,Normal\nb,Anomaly\nc,odd\n")
    assert {r.block_id: r.label for r in logs.read_labels(spark, str(tmp_path / "l.csv")).collect()} == {"a": 0, "b": 1, "c": None}
    logs.write_events(frame(spark, EVENTS, EVENTS_SCHEMA), str(tmp_path / "e"), "csv")
    back = logs.read_canonical_csv(spark, str(tmp_path / "e"), "seq long, timestamp timestamp_ntz, event_id string, block_ids string, template string, level string, content string")
    assert sorted(r.block_ids for r in back.collect()) == ["", "blk_1", "blk_1 blk_2"]
    logs.write_records(frame(spark, [(1, None)], "a int, b string"), str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).first()[0] == '{"a":1,"b":null}' == logs.as_json(frame(spark, [(1, None)], "a int, b string")).first()[0]


def test_sessions(spark):
    lines = sessions.explode_keys(frame(spark, EVENTS, EVENTS_SCHEMA), "block_ids")
    assert lines.count() == 3 and {r.block_id for r in lines.collect()} == {"blk_1", "blk_2"}
    got = {r.block_id: r for r in sessions.labeled(sessions.key_sessions(lines, "block_id", ["seq"]), frame(spark, [("blk_1", 0), ("blk_2", 1)], "block_id string, label int"), "block_id").collect()}
    assert got["blk_1"].event_seq == ["E1", "E2"] and got["blk_1"].n_events == 2 and got["blk_2"].label == 1


def test_quality(spark):
    r = quality.quality_report(frame(spark, EVENTS, EVENTS_SCHEMA), ["seq"], "block_ids").first()
    assert (r.null_cells, r.exact_duplicate_rows, r.time_monotonic, r.tie_fraction, r.n_templates, r.lines_without_key, r.n_keys) == (0, 0, True, 0.0, 2, 1, 2)
    flags = {f.check: f.flag for f in quality.quality_flags(quality.quality_report(frame(spark, EVENTS, EVENTS_SCHEMA), ["seq"], "block_ids")).collect()}
    assert flags == {"single_event_keys": False, "coarse_time": False, "unsorted": False, "null_cells": False, "duplicate_rows": False}


MATRIX = [(D(2008, 11, 9, 20, 0, 0), "E1", "a"), (D(2008, 11, 9, 20, 0, 2), "E2", "a"), (D(2008, 11, 9, 20, 5, 0), "E1", "b"), (D(2008, 11, 9, 20, 10, 0), "E3", "c"), (D(2008, 11, 9, 20, 10, 1), "E3", "c")]


def test_matrix_and_split(spark):
    lines = frame(spark, MATRIX, "timestamp timestamp_ntz, event_id string, block_id string")
    vocab = sessions.vocabulary(lines)
    wide = {r.block_id: [r[v] for v in vocab] for r in sessions.count_matrix(lines, "block_id", vocab).collect()}
    assert vocab == ["E1", "E2", "E3"] and wide == {"a": [1, 1, 0], "b": [1, 0, 0], "c": [0, 0, 2]}
    assert {r.block_id: list(r.features) for r in sessions.count_vectors(lines, "block_id", vocab).collect()} == {k: list(map(float, v)) for k, v in wide.items()}
    meta = sessions.session_meta(lines, "block_id").withColumn("label", F.lit(0))
    split = sessions.temporal_split(meta, "block_id", 2 / 3)
    assert {r.block_id: r.split for r in split.collect()} == {"a": "train", "b": "train", "c": "test"}
    s = sessions.split_summary(split).first()
    assert (s.n_train, s.n_test, s.boundary) == (2, 1, D(2008, 11, 9, 20, 5, 0))
    for bad in (0.0, 1.0, 1.5):
        with pytest.raises(ValueError):
            sessions.temporal_split(meta, "block_id", bad)


def test_operating_point_and_ap(spark):
    def point(labels, recall):
        rows = [(k, float(5 - k), y) for k, y in enumerate(labels)]
        return metrics.operating_point(frame(spark, rows, "k long, score double, label int"), ["k"], recall).first()

    p = point([1, 1, 0, 0, 0], 1.0)
    assert (p.fp, p.tp, p.precision) == (0, 2, 1.0)
    p = point([1, 0, 1, 0, 0], 1.0)
    assert (p.fp, p.tp) == (1, 2) and abs(p.precision - 2 / 3) < 1e-9
    p = point([1, 1, 0, 0, 0], 0.5)
    assert (p.recall, p.tp, p.fp) == (0.5, 1, 0)
    with pytest.raises(ValueError):
        point([0, 0, 0, 0], 0.9)
    ap = lambda s: metrics.average_precision(frame(spark, [(x, y) for x, y in zip(s, [0, 0, 1, 1], strict=True)], "score double, label int")).first()[0]
    assert ap([0.1, 0.2, 0.9, 0.8]) == 1.0 and ap([0.9, 0.8, 0.2, 0.1]) < 1
    times = [D(2008, 11, 9), D(2008, 11, 9, 6), D(2008, 11, 10, 6), D(2008, 11, 10, 12), D(2008, 11, 11)]
    rows = [(k, float(5 - k), y, t) for k, (y, t) in enumerate(zip([1, 0, 1, 0, 0], times, strict=True))]
    f = metrics.false_alarms_per_day(frame(spark, rows, "k long, score double, label int, timestamp timestamp_ntz"), ["k"], "timestamp", 1.0).first()
    assert f.fp == 1 and abs(f.fa_per_day - 0.5) < 1e-9
    drift = metrics.drift_report(frame(spark, rows, "k long, score double, label int, timestamp timestamp_ntz"), ["k"], 4, 1.0).orderBy("bin").collect()
    assert [r.n for r in drift] == [2, 1, 2] and [r.bin for r in drift] == [1, 3, 4]  # the empty bin is left out, the last one is closed


def loop(scores, calib, window, stride, fit):
    held, out = list(scores[:calib][-window:]), []
    z = fit(held)
    for i, x in enumerate(scores[calib:]):
        flag = x > z
        held = (held + [x])[-window:]
        if (i + 1) % stride == 0:
            z = fit(held)
        out.append((i, bool(flag), z))
    return out


@pytest.mark.parametrize("window", [40, 100])
def test_trailing_quantile_is_the_loop(spark, window):
    rng = np.random.default_rng(4)
    x = rng.choice([-12.0, -8.0, -4.0, 0.0], 400, p=[0.6, 0.25, 0.1, 0.05]) + rng.random(400)
    scores = frame(spark, [(k, float(v)) for k, v in enumerate(x)], "k long, score double")
    got = [(r.i, r.flag, r.thr) for r in thresholds.rolling_quantile(scores, ["k"], 60, window, 25, 0.05).orderBy("i").collect()]
    want = loop(list(x), 60, window, 25, lambda h: float(np.quantile(h, 0.95)))
    assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want])


def test_pot(spark):
    rng = np.random.default_rng(0)
    calib, fresh = rng.exponential(size=100_000), rng.exponential(size=100_000)
    r = thresholds.pot_threshold(spark.createDataFrame([(float(v),) for v in calib], "score double"), 0.01, 0.95).first()
    assert 0.005 < (fresh > r.z).mean() < 0.02
    flat = thresholds.pot_threshold(frame(spark, [(1.0,)] * 5, "score double"), 0.01).first()
    assert flat.z == flat.t == 1.0 and flat.n_peaks == 0


def test_excitation(spark):
    rows = frame(spark, [(0, 0.0), (1, 0.5), (2, 2.0)], "k long, t double")
    out = ordered.with_excitation(ordered.in_ranges(rows, ["t", "k"]), "t", ["t", "k"], {"a": 1.0}).orderBy("k").collect()
    assert np.allclose([r.a for r in out], [0, 0.6065307, 0.3584652], atol=1e-6)
    rng = np.random.default_rng(1)
    t = np.sort(np.concatenate([rng.uniform(0, 5000, 800), np.repeat(2500.0, 5)]))
    rows = frame(spark, [(k, float(v)) for k, v in enumerate(t)], "k long, t double")
    got = np.array([r.a for r in ordered.with_excitation(ordered.in_ranges(rows, ["t", "k"]), "t", ["t", "k"], {"a": 0.7}).orderBy("k").collect()])
    want, a = [], 0.0
    for k in range(len(t)):
        a = np.exp(-0.7 * (t[k] - t[k - 1])) * (1 + a) if k else 0.0
        want.append(a)
    assert np.allclose(got, want, atol=1e-9)


def test_intensity_is_strictly_before(spark):
    events = frame(spark, [(0, 1.0), (1, 1.0), (2, 3.0)], "k long, t_sec double")
    grid = frame(spark, [(0.0,), (1.0,), (2.0,), (3.0,), (4.0,)], "g double")
    got = [r.intensity for r in hawkes.intensity_on_grid(events, grid, ["t_sec", "k"], 0.5, 2.0, 1.0).orderBy("g").collect()]
    e = np.exp
    assert np.allclose(got, [0.5, 0.5, 0.5 + 4 * e(-1), 0.5 + 4 * e(-2), 0.5 + 2 * (2 * e(-3) + e(-1))])


def test_hawkes(spark):
    t = hawkes.thinned(0.8, 1.2, 2.0, 8000, 1)
    f = hawkes.fit(t)
    assert f.converged and abs(f.mu / 0.8 - 1) < 0.15 and abs(f.alpha / 1.2 - 1) < 0.2 and abs(f.beta / 2 - 1) < 0.2 and abs(f.branching_ratio - 0.6) < 0.08 and f.subcritical
    rows = frame(spark, [(k, float(v - t[0])) for k, v in enumerate(t)], "k long, t_sec double")
    gaps = hawkes.rescaled_gaps(hawkes.with_rate(rows, ["t_sec", "k"], f.mu, f.alpha, f.beta), ["t_sec", "k"])
    good = hawkes.ks_test(gaps, ["k"]).first()
    assert abs(good.mean_gap - 1) < 0.1 and good.ks_pvalue > 0.01 and gaps.where("gap <= 0").count() == 0
    bad = hawkes.rescaled_gaps(hawkes.with_rate(rows, ["t_sec", "k"], len(t) / 8000, 1e-9, 1.0), ["t_sec", "k"])
    assert hawkes.ks_test(bad, ["k"]).first().ks_pvalue < 0.01
    like = lambda *p: hawkes.negative_log_likelihood(np.log(p), t - t[0], float(t[-1] - t[0]))[0]
    assert like(0.8, 1.2, 2.0) < like(0.01, 0.01, 0.01)
    x = np.log([0.7, 1.0, 1.8])
    value, grad = hawkes.negative_log_likelihood(x, t, float(t[-1]))
    near = [(hawkes.negative_log_likelihood(x + 1e-6 * d, t, float(t[-1]))[0] - value) / 1e-6 for d in np.eye(3)]
    assert np.allclose(grad, near, rtol=1e-3, atol=0.5)


ANOMALIES = "id string, timestamp timestamp_ntz, score double, entity string, templates array<string>, seq long"


def anomaly(k, second, score, entity, templates=("Deleting block <*>",), minute=0):
    return (str(k), D(2008, 11, 11, 8, minute, second), score, entity, list(templates), k)


def test_dedup_and_correlate(spark):
    rows = frame(spark, [anomaly(1, 0, 0.4, "blk_1"), anomaly(2, 1, 0.9, "blk_1"), anomaly(3, 2, 0.5, "blk_2")], ANOMALIES)
    out = triage.dedup(rows).collect()
    assert len(out) == 2 and max(r.score for r in out) == 0.9 and {r.entity: r.dedup_n for r in out} == {"blk_1": 2, "blk_2": 1}
    rows = frame(spark, [anomaly(1, 0, 0.4, "a"), anomaly(2, 10, 0.4, "b"), anomaly(3, 0, 0.4, "a", minute=5), anomaly(4, 30, 0.4, "a", minute=5), anomaly(5, 31, 0.4, "a", minute=6)], ANOMALIES)
    assert [r.incident_no for r in triage.correlate(rows, 30.0).orderBy("seq").collect()] == [1, 1, 2, 2, 3]  # a gap of the limit merges
    rows = frame(spark, [anomaly(k, k, 0.4, e) for k, e in enumerate("ABAA")] + [anomaly(9, 0, 0.4, "A", minute=9)], ANOMALIES)
    assert [r.incident_no for r in triage.correlate(rows, 30.0, True).orderBy("seq").collect()] == [1, 2, 3, 3, 4]
    assert triage.correlate(rows.limit(0)).collect() == []


def test_categories_and_priorities(spark):
    rows = frame(spark, [(["Deleting block <*>"],), (["kernel INFO instruction cache parity error"],), (["something totally generic"],), (["new task"],)], "t array<string>")
    assert [r[0] for r in rows.select(triage.category(F.col("t"))).collect()] == ["data_loss", "hardware_fault", "unknown", "replication_failure"]
    hot = [anomaly(k, k, 0.9, "blk_hot") for k in range(25)] + [("x", D(2008, 11, 11, 9), 0.1, "blk_cold", ["t"], 99)]
    out = triage.triage(frame(spark, hot, ANOMALIES)).orderBy("rank").collect()
    assert [(r.priority, r.n_anomalies, r.dedup_count) for r in out] == [("P1", 1, 25), ("P4", 1, 1)] and out[0].id == "INC-0001" and out[0].entities == ["blk_hot"]
    assert all(out[0][f] for f in triage.FIELDS) and out[0].start == "2008-11-11 08:00:00"


def test_backend_falls_back(spark):
    rows = frame(spark, [anomaly(1, 0, 0.9, "a"), anomaly(2, 0, 0.1, "b", minute=9)], ANOMALIES)

    def backend(text):
        import json

        if "INC-0002" in text:
            raise RuntimeError("no service")
        return json.dumps({"priority": "P3", "category": "network", "summary": "s", "recommended_action": "r", "explanation": "e"})

    got = {r.id: (r.priority, r.category) for r in triage.triage(rows, backend=backend).collect()}
    assert got == {"INC-0001": ("P3", "network"), "INC-0002": ("P4", "data_loss")}
    assert triage.valid_answer('{"priority": "P9"}') is None and triage.valid_answer("no json") is None


def test_severity_and_context(spark):
    rows = frame(spark, [(k, s) for k, s in enumerate([1.0, 2.0, 2.0, 3.0])], "k long, score double")
    assert [r.severity for r in triage.severity_rank(rows).orderBy("k").collect()] == [0.25, 0.625, 0.625, 1.0]
    lines = frame(spark, [(1, n, f"t{n % 3}", f"line {n}") for n in range(9)], "k long, n long, template string, content string")
    got = triage.with_context(rows.limit(2), lines, "k", ["n"], 2, 4).orderBy("k").collect()
    assert got[0].templates == [] and got[1].templates == ["t0", "t1"] and got[1].context == [f"line {n}" for n in range(4)]


def test_windows(spark):
    rows = [(k, D(2024, 1, 1, 0, 0, 30) if k == 0 else D(2024, 1, 1, 0, 2, k), "ab"[k % 2], int(k == 3)) for k in range(4)]
    out = windows.window_features(frame(spark, rows, "seq long, timestamp timestamp_ntz, event_id string, label int"), ["t_sec", "seq"], 60.0, 5).orderBy("win").collect()
    assert [(r.win, r.n_events, r.label, r.a, r.b) for r in out] == [(0, 1, 0, 1, 0), (1, 3, 1, 1, 2)]
    assert {"exc_mean_1", "exc_max_1", "exc_mean_0.03333", "exc_max_0.03333"} <= set(out[0].asDict()) and out[0]["exc_max_1"] == 0.0


def count_rows(rng, n, dims):
    x = np.zeros((n, 12))
    x[:, dims] = rng.poisson(5, (n, len(dims)))
    return x


@pytest.mark.parametrize("model", [detectors.IsolationForest(), detectors.Autoencoder(epochs=60)])
def test_detectors_separate(spark, model):
    rng = np.random.default_rng(0)
    normal, odd = count_rows(rng, 400, [0, 1, 2]), count_rows(rng, 40, [8, 9, 10, 11])
    with pytest.raises(ValueError):
        model.score(normal)
    model.fit(normal)
    a, b = model.score(normal), model.score(odd)
    assert np.isfinite(a).all() and (b.mean() > 3 * a.mean() if isinstance(model, detectors.Autoencoder) else b.mean() > a.mean() + 0.05)
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(normal[:5])], "k long, features array<double>")
    assert np.allclose([r.score for r in detectors.with_score(rows, model).orderBy("k").collect()], a[:5])


def test_templates(spark):
    text = ["Receiving block blk_1 src 10.0.0.1:50", "Receiving block blk_2 src 10.0.0.2:51", "user alice logged in from home", "user bob logged in from work", "user eve logged in from home", "done"]
    out = templates.mine_templates(frame(spark, list(enumerate(text)), "n long, content string"), "n", S.BLOCK_MASKS).orderBy("n").collect()
    assert out[0].template == out[1].template == "Receiving block <*> src <*>" and out[0].event_id == out[1].event_id and out[5].template == "done"


def test_parse_stage_in_one_call(spark, tmp_path):
    lines = [
        "081109 203615 148 INFO dfs.DataNode$PacketResponder: PacketResponder 1 for block blk_38865049064139660 terminating",
        "081109 203807 222 INFO dfs.DataNode$PacketResponder: PacketResponder 0 for block blk_-6952295868487656571 terminating",
        "no line of this form",
        "081109 204005 35 INFO dfs.FSNamesystem: Starting thread",
    ]
    with open(tmp_path / "raw.log", "w") as f:
        f.write("\n".join(lines))
    counts = logs.parsed_table(spark, str(tmp_path / "raw.log"), "HDFS", str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("timestamp").collect()
    assert counts == {"lines": 4, "parsed": 3, "kept": 3}
    assert [r.block_ids for r in got] == [["blk_38865049064139660"], ["blk_-6952295868487656571"], []]
    assert got[0].event_id == got[1].event_id != got[2].event_id


def test_records_are_read_as_written(spark, tmp_path):
    rows = frame(spark, [("INC-0001", None, 2.5), ("INC-0002", "P1", 1.0)], "id string, priority string, max_score double")
    logs.write_records(rows, str(tmp_path / "r"))
    back = logs.read_records(spark, str(tmp_path / "r"), "id string, priority string, max_score double")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    assert [r.priority for r in triage.one_incident(back, "INC-0002").collect()] == ["P1"]


def test_clusters_follow_the_plain_rule():
    def plain(lines, similarity):
        held, out = [], []
        for tokens in lines:
            keys = [(sum(a == b != "<*>" for a, b in zip(t, tokens)) / len(tokens), t.count("<*>")) for t in held]
            best = max(range(len(keys)), key=lambda k: (keys[k], -k), default=None)
            if best is not None and keys[best][0] >= similarity:
                held[best] = [a if a == b else "<*>" for a, b in zip(held[best], tokens)]
            else:
                held.append(list(tokens))
                best = len(held) - 1
            out.append(best)
        return out, [" ".join(t) for t in held]

    rng = np.random.default_rng(3)
    for length in (1, 4, 7):
        lines = [[("<*>" if w == 0 else f"w{w}") for w in rng.integers(0, 5, length)] for _ in range(300)]
        c = templates.Clusters(0.5)
        assert ([c.add(x) for x in lines], c.templates()) == plain(lines, 0.5)


def test_routes_stream_through_batches():
    lines = [("r1", "a b"), ("r1", "a c"), ("r1", "x y"), ("r2", "p"), ("r3", "q")]
    batches = [pd.DataFrame(lines[a:b], columns=["route", "masked_line"]) for a, b in ((0, 1), (1, 2), (2, 5))]
    got = pd.concat(list(templates._mined(iter(batches), 0.5)))
    named = {(r.route, r.cluster): r.template for r in got.itertuples() if r.masked_line is None}
    assert [(r.masked_line, named[r.route, r.cluster]) for r in got.itertuples() if r.masked_line is not None] == [("a b", "a <*>"), ("a c", "a <*>"), ("x y", "x y"), ("p", "p"), ("q", "q")]


def test_decayed_states_are_plain_sums():
    rng = np.random.default_rng(4)
    t = np.sort(np.round(rng.uniform(0, 2000, 150), 1))
    for beta in (0.01, 1.0, 30.0):
        a, b = hawkes._states(t, beta)
        lag = t[:, None] - t[None, :]
        before = np.tri(len(t), k=-1) > 0
        weight = np.where(before, np.exp(-beta * np.where(before, lag, 0)), 0)
        assert np.allclose(a, weight.sum(1), rtol=1e-9, atol=1e-12)
        assert np.allclose(b, (weight * np.where(before, lag, 0)).sum(1), rtol=1e-9, atol=1e-9)


def test_small_groups_are_not_fitted(spark):
    rows = [(1, float(k * k % 977)) for k in range(120)] + [(2, 1.0)] * 5 + [(None, float(k)) for k in range(110)]
    got = hawkes.fit_groups(frame(spark, rows, "g long, t_sec double"), ["g"]).collect()
    assert sorted((r.g is None, r.n_events) for r in got) == [(False, 120), (True, 110)]


def test_missing_label_is_an_alert_and_times_have_no_zone(spark):
    rows = [(None, "2005-03-27-02.30.00.5"), ("-", "2005-06-03-15.42.50.363779"), ("-", "2005-13-03-15.42.50.363779"), ("-", "yesterday"), ("-", None)]
    t = frame(spark, rows, "Label string, Time string").withColumns({c: F.lit("x") for c in ("EventId", "EventTemplate", "Node", "Component", "Level", "Content")})
    out = logs.canonical_nodes(t)
    assert dict(out.dtypes)["timestamp"] == "timestamp_ntz"
    assert [(str(r.timestamp), r.label) for r in out.orderBy("timestamp").collect()] == [("2005-03-27 02:30:00.500000", 1), ("2005-06-03 15:42:50.363779", 0)]
