"""Operators that learn from all rows, keep state between runs, or cut one stream into parts."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlog.operators import detectors, hawkes, sessions, templates, thresholds, triage
from emberlog.operators.scratch import written

SCHEMA = "seq long, score double"


def plain_trailing(x, calib, window, stride, fit):
    """(i, flag, thr) by a loop over the rows; None among x has a place but no value."""
    z, out = None, []
    for k in range(len(x)):
        flag = None if k < calib or z is None or x[k] is None else x[k] > z
        if k + 1 >= calib and (k + 1 - calib) % stride == 0:
            held = [v for v in x[max(0, k + 1 - window) : k + 1] if v is not None]
            z = fit(np.array(held)) if held else None
        if k >= calib:
            out.append((k - calib, flag, z))
    return out


def scores_of(seed, n):
    rng = np.random.default_rng(seed)
    x = [float(v) for v in np.round(rng.exponential(2, n), 1)]  # with many ties
    for k in rng.integers(0, n, n // 15):
        x[k] = None
    return x


@pytest.mark.parametrize("calib,window,stride,block", [(20, 15, 4, 19), (10, 30, 7, 50), (5, 6, 9, 20)])
def test_blocks_give_the_thresholds_of_one_pass(spark, calib, window, stride, block):
    x = scores_of(1, 140)
    rows = spark.createDataFrame([(k, v, "other") for k, v in enumerate(x)], SCHEMA + ", block_no string").repartition(5)
    got = thresholds.trailing(rows, ["seq"], calib, window, stride, "quantile", 0.1, block_rows=block)
    assert got.columns == ["seq", "score", "block_no", "i", "flag", "thr"]
    want = plain_trailing(x, calib, window, stride, lambda h: float(np.quantile(h, 0.9)))
    for r, (i, flag, z) in zip(got.orderBy("seq").collect(), want, strict=True):
        assert (r.i, r.flag) == (i, flag) and (r.thr is None) == (z is None) and (z is None or abs(r.thr - z) < 1e-9)


def test_sorted_window_is_the_multiset():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 9, 300).astype(float)
    held = thresholds.SortedWindow(x[:50])
    for a in range(0, 200, 10):
        held.move(x[a + 50 : a + 60], x[a : a + 10])
        assert (held.values == np.sort(x[a + 10 : a + 60])).all()
        assert np.isclose(held.quantile(0.83), np.quantile(x[a + 10 : a + 60], 0.83))


@pytest.mark.parametrize("kind", ["quantile", "pot"])
def test_runs_with_state_are_one_run(spark, tmp_path, kind):
    x = scores_of(3, 130)
    table = lambda a, b: spark.createDataFrame(list(enumerate(x))[a:b], SCHEMA)
    args = (20, 15, 4, kind, 0.1, 0.6)
    whole = sorted(map(tuple, thresholds.trailing(table(0, 130), ["seq"], *args).collect()))
    folder, got, cuts = f"{tmp_path}/state", [], [0, 8, 50, 51, 130]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        out = thresholds.trailing_run(table(a, b), ["seq"], folder, f"run {k}", *args).collect()
        before = {v: sorted(os.listdir(f"{folder}/{v}")) for v in os.listdir(folder)}
        again = thresholds.trailing_run(table(a, b), ["seq"], folder, f"run {k}", *args).collect()
        assert sorted(out) == sorted(again) and before == {v: sorted(os.listdir(f"{folder}/{v}")) for v in os.listdir(folder)}
        assert sum(v.startswith("v") for v in before) == min(k + 1, 2)
        got += map(tuple, out)
    assert sorted(got) == whole
    assert thresholds.trailing_run(table(0, 0), ["seq"], folder, "nothing", *args).collect() == []


def test_stream_is_fitted_by_ranges_as_a_whole(spark):
    t = hawkes.thinned(0.8, 1.2, 2.0, 700.0, 1)
    one = hawkes.fit(t)
    rows = spark.createDataFrame([(k, float(v) + 50.0) for k, v in enumerate(t)], "seq long, t_sec double").repartition(3)
    many = hawkes.fit_stream(rows, ["t_sec", "seq"], range_rows=len(t) // 9)
    for a, b in ((one.mu, many.mu), (one.alpha, many.alpha), (one.beta, many.beta), (one.loglik, many.loglik), (one.span, many.span)):
        assert abs(a - b) <= 1e-6 * max(1.0, abs(a))
    assert many.n_events == len(t) and many.converged
    held = hawkes.StreamLikelihood(rows, ["t_sec", "seq"], range_rows=len(t) // 9)
    assert held.packed.count() >= 9 and held.packed.agg(F.max("n")).first()[0] < len(t) / 4  # no task holds the stream
    with pytest.raises(ValueError):
        hawkes.fit_stream(rows.limit(1), ["t_sec", "seq"])


def test_kolmogorov_law():
    """Published values, small sizes by hand, and the series where sizes are large."""
    assert abs(hawkes.kolmogorov_cdf(10, 0.274) - 0.6284796154565) < 1e-12
    for d in (0.55, 0.75, 0.9):
        assert abs(hawkes.kolmogorov_cdf(1, d) - (2 * d - 1)) < 1e-12
    assert abs(hawkes.kolmogorov_cdf(2, 0.4) - 2 * (2 * 0.4 - 0.5) ** 2) < 1e-12  # n! (2 d - 1/n)^n for 1/2n <= d <= 1/n
    assert hawkes.kolmogorov_cdf(5, 0.1) == 0.0 and hawkes.kolmogorov_cdf(5, 1.0) == 1.0
    near = [hawkes.kolmogorov_pvalue(n, 1.2 / np.sqrt(n)) for n in (hawkes.EXACT_KS, hawkes.EXACT_KS + 1)]
    assert abs(near[0] - near[1]) < 2e-4
    rng = np.random.default_rng(5)
    draws = np.sort(rng.uniform(size=(20_000, 8)), axis=1)
    k = np.arange(1, 9)
    d = np.maximum(k / 8 - draws, draws - (k - 1) / 8).max(1)
    assert abs((d < 0.3).mean() - hawkes.kolmogorov_cdf(8, 0.3)) < 0.015


def test_subsamples_are_uniform_over_all_rows(spark):
    n, forest = 4000, detectors.IsolationForest(trees=60, subsample=64)
    rows = written(spark.range(n).select(F.array(F.col("id").cast("double")).alias("features"), F.monotonically_increasing_id().alias("row_no")), "rows")
    drawn = [(r.tree, int(r.features[0])) for r in forest.samples(rows).collect()]
    assert len(drawn) == len(set(drawn)) == 60 * 64 and {t for t, _ in drawn} == set(range(60))
    counts = np.bincount([v * 20 // n for _, v in drawn], minlength=20)
    assert ((counts - 192) ** 2 / 192).sum() < 43.8  # chi-square with 19 degrees, 0.1 %
    assert forest.samples(rows.limit(10)).count() == 600  # all rows where there are few


def test_forest_of_all_rows_separates(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.poisson(5, (600, 3)), rng.poisson(25, (12, 3))]).astype(float)
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "k long, features array<double>")
    model = detectors.IsolationForest(trees=50, subsample=128).fit_rows(rows)
    assert len(model.nodes) == 50 and model.psi == 128
    s = model.score(x)
    assert s[600:].mean() > s[:600].mean() + 0.1
    one = detectors.IsolationForest(trees=3).fit_rows(rows.limit(1))
    assert one.psi == 1 and np.isfinite(one.score(x[:2])).all()


def test_network_gradient_is_that_of_its_loss():
    rng = np.random.default_rng(1)
    network = detectors.Network([4, 5, 2, 5, 4], {1, 3})
    theta, z = network.drawn(rng), rng.normal(size=(7, 4))
    g = network.gradient(theta, z)
    for k in range(0, network.size, 7):
        step = np.zeros_like(theta)
        step[k] = 1e-6
        assert abs((network.errors(theta + step, z).mean() - network.errors(theta - step, z).mean()) / 2e-6 - g[k]) < 1e-6


def test_autoencoder_of_all_rows_learns_as_on_one_array(spark):
    rng = np.random.default_rng(0)
    x = rng.poisson(np.outer(rng.uniform(2, 8, 900), [1, 2, 0.5, 3, 1, 0.2])).astype(float)
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "k long, features array<double>")
    make = lambda **more: detectors.Autoencoder(hidden=(8,), latent=2, epochs=12, rate=5e-3, batch=32, **more)
    local, spread = make().fit(x), make().fit_rows(rows)
    assert np.allclose(local.mean, spread.mean) and np.allclose(local.std, spread.std)
    assert abs(spread.score(x).mean() - local.score(x).mean()) < 0.1 * local.score(x).mean()
    assert spread.history[-1] < 0.8 * spread.history[0] and len(spread.history) <= 12
    with pytest.raises(ValueError):
        make().fit_rows(rows.limit(0))


def test_epoch_averages_tasks_by_rows(spark):
    """Tasks of different sizes: the average of each one's own course, weighted by its rows."""
    rng = np.random.default_rng(3)
    x = rng.poisson(4, (90, 3)).astype(float)
    ae = detectors.Autoencoder(hidden=(4,), latent=2, batch=1000)
    ae.mean, ae.std = np.log1p(x).mean(0), np.log1p(x).std(0) + 1e-6
    network, learner = ae._begun(3)
    held = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "k long, features array<double>")
    table = written(held.repartition(2, F.col("k") < 60).select("features", F.lit(False).alias("held"), (F.col("k") < 60).alias("low")), "tasks").repartition(7, "low")
    parts = [x[:60], x[60:]]
    assert len({r[0] for r in table.select(F.spark_partition_id()).collect()}) == 2
    total = ae._epoch(table.drop("low"), network, learner, 0)
    want = np.zeros(len(learner.packed()))
    for p in parts:  # a batch of 1000: one step a task, whatever the order
        own = detectors.Learner.unpacked(learner.packed())
        own.step(network.gradient(own.theta, ae._scaled(p)), ae.rate)
        want += own.packed() * len(p)
    assert total[0] == 90 and total[1] == 0 and np.allclose(total[3:], want)


def test_course_stops_and_keeps_the_best():
    course = detectors.Course(3)
    went = [course.goes_on(loss, np.array([k])) for k, loss in enumerate([5.0, 4.0, 4.5, 3.9999995, 3.0, 3.5, 3.6, 3.7])]
    assert went == [True] * 7 + [False] and course.best[0] == 4


def route_lines(n):
    rng = np.random.default_rng(7)
    return [f"job {' '.join(f'w{v}' for v in rng.integers(0, 4, 5))}" for _ in range(n)] + ["other line here"]


def test_parts_of_a_route_are_merged_by_the_same_rule(spark):
    lines = list(dict.fromkeys(route_lines(300)))
    rows = spark.createDataFrame(list(enumerate(lines)) + [(10_000, None)], "n long, content string")
    got = {r.content: r.template for r in templates.mine_templates(rows, "n", (), similarity=0.6, part_lines=40).collect()}
    first = {x: k for k, x in enumerate(lines)}
    by_route = {}
    for x in lines:
        t = x.split(" ")
        heads = ["<*>" if any(c.isdigit() for c in w) else w for w in t[:2]]
        by_route.setdefault((len(t), *heads), []).append(x)
    hashes = {r.content: r.h for r in rows.select("content", F.xxhash64("content").alias("h")).collect()}
    want = {None: None}
    for own in by_route.values():
        parts = -(-len(own) // 40)
        named, first_of = {}, {}
        for p in range(parts):
            c = templates.Clusters(0.6)
            part = [x for x in own if parts == 1 or hashes[x] % parts == p]
            at = [c.add(x.split(" ")) for x in part]
            for x, k in zip(part, at, strict=True):
                named[x] = c.templates()[k]
                first_of[named[x]] = min(first_of.get(named[x], 1 << 60), first[x])
        if parts > 1:
            c = templates.Clusters(0.6)
            order = sorted(first_of, key=lambda t: (first_of[t], t))
            final = dict(zip(order, [c.add(t.split(" ")) for t in order], strict=True))
            named = {x: c.templates()[final[t]] for x, t in named.items()}
        want |= named
    assert max(map(len, by_route.values())) > 80 and got == want


def test_null_lines_stay(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, None), (3, "a c"), (4, "")], "n long, content string")
    got = templates.mine_templates(rows, "n", ()).orderBy("n").collect()
    assert [(r.content, r.template is None, r.event_id is None) for r in got] == [("a b", False, False), (None, True, True), ("a c", False, False), ("", False, False)]


def incidents_of(spark, n):
    rows = [(str(k), k * 1000, 0.5, f"e{k}", [f"template {k}"], k) for k in range(n)]
    t = spark.createDataFrame(rows, "id string, s long, score double, entity string, templates array<string>, seq long")
    return triage.incidents(triage.correlate(triage.dedup(t.withColumn("timestamp", F.timestamp_seconds("s")).drop("s"))))


def test_each_incident_is_asked_once(spark, tmp_path):
    """A task that dies between two answers is run again, and later calls ask nothing."""
    found, asked_dir = incidents_of(spark, 6).coalesce(1), str(tmp_path / "asked")
    os.makedirs(asked_dir)
    answer = json.dumps({"priority": "P2", "category": "network", "summary": "s", "recommended_action": "r", "explanation": "x"})

    def backend(prompt):
        n = len(os.listdir(asked_dir))
        with open(f"{asked_dir}/{n}", "w") as f:
            f.write(prompt)
        return answer

    store = triage.Answers(f"{tmp_path}/answers")
    rows = [(r.h, r.p) for r in triage.explained(found).select(F.sha2(triage.prompt(found), 256).alias("h"), triage.prompt(found).alias("p")).collect()]
    with pytest.raises(RuntimeError):  # a task that fails after three answers
        for k, (h, p) in enumerate(rows):
            if k == 3:
                raise RuntimeError("lost")
            store.of(h, p, backend)
    for _ in range(2):
        out = triage.asked(found, backend, f"{tmp_path}/answers").collect()
        assert len(out) == 6 and {r.priority for r in out} == {"P2"} and {r.summary for r in out} == {"s"}
        assert len(os.listdir(asked_dir)) == 6
    texts = {open(f"{asked_dir}/{n}").read() for n in os.listdir(asked_dir)}
    assert len(texts) == 6


def test_lines_are_split_as_by_the_pattern(spark):
    """Each line is matched once; marks in the line, line ends and lines of another form make no difference."""
    import re

    from emberlog.functions.scalars import header_pattern
    from emberlog.sources import logs

    form = logs.log_format("BGL")
    pattern, names = header_pattern(form.log_format)
    good = "- 1 2005.06.03 R02 2005-06-03-15.42.50.675872 R02 RAS KERNEL INFO text of $1 and \\2"
    lines = [good, "no such line", "", None, good + " with \x1e and \x1f in it", "x\x1fy", good.replace(" RAS", "  RAS"), good + "\r"]
    got = logs.parse_lines(spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "k long, line string").withColumn("fields", F.lit(1)), form)
    assert got.columns == ["k", "line", "fields", *names]
    want = [(k, *m.groups()) for k, x in enumerate(lines) if x is not None and (m := re.match(pattern, x.removesuffix("\r")))]
    assert sorted(tuple(r) for r in got.select("k", *names).collect()) == want and len(want) == 4


def test_bracketed_quantiles(spark):
    """Ties within and around the bracket, and sizes beyond its accuracy."""
    from emberlog.operators.ordered import quantile

    rng = np.random.default_rng(8)
    for values in (rng.normal(size=30_000), rng.integers(0, 3, 30_000).astype(float), np.concatenate([np.zeros(29_000), rng.normal(size=1000)])):
        table = spark.createDataFrame([(float(v),) for v in values], "x double").repartition(3)
        for p in (0.02, 0.98):
            assert abs(quantile(table, "x", p, "z").first().z - np.quantile(values, p)) < 1e-9


def test_places_within_hot_keys(spark):
    """One key holds most rows and lies in several ranges; keys may be NULL."""
    from emberlog.operators.ordered import with_place_in

    rng = np.random.default_rng(9)
    keys = [None if v == 0 else "hot" if v < 7 else f"k{v}" for v in rng.integers(0, 10, 400)]
    rows = [(k, int(n), "x") for n, k in zip(rng.permutation(400), keys, strict=True)]
    got = with_place_in(spark.createDataFrame(rows, "key string, n long, base string"), "key", ["n"])
    assert got.columns == ["key", "n", "base", "place"]
    order = {}
    for k, n, _ in sorted(rows, key=lambda r: r[1]):
        order.setdefault(k, []).append(n)
    assert all(order[r.key][r.place] == r.n for r in got.collect()) and got.count() == 400
    segments = sessions.key_segments(spark.createDataFrame([(k, n, f"e{n}", n) for k, n, _ in rows], "key string, n long, event_id string, timestamp long"), "key", ["n"], 16)
    assert segments.agg(F.max("n_events")).first()[0] == 16
    for r in segments.collect():
        assert r.event_seq == [f"e{n}" for n in order[r.key][r.segment_no * 16 : r.segment_no * 16 + 16]]


def test_unit_histogram_has_its_empty_bins(spark):
    from emberlog.operators.quality import unit_histogram

    rows = spark.createDataFrame([(1,), (4,), (4,), (0,), (None,)], "n int")
    assert sorted(map(tuple, unit_histogram(rows, "n", 1).collect())) == [(1, 1), (2, 0), (3, 0), (4, 2)]
    assert unit_histogram(rows.limit(0), "n").collect() == []


@pytest.mark.parametrize("part_lines", [40, 50_000])
def test_counts_of_templates_are_those_of_the_lines(spark, part_lines):
    """Whole, in parts, with repeated and NULL lines."""
    text = [f"open {'ab'[k % 2]} x{k % 61} y{k % 7} z" if k % 3 else f"close n{k % 5}" for k in range(400)] + [None, None]
    rows = spark.createDataFrame(list(enumerate(text)), "n long, content string")
    lines = templates.mine_templates(rows, "n", (), similarity=0.6, part_lines=part_lines).groupBy("template", "event_id").count()
    got = templates.template_counts(rows, "n", (), similarity=0.6, part_lines=part_lines)
    assert sorted(map(str, got.select("template", "event_id", "n").collect())) == sorted(str(r).replace("count=", "n=") for r in lines.collect())
