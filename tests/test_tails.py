"""Thresholds on simulated scores: the tail's shape, and streams that stay or drift."""

import numpy as np
from pyspark.sql import functions as F

from emberlog.operators import ordered, thresholds


def scores(spark, values):
    import pandas as pd

    return spark.createDataFrame(pd.DataFrame({"i0": np.arange(len(values)), "score": np.asarray(values, float)}), "i0 long, score double")


def rates(spark, flagged, since):
    return flagged.where(F.col("i") >= since).agg(F.avg(F.col("flag").cast("double"))).first()[0]


def test_tail_of_exponential_excesses(spark):
    x = np.random.default_rng(1).exponential(2.0, 50_000)
    n, mean, var = F.lit(len(x)), F.lit(float(x.mean())), F.lit(float(x.var()))
    gamma, sigma = spark.range(1).select(*[c.alias(k) for c, k in zip(thresholds.tail(n, mean, var), "gs", strict=True)]).first()
    assert abs(gamma) < 0.05 and abs(sigma - 2.0) < 0.15


def test_static_threshold_holds_its_rate(spark):
    rng = np.random.default_rng(0)
    z = thresholds.pot_threshold(scores(spark, rng.exponential(size=200_000)), 0.01, 0.95).first().z
    assert 0.005 < (rng.exponential(size=200_000) > z).mean() < 0.02


def test_adaptive_threshold_on_a_stationary_stream(spark):
    out = thresholds.adaptive_pot(scores(spark, np.random.default_rng(2).exponential(size=120_000)), ["i0"], 20_000, 20_000, 500, 0.01, 0.95)
    assert 0.005 < rates(spark, out, 0) < 0.02


def test_adaptive_threshold_follows_a_drift(spark):
    rng = np.random.default_rng(3)
    table = scores(spark, rng.exponential(np.linspace(1.0, 3.0, 120_000)))
    late = 60_000
    z = thresholds.pot_threshold(table.where("i0 < 20000"), 0.01, 0.95).first().z
    fixed = table.where("i0 >= 80000").agg(F.avg((F.col("score") > z).cast("double"))).first()[0]
    adaptive = rates(spark, thresholds.adaptive_pot(table, ["i0"], 20_000, 20_000, 500, 0.01, 0.95), late)
    assert fixed > 0.05 and adaptive < 0.03 and adaptive < fixed / 3


def test_trailing_quantile_on_discrete_drifting_scores(spark):
    rng = np.random.default_rng(4)
    values = np.concatenate([rng.choice([-12.0, -8.0, -4.0, 0.0], 45_000, p=p) for p in ([0.6, 0.25, 0.1, 0.05], [0.1, 0.2, 0.3, 0.4])])
    table = scores(spark, values)
    fixed = rates(spark, thresholds.fixed_flags(table, ["i0"], 20_000, 0.05), 45_000)
    rolling = rates(spark, thresholds.rolling_quantile(table, ["i0"], 20_000, 20_000, 500, 0.05), 45_000)
    assert fixed > 0.2 and rolling < 0.12 and rolling < fixed / 2


def test_quantile_by_position(spark):
    rng = np.random.default_rng(5)
    for values in ([3.0], [1.0, 2.0], rng.integers(0, 5, 1000), rng.normal(size=777)):
        table = scores(spark, values)
        for p in (0.0, 0.5, 0.98, 1.0):
            assert abs(ordered.quantile(table, "score", p, "z").first().z - np.quantile(np.asarray(values, float), p)) < 1e-9
    assert ordered.quantile(scores(spark, []), "score", 0.5, "z").first().z is None
