"""Self-exciting point process with an exponential kernel: fit, validation, intensity, simulation.

Rate at t: mu + alpha * sum over earlier events of exp(-beta (t - s)); branching ratio alpha / beta.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordered import in_ranges, quantile, with_excitation, with_position, with_previous
from .scratch import written


@dataclass(frozen=True)
class HawkesFit:
    mu: float
    alpha: float
    beta: float
    loglik: float
    n_events: int
    span: float
    converged: bool

    @property
    def branching_ratio(self) -> float:
        return self.alpha / self.beta

    @property
    def subcritical(self) -> bool:
        return self.branching_ratio < 1


def _states(t: np.ndarray, beta: float, held_a: float = 0.0, held_b: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """The decayed counts A and their derivative by beta, -B; B = sum of (t - s) exp(-beta (t - s)).

    held_a and held_b: those at the first time. In blocks, as decayed_counts(): a block's
    exponentials can be summed directly, and what went before it is one decayed number for A
    and one for B.
    """
    a, b = np.zeros(len(t)), np.zeros(len(t))
    first = 0
    while first < len(t):
        end = max(first + 1, int(np.searchsorted(t, t[first] + 300.0 / beta, "right")))
        since = t[first:end] - t[first]
        x = np.exp(beta * since)
        weights = held_a + np.concatenate([[0.0], np.cumsum(x)[:-1]])
        moments = np.concatenate([[0.0], np.cumsum(since * x)[:-1]])
        a[first:end] = weights / x
        b[first:end] = (held_b + since * weights - moments) / x
        if end < len(t):
            held_a, held_b = _onward(t[end] - t[end - 1], beta, 1 + a[end - 1], b[end - 1])
        first = end
    return a, b


def _onward(step: float, beta: float, a: float, b: float) -> tuple[float, float]:
    """A state, its own event counted, a time step later."""
    faded = np.exp(-beta * step)
    return faded * a, faded * (b + step * a)


def likelihood_sums(t: np.ndarray, span: float, mu: float, alpha: float, beta: float, held_a: float = 0.0, held_b: float = 0.0) -> np.ndarray:
    """What a stretch of events adds to the likelihood and its gradient; sums of stretches are those of the stream."""
    a, b = _states(t, beta, held_a, held_b)
    rate = mu + alpha * a
    left = span - t
    with np.errstate(all="ignore"):
        bad = np.count_nonzero(~(rate > 0) | ~np.isfinite(rate))
        return np.array([np.log(rate).sum(), (1 - np.exp(-beta * left)).sum(), (1 / rate).sum(), (a / rate).sum(), (b / rate).sum(), (left * np.exp(-beta * left)).sum(), bad], float)


def _from_sums(sums: np.ndarray, mu: float, alpha: float, beta: float, span: float) -> tuple[float, np.ndarray]:
    logs, faded, inverse, a_rate, b_rate, late, bad = sums
    if bad or not np.isfinite(sums).all():
        return np.inf, np.zeros(3)
    value = -(logs - mu * span - alpha / beta * faded)
    d_beta = -alpha * b_rate + alpha / beta**2 * faded - alpha / beta * late
    return value, -np.array([mu * (inverse - span), alpha * (a_rate - faded / beta), beta * d_beta])


def negative_log_likelihood(log_params: np.ndarray, t: np.ndarray, span: float) -> tuple[float, np.ndarray]:
    """Value and gradient, by the logarithms of mu, alpha and beta."""
    mu, alpha, beta = np.exp(log_params)
    return _from_sums(likelihood_sums(t, span, mu, alpha, beta), mu, alpha, beta, span)


def _start(n: int, span: float, median_step: float | None) -> np.ndarray:
    beta = 1 / median_step if median_step else 1.0
    return np.log([max(0.5 * n / max(span, 1e-12), 1e-12), 0.5 * beta, beta])


def fit(events: np.ndarray, span: float | None = None, rounds: int = 500) -> HawkesFit:
    """Maximum likelihood of the events of one array; times are shifted to the first event, span is not."""
    t = np.sort(np.asarray(events, float))
    t = t - t[0]
    span = float(t[-1]) if span is None else span
    steps = np.diff(t)
    start = _start(len(t), span, np.median(steps[steps > 0]) if np.any(steps > 0) else None)
    return _minimised(lambda x: negative_log_likelihood(x, t, span), start, len(t), span, rounds)


def _minimised(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, n: int, span: float, rounds: int) -> HawkesFit:
    """BFGS with backtracking from x."""
    value, grad = f(x)
    inverse, done = np.eye(3) / max(1.0, np.abs(grad).max()), False
    for _ in range(rounds):
        direction = -inverse @ grad
        if direction @ grad >= 0:
            inverse = np.eye(3) / max(1.0, np.abs(grad).max())
            direction = -inverse @ grad
        direction *= min(1.0, 2.0 / max(np.abs(direction).max(), 1e-12))
        size = 1.0
        while size > 1e-10:
            new, new_grad = f(x + size * direction)
            if np.isfinite(new) and new <= value + 1e-4 * size * (direction @ grad):
                break
            size /= 2
        else:
            done = True
            break
        s, y = size * direction, new_grad - grad
        small = abs(value - new) <= 1e-10 * max(abs(value), abs(new), 1)
        x, value, grad = x + s, new, new_grad
        if small or np.abs(grad).max() < 1e-5:
            done = True
            break
        if (sy := s @ y) > 1e-12:
            left = np.eye(3) - np.outer(s, y) / sy
            inverse = left @ inverse @ left.T + np.outer(s, s) / sy
    mu, alpha, beta = np.exp(x)
    return HawkesFit(float(mu), float(alpha), float(beta), float(-value), n, span, done)


class StreamLikelihood:
    """The likelihood of one stream that lies in ranges of its order, each packed into one row.

    A range's state at its end is the one that it makes alone, plus the decayed state at its
    beginning: the driver gets one row of four numbers for each range, hands each its
    beginning, and gets back seven sums over all ranges. No task holds more than a range.
    """

    SUMS = ("logs", "faded", "inverse", "a_rate", "b_rate", "late", "bad")

    def __init__(self, events: DataFrame, order: Sequence[str], time: str = "t_sec", range_rows: int = 1_000_000) -> None:
        keys = list(dict.fromkeys([*order, time]))
        ranged = in_ranges(events.select(*keys), order, range_rows)

        def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            t = pdf.sort_values(list(order))[time].to_numpy("<f8")
            return pd.DataFrame({"range_no": [key[0]], "n": [len(t)], "first": [t[0]], "last": [t[-1]], "times": [t.tobytes()]})

        self.packed = written(ranged.groupBy("range_no").applyInPandas(pack, "range_no int, n long, first double, last double, times binary"), "packed")
        self.ends = [(r["range_no"], r["first"], r["last"]) for r in self.packed.select("range_no", "first", "last").orderBy("range_no").collect()]
        self.n = self.packed.agg(F.sum("n")).first()[0] or 0
        if self.n:
            self.start, self.span = self.ends[0][1], self.ends[-1][2] - self.ends[0][1]
        steps = with_previous(ranged, list(order), {"before": time}).select((F.col(time) - F.col("before")).alias("step")).where("step > 0")
        self.median_step = quantile(steps, "step", 0.5, "m").first().m

    def _carried(self, beta: float) -> dict[int, tuple[float, float]]:
        """The state at the first event of each range."""

        def alone(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                states = [_states(np.frombuffer(raw, "<f8"), beta) for raw in batch["times"]]
                yield pd.DataFrame({"range_no": batch["range_no"], "a": [a[-1] for a, _ in states], "b": [b[-1] for _, b in states]})

        own = {r.range_no: (r.a, r.b) for r in self.packed.select("range_no", "times").mapInPandas(alone, "range_no int, a double, b double").collect()}
        out, before, a, b = {}, None, 0.0, 0.0
        for number, first, last in self.ends:
            if before is not None:
                a, b = _onward(first - before, beta, 1 + a, b)
            out[number] = (float(a), float(b))
            faded, length = np.exp(-beta * (last - first)), last - first
            a, b, before = own[number][0] + faded * a, own[number][1] + faded * (b + length * a), last
        return out

    def __call__(self, log_params: np.ndarray) -> tuple[float, np.ndarray]:
        mu, alpha, beta = (float(v) for v in np.exp(log_params))
        carried, start, span = self._carried(beta), self.start, self.span

        def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = [likelihood_sums(np.frombuffer(raw, "<f8") - start, span, mu, alpha, beta, *carried[k]) for k, raw in zip(batch["range_no"], batch["times"], strict=True)]
                yield pd.DataFrame(np.array(rows).reshape(-1, 7), columns=self_sums)

        self_sums = list(self.SUMS)
        parts = self.packed.select("range_no", "times").mapInPandas(sums, ", ".join(f"{c} double" for c in self_sums))
        total = np.array(parts.agg(*[F.sum(c) for c in self_sums]).first(), float)
        return _from_sums(total, mu, alpha, beta, span)


def fit_stream(events: DataFrame, order: Sequence[str], time: str = "t_sec", rounds: int = 500, range_rows: int = 1_000_000) -> HawkesFit:
    """fit() of one stream of any length: every evaluation is two passes over its packed ranges."""
    held = StreamLikelihood(events, order, time, range_rows)
    if held.n < 2:
        raise ValueError("a fit needs two events")
    return _minimised(held, _start(held.n, held.span, held.median_step), held.n, held.span, rounds)


FIT_SCHEMA = "mu double, alpha double, beta double, loglik double, n_events long, span double, converged boolean, branching_ratio double"


def fit_groups(events: DataFrame, parts: Sequence[str], time: str = "t_sec", min_events: int = 100) -> DataFrame:
    """One fit for each group of at least min_events events; groups are fitted in parallel, rows of smaller ones never reach Python."""
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    sizes = events.groupBy(*parts).agg(F.count("*").alias("group_size")).where(F.col("group_size") >= min_events).alias("sizes")
    same = [F.col(f"events.{p}").eqNullSafe(F.col(f"sizes.{p}")) for p in parts]
    big = events.select(*parts, time).alias("events").join(sizes, same, "left_semi")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        f = fit(pdf[time].to_numpy())
        return pd.DataFrame([[*key, f.mu, f.alpha, f.beta, f.loglik, f.n_events, f.span, f.converged, f.branching_ratio]])

    schema = ", ".join(f"{p} {kinds[p]}" for p in parts) + ", " + FIT_SCHEMA
    return big.groupBy(*parts).applyInPandas(run, schema)


def window_seconds(events: DataFrame, start: str, hours: float, alerts_only: bool = False, ts: str = "timestamp") -> DataFrame:
    """Events of [start, start + hours) with t_sec, the seconds since the first of them."""
    a = F.lit(start).cast("timestamp")
    at = F.col(ts).cast("timestamp")
    kept = events.where((at >= a) & (F.unix_micros(at) < F.unix_micros(a) + F.lit(int(hours * 3600e6))))
    kept = kept.where("label = 1") if alerts_only else kept
    first = F.broadcast(kept.agg(F.min(F.unix_micros(at)).alias("t0")))
    return kept.crossJoin(first).withColumn("t_sec", (F.unix_micros(at) - F.col("t0")) / F.lit(1e6)).drop("t0")


def with_rate(events: DataFrame, order: Sequence[str], mu: float, alpha: float, beta: float, time: str = "t_sec") -> DataFrame:
    """Adds excitation, intensity and compensator at the events; times start at 0."""
    ranged = in_ranges(events, order)
    out = with_position(with_excitation(ranged, time, order, {"excitation": beta}), order, "i")
    rate = F.lit(mu) + F.lit(alpha) * F.col("excitation")
    compensator = F.lit(mu) * F.col(time) + F.lit(alpha / beta) * (F.col("i") - F.col("excitation"))
    return out.withColumns({"intensity": rate, "compensator": compensator})


def rescaled_gaps(rated: DataFrame, order: Sequence[str]) -> DataFrame:
    """Steps of the compensator, which are exponential with mean 1 if the process fits."""
    ranged = in_ranges(rated.drop("range_no"), order)
    out = with_previous(ranged, order, {"before": "compensator"})
    return out.where("before IS NOT NULL").select(*order, (F.col("compensator") - F.col("before")).alias("gap"))


def _ranked(gaps: DataFrame, order: Sequence[str]) -> DataFrame:
    keys = ["gap", *order]
    return with_position(in_ranges(gaps, keys), keys, "k").withColumn("k", F.col("k") + 1).crossJoin(F.broadcast(gaps.agg(F.count("*").alias("n"), F.avg("gap").alias("mean_gap"))))


def ks_statistic(gaps: DataFrame, order: Sequence[str]) -> DataFrame:
    """Largest distance to the exponential law, mean gap and size."""
    law = 1 - F.exp(-F.col("gap"))
    distance = F.greatest(F.col("k") / F.col("n") - law, law - (F.col("k") - 1) / F.col("n"))
    return _ranked(gaps, order).agg(F.max(distance).alias("ks_stat"), F.first("mean_gap").alias("mean_gap"), F.first("n").alias("n"))


#: Sizes up to which the exact law of the Kolmogorov statistic is used.
EXACT_KS = 10_000


def kolmogorov_cdf(n: int, d: float) -> float:
    """P(D < d) for n values by the power of a matrix of about 2 n d rows (Marsaglia, Tsang and Wang 2003)."""
    if d <= 0.5 / n:
        return 0.0
    if d >= 1:
        return 1.0
    k = int(n * d) + 1
    m, h = 2 * k - 1, k - n * d
    i, j = np.indices((m, m))
    matrix = (i - j + 1 >= 0).astype(float)
    powers = h ** np.arange(1, m + 1)
    matrix[:, 0] -= powers
    matrix[-1] -= powers[::-1]
    matrix[-1, 0] += max(2 * h - 1, 0.0) ** m
    logs = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, m + 1)))])  # of factorials
    matrix *= np.exp(-logs[np.maximum(i - j + 1, 0)])
    out, scale, base, base_scale, left = np.eye(m), 0.0, matrix, 0.0, n
    while left:  # powers by squaring, with their scale apart
        if left & 1:
            out, scale = out @ base, scale + base_scale
            top = np.abs(out).max()
            out, scale = out / top, scale + np.log(top)
        base, base_scale = base @ base, 2 * base_scale
        top = np.abs(base).max()
        base, base_scale = base / top, base_scale + np.log(top)
        left >>= 1
    here = out[k - 1, k - 1]
    log_factor = np.log(np.arange(1, n + 1) / n).sum()
    return float(min(max(np.exp(scale + log_factor + np.log(here)), 0.0), 1.0)) if here > 0 else 0.0


def kolmogorov_pvalue(n: int, d: float) -> float:
    """P(D >= d): exact up to EXACT_KS values, beyond them Kolmogorov's series with the usual correction."""
    if n * d * d > 18:  # under 5e-16, where one term of the series is left
        return float(2 * np.exp(-2 * n * d * d))
    if n <= EXACT_KS:
        return 1.0 - kolmogorov_cdf(n, d)
    x = (np.sqrt(n) + 0.12 + 0.11 / np.sqrt(n)) * d
    k = np.arange(1, 101)
    return 1.0 if x < 0.2 else float(min(max((2.0 * (-1.0) ** (k - 1) * np.exp(-2.0 * k * k * x * x)).sum(), 0.0), 1.0))


def ks_pvalue(stat: Column, n: Column) -> Column:
    """For the one row of a test's result."""

    @F.pandas_udf("double")
    def of(d: pd.Series, size: pd.Series) -> pd.Series:
        return pd.Series([np.nan if pd.isna(x) else kolmogorov_pvalue(int(k), float(x)) for x, k in zip(d, size, strict=True)], dtype=float)

    return of(stat, n)


def ks_test(gaps: DataFrame, order: Sequence[str], alpha: float = 0.05) -> DataFrame:
    out = ks_statistic(gaps, order).withColumn("ks_pvalue", ks_pvalue(F.col("ks_stat"), F.col("n")))
    return out.withColumn("accepted", F.col("ks_pvalue") > alpha)


def qq_points(gaps: DataFrame, order: Sequence[str]) -> DataFrame:
    """Theoretical and observed quantiles at (k - 1/2) / n."""
    return _ranked(gaps, order).select("k", (-F.ln(1 - (F.col("k") - 0.5) / F.col("n"))).alias("theoretical"), F.col("gap").alias("observed"))


def intensity_on_grid(events: DataFrame, grid: DataFrame, order: Sequence[str], mu: float, alpha: float, beta: float, time: str = "t_sec") -> DataFrame:
    """grid (g): the rate just before each grid time; an event at the grid time doesn't count.

    Grid rows join the stream as rows without weight, ordered before events of their time.
    The state of the latest event before a grid row is carried through ranges.
    """
    state = with_excitation(in_ranges(events.select(*dict.fromkeys([*order, time])), order), time, order, {"a": beta})
    held = state.select(F.col(time).alias("g"), F.lit(1).alias("is_event"), (F.col("a") + 1).alias("s"), F.monotonically_increasing_id().alias("tie"))
    rows = held.unionByName(grid.select("g", F.lit(0).alias("is_event"), F.lit(None).cast("double").alias("s"), F.lit(0).cast("long").alias("tie")))
    # the later of two events at one time has the larger state
    keys = ["g", "is_event", "s", "tie"]
    ranged = in_ranges(rows, keys)
    pair = F.when(F.col("is_event") == 1, F.struct("g", "s"))
    own = F.last(pair, ignorenulls=True).over(W.partitionBy("range_no").orderBy(*keys).rowsBetween(W.unboundedPreceding, 0))
    ends = ranged.where("is_event = 1").groupBy("range_no").agg(F.max(F.struct("g", "s")).alias("end"))
    parts = ranged.select("range_no").distinct().join(ends, "range_no", "left")
    carried = parts.select("range_no", F.last("end", ignorenulls=True).over(W.orderBy("range_no").rowsBetween(W.unboundedPreceding, -1)).alias("carried"))
    out = ranged.withColumn("own", own).join(F.broadcast(carried), "range_no").where("is_event = 0").withColumn("at", F.coalesce("own", "carried"))
    pull = F.coalesce(F.col("at.s") * F.exp(F.lit(-beta) * (F.col("g") - F.col("at.g"))), F.lit(0.0))
    return out.select("g", (F.lit(mu) + F.lit(alpha) * pull).alias("intensity"))


def linear_grid(spark: SparkSession, start: float, end: float, points: int = 4000) -> DataFrame:
    return spark.range(points).select((F.lit(float(start)) + F.col("id") * F.lit((end - start) / max(points - 1, 1))).alias("g"))


def thinned(mu: float, alpha: float, beta: float, span: float, seed: int) -> np.ndarray:
    """Times of a simulated process on [0, span) by thinning."""
    rng = np.random.default_rng(seed)
    out, t, state = [], 0.0, 0.0
    while True:
        bound = mu + alpha * state
        wait = rng.exponential(1 / bound)
        t += wait
        if t >= span:
            return np.array(out)
        state *= np.exp(-beta * wait)
        if rng.random() * bound <= mu + alpha * state:
            out.append(t)
            state += 1


def simulate(spark: SparkSession, params: DataFrame) -> DataFrame:
    """params (seed, mu, alpha, beta, span) to (seed, k, t_sec), one path for each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                t = thinned(r.mu, r.alpha, r.beta, r.span, int(r.seed))
                yield pd.DataFrame({"seed": r.seed, "k": np.arange(len(t)), "t_sec": t})

    return params.mapInPandas(run, "seed long, k long, t_sec double")
