"""Unsupervised detectors over count features: isolation forest and autoencoder.

Both learn from all rows and score them in parallel; features are arrays in the
vocabulary's order. The forest's subsamples are drawn in one pass over the rows and its
trees grown in tasks; the network learns in passes, in each of which every task takes the
steps of its own rows and the tasks' parameters are averaged. The driver holds models only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import written


def scaler(rows: DataFrame, width: int) -> DataFrame:
    """(i, mean, std) of log1p of each feature; std is that of the population."""
    exploded = rows.select(F.posexplode(F.transform("features", lambda x: F.log1p(x))).alias("i", "z"))
    return exploded.where(F.col("i") < width).groupBy("i").agg(F.avg("z").alias("mean"), F.stddev_pop("z").alias("std"))


def path_norm(n: float) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    if n <= 1:
        return 0.0
    return 2.0 * (np.log(n - 1) + np.euler_gamma) - 2.0 * (n - 1) / n if n > 2 else 1.0


@dataclass
class IsolationForest:
    """Trees over random splits of small subsamples; rows that are cut off early are anomalous."""

    trees: int = 100
    subsample: int = 256
    seed: int = 0
    log1p: bool = True
    nodes: list[tuple[np.ndarray, ...]] = field(default_factory=list)
    psi: int = 0

    def _prepared(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, np.float32)
        return np.log1p(x) if self.log1p else x

    def fit(self, x: np.ndarray) -> IsolationForest:
        x, rng = self._prepared(x), np.random.default_rng(self.seed)
        self.psi = min(self.subsample, len(x))
        depth = int(np.ceil(np.log2(max(self.psi, 2))))
        self.nodes = [self._tree(x[rng.choice(len(x), self.psi, replace=False)], depth, rng) for _ in range(self.trees)]
        return self

    def samples(self, rows: DataFrame, slack: float = 8.0) -> DataFrame:
        """(tree, features): for each tree the rows with the smallest of its hashes, drawn in one pass.

        rows: a written table (features, row_no) without repeated row_no. A row takes part in
        the trees for which its hash is below what the subsample needs, with some room, so
        hardly more rows are shuffled than are used.
        """
        n = rows.count()
        near = min(1.0, (self.subsample + slack * math.sqrt(self.subsample) + 16) / max(n, 1))
        draw = lambda t: F.struct(t.alias("tree"), F.shiftrightunsigned(F.xxhash64("row_no", t, F.lit(self.seed)), 1).alias("u"))
        drawn = F.filter(F.transform(F.sequence(F.lit(0), F.lit(self.trees - 1)), draw), lambda d: d["u"] <= F.lit(min(int(near * (1 << 63)), (1 << 63) - 1)))
        placed = rows.select("features", "row_no", F.explode(drawn).alias("d")).select("features", "row_no", "d.tree", "d.u")
        place = F.row_number().over(W.partitionBy("tree").orderBy("u", "row_no"))
        return placed.withColumn("place", place).where(F.col("place") <= self.subsample).select("tree", "features")

    def fit_rows(self, rows: DataFrame) -> IsolationForest:
        """fit() on the features of all rows; what reaches the driver are the trees."""
        numbered = written(rows.select("features", F.monotonically_increasing_id().alias("row_no")), "forest-rows")
        least, slack = min(self.subsample, numbered.count()), 8.0
        seed, log1p = self.seed, self.log1p

        def grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            forest = IsolationForest(seed=seed, log1p=log1p)
            x = forest._prepared(np.stack(pdf["features"].to_list()))
            tree = forest._tree(x, int(np.ceil(np.log2(max(len(x), 2)))), np.random.default_rng([seed, int(key[0])]))
            return pd.DataFrame({"tree": [key[0]], "n": [len(x)], **{c: [v.tolist()] for c, v in zip(("feature", "cut", "lower", "upper", "length"), tree, strict=True)}})

        schema = "tree int, n long, feature array<long>, cut array<double>, lower array<long>, upper array<long>, length array<double>"
        while True:
            grown = self.samples(numbered, slack).groupBy("tree").applyInPandas(grow, schema).orderBy("tree").collect() if least else []
            if all(r["n"] == least for r in grown):
                break
            slack *= 4  # a subsample fell short, which the room makes all but impossible
        self.psi = least
        self.nodes = [tuple(np.array(r[c], t) for c, t in (("feature", int), ("cut", float), ("lower", int), ("upper", int), ("length", float))) for r in grown]
        return self

    def _tree(self, x: np.ndarray, depth: int, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        feature, cut, left, right, length = [], [], [], [], []

        def grow(rows: np.ndarray, level: int) -> int:
            at = len(feature)
            for column, v in ((feature, -1), (cut, 0.0), (left, -1), (right, -1), (length, level + path_norm(len(rows)))):
                column.append(v)
            low, high = (rows.min(0), rows.max(0)) if len(rows) else (np.zeros(0), np.zeros(0))
            live = np.flatnonzero(high > low)
            if level < depth and len(rows) > 1 and len(live):
                f = int(rng.choice(live))
                c = float(rng.uniform(low[f], high[f]))
                feature[at], cut[at] = f, c
                left[at] = grow(rows[rows[:, f] <= c], level + 1)
                right[at] = grow(rows[rows[:, f] > c], level + 1)
            return at

        grow(x, 0)
        return tuple(np.array(c) for c in (feature, cut, left, right, length))

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.nodes:
            raise ValueError("fit the forest before scoring")
        x = self._prepared(x)
        total = np.zeros(len(x))
        for feature, cut, left, right, length in self.nodes:
            at = np.zeros(len(x), int)
            while len(live := np.flatnonzero(feature[at] >= 0)):
                node = at[live]
                at[live] = np.where(x[live, feature[node]] <= cut[node], left[node], right[node])
            total += length[at]
        return 2.0 ** (-(total / len(self.nodes)) / max(path_norm(self.psi), 1e-12))


class Network:
    """Fully connected layers; all parameters lie in one vector, so that sets of them can be averaged."""

    def __init__(self, sizes: list[int], straight: set[int]) -> None:
        self.shapes, self.straight = list(zip(sizes[:-1], sizes[1:], strict=True)), straight
        self.size = sum((a + 1) * b for a, b in self.shapes)

    def drawn(self, rng: np.random.Generator) -> np.ndarray:
        return np.concatenate([rng.uniform(-1, 1, (a + 1) * b) / np.sqrt(a) for a, b in self.shapes])

    def layers(self, theta: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out, at = [], 0
        for a, b in self.shapes:
            out.append((theta[at : at + a * b].reshape(a, b), theta[at + a * b : at + (a + 1) * b]))
            at += (a + 1) * b
        return out

    def outputs(self, theta: np.ndarray, z: np.ndarray) -> list[np.ndarray]:
        out = [z]
        for k, (w, b) in enumerate(self.layers(theta)):
            z = z @ w + b
            out.append(z if k in self.straight else np.maximum(z, 0))
            z = out[-1]
        return out

    def errors(self, theta: np.ndarray, z: np.ndarray) -> np.ndarray:
        """The mean squared error of each row's copy."""
        return ((self.outputs(theta, z)[-1] - z) ** 2).mean(1)

    def gradient(self, theta: np.ndarray, z: np.ndarray) -> np.ndarray:
        out, layers, parts = self.outputs(theta, z), self.layers(theta), []
        back = 2 * (out[-1] - z) / z.size
        for k in range(len(layers) - 1, -1, -1):
            if k not in self.straight:
                back = back * (out[k + 1] > 0)
            parts[:0] = [(out[k].T @ back).ravel(), back.sum(0)]
            back = back @ layers[k][0].T
        return np.concatenate(parts)


@dataclass
class Learner:
    """Parameters with the moments of their gradients (Adam)."""

    theta: np.ndarray
    first: np.ndarray
    second: np.ndarray
    steps: float = 0.0

    def step(self, gradient: np.ndarray, rate: float) -> None:
        self.steps += 1
        self.first = 0.9 * self.first + 0.1 * gradient
        self.second = 0.999 * self.second + 0.001 * gradient**2
        size = np.sqrt(self.second / (1 - 0.999**self.steps)) + 1e-8
        self.theta = self.theta - rate * self.first / (1 - 0.9**self.steps) / size

    def packed(self) -> np.ndarray:
        return np.concatenate([self.theta, self.first, self.second, [self.steps]])

    @staticmethod
    def unpacked(v: np.ndarray) -> Learner:
        k = (len(v) - 1) // 3
        return Learner(v[:k], v[k : 2 * k], v[2 * k : 3 * k], float(v[-1]))


class Course:
    """The course of held-out losses: the best parameters so far, and whether it is worth going on."""

    def __init__(self, patience: int, least_gain: float = 1e-6) -> None:
        self.patience, self.least_gain = patience, least_gain
        self.losses: list[float] = []
        self.best_at, self.best = -1, None

    def goes_on(self, loss: float, theta: np.ndarray) -> bool:
        self.losses.append(loss)
        if self.best is None or loss < self.losses[self.best_at] - self.least_gain:
            self.best_at, self.best = len(self.losses) - 1, theta
        return len(self.losses) - 1 - self.best_at < self.patience


@dataclass
class Autoencoder:
    """A small network that learns to copy normal rows; the mean squared error of the copy is the score."""

    hidden: tuple[int, ...] = (32, 16)
    latent: int = 8
    epochs: int = 60
    rate: float = 1e-3
    batch: int = 256
    val_frac: float = 0.1
    patience: int = 6
    seed: int = 0
    theta: np.ndarray | None = None
    history: list[float] = field(default_factory=list)
    mean: np.ndarray | None = None
    std: np.ndarray | None = None

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return (np.log1p(np.asarray(x, float)) - self.mean) / self.std

    def _network(self, width: int) -> Network:
        sizes = [width, *self.hidden, self.latent, *reversed(self.hidden), width]
        return Network(sizes, {len(self.hidden), len(sizes) - 2})  # neither the code nor the copy is bent

    def _pass(self, network: Network, learner: Learner, z: np.ndarray, rng: np.random.Generator) -> None:
        for part in np.array_split(z[rng.permutation(len(z))], -(-len(z) // self.batch)) if len(z) else ():
            learner.step(network.gradient(learner.theta, part), self.rate)

    def _begun(self, width: int) -> tuple[Network, Learner]:
        network = self._network(width)
        theta = network.drawn(np.random.default_rng(self.seed))
        return network, Learner(theta, np.zeros_like(theta), np.zeros_like(theta))

    def fit(self, x: np.ndarray) -> Autoencoder:
        """On the rows of one array."""
        logs = np.log1p(np.asarray(x, float))
        self.mean, self.std = logs.mean(0), logs.std(0) + 1e-6
        z, rng = self._scaled(x), np.random.default_rng(self.seed)
        network, learner = self._begun(z.shape[1])
        held = np.zeros(len(z), bool)
        held[rng.permutation(len(z))[: max(1, round(len(z) * self.val_frac))]] = True
        course = Course(self.patience)
        for _ in range(self.epochs):
            self._pass(network, learner, z[~held], rng)
            if not course.goes_on(float(network.errors(learner.theta, z[held]).mean()), learner.theta):
                break
        self.theta, self.history = course.best, course.losses
        return self

    def fit_rows(self, rows: DataFrame, task_rows: int = 100_000) -> Autoencoder:
        """On all rows: in each epoch a task takes the steps of its rows, and the results are averaged by their numbers.

        A file of the written rows has about task_rows rows, so few rows are one task, which
        learns as fit() does. Held-out rows are chosen by hash. A lost task is run again from
        the epoch's parameters.
        """
        u = F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(self.seed)), F.lit(1 << 20))
        parts = max(1, -(-rows.count() // task_rows))
        table = written(rows.select("features").repartition(parts).withColumn("held", u < F.lit(int(self.val_frac * (1 << 20)))), "training")
        first = table.select(F.size("features").alias("width")).first()
        if first is None:
            raise ValueError("no rows to learn from")
        stats = {r.i: r for r in scaler(table, first.width).collect()}  # one row for each feature
        self.mean, self.std = (np.array([stats[k][c] for k in range(first.width)]) for c in ("mean", "std"))
        self.std = self.std + 1e-6
        network, learner = self._begun(first.width)
        course = Course(self.patience)
        for epoch in range(self.epochs + 1):  # a pass also tells the held-out loss of what it begins with
            before = learner
            total = self._epoch(table, network, learner, epoch)
            trained, n_held, lost, learner = total[0], total[1], total[2], Learner.unpacked(total[3:] / max(total[0], 1))
            if epoch and not course.goes_on(lost / max(n_held, 1), before.theta):
                break
        self.theta, self.history = course.best, course.losses
        return self

    def _epoch(self, table: DataFrame, network: Network, learner: Learner, epoch: int) -> np.ndarray:
        """Trained rows, held-out rows and their loss, and the parameters times trained rows, added over tasks."""
        sent = table.sparkSession.sparkContext.broadcast(learner.packed())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            task = TaskContext.get().partitionId()
            begin = Learner.unpacked(sent.value)
            own, rng, trained, n_held, lost = Learner.unpacked(sent.value), np.random.default_rng([self.seed, epoch, task]), 0, 0, 0.0
            for batch in batches:
                if not batch.num_rows:
                    continue
                lists = batch.column("features")
                z = self._scaled(lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1))
                held = batch.column("held").to_numpy(zero_copy_only=False)
                n_held += int(held.sum())
                lost += float(network.errors(begin.theta, z[held]).sum())
                trained += int((~held).sum())
                self._pass(network, own, z[~held], rng)
            yield pa.RecordBatch.from_pydict({"task": pa.array([task], pa.int32()), "sums": [np.concatenate([[trained, n_held, lost], own.packed() * trained]).astype("<f8").tobytes()]})

        def added(key, rows):
            sums = np.sum([np.frombuffer(r.as_py(), "<f8") for r in rows.column("sums")], axis=0)
            return pa.table({"task": pa.array([0], pa.int32()), "sums": [sums.tobytes()]})

        kind = "task int, sums binary"
        parts = table.mapInArrow(run, kind)
        some = parts.groupBy(F.pmod("task", F.lit(32)).alias("g")).applyInArrow(added, kind)
        return np.frombuffer(some.groupBy("task").applyInArrow(added, kind).first().sums, "<f8")

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.theta is None:
            raise ValueError("fit the autoencoder before scoring")
        z = self._scaled(x)
        return self._network(z.shape[1]).errors(self.theta, z)


def with_score(rows: DataFrame, model, name: str = "score") -> DataFrame:
    """Adds a fitted model's score of each row's features."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # bounded by the model's parameters

    @F.pandas_udf("double")
    def score(features: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(np.stack(features.to_list()))) if len(features) else pd.Series([], dtype=float)

    return rows.withColumn(name, score("features"))
