"""Toxicity by a factorization machine over hashed terms.

Terms are the distinct lower-cased words of a text and the prefixes of 4 and 5 letters of
longer words, hashed to 2^20 buckets. From the training sample the ``terms`` buckets
that tell most about the label (G statistic over presence in documents) become features.
The machine scores w0 + sum w_i + sum over pairs <v_i, v_j>, so that two terms can weigh
more, or less, together than their sum: an insult next to the mention of a group. Pairs
cost no more than a pass over the terms: ((sum v)^2 - sum v^2) / 2.

It is fitted on a sample of at most ``max_rows`` labelled training rows, chosen by a hash
of the doc_id, with Adagrad on the driver; the features of the sample are made in parallel
and each row brings only hashed terms. Every whole text of the table is then scored.

Defined results of edge cases: null and empty texts have no terms and get the base rate;
rows with several labels are toxic if any label is 1; null labels are ignored; with no
labelled rows, or labels of one class, every score is the base rate (0 without rows);
repeated rows are scored alike; an empty table gives an empty table; other columns are
not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import is_train, release_memory

BUCKETS = 1 << 20
PREFIXES = (4, 5)
WORD = re.compile(r"[^\W\d_]+")
THRESHOLD = 0.3


def bucket(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "replace")) % BUCKETS


def word_buckets(word: str) -> tuple[int, ...]:
    """The buckets of a word and of its prefixes."""
    return (bucket(f"w:{word}"), *(bucket(f"p:{word[:n]}") for n in PREFIXES if len(word) > n))


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


@dataclass
class FactorizationMachine:
    features: np.ndarray  # sorted buckets
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def raw(self, rows: list[np.ndarray]) -> np.ndarray:
        """rows: positions in features of each text's terms."""
        out = np.full(len(rows), self.bias)
        for i, x in enumerate(rows):
            if len(x):
                v = self.factors[x]
                out[i] += self.weights[x].sum() + 0.5 * float((v.sum(0) ** 2 - (v**2).sum(0)).sum())
        return out

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(rows), -30, 30)))


def select_features(rows: list[np.ndarray], labels: np.ndarray, terms: int) -> np.ndarray:
    """The buckets whose presence tells most about the label; those of under 3 rows tell nothing."""
    toxic = [r for r, y in zip(rows, labels, strict=True) if y]
    n1 = np.bincount(np.concatenate(toxic), minlength=BUCKETS).astype(float)
    n = np.bincount(np.concatenate(rows), minlength=BUCKETS).astype(float)
    total, positive = len(labels), labels.sum()

    def part(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expected, 1e-9))

    p = positive / total
    g = part(n1, n * p) + part(n - n1, n * (1 - p)) + part(positive - n1, (total - n) * p) + part(total - positive - n + n1, (total - n) * (1 - p))
    g[n < 3] = 0
    best = np.argsort(-g, kind="stable")[:terms]
    return np.sort(best[g[best] > 5.0])


def fit(rows: list[np.ndarray], labels: np.ndarray, terms: int = 4096, rank: int = 6, epochs: int = 12, seed: int = 7) -> FactorizationMachine:
    """rows: the hashed terms of each text; labels: 0 or 1."""
    total, positive = len(labels), float(labels.sum()) if len(labels) else 0.0
    base = positive / total if total else 0.0
    bias = float(np.log(max(base, 1e-9) / max(1 - base, 1e-9)))
    if not 0 < positive < total or not sum(map(len, rows)):
        return FactorizationMachine(np.zeros(0, np.int64), bias, np.zeros(0), np.zeros((0, rank)))
    features = select_features(rows, labels, terms)
    place = np.full(BUCKETS, -1)
    place[features] = np.arange(len(features))
    xs = [p[p >= 0] for p in (place[r] for r in rows)]
    rng = np.random.default_rng(seed)
    w, v = np.zeros(len(features)), rng.normal(0, 0.05, (len(features), rank))
    gw, gv, gb = np.full(len(features), 1e-3), np.full((len(features), rank), 1e-3), 1e-3
    rate, decay, batch = 0.15, 1e-4, 64
    for _ in range(epochs):
        order = rng.permutation(total)
        for a in range(0, total, batch):
            part = order[a : a + batch]
            db, steps = 0.0, []
            for i in part:
                x = xs[i]
                s = v[x].sum(0)
                z = bias + w[x].sum() + 0.5 * float((s**2).sum() - (v[x] ** 2).sum())
                e = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[i]
                db += e
                if abs(e) > 1e-3 and len(x):
                    steps.append((x, e, e * (s - v[x])))
            gb += db * db
            bias -= rate * db / np.sqrt(gb)
            for x, e, dv in steps:
                dw = e + decay * w[x]
                gw[x] += dw * dw
                w[x] -= rate * dw / np.sqrt(gw[x])
                dv = dv + decay * v[x]
                gv[x] += dv * dv
                v[x] -= 0.3 * rate * dv / np.sqrt(gv[x])
    return FactorizationMachine(features, bias, w, v)


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [np.unique(np.array([b for w in words_of(t) for b in word_buckets(w)], np.int32)).tobytes() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("h"), pa.array(found, pa.binary()), batch.column("toxic")], names=["h", "terms", "toxic"])


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """h, terms and toxic of at most max_rows labelled training rows, those with the smallest hashes: first of ids, then of rows."""
    known = labels.where(is_train(F.col("doc_id")) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    # which ids are in the sample is decided before any text is moved; an id may have many rows, so rows are cut as well
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit("sample")), "doc_id").limit(max_rows)
    sample = docs.where(is_train(F.col("doc_id"))).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = sample.select(F.xxhash64("doc_id", "text").alias("h"), "text", "toxic").mapInArrow(_terms, "h long, terms binary, toxic int")
    return rows.orderBy("h", "toxic").limit(max_rows)


def learn(spark: SparkSession, docs: DataFrame, labels: DataFrame, max_rows: int = 8000) -> FactorizationMachine:
    """docs: doc_id, text; labels: doc_id, toxic. Only training rows are read; at most max_rows, four bytes a term, reach the driver."""
    rows = training_rows(docs, labels, max_rows).collect()
    rows.sort(key=lambda r: (r.toxic, r.terms))
    return fit([np.frombuffer(r.terms, np.int32) for r in rows], np.array([r.toxic for r in rows], float))


class Scorer:
    """Scores texts with a model; what it knows of words stays for the batches to come, in a bounded memory."""

    def __init__(self, model: FactorizationMachine) -> None:
        self.model = model
        self.place = {int(b): k for k, b in enumerate(model.features)}
        self.known: dict[str, tuple[int, ...]] = {}
        self.nothing: set[str] = set()

    def __call__(self, texts: pa.Array) -> np.ndarray:
        rows, known, nothing = [], self.known, self.nothing
        for text in texts:
            hits: set[int] = set()
            for w in words_of(text.as_py()) - nothing:
                got = known.get(w)
                if got is None:
                    got = tuple(self.place[b] for b in word_buckets(w) if b in self.place)
                    if got:
                        known[w] = got
                    else:
                        nothing.add(w)
                hits.update(got)
            rows.append(np.array(sorted(hits), np.int64))
        if len(nothing) > 150_000 or len(known) > 150_000:
            nothing.clear()
            known.clear()
        return self.model.score(rows)


def score_documents(spark: SparkSession, docs: DataFrame, model: FactorizationMachine) -> DataFrame:
    """doc_id, held_out, score and predicted of every whole text."""
    shared = spark.sparkContext.broadcast(model)  # bounded by the number of features
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (~is_train(F.col("doc_id"))).alias("held_out"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(shared.value)
        for batch in batches:
            scores = score(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])
        release_memory()

    return source.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(spark: SparkSession, docs: DataFrame, model: FactorizationMachine) -> DataFrame:
    """The rows whose text isn't predicted toxic, with all their columns; each row is decided by itself."""
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(shared.value)
        for batch in batches:
            yield batch.filter(pa.array(score(batch.column("text")) < THRESHOLD))
        release_memory()

    return docs.mapInArrow(run, docs.schema)
