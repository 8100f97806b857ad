"""Approximate nearest neighbours by cosine: inverted file with product-quantised residuals.

Vectors are scaled to length one. Coarse centroids (spherical k-means) and, for the
residuals to them, one codebook for each sub-space are fitted on a sample of at most
``max_sample`` vectors chosen by a hash of the id. Every vector is then indexed: its list
is that of the nearest centroid, its code one byte for each sub-space.

The index is a table of *blocks*: up to ``block_rows`` rows of one list, packed. A list
of any length is many blocks, so a centroid, or one vector that a third of all rows
share, that holds a large part of the rows is not one task's work. Queries are packed
too, in groups of the lists that they probe, and meet the blocks of a list by its id and
a salt: a stated query set against the rows of its lists. Within a block, scores come
from asymmetric distance tables (query sub-vectors against codebooks). Beside each code
stand the length of its quantisation error, by which an approximate score can be wrong
at most, and the original vector. The ``rerank`` rows of the best approximate scores are
scored exactly, in double precision, and then every row of the block that by its bound
could still be among the nearest so far. So the result is exact within the probed lists,
and a task hands on only the nearest of each query, ordered by exact score, then by id.

The number of probes is calibrated on the sample: as many lists as hold the wanted share
of its nearest rows. Vectors without clusters need many, clustered ones few.

Defined results of edge cases: vectors that are null, empty, zero or hold null or
non-finite components take no part, as rows or as queries; a null id takes no part;
vectors of another dimension than most are compared with none; a repeated id is one
row for each of its vectors, and a query's own id is never its candidate; with no
vectors there are no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, shuffle_partitions

BLOCK_ROWS = 4096


def k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Centroids by Lloyd's rounds; an empty cluster starts again at a row far from its centroid."""
    centroids = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = 2 * x @ centroids.T - (centroids**2).sum(1)
        to = near.argmax(1)
        sums = np.stack([np.bincount(to, weights=x[:, d], minlength=k) for d in range(x.shape[1])], axis=1)
        n = np.bincount(to, minlength=k)
        far = np.argsort(near.max(1) - (x**2).sum(1))
        empty = np.flatnonzero(n == 0)
        centroids = sums / np.maximum(n, 1)[:, None]
        centroids[empty] = x[far[: len(empty)]] if len(empty) <= len(far) else 0
    return centroids


@dataclass
class Quantizer:
    centroids: np.ndarray  # lists x dimension
    codebooks: np.ndarray  # sub-spaces x 256 x sub-dimension

    @staticmethod
    def fit(x: np.ndarray, lists: int, sub_spaces: int, seed: int = 11) -> Quantizer:
        rng = np.random.default_rng(seed)
        centroids = k_means(x, lists, 12, rng)
        residual = x - centroids[nearest(x, centroids)]
        parts = np.split(residual, sub_spaces, axis=1)
        return Quantizer(centroids, np.stack([k_means(p, 256, 10, rng) for p in parts]))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        to = nearest(x, self.centroids)
        parts = np.split(x - self.centroids[to], len(self.codebooks), axis=1)
        return to, np.stack([nearest(p, c) for p, c in zip(parts, self.codebooks, strict=True)], axis=1).astype(np.uint8)

    def errors(self, x: np.ndarray, to: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The length of what list and code leave of each row: the most by which its approximate score can be wrong."""
        coded = self.codebooks[np.arange(len(self.codebooks)), codes].reshape(len(x), -1)
        return np.linalg.norm(x - self.centroids[to] - coded, axis=1) + 1e-9  # rounding is far below that

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Sub-spaces x 256: what each code adds to the dot product."""
        return np.einsum("msd,md->ms", self.codebooks, q.reshape(len(self.codebooks), -1))


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    for a in range(0, len(x), 8192):
        out[a : a + 8192] = (2 * x[a : a + 8192] @ centroids.T - (centroids**2).sum(1)).argmax(1)
    return out


def calibrate(x: np.ndarray, centroids: np.ndarray, neighbours: int, recall: float, queries: int = 256) -> int:
    """The probes that find this share of the nearest rows within the sample, where neighbours are farther than in all rows."""
    q = x[:: max(1, len(x) // queries)][:queries]
    dots = q @ x.T
    top = np.argsort(-dots, axis=1, kind="stable")[:, 1 : neighbours + 1]
    place = np.argsort(np.argsort(-(q @ centroids.T), axis=1, kind="stable"), axis=1)
    found = np.sort(np.take_along_axis(place, nearest(x, centroids)[top], axis=1).ravel())
    return int(found[min(len(found) - 1, math.ceil(recall * len(found)))]) + 1 if len(found) else 1


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    """Rows of valid vectors; the caller has filtered. Rows whose squares would leave the range of doubles are scaled by a power of two."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)
    power = np.frexp(np.abs(values).max(axis=1))[1] if len(values) else np.empty(0, int)
    return np.ldexp(values, np.where(np.abs(power) > 400, -power, 0)[:, None])


def _unit(values: np.ndarray) -> np.ndarray:
    return values / np.maximum(np.linalg.norm(values, axis=1), 1e-300)[:, None]


def cosines(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact scores; sums by row, so that equal vectors have equal scores wherever they stand (BLAS doesn't promise that)."""
    return (x * q).sum(1) / (np.sqrt((q * q).sum()) * np.sqrt((x * x).sum(1)))


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the rows that take part."""
    e = F.col("embedding").cast("array<double>")
    good = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(e, lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding")).where("vec_id IS NOT NULL").where(good)


ASSIGNED_SQL = "list int, vec_id long, code binary, error double, vector binary"
INDEX_SQL = "list int, ids binary, codes binary, errors binary, vectors binary"


def _assign(shared, dimension: int, kind: str):
    """Each vector's list, code and error, and itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = _matrix(batch.column("embedding"), dimension)
                x = _unit(values)
                to, codes = shared.value.encode(x)
                packed, whole = ([r.tobytes() for r in rows] for rows in (codes, values.astype(kind)))
                errors = pa.array(shared.value.errors(x, to, codes))
                yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), batch.column("vec_id"), pa.array(packed, pa.binary()), errors, pa.array(whole, pa.binary())], names=["list", "vec_id", "code", "error", "vector"])

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (list, part) to one row for each block."""
    key, ids, codes, errors, vectors = None, [], [], [], []

    def block() -> pa.RecordBatch:
        held = {"ids": [np.array(ids, "<i8").tobytes()], "codes": [b"".join(codes)], "errors": [np.array(errors, "<f8").tobytes()], "vectors": [b"".join(vectors)]}
        return pa.RecordBatch.from_pydict({"list": pa.array([key[0]], pa.int32()), **held})

    for batch in batches:
        for k, part, i, c, e, v in zip(*(batch.column(n).to_pylist() for n in ("list", "part", "vec_id", "code", "error", "vector")), strict=True):
            if (k, part) != key or len(ids) >= 2 * BLOCK_ROWS:
                if ids:
                    yield block()
                key, ids, codes, errors, vectors = (k, part), [], [], [], []
            ids.append(i)
            codes.append(c)
            errors.append(e)
            vectors.append(v)
    if ids:
        yield block()


def _probes(shared, dimension: int, probes: int):
    """Each query's lists, nearest first by dot product."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = _matrix(batch.column("embedding"), dimension)
            dots = _unit(values) @ shared.value.centroids.T
            lists = np.argsort(-dots, axis=1, kind="stable")[:, :probes]
            n = lists.shape[1]
            yield pa.RecordBatch.from_pydict({"query_id": np.repeat(batch.column("vec_id").to_numpy(), n), "list": lists.ravel().astype(np.int32), "q": [v.tobytes() for v in values for _ in range(n)]})

    return run


SEARCH_SQL = "query_id long, vec_id long, score double"


def _search(shared, neighbours: int, rerank: int, kind: str):
    """Blocks of lists against the queries that probe them; a task hands on the nearest of each query, by exact scores."""

    def best(ids: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keep = np.arange(len(score))
        if len(score) > neighbours:  # all that tie with the last one stay in the running until ids decide
            keep = np.flatnonzero(score >= np.partition(score, -neighbours)[-neighbours])
        keep = keep[np.lexsort((ids[keep], -score[keep]))][:neighbours]
        return ids[keep], score[keep]

    def flush(held: dict[int, tuple]) -> pa.RecordBatch:
        rows = [(q, *near) for q, near in held.items()]
        held.clear()
        return pa.RecordBatch.from_pydict({"query_id": np.concatenate([np.full(len(i), q) for q, i, _ in rows]), "vec_id": np.concatenate([i for _, i, _ in rows]), "score": np.concatenate([s for _, _, s in rows])})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quantizer = shared.value
        m = len(quantizer.codebooks)
        place, held = np.arange(m), {}
        for batch in batches:
            for row in batch.to_pylist():
                ids, codes = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["codes"], np.uint8).reshape(-1, m)
                errors, x = np.frombuffer(row["errors"], "<f8"), np.frombuffer(row["vectors"], kind).astype(np.float64).reshape(len(ids), -1)
                centroid = quantizer.centroids[row["list"]]
                for query in row["queries"]:
                    q = np.frombuffer(query["q"], np.float64)
                    near = held.get(query["query_id"], (np.empty(0, np.int64), np.empty(0)))
                    left = ids != query["query_id"]
                    if len(ids) > rerank:
                        unit = _unit(q[None])[0]
                        approx = float(unit @ centroid) + quantizer.tables(unit)[place, codes].sum(1)
                        first = np.argpartition(np.where(left, approx, -np.inf), -rerank)[-rerank:]
                        first = first[left[first]]
                        near = best(np.concatenate([near[0], ids[first]]), np.concatenate([near[1], cosines(x[first], q)]))
                        left[first] = False
                        if len(near[1]) == neighbours:
                            left &= approx + errors >= near[1][-1]
                    rest = np.flatnonzero(left)
                    held[query["query_id"]] = best(np.concatenate([near[0], ids[rest]]), np.concatenate([near[1], cosines(x[rest], q)]))
            if len(held) * neighbours > 1_000_000:
                yield flush(held)
        if held:
            yield flush(held)

    return run


def fit_sample(rows: DataFrame, n: int, max_sample: int) -> DataFrame:
    """At most max_sample of the n rows, those with the smallest hashes of id and vector; few others are sorted."""
    place = F.pmod(F.xxhash64("vec_id", "embedding", F.lit("sample")), F.lit(1 << 30))
    near = (max_sample + 8 * math.sqrt(max_sample) + 16) / max(n, 1)
    some = rows.select("vec_id", "embedding", place.alias("place")).where(F.col("place") < F.lit(int(min(1.0, near) * (1 << 30))))
    return some.orderBy("place", "vec_id", "embedding").limit(max_sample).drop("place")


def search(
    spark: SparkSession, vectors: DataFrame, queries: DataFrame, neighbours: int = 5, rerank: int = 200, max_sample: int = 20_000, sub_spaces: int = 16, recall: float = 0.96
) -> DataFrame:
    """The nearest rows of vectors for each row of queries: query_id, rank, vec_id and score.

    max_sample bounds what is fitted on; lists are about 5 rows^0.4, at most an eighth of the sample and 4096. A query
    probes as many as the sample needs for the given recall, 8 at least.
    """
    scratch = Scratch(spark, "ivfpq")
    single = vectors.schema["embedding"].dataType == T.ArrayType(T.FloatType())
    kind = "<f4" if single else "<f8"  # floats are kept as floats, which loses nothing
    valid = valid_vectors(vectors)
    rows = table = scratch.save(valid.withColumn("embedding", F.col("embedding").cast("array<float>")) if single else valid, "vectors")
    sizes = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    result = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], result)
    dimension, n = sizes[0].d, sizes[0].n
    rows = rows.where(F.size("embedding") == dimension)
    asked = valid_vectors(queries).where(F.size("embedding") == dimension)
    sample = fit_sample(rows, n, max_sample).toPandas()
    sample = sample.assign(key=sample["embedding"].map(tuple)).sort_values(["vec_id", "key"])["embedding"]  # so that what is fitted doesn't depend on partitions
    x = np.stack(sample.to_list() if len(sample) else [r.embedding for r in rows.limit(1).collect()]).astype(np.float64)
    x = x / np.linalg.norm(x, axis=1)[:, None]
    lists = max(1, min(4096, round(5 * n**0.4), len(x) // 8))
    parts = max(m for m in range(1, min(sub_spaces, dimension) + 1) if dimension % m == 0)
    quantizer = Quantizer.fit(x, lists, parts)
    probes = min(lists, max(8, calibrate(x, quantizer.centroids, neighbours, recall)))
    shared = spark.sparkContext.broadcast(quantizer)  # bounded by lists and codebooks

    assigned = scratch.save(rows.mapInArrow(_assign(shared, dimension, kind), ASSIGNED_SQL), "assigned")
    scratch.drop(table)
    # one row for each list tells into how many parts it is dealt
    counts = F.broadcast(assigned.groupBy("list").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("parts")))
    dealt = assigned.join(counts, "list").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    dealt = dealt.repartition(shuffle_partitions(spark), "list", "part").sortWithinPartitions("list", "part").select("list", "part", "vec_id", "code", "error", "vector")
    blocks = scratch.save(dealt.mapInArrow(_pack, INDEX_SQL), "index")
    scratch.drop(assigned)
    probing = asked.mapInArrow(_probes(shared, dimension, probes), "query_id long, list int, q binary")
    # queries of a list in packs of a bounded size; every pack meets every block of its list
    salts = F.pmod(F.xxhash64("query_id"), F.lit(max(1, asked.count() * probes // (lists * 256)))).cast("int")
    packs = probing.groupBy("list", salts.alias("pack")).agg(F.collect_list(F.struct("query_id", "q")).alias("queries"))
    packs = scratch.save(packs, "packs").withColumnRenamed("list", "of")
    met = blocks.join(packs, blocks["list"] == packs["of"]).select("list", "ids", "codes", "errors", "vectors", "queries")
    found = scratch.save(met.repartition(shuffle_partitions(spark)).mapInArrow(_search(shared, neighbours, rerank, kind), SEARCH_SQL), "found")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= neighbours).select("query_id", "rank", "vec_id", "score")
