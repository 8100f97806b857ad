"""How the vocabularies of the sources of a language diverge, counted behind a sketch.

1. Every task adds the distinct terms of each of its documents to a count-min sketch of
   document frequencies by (language, term). Sketches are merged by adding counters, which
   saturate far above the threshold; an estimate is never below the truth. The sketch's size
   follows the corpus, up to ``SKETCH_BITS``; a fuller sketch lets more terms through, which
   costs shuffle, never a term.
2. Terms whose estimate is below the threshold can't be kept and are discarded where they
   are read. The others are added up in the task and shuffled as counts; their document
   frequencies are then exact and decide.
3. Pairs of sources: the terms that neither source holds all have one value, those of one
   source alone have one value for each of its counts, so both come from histograms of
   counts. Only terms that both hold are joined, and each task adds their values up by pair.

A document is a row. Arithmetic is in whole numbers: products that outgrow 64 bits are decimals of 38 digits.

Defined results of edge cases: null text, lang and source are empty; rows that repeat an id
are documents of their own; a group without terms, or a language that keeps none, has its
pairs, with value 0 where nothing is kept; a language with one source has no pairs; an empty table
gives an empty table; a very long text is counted in full; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, release_memory

#: A term in UTF-8: A-Z, a-z and whatever isn't ASCII.
TERM = re.compile(rb"[a-z\x80-\xff]+")
#: Rows of the sketch, and least and most bits of a slot's number in one of them.
DEPTH, SKETCH_BITS = 3, (16, 26)
#: Counters that travel as one row.
CHUNK = 1 << 16
#: Terms that a task holds, with the group's or the language's count, before it hands them on.
HELD = 300_000
SCALE = 1_000_000_000

CHUNKS_SQL = "chunk int, task int, data binary"
CHUNKS = pa.schema([("chunk", pa.int32()), ("task", pa.int32()), ("data", pa.binary())])
COUNTS_SQL = "lang string, source string, term string, n long, docs long"
COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def terms(text: str | None) -> list[bytes]:
    """The terms of a whole text in order; only A-Z is lower-cased."""
    return TERM.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


def hashes_of(lang: str, found) -> np.ndarray:
    """64-bit hashes of terms of a language."""
    import xxhash

    of, head = xxhash.xxh3_64_intdigest, lang.encode("utf-8", "surrogatepass") + b"\0"
    return np.fromiter((of(head + t) for t in found), np.uint64, len(found))


def slots(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    """The places of terms in each row of the sketch, by double hashing."""
    step = (hashes * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return [((hashes + np.uint64(d) * step) >> np.uint64(64 - bits)).astype(np.int64) for d in range(DEPTH)]


def _by_document(batch: pa.RecordBatch) -> Iterator[tuple[str, str, list[bytes]]]:
    langs, sources = (batch.column(c).to_pylist() for c in ("lang", "source"))
    for lang, source, text in zip(langs, sources, batch.column("text"), strict=True):
        yield lang, source, terms(text.as_py())


def _sketch(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sketch, waiting, held = np.zeros((DEPTH, 1 << bits), "u1"), {}, 0

        def add() -> None:
            """The documents of each term; counters stay at their largest value."""
            for lang, docs in waiting.items():
                times = np.minimum(np.fromiter(docs.values(), np.int64, len(docs)), 255)
                for row, at in zip(sketch, slots(hashes_of(lang, docs), bits), strict=True):
                    where, back = np.unique(at, return_inverse=True)
                    row[where] = np.minimum(row[where] + np.bincount(back, times), 255).astype("u1")
            waiting.clear()

        for batch in batches:
            for lang, _, found in _by_document(batch):
                docs = waiting.setdefault(lang, Counter())
                held -= len(docs)
                docs.update(set(found))
                held += len(docs)
                if held > HELD:
                    add()
                    held = 0
        add()
        flat = np.pad(sketch.ravel(), (0, -sketch.size % CHUNK))
        for chunk in range(len(flat) // CHUNK):
            part = flat[chunk * CHUNK : (chunk + 1) * CHUNK]
            if part.any():
                yield pa.RecordBatch.from_pylist([{"chunk": chunk, "task": TaskContext.get().partitionId(), "data": pa.compress(part.tobytes(), codec="zstd", asbytes=True)}], schema=CHUNKS)
        release_memory()

    return run


def _chunk(data: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, decompressed_size=CHUNK, codec="zstd", asbytes=True), "u1")


def _merge(key, table):
    """The same chunk of several tasks' sketches to one."""
    total = np.zeros(CHUNK, np.uint16)
    for data in table.column("data"):
        total = np.minimum(total + _chunk(data.as_py()), 255)
    packed = pa.compress(total.astype("u1").tobytes(), codec="zstd", asbytes=True)
    return pa.Table.from_pylist([{"chunk": key[0].as_py(), "task": 0, "data": packed}], schema=CHUNKS)


def merged_sketch(scratch: Scratch, docs: DataFrame, bits: int) -> np.ndarray:
    """The sketch of all documents, whose size is bounded; tasks are merged in groups before these meet."""
    chunks = scratch.save(docs.mapInArrow(_sketch(bits), CHUNKS_SQL), "sketches")
    groups = max(1, math.isqrt((chunks.agg(F.max("task")).first()[0] or 0) + 1))
    some = chunks.groupBy("chunk", F.pmod("task", F.lit(groups)).alias("part")).applyInArrow(_merge, CHUNKS_SQL)
    out = np.zeros(-(-(DEPTH << bits) // CHUNK) * CHUNK, "u1")
    for r in some.groupBy("chunk").applyInArrow(_merge, CHUNKS_SQL).toLocalIterator():
        out[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = _chunk(r.data)
    scratch.drop(chunks)
    return out[: DEPTH << bits].reshape(DEPTH, 1 << bits)


def _count(sketch, bits: int, least: int):
    """Counts by task of the terms that the sketch leaves possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in counts.items():
                ok = np.ones(len(n), bool)
                for row, at in zip(sketch.value, slots(hashes_of(lang, n), bits), strict=True):
                    ok &= row[at] >= least
                some = list(compress(n.items(), ok))
                k = len(some)
                words = [t.decode("utf-8", "surrogatepass") for t, _ in some]
                yield pa.RecordBatch.from_pydict({"lang": [lang] * k, "source": [source] * k, "term": words, "n": [c for _, c in some], "docs": [docs[t] for t, _ in some]}, schema=COUNTS)
            counts.clear()

        for batch in batches:
            for lang, source, found in _by_document(batch):
                n, docs = counts.setdefault((lang, source), (Counter(), Counter()))
                held -= len(n)
                n.update(found)
                docs.update(set(found))
                held += len(n)
                if held > HELD:
                    yield from rows()
                    held = 0
        yield from rows()
        release_memory()

    return run


# --- values ------------------------------------------------------------------------------


def share(count: str, total: str) -> str:
    """p = 1 + floor(SCALE * (count + 1) / total) in SQL, exactly; total is N + V."""
    return f"1 + (cast({SCALE} as decimal(10, 0)) * cast({count} + 1 as decimal(20, 0))) div cast({total} as decimal(20, 0))"


def divergence(p: str, q: str) -> str:
    """f = floor((p - q) ** 2 / q) in SQL; shares are at most 1 + SCALE, so squares have 64 bits."""
    return f"(({p} - {q}) * ({p} - {q})) div {q}"


def _ranked(rows: DataFrame, most: int | None) -> DataFrame:
    order = W.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    out = rows.withColumn("rank", F.row_number().over(order))
    return out.where(F.col("rank") <= most) if most else out


def divergences(spark: SparkSession, docs: DataFrame, min_docs: int = 3, top: int = 200) -> DataFrame:
    """lang, source, part, item, value and rank: all pairs of sources, and the terms by which each group stands out most."""
    scratch = Scratch(spark, "divergence")
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    read = docs.groupBy("lang", "source").agg(F.sum(F.octet_length("text")).alias("bytes"))
    groups = scratch.save(read, "groups")
    size = groups.agg(F.sum("bytes")).first()[0] or 0
    bits = min(max(int(size // 256).bit_length(), SKETCH_BITS[0]), SKETCH_BITS[1])
    sketch = spark.sparkContext.broadcast(merged_sketch(scratch, docs, bits))
    some = docs.mapInArrow(_count(sketch, bits, min_docs), COUNTS_SQL)
    counts = scratch.save(some.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    kept = scratch.save(counts.groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("df")).where(F.col("df") >= min_docs).drop("df"), "kept")

    of_lang = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all_n").alias("lang_n"))
    own = scratch.save(counts.join(kept, ["lang", "term"]).drop("docs"), "own")
    totals = own.groupBy("lang", "source").agg(F.sum("n").alias("group_n"), F.count("*").alias("held"))
    groups = groups.select("lang", "source").join(totals, ["lang", "source"], "left").join(of_lang, "lang", "left").fillna(0, ["group_n", "held", "v", "lang_n"])
    groups = groups.withColumns({"total": F.col("group_n") + F.col("v"), "lang_total": F.col("lang_n") + F.col("v")})
    groups = scratch.save(groups.select("lang", "source", "held", "v", "total", "lang_total", F.expr(f"CASE WHEN v > 0 THEN {share('0', 'total')} END AS p0")), "totals")
    shares = own.join(groups.select("lang", "source", "total", "lang_total"), ["lang", "source"])
    shares = scratch.save(shares.select("lang", "term", "source", F.expr(f"{share('n', 'total')} AS p"), F.expr(f"{share('all_n', 'lang_total')} AS q")), "shares")

    term_part = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(divergence("p", "q")).alias("value"))
    term_part = _ranked(term_part, top)

    others = groups.select("lang", F.col("source").alias("item"), F.col("held").alias("held_b"), F.col("p0").alias("q0"))
    pairs = groups.select("lang", "source", "held", "v", "p0").join(others, "lang").where("source <> item")
    levels = scratch.save(shares.groupBy("lang", "source", "p").agg(F.count("*").alias("m")), "levels")
    # terms of the first source against the second's share of terms that it lacks, and the other way round
    first = levels.join(others, "lang").where("source <> item").groupBy("lang", "source", "item").agg(F.sum(F.expr(f"m * ({divergence('p', 'q0')})")).alias("first"))
    lacking = groups.select("lang", "source", "p0")
    second = levels.select("lang", F.col("source").alias("item"), F.col("p").alias("q"), "m").join(lacking, "lang").where("source <> item")
    second = second.groupBy("lang", "source", "item").agg(F.sum(F.expr(f"m * ({divergence('p0', 'q')})")).alias("second"))
    # terms that both hold, each pair once in the join and in both directions in the sums
    of = groups.select("lang", "source", "p0")
    held = shares.select("lang", "term", "source", "p").join(of, ["lang", "source"])
    a, b = (held.select("lang", "term", *(F.col(c).alias(f"{c}_{x}") for c in ("source", "p", "p0"))) for x in "ab")
    both = a.join(b, ["lang", "term"]).where("source_a < source_b")

    def sums(x: str, y: str) -> list[Column]:
        """What the shared terms add, and what the histograms have counted for them."""
        each = {"shared": (f"p_{x}", f"p_{y}"), "less1": (f"p_{x}", f"p0_{y}"), "less2": (f"p0_{x}", f"p_{y}")}
        return [F.sum(F.expr(divergence(*d))).alias(f"{name}_{x}") for name, d in each.items()]

    both = scratch.save(both.groupBy("lang", "source_a", "source_b").agg(F.count("*").alias("common"), *sums("a", "b"), *sums("b", "a")), "both")
    shared = None
    for x, y in ("ab", "ba"):
        part = both.select("lang", F.col(f"source_{x}").alias("source"), F.col(f"source_{y}").alias("item"), "common", *(F.col(f"{c}_{x}").alias(c) for c in ("shared", "less1", "less2")))
        shared = part if shared is None else shared.union(part)
    on = ["lang", "source", "item"]
    pairs = pairs.join(first, on, "left").join(second, on, "left").join(shared, on, "left").fillna(0, ["first", "second", "common", "shared", "less1", "less2"])
    value = f"shared + (first - less1) + (second - less2) + (v - held - held_b + common) * coalesce({divergence('p0', 'q0')}, 0)"
    pair_part = _ranked(pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.expr(value).alias("value")), None)
    return pair_part.union(term_part).select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), "rank")
