"""N-gram Jaccard self-join by filters under several global token orders.

Two sets with Jaccard similarity of t or more share a token in their prefixes, the first
n - ceil(t n) + 1 tokens, under *any* global order. Every order has its own inverted index
of prefixes; a pair of documents is a candidate only if it comes out of the index of each
order. The indexes are intersected as pairs of ids, before any text moves.

* Tokens are 64-bit hashes of shingles. All orders put tokens of rare sketch slots first:
  a sketch whose size follows the corpus counts every token, and its log-scaled counts are
  the leading key. A different hash breaks ties in each order. Any function of the token
  is a valid order, so the sketch's noise costs candidates, never links.
* Documents with equal sets form a class, found by 128-bit fingerprints; copies within a
  batch post once.
* Postings are packed by hash bucket, so that one exchange row holds many. Within the
  list of a token, sizes and positions bound the overlap that is still possible, which
  leaves no pair of documents that share little but a common passage. The postings of a
  token that the sketch takes for very frequent are dealt to parts.
* What is returned are connected components. In a long list of the first order a pivot is
  paired with every member; the list waits until links are known, and then only pairs of
  different components are left. All of them are tested, or, while they are many, those of
  further pivots. So a group of copies costs links in proportion to its size, and no
  link between different components is lost. In the other orders the members of a long
  list are marked with the list's bit; two documents with a common bit pass that order.
* A bit table, sized from their number, tells which documents' texts are needed; these are
  kept packed. Candidate pairs are dealt to buckets in which most pairs of a document
  meet, and a text goes once to each bucket that needs it, where its set is made once.
* Components are kept as a table and contracted: new links join components only.

Defined results of edge cases: null and empty texts, and texts of white space, have no
shingles and are their own component; a null doc_id takes no part and has a null
component; rows that repeat a doc_id are one document, whose texts count as linked; an
empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, release_memory, shuffle_partitions, unused_name

#: Least and most bits of a slot's number in the token sketch and in the table of needed documents.
SKETCH_BITS, NEED_BITS = (16, 24), (16, 28)
#: Counters or bytes that travel as one row.
CHUNK = 1 << 16
ORDERS = 3
#: Members up to which all pairs of a list are taken, and pairs a member up to which a waiting list is taken whole.
SHORT, WHOLE = 12, 4
#: Postings of a bucket, and of a part of a frequent token's list.
POSTINGS, PART = 400_000, 1 << 16
#: Documents whose postings are packed together.
POST_ROWS = 5000
#: Bits of a token's identity in a posting; a part's number stands above them.
TOKEN_BITS = 48
#: Pairs of a bucket in verification.
PAIRS = 512


def mix(h: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser."""
    z = h + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words; a full memory starts again."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 150_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | bytes | None, hashes: WordHashes, size: int = 5) -> np.ndarray:
    """The sorted distinct tokens of a whole text; bytes split and lower only by ASCII."""
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text
    words = raw.lower().split() if raw else []
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(size, len(words))
    out = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + w[i : len(w) - k + 1 + i]
    out = mix(out, 0)
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def prefix_size(n: int, t: int) -> int:
    return n - -(-t * n // 100) + 1


def ranks(tokens: np.ndarray, levels: np.ndarray, order: int) -> np.ndarray:
    """The place of each token in an order, which also names the token: its level, then 56 bits of a hash."""
    level = levels[(tokens >> np.uint64(64 - int(len(levels)).bit_length() + 1)).astype(np.int64)]
    return (level.astype(np.uint64) << np.uint64(56)) | (mix(tokens, 7 + order) >> np.uint64(8))


def prefix(tokens: np.ndarray, levels: np.ndarray, order: int, t: int) -> np.ndarray:
    """The first tokens in an order, as ranks."""
    p = prefix_size(len(tokens), t)
    out = np.partition(ranks(tokens, levels, order), p - 1)[:p]
    out.sort()
    return out


# --- tables of a bounded size, combined over all tasks -----------------------------------

CHUNKS_SQL = "chunk int, task int, data binary"
CHUNKS = pa.schema([("chunk", pa.int32()), ("task", pa.int32()), ("data", pa.binary())])


def _chunk_rows(values: np.ndarray, task: int) -> Iterator[dict]:
    """A table's chunks that hold anything, byte by byte, in which small numbers pack well."""
    for chunk in range(-(-len(values) // CHUNK)):
        part = values[chunk * CHUNK : (chunk + 1) * CHUNK]
        if part.any():
            planes = part.view("u1").reshape(len(part), -1).T
            yield {"chunk": chunk, "task": task, "data": pa.compress(np.ascontiguousarray(planes), codec="zstd", asbytes=True)}


def _chunk_of(data: bytes, size: int, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    raw = np.frombuffer(pa.decompress(data, decompressed_size=size * width, codec="zstd", asbytes=True), "u1")
    return raw.reshape(width, size).T.copy().view(kind).ravel()


def _combine(size: int, kind: str):
    """The chunks of several tasks to one: counters are added, bits are united."""

    def run(key, table):
        total = np.zeros(size, np.uint64)
        for c in table.column("data"):
            part = _chunk_of(c.as_py(), size, kind)
            total = total | part if kind == "u1" else total + part
        row = next(_chunk_rows(np.minimum(total, np.iinfo(kind).max).astype(kind), 0))
        return pa.Table.from_pylist([row | {"chunk": key[0].as_py()}], schema=CHUNKS)

    return run


def _total(chunks: DataFrame, length: int, kind: str) -> np.ndarray:
    """The combined table, whose length is bounded; tasks are combined in groups before these meet."""
    size = min(CHUNK, length)
    groups = max(1, math.isqrt((chunks.agg(F.max("task")).first()[0] or 0) + 1))
    some = chunks.groupBy("chunk", (F.col("task") % groups).alias("part")).applyInArrow(_combine(size, kind), CHUNKS_SQL)
    out = np.zeros(length, kind)
    for r in some.groupBy("chunk").applyInArrow(_combine(size, kind), CHUNKS_SQL).toLocalIterator():
        out[r.chunk * CHUNK : r.chunk * CHUNK + size] = _chunk_of(r.data, size, kind)
    return out


def _bits_for(n: int, least_most: tuple[int, int]) -> int:
    """The bits that number n slots, within bounds."""
    return min(max(int(n).bit_length(), least_most[0]), least_most[1])


# --- first pass: sizes, fingerprints, sketch ---------------------------------------------

SIGNED = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), *CHUNKS])
SIGNED_SQL = f"kind int, doc_id long, n long, f1 long, f2 long, {CHUNKS_SQL}"


def _sign(size: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        hashes, sketch = WordHashes(), np.zeros(1 << bits, "<u4")
        for batch in batches:
            n, f1, f2, slots, held = [], [], [], [], 0
            for text in batch.column("text"):
                s = shingles(text.as_py(), hashes, size)
                slots.append((s >> np.uint64(64 - bits)).astype(np.int64))
                held += len(s)
                if held > 1_000_000:
                    np.add.at(sketch, np.concatenate(slots), np.uint32(1))
                    slots, held = [], 0
                n.append(len(s))
                f1.append(int(mix(s, 1).sum(dtype=np.uint64).view(np.int64)))
                f2.append(int(mix(s, 2).sum(dtype=np.uint64).view(np.int64)))
            if slots:
                np.add.at(sketch, np.concatenate(slots), np.uint32(1))
            k = len(n)
            cols = {"kind": [0] * k, "doc_id": batch.column("doc_id"), "n": n, "f1": f1, "f2": f2}
            yield pa.RecordBatch.from_pydict(cols | {f.name: pa.nulls(k, f.type) for f in CHUNKS}, schema=SIGNED)
        for row in _chunk_rows(sketch, TaskContext.get().partitionId()):
            yield pa.RecordBatch.from_pylist([{"kind": 1} | row], schema=SIGNED)
        release_memory()

    return run


# --- second pass: postings of every order ------------------------------------------------


def _packed(columns: list[np.ndarray]) -> bytes:
    """Arrays of 8-byte numbers byte by byte, in which small numbers pack well."""
    out = b"".join(np.ascontiguousarray(c.astype("<u8").view("u1").reshape(-1, 8).T).tobytes() for c in columns)
    return pa.compress(out, codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int, k: int) -> list[np.ndarray]:
    raw = np.frombuffer(pa.decompress(data, decompressed_size=8 * n * k, codec="zstd", asbytes=True), "u1").reshape(k, 8, n)
    return [raw[i].T.copy().view("<u8").ravel() for i in range(k)]


def _steps(values: np.ndarray) -> np.ndarray:
    return np.diff(values.astype(np.uint64), prepend=np.uint64(0))


def _post(levels, parts: np.ndarray, size: int, t: int, buckets: int):
    """Rows (order, bucket) of packed postings; parts tells for each level into how many parts its tokens' lists are dealt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, identity = WordHashes(), np.uint64((1 << TOKEN_BITS) - 1)
        for batch in (whole.slice(a, POST_ROWS) for whole in batches for a in range(0, whole.num_rows, POST_ROWS)):
            seen: set[bytes] = set()
            ids, sizes, tokens = [], [], [[] for _ in range(ORDERS)]
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                s = shingles(text.as_py(), hashes, size) if doc_id.is_valid else ()
                if not len(s) or (same := mix(s, 1).sum().tobytes() + mix(s, 2).sum().tobytes()) in seen:
                    continue
                seen.add(same)
                ids.append(doc_id.as_py())
                sizes.append(len(s))
                for o in range(ORDERS):
                    tokens[o].append(prefix(s, levels.value, o, t))
            if not ids:
                continue
            lengths = np.array([len(p) for p in tokens[0]])
            doc = np.repeat(np.array(ids, np.int64), lengths)
            n = np.repeat(np.array(sizes, np.int64), lengths)
            at = np.arange(len(doc)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            rows = []
            for o in range(ORDERS):
                rank = np.concatenate(tokens[o])
                dealt = parts[(rank >> np.uint64(56)).astype(np.int64)]
                part = np.where(dealt > 1, mix(doc.astype(np.uint64), 6) % dealt + np.uint64(1), np.uint64(0))
                token = (rank & identity) | (part << np.uint64(TOKEN_BITS))
                to = (mix(token, 3) % np.uint64(buckets)).astype(np.int64)
                by = np.argsort(to, kind="stable")
                columns = [c[by] for c in (token, doc, n, at)]
                to = to[by]
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(to)) + 1, [len(to)]])
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    own = [c[a:b] for c in columns]
                    rows.append((o, int(to[a]), int(b - a), _packed([own[0], _steps(own[1]), _steps(own[2]), own[3]])))
            kinds = {"o": pa.int32(), "bucket": pa.int32(), "n": pa.int32(), "data": pa.binary()}
            yield pa.RecordBatch.from_pydict({c: pa.array([r[i] for r in rows], kind) for i, (c, kind) in enumerate(kinds.items())})
        release_memory()

    return run


def possible(n1, p1, n2, p2, t: int):
    """Whether sets of these sizes that share a token at these places, and none before, can be similar."""
    need = -(-t * (n1 + n2) // (100 + t))
    return (100 * np.minimum(n1, n2) >= t * np.maximum(n1, n2)) & (np.minimum(n1 - p1, n2 - p2) >= need)


def possible_columns(x: str, y: str, t: int) -> Column:
    """The same for columns n and at of two aliased tables."""
    need = f"({t} * ({x}.n + {y}.n) + {99 + t}) div {100 + t}"
    return F.expr(f"100 * least({x}.n, {y}.n) >= {t} * greatest({x}.n, {y}.n) AND least({x}.n - {x}.at, {y}.n - {y}.at) >= {need}")


#: kind 0: a candidate pair of order o; kind 1: a member a of a list of the first order that waits; kind 2: bits of a's long lists in order o.
FOUND = pa.schema([("kind", pa.int32()), ("o", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("token", pa.int64()), ("part", pa.int32()), ("n", pa.int64()), ("at", pa.int64())])
FOUND_SQL = "kind int, o int, a long, b long, token long, part int, n long, at long"


def _found(kind: int, o: int, **columns: np.ndarray) -> pa.RecordBatch:
    k = len(columns["a"])
    given = {"kind": np.full(k, kind, np.int32), "o": np.full(k, o, np.int32)} | columns
    return pa.RecordBatch.from_arrays([pa.array(given[f.name], f.type) if f.name in given else pa.nulls(k, f.type) for f in FOUND], schema=FOUND)


def _lists(t: int):
    """The packed postings of an order's bucket to candidate pairs, waiting members and marks."""

    def run(key, table):
        o = key[0].as_py()
        unpacked = [_unpacked(d.as_py(), n.as_py(), 4) for n, d in zip(table.column("n"), table.column("data"), strict=True)]
        token = np.concatenate([p[0] for p in unpacked])
        ids, n = (np.concatenate([np.cumsum(p[k], dtype=np.uint64) for p in unpacked]).astype(np.int64) for k in (1, 2))
        at = np.concatenate([p[3] for p in unpacked]).astype(np.int64)
        order = np.lexsort((n, token))
        token = token[order]
        edge = np.concatenate([[True], token[1:] != token[:-1], [True]])
        alone = edge[1:] & edge[:-1] & (token >> np.uint64(TOKEN_BITS) == 0)
        order, token = order[~alone], token[~alone]
        ids, n, at = ids[order], n[order], at[order]
        starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
        counts = np.diff(np.concatenate([starts, [len(token)]]))
        dealt = token[starts] >> np.uint64(TOKEN_BITS) > 0
        # members that can be the smaller or equal one of a pair
        low = n - at >= -(-2 * t * n // (100 + t))
        lows = np.add.reduceat(low, starts) if len(starts) else np.zeros(0, np.int64)
        a, b, out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
        short = np.repeat((counts <= SHORT) & (lows > 0), counts)
        group = np.repeat(np.arange(len(starts)), counts)
        for d in range(1, SHORT):
            i = np.flatnonzero(short[:-d] & (group[:-d] == group[d:])) if len(token) > d else np.zeros(0, np.int64)
            i = i[possible(n[i], at[i], n[i + d], at[i + d], t)]
            a.append(ids[i])
            b.append(ids[i + d])
        for g in np.flatnonzero(((counts > SHORT) & (lows > 0)) | dealt):
            own = slice(starts[g], starts[g] + counts[g])
            gi, gn, gp, gl = ids[own], n[own], at[own], low[own]
            if lows[g] <= SHORT and not dealt[g]:
                for k in np.flatnonzero(gl):
                    fit = possible(gn[k], gp[k], gn, gp, t)
                    a.append(np.full(int(fit.sum()), gi[k]))
                    b.append(gi[fit])
                continue
            name = int(token[starts[g]] & np.uint64((1 << TOKEN_BITS) - 1))
            if o:
                out.append((gi, np.full(len(gi), 1 << name % 63)))
                continue
            # the pivot has the fewest rarer tokens before its own: it is most like the others
            k = int(np.lexsort((mix(gi.astype(np.uint64), 5), gp))[0])
            fit = possible(gn[k], gp[k], gn, gp, t)
            a.append(np.full(int(fit.sum()), gi[k]))
            b.append(gi[fit])
            out.append(_found(1, o, a=gi, token=np.full(len(gi), name), part=np.full(len(gi), token[starts[g]] >> np.uint64(TOKEN_BITS), np.int32), n=gn, at=gp))
        if o and out:
            marked, to = np.unique(np.concatenate([m[0] for m in out]), return_inverse=True)
            bits = np.zeros(len(marked), np.int64)
            np.bitwise_or.at(bits, to, np.concatenate([m[1] for m in out]))
            out = [_found(2, o, a=marked, token=bits)]
        a, b = np.concatenate(a), np.concatenate(b)
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)[a != b], axis=0)
        release_memory()
        return pa.Table.from_batches([_found(0, o, a=both[:, 0].copy(), b=both[:, 1].copy()), *out], schema=FOUND)

    return run


# --- third pass: the texts of documents in pairs -----------------------------------------


def _slots(ids: np.ndarray, bits: int) -> np.ndarray:
    return (mix(ids.astype(np.uint64), 4) >> np.uint64(64 - bits)).astype(np.int64)


def _need(bits: int):
    """The bit table of these ids, for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table = np.zeros(1 << bits - 3, "u1")
        for batch in batches:
            slot = _slots(batch.column("id").to_numpy(), bits)
            np.bitwise_or.at(table, slot >> 3, np.left_shift(1, slot & 7).astype("u1"))
        rows = list(_chunk_rows(table, TaskContext.get().partitionId()))
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=CHUNKS)

    return run


def _hold(needed, bits: int):
    """id and packed text of the documents that the bit table names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.filter(batch.column("doc_id").is_valid())
            ids = known.column("doc_id").to_numpy()
            slot = _slots(ids, bits)
            wanted = np.flatnonzero((needed.value[slot >> 3] >> (slot & 7).astype("u1")) & 1)
            raw = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in known.column("text").take(pa.array(wanted))]
            packed = [pa.compress(r, codec="zstd", asbytes=True) for r in raw]
            yield pa.RecordBatch.from_pydict({"id": pa.array(ids[wanted]), "size": pa.array([len(r) for r in raw], pa.int64()), "text": pa.array(packed, pa.binary())})

    return run


def _verify(size: int, t: int):
    """The pairs of a bucket whose sets are similar; every set is made once."""

    def run(pairs, texts):
        hashes, sets = WordHashes(), {}
        for i, n, data in zip(*(texts.column(c) for c in ("id", "size", "text")), strict=True):
            raw = pa.decompress(data.as_buffer(), decompressed_size=n.as_py(), codec="zstd", asbytes=True) if n.as_py() else b""
            sets.setdefault(i.as_py(), []).append(shingles(raw, hashes, size))

        def similar(u: np.ndarray, v: np.ndarray) -> bool:
            if not len(u) or not len(v) or 100 * min(len(u), len(v)) < t * max(len(u), len(v)):
                return False
            both = np.concatenate([u, v])
            both.sort()
            shared = int((both[1:] == both[:-1]).sum())
            return 100 * shared >= t * (len(both) - shared)

        ends = zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist(), strict=True)
        keep = [any(similar(u, v) for u in sets.get(a, ()) for v in sets.get(b, ())) for a, b in ends]
        return pairs.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


# --- components --------------------------------------------------------------------------


def components(spark: SparkSession, scratch: Scratch, edges: DataFrame) -> DataFrame:
    """edges (a, b) to (v, label): the smallest vertex of each vertex's component."""
    both = edges.select(F.col("a").alias("v"), F.col("b").alias("u")).union(edges.select("b", "a")).distinct()
    both = scratch.save(both, "edges")
    labels = scratch.save(both.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("label")), "labels")
    while True:
        of = labels.select(F.col("v").alias("u"), F.col("label").alias("near"))
        near = both.join(of, "u").groupBy("v").agg(F.min("near").alias("near"))
        step = scratch.save(labels.join(near, "v").select("v", F.col("label").alias("old"), F.least("label", "near").alias("label")), "step")
        jump = step.select(F.col("v").alias("label"), F.col("label").alias("far"))
        new = step.join(jump, "label", "left").select("v", "old", F.least("label", F.coalesce("far", "label")).alias("label"))
        new = scratch.save(new, "labels")
        scratch.drop(step, labels)
        labels = new.select("v", "label")
        labels.scratch_path = new.scratch_path
        if new.where("label <> old").isEmpty():
            scratch.drop(both)
            return labels


# --- the join ----------------------------------------------------------------------------


def jaccard_components(spark: SparkSession, docs: DataFrame, size: int = 5, t: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs (a written table: doc_id, text); t in per cent."""
    scratch = Scratch(spark, "ngram-join")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    words = (source.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 6
    sketch_bits = _bits_for(words // 32, SKETCH_BITS)
    signed = scratch.save(source.mapInArrow(_sign(size, sketch_bits), SIGNED_SQL), "signed", "kind")
    signs = signed.where("kind = 0").select("doc_id", "n", "f1", "f2")
    counts = _total(signed.where("kind = 1").select("chunk", "task", "data"), 1 << sketch_bits, "<u4")
    # counts on a log scale; what is below the sketch's noise is one level
    noise = counts.mean() + 4 * np.sqrt(counts.mean() + 1)
    level = np.where(counts <= noise, 0, np.minimum(255, 8 * np.log2(np.maximum(counts / np.float32(noise), 1)) + 1)).astype(np.uint8)
    levels = spark.sparkContext.broadcast(level)
    parts = np.minimum(np.ceil(noise * 2.0 ** (np.arange(256) / 8) / PART), (1 << 64 - TOKEN_BITS) - 2).astype(np.uint64)

    named = signs.where("doc_id IS NOT NULL AND n > 0")
    classes = named.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep"))
    reps = scratch.save(named.join(classes, ["n", "f1", "f2"]).select("doc_id", "rep").distinct(), "reps")
    first = reps.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z"))
    split = first.where("a <> z").select("doc_id", "a").join(reps, "doc_id").select("a", F.col("rep").alias("b")).where("a <> b")
    rep_of = scratch.save(first.select("doc_id", F.col("a").alias("rep")), "rep-of")

    total = named.agg(F.sum(F.col("n") * (100 - t) / 100 + 1)).first()[0] or 0
    buckets = max(shuffle_partitions(spark), int(total // POSTINGS) + 1)
    posted = source.mapInArrow(_post(levels, parts, size, t, buckets), "o int, bucket int, n int, data binary")
    found = scratch.save(posted.groupBy("o", "bucket").applyInArrow(_lists(t), FOUND_SQL), "found", "kind")

    def of_reps(table: DataFrame, column: str) -> DataFrame:
        """The column's ids replaced by those of their classes; an id with several texts stands for the class of each."""
        return table.join(reps.select(F.col("doc_id").alias(column), F.col("rep").alias("class")), column).drop(column).withColumnRenamed("class", column)

    def each_once(pairs: DataFrame) -> DataFrame:
        return pairs.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.bit_or("orders").alias("orders"))

    in_order = found.where("kind = 0").select("a", "b", F.expr("shiftleft(1, o)").alias("orders"))
    seen = scratch.save(each_once(of_reps(of_reps(each_once(in_order), "a"), "b")), "seen")
    bits = [F.bit_or(F.when(F.col("o") == o, F.col("token")).otherwise(0)).alias(f"bits{o}") for o in range(1, ORDERS)]
    marks = scratch.save(of_reps(found.where("kind = 2").select("a", "o", "token"), "a").groupBy("a").agg(*bits), "marks")
    members = scratch.save(of_reps(found.where("kind = 1").select("a", "token", "part", "n", "at"), "a").distinct().withColumnRenamed("a", "id"), "members")
    scratch.drop(found)

    def in_all_orders(pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b, orders) those that every other order has as well, by its pairs or by a long list's mark."""
        for side in "ab":
            of = marks.select(F.col("a").alias(side), *(F.col(f"bits{o}").alias(f"{side}{o}") for o in range(1, ORDERS)))
            pairs = pairs.join(of, side, "left")
        for o in range(1, ORDERS):
            pairs = pairs.where(f"coalesce(orders, 0) & {1 << o} <> 0 OR coalesce(a{o} & b{o}, 0) <> 0")
        return pairs.select("a", "b")

    tested = scratch.save(in_all_orders(seen.where("orders & 1 = 1")), "candidates")
    needed = scratch.save(tested.select(F.col("a").alias("id")).union(tested.select("b")).union(members.select("id")).distinct(), "needed")
    need_bits = _bits_for(16 * needed.count(), NEED_BITS)
    table = spark.sparkContext.broadcast(_total(needed.mapInArrow(_need(need_bits), CHUNKS_SQL), 1 << need_bits - 3, "u1"))
    held = scratch.save(source.mapInArrow(_hold(table, need_bits), "id long, size long, text binary"), "held")

    def linked(pairs: DataFrame) -> DataFrame:
        """The similar ones of candidate pairs, dealt to buckets in which most pairs of a document meet."""
        ends = pairs.select(F.col("a").alias("v"), F.col("b").alias("u")).union(pairs.select("b", "a"))
        least = scratch.save(ends.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("g")), "least")
        keyed = pairs
        for side in "ab":
            keyed = keyed.join(least.select(F.col("v").alias(side), F.col("g").alias(f"g{side}")), side)
        keyed = keyed.select("a", "b", F.least("ga", "gb").alias("g"))
        many = keyed.groupBy("g").agg(F.count("*").alias("k"))
        part = F.expr(f"pmod(xxhash64(b), (k + {PAIRS // 2 - 1}) div {PAIRS // 2})")
        into = max(shuffle_partitions(spark), pairs.count() // PAIRS + 1)
        dealt = scratch.save(keyed.join(many, "g").select("a", "b", F.pmod(F.xxhash64("g", part), F.lit(into)).alias("bucket")), "dealt")
        places = scratch.save(dealt.select("bucket", F.col("a").alias("id")).union(dealt.select("bucket", "b")).distinct(), "places")
        texts = held.join(places, "id").select("bucket", "id", "size", "text")
        links = dealt.groupBy("bucket").cogroup(texts.groupBy("bucket")).applyInArrow(_verify(size, t), "a long, b long")
        links = scratch.save(links, "links")
        scratch.drop(least, dealt, places)
        return links

    def contracted(comp: DataFrame, links: DataFrame) -> DataFrame:
        """The components (id, comp) after these links; only those that a link joins take part in the search."""
        edges = links
        for side in "ab":
            edges = edges.join(comp.select(F.col("id").alias(side), F.col("comp").alias(f"c{side}")), side)
        edges = scratch.save(edges.select(F.col("ca").alias("a"), F.col("cb").alias("b")).where("a <> b").distinct(), "joined")
        labels = components(spark, scratch, edges)
        new = scratch.save(comp.join(labels.withColumnRenamed("v", "comp"), "comp", "left").select("id", F.coalesce("label", "comp").alias("comp")), "comp")
        scratch.drop(edges, labels, comp)
        return new

    comp = scratch.save(reps.select(F.col("rep").alias("id"), F.col("rep").alias("comp")).distinct(), "comp")
    comp = contracted(comp, linked(tested).union(split))
    asked_before = None
    turn = 0
    while True:
        turn += 1
        placed = scratch.save(members.join(comp, "id"), "placed")
        members, pairs, asked_before = _next_pairs(scratch, placed, asked_before, t, turn)
        if members is None:
            break
        new = each_once(pairs.withColumn("orders", F.lit(0))).drop("orders").join(tested, ["a", "b"], "left_anti")
        new = scratch.save(in_all_orders(new.join(seen, ["a", "b"], "left")), "new")
        if new.isEmpty():
            continue
        tested = tested.union(new)
        comp = contracted(comp, linked(new))
    result = rep_of.join(comp, F.col("rep") == F.col("id")).select(F.col("doc_id").alias("of"), F.col("comp").alias("component"))
    own = signs.join(scratch.save(result, "result"), F.col("doc_id") == F.col("of"), "left")
    return own.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _next_pairs(scratch: Scratch, placed: DataFrame, asked_before: DataFrame | None, t: int, turn: int) -> tuple[DataFrame | None, DataFrame | None, DataFrame | None]:
    """The lists that still wait, the pairs of this turn, and what has asked so far; nothing when no list has two components.

    placed: the members (token, part, id, n, at) of waiting lists with their component.
    Those outside the largest component of a list ask all its members of other components:
    all of them, if that makes few pairs, else the next pivots.
    """
    sizes = placed.groupBy("token", "comp").agg(F.count("*").alias("c"))
    open_lists = sizes.groupBy("token").agg(F.sum("c").alias("m"), F.max("c").alias("top"), F.max_by("comp", F.struct("c", "comp")).alias("largest")).where("m > top")
    waiting = placed.join(scratch.save(open_lists.drop("top"), "open"), "token")
    rest = waiting.where("comp <> largest")
    if asked_before is not None:
        rest = rest.join(asked_before, ["token", "id"], "left_anti")
    rest = scratch.save(rest.select("token", "id", "n", "at", "comp", "m"), "rest")
    if rest.isEmpty():
        return None, None, None
    waiting = scratch.save(waiting.join(rest.select("token").distinct(), "token", "left_semi").drop("largest", "m"), "waiting")
    parts = waiting.select("token", "part").distinct()

    def met(asking: DataFrame) -> DataFrame:
        """Members that ask, against all members of their list: each part of a list meets all that ask."""
        x, y = asking.join(parts, "token").alias("x"), waiting.alias("y")
        pairs = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.part") == F.col("y.part")))
        return pairs.where("x.comp <> y.comp").where(possible_columns("x", "y", t)).select("x.token", "x.m", F.col("x.id").alias("a"), F.col("y.id").alias("b"))

    light = rest.join(rest.groupBy("token").agg(F.count("*").alias("k")).where("k < 1024"), "token", "left_semi")
    few = met(light).groupBy("token").agg(F.count("*").alias("pairs"), F.first("m").alias("m")).where(f"pairs <= greatest({2 * WHOLE} * m, 4000)")
    none = light.select("token").distinct().join(met(light).select("token").distinct(), "token", "left_anti")
    whole = scratch.save(few.select("token").union(none), "whole")
    heavy = rest.join(whole, "token", "left_anti")
    salt = F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(8 * 2**turn))
    pivots = heavy.groupBy("token", salt.alias("salt")).agg(F.min_by(F.struct("id", "n", "at", "comp", "m"), F.struct("at", F.xxhash64("id"), "id", "n")).alias("p"))
    pivots = scratch.save(pivots.select("token", "p.*"), "pivots")
    asked = pivots.select("token", "id")
    pairs = met(rest.join(whole, "token", "left_semi")).union(met(pivots)).select("a", "b")
    return waiting.join(whole, "token", "left_anti").drop("comp"), pairs, asked if asked_before is None else asked_before.union(asked)


def keep_one(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Of each component the document with the smallest doc_id stays, with all its columns."""
    gone = unused_name("gone", docs)
    out = jaccard_components(spark, docs.select("doc_id", "text")).where("component_id <> doc_id").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(out, F.col("doc_id") == F.col(gone), "left_anti")
