"""Byte-level BPE through a global shuffle of distinct words.

1. Pre-tokens: texts whose characters are all Latin or general punctuation are split
   by the JVM's regular expressions, where its classes agree with the tokenizer's; all
   others by the ``regex`` library. Each Arrow batch is a *block*: it turns its
   pre-tokens into a dictionary of distinct words and one packed row of codes, in
   which the position of a code is the position of the pre-token.
2. The (word, block, code) rows are shuffled by word and sorted, each distinct word is
   encoded once, and its ids go back to all blocks that hold the word.
3. Codes and ids of a block meet again by the block's key; a gather reassembles the
   ids of every document by position. Decoding joins the table of token bytes, which
   is bounded by the vocabulary, to the ids.

Words and codes are made by two passes over the texts, so that neither is kept on disk
besides its own shuffle. A digest of each block's rows and dictionary goes both ways; a block
whose two passes differ (an input that isn't deterministic) is an error, not a wrong row.

A common word has one row for each block, not one for each occurrence, so that no
word's occurrences meet in one task, and a block is bounded by the rows and bytes of an
Arrow batch.

Defined results of edge cases: a null or empty text has no tokens and decodes to no
bytes; repeated rows and null doc_ids are encoded like any other row; columns of the
input other than doc_id and text are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release_memory

#: Characters for which the JVM's classes and the tokenizer's are the same.
PLAIN = r"^[\x00-ɏ‐-‧‰-⁞]*$"
#: White space among them, and all that the tokenizer's \s stands for.
JVM_SPACE = r"\x09-\x0D\x20\x85\xA0"
#: Pre-tokens that are packed or reassembled at a time.
STEP = 1_000_000


def jvm_pattern(pattern: str) -> str:
    """The tokenizer's pattern with white space spelt out, as the JVM's \\s is ASCII only."""
    return pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^{JVM_SPACE}\p{{L}}\p{{N}}]").replace(r"\s+(?!\S)", rf"[{JVM_SPACE}]+(?![^{JVM_SPACE}])").replace(r"\s+", rf"[{JVM_SPACE}]+")


@cache
def ranks(vocabulary: str) -> dict[bytes, int]:
    with open(vocabulary, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@cache
def encoder(vocabulary: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks(vocabulary), special_tokens={})


@cache
def token_tables(vocabulary: str) -> tuple[pa.Array, pa.Array]:
    """By id: the token's bytes, and the id in decimal followed by a comma."""
    table = {rank: token for token, rank in ranks(vocabulary).items()}
    top = max(table, default=-1) + 1
    return pa.array([table.get(i, b"") for i in range(top)], pa.large_binary()), pa.array([b"%d," % i for i in range(top)], pa.large_binary())


def id_type(vocabulary: str) -> str:
    return "<u2" if max(ranks(vocabulary).values(), default=0) < 1 << 16 else "<u4"


def _pack(codes: np.ndarray, place: np.ndarray) -> bytes:
    """Places of the codes byte by byte: the high bytes hardly differ, so that they pack to nothing."""
    if not len(codes):
        return b""
    planes = np.empty((4, len(codes)), "u1")
    for a in range(0, len(codes), STEP):  # in steps, as a worker holds a whole block besides
        planes[:, a : a + STEP] = place[codes[a : a + STEP]].astype("<u4").view("u1").reshape(-1, 4).T
    return pa.Codec("zstd", compression_level=9).compress(planes, asbytes=True)


def _unpack(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    raw = np.frombuffer(pa.decompress(data, decompressed_size=4 * n, codec="zstd", asbytes=True), "u1")
    return np.ascontiguousarray(raw.reshape(4, n).T).view("<u4").ravel().astype(np.int64)


WORDS = pa.schema([("word", pa.string()), ("block", pa.int64()), ("code", pa.int32())])
CODES = pa.schema([("block", pa.int64()), ("digest", pa.string()), ("docs", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("codes", pa.binary())])
WORDS_SQL = "word string, block long, code int"
CODES_SQL = "block long, digest string, docs array<long>, sizes array<int>, codes binary"


def _blocks(pattern: str):
    """Arrow batches (doc_id, text of the texts that aren't plain, words of those that are) to dictionary-coded blocks."""

    def run(batches: Iterator[pa.RecordBatch]):
        import regex
        from pyspark import TaskContext

        find = regex.compile(pattern).findall
        task = TaskContext.get().partitionId()
        for k, batch in enumerate(batches):
            if not batch.num_rows:
                continue
            words, texts, doc_ids = batch.column("words"), batch.column("text"), batch.column("doc_id")
            plain = words.is_valid()
            flat, sizes = words.flatten(), words.value_lengths().drop_null().to_numpy(zero_copy_only=False).astype(np.int32)
            docs = doc_ids.filter(plain).to_pylist()
            if texts.null_count < len(texts):  # texts that aren't plain follow those that are
                lists = [find(t) for t in texts.drop_null().to_pylist()]
                flat = pa.concat_arrays([flat.cast(pa.string()), pa.array([w for x in lists for w in x], pa.string())])
                sizes = np.concatenate([sizes, np.array([len(x) for x in lists], np.int32)])
                docs += doc_ids.filter(texts.is_valid()).to_pylist()
            coded = flat.cast(pa.string()).dictionary_encode()
            del flat, words, texts
            codes = coded.indices.to_numpy(zero_copy_only=False)
            # frequent words get small codes, which pack better
            counts = np.zeros(len(coded.dictionary), np.int64)
            for a in range(0, len(codes), STEP):
                counts += np.bincount(codes[a : a + STEP], minlength=len(counts))
            order = np.argsort(-counts, kind="stable")
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order), dtype=np.int32)
            dictionary = coded.dictionary.take(pa.array(order))
            digest = hashlib.blake2b(str(docs).encode(), digest_size=16)
            for buffer in dictionary.buffers()[1:]:
                digest.update(buffer or b"")
            del coded
            yield (task << 32) + k, digest.hexdigest(), docs, sizes, dictionary, codes, place
            release_memory()
        release_memory()

    return run


def _words(pattern: str):
    blocks = _blocks(pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, digest, _, _, dictionary, *_ in blocks(batches):
            yield pa.RecordBatch.from_pydict({"word": [digest], "block": [block], "code": [-1]}, schema=WORDS)
            order = pc.sort_indices(dictionary).cast(pa.int32())  # neighbours share their beginnings, which pack
            for a in range(0, len(dictionary), 50_000):
                codes = order.slice(a, 50_000)
                yield pa.RecordBatch.from_arrays([dictionary.take(codes), pa.array(np.full(len(codes), block)), codes], schema=WORDS)

    return run


def _codes(pattern: str):
    blocks = _blocks(pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, digest, docs, sizes, _, codes, place in blocks(batches):
            yield pa.RecordBatch.from_pydict({"block": [block], "digest": [digest], "docs": [docs], "sizes": [sizes], "codes": [_pack(codes, place)]}, schema=CODES)

    return run


def _encode(vocabulary: str, pattern: str):
    """Rows sorted by word to (block, code, ids); each distinct word is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, kind = encoder(vocabulary, pattern).encode_ordinary, id_type(vocabulary)
        last, ids = None, b""
        for batch in batches:
            out = []
            for word, code in zip(batch.column("word").to_pylist(), batch.column("code").to_pylist(), strict=True):
                if code < 0:  # the digest of a block's dictionary
                    out.append(word.encode())
                    continue
                if word != last:
                    last, ids = word, np.asarray(encode(word), kind).tobytes()
                out.append(ids)
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("code"), pa.array(out, pa.binary())], names=["of", "code", "ids"])

    return run


def _slices(offsets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions offsets[i] .. offsets[i] + sizes[i] - 1 for every i, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(offsets - (ends - sizes), sizes)


def block_ids(docs: pa.Table, words: pa.Table, kind: str) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """doc ids, tokens of each and all their ids, in steps of a bounded number of pre-tokens."""
    order = np.argsort(words.column("code").to_numpy(), kind="stable")
    taken = words.column("ids").combine_chunks().cast(pa.large_binary()).take(pa.array(order))
    if docs.num_rows != 1 or not len(order) or taken[0].as_py() != docs.column("digest")[0].as_py().encode():
        raise ValueError("the two passes over the texts of a block differ")
    taken = taken.slice(1)
    ends = np.frombuffer(taken.buffers()[1], np.int64, count=len(order), offset=8)
    flat, width = np.frombuffer(taken.buffers()[2][ends[0] :], kind), np.dtype(kind).itemsize
    starts, lengths = (ends[:-1] - ends[0]) // width, np.diff(ends) // width
    for row in docs.to_pylist():
        doc_ids, sizes = row["docs"], np.asarray(row["sizes"], np.int64)
        codes, upto = _unpack(row["codes"], int(sizes.sum())), np.concatenate([[0], np.cumsum(sizes)])
        a = 0
        while a < len(doc_ids):
            b = max(a + 1, int(np.searchsorted(upto, upto[a] + STEP, "right")) - 1)
            own = codes[upto[a] : upto[b]]
            per_word = lengths[own]
            ids = flat[_slices(starts[own], per_word)]
            edge = np.concatenate([[0], np.cumsum(per_word)])
            yield doc_ids[a:b], np.diff(edge[upto[a : b + 1] - upto[a]]), ids
            a = b


def _views(table: pa.Array, ids: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """The joined entries of a table for the ids, and where each ends."""
    got = table.take(pa.array(ids.astype(np.int64)))
    ends = np.frombuffer(got.buffers()[1], np.int64, count=len(ids) + 1)
    return memoryview(got.buffers()[2]) if len(ids) and got.buffers()[2] is not None else memoryview(b""), ends


def _digests(vocabulary: str):
    def run(key, docs: pa.Table, words: pa.Table) -> pa.Table:
        tokens, decimal = token_tables(vocabulary)
        out: dict[str, list] = {"doc_id": [], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for doc_ids, sizes, ids in block_ids(docs, words, id_type(vocabulary)):
            edge = np.concatenate([[0], np.cumsum(sizes)])
            for name, table, cut in (("ids_sha256", decimal, 1), ("decoded_sha256", tokens, 0)):
                data, ends = _views(table, ids)
                out[name] += [hashlib.sha256(data[ends[a] : ends[b] - (cut if b > a else 0)]).hexdigest() for a, b in zip(edge[:-1], edge[1:], strict=True)]
            out["doc_id"] += doc_ids
            out["n_tokens"] += sizes.tolist()
        return pa.table(out, schema=pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]))

    return run


def _arrays(vocabulary: str):
    def run(key, docs: pa.Table, words: pa.Table) -> pa.Table:
        tokens, _ = token_tables(vocabulary)
        ids_of, texts, doc_ids = [], [], []
        for docs_of, sizes, ids in block_ids(docs, words, id_type(vocabulary)):
            edge = np.concatenate([[0], np.cumsum(sizes)])
            data, ends = _views(tokens, ids)
            doc_ids += docs_of
            ids_of += [ids[a:b].astype(np.int32) for a, b in zip(edge[:-1], edge[1:], strict=True)]
            texts += [bytes(data[ends[a] : ends[b]]).decode("utf-8", "replace") for a, b in zip(edge[:-1], edge[1:], strict=True)]
        return pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "ids": pa.array(ids_of, pa.list_(pa.int32())), "decoded": pa.array(texts, pa.string())})

    return run


def _encoded(docs: DataFrame, vocabulary: str, pattern: str):
    """The codes of the blocks, and (of, code, ids) of their words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = text.rlike(PLAIN)
    split = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.when(~plain, text).alias("text"),
        F.when(plain, F.regexp_extract_all(text, F.lit(jvm_pattern(pattern)), F.lit(0))).alias("words"),
    )
    pairs = split.mapInArrow(_words(pattern), WORDS_SQL).repartition("word").sortWithinPartitions("word")
    ids = pairs.mapInArrow(_encode(vocabulary, pattern), "of long, code int, ids binary")
    return split.mapInArrow(_codes(pattern), CODES_SQL), ids


def encode_digests(spark: SparkSession, docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """docs: a written table. doc_id, n_tokens, SHA-256 of the comma-joined ids and of the decoded bytes."""
    codes, ids = _encoded(docs, vocabulary, pattern)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return codes.groupBy("block").cogroup(ids.groupBy("of")).applyInArrow(_digests(vocabulary), schema)


def encode_documents(spark: SparkSession, docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """docs: a written table. doc_id, the token ids, and the text decoded from them."""
    codes, ids = _encoded(docs, vocabulary, pattern)
    return codes.groupBy("block").cogroup(ids.groupBy("of")).applyInArrow(_arrays(vocabulary), "doc_id long, ids array<int>, decoded string")
