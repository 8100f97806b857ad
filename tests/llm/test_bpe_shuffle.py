import hashlib

import public_tokenizers
import pytest

from emberlog.llm.bpe_shuffle import encode_digests, encode_documents, encoder

VOCABULARY, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
TEXTS = [
    "Hello world, it's  fine.\n\nNew   line \t tab ", "", None, "naïve café – “quoted” … 123 4½² x²", "日本語テキスト と mixed　spaces here", "\x1c\x1d \x85\xa0x \xa0", "'s't're've 'll''d 's",
    "emoji 👩‍👩‍👧 ok Ɤᲊ 𞤀 ", "a" * 3000 + " " * 500 + "b", "!!!???...'s -- 'sabc don't", "dup", "dup", "\n", " ", "اللغة ١٢٣ हिन्दी क्षि", "  em", "x​y­", "Ⅷ ⅳ ªº ǅ ʰ",
]


def expected(text):
    ids = encoder(VOCABULARY, PATTERN).encode_ordinary(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_same_as_the_library(spark):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, word string")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in encode_digests(spark, docs, VOCABULARY, PATTERN).collect()}
    assert got == {i: expected(t) for i, t in enumerate(TEXTS)}


def test_ids_and_round_trip(spark):
    docs = spark.createDataFrame([(None, "it's one"), (1, "two  três"), (1, "two  três")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, list(r.ids), r.decoded) for r in encode_documents(spark, docs, VOCABULARY, PATTERN).collect())
    encode = encoder(VOCABULARY, PATTERN).encode_ordinary
    assert got == [(0, encode("it's one"), "it's one")] + 2 * [(1, encode("two  três"), "two  três")]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert encode_digests(spark, docs, VOCABULARY, PATTERN).collect() == []


@pytest.mark.parametrize("table", ["documents"])
def test_whole_table(spark, table):
    docs = spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in encode_digests(spark, docs, VOCABULARY, PATTERN).collect()}
    assert got == {r.doc_id: expected(r.text) for r in docs.collect()}
