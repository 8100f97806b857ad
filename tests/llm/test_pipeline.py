import hashlib

import corpus_pipeline
from emberlog.llm import toxicity_fm
from test_bpe_shuffle import expected
from test_decontam import brute as leaks
from test_line_runs import brute as line_dedup
from test_ngram_join import brute as components


def test_stages_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    model = toxicity_fm.learn(spark, docs, spark.read.parquet(f"{sf}/labels.parquet"))
    toxic = {r.doc_id for r in toxicity_fm.score_documents(spark, docs, model).where("predicted = 1").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id not in toxic]
    rows = [(d, t) for d, _, _, t in line_dedup(rows)]
    kept = {c for _, _, c in components(rows)}
    rows = [(d, t) for d, t in rows if d in kept]
    leaked = {d for d, _ in leaks(rows, items)}
    want = {d: expected(t) for d, t in rows if d not in leaked}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == want and 0 < len(want) < docs.count()


def test_each_stage_keeps_the_columns(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.createDataFrame([(1, "some clean text", None, None, None), (2, None, "en", "s", 0), (2, None, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.count() == 3
        assert stage(spark, docs.limit(0), sf).count() == 0
    assert hashlib.sha256(b"").hexdigest() in {r.decoded_sha256 for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()}
