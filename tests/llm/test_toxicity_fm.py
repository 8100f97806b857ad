import math
import zlib
from itertools import combinations

import numpy as np

from pyspark.sql import functions as F

from emberlog.llm.toxicity_fm import bucket, fit, keep_clean, learn, score_documents, training_rows


def test_pair_counts_beyond_its_terms():
    """Toxic only if an insult and a group stand together: no additive model separates that."""
    rng = np.random.default_rng(0)
    a, b, fill = bucket("w:insult"), bucket("w:group"), [bucket(f"w:{k}") for k in range(50)]
    rows, labels = [], []
    for k in range(1200):
        has_a, has_b = k % 2, k // 2 % 2
        rows.append(np.array(sorted({*rng.choice(fill, 5).tolist(), *([a] * has_a), *([b] * has_b)}), np.int64))
        labels.append(float(has_a and has_b))
    model = fit(rows, np.array(labels), epochs=30)
    place = {int(x): k for k, x in enumerate(model.features)}
    scores = model.score([np.array([place[t] for t in r if t in place], np.int64) for r in rows])
    assert ((scores >= 0.5) == (np.array(labels) == 1)).mean() > 0.98


def test_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = learn(spark, docs, labels)
    got = score_documents(spark, docs, model).where("held_out").join(labels, "doc_id").select("predicted", "toxic", "score").collect()
    hit = sum(r.predicted and r.toxic for r in got)
    assert hit / sum(r.toxic for r in got) > 0.85 and hit / sum(r.predicted for r in got) > 0.9
    kept = keep_clean(spark, docs.limit(500), model)
    assert kept.columns == docs.columns and 0 < kept.count() < 500


def brute(text, model):
    """The score by the plain rule: distinct features, and a loop over all their pairs."""
    words = set("".join(c if c.isalnum() and not c.isdecimal() else " " for c in (text or "").lower()).split())
    terms = {f"w:{w}" for w in words} | {f"p:{w[:n]}" for w in words for n in (4, 5) if len(w) > n}
    place = {int(b): k for k, b in enumerate(model.features)}
    xs = sorted({place[b] for b in (zlib.crc32(t.encode()) % (1 << 20) for t in terms) if b in place})
    raw = model.bias + sum(float(model.weights[x]) for x in xs)
    vectors = model.factors.tolist()
    raw += sum(math.sumprod(vectors[a], vectors[b]) for a, b in combinations(xs, 2))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, raw))))


def test_whole_table_against_all_pairs(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    more = spark.createDataFrame([(-1, " ".join(f"word{k} idiot" for k in range(150_000))), (-2, None), (-3, ""), (-4, "ÉTÉ x_y z9 4you ²nd")], "doc_id long, text string")
    table = docs.select("doc_id", "text").union(more)
    model = learn(spark, docs, labels)
    assert len(model.features) and np.abs(model.factors).max() > 0
    got = {r.doc_id: r for r in score_documents(spark, table, model).collect()}
    rows = table.collect()
    assert len(got) == len(rows)
    for r in rows:
        score = brute(r.text, model)
        assert abs(got[r.doc_id].score - score) < 1e-9 and got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.3)
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (2, "", 0.5), (None, "x y", 0.5)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    out = score_documents(spark, docs, learn(spark, docs, labels)).collect()
    assert len(out) == 4 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert score_documents(spark, docs.limit(0), learn(spark, docs.limit(0), labels.limit(0))).collect() == []


def test_sample_is_bounded_in_rows(spark):
    """One labelled id repeats, with one text and with many."""
    docs = spark.range(3000).select(F.when(F.col("id") < 2000, 4).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 700).alias("text"))
    docs = docs.union(spark.range(2000).select(F.lit(5).cast("long"), F.lit("one text")))
    labels = spark.range(4000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    assert 0 < training_rows(docs, labels, 500).count() <= 500
    assert training_rows(docs, labels.where("doc_id IN (4, 5)"), 500).count() == 500
    every = training_rows(docs, labels, 8000).count()
    assert every == docs.where("pmod(crc32(cast(doc_id AS string)), 4) <> 2").count()
