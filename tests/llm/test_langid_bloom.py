import zlib
from collections import Counter, defaultdict

import numpy as np

from emberlog.llm.langid_bloom import LanguageFilters, grams, learn, predict


def plain_grams(text):
    """(size, bytes) of all n-grams by the plain rule."""
    data = (" " + " ".join("".join(c if c.isalnum() and not c.isdecimal() else " " for c in text.lower()).split()) + " ").encode()
    return [(size, data[a : a + size]) for size in (1, 2, 3, 4) for a in range(len(data) - size + 1)]


def brute(rows, per_language=4000):
    """(doc_id, lang_pred, score) by exact sets of each language's most frequent n-grams; rows: doc_id, text, lang."""
    counts = defaultdict(Counter)
    for d, t, lang in rows:
        if zlib.crc32(str("" if d is None else d).encode()) % 4 != 2 and t is not None and lang is not None:
            counts[lang].update(plain_grams(t))
    held = {lang: {g for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:per_language]} for lang, c in sorted(counts.items())}
    out = []
    for d, t, _ in rows:
        if not t or not any(c.isalpha() for c in t):
            out.append((d, "und", 0.0))
            continue
        found = plain_grams(t)
        hits = {lang: sum(g in own for g in found) for lang, own in held.items()}
        best = max(hits, key=hits.get)
        out.append((d, best, hits[best] / sum(hits.values())))
    return out


def test_whole_table_against_exact_sets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in predict(spark, docs, learn(spark, docs)).collect()}
    want = brute([(r.doc_id, r.text, r.lang) for r in docs.collect()])
    assert len(want) == len(got) == docs.count()
    for d, lang, score in want:
        assert got[d].lang_pred == lang and abs(got[d].score - score) < 0.01
        assert got[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2)


def test_very_long_text_is_counted_whole(spark):
    """Pieces of a text join without a lost or doubled n-gram."""
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(500)]
    long = " ".join(rng.choice(words, 400_000)) + " der hund" * 3
    rows = [(0, "the cat", "en"), (1, " ".join(words[:100]), "xx"), (3, "der hund", "de"), (6, long, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(long) > 2 << 20
    model = learn(spark, docs)
    got = {r.doc_id: r for r in predict(spark, docs, model).collect()}
    data = np.frombuffer(f" {long} ".encode(), np.uint8)
    whole = [model.lookup(grams(data, size)) for size in (1, 2, 3, 4)]
    n, chance = sum(h.shape[1] for h in whole), model.chance()
    counts = np.array([sum(int(((h[0] >> np.uint64(k)) & np.uint64(1)).sum()) for h in whole) for k in range(3)])
    fixed = np.maximum((counts - chance * n) / (1 - chance), 0)
    assert got[6].lang_pred == "xx" == model.languages[int(fixed.argmax())] and abs(got[6].score - fixed.max() / fixed.sum()) < 1e-12


def test_copies_are_sampled_one_by_one(spark):
    from pyspark.sql import functions as F

    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("the very same text").alias("text"), F.lit("en").alias("lang"))
    for bound in (40, 400):
        model = learn(spark, docs, max_rows=bound)
        assert model.languages == ["en"] and {r.lang_pred for r in predict(spark, docs.limit(3), model).collect()} == {"en"}


def test_bitmask_lookup_and_false_positive_rate():
    rng = np.random.default_rng(1)
    held = {f"l{k:02d}": rng.integers(0, 1 << 32, 500).astype(np.uint64) for k in range(70)}
    held["l03"] = np.concatenate([held["l03"], held["l69"][:50]])
    f = LanguageFilters.build(held, 16)
    both = f.lookup(held["l69"][:50])
    assert ((both[0] >> np.uint64(3)) & np.uint64(1)).all() and ((both[1] >> np.uint64(69 - 64)) & np.uint64(1)).all()
    absent = f.lookup(rng.integers(1 << 40, 1 << 41, 200_000).astype(np.uint64))
    assert abs(((absent[0] >> np.uint64(3)) & np.uint64(1)).mean() - f.chance()[3]) < 1e-3
    assert grams(np.frombuffer(b"ab", np.uint8), 2).tolist() == [(2 << 16) + (97 << 8) + 98] and len(grams(np.frombuffer(b"a", np.uint8), 2)) == 0


def test_counts_by_batch_are_those_of_each_text():
    """Texts that share a batch, pieces of one text, and more languages than bits of a small mask."""
    rng = np.random.default_rng(2)
    texts = [" ".join("".join(rng.choice(list("abcdeé"), 4)) for _ in range(rng.integers(1, 60))) for _ in range(30)] + [None, "", "7", "a"]
    texts.append(" ".join("".join(rng.choice(list("abcdeé"), 4)) for _ in range(250_000)))
    for languages in (3, 70):
        held = {f"l{k:02d}": np.concatenate([grams(rng.choice(np.frombuffer(b"abcde \xc3\xa9", np.uint8), 400), s) for s in (1, 2, 3, 4)]) for k in range(languages)}
        model = LanguageFilters.build(held, 16)
        names, scores = model.predict(texts)
        chance = model.chance()
        for text, name, score in zip(texts, names, scores, strict=True):
            if not text or not any(c.isalpha() for c in text):
                assert (name, score) == ("und", 0.0)
                continue
            data = np.frombuffer(f" {text} ".encode(), np.uint8)
            found = [model.lookup(grams(data, size)) for size in (1, 2, 3, 4)]
            n = sum(f.shape[1] for f in found)
            counts = np.array([sum(int(((f[k // 64] >> np.uint64(k % 64)) & np.uint64(1)).sum()) for f in found) for k in range(languages)])
            fixed = np.maximum((counts - chance * n) / (1 - np.minimum(chance, 0.999)), 0)
            assert name == model.languages[int(fixed.argmax())] and abs(score - fixed.max() / fixed.sum()) < 1e-12


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = predict(spark, docs, learn(spark, docs)).join(docs, "doc_id").where("held_out").select("lang", "lang_pred", "score").collect()
    assert len(got) > 200 and sum(r.lang == r.lang_pred for r in got) / len(got) >= 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_edges(spark):
    rows = [(0, "the cat", "en"), (1, "the dog", "en"), (3, "der hund", "de"), (5, None, "en"), (6, "123 !?", None), (7, "", "de"), (None, "der der", "de"), (8, "the the", None)]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, score double")
    out = predict(spark, docs, learn(spark, docs)).collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == len(rows) and got[8].lang_pred == "en" and got[None].lang_pred == "de"
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (5, 6, 7))
    none = docs.limit(0)
    assert {r.lang_pred for r in predict(spark, docs, learn(spark, none)).collect()} == {"und"} and predict(spark, none, learn(spark, docs)).collect() == []
