import random
import tempfile
from collections import defaultdict

from emberlog.llm import ngram_join
from emberlog.llm.ngram_join import jaccard_components, keep_one


def shingle_set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    if not words:
        return set()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)}


def brute(rows):
    sets = [(d, shingle_set(t)) for d, t in rows]
    parent = {d: d for d, _ in rows if d is not None}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    holders = defaultdict(list)
    for k, (d, s) in enumerate(sets):
        if d is not None:
            for x in s:
                holders[x].append(k)
    tested = set()
    for ks in holders.values():
        for i, a in enumerate(ks):
            for b in ks[i + 1 :]:
                if (a, b) not in tested:
                    tested.add((a, b))
                    (d, s), (e, r) = sets[a], sets[b]
                    if 100 * len(s & r) >= 80 * len(s | r):
                        x, y = root(d), root(e)
                        parent[max(x, y)] = min(x, y)
    return sorted(((d, len(s), root(d) if d is not None else None) for d, s in sets), key=str)


def run(spark, rows):
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n long")
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(spark, docs).collect()), key=str)


def near_texts(rnd):
    """Groups around the threshold: many changes of one base, chains, a passage that all share, short texts."""
    word = lambda: "".join(rnd.choices("abcdefghij", k=rnd.randint(2, 7)))
    base, passage = [word() for _ in range(90)], [word() for _ in range(50)]
    texts = []
    for _ in range(60):
        w = list(base)
        for _ in range(rnd.randint(0, 4)):
            w[rnd.randrange(len(w))] = word()
        texts.append(" ".join(w))
    for k in range(25):
        texts.append(" ".join(base[: 90 - 3 * k] + [word() for _ in range(3 * k)]))
        texts.append(" ".join([word() for _ in range(rnd.randint(4, 30))] + passage + [word() for _ in range(rnd.randint(0, 12))]))
    return texts


def test_against_all_pairs(spark):
    rnd = random.Random(2)
    texts = near_texts(rnd) + ["", None, " \t ", "Same  words\x0bHERE", "same words here", "one", "ONE", "É a b c d e", "é a b c d e", "x" * 20000]
    rows = list(enumerate(texts))
    rnd.shuffle(rows)
    rows += [(None, texts[0]), (None, None), (3, texts[3]), (5, "another text for a repeated id that is linked with nothing"), (200, "another text for a repeated id that is linked with nothing")]
    got = run(spark, rows)
    assert got == brute(rows)
    assert len({c for _, _, c in got}) > 5


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(spark, docs).collect()), key=str)
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])
    kept = keep_one(spark, docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {c for _, _, c in got}


def test_empty(spark):
    assert run(spark, []) == [] and run(spark, [(1, None)]) == [(1, 0, 1)]


def test_second_text_of_a_repeated_id(spark):
    a, b = (" ".join(f"{k}{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200)) for k in "xy")
    rows = [(1, a), (5, a), (5, b), (9, b + " end")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    table.write.parquet(path := tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/docs")
    got = {r.doc_id: r.component_id for r in jaccard_components(spark, spark.read.parquet(path)).collect()}
    assert got == {1: 1, 5: 1, 9: 1}


def test_pivots_and_parts(spark, monkeypatch):
    """Small limits: long lists wait, are dealt to parts, and take several turns of pivots; the components stay those of all pairs."""
    for name, value in {"SHORT": 3, "WHOLE": 0, "PART": 3, "POSTINGS": 400, "PAIRS": 8}.items():
        monkeypatch.setattr(ngram_join, name, value)
    rnd, turns = random.Random(11), []
    next_pairs = ngram_join._next_pairs

    def watched(*args):
        out = next_pairs(*args)
        turns.append((args[1].where("part > 0").count(), out[2].count() if out[0] is not None else None))
        return out

    monkeypatch.setattr(ngram_join, "_next_pairs", watched)
    word = lambda: "".join(rnd.choices("abcdefghij", k=6))
    texts = near_texts(rnd)
    # texts of passages that are all frequent: long lists of texts that share some passages and differ in others
    choices = [[" ".join(word() for _ in range(9)) for _ in range(3)] for _ in range(8)]
    texts += [" ".join(rnd.choice(c) for c in choices) for _ in range(1000)]
    rows = list(enumerate(texts))
    assert run(spark, rows) == brute(rows)
    asked = [n for _, n in turns if n is not None]
    assert turns[0][0] > 0 and sum(n > 0 for n in asked) >= 2 and asked == sorted(asked)
