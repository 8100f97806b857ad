import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from emberlog.llm.common import Scratch
from emberlog.llm.source_divergence import divergences, hashes_of, merged_sketch, slots, terms


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain_terms(text):
    return [low(x) for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def brute(rows, top=200, min_docs=3):
    docs, n, groups, out = defaultdict(Counter), defaultdict(Counter), set(), []
    for lang, source, text in rows:
        lang, source, found = lang or "", source or "", plain_terms(text)
        groups.add((lang, source))
        n[lang, source].update(found)
        docs[lang].update(set(found))
    f = lambda p, q: (p - q) ** 2 // q
    for lang in {g[0] for g in groups}:
        kept = [t for t, k in docs[lang].items() if k >= min_docs]
        sources = sorted(s for g, s in groups if g == lang)
        total = {s: sum(n[lang, s][t] for t in kept) for s in sources}
        share = lambda c, of: 1 + 10**9 * (c + 1) // (of + len(kept))  # noqa: B023, E731
        p = {(s, t): share(n[lang, s][t], total[s]) for s in sources for t in kept}
        q = {t: share(sum(n[lang, s][t] for s in sources), sum(total.values())) for t in kept}
        for s in sources:
            pairs = [(o, sum(f(p[s, t], p[o, t]) for t in kept)) for o in sources if o != s]
            own = [(t, f(p[s, t], q[t])) for t in kept if n[lang, s][t] and p[s, t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", own, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, k + 1) for k, (item, v) in enumerate(items[:most])]
    return sorted(out)


def some_rows():
    rnd = random.Random(2)
    words = ["the", "The", "a", "é", "Éa", "x1y", "don't", "ß", "naïve", "é", " ", "A_b"] + [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(10)]
    texts = [None, "", "123 _"] + [None] * 9
    rows = []
    for i in range(300):
        texts[3 + i % 9] = " ".join(rnd.choices(words[: 40 + i], k=30))
        rows.append((rnd.choice(["en", "fr", None]), rnd.choice(["a", "a", "a", "b", "c", "é", None]), rnd.choice(texts)))
    # a language that keeps nothing, one with one source, a source without terms, a very long text, a term of one source only
    return rows + [("xx", "a", "one two"), ("xx", "b", None), *[("yy", "only", "k k K")] * 3, ("en", "blank", "  "), ("fr", "long", "lang und Wörter " * 40_000), *[("fr", "own", "solo")] * 4]


def test_all_parts_and_edges(spark):
    rows = some_rows()
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(5).withColumns({c: F.lit(1) for c in ("term", "n", "value", "p", "chunk")})
    got = divergences(spark, docs, top=20)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute(rows, 20)
    assert divergences(spark, docs.limit(0)).collect() == []


def test_sketch_never_underestimates(spark):
    rows = [(lang or "", source or "", text or "") for lang, source, text in some_rows()]
    truth = defaultdict(Counter)
    for lang, _, text in rows:
        truth[lang].update({t.encode() for t in plain_terms(text)})
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(7)
    for bits in (6, 16):
        sketch = merged_sketch(Scratch(spark, "test"), docs, bits)
        for lang, docs_of in truth.items():
            rows_of = [row[at] for row, at in zip(sketch, slots(hashes_of(lang, docs_of), bits), strict=True)]
            assert (np.min(rows_of, axis=0) >= np.minimum(list(docs_of.values()), 255)).all()


def test_terms():
    text = "Don't NAÏVE x1 É_é [a]^`b{c}\x00\x7f\u0080"
    assert [t.decode() for t in terms(text)] == plain_terms(text)
