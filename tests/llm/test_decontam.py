import re
from collections import defaultdict

from emberlog.llm.decontam import UNITS, WINDOW, contaminated, keep_clean, tagged

ITEM = "Alice has 12 red apples and gives 5 of them to Bruno before she walks 3 km home with 12 bags"
OTHER = "Alice has 40 red apples and gives 9 of them to Carla before she walks 7 km home with 40 bags"
BROKEN = "Alice has 40 red apples and gives 9 of them to Carla before she walks 7 km home with 41 bags"


def words(text):
    """The template's words by the plain rule."""
    t = re.sub("[\x01-\x03]+", " ", text or "")
    t = re.sub(r"(?<=[^\W_] )([A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+)|(?<=[,;] )([A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+)", lambda m: "\x01" + m[0], t)
    t = re.sub(r"(?<=\d)[.,](?=\d)", "", t)
    t = re.sub(rf"(?<![^\W_])(\d+) ?({'|'.join(UNITS)})(?![^\W_])", "\x02\\1 \x03\\2", t, flags=re.I)
    t = re.sub("(?<![^\\W_\x02])(?<!\x02)(\\d+)(?![^\\W_])", "\x02\\1", t)
    return [w for w in re.split("[^\\w\x01\x02\x03]+|_+", t.lower()) if w]


def bare(w):
    return w.removeprefix("\x01")


def forms(ws):
    kind = lambda w: w[0] if w[0] < " " else w
    return {tuple(map(kind, ws)), tuple(kind(bare(w)) for w in ws)}


def places(d):
    where = defaultdict(set)
    for p in range(len(d) - WINDOW + 1):
        for f in forms(d[p : p + WINDOW]):
            where[f].add(p)
    return where


def runs_of(d, b, where):
    """(first place, word after the last, line) of the runs of windows that count."""
    lines = {p - q for q in range(len(b) - WINDOW + 1) if any(w >= " " for w in b[q : q + WINDOW]) for f in forms(b[q : q + WINDOW]) for p in where.get(f, ())}
    out = []
    for line in lines:
        pairs = {q: (b[q], d[q + line]) for q in range(len(b)) if 0 <= q + line < len(d)}
        equal = {q for q, (x, y) in pairs.items() if bare(x) == bare(y)}
        alike = equal | {q for q, (x, y) in pairs.items() if x < " " and x[0] == y[0]}
        held = lambda good: {q for q in range(len(b)) if all(q + k in good for k in range(WINDOW))}
        starts = held(alike)
        mapped = {tuple(map(bare, pairs[q + k])) for q in starts for k in range(WINDOW) if b[q + k] < " "}
        if len({x for x, _ in mapped}) < len(mapped) or len({y for _, y in mapped}) < len(mapped):
            starts = held(equal)
        for q in sorted(starts):
            if q - 1 in starts:
                out[-1] = (out[-1][0], q + WINDOW, line)
            else:
                out.append((q, q + WINDOW, line))
    return sorted(out)


def best_chain(runs, shift=10):
    def follow(k):
        s, e, line = runs[k]
        nexts = [j for j, (t, _, other) in enumerate(runs) if t > s and t + other > s + line and abs(other - line) <= shift]
        return max([e - s] + [min(e, runs[j][0]) - s + follow(j) for j in nexts])

    return max(map(follow, range(len(runs))), default=0)


def brute(docs, items, least=0.6, run=13):
    out, held = set(), [(i, words(t)) for i, t in items]
    for doc, text in docs:
        d = words(text)
        where = places(d)
        for i, b in held:
            if not any(w >= " " for q in range(len(b) - WINDOW + 1) for w in b[q : q + WINDOW]):
                if b and b == d:
                    out.add((doc, i))
            elif set(d) & set(b) and (rs := runs_of(d, b, where)) and (best_chain(rs) / len(b) >= least or max(e - s for s, e, _ in rs) >= run):
                out.add((doc, i))
    return out


def found(spark, docs, items, **more):
    return {(r.doc_id, r.item_id) for r in contaminated(spark, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), **more).collect()}


def test_reparameterised_and_inconsistent(spark):
    docs = [(1, f"Some words first. {OTHER}. And then more."), (2, BROKEN), (3, ITEM.upper()), (4, "nothing of the kind in this text at all"), (5, None), (6, ""), (None, ITEM), (1, f"Some words first. {OTHER}. And then more."), (7, f"{BROKEN}. {OTHER}")]
    items = [(10, ITEM), (11, "too short"), (12, None)]
    assert found(spark, docs, items) == brute(docs, items) and (1, 10) in brute(docs, items) and (2, 10) not in brute(docs, items)
    assert found(spark, docs, items, broadcast_bytes=0) == brute(docs, items)
    assert found(spark, docs, []) == set() and found(spark, [], items) == set()
    kept = keep_clean(spark, spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, th long"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r.doc_id for r in kept.collect())) == [2, 4, 5, 6]


def test_changed_word_is_still_found(spark):
    text = "the long river runs under seven old bridges and turns east behind the mill"
    assert found(spark, [(1, "so " + text.replace("bridges", "arches") + " again")], [(1, text)]) == {(1, 1)}


def test_whole_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in contaminated(spark, docs, items).collect()}
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])


def test_words(spark):
    texts = [ITEM, "In 1,000 Jahren. Der Größe 3.5 kg, Paul; x12 y", "5km 7 KM \x02 9"]
    from pyspark.sql import functions as F

    got = [list(r.w) for r in spark.createDataFrame([(t,) for t in texts], "text string").select(tagged(F.col("text")).alias("w")).collect()]
    assert got == [words(t) for t in texts]


def test_other_case_and_spacing(spark):
    german = "Der Bauer fährt am Morgen mit dem Wagen zur Mühle und bringt das Mehl der Frau Schmidt, die im Garten hinter dem Haus auf Kinder und Gäste wartet"
    names = "So today Alice and Bruno met Carla near Dover while Emil and Frida rode with Gustav to Hamburg"
    forms = [str, str.lower, str.upper, lambda t: t.replace(" ", "  "), lambda t: t.replace(" ", "\n"), lambda t: t.replace(" ", "\u00a0")]
    docs = [(10 * k + j, f(t)) for j, t in enumerate((german, names)) for k, f in enumerate(forms)]
    assert found(spark, docs, [(0, german), (1, names)]) == {(d, d % 10) for d, _ in docs}
    assert found(spark, docs, [(0, german.lower()), (1, names.upper())]) == {(d, d % 10) for d, _ in docs}
    other = "So today Xaver and Yann met Zoe near Leeds while Otto and Paula rode with Quirin to Rostock"
    assert found(spark, [(1, other), (2, other.replace(" ", "  "))], [(1, names)]) == {(1, 1), (2, 1)}


def test_part_of_a_long_item(spark):
    item = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(200)]
    text = " ".join
    docs = [(1, text(["before", *item[40:75], "after"])), (2, text(["before", *item[40:53], "after"])), (3, text(["before", *item[40:52], "after"]))]
    docs += [(4, text([*item[40:48], "other", "words", *item[60:68]])), (5, text(["before", *item[:119]]))]
    assert found(spark, docs, [(1, text(item))]) == {(1, 1), (2, 1), (5, 1)}  # 12 words in a row are too few, and so are two runs of 8


def test_copy_with_one_value_edited(spark):
    edited = ITEM.replace("with 12 bags", "with 13 bags")
    twice = "Here Alice and her friend watch the boats until dawn and then Alice walks home alone"
    docs = [(1, edited), (2, BROKEN), (3, twice.replace("then Alice", "then Carla"))]
    assert found(spark, docs, [(10, ITEM), (11, twice)]) == {(1, 10), (3, 11)}


def test_blocks_in_another_order(spark):
    item = [f"w{chr(97 + k)}{chr(97 + j)}" for k in range(4) for j in range(5)][:19]
    blocks, filler = [item[:5], item[5:10], item[10:15]], "some quite other words here".split()
    text = lambda parts: " ".join(w for p in parts for w in [*p, *filler])
    docs = [(1, text([blocks[2], blocks[0], blocks[1]])), (2, text(blocks)), (3, " ".join(item)), (4, " ".join([*blocks[0], *filler * 5, *blocks[1], *filler * 5, *blocks[2]]))]
    items = [(1, " ".join(item))]
    assert found(spark, docs, items) == brute(docs, items) == {(2, 1), (3, 1)}


def test_slots_are_consistent_both_ways(spark):
    merged = "Alice has 40 red apples and gives 40 of them to Alice before she walks 40 km home with 40 bags"
    names = "So today Alice and Bruno met Carla near Dover while Emil and Frida rode with Gustav to Hamburg"
    docs = [(1, merged), (2, OTHER), (3, names.replace("Bruno", "Alice")), (4, "So today Xaver and Xaver met Zoe near Leeds while Otto and Paula rode with Quirin to Rostock")]
    items = [(1, ITEM), (2, names)]
    assert found(spark, docs, items) == brute(docs, items) == {(2, 1), (3, 2)}


def test_a_longer_name_shifts_the_alignment(spark):
    item = "Yesterday the old miller told Alice that the new bridge over the river needs stronger beams"
    docs = [(1, item.replace("Alice", "Anna Maria Luise")), (2, item.replace(" new", "").replace("miller", "grey miller"))]
    assert found(spark, docs, [(1, item)]) == brute(docs, [(1, item)]) == {(1, 1), (2, 1)}


def test_tables_of_figures(spark):
    figures = " ".join(str(k) for k in range(60))
    docs = [(1, " ".join(str(7 * k) for k in range(3000))), (2, figures), (3, f"Table: {figures}"), (4, "x " * 50 + figures + " y" * 50)]
    items = [(1, figures), (2, "The sum of " + figures + " is to be found by the pupil")]
    assert found(spark, docs, items) == brute(docs, items)
    assert (2, 1) in brute(docs, items) and not any(d == 1 for d, _ in brute(docs, items))


def test_short_items(spark):
    items = [(1, "Too short."), (2, "12 km"), (3, "!?")]
    docs = [(1, "too   SHORT"), (2, "this is too short to tell"), (3, "12 km"), (4, "13 km"), (5, "..."), (6, None)]
    assert found(spark, docs, items) == brute(docs, items) == {(1, 1), (3, 2)}


def test_very_long_text_and_clashing_columns(spark):
    long = "many different words stand in this long text and " * 40_000
    table = spark.createDataFrame([(1, long + ITEM, 1, 2, 3), (2, long, 1, 2, 3), (2, long, 1, 2, 3)], "doc_id long, text string, leaked int, th int, ih int")
    items = spark.createDataFrame([(1, ITEM, 5)], "item_id long, text string, words int")
    kept = keep_clean(spark, table, items)
    assert kept.columns == table.columns and [r.doc_id for r in kept.collect()] == [2, 2]


def test_many_repeats_take_no_square_of_time(spark):
    """A passage of ten words of an item, and a whole short item, again and again in one text."""
    import time

    item = " ".join(f"w{chr(97 + k)}x" for k in range(20))
    ten = " ".join(item.split()[:10])
    short = "one two three four five six seven eight nine ten"
    took = []
    for k in (1000, 16_000):
        docs = [(1, " ".join([ten] * k)), (2, " ".join([short] * k)), (3, " ".join([ten] * 30 + [item] + [ten] * 30))]
        began = time.monotonic()
        assert found(spark, docs, [(1, item), (2, short)]) == {(2, 2), (3, 1)}
        took.append(time.monotonic() - began)
    assert took[1] < 6 * took[0] + 10
