"""Benchmark decontamination by template canonicalisation (DataFrame operations only).

A text becomes a sequence of lower-cased words in which numbers, units after a number
and names (capitalised words within a sentence) are typed slots. Windows of five words
are hashed over this template, so that a question with other numbers or names has the
same windows, and hash-joined with the windows of the benchmark that hold a plain word
at least (windows of slots alone are alike in all tables of figures). White space is collapsed
first, and the windows in which names are plain lower-case words are hashed as well, in one
space with the others, so that a copy in other case or spacing is found too.

The join tells at which *alignments* (document position minus item position) a document
and an item are to be compared, word by word. Words match if they are equal or slots of
one type, and a window counts if its five words match. Within an alignment the slots of
these windows must be consistent in both directions: each item value stands for one document
value, and each document value for one item value. Alignments that break this are not
re-parameterised questions, and only their windows whose words equal the item's, values
too, are kept.

Windows in a row are a *run*. A name of two words or a word left out shifts the alignment,
so runs of near alignments (at most ``shift`` words apart from one to the next) that
stand in the same order in the item and in the document form a chain. A document is
contaminated by an item if the runs of one chain cover ``min_coverage`` of its words, or if
one run covers ``min_run`` of them, whatever share of the item that is.

The windows of the benchmark and the keys of texts to compare are broadcast only if their
counted size is under ``broadcast_bytes``; beyond it these joins are shuffles.

Defined results of edge cases: null and empty texts match nothing, and items without
words neither; items of fewer words than a window, or without a window that holds a plain
word, match the texts that have just their words, values too; a null doc_id or item_id matches
like any other; repeated rows are reported once; empty tables give an empty table; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, unused_name

WINDOW = 5
#: Tags that stand before the value of a name, a number and a unit.
NAME, NUMBER, UNIT = "\x01", "\x02", "\x03"
UNITS = "mm cm dm m km in ft yd mi mg g kg t lb oz ml cl l s sec min h hr hours minutes days weeks months years percent dollars euros usd eur gb mb kb hz khz mhz w kw v".split()


def tagged(text: Column) -> Column:
    """The text's words in lower case; slots have their tag in front."""
    space = r"\x01-\x03\s\p{Z}"  # a single plain space stays as it is
    t = F.regexp_replace(F.coalesce(text, F.lit("")), rf"[{space}&&[^ ]][{space}]*| [{space}]+", " ")
    t = F.regexp_replace(t, r"(?<=[\p{L}\p{N},;] )(\p{Lu}\p{Ll}+)", NAME + "$1")
    digits = F.regexp_replace(t, r"(?<=\p{N})[.,](?=\p{N})", "")
    digits = F.regexp_replace(digits, rf"(?<![\p{{L}}\p{{N}}])(\p{{N}}+)(?: ?(?i)({'|'.join(UNITS)}))(?![\p{{L}}\p{{N}}])", f"{NUMBER}$1 {UNIT}$2")
    digits = F.regexp_replace(digits, rf"(?<![\p{{L}}\p{{N}}{NUMBER}])(\p{{N}}+)(?![\p{{L}}\p{{N}}])", f"{NUMBER}$1")
    t = F.when(t.rlike(r"\p{N}"), digits).otherwise(t)
    return F.filter(F.split(F.lower(t), rf"[^\p{{L}}\p{{M}}\p{{N}}{NAME}{NUMBER}{UNIT}]+"), lambda w: w != "")


def template(words: Column) -> Column:
    """A hash for each word; all slots of a type have the same."""
    return F.transform(words, lambda w: F.xxhash64(F.when(w < " ", F.substring(w, 1, 1)).otherwise(w)))


def plain(words: Column) -> Column:
    """The words with names as any other word; numbers and units stay slots."""
    return F.transform(words, lambda w: F.when(w.startswith(NAME), F.substring(w, 2, 1 << 30)).otherwise(w))


def windows(codes: Column) -> Column:
    """The hash of each window of WINDOW codes, made by doubling: 1 + 1, 2 + 2, 4 + 1."""

    def joined(a: Column, b: Column, shift: int) -> Column:
        return F.zip_with(a, F.slice(b, shift + 1, F.greatest(F.size(b), F.lit(1))), lambda x, y: F.xxhash64(x, y))

    def of(c: Column) -> Column:
        return F.transform(F.array(joined(c, c, 1)), lambda two: F.get(F.transform(F.array(joined(two, two, 2)), lambda four: joined(four, c, 4)), F.lit(0)))

    # outer lambdas hold each array, so that none is made again for each element
    whole = F.transform(F.array(codes), lambda c: F.transform(of(c), lambda h: F.slice(h, 1, F.greatest(F.size(c) - (WINDOW - 1), F.lit(0)))))
    return F.get(F.flatten(whole), F.lit(0))


def _windowed(rows: DataFrame, keys: list[str], place: str) -> DataFrame:
    """Rows of rows.words, or else of the tagged text, to one row for each template window and each plain window that differs from it."""
    words = F.col("words") if "words" in rows.columns else tagged(F.col("text"))

    def both(w: Column) -> Column:
        other = F.transform(F.array(windows(template(w))), lambda t: F.array(t, F.when(F.exists(w, lambda x: x.startswith(NAME)), F.zip_with(windows(template(plain(w))), t, lambda a, b: F.when(a != b, a)))))
        return F.get(other, F.lit(0))

    arrays = F.get(F.transform(F.array(words), both), F.lit(0))
    return rows.select(*keys, F.explode(arrays).alias("hs")).select(*keys, F.posexplode("hs").alias(place, "h")).where("h IS NOT NULL")


#: Two hashes stand for a text.
TEXT = ["th", "tg"]


def _hashes(text: Column) -> list[Column]:
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("th"), F.xxhash64(F.lit("second"), text).alias("tg")]


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, min_coverage: float = 0.6, broadcast_bytes: int = 32 << 20, min_run: int = 13, shift: int = 10) -> DataFrame:
    """doc_id, item_id, n_windows and coverage of each contaminated document and its item."""
    scratch = Scratch(spark, "decontam")

    def small(table: DataFrame) -> DataFrame:
        return F.broadcast(table) if table.count() * 64 <= broadcast_bytes else table

    source = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text"), *_hashes(F.col("text")))
    items = scratch.save(benchmark.select("item_id", F.md5(F.col("text").cast("binary")).alias("ih"), tagged(F.col("text")).alias("words")).where(F.size("words") > 0), "items")
    texts_of_items = items.dropDuplicates(["ih"]).select("ih", "words")
    bench = _windowed(texts_of_items, ["ih", "words"], "q")
    bench = bench.where(F.exists(F.slice("words", F.col("q") + 1, WINDOW), lambda w: w >= " ")).select("ih", "q", "h").distinct()
    bench = scratch.save(bench, "windows")
    hits = _windowed(source, ["doc_id", *TEXT], "p").join(small(bench), "h")
    met = scratch.save(hits.groupBy("doc_id", *TEXT, "ih").agg(F.collect_set(F.col("p") - F.col("q")).alias("lines")), "met")
    texts = source.select(*TEXT, "text").join(small(scratch.save(met.select(*TEXT).distinct(), "texts")), TEXT, "left_semi").dropDuplicates(TEXT)
    compared = met.select(*TEXT, "ih", "lines").dropDuplicates([*TEXT, "ih"]).join(texts.select(*TEXT, tagged(F.col("text")).alias("doc")), TEXT)
    compared = compared.join(texts_of_items.withColumnRenamed("words", "item"), "ih")
    runs = F.array_sort(F.flatten(F.transform("lines", lambda line: _runs(F.col("item"), F.col("doc"), line))))
    compared = compared.select(*TEXT, "ih", F.size("item").alias("n"), runs.alias("runs")).where(F.size("runs") > 0)
    most = F.array_max(F.transform("runs", lambda r: r["e"] - r["s"] + WINDOW))
    windows_met = F.size(F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["s"], r["e"])))))
    compared = compared.select(*TEXT, "ih", windows_met.cast("long").alias("n_windows"), (_best_chain(F.col("runs"), shift, F.col("n")) / F.col("n")).alias("coverage"), most.alias("run"))
    found = compared.where((F.col("coverage") >= min_coverage) | (F.col("run") >= min_run)).select(*TEXT, "ih", "n_windows", "coverage")
    found = met.select("doc_id", *TEXT, "ih").join(found, [*TEXT, "ih"]).select("doc_id", "ih", "n_windows", "coverage")
    whole = scratch.save(texts_of_items.join(bench, "ih", "left_anti"), "whole")
    if not whole.isEmpty():
        own = whole.select("ih", F.array_join("words", " ").alias("of"))
        alike = source.select("doc_id", F.array_join(tagged(F.col("text")), " ").alias("of")).join(small(own), "of")
        found = found.union(alike.select("doc_id", "ih", F.lit(1).cast("long"), F.lit(1.0)))
    found = found.join(items.select("ih", "item_id"), "ih")
    return found.groupBy("doc_id", "item_id").agg(F.max("n_windows").alias("n_windows"), F.max("coverage").alias("coverage"))


def _held(value: Column, use) -> Column:
    """use(value), where value is computed once however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _runs(item: Column, doc: Column, line: Column) -> Column:
    """The runs of windows (s and e are the first and the last one's place in the item) of one alignment."""

    def bare(w: Column) -> Column:
        return F.when(w.startswith(NAME), F.substring(w, 2, 1 << 30)).otherwise(w)

    def spots(words: Column) -> Column:
        """For each item word: both words, whether they are equal, and whether they match."""

        def spot(w: Column) -> Column:
            i, d = w["i"], w["d"]
            equal = F.coalesce(bare(i) == bare(d), F.lit(False))
            match = equal | F.coalesce((i < " ") & (F.substring(i, 1, 1) == F.substring(d, 1, 1)), F.lit(False))
            return F.struct(i.alias("i"), d.alias("d"), equal.alias("equal"), match.alias("match"))

        return F.transform(F.transform(words, lambda i, q: F.struct(i.alias("i"), F.get(doc, q + line).alias("d"))), spot)

    def starts(w: Column) -> Column:
        return F.sequence(F.lit(0), F.size(w) - WINDOW)

    def full(w: Column, what: str) -> Column:
        """For each place whether a window of such words begins there."""
        return F.transform(starts(w), lambda q: F.forall(F.slice(w, q + 1, WINDOW), lambda x: x[what]))

    def consistent(w: Column, held: Column) -> Column:
        in_window = F.filter(w, lambda x, q: (x["i"] < " ") & F.exists(F.slice(held, F.greatest(q - (WINDOW - 2), F.lit(1)), F.least(q, F.lit(WINDOW - 1)) + 1), lambda h: h))
        values = F.array_distinct(F.transform(in_window, lambda x: F.struct(bare(x["i"]).alias("i"), bare(x["d"]).alias("d"))))
        one_to_one = lambda v: (F.size(F.array_distinct(v["i"])) == F.size(v)) & (F.size(F.array_distinct(v["d"])) == F.size(v))
        return _held(values, one_to_one)

    def as_runs(held: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(held) - 1)
        here = lambda q: F.coalesce(F.get(held, q), F.lit(False))
        first = F.filter(at, lambda q: here(q) & ~here(q - 1))
        last = F.filter(at, lambda q: here(q) & ~here(q + 1))
        return F.zip_with(first, last, lambda s, e: F.struct(s.alias("s"), e.alias("e"), line.cast("int").alias("line")))

    def of(w: Column) -> Column:
        return _held(_held(full(w, "match"), lambda held: F.when(consistent(w, held), held).otherwise(full(w, "equal"))), as_runs)

    return _held(spots(item), of)


def _best_chain(runs: Column, shift: int, n: Column) -> Column:
    """The most words of the item, which has n, that runs cover which stand in one order in item and document, from one to the next at most ``shift`` words apart.

    Runs are taken by their place in the document. A run's predecessor lies at most n + shift
    words before it, so chains that end further back are let go, and the work grows with the
    number of runs, not with its square.
    """
    kind = "struct<best:int,recent:array<struct<p:int,s:int,e:int,line:int,best:int>>>"
    none = F.struct(F.lit(0).alias("best"), F.array().alias("recent")).cast(kind)
    placed = F.array_sort(F.transform(runs, lambda r: F.struct((r["s"] + r["line"]).alias("p"), r["s"].alias("s"), r["e"].alias("e"), r["line"].alias("line"))))

    def step(held: Column, r: Column) -> Column:
        recent = F.filter(held["recent"], lambda b: b["p"] >= r["p"] - n - shift)
        follows = lambda b: (b["s"] < r["s"]) & (b["p"] < r["p"]) & (F.abs(b["line"] - r["line"]) <= shift)
        gains = F.transform(F.filter(recent, follows), lambda b: b["best"] - F.greatest(b["e"] + WINDOW - r["s"], F.lit(0)))
        best = (r["e"] - r["s"] + WINDOW + F.greatest(F.coalesce(F.array_max(gains), F.lit(0)), F.lit(0))).cast("int")
        end = lambda x: F.struct(r["p"].alias("p"), r["s"].alias("s"), r["e"].alias("e"), r["line"].alias("line"), x.alias("best"))
        return _held(best, lambda x: F.struct(F.greatest(held["best"], x).alias("best"), F.concat(recent, F.array(end(x))).alias("recent")).cast(kind))

    return F.aggregate(placed, none, step, lambda held: held["best"])


def keep_clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that no item contaminates, with all their columns."""
    of = unused_name("leaked", docs)
    # written, so that the join knows how small it is
    leaked = Scratch(spark, "leaked").save(contaminated(spark, docs, benchmark).select(F.col("doc_id").alias(of)).distinct(), "ids")
    return docs.join(leaked, F.col("doc_id").eqNullSafe(F.col(of)), "left_anti")
