from collections import defaultdict

from emberlog.llm.common import Scratch
from emberlog.llm.line_runs import Buckets, LineRuns, bucket_order, dedup_lines

LONG = "This line is long enough to be a line that counts, é."


def key(line):
    k = line.strip(" \t\n\x0b\x0c\r")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in k)


def brute(rows):
    """(doc_id, lines, dropped, text) by the plain rule."""
    holders = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(d)
    low = lambda d: (d is not None, d or 0)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders[key(x)]) < 5 or d == max(holders[key(x)], key=low)]
        out.append((d, len(lines), len(lines) - len(kept), t if len(kept) == len(lines) else "\n".join(kept)))
    return out


def test_edges_and_extra_columns(spark):
    rows = [(k, f"{LONG}\nown line {k}\n{LONG.upper()} \t") for k in range(6)] + [(7, "x" * 39 + "\n" + "y" * 41), (8, ""), (9, None), (3, f"{LONG}\nown line 3\n{LONG.upper()} \t"), (None, LONG), (11, "\n\n"), (12, "É" * 50)]
    rows += [(20 + k, "É" * 50 + "\n" + "é" * 50) for k in range(5)] + [(40 + k, "z" * 45) for k in range(4)]
    clashes = ["h1", "key", "of_doc", "of_text", "own_text", "drop", "th", "doc", "batch", "n", "last", "__doc", "__h1"]
    docs = spark.createDataFrame([(d, t, 5, *clashes) for d, t in rows], "doc_id long, text string, n_lines int, " + ", ".join(f"{c} string" for c in clashes))
    for batches, fanout in ((4, 2), (1, 2), (7, 3)):
        got = dedup_lines(spark, docs, batches=batches, fanout=fanout)
        assert got.columns == ["doc_id", "text", "n_lines", *clashes, "n_dropped"]
        assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()), key=str) == sorted(brute(rows), key=str)
    assert dedup_lines(spark, docs.limit(0)).collect() == []


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in dedup_lines(spark, docs).collect()}
    assert got == set(brute([(r.doc_id, r.text) for r in docs.collect()]))


def test_second_batch_reads_runs_as_they_are(spark):
    """Merge joins with runs neither shuffle nor sort them."""
    from pyspark.sql import functions as F

    buckets = Buckets(spark, Scratch(spark, "test"), 5)
    rows = spark.range(4000).select(F.xxhash64("id").alias("h1"), F.xxhash64("id", F.lit(1)).alias("h2"), F.lit(1).cast("long").alias("n"), F.col("id").alias("last"), (F.col("id") % 4).cast("int").alias("batch"))
    twice = rows.union(rows.withColumn("batch", (F.col("batch") + 1) % 4)).repartition(5, "h1", "h2")
    stats, runs = buckets.save(twice, "batches", "batch"), LineRuns(buckets)
    for b in range(4):
        batch = stats.where(F.col("batch") == b).select("h1", "h2", "n", "last")
        if b:
            with bucket_order(spark):
                plan = runs.fresh(batch)._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan, plan
        runs.add(batch)
    assert len(runs.runs.tables()) == 1
    assert sorted((r.n, r.last) for r in runs.counts().collect()) == [(2, k) for k in range(4000)]


def test_very_long_text(spark):
    rows = [(k, f"{LONG}\n" + f"own line of document {k} that is long enough to count\n" * 20_000) for k in range(6)]
    got = {(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in dedup_lines(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == set(brute(rows))
