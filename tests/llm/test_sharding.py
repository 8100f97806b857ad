import random
from itertools import groupby

from pyspark.sql import functions as F

from emberlog.llm.sharding import Boundaries, find_cuts, shard_documents


def brute_capacity(sizes, shards):
    """The smallest capacity by trying the sums of consecutive groups."""
    for c in range(max(max(sizes), -(-sum(sizes) // shards)), sum(sizes) + 1):
        used, at = 1, 0
        for s in sizes:
            if at + s > c:
                used, at = used + 1, 0
            at += s
        if used <= shards:
            return c


def test_capacity_is_smallest(spark):
    rnd = random.Random(5)
    for sizes, shards in (([rnd.randint(8, 400) for _ in range(3000)], 24), ([5000] + [9] * 700, 7), ([10], 3), ([8, 8, 8, 90, 8], 3)):
        ends = [sum(sizes[: k + 1]) for k in range(len(sizes))]
        prefix = spark.createDataFrame([(e,) for e in ends], "end long").cache()
        capacity, cuts = find_cuts(prefix, ends[-1], shards)
        assert capacity == brute_capacity(sizes, shards)
        assert set(cuts) <= {0, *ends} and cuts == sorted(cuts) and len(cuts) == shards - 1
        assert max(b - a for a, b in zip([0, *cuts], [*cuts, ends[-1]], strict=True)) <= capacity


def test_grid_is_refined(spark, monkeypatch):
    monkeypatch.setattr("emberlog.llm.sharding.CELLS", 16)
    monkeypatch.setattr("emberlog.llm.sharding.PARTS", 4)
    rnd = random.Random(6)
    sizes = [rnd.randint(8, 60) for _ in range(400)]
    ends = [sum(sizes[: k + 1]) for k in range(len(sizes))]
    assert find_cuts(spark.createDataFrame([(e,) for e in ends], "end long").cache(), ends[-1], 5)[0] == brute_capacity(sizes, 5)
    assert Boundaries([(0, 0, 1), (5, 9, 4)]).last(7, True) == 7


def check(spark, rows, shards=24):
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    out = shard_documents(spark, docs, shards).collect()
    assert len(out) == len(rows)
    for shard, own in groupby(sorted(out, key=lambda r: (r.shard, r.slot)), key=lambda r: r.shard):
        assert 0 <= shard < shards and [r.slot for r in own] == list(range(len([r for r in out if r.shard == shard])))
    return out


def test_rows_ties_nulls_repeats(spark):
    rows = [(i, "copy" if i % 3 == 0 else f"text {i} " + "é" * (i % 50), "x") for i in range(600)] + [(None, None, "x"), (7, "text 7 " + "é" * 7, "x"), (8, "", None), (8, "", None)]
    out = check(spark, rows)
    assert len({r.shard for r in out if r.size == 12}) == 1
    assert {r.size for r in out if r.doc_id == 7} == {8 + 7 + 14}
    assert check(spark, [], 24) == []


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = shard_documents(spark, docs, 24)
    sums = [r.s for r in out.groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert sum(sums) == docs.agg(F.sum(F.octet_length("text") + 8)).first()[0] and len(sums) == 24
    assert out.join(docs, "doc_id").groupBy("text").agg(F.countDistinct("shard").alias("n")).where("n > 1").count() == 0
