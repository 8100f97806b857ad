import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from emberlog.llm.exact_groups import content_hash, exact_groups, keep_one


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(rows, keep):
    """(doc_id, keep_id, group_size, text_sha256), and how many rows of each group stay."""
    groups = defaultdict(list)
    for d, t in rows:
        groups[low(t)].append(d)
    key = lambda d: (d is not None, d or 0)
    best = {k: (max if keep == "largest" else min)(ids, key=key) for k, ids in groups.items()}
    return sorted(((d, best[low(t)], len(groups[low(t)]), hashlib.sha256(low(t).encode()).hexdigest()) for d, t in rows), key=str)


ROWS = [(1, "Same Text"), (5, "same text"), (3, "SAME TEXT"), (2, "É"), (4, "é"), (6, None), (7, ""), (8, "x" * 300_000), (9, "X" * 300_000), (10, " same text")]
ROWS += [(None, "no id"), (11, "no id"), (5, "same text"), (5, "other"), (None, "lone"), (None, "lone")]


def weak_hash(text):
    """Two different hashes for all texts."""
    return F.pmod(F.length(text), F.lit(2)).cast("long"), F.lit(0).cast("long")


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("hashes", [content_hash, weak_hash])
def test_groups_and_collisions(spark, keep, hashes):
    docs = spark.createDataFrame([(d, t) for d, t in ROWS], "doc_id long, text string").repartition(3)
    got = exact_groups(spark, docs, keep, hashes=hashes).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute(ROWS, keep)
    stay = [r for r in got if r.kept]
    assert len({r.text_sha256 for r in got}) == len(stay) == len({r.text_sha256 for r in stay}) and all(r.doc_id == r.keep_id for r in stay)


def test_unique_texts_do_not_matter_to_the_bit_table(spark):
    """A full table lets all texts pass; the groups are the same."""
    rows = [(k, f"text {k % 400}") for k in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = exact_groups(spark, docs, most_bits=8).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute(rows, "smallest")


def test_one_row_stays_with_all_its_columns(spark):
    names = ["row_no", "gone", "h1", "norm", "row", "keep_id", "kept"]
    docs = spark.createDataFrame([(d, t, *[f"{n}{k}" for n in names]) for k, (d, t) in enumerate(ROWS)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    got = keep_one(spark, docs, "largest")
    assert got.columns == docs.columns
    rows = got.collect()
    assert sorted(low(r.text) for r in rows) == sorted({low(t) for _, t in ROWS}) and {r.doc_id for r in rows if low(r.text) == "same text"} == {5}
    assert set(rows) <= set(docs.collect())
    assert keep_one(spark, docs.limit(0)).collect() == [] == exact_groups(spark, docs.limit(0)).collect()


def test_hot_group_moves_no_text_for_its_copies(spark):
    """A third of all rows is one text: its copies meet as one row a task."""
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text"))
    got = exact_groups(spark, docs, "largest")
    assert got.where("group_size = 2000 AND keep_id = 5997").count() == 2000 and got.where("kept").count() == 4001
    with pytest.raises(ValueError):
        exact_groups(spark, docs, "first")
