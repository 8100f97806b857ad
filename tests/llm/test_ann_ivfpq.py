import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlog.llm.ann_ivfpq import BLOCK_ROWS, fit_sample, search


def brute(rows, neighbours=5):
    """query, rank, id and score over all rows, by the rule."""
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for q, v in good:
        if q % 50 == 0:
            scores = sorted((-float(v @ w / (np.linalg.norm(v) * np.linalg.norm(w))), i) for i, w in good if i != q)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:neighbours])]
    return out


def run(spark, rows):
    table = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    return search(spark, table, table.where(F.col("vec_id") % 50 == 0)).collect()


def clustered(n, dimension=64, groups=40, seed=7):
    """Vectors around centres, of various widths, and some around none."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dimension))
    to = rng.integers(0, groups + 4, n)
    spread = rng.uniform(0.1, 0.8, groups)
    x = rng.normal(size=(n, dimension))
    return np.where((to < groups)[:, None], centres[to % groups] + spread[to % groups][:, None] * x, x)


def recall_of(table, got):
    rows = table.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    want = set()
    for k in np.flatnonzero(ids % 50 == 0):
        s = x @ x[k]
        s[k] = -2
        want |= {(int(ids[k]), int(i)) for i in ids[np.lexsort((ids, -s.round(12)))[:5]]}
    assert len(got) == len(want)
    return len(want & {(r.query_id, r.vec_id) for r in got}) / len(want)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1", "clustered"])
def test_recall(spark, sf):
    if sf == "clustered":
        table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(clustered(12_000))], "vec_id long, embedding array<float>")
    else:
        table = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    recall = recall_of(table, search(spark, table, table.where(F.col("vec_id") % 50 == 0)).collect())
    print(sf, recall)
    assert recall >= 0.9


def test_result_does_not_depend_on_partitions(spark):
    rows = [(i, v.tolist()) for i, v in enumerate(clustered(6000, 32))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    before, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (1, 4, 64):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            dealt = table.repartition(n)
            got.append(sorted(map(tuple, search(spark, dealt, dealt.where(F.col("vec_id") % 50 == 0)).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1] == got[2]


def test_ties_and_a_list_of_many_blocks(spark):
    rng = np.random.default_rng(3)
    same = rng.normal(size=16).tolist()
    rows = [(i, same) for i in range(BLOCK_ROWS + 1500)] + [(100_000 + i, rng.normal(size=16).tolist()) for i in range(300)]
    got = {(r.query_id, r["rank"]): r.vec_id for r in run(spark, rows)}
    assert [got[4000, k] for k in range(1, 6)] == [0, 1, 2, 3, 4] and [got[0, k] for k in range(1, 6)] == [1, 2, 3, 4, 5]


def test_groups_of_near_copies(spark):
    """Product codes nearly tie within a group, so that only exact scores tell its rows apart."""
    rng = np.random.default_rng(5)
    groups = [c + 0.02 * rng.normal(size=(1000, 32)) for c in rng.normal(size=(3, 32))]
    x = np.concatenate([*groups, rng.normal(size=(2000, 32))])
    got = {(r.query_id, r.vec_id) for r in run(spark, [(i, v.tolist()) for i, v in enumerate(x)]) if r.query_id < 3000}
    x = x.astype(np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = [(q, np.argsort(-np.where(np.arange(len(x)) == q, -2, x @ x[q]))[:5]) for q in range(0, 3000, 50)]
    want = {(q, int(i)) for q, top in near for i in top}
    recall = len(want & got) / len(want)
    print(recall)
    assert len(got) == len(want) and recall >= 0.95


def test_edges(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (50, [1.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (100, []), (None, [1.0, 1.0])]
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in run(spark, rows)]
    want = brute([(i, v) for i, v in rows if i is None or i < 60])
    assert [g[:3] for g in sorted(got)] == [w[:3] for w in sorted(want)] and np.allclose([g[3] for g in sorted(got)], [w[3] for w in sorted(want)], atol=1e-12)
    assert run(spark, []) == [] and run(spark, [(0, [1.0, 2.0])]) == []


def test_sample_is_bounded_in_rows(spark):
    """One id repeats, with one vector and with many."""
    rows = spark.range(6000).select(F.when(F.col("id") < 4000, 7).otherwise(F.col("id")).alias("vec_id"), F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("embedding"))
    rows = rows.union(spark.range(3000).select(F.lit(9).cast("long"), F.array(F.lit(1.0), F.lit(2.0)).cast("array<float>")))
    for most in (1, 500, 8999):
        assert fit_sample(rows, 9000, most).count() <= most
    assert fit_sample(rows, 9000, 8999).count() == 8999
    assert fit_sample(rows, 9000, 20_000).count() == 9000
