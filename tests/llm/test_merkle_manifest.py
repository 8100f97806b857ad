import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from emberlog.llm.merkle_manifest import manifest

COLUMNS = "doc_id leaf subroot root proof_sha256 folded_root verified".split()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(nodes, fanout):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + fanout])) for i in range(0, len(out[-1]), fanout)])
    return out


def path(tree, at, fanout):
    out = []
    for nodes in tree[:-1]:
        first = at - at % fanout
        out.append(("".join(nodes[first:at]), "".join(nodes[at + 1 : first + fanout])))
        at //= fanout
    return out


def brute(rows, fanout):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {s: levels([leaf(r) for r in by[s]], fanout) for s in sources}
    top = levels([trees[s][-1][0] for s in sources], fanout)
    out = []
    for k, s in enumerate(sources):
        for i, r in enumerate(by[s]):
            steps, now = path(trees[s], i, fanout) + path(top, k, fanout), leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                now = leaf((*r[:4], low(r[4])))
            for a, b in steps:
                now = sha(a + now + b)
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], sha("".join(a + b for a, b in steps)), now, now == top[-1][0]))
    return sorted(map(str, out))


def rows_of(n, sources, seed=1):
    rnd = random.Random(seed)
    texts = [None, "", "Hello World Ä", "abc"]
    return [(i if i % 97 else None, rnd.choice(sources), rnd.choice(["en", None]), rnd.choice([None, i]), rnd.choice([*texts, f"T{i}", f"t{i}"])) for i in range(n)]


CASES = {
    "trees of several rounds of blocks": (rows_of(90, ["hot"] * 20 + ["b", None, "", "é", "Z"]), 3, 2),
    "many sources, rows that repeat": (rows_of(200, [f"s{j}" for j in range(40)]) + [(7, "s1", None, None, "Same")] * 30, 16, 3),
    "one source": (rows_of(40, ["only"]), 16, 1),
    "one row": ([(5, None, None, None, "A" * 200_000)], 16, 3),
}
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("name", CASES)
def test_against_plain_trees(spark, name):
    rows, fanout, per_block = CASES[name]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit("clash") for c in ("tree", "pos", "node", "before", "tested", "row")})
    got = manifest(spark, docs, fanout, per_block)
    assert got.columns == COLUMNS
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(rows, fanout)


def test_empty(spark):
    assert manifest(spark, spark.createDataFrame([], SCHEMA)).collect() == []
