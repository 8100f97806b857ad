"""Merkle manifest of a table: a hash tree for each source, and one over their roots.

Blocks of a tree are aligned: a block holds the nodes of ``fanout ** levels`` consecutive
places, so all runs of those levels lie in one block. A task gets a block as Arrow rows and
lets DuckDB run one ordered ``string_agg`` and ``sha256`` query for each level; what leaves
it is the block's root. Block roots are the nodes of the next round, until every tree has
one node; these are the nodes of the outer tree, which is built in the same way.

The way down gives each node the siblings outside its block, level by level from below:
Spark joins a block's outer proof, one row, to the block's nodes, and DuckDB puts the
siblings inside the block before it. In the last round the proof is hashed, and the root is
folded again from the leaf under test and its siblings.

Leaves, lower-cased texts and crc32 are plain columns; no text reaches a Python worker. Rows
are numbered in a range-partitioned order, of which only counts by partition cross tasks, so
neither a source that holds most rows nor an id that repeats meets in one task. A block's
size is fixed; nothing grows with the table but the number of blocks.

Defined results of edge cases: null fields are ``-``; null ids come first in a source and
are not tampered with; rows that repeat an id stand next to each other, by leaf; a null
source is a source of its own, before all others; a lone leaf is its source's root, and a
lone source's root is the root; a leaf without siblings has the hash of nothing as its
proof; an empty table gives an empty table; columns other than those named are not read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, release_memory, shuffle_partitions

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODE = "tree string, pos long, node string"
OUTER = f"{NODE}, before array<string>, after array<string>, subroot string, root string"
RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def field(c: Column) -> Column:
    """A value with its length in bytes, or ``-``."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(text: Column) -> Column:
    values = [text if f == "text" else F.col(f) for f in FIELDS]
    return F.sha2(F.concat(*map(field, values)), 256)


def tampered_with(doc_id: Column) -> Column:
    """The rows whose text is lower-cased: 5 divides the crc32 of the id as text."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


# --- places ------------------------------------------------------------------------------


def numbered(scratch: Scratch, rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """rows (a written table) with ``pos``, their place from 0 within the tree by ``order``, which tells rows apart."""
    ranges = shuffle_partitions(scratch.spark)
    keys = [F.col(c).asc_nulls_first() for c in (tree, *order)]
    placed = scratch.save(rows.repartitionByRange(ranges, *keys).withColumn("part", F.spark_partition_id()), "placed")
    # a part is a range of the order, so parts and trees make few more rows than either
    counts = placed.groupBy("part", tree).agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(W.partitionBy(tree).orderBy("part")) - F.col("n")).drop("n")
    within = F.row_number().over(W.partitionBy("part", tree).orderBy(*keys[1:]))
    return placed.withColumn("within", within).join(before, ["part", tree]).withColumn("pos", F.col("before") + F.col("within") - 1).drop("part", "within", "before")


# --- blocks in DuckDB --------------------------------------------------------------------

_engine = []


def engine():
    """One DuckDB of this worker, with one thread and a bounded memory."""
    if not _engine:
        import duckdb

        con = duckdb.connect()
        con.sql("SET threads = 1")
        con.sql("SET memory_limit = '400MB'")
        con.sql("SET preserve_insertion_order = false")
        _engine.append(con)
    return _engine[0]


def levels_sql(fanout: int, levels: int) -> str:
    """Common table expressions l0 to l<levels> (pos, node) over a block's rows ``block``."""
    ctes = ["l0 AS (SELECT pos, node FROM block)"]
    for k in range(levels):
        ctes.append(f"l{k + 1} AS (SELECT pos // {fanout} AS pos, sha256(string_agg(node, '' ORDER BY pos)) AS node FROM l{k} GROUP BY 1)")
    return ", ".join(ctes)


def siblings_sql(fanout: int, levels: int) -> str:
    """More of them: s<k> (pos, before, after), the siblings of each node of level k by the side on which they stand."""
    ctes = [levels_sql(fanout, levels)]
    for k in range(levels):
        ctes.append(f"r{k} AS (SELECT pos // {fanout} AS run, list(node ORDER BY pos) AS nodes FROM l{k} GROUP BY 1)")
        ctes.append(
            f"s{k} AS (SELECT pos, array_to_string(nodes[1 : pos % {fanout}], '') AS before, array_to_string(nodes[pos % {fanout} + 2 :], '') AS after FROM l{k} JOIN r{k} ON pos // {fanout} = run)"
        )
    return ", ".join(ctes)


def _levels(height: int, base: int, levels: int) -> int:
    return max(0, min(levels, height - base))


def block_roots(fanout: int, levels: int, base: int):
    """A block's nodes (tree, height, block, pos, node) to its root."""

    def run(key, table):
        tree, height, block = (k.as_py() for k in key)
        n = _levels(height, base, levels)
        con = engine()
        con.register("block", table.select(["pos", "node"]))
        root = con.execute(f"WITH {levels_sql(fanout, n)} SELECT node FROM l{n}").fetchall()[0][0]
        con.unregister("block")
        return pa.table({"tree": [tree], "pos": [block], "node": [root]}, schema=NODES)

    return run


NODES = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("node", pa.string())])
OUTERS = pa.schema([*NODES, ("before", pa.list_(pa.string())), ("after", pa.list_(pa.string())), ("subroot", pa.string()), ("root", pa.string())])
RESULTS = pa.schema([("doc_id", pa.int64()), *((c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), ("verified", pa.bool_())])


def _inner(fanout: int, n: int) -> tuple[str, str, str]:
    """SQL of the lists of siblings inside the block, and of the joins that give them to a leaf."""
    before = ", ".join(f"s{k}.before" for k in range(n))
    after = ", ".join(f"s{k}.after" for k in range(n))
    joins = " ".join(f"JOIN s{k} ON s{k}.pos = b.pos // {fanout**k}" for k in range(n))
    return f"[{before}]::VARCHAR[]", f"[{after}]::VARCHAR[]", joins


def outer_proofs(fanout: int, levels: int, base: int):
    """The siblings outside of each node of a block: those inside the block, then the block's own."""

    def run(key, nodes, outer):
        n = _levels(key[1].as_py(), base, levels)
        before, after, joins = _inner(fanout, n)
        con = engine()
        con.register("block", nodes.select(["tree", "pos", "node"]))
        con.register("beyond", outer.select(["before", "after", "subroot", "root"]))
        out = con.sql(
            f"WITH {siblings_sql(fanout, n)} SELECT b.tree, b.pos, b.node, list_concat({before}, o.before) AS before, list_concat({after}, o.after) AS after, o.subroot, o.root"
            f" FROM block b {joins} CROSS JOIN beyond o"
        ).to_arrow_table()
        con.unregister("block")
        con.unregister("beyond")
        return out.cast(OUTERS)

    return run


def folded_proofs(fanout: int, levels: int):
    """The last round: the proof's hash of each leaf, and the root folded from the leaf under test."""

    def run(key, leaves, outer):
        n = _levels(key[1].as_py(), 0, levels)
        steps = len(outer.column("before")[0])
        con = engine()
        con.register("block", leaves.select(["pos", "node", "doc_id", "tested"]))
        con.register("beyond", outer.select(["before", "after", "subroot", "root"]))
        _, _, joins = _inner(fanout, n)
        inside, fold = "''", "coalesce(b.tested, b.node)"
        for k in range(n):
            inside += f" || s{k}.before || s{k}.after"
            fold = f"sha256(s{k}.before || {fold} || s{k}.after)"
        beyond, top = "''", "folded"
        for k in range(1, steps + 1):
            beyond += f" || o.before[{k}] || o.after[{k}]"
            top = f"sha256(o.before[{k}] || {top} || o.after[{k}])"
        # what the leaves of a block fold to is mostly one value, which goes up once
        out = con.sql(
            f"WITH {siblings_sql(fanout, n)}, beyond_it AS (SELECT *, {beyond} AS proof FROM beyond o),"
            f" inner_part AS (SELECT b.doc_id, b.node AS leaf, sha256({inside} || o.proof) AS proof_sha256, {fold} AS folded FROM block b {joins} CROSS JOIN beyond_it o),"
            f" tops AS (SELECT folded, {top} AS folded_root, o.subroot, o.root FROM (SELECT DISTINCT folded FROM inner_part) CROSS JOIN beyond o)"
            " SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM inner_part JOIN tops USING (folded)"
        ).to_arrow_table()
        con.unregister("block")
        con.unregister("beyond")
        release_memory()
        return out.cast(RESULTS)

    return run


# --- trees -------------------------------------------------------------------------------


class Forest:
    """Trees over numbered nodes (tree, pos, node): their block roots by round, and the way back down."""

    def __init__(self, scratch: Scratch, nodes: DataFrame, fanout: int, levels: int):
        self.scratch, self.fanout, self.levels = scratch, fanout, levels
        self.width = fanout**levels
        grown = F.greatest(F.lit(0), *[F.when(F.col("n") > fanout**k, k + 1) for k in range(63) if fanout**k < 1 << 62])
        self.heights = scratch.save(nodes.groupBy("tree").agg(F.count("*").alias("n")).select("tree", grown.cast("int").alias("height")), "heights")
        self.rounds = [nodes]
        most = self.heights.agg(F.max("height")).first()[0] or 0
        for base in range(0, max(most, 1), levels):
            up = self._blocks(base).groupBy("tree", "height", "block").applyInArrow(block_roots(fanout, levels, base), NODE)
            self.rounds.append(scratch.save(up, "nodes"))

    def _blocks(self, base: int) -> DataFrame:
        """Nodes of a round with their tree's height and their block; finished trees take part in the first round only."""
        nodes = self.rounds[base // self.levels].join(self.heights, "tree")
        return (nodes.where(F.col("height") > base) if base else nodes).withColumn("block", F.expr(f"pos div {self.width}"))

    def _round_of(self) -> Column:
        """The round after which a tree has one node."""
        return F.greatest(F.lit(1), F.ceil(F.col("height") / self.levels))

    def roots(self) -> DataFrame:
        """(tree, node) of every tree."""
        tops = [nodes.join(self.heights, "tree").where(self._round_of() == k).select("tree", "node") for k, nodes in enumerate(self.rounds) if k]
        out = tops[0]
        for t in tops[1:]:
            out = out.union(t)
        return self.scratch.save(out, "roots")

    def down(self, tops: DataFrame, finish=None, kind: str = OUTER) -> DataFrame:
        """What ``finish`` makes of the nodes and the proofs outside their blocks; tops: those of each tree as a whole."""
        heights = self.heights.select(F.col("tree"), F.col("height").alias("tall"))
        tops = tops.join(self.heights, "tree")
        columns = ["before", "after", "subroot", "root"]
        outer = None
        for k in range(len(self.rounds) - 1, 0, -1):
            beyond = tops.where(self._round_of() == k).select("tree", F.lit(0).cast("long").alias("pos"), *columns)
            if outer is not None:
                beyond = beyond.union(outer.select("tree", "pos", *columns))
            beyond = beyond.join(heights, "tree").select("tree", "tall", F.col("pos").alias("place"), *columns)
            base = (k - 1) * self.levels
            blocks = self._blocks(base).groupBy("tree", "height", "block").cogroup(beyond.groupBy("tree", "tall", "place"))
            if k > 1 or finish is None:
                outer = self.scratch.save(blocks.applyInArrow(outer_proofs(self.fanout, self.levels, base), OUTER), "outer")
            else:
                outer = blocks.applyInArrow(finish, kind)
        return outer


def manifest(spark: SparkSession, docs: DataFrame, fanout: int = 16, levels: int = 3) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row of docs."""
    scratch = Scratch(spark, "merkle")
    source = F.col("source").cast("string")
    tree = F.when(source.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), source))
    lowered = F.when(tampered_with(F.col("doc_id")), leaf_digest(ascii_lower(F.col("text"))))
    leaves = docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf_digest(F.col("text")).alias("node"), lowered.alias("tested"), F.monotonically_increasing_id().alias("row"))
    leaves = numbered(scratch, scratch.save(leaves, "leaves"), "tree", ["doc_id", "node", "row"]).drop("row")
    inner = Forest(scratch, scratch.save(leaves, "numbered"), fanout, levels)
    subroots = inner.roots().select(F.lit("").alias("all"), F.col("tree").alias("source"), "node")
    subroots = scratch.save(numbered(scratch, subroots, "all", ["source"]).select(F.col("all").alias("tree"), "pos", "node", "source"), "subroots")
    outer = Forest(scratch, subroots.select("tree", "pos", "node"), fanout, levels)
    nothing = F.array().cast("array<string>")
    root = outer.roots().select("tree", nothing.alias("before"), nothing.alias("after"), F.lit(None).cast("string").alias("subroot"), F.col("node").alias("root"))
    proofs = outer.down(root)
    tops = proofs.join(subroots.select("pos", "source"), "pos").select(F.col("source").alias("tree"), "before", "after", F.col("node").alias("subroot"), "root")
    return inner.down(tops, folded_proofs(fanout, levels), RESULT)
