"""Minimax contiguous partition of atomic groups into shards.

Documents with equal texts form one atomic group. Groups are ordered by their smallest
doc_id (then by digest), and a shard takes consecutive groups, so that the largest
shard is as small as contiguity allows. The smallest feasible capacity is found by
binary search; a capacity is checked by the greedy rule, which fills each shard up to
the last group boundary within reach.

The check only asks for the last boundary at or below a value, and boundaries are
prefix sums of sizes. The driver therefore keeps, for each cell of a fixed grid over
[0, total], the smallest and largest boundary in it, never the groups. An answer
inside a cell is uncertain; the search then runs with the lower and the upper answer,
which bounds the smallest capacity from both sides, and the cells that the two runs
pass through are divided and read again from the distributed prefix sums. It ends when
no such cell hides a boundary. What the driver holds is bounded by the number of cells.

Among the cuts that keep the capacity, each shard takes the one nearest to its equal
share, so that sizes are near equal and not only bounded.

Defined results of edge cases: a null text has no bytes and is not equal to an empty
one; null doc_ids sort first; repeated rows are rows of their own; an empty table gives
an empty table; shards may be empty where there are fewer groups than shards; columns
of the input other than doc_id and text are not read.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, shuffle_partitions

#: Cells of the first grid, and parts into which an uncertain cell is divided.
CELLS, PARTS = 16384, 64


class Boundaries:
    """What is known of the group boundaries: per cell the smallest and largest, and whether others may lie between."""

    def __init__(self, cells: list[tuple[int, int, int]]):
        self.cells = sorted(cells)
        self._index()

    def _index(self) -> None:
        self.low = [c[0] for c in self.cells]
        self.high = [c[1] for c in self.cells]

    def open_cell(self, x: int) -> int | None:
        """The cell in which the last boundary at or below x is uncertain."""
        i = bisect_right(self.low, x) - 1
        return i if i >= 0 and self.cells[i][1] > x and self.cells[i][2] > 2 else None

    def last(self, x: int, upper: bool) -> int:
        """The last boundary at or below x, or a bound of it."""
        i = bisect_right(self.low, x) - 1
        if self.cells[i][1] <= x:
            return self.cells[i][1]
        if self.cells[i][2] > 2 and upper:
            return x
        return self.cells[i][0]

    def replace(self, gone: set[int], new: list[tuple[int, int, int]]) -> None:
        self.cells = sorted([c for k, c in enumerate(self.cells) if k not in gone] + new)
        self._index()


def greedy(bounds: Boundaries, capacity: int, shards: int, total: int, upper: bool) -> tuple[bool, set[int]]:
    """Whether the shards hold everything, and the uncertain cells on the way."""
    at, unsure = 0, set()
    for _ in range(shards):
        if at >= total:
            break
        cell = bounds.open_cell(at + capacity)
        if cell is not None:
            unsure.add(cell)
        at = bounds.last(min(at + capacity, total), upper)
    return at >= total, unsure


def smallest(bounds: Boundaries, shards: int, total: int, upper: bool) -> int:
    low, high = max(1, -(-total // shards)), total
    while low < high:
        mid = (low + high) // 2
        if greedy(bounds, mid, shards, total, upper)[0]:
            high = mid
        else:
            low = mid + 1
    return low


def _summary(prefix: DataFrame, cell) -> list[tuple[int, int, int]]:
    rows = prefix.groupBy(cell.alias("cell")).agg(F.min("end").alias("a"), F.max("end").alias("b"), F.count("*").alias("n")).collect()
    return [(r.a, r.b, r.n) for r in rows]


def _uncertain(bounds: Boundaries, capacities: list[int], shards: int, total: int, cuts: bool) -> set[int]:
    out: set[int] = set()
    for c in capacities:
        for upper in (False, True):
            out |= greedy(bounds, c, shards, total, upper)[1]
    if cuts:
        for j in range(1, shards):
            cell = bounds.open_cell(j * total // shards)
            if cell is not None:
                out.add(cell)
    return out


def _refine(prefix: DataFrame, bounds: Boundaries, cells: set[int]) -> None:
    """Read the inside of the cells, each divided into parts."""
    ranges = [bounds.cells[k][:2] for k in sorted(cells)]
    lows, steps = [a for a, _ in ranges], [max(1, -(-(b - a + 1) // PARTS)) for a, b in ranges]
    edges = F.array(*[F.lit(a) for a in lows])
    k = F.size(F.filter(edges, lambda e: e <= F.col("end")))
    numbered = prefix.withColumn("k", k).where("k > 0")
    numbered = numbered.withColumn("hi", F.get(F.array(*[F.lit(b) for _, b in ranges]), F.col("k") - 1)).where("end <= hi")
    part = F.floor((F.col("end") - F.get(edges, F.col("k") - 1)) / F.get(F.array(*[F.lit(s) for s in steps]), F.col("k") - 1))
    bounds.replace(cells, _summary(numbered, F.struct("k", part.alias("p"))))


def find_cuts(prefix: DataFrame, total: int, shards: int) -> tuple[int, list[int]]:
    """prefix: a column ``end`` with the boundary after each group. Returns the smallest capacity and the cuts."""
    if total == 0:
        return 0, [0] * (shards - 1)
    width = max(1, -(-total // CELLS))
    bounds = Boundaries([(0, 0, 1), *_summary(prefix.where("end > 0"), F.floor(F.col("end") / width))])
    while True:
        high, low = smallest(bounds, shards, total, False), smallest(bounds, shards, total, True)
        probes = sorted({low, high, (low + high) // 2})
        cells = _uncertain(bounds, probes, shards, total, low == high)
        if not cells and low == high:
            break
        if not cells:  # the bounds differ only beyond the probes: look at every cell between them
            cells = {k for c in range(low, high + 1, max(1, (high - low) // 64)) for k in _uncertain(bounds, [c], shards, total, False)}
        _refine(prefix, bounds, cells)
    return low, _balanced(prefix, bounds, low, shards, total)


def _balanced(prefix: DataFrame, bounds: Boundaries, capacity: int, shards: int, total: int) -> list[int]:
    """Cuts that keep the capacity, each as near to its equal share as that allows."""
    while True:
        cuts, unsure = _try_balanced(bounds, capacity, shards, total)
        if not unsure:
            return cuts
        _refine(prefix, bounds, unsure)


def _try_balanced(bounds: Boundaries, capacity: int, shards: int, total: int) -> tuple[list[int], set[int]]:
    """Cuts by what is known, and the uncertain cells that they depend on."""
    unsure: set[int] = set()

    def at_or_below(x: int) -> int:
        if (cell := bounds.open_cell(x)) is not None:
            unsure.add(cell)
        return bounds.last(x, False)

    def at_or_above(x: int) -> int:
        if at_or_below(x) == x:
            return x
        i = bisect_right(bounds.low, x) - 1
        return bounds.cells[i][1] if bounds.cells[i][1] >= x else bounds.cells[min(i + 1, len(bounds.cells) - 1)][0]

    earliest = [total]  # from the right: the first cut that leaves what the later shards can take
    for _ in range(shards - 1):
        earliest.append(at_or_above(max(0, earliest[-1] - capacity)))
    earliest = earliest[::-1]
    cuts, at = [], 0
    for j in range(1, shards):
        first, last = max(earliest[j], at), at_or_below(min(at + capacity, total))
        ideal = min(max(j * total // shards, first), last)
        near = [c for c in (at_or_below(ideal), at_or_above(ideal), last) if first <= c <= last]
        at = min(near, key=lambda c: (abs(c - ideal), c)) if near else max(at, last)
        cuts.append(at)
    return cuts, unsure


def shard_documents(spark: SparkSession, docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row."""
    scratch = Scratch(spark, "sharding")
    text = F.col("text")
    raw = F.coalesce(text, F.lit("")).cast("binary")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(F.coalesce(text, F.lit(""))) + 8).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"), F.when(text.isNull(), F.lit("null")).otherwise(F.sha2(raw, 256)).alias("group"),
    )
    rows = scratch.save(rows, "rows")
    groups = rows.groupBy("group").agg(F.min("doc_id").alias("first"), F.sum("size").alias("bytes"))
    placed = groups.repartitionByRange(shuffle_partitions(spark), "first", "group").withColumn("part", F.spark_partition_id())
    placed = scratch.save(placed, "groups")
    offsets, at = {}, 0
    for r in placed.groupBy("part").agg(F.sum("bytes").alias("b")).orderBy("part").collect():  # one row for each partition
        offsets[r.part] = at
        at += r.b
    base = spark.createDataFrame(sorted(offsets.items()), "part int, base long")
    running = F.sum("bytes").over(W.partitionBy("part").orderBy(F.col("first").asc_nulls_first(), "group"))
    # the offsets have one row for each partition
    prefix = placed.withColumn("run", running).join(F.broadcast(base), "part").select("group", "bytes", (F.col("base") + F.col("run")).alias("end"))
    prefix = scratch.save(prefix, "prefix")
    _, cuts = find_cuts(prefix.select("end"), at, shards)
    start = F.col("end") - F.col("bytes")
    shard = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= start)) if cuts else F.lit(0)
    assigned = rows.join(prefix.select("group", shard.cast("int").alias("shard")), "group").drop("group")
    blocks = shuffle_partitions(spark)
    assigned = scratch.save(assigned.withColumn("block", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(blocks)).cast("int")), "assigned")
    # slots: an offset for each (shard, block), of which there are shards x partitions, and the row's number within
    sums = assigned.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = sums.withColumn("before", F.sum("n").over(W.partitionBy("shard").orderBy("block")) - F.col("n")).drop("n")
    number = F.row_number().over(W.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "size"))
    slots = assigned.withColumn("number", number).join(F.broadcast(before), ["shard", "block"])
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("number") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
