"""Exact deduplication by a 128-bit content hash, with a comparison of bytes (DataFrame operations only).

1. Every row gets two 64-bit hashes of its normalised text. Rows are counted by hash; counts
   and the id that stays are combined before the shuffle, so a group of any size costs one
   row a task. No text moves.
2. Texts whose hash stands in one row are done. The others pass a bit table of the repeated
   hashes, whose size is bounded, and are grouped by hash *and* bytes; of a task's copies one
   text travels. A hash under which two texts appear is a collision.
3. Rows of colliding hashes, none in practice, are told apart by their texts, so that no
   group ever holds two texts.

The bit table has ``most_bits`` bits at most. Beyond that it lets unique texts pass, which
costs shuffle, not results.

Defined results of edge cases: a null text equals an empty one; a null doc_id sorts below
every other; of rows that repeat the id that stays one row stays; an empty table gives an
empty table; ``keep_one`` returns the columns of the input as they are, whatever their
names; a very long text is one row like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, unused_name

KEY = ["h1", "h2"]
#: Bits of one row of the bit table, as Spark's bitmap functions make them.
ROW_BITS = 1 << 15


def content_hash(text: Column) -> tuple[Column, Column]:
    """128 bits of a text, as two hashes with different seeds."""
    return F.xxhash64(text), F.xxhash64(F.lit("second"), text)


def _bit_table(groups: DataFrame, bits: int) -> DataFrame:
    """(bits_of, bits): a set bit for each hash, in rows of 4 KB."""
    slot = F.pmod(F.col("h1"), F.lit(bits))
    return groups.groupBy(F.bitmap_bucket_number(slot).alias("bits_of")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))


def _passes(hashed: DataFrame, table: DataFrame, bits: int) -> DataFrame:
    """The rows whose hash the bit table holds, and others by chance."""
    slot = F.pmod(F.col("h1"), F.lit(bits))
    at = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.expr("substring(bits, int(at div 8) + 1, 1)")), 16, 10).cast("int")
    # at most bits / 8 bytes
    met = hashed.withColumns({"bits_of": F.bitmap_bucket_number(slot), "at": at}).join(F.broadcast(table), "bits_of")
    return met.where(F.expr("shiftleft(1, int(at % 8))").bitwiseAND(byte) != 0).drop("bits_of", "bits", "at")


def exact_groups(spark: SparkSession, docs: DataFrame, keep: str = "smallest", tie: str | None = None, hashes=content_hash, most_bits: int = 1 << 28) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of docs (doc_id, text).

    keep: whether the smallest or the largest doc_id of a group stays. tie: a column that
    names rows, returned as ``row`` and deciding between rows that repeat an id. hashes:
    text to the two hashes.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is smallest or largest")
    scratch = Scratch(spark, "exact-groups")
    best = F.max if keep == "largest" else F.min

    def hashed(rows: DataFrame) -> DataFrame:
        norm = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
        h1, h2 = hashes(norm)
        number = F.col(tie) if tie else F.monotonically_increasing_id()
        return rows.select("doc_id", number.cast("long").alias("row"), h1.alias("h1"), h2.alias("h2"), norm.alias("norm"))

    def marked(rows: DataFrame, text_no: Column) -> DataFrame:
        return rows.select("doc_id", "row", *KEY, text_no.cast("long").alias("text_no"), F.unhex(F.sha2("norm", 256)).alias("sha"))

    rows = scratch.save(marked(hashed(docs), F.lit(0)), "rows")
    repeated = scratch.save(rows.groupBy(*KEY).agg(F.count("*").alias("n")).where("n > 1").select(*KEY), "repeated")
    if not repeated.isEmpty():
        bits = min(most_bits, max(ROW_BITS, 1 << (16 * repeated.count()).bit_length()))
        # texts equal byte by byte are one row of this; a hash with two rows collides
        texts = _passes(hashed(docs), _bit_table(repeated, bits), bits).groupBy(*KEY, "norm").agg(F.count("*").alias("n"))
        collided = scratch.save(texts.groupBy(*KEY).agg(F.count("*").alias("texts")).where("texts > 1").select(*KEY), "collided")
        if not collided.isEmpty():
            apart = scratch.save(hashed(docs).join(collided, KEY), "apart")
            number = F.row_number().over(W.partitionBy(*KEY).orderBy("norm"))
            named = apart.select(*KEY, "norm").distinct().withColumn("text_no", number)
            rows = scratch.save(rows.join(collided, KEY, "left_anti").unionByName(marked(apart.join(named, [*KEY, "norm"]), F.col("text_no"))), "rows")
    of = [*KEY, "text_no"]
    # the order of structs puts nulls below values; for the smallest id a flag puts them there too, and the row decides ties
    stays = F.struct(F.col("doc_id").isNotNull().alias("known"), F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"))
    groups = rows.groupBy(*of).agg(F.count("*").alias("group_size"), best(stays).alias("s")).where("group_size > 1")
    groups = scratch.save(groups.select(*of, "group_size", "s.keep_id", "s.keep_row"), "groups")
    found = rows.join(groups, of, "left")
    alone = F.col("group_size").isNull()
    out = found.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "row",
    )
    return out if tie else out.drop("row")


def keep_one(spark: SparkSession, docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """One row of each group of equal texts stays, with all its columns."""
    row, gone = (unused_name(n, docs) for n in ("row_no", "gone"))
    numbered = Scratch(spark, "exact-rows").save(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    out = exact_groups(spark, numbered.select("doc_id", "text", row), keep, tie=row).where("NOT kept").select(F.col("row").alias(gone))
    return numbered.join(out, F.col(row) == F.col(gone), "left_anti").drop(row)
