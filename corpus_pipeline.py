"""The corpus pipeline: five stages, each over all that the one before kept.

1. toxicity: rows whose text the model predicts toxic go, each by its own score and the
   operator's threshold; the model learns from the labelled training rows.
2. line dedup: long lines of five documents or more stay in one of them.
3. n-gram Jaccard join: of each group of near-duplicates the smallest doc_id stays.
4. benchmark decontamination: documents that hold a benchmark item's template go.
5. byte-level BPE: ids and decoded bytes of what is left, as digests.

All but the last return the columns of documents; n_chars follows the text. A document
that line dedup leaves empty stays. Stages act as their operators say for nulls, empty
texts, repeats and empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm import bpe_shuffle, decontam, ngram_join, toxicity_fm
from emberlog.llm.common import Scratch, read_table
from emberlog.llm.line_runs import dedup_lines

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity_fm.learn(spark, docs, read_table(spark, sf_dir, "labels"))
    return toxicity_fm.keep_clean(spark, docs.select(*COLUMNS), model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark, docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(spark, docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.keep_clean(spark, docs.select(*COLUMNS), read_table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_shuffle.encode_digests(spark, docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]
#: Not expressible: a fitted model decides the first stage, a tokenizer makes the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written and read again for the next."""
    scratch = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.save(docs, name)
    return docs
