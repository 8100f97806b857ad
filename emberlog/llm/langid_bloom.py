"""Language identification by language-bitmask n-gram filters.

A model is one bit-sliced Bloom filter: slot s holds a mask with one bit for each
language, so that one lookup of an n-gram, an AND over its slots, returns all languages
that hold it. For every language the filter holds its most frequent byte n-grams of 1 to
4 bytes (of lower-cased text, in which a run of other characters than letters is one
space), so its size is bounded by languages x grams_per_language.

A text is decided by the number of its n-grams that each language holds (a popcount per
language). A count is corrected for false positives: with f the share of the slots'
masks that would match by chance, count' = (count - f n) / (1 - f). The largest corrected
count wins, ties go to the first language by name.

Learning reads text and non-null lang of the training rows only, by language a sample of
about ``max_rows`` documents chosen by a hash of doc_id and text, so that copies of a
text are dealt one by one, and counts n-grams of their whole texts in parallel.

Defined results of edge cases: a text that is null or has no letter is "und" with score
0; with nothing to learn from every text is "und"; repeated rows are scored like any
other; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import is_train

SIZES = (1, 2, 3, 4)
HASHES = 3
#: Bytes that are looked up together, so few that they stay in the processor's cache.
PIECE = 1 << 16


def letters_only(text: str) -> bytes:
    """Lower case, in UTF-8, with one space for each run of other characters and at both ends."""
    import re

    return b" " + re.sub(r"[\W\d_]+", " ", text.lower()).strip().encode("utf-8", "replace") + b" "


def grams(data: np.ndarray, size: int) -> np.ndarray:
    """The byte n-grams of one size as numbers, with the size in the bits above."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = (out << np.uint64(8)) | data[k : k + n]
    return out


def slots(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    """The slots of each key, from one 64-bit mix."""
    h = keys * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    mask = np.uint64((1 << bits) - 1)
    return [((h >> np.uint64(k * 21)) & mask).astype(np.int64) for k in range(HASHES)]


@dataclass
class LanguageFilters:
    languages: list[str]
    bits: int
    masks: np.ndarray  # for each 64 languages a word of language bits for each slot

    @staticmethod
    def build(held: dict[str, np.ndarray], bits: int = 18) -> LanguageFilters:
        """held: the n-grams of each language."""
        languages = sorted(held)
        if bits > 21:
            raise ValueError("a slot has up to 21 bits")
        masks = np.zeros((-(-len(languages) // 64), 1 << bits), np.uint64)
        for k, language in enumerate(languages):
            for s in slots(held[language], bits):
                masks[k // 64][s] |= np.uint64(1 << k % 64)
        return LanguageFilters(languages, bits, masks)

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """For each n-gram a mask of all languages that hold it, one row for each 64 languages."""
        first, *rest = slots(keys, self.bits)
        out = self.masks[:, first]
        for s in rest:
            out &= self.masks[:, s]
        return out

    def chance(self) -> np.ndarray:
        """By language, the share of absent n-grams that the filter reports."""
        return np.array([(((self.masks[k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean()) ** HASHES for k in range(len(self.languages))])

    def counted(self, data: np.ndarray, of: np.ndarray, new: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each text the n-grams that each language holds, and all n-grams.

        of: the text of each byte; new: whether n-grams that end there haven't been counted.
        Masks are counted by text first, whatever languages they name; their bits are added up
        once for each mask that occurs.
        """
        hits, total = np.zeros((texts, len(self.languages))), np.zeros(texts)
        value = np.zeros(len(data) + 1, np.uint64)  # the bytes of the n-grams of one size
        for size in SIZES:
            n = len(data) - size + 1
            if n <= 0:
                break
            value = (value[:n] << np.uint64(8)) | data[size - 1 :]
            own = np.where((of[:n] == of[size - 1 :]) & new[size - 1 :], of[:n], texts)  # not across texts
            total += np.bincount(own, minlength=texts + 1)[:texts]
            if size <= 2:  # there are so few that all have been looked up
                found = self.short(size)[:, value.astype(np.int64)]
            else:
                found = self.lookup(value + np.uint64(size << 8 * size))
            for word, masks in enumerate(found):
                if len(self.languages) <= 10:
                    kinds, back = np.arange(1 << len(self.languages), dtype=np.uint64), masks.astype(np.int64)
                else:
                    kinds, back = np.unique(masks, return_inverse=True)
                seen = np.bincount(own * len(kinds) + back, minlength=(texts + 1) * len(kinds)).reshape(texts + 1, -1)[:texts]
                here = range(64 * word, min(64 * (word + 1), len(self.languages)))
                bits = np.stack([(kinds >> np.uint64(k % 64)) & np.uint64(1) for k in here], axis=1)
                hits[:, here.start : here.stop] += seen @ bits.astype(float)
        return hits, total

    def short(self, size: int) -> np.ndarray:
        """The masks of all n-grams of one or two bytes."""
        held = self.__dict__.setdefault("_short", {})
        if size not in held:
            held[size] = self.lookup(np.arange(256**size, dtype=np.uint64) + np.uint64(size << 8 * size))
        return held[size]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        if not self.languages:
            return names, scores
        hits, total = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        pieces: list[tuple[int, bytes, int]] = []

        def count() -> None:
            lengths = [len(p) for _, p, _ in pieces]
            of = np.repeat(np.arange(len(pieces)), lengths)
            place = np.arange(len(of)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            new = place >= np.repeat([lead for _, _, lead in pieces], lengths)
            found, n = self.counted(np.frombuffer(b"".join(p for _, p, _ in pieces), np.uint8), of, new, len(pieces))
            ids = np.array([i for i, _, _ in pieces])
            np.add.at(hits, ids, found)
            np.add.at(total, ids, n)
            pieces.clear()

        known, held, lead = [i for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)], 0, max(SIZES) - 1
        for i in known:
            raw = letters_only(texts[i])
            for a in range(0, len(raw), PIECE):  # long texts in pieces, each after the bytes with which its first n-grams begin
                pieces.append((i, raw[max(0, a - lead) : a + PIECE], min(a, lead)))
                held += len(pieces[-1][1])
                if held >= PIECE:
                    count()
                    held = 0
        if pieces:
            count()
        chance = self.chance()
        fixed = np.maximum((hits - np.outer(total, chance)) / (1 - np.minimum(chance, 0.999)), 0)
        for i in known:
            best, every = int(np.argmax(fixed[i])), fixed[i].sum()
            names[i] = self.languages[best]
            scores[i] = float(fixed[i][best] / every) if every > 0 else 0.0
        return names, scores


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        table = pd.DataFrame({"lang": batch.column("lang").to_pylist(), "text": batch.column("text").to_pylist()})
        for lang, texts in table.groupby("lang")["text"]:
            found = [grams(np.frombuffer(letters_only(t), np.uint8), size) for t in texts for size in SIZES]
            keys, counts = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(keys), "gram": keys.astype(np.int64), "n": counts.astype(np.int64)}, schema=pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())]))


def learn(spark: SparkSession, docs: DataFrame, max_rows: int = 2000, grams_per_language: int = 4000, bits: int = 18) -> LanguageFilters:
    """Filters of the languages of the training rows of docs (doc_id, text, lang)."""
    train = docs.where(is_train(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    sizes = {r.lang: r.n for r in docs.where(is_train(F.col("doc_id")) & F.col("lang").isNotNull()).groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, max_rows / n))).otherwise(share)
    # the hash spreads rows evenly over [0, 1), copies of one text too
    place = F.pmod(F.xxhash64("doc_id", "text", F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = train.where(place < share).select("lang", "text")
    counted = sample.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = counted.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("r") <= grams_per_language)
    rows = top.select("lang", "gram").toPandas()  # languages x grams_per_language rows at most
    return LanguageFilters.build({lang: g["gram"].to_numpy().astype(np.uint64) for lang, g in rows.groupby("lang")}, bits)


def predict(spark: SparkSession, docs: DataFrame, model: LanguageFilters) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every whole text."""
    shared = spark.sparkContext.broadcast(model)  # bounded by the number of slots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = shared.value.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (~is_train(F.col("doc_id"))).alias("held_out"), "text")
    return source.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
