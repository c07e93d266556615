"""Language identification with language-bitmask n-gram filters.

A filter is an array of slots, each a bitmask of languages (bit-sliced: one
Bloom filter per bit, all looked up at once; 64 languages a word, and as many
words as the languages need).  An n-gram's three slots are combined by AND, which
gives all languages that contain it.  A text's n-grams are counted per language;
a filter with the share ``f`` of false answers contributes ``n * f`` hits by
chance, so ``(hits - n f) / (1 - f)`` estimates the true ones.  The language with
the most decides (of equal ones the first by name).

The filters are learned from a bounded sample: of each language at most
``SAMPLE`` texts, and of many languages fewer, ``TEXTS`` in all (one a language
at least), the first by a hash of doc_id.  Every language of the labels is
learned.  An n-gram belongs to a language if it makes up at least ``LEAST`` of
its n-grams there, so a language has at most 1 / LEAST of them, and at least
``SHARE`` of what the language with the most has; that keeps mislabelled or mixed
texts out.

Texts that are null or hold no letter are ``und`` with score 0, as is everything
if nothing was learned.  Repeated documents are predicted each; a
repeated doc_id teaches one of its texts; labelled rows doc_id or text teach nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirework.llm.common import batch_of, map_arrow, staged, table
from quirework.llm.quality_knn import fold

#: Texts of each language that the filters are learned from, at most.
SAMPLE = 1000
#: Texts of all languages together, about.
TEXTS = 256_000
SIZES, SLOTS, HASHES = (3, 4, 5), 1 << 20, 3
LEAST, SHARE = 2e-6, 0.2
_LETTER = regex.compile(r"\p{L}")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Bytes that are hashed at once.
PIECE = 1 << 20


def grams(raw: bytes) -> Iterator[np.ndarray]:
    """64-bit hashes of the byte n-grams of a whole text in lower case, blanks
    alike, those that begin in PIECE bytes at a time."""
    text = b" " + b" ".join(raw.translate(_LOWER).split()) + b" "
    for lo in range(0, len(text), PIECE):
        x = np.frombuffer(text[lo : lo + PIECE + max(SIZES) - 1], np.uint8).astype(np.uint64)
        begin = min(PIECE, len(text) - lo)
        out = []
        code = x
        for n in range(2, max(SIZES) + 1):
            if len(code) < 2:
                break
            code = (code[:-1] << np.uint64(8)) | x[n - 1 :]
            if n in SIZES:
                h = (code[:begin] + np.uint64(n * 0x517CC1B727220A95 % 2**64)) * np.uint64(0x9E3779B97F4A7C15)
                out.append(h ^ (h >> np.uint64(32)))
        if out:
            yield np.concatenate(out)


def places(h: np.ndarray) -> list[np.ndarray]:
    """The slots of each n-gram."""
    return [((h * np.uint64(m)) >> np.uint64(44)).astype(np.int64) for m in (0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


class Filters:
    """Bit-sliced Bloom filters of all languages."""

    def __init__(self, per_language: dict[str, np.ndarray]):
        self.names = sorted(per_language)
        self.words = (len(self.names) + 63) // 64
        self.slots = np.zeros((self.words, SLOTS), np.uint64)
        self.false = np.zeros(len(self.names))
        for i, name in enumerate(self.names):
            bit = np.uint64(1 << (i % 64))
            for at in places(per_language[name]):
                np.bitwise_or.at(self.slots[i // 64], at, bit)
            self.false[i] = float((self.slots[i // 64] & bit != 0).mean()) ** HASHES

    def hits(self, raw: bytes) -> tuple[np.ndarray, int]:
        """Per language the n-grams it contains, and the number of n-grams."""
        out, total = np.zeros(len(self.names)), 0
        for h in grams(raw):
            total += len(h)
            at = places(h)
            for w in range(self.words):
                slots = self.slots[w]
                mask = slots[at[0]] & slots[at[1]] & slots[at[2]]
                for i in range(64 * w, min(len(self.names), 64 * w + 64)):
                    out[i] += np.count_nonzero(mask & np.uint64(1 << (i % 64)))
        return out, total

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.names or not _LETTER.search(text):
            return "und", 0.0
        hits, n = self.hits(text.encode("utf-8", "surrogatepass"))
        true = np.maximum(hits - n * self.false, 0) / (1 - self.false + 1e-12)
        best = int(true.argmax())
        return self.names[best], float(true[best] / max(true.sum(), 1e-12))


def gram_counts(batches):
    """Hashes and counts of the n-grams of each text."""
    for batch in batches:
        for lang, raw in zip(batch.column("lang").to_pylist(), batch.column("raw").to_pylist(), strict=True):
            for part in grams(raw):
                keys, counts = np.unique(part, return_counts=True)
                yield batch_of(
                    lang=pa.array([lang] * len(keys), pa.string()),
                    h=pa.array(keys.view(np.int64)),
                    n=pa.array(counts.astype(np.int64)),
                )


def learn(docs: DataFrame, sample: int = SAMPLE, texts: int = TEXTS) -> Filters:
    """Filters from a bounded sample of the labelled texts."""
    named = docs.where("lang is not null and text is not null and doc_id is not null")
    # a repeated doc_id counts once, with the text of the least hash
    share = named.groupBy("lang", "doc_id").agg(F.min(F.xxhash64("text")).alias("t")).withColumn("o", F.xxhash64("doc_id"))
    sizes = staged(share.groupBy("lang").agg(F.count(F.lit(1)).alias("of")), "languages")
    each = max(1, min(sample, texts // max(1, sizes.count())))
    # the first of each language by hash, thinned before the window so that no task gets a whole language
    thin = F.col("o") / F.lit(2.0**64) + 0.5 <= F.lit(4.0 * each + 1000) / F.col("of")
    first = Window.partitionBy("lang").orderBy("o", "doc_id")
    picked = staged(
        share.join(sizes, "lang")
        .where(thin)
        .withColumn("r", F.row_number().over(first))
        .where(F.col("r") <= each)
        .select(F.col("lang").alias("_l"), F.col("doc_id").alias("_d"), F.col("t").alias("_t")),
        "picked",
    )
    # at most ``texts`` ids, or one a language: small enough to broadcast
    chosen = named.select("doc_id", "lang", F.xxhash64("text").alias("t"), F.col("text").cast("binary").alias("raw")).join(
        F.broadcast(picked), (F.col("doc_id") == F.col("_d")) & (F.col("lang") == F.col("_l")) & (F.col("t") == F.col("_t"))
    )
    counted = map_arrow(chosen.dropDuplicates(["lang", "doc_id"]).select("lang", "raw"), gram_counts, "lang string, h long, n long")
    counts = staged(counted.groupBy("lang", "h").agg(F.sum("n").alias("n")), "grams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("of"))
    rates = staged(
        counts.join(totals, "lang").select("lang", "h", (F.col("n") / F.col("of")).alias("rate")).where(F.col("rate") >= LEAST), "rates"
    )
    tops = rates.groupBy("h").agg(F.max("rate").alias("top"))
    kept = rates.join(tops, "h").where(F.col("rate") >= SHARE * F.col("top")).select("lang", "h")
    # at most 1 / LEAST numbers a language
    by = kept.toArrow().group_by("lang").aggregate([("h", "list")])
    lists = zip(by.column("lang").to_pylist(), by.column("h_list").combine_chunks(), strict=True)
    return Filters({lang: h.values.to_numpy(zero_copy_only=False).view(np.uint64) for lang, h in lists})


def predictor(shared):
    def work(batches):
        filters = shared.value
        for batch in batches:
            said = [filters.predict(t) for t in batch.column("text").to_pylist()]
            yield batch_of(
                doc_id=batch.column("doc_id"),
                lang_pred=pa.array([x for x, _ in said], pa.string()),
                score=pa.array([x for _, x in said], pa.float64()),
            )

    return work


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(
        docs.select("doc_id", "text"),
        predictor(docs.sparkSession.sparkContext.broadcast(filters)),
        f"doc_id {kind}, lang_pred string, score double",
    )


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    filters = learn(docs.where(fold(of=3) != 1))
    return identify(docs, filters).select("doc_id", (fold(of=3) == 1).alias("held_out"), "lang_pred", "score")
