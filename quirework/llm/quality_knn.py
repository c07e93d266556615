"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

A text is a bag of hashed terms: case-keeping byte trigrams, and marks of form
(repeated words, lines, capitals, symbols) that share the vector.  Weighted by
tf-idf they are projected by a truncated SVD that is fitted on a bounded sample
of labelled rows: at most ``SAMPLE`` of either class, the first by a hash of
doc_id.  The sample's latent vectors and labels are broadcast (their size is
bounded by ``2 * SAMPLE * RANK`` numbers); every document is compared with all
of them by exact blocked cosine products, and its ``NEIGHBOURS`` nearest vote
with their similarity as weight.  A class's votes are divided by its share of
the sample.

Labels, language, source and id never enter a vector.  Null and empty texts have
the zero vector and score 0; so does everything when there is no labelled row.
Repeated documents are scored each; labels that are null or of unknown documents
are ignored; a document with both labels counts as 0; a repeated doc_id teaches
the text of the least hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.llm.common import batch_of, map_arrow, staged, table, utf8

#: Labelled rows of each class that the space is fitted on, at most.
SAMPLE = 1500
TERMS, FORMS, RANK, NEIGHBOURS, POWER = 4096, 96, 64, 15, 4
THRESHOLD = 0.3
BLOCK = 512
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _level(share: float) -> int:
    """A share as one of twelve levels, finer near zero."""
    return int(min(11, np.sqrt(max(share, 0.0)) * 12))


def terms(raw: bytes) -> np.ndarray:
    """Counts of hashed byte trigrams, then marks of form."""
    out = np.zeros(TERMS + FORMS, np.float32)
    n = len(raw)
    if n == 0:
        return out
    x = np.frombuffer(raw, np.uint8)
    if n > 2:
        h = x[:-2].astype(np.uint32) * np.uint32(0x9E3779B1)
        h += x[1:-1].astype(np.uint32) * np.uint32(0x85EBCA77)
        h += x[2:].astype(np.uint32) * np.uint32(0xC2B2AE3D)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        out[:TERMS] = np.bincount(h >> np.uint32(20), minlength=TERMS)
    by = np.bincount(x, minlength=256)
    words = raw.translate(_LOWER).split()
    lines = [line for line in raw.split(b"\n") if line.strip()]
    m = max(1, len(words))
    same = sum(map(bytes.__eq__, words[1:], words[:-1]))
    marks = (
        same / m,
        1 - len(set(words)) / m,
        1 - len(set(lines)) / max(1, len(lines)),
        by[65:91].sum() / n,
        (by[35:39].sum() + by[42] + by[60] + by[62] + by[124]) / n,
        (by[33] + by[63]) / n,
        by[48:58].sum() / n,
        min(1.0, 10 / m),
    )
    for i, v in enumerate(marks):
        out[TERMS + 12 * i + _level(float(v))] = 1
    return out


class Space:
    """Term weights, the latent basis and the labelled vectors."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, rank: int = RANK, seed: int = 8):
        self.labels = labels.astype(np.float32)
        self.idf = np.log((1 + len(rows)) / (1 + (rows > 0).sum(axis=0))).astype(np.float32) + 1
        a = self.weighted(rows)
        k = min(rank + 16, *a.shape)
        y = a @ np.random.RandomState(seed).standard_normal((a.shape[1], k)).astype(np.float32)
        for _ in range(4):  # randomized subspace iteration
            q, _ = np.linalg.qr(y)
            y = a @ (a.T @ q)
        q, _ = np.linalg.qr(y)
        _, _, basis = np.linalg.svd(q.T @ a, full_matrices=False)
        self.basis = np.ascontiguousarray(basis[:rank].T)
        self.known = unit(a @ self.basis)
        share = np.array([(labels == c).mean() if len(labels) else 0 for c in (0, 1)])
        self.weight = np.where(labels == 1, 1 / max(share[1], 1e-9), 1 / max(share[0], 1e-9)).astype(np.float32)

    def weighted(self, rows: np.ndarray) -> np.ndarray:
        """Unit tf-idf vectors; the marks of form weigh as much as the trigrams."""
        t = np.log1p(rows[:, :TERMS]) * self.idf[:TERMS]
        f = rows[:, TERMS:] * self.idf[TERMS:]
        return np.hstack([unit(t), unit(f)]) * np.float32(0.5**0.5)

    def scores(self, rows: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        """The weighted vote for label 1 of each row."""
        out = np.zeros(len(rows))
        k = min(neighbours, len(self.known))
        for lo in range(0, len(rows), BLOCK):
            z = unit(self.weighted(rows[lo : lo + BLOCK]) @ self.basis)
            cos = z @ self.known.T
            top = np.argpartition(-cos, k - 1, axis=1)[:, :k]
            w = np.maximum(np.take_along_axis(cos, top, axis=1), 0) ** POWER * self.weight[top]
            total = w.sum(axis=1)
            out[lo : lo + BLOCK] = np.where(total > 0, (w * self.labels[top]).sum(axis=1) / np.maximum(total, 1e-30), 0)
        return np.where(rows[:, :TERMS].any(axis=1), out, 0.0)


def unit(x: np.ndarray) -> np.ndarray:
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def vectors(batches):
    for batch in batches:
        yield batch_of(
            quality=batch.column("quality"),
            x=pa.array([terms(t).tobytes() for t in batch.column("raw").to_pylist()], pa.binary()),
        )


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Space | None:
    """The space from a bounded sample of both classes; None without labels."""
    marked = (
        labels.where("doc_id is not null and quality in (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("quality").cast("int").alias("quality"))
    )
    there = marked.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    order = (F.xxhash64("doc_id"), "doc_id")
    picked = staged(
        there.where("quality = 0").orderBy(*order).limit(sample).unionByName(
            there.where("quality = 1").orderBy(*order).limit(sample)
        ),
        "picked",
    )
    # at most 2 * sample ids: small enough to broadcast
    texts = (
        docs.select("doc_id", utf8().alias("raw"))
        .join(F.broadcast(picked), "doc_id")
        .groupBy("doc_id", "quality")
        .agg(F.min_by("raw", F.xxhash64("raw")).alias("raw"))
    )
    rows = map_arrow(texts.select("quality", "raw"), vectors, "quality int, x binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r.quality, bytes(r.x)))
    x = np.frombuffer(b"".join(bytes(r.x) for r in rows), np.float32).reshape(len(rows), -1)
    return Space(x, np.array([r.quality for r in rows]))


def scorer(shared):
    def work(batches):
        space = shared.value
        for batch in batches:
            score = []
            raws = batch.column("raw").to_pylist()
            for lo in range(0, len(raws), BLOCK):
                some = raws[lo : lo + BLOCK]
                if space is None:
                    score += [0.0] * len(some)
                else:
                    score += space.scores(np.array([terms(t) for t in some])).tolist()
            yield batch_of(
                doc_id=batch.column("doc_id"),
                score=pa.array(score, pa.float64()),
                **{n: batch.column(n) for n in batch.schema.names if n not in ("doc_id", "raw")},
            )

    return work


def classify(docs: DataFrame, space: Space | None, keep: tuple = ()) -> DataFrame:
    """doc_id, score and the columns named in ``keep``."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    extra = [c for c in keep if c != "doc_id"]
    return map_arrow(
        docs.select("doc_id", utf8().alias("raw"), *extra),
        scorer(docs.sparkSession.sparkContext.broadcast(space)),
        f"doc_id {kinds['doc_id']}, score double" + "".join(f", {c} {kinds[c]}" for c in extra),
    )


def fold(doc_id="doc_id", of: int = 5):
    """The contract's fold of a document."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % of


def quality_scores(docs: DataFrame, labels: DataFrame, keep: tuple = ()) -> DataFrame:
    """Scores of all documents; learns from folds 1 to 4."""
    return classify(docs, fit(docs, labels.where(fold() != 0)), keep)


def op8_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select(
        "doc_id",
        (fold() == 0).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
