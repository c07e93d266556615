"""Benchmark decontamination by winnowing.

Words are lower-cased (A-Z only) runs of ASCII letters, digits and all
non-ASCII characters.  A window is ``span`` consecutive words of an item (a
shorter item is one window of all its words).  Both sides are winnowed: of every
``w`` consecutive k-gram hashes the least is kept, with ``k + w - 1 == span``,
so any shared span of ``span`` words shares at least one kept fingerprint.
Documents' fingerprints are joined with the benchmark's; each match is extended
by looking up the windows around it and comparing their words, so hits are
exact.  Items of n < span words are winnowed with ``k = n, w = 1``.

The benchmark is broadcast in blocks of at most ``BLOCK_WORDS`` words (its size
is measured first); a larger benchmark takes several passes whose hits are
united per document.  Null and empty texts have no words; items with a null id
take no part.  Repeated documents are judged each; an item id on several rows is
one item.
"""

from __future__ import annotations

import hashlib
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.llm.common import batch_of, map_arrow, table, utf8

SPAN, K = 10, 5
#: Words of the benchmark that one broadcast holds at most (one item may exceed it).
BLOCK_WORDS = 2_000_000

_FOLD = bytes(
    (c + 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256)
)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def words(raw: bytes) -> list[bytes]:
    """Words of a UTF-8 text; all non-ASCII bytes belong to words."""
    return raw.translate(_FOLD).split()


def gram_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive ids; grams with an unknown word (-1) get
    the largest value."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    x = (ids.astype(np.uint64) + np.uint64(1)) * _MIX
    x ^= x >> np.uint64(29)
    h = np.zeros(n, np.uint64)
    bad = np.zeros(n, bool)
    for j in range(k):
        h = h * np.uint64(0x100000001B3) + x[j : j + n]
        bad |= ids[j : j + n] < 0
    h ^= h >> np.uint64(31)
    h *= _MIX
    h >>= np.uint64(1)
    h[bad] = _NONE
    return h


def winnow(h: np.ndarray, w: int) -> np.ndarray:
    """Positions of the least hash of every w consecutive ones (ties: each),
    without those of grams that hold an unknown word."""
    n = len(h)
    if n == 0:
        return np.empty(0, np.int64)
    w = min(w, n)
    least = h[: n - w + 1]
    for j in range(1, w):
        least = np.minimum(least, h[j : n - w + 1 + j])
    at = np.flatnonzero(h != _NONE)
    kept = np.zeros(len(at), bool)
    for j in range(w):
        s = at - j
        kept |= (s >= 0) & (s < len(least)) & (least[np.clip(s, 0, len(least) - 1)] == h[at])
    return at[kept]


class Fingerprints:
    """Winnowed fingerprints and exact windows of one block of items."""

    def __init__(self, items: list[tuple[str, bytes]], span: int = SPAN, k: int = K):
        self.span, self.k, self.vocab = span, k, {}
        by_len: dict[int, dict[tuple, set]] = {}
        prints = []
        for item, raw in items:
            ids = [self.vocab.setdefault(w, len(self.vocab)) for w in words(raw)]
            if not ids:
                continue
            size = min(span, len(ids))
            found = by_len.setdefault(size, {})
            for i in range(len(ids) - size + 1):
                found.setdefault(tuple(ids[i : i + size]), set()).add(item)
            if size == span:
                h = gram_hashes(np.array(ids, np.int64), k)
                prints.append(h[winnow(h, span - k + 1)])
        self.prints = np.unique(np.concatenate(prints)) if prints else np.empty(0, np.uint64)
        self.tables = {}
        for size, found in by_len.items():
            rows = np.array(list(found), np.int64).reshape(-1, size)
            h = np.array([gram_hashes(r, size)[0] for r in rows], np.uint64)
            order = np.argsort(h, kind="stable")
            owners = list(found.values())
            self.tables[size] = (h[order], rows[order], [sorted(owners[i]) for i in order])

    def _known(self, h: np.ndarray, table: np.ndarray) -> np.ndarray:
        at = np.searchsorted(table, h)
        at[at == len(table)] = 0
        return (table[at] == h) & (h != _NONE)

    def hits(self, ids: np.ndarray):
        """Starts, lengths and item lists of all windows in ``ids``."""
        out = []
        for size, (hashes, rows, owners) in self.tables.items():
            if len(ids) < size:
                continue
            if size == self.span:  # winnowed fingerprints locate the candidates
                grams = gram_hashes(ids, self.k)
                picked = winnow(grams, self.span - self.k + 1)
                picked = picked[self._known(grams[picked], self.prints)]
                starts = (picked[:, None] - np.arange(self.span - self.k + 1)).ravel()
                starts = np.unique(starts[(starts >= 0) & (starts <= len(ids) - size)])
            else:
                grams = gram_hashes(ids, size)
                starts = np.flatnonzero(self._known(grams, hashes))
            for lo in range(0, len(starts), 100_000):
                at = starts[lo : lo + 100_000]
                near = ids[at[:, None] + np.arange(size)]
                h = np.zeros(0, np.uint64) if len(at) == 0 else _rows_hash(near)
                first = np.searchsorted(hashes, h)
                for p, r, x in zip(at, first, range(len(at)), strict=True):
                    while r < len(hashes) and hashes[r] == h[x]:
                        if (rows[r] == near[x]).all():
                            out.append((int(p), size, owners[r]))
                            break
                        r += 1
        return out


def _rows_hash(rows: np.ndarray) -> np.ndarray:
    k = rows.shape[1]
    x = (rows.astype(np.uint64) + np.uint64(1)) * _MIX
    x ^= x >> np.uint64(29)
    h = np.zeros(len(rows), np.uint64)
    for j in range(k):
        h = h * np.uint64(0x100000001B3) + x[:, j]
    h ^= h >> np.uint64(31)
    h *= _MIX
    h >>= np.uint64(1)
    h[(rows < 0).any(axis=1)] = _NONE
    return h


def scan(shared):
    """The worker's function: one row out for each document."""

    def work(batches):
        prints = shared.value
        gap = np.full(1, -1, np.int64)
        for batch in batches:
            parts, sizes = [], []
            for raw in batch.column("raw").to_pylist():
                ws = words(raw)
                parts += [np.fromiter(map(prints.vocab.get, ws, repeat(-1)), np.int64, len(ws)), gap]
                sizes.append(len(ws))
            ids = np.concatenate(parts) if parts else gap
            base = np.concatenate([[0], np.cumsum(np.array(sizes) + 1)]).astype(np.int64)
            hits: dict[int, tuple[list, set]] = {}
            for p, size, owners in prints.hits(ids):
                d = int(np.searchsorted(base, p, side="right")) - 1
                spans, named = hits.setdefault(d, ([], set()))
                named.update(owners)
                start = p - int(base[d])
                if spans and start <= spans[-1][1] and start >= spans[-1][0]:
                    spans[-1][1] = max(spans[-1][1], start + size)
                else:
                    spans.append([start, start + size])
            spans = [
                np.array(hits[d][0], "<i8").tobytes() if d in hits else b"" for d in range(len(sizes))
            ]
            named = [sorted(hits[d][1]) if d in hits else [] for d in range(len(sizes))]
            yield batch_of(
                doc_id=batch.column("doc_id"),
                n_words=pa.array(sizes, pa.int64()),
                hits=pa.array(spans, pa.binary()),
                items=pa.array(named, pa.list_(pa.string())),
                **{n: batch.column(n) for n in batch.schema.names if n not in ("doc_id", "raw")},
            )

    return work


def digest(batches):
    """Unites the hits of a document and derives the contract's columns."""
    for batch in batches:
        n_hit, n_items, sha = [], [], []
        for spans, items in zip(batch.column("hits").to_pylist(), batch.column("items").to_pylist(), strict=True):
            n = last = 0
            for s, e in sorted(map(tuple, np.frombuffer(spans, "<i8").reshape(-1, 2).tolist())):
                n += max(0, e - max(s, last))
                last = max(last, e)
            ids = sorted(set(items))
            n_hit.append(n)
            n_items.append(len(ids))
            sha.append(hashlib.sha256(",".join(ids).encode()).hexdigest())
        yield batch_of(
            doc_id=batch.column("doc_id"),
            n_words=batch.column("n_words"),
            n_hit=pa.array(n_hit, pa.int64()),
            n_items=pa.array(n_items, pa.int64()),
            items_sha256=pa.array(sha, pa.string()),
            contaminated=pa.array([x > 0 for x in n_hit], pa.bool_()),
            **{n: batch.column(n) for n in batch.schema.names if n not in ("doc_id", "n_words", "hits", "items")},
        )


def blocks(benchmark: DataFrame, most: int = BLOCK_WORDS) -> list[DataFrame]:
    """The benchmark in parts that are small enough to broadcast."""
    items = benchmark.where("item_id is not null and text is not null").select(
        F.col("item_id").cast("string").alias("item"), utf8().alias("raw")
    )
    chars = items.agg(F.sum(F.length("raw"))).first()[0] or 0
    n = max(1, -(-chars // (2 * most)))  # a word takes two bytes at least
    return [items.where(F.pmod(F.xxhash64("item"), F.lit(n)) == i) for i in range(n)]


DIGEST = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def decontaminate(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, k: int = K, keep: tuple = ()) -> DataFrame:
    """One row per document with its hits; ``keep`` names columns to carry on."""
    sc = docs.sparkSession.sparkContext
    fields = docs.schema
    extra = [c for c in keep if c != "doc_id"]
    tail = "".join(f", {c} {fields[c].dataType.simpleString()}" for c in extra)
    head = f"doc_id {fields['doc_id'].dataType.simpleString()}"
    rows = docs.select("doc_id", utf8().alias("raw"), *extra)
    parts = blocks(benchmark)
    if len(parts) > 1:  # several passes: hits meet per row, told apart by what the row holds
        rows = docs.select(
            F.struct("doc_id", *extra, F.xxhash64("text").alias("_h")).alias("doc_id"), utf8().alias("raw")
        )
        kind = rows.schema["doc_id"].dataType.simpleString()
        found = None
        for part in parts:
            shared = sc.broadcast(Fingerprints([(r.item, bytes(r.raw)) for r in part.toLocalIterator()], span, k))
            one = map_arrow(rows, scan(shared), f"doc_id {kind}, n_words long, hits binary, items array<string>")
            found = one if found is None else found.unionByName(one)
        meet = found.groupBy("doc_id").agg(
            F.first("n_words").alias("n_words"),
            (F.count(F.lit(1)) / len(parts)).cast("int").alias("_n"),
            F.collect_list("hits").alias("hits"),
            F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
        )
        meet = meet.select(
            F.explode(F.array_repeat(F.struct("n_words", "hits", "items"), F.col("_n"))).alias("x"), "doc_id"
        ).select(
            "doc_id.doc_id",
            "x.n_words",
            F.unhex(F.array_join(F.transform("x.hits", F.hex), "")).alias("hits"),
            "x.items",
            *(F.col(f"doc_id.{c}").alias(c) for c in extra),
        )
        return map_arrow(meet, digest, f"{head}, {DIGEST}{tail}")
    shared = sc.broadcast(Fingerprints([(r.item, bytes(r.raw)) for r in parts[0].toLocalIterator()], span, k))

    def whole(batches, first=scan(shared)):
        return digest(first(batches))

    return map_arrow(rows, whole, f"{head}, {DIGEST}{tail}")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
