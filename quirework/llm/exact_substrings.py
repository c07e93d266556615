"""Exact substring dedup: bytes covered by a ``width``-byte string that starts
twice anywhere are removed.

The method asked for (merging shard Burrows-Wheeler transforms by interleave
refinement, module ``bwt``) needs one pass over all merged bytes for each of
``width`` symbols of depth, which the limits don't allow for whole texts (README
has the figures).  The query therefore uses an exact, linear form of the same
question:

1. Each ``width``-byte window names its anchor, the least (hash, place) among
   its ``GRAM``-byte grams.  Equal windows name the same anchor at the same
   offset, so only windows of an anchor that occurs twice can repeat.
   Consecutive windows with one anchor form a run (about one per 170 bytes).
2. Anchors are counted (map-side combined).  A run whose anchor is unique is
   done.  A run whose whole context (all bytes of its windows) occurs twice is
   removed whole.
3. Left are contexts of repeated anchors that differ.  Their windows' hashes are
   compared among the anchor's distinct contexts, one row for each.  An
   anchor with more than ``HOT`` contexts is not gathered: its windows are dealt
   out by their offset from the anchor, and with more than ``HOT * BLOCK``
   contexts the hashes of its windows are counted by a shuffle of their own.

Matches never cross documents; a null text is empty.  Repeated rows are
copies of each other, so their windows repeat.  Rows are told apart by
doc_id (may be null) and a hash of the text; other columns are ignored.

Passages of ``OVER`` words (white space apart) that another document holds too
may be shorter than ``width`` bytes.  They are not removed but told
(``shares_passage``), by the same anchors over words: equal contexts first, then
the windows of anchors that documents without such a context have.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.llm.common import batch_of, map_arrow, staged, table, text_of, utf8

WIDTH, GRAM = 400, 64
#: Words of a passage, and of the grams that are its anchors.
OVER, WORD_GRAM = 51, 16
#: Distinct contexts of an anchor that one task compares.
HOT = 4096
#: Windows a context that one task compares of an anchor with more contexts.
BLOCK = 16
#: Keys of more than one in so many runs, and texts of more than one in so many
#: rows, are joined by broadcast.
OFTEN = 4096
#: Bytes that are hashed at once (a longer text goes alone).
PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)
_VALUES = np.random.RandomState(400).randint(0, 1 << 63, 256, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_TOP = np.uint64(0xFFFFFFFF00000000)
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)
_POWERS: dict[str, np.ndarray] = {}
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and their inverses modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", _BACK)):
            p = np.full(max(n, PIECE), base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.cumprod(p, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


class Hashes:
    """Hashes of any range of a byte string."""

    def __init__(self, raw: bytes):
        self._sum(_VALUES[np.frombuffer(raw, np.uint8)])

    def _sum(self, values: np.ndarray) -> None:
        up, self.down = powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def grams(self, size: int) -> np.ndarray:
        """The hash of the gram at each place."""
        n = len(self.sums) - size
        if n <= 0:
            return np.empty(0, np.uint64)
        return mix((self.sums[size:] - self.sums[:n]) * self.down[:n])


class WordHashes(Hashes):
    """Hashes of any range of the words of some texts, without the texts of fewer
    than ``least`` words: ``at`` names the texts, ``sizes`` their words."""

    def __init__(self, texts: list[bytes], least: int):
        raw = b" ".join(texts)
        blank = np.ones(len(raw) + 2, bool)
        blank[1:-1] = _SPACE[np.frombuffer(raw, np.uint8)]
        edges = np.flatnonzero(blank[1:] != blank[:-1])
        starts, ends = edges[::2], edges[1::2]
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        count = np.diff(np.searchsorted(starts, begins))
        self.at = np.flatnonzero(count >= least)
        self.sizes = count[self.at]
        long_ = np.repeat(count >= least, count)
        self.starts, self.ends = starts[long_], ends[long_]
        self._sum(Hashes(raw).of(self.starts, self.ends))
        base = np.repeat(begins[self.at], self.sizes)
        self.starts, self.ends = self.starts - base, self.ends - base  # bytes in the word's own text


def least_of(x: np.ndarray, w: int) -> np.ndarray:
    """The least of every w consecutive values."""
    done = 1
    while done * 2 <= w:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (w - done)], x[w - done :]) if w > done else x


def runs_of(texts: list[bytes], width: int = WIDTH, gram: int = GRAM):
    """Runs of windows with one anchor over some texts: (text number, anchor
    hash, context hash, first start, last start, anchor's place)."""
    at = [i for i, t in enumerate(texts) if len(t) >= width]
    if not at:
        return (np.empty(0, np.int64),) * 6
    sizes = np.array([len(texts[i]) for i in at], np.int64)
    text, anchor, context, first, last, p = runs_in(Hashes(b"".join(texts[i] for i in at)), sizes, width, gram)
    base = (np.cumsum(sizes) - sizes)[text]
    return np.array(at, np.int64)[text], anchor, context, first - base, last - base, p - base


def runs_in(hashes: Hashes, sizes: np.ndarray, width: int, gram: int):
    """Runs over texts of some sizes that lie one after the other, as ``runs_of``
    gives them, with places counted from the first text's start."""
    ends = np.cumsum(sizes)
    begins = ends - sizes
    h = hashes.grams(gram)
    key = (h & _TOP) | np.arange(len(h), dtype=np.uint64)
    for e in ends[:-1]:  # grams across a border
        key[e - gram + 1 : e] = _LAST
    least = least_of(key, width - gram + 1)
    place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.empty(len(place), bool)
    new[0] = True
    np.not_equal(place[1:], place[:-1], out=new[1:])
    valid = np.ones(len(place), bool)
    for b, e in zip(begins, ends, strict=True):
        valid[max(e - width + 1, 0) : e] = False
        if b < len(new):
            new[b] = True
    new &= valid
    first = np.flatnonzero(new)
    stop = np.append(first[1:], len(place))
    text = np.searchsorted(ends, first, side="right")
    last = np.minimum(stop - 1, ends[text] - width)
    p = place[first]
    anchor = h[p]
    around = hashes.of(first, last + width)
    context = mix(around + (p - first).astype(np.uint64) * np.uint64(_BASE) + (last - first).astype(np.uint64))
    return text, anchor, context, first, last, p


def pieces(raws: list[bytes]):
    """(first number, texts) of about PIECE bytes."""
    lo = size = 0
    for i, t in enumerate(raws):
        if size and size + len(t) > PIECE:
            yield lo, raws[lo:i]
            lo, size = i, 0
        size += len(t)
    yield lo, raws[lo:]


def run_rows(width: int, gram: int):
    def work(batches):
        for batch in batches:
            for lo, some in pieces(batch.column("raw").to_pylist()):
                i, a, c, s, e, p = runs_of(some, width, gram)
                if not len(i):
                    continue
                rows = pa.array(i + lo)
                yield batch_of(
                    doc_id=batch.column("doc_id").take(rows),
                    rid=batch.column("rid").take(rows),
                    a=pa.array(a.view(np.int64)),
                    c=pa.array(c.view(np.int64)),
                    s=pa.array(s.astype(np.int32)),
                    e=pa.array(e.astype(np.int32)),
                    p=pa.array(p.astype(np.int32)),
                )

    return work


def word_run_rows(words: int, gram: int):
    """Runs over words; s and e are bytes, those of the run's whole context."""

    def work(batches):
        for batch in batches:
            for lo, some in pieces(batch.column("raw").to_pylist()):
                hashes = WordHashes(some, words)
                if not len(hashes.at):
                    continue
                i, a, c, s, e, p = runs_in(hashes, hashes.sizes, words, gram)
                rows = pa.array(hashes.at[i] + lo)
                yield batch_of(
                    doc_id=batch.column("doc_id").take(rows),
                    rid=batch.column("rid").take(rows),
                    a=pa.array(a.view(np.int64)),
                    c=pa.array(c.view(np.int64)),
                    s=pa.array(hashes.starts[s].astype(np.int32)),
                    e=pa.array(hashes.ends[e + words - 1].astype(np.int32)),
                    p=pa.array((p - s).astype(np.int32)),
                    first=pa.array(np.diff(i, prepend=-1) > 0),
                )

    return work


def word_windows(words: int):
    """The key of every window of ``words`` words of some contexts."""

    def work(batches):
        for batch in batches:
            hashes = WordHashes(batch.column("ctx").to_pylist(), words)
            n = hashes.sizes - words + 1
            row = np.repeat(np.arange(len(n)), n)
            at = np.arange(n.sum()) + row * (words - 1)
            yield batch_of(
                rid=batch.column("rid").take(pa.array(hashes.at[row])),
                k=pa.array(hashes.of(at, at + words).view(np.int64)),
            )

    return work


def context_rows(width: int):
    """The bytes of the contexts to compare, out of the documents' texts; a text
    that comes again in a task with the same doc_id is passed over."""

    def work(batches):
        seen = set()
        for batch in batches:
            out = {n: [] for n in ("row", "a", "c", "one", "s", "e", "p", "ctx")}
            columns = (batch.column(n).to_pylist() for n in ("doc_id", "rid", "raw", "wanted"))
            for i, (doc_id, rid, raw, wanted) in enumerate(zip(*columns, strict=True)):
                if (doc_id, rid) in seen:
                    continue
                seen.add((doc_id, rid))
                for w in wanted:
                    out["row"].append(i)
                    for n in ("a", "c", "one", "s", "e", "p"):
                        out[n].append(w[n])
                    out["ctx"].append(raw[w["s"] : w["e"] + width])
            rows = pa.array(out["row"], pa.int64())
            yield batch_of(
                doc_id=batch.column("doc_id").take(rows),
                rid=batch.column("rid").take(rows),
                a=pa.array(out["a"], pa.int64()),
                c=pa.array(out["c"], pa.int64()),
                one=pa.array(out["one"], pa.bool_()),
                s=pa.array(out["s"], pa.int32()),
                e=pa.array(out["e"], pa.int32()),
                p=pa.array(out["p"], pa.int32()),
                ctx=pa.array(out["ctx"], pa.binary()),
            )

    return work


def window_keys(a, s, e, p, ctx, width):
    """(row, start, key) of every window of some contexts; equal windows of an
    anchor have equal keys."""
    hashes = Hashes(b"".join(ctx))
    sizes = np.array([len(x) for x in ctx], np.int64)
    base = np.cumsum(sizes) - sizes
    n = (e - s + 1).astype(np.int64)
    row = np.repeat(np.arange(len(n)), n)
    j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = base[row] + j
    start = s[row] + j
    offset = (p[row] - start).astype(np.uint64)
    key = hashes.of(at, at + width) + mix(a.view(np.uint64) + np.uint64(_BASE))[row] + offset * np.uint64(_BACK)
    return row, start, mix(key)


def repeated_windows(width: int):
    """Spans of windows that another context of the anchor holds; rows come
    sorted by anchor."""

    def flush(parts):
        b = pa.Table.from_batches(parts)
        a, s, e, p = (b.column(n).to_numpy() for n in ("a", "s", "e", "p"))
        row, start, key = window_keys(a, s.astype(np.int64), e.astype(np.int64), p.astype(np.int64), b.column("ctx").to_pylist(), width)
        order = np.argsort(key)
        k = key[order]
        same = np.zeros(len(k), bool)
        same[1:] = k[1:] == k[:-1]
        same[:-1] |= same[1:].copy()
        twice = np.zeros(len(k), bool)
        twice[order] = same
        twice &= b.column("one").to_numpy(zero_copy_only=False)[row]
        at = np.flatnonzero(twice)
        cut = np.ones(len(at), bool)
        cut[1:] = (np.diff(at) > 1) | (np.diff(row[at]) > 0)
        first = at[cut]
        last = at[np.append(np.flatnonzero(cut)[1:] - 1, len(at) - 1)] if len(at) else at
        rows = pa.array(row[first])
        return batch_of(
            doc_id=b.column("doc_id").take(rows).combine_chunks(),
            rid=b.column("rid").take(rows).combine_chunks(),
            s=pa.array(start[first].astype(np.int32)),
            e=pa.array((start[last] + width).astype(np.int32)),
        )

    def work(batches):
        parts, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            a = batch.column("a").to_numpy()
            cut = int(np.searchsorted(a, a[-1]))
            if cut and n + cut >= 1024:
                parts.append(batch.slice(0, cut))
                yield flush(parts)
                parts, n = [], 0
                batch = batch.slice(cut)
            elif n >= 1024 and parts[-1].column("a")[-1].as_py() != a[0]:
                yield flush(parts)
                parts, n = [], 0
            parts.append(batch)
            n += batch.num_rows
        if parts:
            yield flush(parts)

    return work


def hot_rows(width: int, limit: int):
    """Blocks of windows of the contexts of anchors with many (``m``) of them: a
    row for each block of windows that lie at neighbouring offsets from the
    anchor (equal windows lie at equal ones), as many as let ``m`` blocks have
    about ``limit`` windows, with the windows' keys."""

    def work(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                b = batch.slice(lo, 256)
                a, s, e, p, m = (b.column(n).to_numpy() for n in ("a", "s", "e", "p", "m"))
                row, start, key = window_keys(a, s.astype(np.int64), e.astype(np.int64), p.astype(np.int64), b.column("ctx").to_pylist(), width)
                wide = np.maximum(1, limit // m)[row]
                # offsets fall by one from window to window, blocks end where offset / wide changes
                block = (p.astype(np.int64)[row] - start) // wide
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (block[1:] != block[:-1])
                first = np.flatnonzero(new)
                rows = pa.array(row[first])
                ends = pa.array(np.append(first, len(row)).astype(np.int32))
                yield batch_of(
                    doc_id=b.column("doc_id").take(rows),
                    rid=b.column("rid").take(rows),
                    a=b.column("a").take(rows),
                    one=b.column("one").take(rows),
                    block=pa.array(block[first]),
                    s=pa.array(start[first].astype(np.int32)),
                    k=pa.ListArray.from_arrays(ends, pa.array(key.view(np.int64))),
                )

    return work


def repeated_keys(width: int):
    """Spans of the windows whose key comes twice in a block; rows come sorted by
    anchor and block."""

    def flush(parts):
        b = pa.Table.from_batches(parts).combine_chunks()
        lists = b.column("k").combine_chunks()
        n = lists.value_lengths().to_numpy()
        key = lists.flatten().to_numpy()
        row = np.repeat(np.arange(len(n)), n)
        start = b.column("s").to_numpy()[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        _, back, count = np.unique(key, return_inverse=True, return_counts=True)
        at = np.flatnonzero((count[back] > 1) & b.column("one").to_numpy(zero_copy_only=False)[row])
        cut = np.ones(len(at), bool)
        cut[1:] = (np.diff(at) > 1) | (np.diff(row[at]) > 0)
        first = at[cut]
        last = at[np.append(np.flatnonzero(cut)[1:] - 1, len(at) - 1)] if len(at) else at
        rows = pa.array(row[first])
        return batch_of(
            doc_id=b.column("doc_id").take(rows).combine_chunks(),
            rid=b.column("rid").take(rows).combine_chunks(),
            s=pa.array(start[first].astype(np.int32)),
            e=pa.array((start[last] + width).astype(np.int32)),
        )

    def work(batches):
        parts: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            a, block = batch.column("a").to_numpy(), batch.column("block").to_numpy()
            new = np.flatnonzero((a[1:] != a[:-1]) | (block[1:] != block[:-1])) + 1
            if parts and (parts[-1].column("a")[-1].as_py(), parts[-1].column("block")[-1].as_py()) != (a[0], block[0]):
                yield flush(parts)
                parts = []
            if len(new):
                parts.append(batch.slice(0, new[-1]))
                yield flush(parts)
                parts, batch = [], batch.slice(new[-1])
            parts.append(batch)
        if parts:
            yield flush(parts)

    return work


def united(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def cut_texts(batches):
    for batch in batches:
        rows = []
        for raw, spans in zip(batch.column("raw").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            runs = united([tuple(x.values()) for x in spans or ()])
            kept, at = [], 0
            for s, e in runs:
                kept.append(raw[at:s])
                at = e
            kept = b"".join([*kept, raw[at:]])
            rows.append((len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
        yield batch_of(
            doc_id=batch.column("doc_id"),
            n_bytes=pa.array(cols[0], pa.int64()),
            n_removed=pa.array(cols[1], pa.int64()),
            n_spans=pa.array(cols[2], pa.int64()),
            kept_sha256=pa.array(cols[3], pa.string()),
            shares_passage=batch.column("shares"),
            kept=pa.array(cols[4], pa.binary()),
        )


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], count: str, total: int, share: int) -> DataFrame:
    """Inner join to ``right``, which has one row a key and in ``count`` how many
    of the ``total`` rows of ``left`` have that key.  Keys of more than 1/share
    of the rows are fewer than ``share``: they are broadcast, so that their rows
    stay where they are; all others are joined by a shuffle."""
    often = right.where(F.col(count) * F.lit(share) > F.lit(total))
    rest = right.where(F.col(count) * F.lit(share) <= F.lit(total))
    near = left.join(F.broadcast(often), keys)
    far = left.join(F.broadcast(often.select(*keys)), keys, "left_anti").join(rest, keys)
    return near.unionByName(far)


def contexts_to_compare(docs: DataFrame, counts: DataFrame, often: DataFrame, width: int) -> DataFrame:
    """One row per (anchor, distinct context) with the context's bytes.

    ``counts`` names the row (text's hash, place, doc_id) that stands for a
    context.  Other rows with that doc_id and text fit as well; of a text that
    the table has ``often`` the rows stay where they are and one is picked after
    the bytes are cut out, of any other text they meet in one task, which takes
    the first."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    wanted = (
        counts.select(
            F.col("least.rid").alias("_r"),
            F.col("least.doc_id").alias("_d"),
            F.struct("a", "c", (F.col("n") == 1).alias("one"), "least.s", "least.e", "least.p").alias("w"),
        )
        .groupBy("_r", "_d")
        .agg(F.collect_list("w").alias("wanted"))
    )
    same = (F.col("rid") == F.col("_r")) & F.col("doc_id").eqNullSafe(F.col("_d"))
    columns = f"doc_id {kind}, rid long, a long, c long, one boolean, s int, e int, p int, ctx binary"

    def cut(joined: DataFrame) -> DataFrame:
        return map_arrow(joined.select("doc_id", "rid", "raw", "wanted"), context_rows(width), columns)

    hot = wanted.join(F.broadcast(often.withColumnRenamed("rid", "_r")), "_r", "left_semi")
    near = cut(docs.join(F.broadcast(hot), same)).dropDuplicates(["a", "c"])
    rest = wanted.join(F.broadcast(often.withColumnRenamed("rid", "_r")), "_r", "left_anti")
    return cut(docs.join(F.broadcast(often), "rid", "left_anti").join(rest, same)).unionByName(near)


def repeated_spans(
    docs: DataFrame, width: int = WIDTH, gram: int = GRAM, hot: int = HOT, share: int = OFTEN
) -> tuple[DataFrame, DataFrame]:
    """(doc_id, rid, s, e): byte spans that repeated windows cover, of all texts
    but those that more than 1/share of the table's rows have; and those texts
    (rid), fewer than ``share``: each is its own copy and goes whole.  ``docs``
    has doc_id, rid and raw."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    ids = f"doc_id {kind}, rid long"
    long_docs = docs.where(F.octet_length("raw") >= width)
    runs = staged(map_arrow(long_docs, run_rows(width, gram), f"{ids}, a long, c long, s int, e int, p int"), "runs")
    total = runs.count()
    # every text has one run that begins at 0
    copies = runs.where("s = 0").groupBy("rid").agg(F.count(F.lit(1)).alias("k"))
    rows = runs.where("s = 0").count()
    often = staged(copies.where((F.col("k") > 1) & (F.col("k") * F.lit(share) > F.lit(rows))).select("rid"), "often")
    twice = staged(
        runs.groupBy("a")
        .agg(F.count(F.lit(1)).alias("t"), F.min("c").alias("c0"), F.max("c").alias("c1"))
        .where("t > 1")
        .select("a", "t", (F.col("c0") == F.col("c1")).alias("pure")),
        "twice",
    )
    known = staged(join_counted(runs, twice, ["a"], "t", total, share).drop("t"), "known")
    mixed = known.where(~F.col("pure"))
    counts = staged(
        mixed.groupBy("a", "c").agg(
            F.count(F.lit(1)).alias("n"), F.min(F.struct("rid", "s", "e", "p", "doc_id")).alias("least")
        ),
        "counts",
    )
    full = (F.col("e") + F.lit(width)).cast("int").alias("e")
    spans = known.where("pure").select("doc_id", "rid", "s", full)
    whole = join_counted(mixed, counts.where("n > 1").drop("least"), ["a", "c"], "n", total, share)
    spans = spans.unionByName(whole.select("doc_id", "rid", "s", full))
    contexts = contexts_to_compare(long_docs, counts, often, width)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many = counts.groupBy("a").agg(F.count(F.lit(1)).alias("m"))
    hot_anchors = staged(many.where(F.col("m") > hot), "hot")
    few = contexts
    if not hot_anchors.isEmpty():
        contexts = staged(contexts, "contexts")
        few = contexts.join(hot_anchors, "a", "left_anti").select(contexts.columns)
        blocks = staged(
            map_arrow(
                contexts.join(hot_anchors, "a").select(*contexts.columns, "m"),
                hot_rows(width, hot * BLOCK),
                f"{ids}, a long, one boolean, block long, s int, k array<long>",
            ),
            "blocks",
        )
        # too many for a task even if a block is one window: the windows are counted
        most = hot_anchors.where(F.col("m") > hot * BLOCK).select("a")
        by_block = blocks.join(most, "a", "left_anti").select(blocks.columns).repartition(n, "a", "block")
        spans = spans.unionByName(
            map_arrow(by_block.sortWithinPartitions("a", "block"), repeated_keys(width), f"{ids}, s int, e int")
        )
        if not most.isEmpty():
            windows = blocks.join(most, "a", "left_semi").withColumn("k", F.col("k")[0])
            same = windows.groupBy("a", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
            spans = spans.unionByName(
                windows.where("one")
                .join(same, ["a", "k"], "left_semi")
                .select("doc_id", "rid", "s", (F.col("s") + F.lit(width)).cast("int").alias("e"))
            )
    dealt = few.repartition(n, "a").sortWithinPartitions("a")
    spans = spans.unionByName(map_arrow(dealt, repeated_windows(width), f"{ids}, s int, e int"))
    return spans.join(F.broadcast(often), "rid", "left_anti").select("doc_id", "rid", "s", "e"), often


def shared_passages(docs: DataFrame, words: int = OVER, gram: int = WORD_GRAM, share: int = OFTEN) -> DataFrame:
    """(doc_id, rid) of the rows that hold ``words`` consecutive words that
    another row holds too.  ``docs`` has doc_id, rid and raw."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = f"doc_id {kind}, rid long, a long, c long, s int, e int, p int, first boolean"
    long_docs = docs.where(F.octet_length("raw") >= 2 * words - 1)
    runs = staged(map_arrow(long_docs, word_run_rows(words, gram), columns), "word-runs")
    total = runs.count()
    texts = runs.where("first").select("doc_id", "rid")  # every row has one
    rows = texts.count()
    copies = staged(texts.groupBy("rid").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "word-copies")
    often = copies.where(F.col("k") * F.lit(share) > F.lit(rows)).select("rid")
    several = (F.count(F.lit(1)).alias("n"), F.min("rid").alias("r0"), F.max("rid").alias("r1"))
    twice = staged(runs.groupBy("a").agg(*several).where("r0 <> r1").select("a", "n"), "word-twice")
    known = staged(join_counted(runs.drop("first"), twice, ["a"], "n", total, share).drop("n"), "word-known")
    counts = staged(
        known.groupBy("a", "c").agg(*several, F.min(F.struct("rid", "s", "e", "p", "doc_id")).alias("least")),
        "word-counts",
    )
    alike = counts.where("r0 <> r1").select("a", "c", "n")
    found = join_counted(known, alike, ["a", "c"], "n", total, share).select("rid")
    found = staged(found.unionByName(copies.select("rid")).distinct(), "word-found")
    # texts that share no whole context: their anchors' windows are compared
    asking = counts.where("r0 = r1").join(found.withColumnRenamed("rid", "r0"), "r0", "left_anti").select("a").distinct()
    contexts = contexts_to_compare(long_docs, counts.join(asking, "a", "left_semi"), often, 0)
    # staged, so that no task has two Python workers at once (idle ones keep their memory)
    contexts = staged(contexts.select("rid", "ctx"), "word-contexts")
    windows = staged(
        map_arrow(contexts, word_windows(words), "rid long, k long").distinct(), "word-windows"
    )
    same = staged(windows.groupBy("k").agg(*several).where("r0 <> r1").select("k", "n"), "word-same")
    more = join_counted(windows, same, ["k"], "n", windows.count(), share).select("rid").distinct()
    alone = found.unionByName(more).distinct().join(copies, "rid", "left_anti")
    return join_counted(texts, copies, ["rid"], "k", rows, share).select("doc_id", "rid").unionByName(
        texts.join(alone, "rid", "left_semi").select("doc_id", "rid")
    )


def exact_substring_dedup(
    docs: DataFrame, width: int = WIDTH, gram: int = GRAM, hot: int = HOT, share: int = OFTEN
) -> DataFrame:
    """What is kept of every document, with counts and its hash; ``shares_passage``
    is 1 if the document holds ``OVER`` words that another row holds too, else 0."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64(text_of()).alias("rid"), utf8().alias("raw"))
    shared = staged(shared_passages(rows, share=share), "shared")
    spans, often = repeated_spans(rows, width, gram, hot, share)
    none = F.lit(None).cast("struct<s: int, e: int>")
    by_doc = (
        spans.select("doc_id", "rid", F.struct("s", "e").alias("x"), F.lit(0).alias("shares"))
        .unionByName(shared.select("doc_id", "rid", none.alias("x"), F.lit(1).alias("shares")))
        .groupBy("doc_id", "rid")
        .agg(F.collect_set("x").alias("spans"), F.max("shares").alias("shares"))
        .withColumnsRenamed({"doc_id": "_d", "rid": "_r"})
    )
    # texts too short for either and texts that very many rows share stay where they are
    least = min(width, 2 * OVER - 1)
    short, long_ = rows.where(F.octet_length("raw") < least), rows.where(F.octet_length("raw") >= least)
    whole = F.array(F.struct(F.lit(0).alias("s"), F.octet_length("raw").alias("e")))
    whole_shares = often.join(shared.select("rid").distinct(), "rid", "left_semi").withColumn("shares", F.lit(1))
    whole_shares = often.join(F.broadcast(whole_shares), "rid", "left")
    joined = long_.join(F.broadcast(often), "rid", "left_anti").join(
        by_doc, (F.col("rid") == F.col("_r")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left"
    )
    every = (
        joined.select("doc_id", "raw", "spans", "shares")
        .unionByName(
            short.select("doc_id", "raw", F.lit(None).cast("array<struct<s: int, e: int>>").alias("spans"), F.lit(0).alias("shares"))
        )
        .unionByName(
            long_.join(F.broadcast(whole_shares), "rid").select("doc_id", "raw", whole.alias("spans"), "shares")
        )
    )
    return map_arrow(
        every.withColumn("shares", F.coalesce("shares", F.lit(0)).cast("long")),
        cut_texts,
        f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, shares_passage long, kept binary",
    )


def op4_exact_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_substring_dedup(table(spark, sf_dir, "documents")).drop("kept")
