"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints are 64 bits from the XXH64 (seed 42) of 3-word shingles; a bit is 1
if more than half of the shingles' hashes have it.  Two fingerprints link at
``radius`` or fewer differing bits.

Candidates: with radius 3, two linked fingerprints agree on one of four 16-bit
blocks and, of the other 48 bits, on one of four 12-bit blocks; the 16 keys of
28 bits lose no link.  Only distinct fingerprints are compared (copies never
meet each other), within a key's bucket, bit-sliced: differences are stored as
bit planes, carry-save counters add a plane to all pairs at once, and a block of
pairs is abandoned as soon as every counter is past the radius.  A bucket passes
on a spanning forest of its links, never all pairs.  A bucket of more than
``CELL`` fingerprints is dealt out as pairs of its blocks to many tasks.

Components come from large-star/small-star rounds over DataFrames, each cut by a
table in the shared folder.  Texts without words (null, empty) have fingerprint
zero and link like any other.  A component is named by its smallest doc_id, null
ids not counted (null if there is no other).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from quirework.llm.common import batch_of, map_arrow, staged, table, utf8

SEED, SHINGLE, RADIUS = 42, 3, 3
#: Fingerprints of a bucket that one task compares.
CELL = 50_000
#: Parts into which the rows of one fingerprint are dealt.
SALTS = 256
#: Pairs of a block.
BLOCK = 1 << 16
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(raw: bytes, size: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit SimHash of a UTF-8 text."""
    ws = raw.translate(_LOWER).split()
    if not ws:
        return 0
    if len(ws) <= size:
        return xxh64_intdigest(b" ".join(ws), seed)
    line = b" ".join(ws)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1)
    starts = [0, *ends[: len(ws) - size].tolist()]
    h = np.array(
        [xxh64_intdigest(line[a:b], seed) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)],
        "<u8",
    )
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(h), 8192):
        ones += np.unpackbits(h[lo : lo + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
            axis=0, dtype=np.int64
        )
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def near(planes: Iterator[np.ndarray], radius: int) -> np.ndarray | None:
    """Lanes whose set bits over all planes number at most ``radius`` (<= 3).

    Two counter planes hold each lane's count, a third one that it has passed
    three: carry-save additions for all lanes at once.  None when the block was
    abandoned because every lane is past the radius."""
    low = high = over = None
    for j, x in enumerate(planes):
        if low is None:
            low, high, over = x.copy(), np.zeros_like(x), np.zeros_like(x)
            continue
        carry = low & x
        low ^= x
        spill = high & carry
        high ^= carry
        over |= spill
        if j % 8 == 7 and (_past(low, high, over, radius) == 0xFF).all():
            return None
    return ~_past(low, high, over, radius)


def _past(low, high, over, radius: int) -> np.ndarray:
    """Lanes whose count is above the radius, as all-ones bits."""
    return over | {0: low | high, 1: high, 2: low & high, 3: np.zeros_like(low)}[radius]


def planes_of(x: np.ndarray) -> np.ndarray:
    """64 bit planes of the numbers, eight lanes a byte."""
    bits = np.unpackbits(x.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(bits.T, axis=1, bitorder="little")


def near_pairs(a: np.ndarray, b: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Positions at which a and b differ in at most ``radius`` bits."""
    out = []
    for lo in range(0, len(a), BLOCK):
        x = a[lo : lo + BLOCK] ^ b[lo : lo + BLOCK]
        got = near(iter(planes_of(x)), radius)
        if got is not None:
            out.append(np.flatnonzero(np.unpackbits(got, bitorder="little")[: len(x)]) + lo)
    return np.concatenate(out) if out else np.empty(0, np.int64)


def near_rows(queries: np.ndarray, planes: np.ndarray, n: int, radius: int = RADIUS):
    """(query, lane) pairs between some queries and a block's stored planes."""
    masks = np.where(
        np.unpackbits(queries.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), 0xFF, 0
    ).astype(np.uint8)
    got = near((planes[j][None, :] ^ masks[:, j][:, None] for j in range(64)), radius)
    if got is None:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    rows, bytes_ = np.nonzero(got)
    bits = np.unpackbits(got[rows, bytes_][:, None], axis=1, bitorder="little")
    at, lane = np.nonzero(bits)
    lanes = bytes_[at] * 8 + lane
    ok = lanes < n
    return rows[at][ok], lanes[ok]


class Forest:
    """Union-find that tells which links are new."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (p := up.setdefault(x, x)) != x:
            up[x] = x = up[p]
        return x

    def link(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def compare(fps: np.ndarray, forest: Forest, radius: int = RADIUS) -> list[tuple[int, int]]:
    """A spanning forest of the links among the distinct fingerprints."""
    out, n = [], len(fps)
    planes = planes_of(fps)
    step = max(1, BLOCK * 8 // max(n, 1))
    for lo in range(0, n, step):
        from_byte = lo // 8  # lanes before the first query were compared already
        i, j = near_rows(fps[lo : lo + step], planes[:, from_byte:], n - from_byte * 8, radius)
        i, j = i + lo, j + from_byte * 8
        for x, y in zip(fps[i[i < j]].tolist(), fps[j[i < j]].tolist(), strict=True):
            if forest.link(x, y):
                out.append((x, y))
    return out


def compare_buckets(radius: int):
    """The worker's function: rows sorted by key in, links out."""

    def flush(key, fp, forest):
        """Links of whole buckets in rows sorted by key."""
        cuts = np.flatnonzero(np.diff(key)) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(key)]])
        size = ends - starts
        links = []
        left, right = [], []
        for m in np.unique(size[(size > 1) & (size <= 64)]):
            base = starts[size == m]
            i, j = np.triu_indices(m, 1)
            left.append((base[:, None] + i).ravel())
            right.append((base[:, None] + j).ravel())
        if left:
            a, b = fp[np.concatenate(left)], fp[np.concatenate(right)]
            at = near_pairs(a, b, radius)
            links += [(x, y) for x, y in zip(a[at].tolist(), b[at].tolist(), strict=True) if forest.link(x, y)]
        for s, e in zip(starts[size > 64], ends[size > 64], strict=True):
            links += compare(fp[s:e], forest, radius)
        return links

    def work(batches):
        forest, keys, fps = Forest(), [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("key").to_numpy()
            keys.append(key)
            fps.append(batch.column("fp").to_numpy().view(np.uint64))
            if keys[0][0] == key[-1]:  # one bucket so far
                continue
            k, f = np.concatenate(keys), np.concatenate(fps)
            done = np.searchsorted(k, k[-1])
            yield _pairs(flush(k[:done], f[:done], forest))
            keys, fps = [k[done:]], [f[done:]]
            if len(forest.up) > 1_000_000:
                forest = Forest()
        if keys:
            yield _pairs(flush(np.concatenate(keys), np.concatenate(fps), forest))

    return work


def _pairs(links) -> pa.RecordBatch:
    ab = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
    return batch_of(a=pa.array(ab[:, 0].copy(), pa.int64()), b=pa.array(ab[:, 1].copy(), pa.int64()))


def keys_of(fp):
    """The 16 keys of a fingerprint: a 16-bit block, then a 12-bit block of the rest."""
    out = []
    for i in range(4):
        block = F.shiftrightunsigned(fp, 16 * i).bitwiseAND(0xFFFF)
        low = fp.bitwiseAND((1 << (16 * i)) - 1) if i else F.lit(0).cast("long")
        high = F.shiftleft(F.shiftrightunsigned(fp, 16 * (i + 1)), 16 * i) if i < 3 else F.lit(0).cast("long")
        rest = low.bitwiseOR(high)
        for j in range(4):
            part = F.shiftrightunsigned(rest, 12 * j).bitwiseAND(0xFFF)
            out.append(F.lit((4 * i + j) << 28).cast("long") + F.shiftleft(block, 12) + part)
    return F.array(*out)


def links(prints: DataFrame, radius: int = RADIUS, cell: int = CELL) -> DataFrame:
    """Links (a, b) that connect what lies within the radius; ``prints``: the
    distinct fingerprints as signed longs in column fp."""
    if radius > 3:
        raise ValueError("the keys hold for at most three differing bits")
    keyed = prints.select("fp", F.explode(keys_of(F.col("fp"))).alias("key"))
    counts = staged(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell), "hot")
    plain = keyed
    if not counts.isEmpty():
        hot = keyed.join(counts, "key").withColumn("m", F.ceil(F.col("n") / cell).cast("int"))
        hot = hot.withColumn("mine", F.pmod(F.xxhash64("fp", "key"), F.col("m")).cast("int"))
        cells = hot.select(
            F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("other"), "fp", "key", "mine"
        ).select(
            "fp",
            F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("key"),
        )
        plain = keyed.join(counts, "key", "left_anti").select("fp", F.xxhash64("key").alias("key")).unionByName(cells)
    n = prints.sparkSession.conf.get("spark.sql.shuffle.partitions")
    dealt = plain.select("key", "fp").repartition(int(n), "key").sortWithinPartitions("key", "fp")
    return map_arrow(dealt, compare_buckets(radius), "a long, b long")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node with an edge; the root is the smallest node."""
    now = staged(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    sign = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = staged(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == sign:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        sign = new
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def printer(batches):
    for batch in batches:
        fp = np.array([fingerprint(t) for t in batch.column("raw").to_pylist()], np.uint64)
        yield batch_of(
            doc_id=batch.column("doc_id"),
            fp=pa.array(fp.view(np.int64), pa.int64()),
            **{n: batch.column(n) for n in batch.schema.names if n not in ("doc_id", "raw")},
        )


def printed(docs: DataFrame, keep: tuple = ()) -> DataFrame:
    """doc_id, fp and the columns ``keep`` of every row, with the part it is dealt to."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    prints = map_arrow(
        docs.select("doc_id", utf8().alias("raw"), *keep),
        printer,
        f"doc_id {kinds['doc_id']}, fp long" + "".join(f", {c} {kinds[c]}" for c in keep),
    )
    return staged(prints, "prints").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))


def rooted(prints: DataFrame, least: Column) -> DataFrame:
    """fp, its parts, the root of its component and its minimum of ``least``."""
    # copies count once per part first, so no task meets all rows of a fingerprint
    parts = prints.groupBy("fp", "salt").agg(F.min(least).alias("least"))
    distinct = parts.groupBy("fp").agg(F.min("least").alias("least"), F.collect_list("salt").alias("salts"))
    roots = components(links(distinct.select("fp")))
    return distinct.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", "salts", F.coalesce("root", "fp").alias("root")
    )


def simhash_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fp (signed) and component_id of every row."""
    prints = printed(docs)
    nodes = rooted(prints, F.col("doc_id"))
    names = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = nodes.join(names, "root").select("fp", F.explode("salts").alias("salt"), "component_id")
    return prints.join(named, ["fp", "salt"]).select("doc_id", "fp", "component_id")


def simhash_keepers(docs: DataFrame, row: tuple) -> DataFrame:
    """The columns ``row``, which tell rows apart, of one row of each component:
    the one with the smallest doc_id, null ids last, then the smallest ``row``."""
    prints = printed(docs, row)
    nodes = rooted(prints, F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", *row))
    return nodes.groupBy("root").agg(F.min("least").alias("least")).select(*(f"least.{c}" for c in row))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
