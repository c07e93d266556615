"""Best-fit packing of token sequences by bin completion.

Documents become token ids plus an end id; one longer than the sequence is cut
into full pieces, the first piece taking the rest.  Packing needs only the
*histogram* of piece lengths (at most ``size`` counts, whatever the corpus), so
the driver packs the histogram.  Best-fit decreasing is the first incumbent; where
it needs more sequences than the lower bound, bin completion looks for fewer: for
the largest length left it branches over the undominated fillings of its gap and
gives up a branch whose waste is past what the wanted number of sequences leaves.
A filling is applied as often as its counts allow (or once), so steps do not grow
with the corpus.  A pass looks at ``NODES`` fillings at most; a packing above the
bound is therefore not proved to be the least.

The result is a table of slots (length, ranks, sequences, offset).  Pieces get
their rank among equals by (length, salt) windows and running sums, so no task
holds a length's pieces as a whole.  Null texts are empty: one piece with the
end id.  Repeated rows are packed each; other columns are ignored.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirework.llm.common import batch_of, map_arrow, staged, table, text_of

TOKENIZER, SIZE, END = "byte_bpe_50k.json", 1024, 2
#: Pieces of a (length, salt) window, about.
WINDOW_ROWS = 200_000
#: Fillings that a pass of the search looks at; then the incumbent stands.
NODES = 2000
#: Waste of a sequence, in parts of the mean left, whose fillings a pass tries first.
SHARES = (4.0, 0.0, 0.5, 1.0, 2.0, 8.0, 16.0)
#: Pre-tokens that a task keeps, about; longer ones are not kept.
CACHE = 800_000
LONG = 64
#: Pre-tokens that are encoded as one text.
JOINED = 64
#: Bytes of text whose distinct chunks are looked up together, about.
GROUP = 4 << 20
#: Marks that begin a chunk after a letter or number (no apostrophe: it may join letters).
MARKS = ".,;:!?%&$#*|<>()-"
#: What a byte is to the cuts: a blank, a line feed, a mark, a letter or number, the
#: first byte of a Latin-1 letter (all but two of its second bytes are letters).
BLANK, FEED, MARK, WORD, LATIN = 1, 2, 3, 4, 5
KINDS = bytes(
    BLANK if c == 32
    else FEED if c == 10
    else LATIN if c == 0xC3
    else MARK if chr(c) in MARKS
    else WORD if c < 128 and chr(c).isalnum()
    else 0
    for c in range(256)
)
_LOADED: dict[str, tuple] = {}


def load(path: str):
    if path not in _LOADED:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = False  # the library's default: special strings are special
        # not plain: two blanks or line feeds together, one at an end, other white space, a special string
        space = "".join(f"\\x{{{c:x}}}" for c in range(0x3001) if chr(c).isspace() and c not in (10, 32))
        special = [re.escape(x.content) for x in t.get_added_tokens_decoder().values()]
        uneven = "|".join([rf"\A[ \n]|[ \n]\z|[ \n][ \n]|[{space}]", *special])
        _LOADED[path] = (t, [{}, {}], uneven, t.encode("\n", add_special_tokens=False).ids)
    return _LOADED[path]


def _raw(ids) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def pieces_of(parts: list[str], t, feed: int) -> list[bytes]:
    """The ids of each of some pre-tokens.

    They hold no line feed, so they are encoded in one text with line feeds
    between them and the ids are cut where the line feed's id stands; should the
    number of cuts differ, each is encoded alone."""
    out: list[bytes] = []
    lines = [parts[i : i + JOINED] for i in range(0, len(parts), JOINED)]
    for some, e in zip(lines, t.encode_batch_fast(["\n".join(x) for x in lines], add_special_tokens=False), strict=True):
        ids = np.array(e.ids, "<u4")
        at = [-1, *np.flatnonzero(ids == feed).tolist(), len(ids)]
        if len(at) != len(some) + 1:
            out += [_raw(t.encode(p, add_special_tokens=False).ids) for p in some]
            continue
        raw = ids.tobytes()
        out += [raw[4 * x + 4 : 4 * y] for x, y in zip(at, at[1:])]
    return out


def chunks_of(texts: pa.StringArray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The chunks of plain texts one after the other, and at which chunk each text
    begins (and the last one ends).

    A chunk begins at every blank, at and after every line feed, and at a mark
    after a letter or number: there a pre-token begins, whatever stands around."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    low, high = int(offsets[0]), int(offsets[-1])
    data = texts.buffers()[2].slice(low, high - low) if high > low else pa.py_buffer(b"")
    raw, starts = data.to_pybytes(), offsets - low
    kind = np.frombuffer(raw.translate(KINDS), np.uint8)
    begins = np.zeros(len(raw) + 1, bool)
    feed, mark = kind == FEED, kind == MARK
    begins[:-1] = (kind == BLANK) | feed
    begins[1:] |= feed
    begins[1:-1] |= mark[1:] & (kind[:-1] == WORD)
    at = np.flatnonzero(mark[2:] & (kind[:-2] == LATIN))
    second = np.frombuffer(raw, np.uint8)[at + 1]
    begins[at[(second != 0x97) & (second != 0xB7)] + 2] = True
    begins[starts] = True
    cuts = np.flatnonzero(begins).astype(np.int32)
    chunks = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), data)
    return chunks.dictionary_encode(), np.searchsorted(cuts, starts)


def encoded(texts: pa.StringArray, path: str) -> list[memoryview | bytes]:
    """Each text's ids as little-endian 32-bit numbers.

    Plain texts are words parted by single blanks or line feeds: their distinct
    chunks are encoded once each and the ids put together by Arrow.  Any other
    text is encoded whole.  The cache has two generations: when the young
    one is full it becomes the old one, whose chunks are taken over when they are
    met again."""
    t, caches, uneven, line_feed = load(path)
    if not len(texts):
        return []
    texts = texts.cast(pa.string())
    if len(caches[0]) > CACHE // 2:
        caches[:] = [{}, caches[0]]
    young, old = caches
    young["\n"] = _raw(line_feed)
    odd = pc.match_substring_regex(texts, uneven)
    whole = pc.indices_nonzero(odd).to_pylist()
    chunks, first = chunks_of(pc.if_else(odd, "", texts) if whole else texts)
    words = chunks.dictionary.to_pylist()
    raw = list(map(young.get, words))
    new = []
    for i in [i for i, x in enumerate(raw) if x is None]:
        found = old.get(words[i])
        if found is None:
            new.append(i)
        else:
            raw[i] = young[words[i]] = found
    for lo in range(0, len(new), 20_000):
        some = new[lo : lo + 20_000]
        for i, x in zip(some, pieces_of([words[i] for i in some], t, line_feed[0]), strict=True):
            raw[i] = x
            if len(words[i]) <= LONG:
                young[words[i]] = x
    ids = pa.array(raw, pa.large_binary()).take(chunks.indices)
    ends = np.frombuffer(ids.buffers()[1], np.int64)[first].tolist()
    view = memoryview(ids.buffers()[2] or b"")
    out: list[memoryview | bytes] = [view[a:b] for a, b in zip(ends, ends[1:])]
    for i in whole:
        out[i] = _raw(t.encode(texts[i].as_py(), add_special_tokens=False).ids)
    return out


def encode(texts: list[str], path: str) -> list[bytes]:
    """``encoded`` for a list."""
    return [bytes(x) for x in encoded(pa.array(texts, pa.string()), path)]


def grouped(batches):
    """Batches put together up to about ``GROUP`` bytes."""

    def whole(some):
        return batch_of(**{c: pa.concat_arrays([b.column(c) for b in some]) for c in ("doc_id", "text")})

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= GROUP:
            group, held = whole(held), []
            yield group
    if held:
        yield whole(held)


def cutter(path: str, size: int, end: int):
    """The worker's function: a row for each piece of a document."""

    def work(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tail = _raw([end])
        try:
            for batch in grouped(batches):
                at, piece, start, length, crc = [], [], [], [], []
                for i, ids in enumerate(encoded(batch.column("text"), path)):
                    n = len(ids) // 4 + 1  # and the end id
                    s, k = 0, 0
                    e = n % size or min(size, n)
                    while s < n:
                        at.append(i)
                        piece.append(k)
                        start.append(s)
                        length.append(e - s)
                        here = zlib.crc32(ids[4 * s : 4 * e])
                        crc.append(here if e < n else zlib.crc32(tail, here))
                        s, e, k = e, e + size, k + 1
                yield batch_of(
                    doc_id=batch.column("doc_id").take(pa.array(at, pa.int64())),
                    piece=pa.array(piece, pa.int32()),
                    start=pa.array(start, pa.int64()),
                    length=pa.array(length, pa.int64()),
                    ids_crc32=pa.array(crc, pa.int64()),
                )
        finally:  # the worker stays for other tasks and operators, its cache does not
            load(path)[1][:] = [{}, {}]
            pa.default_memory_pool().release_unused()

    return work


def best_fit_decreasing(counts: dict[int, int], size: int) -> list[tuple[list[int], int]]:
    """(lengths, times): best-fit decreasing, sequences that are alike at once.

    They are kept by gap; of each length and group only one sequence can get
    fewer pieces than fit, so the groups do not grow with the corpus."""
    gaps: dict[int, dict[tuple[int, ...], int]] = {}
    for s in sorted((s for s, n in counts.items() if n), reverse=True):
        n = counts[s]
        while n:
            gap = next((g for g in range(s, size) if gaps.get(g)), size)
            fill, there = next(iter(gaps[gap].items())) if gap < size else ((), n)
            k = min(n, gap // s)
            times = min(there, n // k)
            if fill:
                gaps[gap][fill] -= times
                if not gaps[gap][fill]:
                    del gaps[gap][fill]
            group = gaps.setdefault(gap - k * s, {})
            group[(*fill, *[s] * k)] = group.get((*fill, *[s] * k), 0) + times
            n -= k * times
    return [(list(fill), times) for group in gaps.values() for fill, times in group.items()]


def least_sequences(counts: dict[int, int], size: int) -> int:
    """A lower bound (Martello and Toth): for each k, lengths above size - k
    stand alone, and those below k are left out."""
    n = np.zeros(size + 1, np.int64)
    for s, c in counts.items():
        n[s] = c
    tokens, half = n * np.arange(size + 1), size // 2
    out = 0
    for k in range(half + 1):
        alone, large = int(n[size - k + 1 :].sum()), int(n[half + 1 : size - k + 1].sum())
        over = int(tokens[k : half + 1].sum()) - (large * size - int(tokens[half + 1 : size - k + 1].sum()))
        out = max(out, alone + large + max(0, -(-over // size)))
    return out


def fillings(left: list[int], gap: int, over: int, slack: int):
    """The fillings of ``gap`` that waste more than ``over`` and at most
    ``slack``, those with the largest lengths first, None for a dominated one;
    ``left`` counts the free lengths.

    A filling is dominated if one of its lengths, or two together, can give way
    to a free length that is larger, or as large as the two."""
    sizes = [s for s in range(gap, 0, -1) if left[s]]
    mask = (1 << (gap + 1)) - 1
    free = sum(1 << s for s in sizes)
    reach = [1] * (len(sizes) + 1)  # the sums of each length and all smaller ones
    for i in range(len(sizes) - 1, -1, -1):
        r, c, k = reach[i + 1], min(left[sizes[i]], gap // sizes[i]), 1
        while c > 0:
            r |= r << (min(k, c) * sizes[i]) & mask
            c, k = c - k, 2 * k
        reach[i] = r

    def dominated(taken: list[int], waste: int) -> bool:
        spare = free
        for s in set(taken):
            if taken.count(s) == left[s]:
                spare &= ~(1 << s)
        if spare & ((1 << (waste + 1)) - 1):  # a free length fits beside them
            return True
        for x in set(taken):
            if spare >> (x + 1) & ((1 << waste) - 1):
                return True
        return any(
            spare >> (x + y) & ((1 << (waste + 1)) - 1) for i, x in enumerate(taken) for y in taken[i + 1 :]
        )

    def walk(i: int, room: int, taken: list[int]):
        for j in range(i, len(sizes)):
            low = max(0, room - slack)
            if not reach[j] >> low & ((1 << max(0, room - over - low)) - 1):
                return
            s = sizes[j]
            for k in range(min(left[s], room // s), 0, -1):
                yield from walk(j + 1, room - k * s, taken + [s] * k)
        if over < room <= slack:
            yield None if dominated(taken, room) else taken

    yield from walk(0, gap, [])


def complete(counts: dict[int, int], size: int, most: int, share: float, nodes: int):
    """A packing of at most ``most`` sequences, None if the nodes don't find one.

    Branches over the fillings of the largest length left while the waste of all
    sequences stays within the bound; those that waste at most ``share`` times
    the mean that is left come first, then those that waste twice as much."""
    left = [counts.get(s, 0) for s in range(size + 1)]
    waste = most * size - sum(s * n for s, n in counts.items())
    open_, used, largest = most, 0, size

    def children(s: int, waste: int, open_: int):
        nonlocal used
        free, gap = list(left), size - s
        free[s] -= 1
        most, over = min(waste, gap), -1
        slack = min(most, int(share * waste / max(1, open_)))
        while over < most:
            for fill in fillings(free, gap, over, slack):
                used += 1
                if used > nodes:
                    return
                if fill is None:
                    continue
                lost, whole = gap - sum(fill), [s, *fill]
                times = min(left[x] // n for x, n in Counter(whole).items())
                times = min(times, open_, waste // lost if lost else times)
                if times > 1:
                    yield whole, times
                if times:
                    yield whole, 1
            over, slack = slack, min(most, 2 * slack + 1)

    stack: list = []
    while True:
        while largest and not left[largest]:
            largest -= 1
        if not largest:
            return [done for _, done, _ in stack]
        stack.append([children(largest, waste, open_), None, largest])
        while True:
            branch, done, largest = stack[-1]
            if done:
                for x in done[0]:
                    left[x] += done[1]
                waste += done[1] * (size - sum(done[0]))
                open_ += done[1]
            stack[-1][1] = done = next(branch, None)
            if done:
                break
            stack.pop()
            if not stack or used > nodes:
                return None
        for x in done[0]:
            left[x] -= done[1]
        waste -= done[1] * (size - sum(done[0]))
        open_ -= done[1]


def pack_histogram(counts: dict[int, int], size: int = SIZE) -> list[tuple[list[int], int]]:
    """(lengths, times): the sequences, largest length first."""
    best, least = best_fit_decreasing(counts, size), least_sequences(counts, size)
    need = sum(n for _, n in best)
    step = (need - least) // 16
    for share in SHARES:
        low = least  # halve what is between the bound and the incumbent
        while need - low > step:
            most = (low + need - 1) // 2
            found = complete(counts, size, most, share, NODES)
            if found is None:
                low = most + 1
            else:
                best, need = found, sum(n for _, n in found)
    return sorted(best, key=lambda x: sorted(x[0], reverse=True), reverse=True)


def slots(bins: list[tuple[list[int], int]], size: int) -> tuple[np.ndarray, ...]:
    """Sorted keys (length, first rank) with the first sequence and the offset."""
    used, rows, first = Counter(), [], 0
    for fill, times in bins:
        offset = 0
        for s in fill:
            rows.append((s, used[s], first, offset))
            used[s] += times
            offset += s
        first += times
    rows.sort()
    return tuple(np.array(c, np.int64) for c in (zip(*rows, strict=True) if rows else ((), (), (), ())))


def placer(shared):
    def work(batches):
        length, rank, first, offset = shared.value
        span = np.int64(1) << np.int64(48)
        key = length * span + rank
        for batch in batches:
            mine = batch.column("length").to_numpy() * span + (r := batch.column("rank").to_numpy())
            at = np.searchsorted(key, mine, side="right") - 1
            yield batch_of(
                **{n: batch.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")},
                sequence_id=pa.array(first[at] + r - rank[at], pa.int64()),
                offset=pa.array(offset[at], pa.int64()),
            )

    return work


def best_fit_packing(docs: DataFrame, tokenizer: str, size: int = SIZE, end: int = END) -> DataFrame:
    """Pieces of all documents with their sequence and offset."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    cut = map_arrow(docs.select("doc_id", text_of().alias("text")), cutter(tokenizer, size, end), columns)
    pieces = staged(cut, "pieces")
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    shared = docs.sparkSession.sparkContext.broadcast(slots(pack_histogram(histogram, size), size))
    salts = max(16, -(-max(histogram.values(), default=1) // WINDOW_ROWS))
    keyed = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    before = (
        keyed.groupBy("length", "salt")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn(
            "before",
            F.coalesce(
                F.sum("n").over(
                    Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ),
        )
        .drop("n")
    )
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = keyed.withColumn("r", F.row_number().over(order) - 1).join(before, ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("r") + F.col("before")).cast("long").alias("rank"))
    return map_arrow(ranked, placer(shared), f"{columns}, sequence_id long, offset long")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return best_fit_packing(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
