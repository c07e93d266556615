"""The composed clean-up of converted documents.

One row a document, with its lines, bookmarks and references as arrays: what
columns can tell about a block or a line is told in place, and what depends on
the others of the document is worked out in Arrow batches.  Nothing of that is
shuffled; tables of their own are dealt out once, by document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from quirework.functions import text as T
from quirework.operators import blocks as B
from quirework.operators import cleanup, headings, repair, whole
from quirework.shipping import ship
from quirework.sources import readers

COUNTERS = ("removed_margins", "restored_dashes", "removed_ornaments", "joined_words", "headings")
#: Documents (and bytes) of an Arrow batch, as texts have any length, and how many
#: of them are Python objects at a time.
BATCH, BYTES, ROWS = 512, 16 << 20, 64

#: More words than a margin or a heading has, told by a text's start: of white
#: space, of letters and digits, and of letters, digits and ``#`` with a letter.
#: The last number is the same for all lines of one ``key_heading`` and at most
#: that of the words, so a line of more shares its key with no heading.
_MANY_SPACED = rf"^\s*+(?:\S++\s++){{{cleanup.SHORT}}}\S"
_MANY_WORDS = rf"^[^\p{{L}}\p{{N}}]*+(?:[\p{{L}}\p{{N}}]++[^\p{{L}}\p{{N}}]++){{{cleanup.WORDS}}}[\p{{L}}\p{{N}}]"
_MANY_LETTERED = rf"^(?:[^\p{{L}}]*+\p{{L}}[\p{{L}}\p{{N}}#]*+[^\p{{L}}\p{{N}}#]++){{{cleanup.WORDS}}}[^\p{{L}}]*+\p{{L}}"

LINE = ("page", "line_no", "text", "size", "bold", "centered", "gap_before")
MARK = ("page", "ord", "title", "depth")
REFERENCE = ("page", "text")


def sections(docs: DataFrame) -> DataFrame:
    """(book, section, page, pos, is_marker, text): blocks, numbered by the page
    markers before them; ``page`` is the marker's number, null if unreadable."""
    x = docs.select(F.col("doc_id").alias("book"), readers.normalized_markers("text").alias("text"))
    x = x.select("book", F.posexplode(F.split("text", "\n\n")).alias("pos", "text")).withColumn("is_marker", B.is_marker())
    w = Window.partitionBy("book").orderBy("pos")
    x = x.withColumn("section", F.sum(F.col("is_marker").cast("int")).over(w))
    page = F.when(F.col("is_marker"), F.struct(B.marker_page().alias("n")))
    return x.withColumn("page", F.last(page, ignorenulls=True).over(w)["n"])


def by_rows(f: Callable, kind: pa.DataType, *columns: pa.Array) -> pa.Array:
    """A function of one document's values over a batch, some rows at a time."""
    parts = []
    for at in range(0, len(columns[0]), ROWS):
        rows = zip(*(c.slice(at, ROWS).to_pylist() for c in columns))
        parts.append(pa.array([f(*r) for r in rows], kind))
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def page_texts(blocks, marks, references, pairs) -> dict | None:
    """A document's sections (what stands before the first marker, then a page a
    marker) without running matter and with their dashes.  Two markers of one
    number are two pages; what stands before the first is no page.  ``ref``: the
    page's reference, from 1; 0 for none, null where nothing is known of it.
    ``blocks``: how many are left, markers included."""
    if blocks is None:
        return None
    places: list[list[int]] = [[]]
    markers: list[int | None] = [None]
    for i, m in enumerate(marks):
        if m["is_marker"]:
            places.append([])
            markers.append(i)
        else:
            places[-1].append(i)
    gone = whole.without_margins([[i for i in own if marks[i]["filled"]] for own in places[1:]], [m["key"] for m in marks])
    known = {page: n for n, page in enumerate(references or [], 1) if page is not None}
    out, dashes, total = [], 0, 0
    for marker, own in zip(markers, places):
        kept = [blocks[i] for i in own if i not in gone]
        page = None if marker is None else marks[marker]["page"]
        ref = known.get(page, 0) if references and page is not None else None
        text, n = repair.restored("\n\n".join(kept), pairs[ref - 1] if ref else None)
        dashes += n
        total += bool(kept) + (marker is not None) + text.count("\n\n")
        out.append({"marker": None if marker is None else blocks[marker], "text": text if kept else None, "ref": ref})
    return {"sections": out, "blocks": total, "removed_margins": len(gone), "restored_dashes": dashes}


SECTION = pa.struct([("marker", pa.string()), ("text", pa.string()), ("ref", pa.int32())])
PAGES = pa.struct([("sections", pa.list_(SECTION)), *((c, pa.int64()) for c in ("blocks", "removed_margins", "restored_dashes"))])


@F.arrow_udf(from_arrow_type(PAGES))
def _page_texts(blocks: pa.Array, marks: pa.Array, references: pa.Array, pairs: pa.Array) -> pa.Array:
    return by_rows(page_texts, PAGES, blocks, marks, references, pairs)


def finished(sections, before, lines, outline) -> dict | None:
    """A document's text out of its sections' blocks, with whole words and its
    headings marked; ``before``: how many blocks there were with ornaments."""
    if sections is None:
        return None
    marks = whole.proposed_headings(lines, outline)
    blocks = [b for own in sections for b in own]
    text, n = repair.joined("\n\n".join(blocks))
    return {
        "text": headings.apply_headings(text, marks or None),
        "removed_ornaments": before - len(blocks),
        "joined_words": n,
        "headings": len(marks),
    }


FINISHED = pa.struct([("text", pa.string()), *((c, pa.int64()) for c in ("removed_ornaments", "joined_words", "headings"))])


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        done = by_rows(finished, FINISHED, *(b[c] for c in ("sections", "blocks", "lines", "outline")))
        own = dict(zip(FINISHED.names, done.flatten())) | {c: b[c] for c in ("doc_id", "removed_margins", "restored_dashes")}
        counts = {c: pc.fill_null(own[c], 0) for c in COUNTERS}
        yield pa.RecordBatch.from_pydict({"doc_id": own["doc_id"], "text": own["text"]} | counts)


def block_marks(blocks: Column | str) -> Column:
    """What running matter asks of each block."""
    # a function's argument is worked out as often as it is used: by steps, once
    found = F.transform(blocks, lambda b: F.struct(b.alias("b"), B.is_marker(b).alias("is_marker"), b.rlike(r"\S").alias("filled")))
    return F.transform(
        found,
        lambda x: F.struct(
            x["is_marker"].alias("is_marker"),
            F.when(x["is_marker"], B.marker_page(x["b"])).cast("long").alias("page"),
            x["filled"].alias("filled"),
            F.when(x["filled"] & ~x["is_marker"] & ~x["b"].rlike(_MANY_SPACED) & cleanup.is_short(x["b"]), T.key_cleanup(x["b"])).alias("key"),
        ),
    )


def line_marks(lines: Column | str) -> Column:
    """What headings ask of each line."""
    lower = F.transform(lines, lambda x: F.struct(x.alias("x"), F.lower(x["text"]).alias("t")))
    known = F.transform(
        lower,
        lambda y: F.struct(
            y["x"].alias("x"),
            F.when(~y["t"].rlike(_MANY_WORDS), T.tok_alnum(y["t"])).alias("words"),
            F.when(~y["t"].rlike(_MANY_LETTERED), T.key_heading(y["t"])).alias("key"),
        ),
    )
    few = lambda y: F.size(y["words"]) > 0
    short = F.transform(known, lambda y: F.struct(y.alias("y"), F.when(few(y), T.trim_space(y["x"]["text"])).alias("trimmed")))
    return F.transform(
        short,
        lambda z: F.struct(
            z["y"]["x"]["page"].cast("long").alias("page"),
            z["y"]["x"]["line_no"].alias("line_no"),
            z["trimmed"].alias("text"),
            z["y"]["x"]["size"].cast("double").alias("size"),
            F.round(z["y"]["x"]["size"] * 2).cast("int").alias("half"),
            z["y"]["x"]["bold"].alias("bold"),
            z["y"]["x"]["centered"].alias("centered"),
            z["y"]["x"]["gap_before"].cast("double").alias("gap_before"),
            z["y"]["key"].alias("key"),
            F.length(z["y"]["x"]["text"]).cast("long").alias("length"),
            z["y"]["words"].alias("words"),
            F.coalesce(z["trimmed"].rlike(r"\p{L}") & ~z["trimmed"].rlike("[,;]$"), F.lit(False)).alias("looks"),
        ),
    )


def outline_marks(x: Column) -> Column:
    """A bookmark's words and the level that it gives."""
    return F.struct(
        x["page"].cast("long").alias("page"), x["ord"].alias("ord"), T.tok_alnum(x["title"]).alias("words"),
        F.least(x["depth"] + 1, F.lit(cleanup.LEVELS)).alias("level"),
    )


def reference_marks(x: Column) -> Column:
    """A reference's dashes and, once each, the characters that an ornament may
    have; far less than its text."""
    symbols = F.array_distinct(F.split(F.regexp_replace(x["text"], r"[0-9A-Za-z\s]+", ""), ""))
    pairs = F.when(x["text"].rlike(f"[{repair.DASHES}]"), repair.dash_pairs(x["text"]))
    return F.struct(x["page"].cast("long").alias("page"), F.array_join(symbols, "").alias("symbols"), pairs.alias("pairs"))


def without_ornaments(section: Column, references: Column) -> Column:
    """A section's blocks, its marker first, without ornaments."""
    ref = F.when(section["ref"] > 0, F.element_at(references, section["ref"])["symbols"])
    blocks = F.when(section["text"].isNotNull(), F.split(section["text"], "\n\n")).otherwise(F.array())

    def stays(b: Column) -> Column:
        # most blocks are told by their first letter
        other = section["ref"].isNull() | b.rlike("[0-9A-Za-z]") | ~cleanup.is_ornament(b)
        return other | F.coalesce(cleanup.has_symbol(ref, b), F.lit(False))

    return F.array_compact(F.concat(F.array(section["marker"]), F.filter(blocks, stays)))


def polish_marked(docs: DataFrame) -> DataFrame:
    """``polish_rows`` with the marks of lines, bookmarks and references."""
    spark = docs.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BYTES)
    x = docs.withColumn("_blocks", F.split(readers.normalized_markers("text"), "\n\n"))
    # worked out once: the optimizer doubles no function that it takes for a random one
    texts = _page_texts.asNondeterministic()("_blocks", block_marks("_blocks"), "references.page", "references.pairs")
    x = x.select("doc_id", "lines", "outline", "references", texts.alias("_x"))
    kept = F.transform("_x.sections", lambda s: without_ornaments(s, F.col("references")))
    x = x.select("doc_id", "_x.blocks", "_x.removed_margins", "_x.restored_dashes", kept.alias("sections"), "lines", "outline")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return x.mapInArrow(_finished, f"doc_id {kind}, text string, {', '.join(f'{c} long' for c in COUNTERS)}")


def polish_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text, and the five ``COUNTERS``): margins go, dashes come back,
    ornaments go, broken words are joined, headings are marked, in this order.

    ``docs``: doc_id, text and the arrays ``lines`` (``LINE``), ``outline``
    (``MARK``) and ``references`` (``REFERENCE``, one a page), each null or empty
    where a document has none; ``line_no`` is unique on its page.  A null text
    stays null, with zeros."""
    marks = line_marks("lines").alias("lines"), F.transform("outline", outline_marks), F.transform("references", reference_marks)
    return polish_marked(docs.select("doc_id", "text", marks[0], marks[1].alias("outline"), marks[2].alias("references")))


def gathered(table: DataFrame, marks: Column, name: str) -> DataFrame:
    """(doc_id, ``name``): each book's marks as an array."""
    return table.select(F.col("book").alias("doc_id"), marks.alias("_m")).groupBy("doc_id").agg(F.collect_list("_m").alias(name))


def polish(docs: DataFrame, lines: DataFrame, outline: DataFrame, references: DataFrame) -> DataFrame:
    """``polish_rows`` of tables: the texts and the others' marks are dealt out
    once, by document.

    ``docs``: doc_id (unique), text.  ``lines`` and ``outline``: as in
    ``cleanup.proposed_headings``, with doc_id as ``book``.  ``references``: book,
    page, text, one row a page; a page without a number has none.  All three may
    be empty."""
    x = docs.select("doc_id", "text")
    x = x.join(gathered(lines, line_marks(F.array(F.struct(*LINE)))[0], "lines"), "doc_id", "left")
    x = x.join(gathered(outline, outline_marks(F.struct(*MARK)), "outline"), "doc_id", "left")
    return polish_marked(x.join(gathered(references, reference_marks(F.struct(*REFERENCE)), "references"), "doc_id", "left"))
