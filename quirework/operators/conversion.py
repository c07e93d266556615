"""Converted documents: second readings of doubtful pages, then the clean-up.

Reading a file and asking a visual model are the caller's; their results come in
as tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirework.functions import readings
from quirework.functions import text as T
from quirework.operators import blocks as B
from quirework.operators import doubt, images, polish


def reread_pages(pages: DataFrame, rereads: DataFrame, references: DataFrame, ink: DataFrame, full: bool = False) -> DataFrame:
    """(book, page, text, accepted, why) of the pages that a second reading is
    asked for and that are started within the time their book has.

    ``pages``: book, page, text.  ``rereads``: the same with ``seconds``; a null
    text is a failed reading.  ``ink``: book, page, ink.  An accepted reading is
    the page's new ``text``; of a refused one only the figures go to the end of
    the page, if figures are expected there (or ``full``: all pages are read, in
    any time).  ``text`` is null where the page stays as it is."""
    words = pages.select("book", "page", F.size(T.tok_alnum("text")).alias("words"))
    doubtful = doubt.doubtful_pages(pages, references, ["book", "page"]).select("book", "page", F.lit("doubtful").alias("why"))
    figures = doubt.figure_pages(ink.join(words, ["book", "page"])).select("book", "page", F.lit("figure").alias("why"))
    whys = doubtful.union(figures)
    if full:
        whys = whys.union(pages.select("book", "page", F.lit("full").alias("why")))
    asked = whys.groupBy("book", "page").agg(F.array_sort(F.collect_set("why")).alias("why"))
    x = asked.join(rereads.select("book", "page", F.col("text").alias("reread"), "seconds"), ["book", "page"])
    if not full:
        count = pages.groupBy("book").agg(F.count(F.lit(1)).alias("_n"))
        x = doubt.within_budget(x.join(count, "book"), "book", "page", "seconds", doubt.reread_budget(F.col("_n"))).drop("_n", "spent")
    x = x.join(pages, ["book", "page"])
    plain = x.select("book", "page", readings.without_figures("reread").alias("text")).where("text is not null")
    # a page and its reading meet word by word; pages that aren't asked for stay out
    judged = doubt.accepted_rereads(x.select("book", "page", "text"), plain, ["book", "page"]).select("book", "page", "accepted")
    x = x.join(judged, ["book", "page"], "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)) & F.col("reread").isNotNull())
    only = readings.only_figures("reread")
    wanted = F.arrays_overlap("why", F.array(F.lit("figure"), F.lit("full")))
    new = F.when(F.col("accepted"), F.col("reread")).when(wanted & (only != ""), F.concat(T.trim_space("text"), F.lit("\n\n"), only))
    return x.select("book", "page", new.alias("text"), "accepted", "why")


def replaced(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with new texts of ``pages`` (book, page, text)
    behind the first marker of a page; null texts and pages without a marker
    change nothing."""
    x = polish.sections(docs).groupBy("book", "section").agg(
        F.max("page").alias("page"),
        F.max(F.when(F.col("is_marker"), F.col("text"))).alias("marker"),
        F.array_sort(F.collect_list(F.when(~F.col("is_marker"), F.struct("pos", "text")))).alias("x"),
    )
    first = F.row_number().over(Window.partitionBy("book", "page").orderBy("section")) == 1
    x = x.withColumn("first", first & F.col("page").isNotNull())
    new = pages.where("text is not null").select("book", "page", F.col("text").alias("_new"), F.lit(True).alias("first"))
    x = x.join(new, ["book", "page", "first"], "left")
    body = F.when(F.col("_new").isNull(), F.col("x.text")).otherwise(F.array("_new"))
    parts = F.struct("section", F.array_compact(F.concat(F.array("marker"), body)).alias("blocks"))
    whole = x.groupBy("book").agg(F.array_sort(F.collect_list(parts)).alias("x"))
    whole = whole.select(F.col("book").alias("doc_id"), F.array_join(F.flatten("x.blocks"), "\n\n").alias("_text"))
    out = docs.join(whole, "doc_id", "left").withColumn("text", F.coalesce("_text", "text"))
    return out.select(*docs.columns)


def convert(docs: DataFrame, lines: DataFrame, outline: DataFrame, references: DataFrame, rereads: DataFrame, ink: DataFrame) -> DataFrame:
    """The clean text of each document (doc_id, text, scanned), the clean-up's
    counters, and the pages whose second reading was taken (``reread``, ascending).

    Image references of the reader go: pictures come back with their places.
    Only scanned documents are read again; their hidden text layer
    (``references``) serves to find doubtful pages, never to repair the text.
    Other tables: as in ``polish.polish`` and ``reread_pages``."""
    bare = docs.select("doc_id", images.without_references("text").alias("text"), "scanned")
    scans = bare.where("scanned").select(F.col("doc_id").alias("book"))
    of = lambda df: df.join(scans, "book", "left_semi")
    pages = B.page_texts(B.with_pages(B.blocks(bare.where("scanned")))).withColumnRenamed("doc_id", "book")
    again = reread_pages(pages, of(rereads), of(references), of(ink))
    text = replaced(bare.select("doc_id", "text"), again)
    out = polish.polish(text, lines, outline, references.join(scans, "book", "left_anti"))
    taken = again.where("accepted").groupBy(F.col("book").alias("doc_id")).agg(F.array_sort(F.collect_list("page")).alias("reread"))
    return out.join(taken, "doc_id", "left").withColumn("reread", F.coalesce("reread", F.array().cast(taken.schema["reread"].dataType)))
