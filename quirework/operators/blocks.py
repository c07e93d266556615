"""Blocks, pages and chapters of Markdown documents.

A document is a text with page markers ``<!-- page: N -->``; blocks are parted by
a blank line.  Windows are partitioned by document (or document and page), so
they grow with a document, never with the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.functions import text as T

MARKER = r"^<!-- page: *([0-9]+) *-->$"


def blocks(docs: DataFrame, by: str = "\n\n", doc: str = "doc_id") -> DataFrame:
    """(doc, pos, text) of every block."""
    return docs.select(doc, F.posexplode(F.split("text", by)).alias("pos", "text"))


def fenced_blocks(docs: DataFrame) -> DataFrame:
    """Blocks that blank lines inside code fences do not split."""
    w = Window.partitionBy("doc_id").orderBy("line")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "s"))
    fence = F.trim("s").startswith("```").cast("int")
    lines = lines.withColumn("open", (F.sum(fence).over(w) % 2 == 1) | (fence == 1))
    lines = lines.withColumn("gap", (T.trim_space("s") == "") & ~F.col("open"))
    lines = lines.withColumn("g", F.sum(F.col("gap").cast("int")).over(w)).where(~F.col("gap"))
    out = lines.groupBy("doc_id", "g").agg(F.sort_array(F.collect_list(F.struct("line", "s"))).alias("x"))
    pos = F.row_number().over(Window.partitionBy("doc_id").orderBy("g")) - 1
    return out.select("doc_id", pos.alias("pos"), F.array_join("x.s", "\n").alias("text"))


def is_marker(text="text") -> Column:
    """A page marker, whether or not its number can be read."""
    return T.trim_space(text).startswith("<!-- page:")


def marker_page(text="text") -> Column:
    """A marker's page; null if it is no number."""
    rest = F.regexp_replace(F.substring(T.trim_space(text), 11, 2**30), "(-->)+$", "")
    return T.trim_space(rest).try_cast("int")


def is_content(text="text") -> Column:
    """Neither empty nor an image nor a comment."""
    return T.col(text).rlike(r"^\s*+(?!!\[|<!--)\S")


def with_pages(parts: DataFrame) -> DataFrame:
    """The page of each block, by forward fill of the markers; null before the
    first one and behind one whose number can't be read."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    page = F.when(is_marker(), F.struct(marker_page().alias("n")))
    return parts.withColumn("is_marker", is_marker()).withColumn("page", F.last(page, ignorenulls=True).over(w)["n"])


def with_counted_pages(parts: DataFrame) -> DataFrame:
    """The same for views and translations: a marker without a number stands for
    the page after the last one, and pages before the first are 0."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    x = parts.withColumn("is_marker", is_marker()).withColumn("_n", F.when(is_marker(), marker_page()))
    x = x.withColumn("_g", F.count("_n").over(w))
    more = F.sum((F.col("is_marker") & F.col("_n").isNull()).cast("int")).over(Window.partitionBy("doc_id", "_g").orderBy("pos"))
    known = F.coalesce(F.last("_n", ignorenulls=True).over(w), F.lit(0))
    return x.withColumn("page", (known + more).cast("int")).drop("_n", "_g")


def split_pages(docs: DataFrame) -> DataFrame:
    """(doc_id, page, text) by markers anywhere in the text; texts of one page
    are joined, what stands before the first marker, behind a marker without a
    number or behind an unterminated one goes."""
    parts = docs.select("doc_id", F.posexplode(F.split("text", "<!-- page:")).alias("pos", "s")).where("pos > 0")
    w = Window.partitionBy("doc_id").orderBy("pos")
    end = F.instr("s", "-->")
    x = parts.withColumn("stopped", F.max((end == 0).cast("int")).over(w)).where("stopped = 0")
    x = x.select(
        "doc_id", "pos", T.trim_space(F.substring(F.col("s"), F.lit(1), end - 1)).try_cast("int").alias("page"),
        F.substring(F.col("s"), end + 3, F.length("s")).alias("t"),
    )
    out = x.where("page is not null").groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(F.struct("pos", "t"))).alias("x"))
    return out.select("doc_id", "page", F.array_join("x.t", "").alias("text"))


def located(parts: DataFrame, page: int, block: int) -> DataFrame:
    """The trimmed text of one content block of each document."""
    own = numbered(parts).where((F.col("page") == page) & (F.col("block") == block))
    return own.select("doc_id", T.trim_space("text").alias("text"))


def first_blocks(parts: DataFrame, most: int) -> DataFrame:
    """Blocks up to the ``most``-th content block; markers and images are not
    counted."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    return parts.withColumn("_n", F.sum(is_content().cast("int")).over(w)).where(F.col("_n") <= most).drop("_n")


def page_subset(parts: DataFrame, first: int, last: int, offset: int) -> DataFrame:
    """Blocks of pages first..last, pages renumbered by an offset, in the
    markers as well."""
    kept = parts.where(F.col("page").between(first, last)).withColumn("page", F.col("page") + offset)
    marker = F.concat(F.lit("<!-- page: "), F.col("page").cast("string"), F.lit(" -->"))
    return kept.withColumn("text", F.when(F.col("is_marker"), marker).otherwise(F.col("text")))


def edited_pages(pages: DataFrame, edits: DataFrame) -> DataFrame:
    """Pages with whole new texts; an edit that holds a marker or names a page
    that isn't there is refused (it changes nothing)."""
    fair = edits.where(~F.contains(F.col("text"), F.lit("<!-- page:")))
    return replace_pages(pages, fair)


def numbered(parts: DataFrame, page: str = "page") -> DataFrame:
    """Content blocks with their number on the page, from 0."""
    w = Window.partitionBy("doc_id", page).orderBy("pos")
    return parts.where(is_content()).withColumn("block", F.row_number().over(w) - 1)


def page_texts(parts: DataFrame) -> DataFrame:
    """One text per page; repeated markers merge, text before the first goes."""
    own = parts.where("page is not null and not is_marker")
    out = own.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("x"))
    return out.select("doc_id", "page", F.array_join("x.text", "\n\n").alias("text"))


def only_pages(parts: DataFrame, first: int, last: int) -> DataFrame:
    """Blocks of pages first..last; documents without markers stay whole."""
    if first < 1 or last < first:
        raise ValueError("a page range needs 1 <= first <= last")
    any_marker = F.max("is_marker").over(Window.partitionBy("doc_id"))
    kept = parts.withColumn("_any", any_marker)
    return kept.where(~F.col("_any") | F.col("page").between(first, last)).drop("_any")


def without_markers(parts: DataFrame) -> DataFrame:
    """The document's text for export."""
    out = parts.where(~is_marker()).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("x"))
    return out.select("doc_id", F.concat(T.trim_space(F.array_join("x.text", "\n\n")), F.lit("\n")).alias("text"))


def replace_pages(pages: DataFrame, replacements: DataFrame) -> DataFrame:
    """Pages with new texts where there is one."""
    new = replacements.select("doc_id", "page", F.col("text").alias("_new"))
    return pages.join(new, ["doc_id", "page"], "left").withColumn("text", F.coalesce("_new", "text")).drop("_new")


def correct_blocks(parts: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits (doc_id, page, block, key, text) applied only where the block still
    has the key; blank replacements are refused."""
    new = edits.where(T.trim_space("text") != "").select(
        "doc_id", "page", "block", F.col("key").alias("_k"),
        F.regexp_replace(T.trim_space("text"), r"\n\s*\n+", "\n").alias("_new"),
    )
    joined = parts.join(new, ["doc_id", "page", "block"], "left")
    same = F.col("_k") == T.block_key("text")
    return joined.withColumn("text", F.when(same, F.col("_new")).otherwise(F.col("text"))).drop("_k", "_new")


def heading_level(line) -> Column:
    """1 to 6 for a Markdown heading, else null."""
    return F.nullif(F.length(F.regexp_extract(line, "^(#{1,6}) ", 1)), F.lit(0))


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, line, s, fenced) of every line."""
    w = Window.partitionBy("doc_id").orderBy("line")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "s"))
    fence = F.trim("s").startswith("```").cast("int")
    return lines.withColumn("fenced", (F.sum(fence).over(w) % 2 == 1) | (fence == 1))


def split_levels(lines: DataFrame) -> DataFrame:
    """Per document the smallest heading level that occurs twice or more."""
    heads = lines.where(~F.col("fenced")).withColumn("level", heading_level(F.col("s"))).where("level is not null")
    return heads.groupBy("doc_id", "level").count().where("count >= 2").groupBy("doc_id").agg(F.min("level").alias("split_level"))


def chapters(lines: DataFrame) -> DataFrame:
    """Each line's chapter: one starts at a heading of the split level or above
    when the current one isn't blank."""
    level = F.when(~F.col("fenced"), heading_level(F.col("s")))
    w = Window.partitionBy("doc_id").orderBy("line")
    joined = lines.join(split_levels(lines), "doc_id", "left").withColumn("level", level)
    starts = F.coalesce(F.col("level") <= F.col("split_level"), F.lit(False))
    before = F.max((T.trim_space("s") != "").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    joined = joined.withColumn("starts", (starts & (F.coalesce(before, F.lit(0)) == 1)).cast("int"))
    return joined.withColumn("chapter", F.sum("starts").over(w)).drop("starts")


def contents(lines: DataFrame) -> DataFrame:
    """Table of contents: per chapter its title and the headings one level below."""
    heads = chapters(lines).where("level is not null")
    w = Window.partitionBy("doc_id", "chapter")
    title = F.regexp_replace(F.regexp_replace("s", "^#+ ", ""), r"\*", "")
    heads = heads.select("doc_id", "chapter", "line", "level", title.alias("title")).withColumn("base", F.min("level").over(w))
    heads = heads.withColumn("n", F.row_number().over(w.orderBy("line")))
    return heads.where("(n = 1 or level = base + 1) and title <> ''").withColumn("is_title", F.col("n") == 1)


def structure(lines: DataFrame) -> DataFrame:
    """Headings, tables and images per document; those inside fences count for
    tables and images only."""
    w = Window.partitionBy("doc_id").orderBy("line")
    row = T.trim_space("s").startswith("|")
    rule = T.trim_space("s").rlike(r"^\|[ :|-]*-[ :|-]*$")
    x = lines.withColumn("tab", (rule & F.coalesce(F.lag(row).over(w), F.lit(False))).cast("int"))
    return x.groupBy("doc_id").agg(
        F.sum(F.when(~F.col("fenced") & heading_level(F.col("s")).isNotNull(), 1).otherwise(0)).alias("headings"),
        F.sum(F.col("tab") + T.occurrences("s", "<table")).alias("tables"),
        F.sum(T.occurrences("s", "![") + T.occurrences("s", "<img")).alias("images"),
    )


def shape(text="text") -> Column:
    """What a block is, as far as a translation must keep it."""
    t = T.trim_space(text)
    lines = F.split(t, "\n")
    return (
        F.when(t.rlike(MARKER), "page")
        .when(t.startswith("```") | t.startswith("$$"), "literal")
        .when(t.startswith("!["), "image")
        .when(
            t.startswith("|"),
            F.concat(F.lit("table:"), F.size(lines).cast("string"), F.lit("x"), (T.occurrences(lines[0], "|") - 1).cast("string")),
        )
        .when(t.rlike("^#{1,6} "), F.concat(F.lit("heading:"), F.length(F.regexp_extract(t, "^(#+)", 1)).cast("string")))
        .when(t.rlike(r"^([-*] |[0-9]+\. )"), "list")
        .otherwise("paragraph")
    )


def prefix_and_text(line) -> Column:
    """A line's structural prefix and the rest."""
    rx = r"^(\s*(?:#{1,6} |[-*>] |[0-9]+\. )?)([\s\S]*)$"
    return F.struct(F.regexp_extract(line, rx, 1).alias("prefix"), F.regexp_extract(line, rx, 2).alias("rest"))


def continuations(parts: DataFrame) -> DataFrame:
    """Paragraphs that run on over a page break: (doc_id, pos, next_pos), each
    block in one pair at most (pairs of a chain are taken from the left)."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    x = parts.withColumn("marks", F.sum(F.col("is_marker").cast("int")).over(w)).where(is_content())
    x = x.withColumn("kind", shape()).withColumn("t", T.trim_space("text"))
    nxt = lambda c: F.lead(c).over(w)
    runs = (
        (F.col("kind") == "paragraph")
        & (nxt("kind") == "paragraph")
        & (nxt("marks") - F.col("marks") == 1)
        & ~F.col("t").rlike(r"[.!?:;…\"”»)]$")
        & nxt("t").rlike(r"^\p{Ll}")
    )
    x = x.withColumn("next_pos", nxt("pos")).withColumn("runs", F.coalesce(runs, F.lit(False)))
    island = F.sum((~F.col("runs")).cast("int")).over(w)
    x = x.withColumn("island", island - (~F.col("runs")).cast("int"))
    turn = F.row_number().over(Window.partitionBy("doc_id", "island").orderBy("pos"))
    return x.withColumn("turn", turn).where("runs and turn % 2 = 1").select("doc_id", "pos", "next_pos")


def split_translation(words: Column, a: Column, b: Column) -> Column:
    """A joined translation cut in proportion a : b, at least a word each side."""
    n = F.size(words)
    cut = F.greatest(F.lit(1), F.least(n - 1, F.ceil(n * a / (a + b)).cast("int")))
    cut = F.when(n < 2, n).otherwise(cut)
    return F.struct(
        F.array_join(F.slice(words, F.lit(1), cut), " ").alias("first"),
        F.array_join(F.slice(words, cut + 1, F.greatest(n - cut, F.lit(0))), " ").alias("second"),
    )
