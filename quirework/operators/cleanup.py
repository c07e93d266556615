"""Running matter, ornaments and headings.

Input blocks have (book, page, pos, text).  Counting keys is a map-side combined
aggregation; the few repeated keys go back by a join that Spark broadcasts only
if it measures them small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.functions import text as T

EDGE, SHORT, LEAST, SHARE, RUN, GAP = 2, 8, 3, 0.15, 5, 2


def edges(blocks: DataFrame, n: int = EDGE) -> DataFrame:
    """The first and last n non-empty blocks of each page."""
    w = Window.partitionBy("book", "page")
    own = blocks.where(T.trim_space("text") != "")
    own = own.withColumn("_a", F.row_number().over(w.orderBy("pos"))).withColumn("_z", F.count(F.lit(1)).over(w) - F.col("_a"))
    return own.where((F.col("_a") <= n) | (F.col("_z") < n)).drop("_a", "_z")


def is_short(text="text") -> Column:
    """At most eight white-space words, and no table row."""
    words = F.filter(F.split(T.col(text), r"\s+"), lambda w: w != "")
    return (F.size(words) <= SHORT) & ~F.contains(T.col(text), F.lit("|"))


def longest_runs(pages: DataFrame, gap: int = GAP) -> DataFrame:
    """(book, key, run): the longest run of pages of a key with small gaps."""
    w = Window.partitionBy("book", "key").orderBy("page")
    x = pages.select("book", "key", "page").distinct()
    x = x.withColumn("_n", (F.col("page") - F.lag("page").over(w) > gap).cast("int"))
    x = x.withColumn("_g", F.sum(F.coalesce("_n", F.lit(0))).over(w))
    return x.groupBy("book", "key", "_g").count().groupBy("book", "key").agg(F.max("count").alias("run"))


def running_keys(blocks: DataFrame) -> DataFrame:
    """(book, key) of running headers and footers."""
    keyed = edges(blocks).where(is_short()).select("book", "page", T.key_cleanup("text").alias("key"))
    # empty keys (only punctuation) name nothing
    keyed = keyed.where("key <> ''").distinct()
    pages = blocks.groupBy("book").agg(F.countDistinct("page").alias("pages")).where(f"pages >= {LEAST}")
    seen = keyed.groupBy("book", "key").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    seen = seen.join(pages, "book").withColumn("least", F.greatest(F.lit(LEAST), F.ceil(F.col("pages") * F.lit(SHARE))))
    by_run = longest_runs(keyed.join(seen.select("book", "key"), ["book", "key"], "left_semi"))
    return seen.join(by_run, ["book", "key"]).where((F.col("n") >= F.col("least")) | (F.col("run") >= RUN)).select("book", "key", "n", "run")


def running_matter(blocks: DataFrame) -> DataFrame:
    """Edge blocks that are running headers or footers."""
    at = edges(blocks).where(is_short()).withColumn("key", T.key_cleanup("text"))
    return at.join(running_keys(blocks).select("book", "key"), ["book", "key"], "left_semi")


def remove_running_matter(blocks: DataFrame) -> DataFrame:
    gone = running_matter(blocks).select("book", "page", "pos")
    return blocks.join(gone, ["book", "page", "pos"], "left_anti")


def symbols(text) -> Column:
    """The text without white space."""
    return F.regexp_replace(T.col(text), r"\s+", "")


def is_ornament(text="text") -> Column:
    """One to three symbols, none of them a Latin letter, a digit or a mark of
    Markdown; white space between them doesn't count."""
    return symbols(text).rlike(r"^[^0-9A-Za-z!\[\]()|#*_]{1,3}$")


def has_symbol(reference, text) -> Column:
    """Whether any symbol of the text stands in the reference; null without one."""
    return F.exists(F.split(symbols(text), ""), lambda c: (c != "") & F.contains(T.col(reference), c))


def ornaments(blocks: DataFrame, references: DataFrame) -> DataFrame:
    """Blocks that are ornaments and of which the page's reference text has no
    symbol (a page without a reference has none); nothing in books that have no
    references at all, nor where the page is unknown."""
    own = blocks.where(is_ornament() & F.col("page").isNotNull()).join(references.select("book").distinct(), "book", "left_semi")
    ref = references.select("book", "page", F.col("text").alias("_ref"))
    return own.join(ref, ["book", "page"], "left").where(~F.coalesce(has_symbol("_ref", "text"), F.lit(False))).drop("_ref")


def hyphen_candidates(blocks: DataFrame) -> DataFrame:
    """Words broken by "- ": both halves and whether the hyphen stays
    (``compound``) or goes (``joined``), by the book's own vocabulary.  Table
    rows are left out; fences are for the caller to leave out."""
    half = r"(?<!\p{L})(\p{L}+\p{Ll})-[ \n]+(?=(\p{Ll}\p{L}*))"
    part = lambda i: F.regexp_extract_all("text", F.lit(half), F.lit(i))
    found = blocks.where(~F.startswith(F.col("text"), F.lit("|"))).select(
        "book", "page", "pos", F.explode(F.arrays_zip(part(1).alias("l"), part(2).alias("r"))).alias("x")
    ).select("book", "page", "pos", F.lower("x.l").alias("l"), F.lower("x.r").alias("r"))
    words = blocks.select("book", F.explode(T.tok_alnum_hyphen("text")).alias("word"))
    pairs = found.select("book", "l", "r").distinct()
    # only words that a pair asks for are kept
    asked = pairs.select("book", "l", "r", F.explode(F.array(F.concat("l", F.lit("-"), "r"), F.concat("l", "r"), "l", "r")).alias("word"))
    there = words.join(asked.select("book", "word").distinct(), ["book", "word"], "left_semi").distinct()
    has = asked.join(there.withColumn("_y", F.lit(True)), ["book", "word"], "left").groupBy("book", "l", "r").agg(
        *[
            F.coalesce(F.bool_or((F.col("word") == w) & F.col("_y")), F.lit(False)).alias(n)
            for n, w in (("_h", F.concat("l", F.lit("-"), "r")), ("_j", F.concat("l", "r")), ("_l", F.col("l")), ("_r", F.col("r")))
        ]
    )
    long = (F.length("l") >= 3) & (F.length("r") >= 3)
    stays = F.col("_h") | (~F.col("_j") & long & F.col("_l") & F.col("_r"))
    how = F.when(stays, "compound").otherwise("joined")
    return found.join(has, ["book", "l", "r"]).select("book", "page", "pos", "l", "r", how.alias("how"))


def body_sizes(lines: DataFrame) -> DataFrame:
    """The size (to halves) with most characters; ties to the smaller one."""
    half = (F.round(F.col("size") * 2) / 2).alias("half")
    n = lines.groupBy("book", half).agg(F.sum(F.length("text")).alias("n"))
    return n.groupBy("book").agg(F.max_by("half", F.struct("n", (-F.col("half")).alias("s"))).alias("body"))


def running_lines(lines: DataFrame) -> DataFrame:
    """(book, key) of lines at the edges of at least three pages and a quarter of
    the book's, which are no headings."""
    pages = lines.groupBy("book").agg(F.countDistinct("page").alias("pages"))
    w = Window.partitionBy("book", "page")
    at = lines.withColumn("_a", F.row_number().over(w.orderBy("line_no"))).withColumn("_z", F.count(F.lit(1)).over(w) - F.col("_a"))
    at = at.where((F.col("_a") <= 2) | (F.col("_z") < 2)).select("book", "page", T.key_heading("text").alias("key")).distinct()
    run = at.groupBy("book", "key").agg(F.count(F.lit(1)).alias("n")).join(pages, "book")
    return run.where(F.col("n") >= F.greatest(F.lit(3), F.ceil(F.col("pages") / 4))).select("book", "key")


#: What makes two lines alike: size in half points, bold, centred.
STYLE = ("half", "bold", "centered")
#: A heading's words at most, levels, and how far down a page a bookmark reaches.
WORDS, LEVELS, REACH, TAIL = 15, 4, 8, 4


def judged_lines(lines: DataFrame) -> DataFrame:
    """Lines with ``body``, ``half`` (size in half points), ``words``, ``large``,
    ``candidate`` (looks like a heading) and, for candidates, ``level`` by the
    rank of their style.

    ``lines``: book, page, line_no, text, size, bold, centered."""
    x = lines.join(body_sizes(lines), "book").withColumn("key", T.key_heading("text"))
    x = x.join(running_lines(lines).withColumn("_run", F.lit(True)), ["book", "key"], "left")
    x = x.withColumn("half", F.round(F.col("size") * 2).cast("int")).withColumn("words", T.tok_alnum("text"))
    x = x.withColumn("large", F.col("size") >= F.col("body") * F.lit(1.12))
    marked = (F.col("bold") | F.col("centered")) & (F.col("size") >= F.col("body") * F.lit(0.95))
    looks = F.size("words").between(1, WORDS) & F.col("text").rlike(r"\p{L}") & ~T.trim_space("text").rlike("[,;]$") & (F.col("large") | marked)
    x = x.withColumn("candidate", F.coalesce(looks & F.col("_run").isNull(), F.lit(False))).drop("_run", "key")
    # the styles of a book are few
    styles = x.where("candidate").select("book", *STYLE).distinct()
    rank = F.dense_rank().over(Window.partitionBy("book").orderBy(*(F.desc(c) for c in STYLE)))
    styles = styles.select(F.lit(True).alias("candidate"), "book", *STYLE, F.least(rank, F.lit(LEVELS)).alias("level"))
    return x.join(styles, ["candidate", "book", *STYLE], "left")


def heading_candidates(lines: DataFrame) -> DataFrame:
    """Lines that look like headings, with a level by the rank of their style."""
    return judged_lines(lines).where("candidate")


def outline_hits(judged: DataFrame, outline: DataFrame) -> DataFrame:
    """(book, page, line_no, outline_level): lines among the first eight of a page
    that are the title of a bookmark to it, or, if they stand out, the end of
    one (four words at most).  The first bookmark in order counts.

    ``outline``: book, page, ord, title, depth."""
    w = Window.partitionBy("book", "page").orderBy("line_no")
    top = judged.withColumn("_at", F.row_number().over(w)).where((F.col("_at") <= REACH) & F.size("words").between(1, WORDS))
    marks = outline.select("book", "page", "ord", T.tok_alnum("title").alias("_title"), F.least(F.col("depth") + 1, F.lit(LEVELS)).alias("_level"))
    n = F.size("words")
    end = F.when(F.size("_title") >= n, F.slice("_title", F.size("_title") - n + 1, n)) == F.col("words")
    stands_out = F.col("centered") | F.col("bold") | F.col("large")
    hit = (F.col("_title") == F.col("words")) | (stands_out & (n <= TAIL) & F.coalesce(end, F.lit(False)))
    x = top.join(marks.where(F.size("_title") > 0), ["book", "page"]).where(hit)
    return x.groupBy("book", "page", "line_no").agg(F.min_by("_level", "ord").alias("outline_level"))


def merged_headings(judged: DataFrame) -> DataFrame:
    """Consecutive candidates of one style on a page, each close to the one before
    it (a null ``gap_before`` is not close), as one heading: (book, page, line_no,
    level, text).  A line with an ``outline_level`` is a heading of its own and
    ends the run."""
    w = Window.partitionBy("book", "page").orderBy("line_no")
    own = F.col("outline_level").isNull()
    x = judged.withColumn("_run", F.col("candidate") & own)
    same = F.col("_run") & F.lag("_run").over(w) & (F.col("gap_before") <= F.col("size") * F.lit(1.6))
    for c in STYLE:
        same &= F.lag(c).over(w) == F.col(c)
    x = x.withColumn("_g", F.sum((~F.coalesce(same, F.lit(False))).cast("int")).over(w)).where(F.col("candidate") | ~own)
    out = x.groupBy("book", "page", "_g").agg(
        F.min("line_no").alias("line_no"),
        F.min(F.coalesce("outline_level", "level")).alias("level"),
        F.sort_array(F.collect_list(F.struct("line_no", T.trim_space("text").alias("text")))).alias("x"),
    )
    return out.select("book", "page", "line_no", "level", F.array_join("x.text", " ").alias("text"))


def proposed_headings(lines: DataFrame, outline: DataFrame) -> DataFrame:
    """(book, page, line_no, level, text) of the headings that styles and
    bookmarks propose; ``lines`` also have ``gap_before``, the distance to the
    line above (null on top of a page)."""
    judged = judged_lines(lines)
    return merged_headings(judged.join(outline_hits(judged, outline), ["book", "page", "line_no"], "left"))


def repeated_margins(lines: DataFrame) -> DataFrame:
    """(book, key, n) of margin lines that evaluation leaves out."""
    at = edges(lines).select("book", "page", T.key_evaluation("text").alias("key"))
    pages = lines.groupBy("book").agg(F.countDistinct("page").alias("pages"))
    n = at.groupBy("book", "key").agg(F.countDistinct("page").alias("n")).where("n >= 3").join(pages, "book")
    return n.where(F.col("n") >= F.greatest(F.lit(3), F.ceil(F.col("pages") * F.lit(0.15)))).select("book", "key", "n")


def without_margins(lines: DataFrame) -> DataFrame:
    """Lines whose key is no repeated margin, anywhere on the page."""
    keys = repeated_margins(lines).select("book", "key")
    return lines.withColumn("key", T.key_evaluation("text")).join(keys, ["book", "key"], "left_anti").drop("key")


def margin_leaks(output: DataFrame, margins: DataFrame) -> DataFrame:
    """Lines of an output that are margins; keys of digits alone count only
    within two lines of a page marker."""
    w = Window.partitionBy("book", "page").orderBy("pos").rowsBetween(-2, 2)
    x = output.withColumn("near", F.max(T.trim_space("text").rlike("^<!-- page:").cast("int")).over(w))
    x = x.withColumn("key", T.key_evaluation("text")).join(margins.select("book", "key"), ["book", "key"], "left_semi")
    return x.where(~F.col("key").rlike("^[# ]+$") | (F.col("near") == 1)).drop("near")
