"""Signals of doubt about a page: agreement of two readings, figures, scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.functions import text as T

LEAST_WORDS, DOUBTFUL = 20, 0.80


def bags(pages: DataFrame, keys: list[str], words: Column | None = None, name: str = "n") -> DataFrame:
    """(keys, word, n): the word counts of each page (map-side combined)."""
    words = T.tok_alnum("text") if words is None else words
    return pages.select(*keys, F.explode(words).alias("word")).groupBy(*keys, "word").agg(F.count(F.lit(1)).alias(name))


def bag_matches(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: words of a, of b and of their multiset intersection."""
    both = a.withColumnRenamed("n", "na").join(b.withColumnRenamed("n", "nb"), [*keys, "word"], "full_outer")
    zero = F.lit(0).cast("long")
    return both.groupBy(*keys).agg(
        F.sum(F.coalesce("na", zero)).alias("words_a"),
        F.sum(F.coalesce("nb", zero)).alias("words_b"),
        F.sum(F.least(F.coalesce("na", zero), F.coalesce("nb", zero))).alias("matches"),
    )


def agreement(pages: DataFrame, references: DataFrame, keys: list[str]) -> DataFrame:
    """The smaller of both coverages; null where either side is too short."""
    x = bag_matches(bags(pages, keys), bags(references, keys), keys)
    share = F.least(F.col("matches") / F.col("words_a"), F.col("matches") / F.col("words_b"))
    enough = (F.col("words_a") >= LEAST_WORDS) & (F.col("words_b") >= LEAST_WORDS)
    return x.withColumn("agreement", F.when(enough, share))


def doubtful_pages(pages: DataFrame, references: DataFrame, keys: list[str]) -> DataFrame:
    return agreement(pages, references, keys).where(F.col("agreement") < F.lit(DOUBTFUL))


def accepted_rereads(pages: DataFrame, rereads: DataFrame, keys: list[str]) -> DataFrame:
    """Whether a second reading keeps three quarters of the words and isn't half
    as long again; an empty one is refused."""
    x = bag_matches(bags(pages, keys), bags(rereads, keys), keys)
    keeps = F.col("matches") >= F.lit(0.75) * F.col("words_a")
    return x.withColumn("accepted", (F.col("words_b") > 0) & keeps & (F.col("words_b") <= F.lit(1.5) * F.col("words_a")))


def figure_pages(ink: DataFrame) -> DataFrame:
    """Pages with more ink than their words explain: ``ink`` has book, page,
    ink, words.  The ink of a word is the upper median over the wordy pages."""
    per = F.sort_array(F.collect_list(F.when(F.col("words") >= 50, F.col("ink") / F.col("words"))))
    mid = ink.groupBy("book").agg(per.alias("x")).select("book", F.get("x", (F.size("x") / 2).cast("int")).alias("per_word"))
    expected = F.col("per_word") * F.greatest(F.col("words"), F.lit(20))
    return ink.join(mid, "book").where((F.col("ink") > F.lit(0.02)) & (F.col("ink") > F.lit(2.5) * expected))


def within_budget(pages: DataFrame, key: str, order: str, seconds: str, budget: Column) -> DataFrame:
    """Pages that are started before the budget is spent."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return pages.withColumn("spent", F.coalesce(F.sum(seconds).over(w), F.lit(0))).where(F.col("spent") <= budget)


def reread_budget(pages: Column) -> Column:
    return F.greatest(pages * 20, F.lit(300))


def scanned_documents(facts: DataFrame) -> DataFrame:
    """``facts``: book, page, visible_letters, image_coverage (null: no image).
    A page votes for text (20 letters) or scan (half covered); a book is scanned
    if at least half of the votes say so."""
    text = F.col("visible_letters") >= 20
    scan = ~text & (F.coalesce("image_coverage", F.lit(0.0)) >= 0.5)
    n = facts.groupBy("book").agg(F.count_if(text).alias("text_pages"), F.count_if(scan).alias("scan_pages"))
    return n.withColumn("scanned", (F.col("scan_pages") > 0) & (F.col("scan_pages") >= F.col("text_pages")))


def pages_to_reread(doubtful: DataFrame, figures: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """Doubtful pages and pages with figures, each once; all of them if asked."""
    if every is not None:
        return every.select("book", "page").distinct()
    return doubtful.select("book", "page").union(figures.select("book", "page")).distinct()


def image_coverage(pages: DataFrame, images: DataFrame) -> DataFrame:
    """The share of each page that its largest image covers, 0 without one.
    ``pages``: book, page, width, height; ``images``: book, page, w, h."""
    size = images.groupBy("book", "page").agg(F.max(F.col("w") * F.col("h")).alias("_a"))
    area = F.col("width") * F.col("height")
    share = F.when(area > 0, F.coalesce("_a", F.lit(0.0)) / area).otherwise(0.0)
    return pages.join(size, ["book", "page"], "left").withColumn("image_coverage", share).drop("_a")


def visible_letters(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """Letters and digits of each page's visible lines, 0 without any."""
    n = lines.groupBy("book", "page").agg(F.sum(F.length(T.letters_only("text"))).alias("visible_letters"))
    return pages.join(n, ["book", "page"], "left").withColumn("visible_letters", F.coalesce("visible_letters", F.lit(0).cast("long")))
