"""Evaluation metrics: bags, order, edits, chrF, recall in the top."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from quirework.functions import readings
from quirework.functions import text as T
from quirework.operators.doubt import bag_matches, bags
from quirework.shipping import ship


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def word_scores(output: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """Recall and precision of words and recall of numbers."""
    x = bag_matches(bags(reference, keys), bags(output, keys), keys)
    digits = T.numbers_in(T.tok_alnum("text"))
    n = bag_matches(bags(reference, keys, digits), bags(output, keys, digits), keys).select(
        *keys, ratio(F.col("matches"), F.col("words_a")).alias("numbers_recall")
    )
    return x.select(
        *keys, ratio(F.col("matches"), F.col("words_a")).alias("words_recall"), ratio(F.col("matches"), F.col("words_b")).alias("words_precision")
    ).join(n, keys, "left")


def lcs_length(a: list[str], b: list[str]) -> int:
    """Longest common subsequence by bit-parallel rows (one addition a word)."""
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        hit = row & places.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@F.pandas_udf(IntegerType())
def lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else lcs_length(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="Int32")


def order_scores(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Mean share of the reference words in common order, over pages of 20
    words; ``pairs`` has reference and output texts per page."""
    x = pairs.withColumn("a", T.tok_alnum("reference")).withColumn("b", T.tok_alnum("output")).where(F.size("a") >= 20)
    return x.withColumn("s", lcs("a", "b") / F.size("a")).groupBy(*keys).agg(F.avg("s").alias("order"))


def char_error_rate(reference, output) -> Column:
    r, o = F.lower(T.squeeze(reference)), F.lower(T.squeeze(output))
    return F.when(F.length(r) == 0, F.when(F.length(o) == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(r, o) / F.length(r))


def chrf(pairs: DataFrame, keys: list[str], most: int = 6, beta: float = 2.0) -> DataFrame:
    """chrF over character n-grams without white space, counts summed per key,
    orders without n-grams left out."""
    n = F.col("order")

    def grams(side):
        t = F.regexp_replace(side, r"\s+", "")
        x = pairs.select(*keys, "id", t.alias("t"), F.explode(F.sequence(F.lit(1), F.lit(most))).alias("order")).where(F.length("t") >= n)
        x = x.select(*keys, "id", "order", F.explode(F.sequence(F.lit(1), F.length("t") - n + 1)).alias("i"), "t")
        return x.select(*keys, "id", "order", F.substring("t", F.col("i"), n).alias("word")).groupBy(*keys, "id", "order", "word").agg(
            F.count(F.lit(1)).alias("n")
        )

    x = bag_matches(grams("reference"), grams("output"), [*keys, "id", "order"]).groupBy(*keys, "order").agg(
        F.sum("matches").alias("m"), F.sum("words_a").alias("a"), F.sum("words_b").alias("b")
    )
    p, r = F.when(F.col("b") > 0, F.col("m") / F.col("b")).otherwise(0.0), F.when(F.col("a") > 0, F.col("m") / F.col("a")).otherwise(0.0)
    x = x.groupBy(*keys).agg(F.avg(p).alias("p"), F.avg(r).alias("r"))
    b2 = beta * beta
    f = (1 + b2) * F.col("p") * F.col("r") / (b2 * F.col("p") + F.col("r"))
    return x.select(*keys, (100 * F.when(F.col("p") + F.col("r") > 0, f).otherwise(0.0)).alias("chrf"))


def recall_in_top(items: DataFrame, shares: tuple = (0.1, 0.2, 0.5)) -> DataFrame:
    """Share of the planted items among the first of each book's list; items
    have book, rank (1..), planted."""
    n = F.count(F.lit(1)).over(Window.partitionBy("book"))
    x = items.withColumn("n", n)
    out = None
    for s in shares:
        cut = F.greatest(F.lit(1), F.bround(F.col("n") * F.lit(s), 0))
        y = x.groupBy("book").agg(
            F.lit(s).alias("share"), F.count_if(F.col("planted") & (F.col("rank") <= cut)).alias("found"), F.count_if("planted").alias("planted")
        )
        out = y if out is None else out.unionByName(y)
    return out.withColumn("recall", ratio(F.col("found"), F.col("planted")))


#: Words that a join of titles and headings goes by.
SHINGLE = 3


def outline_recall(titles: DataFrame, headings: DataFrame) -> DataFrame:
    """Share of the titles that some heading of the book contains or is
    contained in; those under three characters are never found but count."""
    t = titles.select("book", "ord", T.tok_alnum("title").alias("tw")).withColumn("t", F.array_join("tw", " "))
    h = headings.select("book", T.tok_alnum("text").alias("hw")).where(F.size("hw") > 0).distinct().withColumn("h", F.array_join("hw", " "))
    pad = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))
    # whoever is contained begins with up to three words that the other has in a row
    key = lambda a: F.array_join(F.slice(a, 1, SHINGLE), " ")
    shingles = lambda a: F.explode(F.array_distinct(F.flatten(F.transform(
        F.sequence(F.lit(1), F.size(a)), lambda i: F.transform(F.sequence(F.lit(1), F.lit(SHINGLE)), lambda k: F.array_join(F.slice(a, i, k), " "))
    ))))
    own = t.where("length(t) >= 3")
    inside = own.withColumn("k", key("tw")).join(h.select("book", "h", shingles("hw").alias("k")), ["book", "k"]).where(F.contains(pad("h"), pad("t")))
    around = own.select("book", "ord", "t", shingles("tw").alias("k")).join(h.withColumn("k", key("hw")), ["book", "k"]).where(F.contains(pad("t"), pad("h")))
    hit = inside.select("book", "ord").unionByName(around.select("book", "ord"))
    found = hit.select("book", "ord").distinct().groupBy("book").agg(F.count(F.lit(1)).alias("found"))
    n = t.groupBy("book").agg(F.count(F.lit(1)).alias("titles")).join(found, "book", "left")
    return n.select("book", "titles", F.coalesce("found", F.lit(0).cast("long")).alias("found")).withColumn("recall", ratio(F.col("found"), F.col("titles")))


def new_findings(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Findings of ``after`` beyond those of ``before`` (multiset difference)."""
    return after.select(*keys).exceptAll(before.select(*keys))


def compared_shapes(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks of a source and its translation by position: other shape, links."""
    a = source.select(*keys, F.col("shape").alias("sa"), T.link_targets("text").alias("la"))
    b = target.select(*keys, F.col("shape").alias("sb"), T.link_targets("text").alias("lb"))
    return a.join(b, keys, "full_outer").agg(
        F.count_if(~F.col("sa").eqNullSafe(F.col("sb"))).alias("other_shape"), F.count_if(F.col("la") != F.col("lb")).alias("other_links")
    )


def verified(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """ok, different or missing for each file of a manifest."""
    f = files.select("path", F.col("sha256").alias("_h"))
    status = F.when(F.col("_h").isNull(), "missing").when(F.lower("_h") == F.lower("sha256"), "ok").otherwise("different")
    return manifest.join(f, "path", "left").withColumn("status", status).drop("_h")




def expected_titles(curated: DataFrame, outline: DataFrame) -> DataFrame:
    """(book, ord, title): the curated list of a book, or else its outline."""
    rest = outline.join(curated.select("book").distinct(), "book", "left_anti")
    own = curated.withColumn("title", T.trim_space("title")).where("title <> ''")
    return own.select("book", "ord", "title").unionByName(rest.select("book", "ord", "title"))


def scanned_scores(wanted: DataFrame, references: DataFrame, output: DataFrame) -> DataFrame:
    """Scores of scanned books over their reference pages: words and numbers
    pooled over the book, order and character errors as means over pages, and
    ``notes`` on pages without a reference or an output, in page order.

    ``wanted``: book, page; the others: book, page, text (Markdown).  Scores are
    null where no reference word is left to compare."""
    ship(wanted.sparkSession)
    r = references.select("book", "page", readings.compared_text("text").alias("a"))
    o = output.select("book", "page", readings.compared_text("text").alias("b"))
    x = wanted.select("book", "page").distinct().join(r, ["book", "page"], "left").join(o, ["book", "page"], "left")
    note = F.when(F.col("a").isNull(), F.concat(F.lit("no reference of page "), "page")).when(F.col("b").isNull(), F.concat(F.lit("the output marks no page "), "page"))
    x = x.withColumn("note", note).withColumn("wa", T.tok_alnum("a")).withColumn("wb", T.tok_alnum("b"))
    both = F.col("note").isNull()
    order = F.when(both & (F.size("wa") > 0), lcs("wa", "wb") / F.size("wa"))
    x = x.withColumn("order", order).withColumn("cer", F.when(both, char_error_rate("a", "b")))
    means = x.groupBy("book").agg(
        F.avg("order").alias("order"),
        F.avg("cer").alias("cer"),
        F.array_sort(F.collect_list(F.when(~both, F.struct("page", "note")))).alias("notes"),
    )
    pooled = x.where(both).select("book", F.explode(F.array(F.struct("wa", F.lit("a").alias("side")), F.struct(F.col("wb").alias("wa"), F.lit("b").alias("side")))).alias("x"))
    n = pooled.select("book", "x.side", F.explode("x.wa").alias("word")).groupBy("book", "word").agg(
        F.count_if(F.col("side") == "a").alias("na"), F.count_if(F.col("side") == "b").alias("nb")
    )
    same, number = F.least("na", "nb"), F.col("word").rlike("[0-9]")
    sums = n.groupBy("book").agg(
        F.sum("na").alias("_a"), F.sum("nb").alias("_b"), F.sum(same).alias("_m"),
        F.sum(F.when(number, F.col("na"))).alias("_na"), F.sum(F.when(number, same)).alias("_nm"),
    )
    y = means.join(sums, "book", "left")
    any_words = F.coalesce(F.col("_a"), F.lit(0)) > 0
    return y.select(
        "book",
        *(
            F.when(any_words, c).alias(name)
            for name, c in {
                "words_recall": ratio(F.col("_m"), F.col("_a")),
                "words_precision": ratio(F.col("_m"), F.col("_b")),
                "numbers_recall": ratio(F.col("_nm"), F.col("_na")),
                "order": F.col("order"),
                "cer": F.col("cer"),
            }.items()
        ),
        F.col("notes.note").alias("notes"),
    )
