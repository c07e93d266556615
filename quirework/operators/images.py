"""Images and page geometry over tables of extracted facts."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quirework.functions import text as T
from quirework.shipping import ship


def references(parts: DataFrame) -> DataFrame:
    """(doc_id, page, ord, name) of the image references in the blocks."""
    names = F.regexp_extract_all("text", F.lit(r"!\[[^\]]*\]\(([^)]*)\)"), 1)
    x = parts.select("doc_id", "page", "pos", F.posexplode(names).alias("k", "name"))
    return x.select("doc_id", "page", (F.row_number().over(Window.partitionBy("doc_id").orderBy("pos", "k")) - 1).alias("ord"), "name")


def words_per_page(parts: DataFrame) -> DataFrame:
    """Words of each page without its image lines."""
    text = F.regexp_replace("text", r"(?m)^!\[.*$", "")
    return parts.where("not is_marker").groupBy("doc_id", "page").agg(F.sum(F.size(T.tok_spaces(text))).alias("words"))


def rejected(refs: DataFrame, facts: DataFrame, words: DataFrame) -> DataFrame:
    """References that are no content: tiny, on three pages or more, a page's
    own background, of one colour, or a mask right after its picture."""
    x = refs.join(facts, ["doc_id", "name"]).join(words, ["doc_id", "page"], "left")
    spread = x.groupBy("doc_id", "content_hash").agg(F.countDistinct("page").alias("pages"))
    x = x.join(spread, ["doc_id", "content_hash"])
    w = Window.partitionBy("doc_id").orderBy("ord")
    tall = F.greatest("width", "height") / F.least("width", "height")
    background = tall.between(1.2, 1.8) & (F.col("width") >= 600) & (F.col("height") >= 600) & (F.coalesce("words", F.lit(0)) >= 25)
    mask = (
        F.col("grayscale")
        & (F.lag("width").over(w) == F.col("width"))
        & (F.lag("height").over(w) == F.col("height"))
        & (F.lag("page").over(w) == F.col("page"))
        & ~F.lag("grayscale").over(w)
    )
    why = (
        F.when(F.least("width", "height") < 48, "tiny")
        .when(F.col("pages") >= 3, "repeated")
        .when(background, "background")
        .when(F.col("uniform"), "uniform")
        .when(F.coalesce(mask, F.lit(False)), "mask")
    )
    return x.withColumn("why", why).where("why is not null").select("doc_id", "page", "ord", "name", "why")


def kept_references(refs: DataFrame, gone: DataFrame) -> DataFrame:
    return refs.join(gone.select("doc_id", "name"), ["doc_id", "name"], "left_anti")


def without_references(text) -> Column:
    """The text without any image reference."""
    return F.regexp_replace(T.col(text), r"!\[[^\]]*\]\([^)]*\)", "")


_TARGET = re.compile(r"\]\(([^)]*)\)")


def without_images(text: str | None, names) -> str | None:
    """The text without references to these files, whatever their other text."""
    if text is None or names is None:
        return text
    gone, out, at = set(names), [], 0
    for m in _TARGET.finditer(text):
        if m[1] not in gone:
            continue
        start = text.rfind("![", at, m.start())
        if start < 0:  # it may begin before a reference that went
            held = "".join([*out, text[at : m.start()]])
            start = held.rfind("![")
            if start < 0:
                gone.discard(m[1])
                continue
            out = [held[:start]]
        else:
            out.append(text[at:start])
        at = m.end()
    return "".join([*out, text[at:]])


@F.pandas_udf(StringType())
def _without_images(text: pd.Series, names: pd.Series) -> pd.Series:
    return pd.Series([without_images(t, n) for t, n in zip(text, names, strict=True)], dtype=object)


def drop_references(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) without the references to ``gone`` (doc_id, name)."""
    ship(docs.sparkSession)
    names = gone.groupBy("doc_id").agg(F.collect_set("name").alias("_names"))
    return docs.join(names, "doc_id", "left").withColumn("text", _without_images("text", "_names")).select(*docs.columns)


def anchors(images: DataFrame, texts: DataFrame) -> DataFrame:
    """Each image's anchor: the first 24 letters of the highest text below it
    that overlaps it; null if there is none.  Coordinates grow upwards."""
    t = texts.select("doc_id", "page", F.col("top").alias("t_top"), F.col("left").alias("t_l"), F.col("right").alias("t_r"), "text")
    hit = images.join(t, ["doc_id", "page"]).where("t_top <= bottom + 1 and t_l < right and t_r > left")
    best = hit.groupBy("doc_id", "page", "seq").agg(F.max_by("text", F.struct("t_top", "text")).alias("text"))
    best = best.select("doc_id", "page", "seq", F.substring(T.letters_only("text"), 1, 24).alias("anchor"))
    return images.join(best, ["doc_id", "page", "seq"], "left")


def insert_places(images: DataFrame, parts: DataFrame) -> DataFrame:
    """(doc_id, page, seq, pos): the block before which an image goes; null for
    the page's end."""
    t = parts.where("not is_marker").select("doc_id", "page", "pos", T.letters_only("text").alias("l"))
    hit = images.where("anchor <> ''").join(t, ["doc_id", "page"]).where(F.contains("l", "anchor"))
    first = hit.groupBy("doc_id", "page", "seq").agg(F.min("pos").alias("pos"))
    return images.join(first, ["doc_id", "page", "seq"], "left")


def joined_pieces(pieces: DataFrame) -> DataFrame:
    """Pieces of a line joined, a blank where the gap is over a quarter of the
    size: (doc_id, page, band, text)."""
    w = Window.partitionBy("doc_id", "page", "band").orderBy("left")
    gap = F.col("left") - F.lag("right").over(w) > F.col("size") * F.lit(0.25)
    s = F.concat(F.when(gap, F.lit(" ")).otherwise(F.lit("")), F.col("text"))
    x = pieces.withColumn("s", s).groupBy("doc_id", "page", "band").agg(F.sort_array(F.collect_list(F.struct("left", "s"))).alias("x"))
    return x.select("doc_id", "page", "band", F.array_join("x.s", "").alias("text"))


def bands(pieces: DataFrame) -> DataFrame:
    """Text pieces in line bands: from the top down, a piece joins the band
    whose first centre is within half the larger height (pages are small, so
    each is handled whole)."""

    def page(df):
        df = df.sort_values(["center", "left"], ascending=[False, True]).reset_index(drop=True)
        band, first, height, out = -1, None, 0.0, []
        for c, h in zip(df["center"], df["height"], strict=True):
            if first is None or abs(c - first) > 0.5 * max(h, height):
                band, first, height = band + 1, c, h
            out.append(band)
        df["band"] = out
        return df

    schema = pieces.drop("band").schema.simpleString()[7:-1].replace(":", " ")
    return pieces.drop("band").groupBy("doc_id", "page").applyInPandas(page, f"{schema}, band int")


def common_edges(pieces: DataFrame) -> DataFrame:
    """The most common left edge in bins of three points; ties to the left."""
    x = pieces.withColumn("bin", F.round(F.col("left") / 3)).groupBy("doc_id", "page", "bin").count()
    return x.groupBy("doc_id", "page").agg((F.max_by("bin", F.struct("count", (-F.col("bin")).alias("b"))) * 3).alias("edge"))
