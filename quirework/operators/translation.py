"""Guards around a translation model.

The model is a hook: a function from a pandas Series of (prompt) texts to a
Series of translations, run as a pandas UDF.  Everything else is columns.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quirework.functions import text as T


def judged(source: Column, target: Column) -> Column:
    """empty, untranslated, length or null: integer bounds of 3/10 and 3 times."""
    a, b = F.length(source), F.length(target)
    same = T.squeeze(F.lower(source)) == T.squeeze(F.lower(target))
    return (
        F.when(T.trim_space(target) == "", "empty")
        .when(same & (F.size(T.tok_alnum(source)) >= 5), "untranslated")
        .when((a >= 20) & ((b * 10 < a * 3) | (b > a * 3)), "length")
    )


def lost_numbers(source: Column, target: Column) -> Column:
    """Digit groups of the source that the target has too few of."""
    s, t = T.digit_groups(source), T.digit_groups(target)
    count = lambda a, x: F.size(F.filter(a, lambda y: y == x))
    return F.filter(F.array_distinct(s), lambda x: count(s, x) > count(t, x))


def terms_in(texts: DataFrame, glossary: DataFrame, most: int = 200) -> DataFrame:
    """(id, terms): glossary terms in each text, in the glossary's order.  The
    glossary holds ``most`` terms at most (a longer one is refused), so it may be
    broadcast."""
    if glossary.limit(most + 1).count() > most:
        raise ValueError(f"a glossary has {most} terms at most")
    terms = F.broadcast(glossary)
    hit = texts.join(terms, T.contains_word("text", F.col("source")))
    out = hit.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("ord", "source"))).alias("x"))
    return out.select("id", F.transform("x", lambda x: x["source"]).alias("terms"))


def parse_glossary(lines: DataFrame, most: int = 200) -> DataFrame:
    """``source = target`` lines; other lines are an error, as are too many."""
    parts = F.split("value", "=", 2)
    x = lines.where(T.trim_space("value") != "").select("ord", T.trim_space(parts[0]).alias("source"), T.trim_space(F.get(parts, 1)).alias("target"))
    bad = x.where("coalesce(source, '') = '' or coalesce(target, '') = ''").count()
    if bad or x.count() > most:
        raise ValueError("every line needs both sides, and there is a bound on their number")
    return x


def prompt(text: Column, language: Column, terms: Column | None = None) -> Column:
    head = F.concat(F.lit("Translate into "), T.language_name(language), F.lit(":\n\n"), text)
    if terms is None:
        return head
    listed = F.array_join(F.transform(terms, lambda t: F.concat(t["source"], F.lit(" -> "), t["target"])), "\n")
    return F.concat(F.lit("Use these terms:\n"), listed, F.lit("\n\n"), head)


def translate(units: DataFrame, model: Callable[[pd.Series], pd.Series], identity: str, cache: DataFrame | None = None) -> DataFrame:
    """(id, text) to (id, text, key, translated, doubt, cached).  Cached
    translations with the same key are reused; only misses reach the model."""
    key = F.substring(F.sha2(F.concat(F.lit(identity + "\0"), F.col("text")), 256), 1, 32)
    x = units.withColumn("key", key)
    known = (cache if cache is not None else x.select("key", F.lit("").alias("translated")).limit(0)).select("key", F.col("translated").alias("_t"))
    x = x.join(known.dropDuplicates(["key"]), "key", "left")
    run = F.pandas_udf(model, StringType())
    misses = x.where("_t is null").withColumn("translated", run("text")).withColumn("cached", F.lit(False))
    hits = x.where("_t is not null").withColumn("translated", F.col("_t")).withColumn("cached", F.lit(True))
    out = misses.unionByName(hits).drop("_t")
    doubt = judged(F.col("text"), F.col("translated"))
    marks = T.inline_marks("text") != T.inline_marks("translated")
    links = T.link_targets("text") != T.link_targets("translated")
    lost = F.size(lost_numbers(F.col("text"), F.col("translated"))) > 0
    doubt = F.coalesce(doubt, F.when(marks | links, "formatting_lost"), F.when(lost, "numbers"))
    kept = F.when(doubt == "empty", F.col("text")).otherwise(F.col("translated"))
    return out.withColumn("doubt", doubt).withColumn("translated", kept)


def doubts_view(doubts: DataFrame, parts: DataFrame, most: int = 160) -> DataFrame:
    """Doubts (doc_id, page, block, doubt) with the beginning of their block on
    one line; empty where the block is gone."""
    text = F.replace(F.substring(T.trim_space("text"), 1, most), F.lit("\n"), F.lit(" "))
    own = parts.select("doc_id", "page", "block", text.alias("excerpt"))
    return doubts.join(own, ["doc_id", "page", "block"], "left").withColumn("excerpt", F.coalesce("excerpt", F.lit("")))


def doubt_counts(doubts: DataFrame) -> DataFrame:
    """How many doubts there are of each kind."""
    return doubts.groupBy("doubt").agg(F.count(F.lit(1)).alias("n"))


def saved_translations(documents: DataFrame, done: DataFrame, names: Column) -> DataFrame:
    """Finished translations of known documents with their language's name, by
    document and name."""
    own = done.join(documents.select("doc_id"), "doc_id", "left_semi")
    return own.withColumn("label", names).orderBy("doc_id", "label")
