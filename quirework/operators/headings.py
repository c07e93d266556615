"""Applying proposed headings to Markdown.

Which block takes a heading depends on the heading before it, so one document's
list is worked through in order, Arrow-batched; documents are independent.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quirework.shipping import ship

#: A title of at most so many letters must fill its block.
SHORT = 3
_WORD_END = re.compile(r"\S*")
_OTHERS = re.compile(r"[\W_]+")


def letters(text: str) -> str:
    """Letters and digits only, in lower case."""
    return _OTHERS.sub("", text).lower()


def title_and_rest(block: str, n: int) -> tuple[str, str]:
    """The block up to the end of the word with its n-th letter, and the rest."""
    places = [m.end() for m in re.finditer(r"[^\W_]", block)]
    cut = _WORD_END.match(block, places[n - 1]).end() if len(places) >= n else len(block)
    title = block[:cut].replace("*", "").replace("`", "").strip()
    return title, block[cut:].lstrip("*`").strip()


def apply_headings(markdown: str | None, headings) -> str | None:
    """Mark each (text, level) at the first block that starts with its letters,
    looking from the last mark on and then from the top.  What follows a title
    becomes a block of its own.  Headings and comments stay; a title that no
    block starts with is left out; a null text stays null."""
    if markdown is None:
        return None
    blocks = markdown.replace("\r\n", "\n").split("\n\n")
    if headings is None:
        return "\n\n".join(blocks)
    # what a block can match; none for headings and comments
    key = lambda b: "" if b.strip().startswith(("#", "<!--")) else letters(b)
    keys = [key(b) for b in blocks]
    at = 0
    for heading in headings:
        want = letters(heading["text"] or "")
        if not want:
            continue
        fits = want.__eq__ if len(want) <= SHORT else lambda k, w=want: k.startswith(w)
        found = next((i for i in (*range(at, len(keys)), *range(at)) if fits(keys[i])), None)
        if found is None:
            continue
        title, rest = title_and_rest(blocks[found].strip(), len(want))
        new = [f"{'#' * heading['level']} {title}", *([rest] if rest else [])]
        blocks[found : found + 1] = new
        keys[found : found + 1] = [key(b) for b in new]
        at = found + 1
    return "\n\n".join(blocks)


@F.pandas_udf(StringType())
def _applied(text: pd.Series, headings: pd.Series) -> pd.Series:
    return pd.Series([apply_headings(t, h) for t, h in zip(text, headings, strict=True)], dtype=object)


def with_headings(docs: DataFrame, text: str = "text", headings: str = "headings") -> DataFrame:
    """``docs`` with its text marked by an array of (text, level) in order."""
    ship(docs.sparkSession)
    return docs.withColumn(text, _applied(text, headings))
