"""Texts as a reader or a model gives them: visible text, figures, tables.

What a sign means here depends on the signs before it, so each text is walked
through once, Arrow-batched.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quirework.functions import text as T
from quirework.operators.tables import tables_to_markdown

#: A tag longer than so many bytes is no tag.
TAG = 4096
_SIGN = re.compile(r"<|!\[|\]\(|[#*_`|\[\]>~]")


def visible(markdown: str | None) -> str | None:
    """The text without comments, tags, images, link targets and formatting
    signs, each a blank.  A ``<`` that opens no tag stays, with all up to the
    next ``>``; an image or link target without its end runs to the text's end."""
    if markdown is None:
        return None
    out, at = [], 0
    while m := _SIGN.search(markdown, at):
        out.append(markdown[at : m.start()])
        at = m.end()
        if m[0] == "<":
            end = markdown.find(">", at, m.start() + TAG + 1)
            held = markdown[m.start() : end + 1] if end >= 0 else markdown[m.start() : m.start() + TAG + 1]
            raw = held.encode("utf-8", "surrogatepass")
            if len(raw) > TAG + 1 or (end < 0 and len(raw) > TAG):  # cut behind the byte that is one too many
                n = next(i for i, size in enumerate(_sizes(held), 1) if size > TAG)
                held, end = held[:n], end if n == len(held) else -1
            tag = end >= 0 and (held.startswith("<!--") or re.match(r"<[A-Za-z/]", held))
            out.append(" " if tag else held)
            at = m.start() + len(held)
        elif len(m[0]) == 2:
            end = markdown.find(")", at)
            at = end + 1 if end >= 0 else len(markdown)
            out.append(" ")
        else:
            out.append(" ")
    return "".join([*out, markdown[at:]])


def _sizes(text: str):
    """Bytes up to each character."""
    n = 0
    for c in text:
        n += len(c.encode("utf-8", "surrogatepass"))
        yield n


@F.pandas_udf(StringType())
def visible_text(text: pd.Series) -> pd.Series:
    return text.map(visible)


@F.pandas_udf(StringType())
def compared_text(text: pd.Series) -> pd.Series:
    """Visible text in composed form (NFC), as evaluation compares it."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", visible(t)))


FIGURE = r"\[\[figure:[0-9]+,[0-9]+,[0-9]+,[0-9]+\]\]"
_BOX = re.compile(r"bbox_([0-9]+)[_.\"']([0-9]+)[_.\"']([0-9]+)[_.\"']([0-9]+)(?:[_.\"']|$)")
_THOUGHT = re.compile(r"<think>.*?(?:</think>|\Z)", re.S)
_IMAGE = re.compile(r"<img.*?(?:>|\Z)", re.S)


def box(tag: str) -> tuple[int, ...] | None:
    """The box of a figure's tag, as ``text.figure_box`` has it."""
    m = _BOX.search(tag)
    left, top, right, bottom = (min(1000, int(x)) for x in m.groups()) if m else (0, 0, 0, 0)
    return (left, top, right, bottom) if right >= left + T.FIGURE_SIDE and bottom >= top + T.FIGURE_SIDE else None


def cleaned(raw: str | None) -> str | None:
    """A page as a visual model reads it, fit for Markdown: no thoughts, every
    figure once, as a mark of its box in a block of its own, blocks parted by
    one blank line, tables as pipe tables."""
    if raw is None:
        return None
    while (text := _THOUGHT.sub("", raw)) != raw:
        raw = text
    seen = set()

    def mark(m):
        found = box(m[0])
        if found is None or found in seen:
            return ""
        seen.add(found)
        return "\n\n[[figure:{},{},{},{}]]\n\n".format(*found)

    blocks = (b.strip() for b in _IMAGE.sub(mark, raw).split("\n\n"))
    return tables_to_markdown("\n\n".join(b for b in blocks if b))


@F.pandas_udf(StringType())
def cleaned_reading(text: pd.Series) -> pd.Series:
    return text.map(cleaned)


def _figures(text, keep: bool) -> Column:
    is_figure = lambda b: T.trim_space(b).rlike(f"^{FIGURE}$")
    return F.array_join(F.filter(F.split(T.col(text), "\n\n"), lambda b: is_figure(b) if keep else ~is_figure(b)), "\n\n")


def only_figures(text) -> Column:
    """The figures' marks alone."""
    return _figures(text, True)


def without_figures(text) -> Column:
    return _figures(text, False)
