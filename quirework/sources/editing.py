"""EPUB packages changed in place: texts of blocks, the language.

Only the bytes of what changes are replaced; all else of a package stays.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.shipping import ship
from quirework.sources import readers


def escaped(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def set_texts(xhtml: bytes, edits: dict[int, str]) -> bytes:
    """A chapter with new texts of its blocks by number; a block that there isn't
    or that isn't editable is an error."""
    blocks = readers.placed_blocks(xhtml)
    for n in sorted(edits, reverse=True):
        if not (0 <= n < len(blocks) and blocks[n][2]):
            raise ValueError(f"block {n} can't be edited")
        start, end = blocks[n][3:]
        xhtml = xhtml[:start] + escaped(edits[n]).encode() + xhtml[end:]
    return xhtml


def replace_attribute(tag: str, name: str, value: str) -> str:
    """A tag with another value of an attribute, if it has it."""
    return re.sub(rf" {re.escape(name)}=([\"'])(.*?)\1", lambda m: f" {name}={m[1]}{value}{m[1]}", tag, flags=re.S)


def chapter_language(xhtml: bytes, code: str) -> bytes:
    """A chapter whose ``html`` tag names the language in the attributes it has."""
    m = re.search(rb"<html[^>]*", xhtml)
    if not m or m.end() == len(xhtml):
        return xhtml
    tag = replace_attribute(m[0].decode(), "lang", code)
    return xhtml[: m.start()] + replace_attribute(tag, "xml:lang", code).encode() + xhtml[m.end() :]


def package_language(opf: bytes, code: str) -> bytes:
    """A package document whose first ``dc:language`` is the code."""
    return re.sub(rb"(<dc:language[^>]*>).*?(</dc:language>)", lambda m: m[1] + code.encode() + m[2], opf, count=1, flags=re.S)


def edited(content: bytes, texts: dict[tuple[int, int], str], language: str | None = None) -> bytes:
    """The package with new texts by (chapter, block) and, if given, another
    language.  Entries keep their order, times and way of packing."""
    chapters = readers.epub_chapters(content)
    new: dict[str, bytes] = {}
    by_chapter: dict[int, dict[int, str]] = {}
    for (chapter, block), text in texts.items():
        by_chapter.setdefault(chapter, {})[block] = text
    if any(not 0 <= c < len(chapters) for c in by_chapter):
        raise ValueError("no such chapter")
    for number, name, xhtml in chapters:
        xhtml = set_texts(new.get(name, xhtml), by_chapter.get(number, {}))
        new[name] = chapter_language(xhtml, language) if language else xhtml
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as old, zipfile.ZipFile(out, "w") as z:
        opf = readers.package_path(old)
        if language:
            new[opf] = package_language(old.read(opf), language)
        for entry in old.infolist():
            z.writestr(entry, new.get(entry.filename, None) or old.read(entry), entry.compress_type)
    return out.getvalue()


def edit_packages(packages: DataFrame, edits: DataFrame, language: str | None = None) -> DataFrame:
    """``packages`` (id, content) with the texts of ``edits`` (id, chapter, block,
    text; one row a block) and the language set.  A package without edits stays,
    but for its language; null content stays null."""
    ship(packages.sparkSession)
    of = edits.groupBy("id").agg(F.collect_list(F.struct("chapter", "block", "text")).alias("edits"))

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = [
                c if c is None else edited(bytes(c), {(e["chapter"], e["block"]): e["text"] for e in ([] if x is None else x)}, language)
                for c, x in zip(f["content"], f["edits"], strict=True)
            ]
            yield pd.DataFrame({"id": f["id"], "content": made})

    x = packages.select("id", "content").join(of, "id", "left")
    kind = packages.schema["id"].dataType.simpleString()
    return x.mapInPandas(write, f"id {kind}, content binary")


def chapter_view(blocks: DataFrame, chapter: int) -> DataFrame:
    """The blocks of a package's chapter; a number past the last is the last."""
    last = blocks.groupBy("id").agg(F.max("chapter").alias("_last"))
    x = blocks.join(last, "id").where(F.col("chapter") == F.greatest(F.lit(0), F.least(F.lit(chapter), F.col("_last"))))
    return x.drop("_last")
