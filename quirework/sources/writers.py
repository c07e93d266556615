"""Writers: Markdown export, EPUB packages, comparison tables."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.functions import text as T

CONTAINER = (
    '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container">'
    '<rootfiles><rootfile full-path="book.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
)


def exported_markdown(docs: DataFrame, folder: str) -> DataFrame:
    """Texts whose image links point into the export's folder."""
    return docs.withColumn("text", F.regexp_replace("text", r"(!\[[^\]]*\]\()(?:[^)]*/)?([^)/]+)\)", f"$1{folder}/$2)"))


def used_images(refs: DataFrame, files: DataFrame) -> DataFrame:
    return files.join(refs.select("doc_id", "name").distinct(), ["doc_id", "name"], "left_semi")


def page(title: str, body: str) -> str:
    return (
        '<?xml version="1.0" encoding="utf-8"?><html xmlns="http://www.w3.org/1999/xhtml"><head><title>'
        f"{escape(title)}</title></head><body>{body}</body></html>"
    )


def epub_package(identifier: str, title: str, language: str, chapters: list[tuple[str, str]]) -> bytes:
    """An EPUB 3 package of (title, body) chapters; entries in a fixed order."""
    out = io.BytesIO()
    names = [f"chapter-{i:04d}.xhtml" for i in range(len(chapters))]
    items = "".join(f'<item id="c{i}" href="{n}" media-type="application/xhtml+xml"/>' for i, n in enumerate(names))
    spine = "".join(f'<itemref idref="c{i}"/>' for i in range(len(names)))
    nav = "".join(f'<li><a href="{n}">{escape(t)}</a></li>' for n, (t, _) in zip(names, chapters, strict=True))
    opf = (
        '<?xml version="1.0" encoding="utf-8"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id">'
        '<metadata xmlns:dc="http://purl.org/dc/elements/1.1/">'
        f'<dc:identifier id="id">{escape(identifier)}</dc:identifier><dc:title>{escape(title)}</dc:title>'
        f'<dc:language>{escape(language or "und")}</dc:language><meta property="dcterms:modified">2000-01-01T00:00:00Z</meta></metadata>'
        f'<manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>{items}</manifest><spine>{spine}</spine></package>'
    )
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(zipfile.ZipInfo("mimetype"), "application/epub+zip")
        for name, body in [
            ("META-INF/container.xml", CONTAINER),
            ("book.opf", opf),
            ("nav.xhtml", page(title, f'<nav xmlns:epub="http://www.idpf.org/2007/ops" epub:type="toc"><ol>{nav}</ol></nav>')),
            *((n, page(t, b)) for n, (t, b) in zip(names, chapters, strict=True)),
        ]:
            z.writestr(zipfile.ZipInfo(name), body, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def epubs(chapters: DataFrame) -> DataFrame:
    """(id, content): a package for each document of (id, title, language, ord,
    chapter, body); a document's chapters are gathered, never the corpus."""
    x = chapters.groupBy("id", "title", "language").agg(F.sort_array(F.collect_list(F.struct("ord", "chapter", "body"))).alias("c"))

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = [
                epub_package(f"urn:sha256:{r.id}", r.title, r.language, [(c["chapter"], c["body"]) for c in r.c]) for r in f.itertuples()
            ]
            yield pd.DataFrame({"id": f["id"], "content": made})

    return x.mapInPandas(write, "id string, content binary")


def percent(x):
    return F.coalesce(F.format_string("%.1f %%", T.col(x) * 100), F.lit("—"))


def comparison(results: DataFrame, metric: str) -> DataFrame:
    """ids x candidates of a metric, a dash where there is none."""
    x = results.groupBy("id").pivot("candidate").agg(F.first(metric))
    return x.select("id", *(percent(f"`{c}`").alias(c) for c in x.columns if c != "id"))
