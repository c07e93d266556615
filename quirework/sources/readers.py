"""Readers: Markdown, HTML pages, EPUB packages, manifests, glossaries."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote
from xml.etree import ElementTree
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.functions import text as T

#: Fixed value: the block elements of an EPUB chapter that hold text.
BLOCK_TAGS = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "td", "th", "dt", "dd", "figcaption")
MANIFEST = (
    "id string, title string, url string, sha256 string, bytes long, license string, kind string, language string, "
    "tests string, pages array<int>, reference_pages array<int>, private boolean"
)


def markdown(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as (path, text), CRLF as LF."""
    x = spark.read.text(path, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    return x.select("path", F.regexp_replace("value", "\r\n", "\n").alias("text")).where(T.supported("path"))


def normalized_markers(text) -> Column:
    """Each page marker a block of its own; CRLF as LF; no blank start."""
    t = F.regexp_replace(T.col(text), "\r\n", "\n")
    t = F.regexp_replace(t, r"\s*(<!-- page:[^>]*?-->)\s*", "\n\n$1\n\n")
    return F.regexp_replace(t, r"^\s+", "")


def binaries(spark: SparkSession, path: str, most: int = 512 << 20) -> DataFrame:
    """(path, id, bytes, content): files named by their SHA-256; a file over the
    size is refused."""
    x = spark.read.format("binaryFile").load(path)
    large = x.where(F.col("length") > most).select("path").first()
    if large:
        raise ValueError(f"{large.path} has more than {most} bytes")
    return x.select("path", F.sha2("content", 256).alias("id"), F.col("length").alias("bytes"), "content")


def is_pdf(content) -> Column:
    return F.substring(T.col(content), 1, 5) == F.lit(b"%PDF-")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The evaluation manifest; malformed rows fail the job, repeated ids and
    hashes that are no SHA-256 are an error."""
    x = spark.read.schema(MANIFEST).option("mode", "FAILFAST").json(path)
    if x.groupBy("id").count().where("count > 1").count() or x.where("not sha256 rlike '^[0-9a-fA-F]{64}$'").count():
        raise ValueError("manifest ids must be unique and hashes 64 hex digits")
    return x


def loose_glossary(spark: SparkSession, path: str) -> DataFrame:
    """(source, target) of a tab-separated glossary; other lines are passed over."""
    return loose_terms(spark.read.text(path))


def loose_terms(lines: DataFrame) -> DataFrame:
    """The same of lines in ``value``."""
    parts = F.split("value", "\t")
    x = lines.select(T.trim_space(parts[0]).alias("source"), T.trim_space(F.get(parts, 1)).alias("target"))
    return x.where("source <> '' and target <> ''")


def package_images(references: DataFrame, entries: DataFrame) -> DataFrame:
    """(doc_id, name, entry): the one entry of the document's package that is a
    referenced path or ends with it; references with none or several are left
    out.  ``.`` and ``..`` parts of a path are dropped; paths meet by equality
    through the entries' path ends."""
    steps = F.filter(F.split(F.replace(F.col("name"), F.lit("\\"), F.lit("/")), "/"), lambda x: ~x.isin("", ".", ".."))
    wanted = references.select("doc_id", "name", F.array_join(steps, "/").alias("tail")).where("tail <> ''").distinct()
    cut = F.split("entry", "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(cut)), lambda i: F.array_join(F.slice(cut, i, F.size(cut)), "/"))
    ends = entries.select("doc_id", "entry", F.explode(tails).alias("tail"))
    x = wanted.join(ends, ["doc_id", "tail"]).groupBy("doc_id", "name").agg(F.count(F.lit(1)).alias("n"), F.min("entry").alias("entry"))
    return x.where("n = 1").select("doc_id", "name", "entry")


def page_range(first, last, pages) -> Column:
    return F.struct(F.greatest(T.col(first), F.lit(1)).alias("first"), F.least(T.col(last), T.col(pages)).alias("last"))


def findings(spark: SparkSession, path: str) -> DataFrame:
    """Checker messages, a row for each location, one if there is none."""
    schema = "messages array<struct<ID: string, severity: string, message: string, locations: array<struct<path: string>>>>"
    x = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("messages").alias("m"))
    x = x.select("m.*", F.explode_outer("m.locations").alias("l"))
    return x.select("severity", F.col("ID").alias("identifier"), F.col("l.path").alias("path"), T.squeeze("message").alias("message"))


def local(tag: str) -> str:
    return tag.rpartition("}")[2].lower()


def placed_blocks(xhtml: bytes) -> list[tuple[str, str, bool, int, int]]:
    """(tag, text, editable, start, end) of the innermost text blocks in order;
    editable ones hold no element and no CDATA section.  Start and end are the
    bytes of what stands between the tags.  Depth is no limit."""
    out: list[tuple[str, str, bool, int, int]] = []
    # of each open element: tag, text, whether it is plain, whether a block is in it, where its content starts
    stack: list[list] = []
    parser = expat.ParserCreate(namespace_separator="}")
    parser.buffer_text = False

    def begun():
        if stack and stack[-1][4] is None:
            stack[-1][4] = parser.CurrentByteIndex

    def start(tag, _):
        begun()
        if stack:
            stack[-1][2] = False
        stack.append([local(tag), [], True, False, None])

    def end(_):
        begun()
        tag, text, plain, inner, at = stack.pop()
        block = tag in BLOCK_TAGS
        if block and not inner and (words := " ".join("".join(text).split())):
            out.append((tag, words, plain, at, parser.CurrentByteIndex))
        if stack:
            stack[-1][1] += text
            stack[-1][3] |= block or inner

    def cdata():
        begun()
        stack[-1][2] = False

    def chars(data):
        begun()
        stack[-1][1].append(data)

    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.StartCdataSectionHandler, parser.CharacterDataHandler = cdata, chars
    parser.CommentHandler = parser.DefaultHandler = lambda _: begun()
    parser.ProcessingInstructionHandler = lambda *_: begun()
    parser.Parse(xhtml, True)
    return out


def chapter_blocks(xhtml: bytes) -> list[tuple[str, str, bool]]:
    """(tag, text, editable) of ``placed_blocks``."""
    return [b[:3] for b in placed_blocks(xhtml)]


def package_path(package: zipfile.ZipFile) -> str:
    """The entry of the package document."""
    top = ElementTree.fromstring(package.read("META-INF/container.xml"))
    return next(e.attrib["full-path"] for e in top.iter() if local(e.tag) == "rootfile")


def epub_chapters(content: bytes) -> list[tuple[int, str, bytes]]:
    """(number, entry, XHTML) of the spine's chapters that the package has."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        opf = package_path(z)
        package = ElementTree.fromstring(z.read(opf))
        items = {e.attrib["id"]: e.attrib["href"] for e in package.iter() if local(e.tag) == "item"}
        out = []
        for ref in (e.attrib["idref"] for e in package.iter() if local(e.tag) == "itemref"):
            name = posixpath.normpath(posixpath.join(posixpath.dirname(opf), unquote(items.get(ref, "")))).lstrip("/")
            if name in names:
                out.append((len(out), name, z.read(name)))
        return out


def epub_blocks(packages: DataFrame) -> DataFrame:
    """(id, chapter, block, tag, text, editable) of EPUB packages (id, content)."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [
                (i, n, k, *b)
                for i, content in zip(f["id"], f["content"], strict=True)
                for n, _, xhtml in epub_chapters(bytes(content))
                for k, b in enumerate(chapter_blocks(xhtml))
            ]
            yield pd.DataFrame(rows, columns=["id", "chapter", "block", "tag", "text", "editable"])

    return packages.select("id", "content").mapInPandas(read, "id string, chapter int, block int, tag string, text string, editable boolean")
