"""Composed clean-up, readers' texts, page geometry and EPUB editing on fixtures."""

import zipfile
from io import BytesIO

import pytest
from pyspark.sql import functions as F

from quirework.functions import readings
from quirework.operators import cleanup, conversion, geometry, images, metrics, polish, tables
from quirework.sources import editing, readers, writers

LINES = "book long, page long, line_no int, text string, size double, bold boolean, centered boolean, gap_before double"
OUTLINE = "book long, page long, ord int, title string, depth int"
REFS = "book long, page long, text string"


def document():
    body = {
        1: "Chapter One begins here and goes on\n\nHe came home yes and an inter-\nnational treaty was signed.",
        2: "❦\n\n· ·\n\nplain text of two - and more words here",
        3: "nothing\n\n**",
        4: "Tail text end inter-",
    }
    pages = [f"\r\n<!-- page: {p} -->\n\nThe Running Title\n\n{body[p]}\n\n{p}" for p in body]
    return "intro" + "".join(pages) + "\n\n<!-- page: x -->\n\nnational end\n\n❦"


def test_polish(spark):
    docs = spark.createDataFrame([(1, document()), (2, None), (3, ""), (4, "no markers, a well-\nknown case")], "doc_id long, text string")
    body = [(1, 1, i, "body text line goes on and on for ever " * 3, 10.0, False, False, 12.0) for i in range(3, 8)]
    lines = spark.createDataFrame([(1, 1, 1, "The Running Title", 9.0, False, False, None), (1, 1, 2, "Chapter One", 18.0, True, False, 30.0), *body], LINES)
    outline = spark.createDataFrame([], OUTLINE)
    refs = spark.createDataFrame([(1, 1, "He came home—yes and"), (1, 2, "§")], REFS)
    got = {r.doc_id: r for r in polish.polish(docs, lines, outline, refs).collect()}
    assert got[1].text == (
        "intro\n\n<!-- page: 1 -->\n\n# Chapter One\n\nbegins here and goes on\n\nHe came home—yes and an international treaty was signed.\n\n"
        "<!-- page: 2 -->\n\nplain text of two - and more words here\n\n<!-- page: 3 -->\n\nnothing\n\n**\n\n"
        "<!-- page: 4 -->\n\nTail text end international\n\n<!-- page: x -->\n\nend\n\n❦"
    )
    assert got[1][2:] == (8, 1, 2, 2, 1)
    assert (got[2].text, got[3].text, got[4].text) == (None, "", "no markers, a wellknown case")
    assert got[2][2:] == got[3][2:] == (0, 0, 0, 0, 0)
    # without lines and references: no headings, dashes and ornaments
    bare = {r.doc_id: r for r in polish.polish(docs, lines.limit(0), outline, refs.limit(0)).collect()}
    assert bare[1][2:] == (8, 0, 0, 2, 0) and "❦\n\n· ·" in bare[1].text
    assert polish.polish(docs.limit(0), lines, outline, refs).count() == 0


def test_proposed_headings(spark):
    body = [(1, p, i, "plain words of a body line that goes on " * 3, 10.0, False, False, 12.0) for p in (1, 2) for i in (10, 11)]
    lines = spark.createDataFrame(
        [
            (1, 1, 1, "I", 10.0, False, True, None),
            (1, 1, 2, "Big", 18.0, True, False, 20.0),
            (1, 1, 3, "title", 18.2, True, False, 20.0),  # the same half points
            (1, 1, 4, "far", 18.0, True, False, 90.0),
            (1, 1, 5, "exact words here", 10.0, False, False, 12.0),
            (1, 2, 1, "large", 14.0, False, False, None),
            (1, 2, 2, "under", 14.0, False, False, None),  # an unknown distance isn't close
            (1, 2, 3, "words, and comma,", 18.0, True, False, 20.0),
            (1, 2, 4, None, 18.0, True, False, 20.0),
            *body,
        ],
        LINES,
    )
    outline = spark.createDataFrame([(1, 1, 1, "Chapter I", 0), (1, 1, 2, "Exact: words here!", 2), (1, 1, 3, "exact words here", 0), (1, 2, 4, "I", 0)], OUTLINE)
    got = [(r.page, r.line_no, r.level, r.text) for r in cleanup.proposed_headings(lines, outline).orderBy("page", "line_no").collect()]
    assert got == [(1, 1, 1, "I"), (1, 2, 1, "Big title"), (1, 4, 1, "far"), (1, 5, 3, "exact words here"), (2, 1, 2, "large"), (2, 2, 2, "under")]


def test_visible_text():
    assert readings.visible("# A *b* ![alt](x.png) [c](d) <b>e</b> <!-- f -->g") == "  A  b     c   e   g"
    assert readings.visible("a < b * c > d * e") == "a < b * c > d   e"
    assert readings.visible("1 <") == "1 <" and readings.visible("![open * end") == " " and readings.visible("x](open") == "x "
    assert readings.visible(None) is None and readings.visible("") == ""
    long = "<a " + "é" * 3000 + ">*"
    cut = len("<a ") + (4096 - 3) // 2 + 1  # the character that passes 4096 bytes is held, what follows is read anew
    assert readings.visible(long) == long[:cut] + long[cut:].replace(">", " ").replace("*", " ")
    fits = "<a " + "x" * 4093 + ">*"
    assert readings.visible(fits) == "  " and readings.visible("<a " + "x" * 4094 + ">*").endswith("x  ")


def test_cleaned_readings(spark):
    tag = "<img src='images/bbox_{}_10_1200_900.jpg'>"
    raw = f"<think>a\n\nb</think>\n\n one \n\n\n\n{tag.format(5)}{tag.format(5)}two{tag.format(980)}<table><tr><td>x|y</td></tr></table><think>open"
    want = "one\n\n[[figure:5,10,1000,900]]\n\ntwo\n\n| x\\|y |\n| --- |\n\n"
    assert readings.cleaned(raw) == want
    assert readings.cleaned(None) is None and readings.cleaned("") == "" and readings.cleaned("<img") == ""
    assert tables.tables_to_markdown("a<table></table><table><tr><td>b") == "a<table></table><table><tr><td>b"
    df = spark.createDataFrame([(want,), (None,)], "t string").select(readings.only_figures("t").alias("f"), readings.without_figures("t").alias("r"))
    one, null = df.collect()
    assert one.f == "[[figure:5,10,1000,900]]" and "figure" not in one.r and one.r.startswith("one\n\ntwo") and null == (None, None)


PIECES = "book long, page long, text string, left double, right double, center double, height double, size double, bold boolean"


def test_styled_lines(spark):
    def piece(text, left, right, center, size=10.0, bold=False, page=1):
        return (1, page, text, left, right, center, 10.0, size, bold)

    rows = [piece("Wide title over both", 200.0, 400.0, 800.0, 16.0, True)]
    for i in range(30):
        rows += [piece(f"left column row {i}", 50.0, 290.0, 780.0 - 12 * i), piece(f"right column row {i}", 310.0, 550.0, 781.0 - 12 * i)]
    rows += [piece("wide foot", 50.0, 550.0, 300.0)]
    rows += [piece("fake", 50.0, 80.0, 700.0, page=2), piece("fake", 50.4, 80.4, 700.0, page=2), piece("next", 84.0, 100.0, 700.2, page=2), piece("ed", 101.0, 110.0, 700.0, page=2)]
    rows += [piece("——", 50.0, 60.0, 500.0, page=2), piece(None, 1.0, 2.0, 3.0, page=2), (1, None, "x", 1.0, 2.0, 3.0, 1.0, 1.0, True)]
    got = geometry.styled_lines(spark.createDataFrame(rows, PIECES)).orderBy("page", "line_no").collect()
    first = [r for r in got if r.page == 1]
    assert [r.text for r in first] == ["Wide title over both", *(f"left column row {i}" for i in range(30)), *(f"right column row {i}" for i in range(30)), "wide foot"]
    assert [r.column for r in first] == [0] + [1] * 30 + [2] * 30 + [0]
    assert (first[0].size, first[0].bold, first[0].centered, first[0].gap_before) == (16.0, True, True, None)
    assert first[2].gap_before == 12.0 and not first[2].bold
    second = [r for r in got if r.page == 2]
    assert [(r.text, r.bold, r.column) for r in second] == [("fake nexted", True, 0)]
    assert geometry.styled_lines(spark.createDataFrame([], PIECES)).count() == 0
    fonts = spark.createDataFrame([("Arial-Bold", 400, False), ("x", 800, None), ("x", None, True), (None, None, None), ("Light", 600, False)], "f string, w int, r boolean")
    assert [r[0] for r in fonts.select(geometry.is_bold("f", "w", "r")).collect()] == [True, True, True, False, False]


def test_epub_editing(spark):
    bodies = ["<h1>Títle</h1><p>one &amp; <b>two</b></p><p>old — text</p><li><p>in</p></li><p><![CDATA[c]]></p><p> </p>", "<p>second</p>"]
    package = writers.epub_package("u", "T", "es", [("a", bodies[0]), ("b", bodies[1])])
    blocks = readers.chapter_blocks(readers.epub_chapters(package)[0][2])
    assert blocks == [("h1", "Títle", True), ("p", "one & two", False), ("p", "old — text", True), ("p", "in", True), ("p", "c", False)]
    packages = spark.createDataFrame([("a", package), ("b", package), ("n", None)], "id string, content binary")
    edits = spark.createDataFrame([("a", 0, 2, "new <x> & y"), ("a", 0, 0, "Tütle"), ("a", 1, 0, "2nd")], "id string, chapter int, block int, text string")
    got = {r.id: r.content for r in editing.edit_packages(packages, edits, "de").collect()}
    chapters = readers.epub_chapters(bytes(got["a"]))
    assert [b[1] for b in readers.chapter_blocks(chapters[0][2])] == ["Tütle", "one & two", "new <x> & y", "in", "c"]
    assert readers.chapter_blocks(chapters[1][2])[0][1] == "2nd" and got["n"] is None
    with zipfile.ZipFile(BytesIO(bytes(got["b"]))) as new, zipfile.ZipFile(BytesIO(package)) as old:
        assert [e.filename for e in new.infolist()] == [e.filename for e in old.infolist()]
        assert new.infolist()[0].compress_type == zipfile.ZIP_STORED
        changed = [n for n in old.namelist() if old.read(n) != new.read(n)]
        assert changed == ["book.opf"] and b"<dc:language>de</dc:language>" in new.read("book.opf")
    assert editing.chapter_language(b"<html lang='es' xml:lang=\"es\" x='1'><p lang='es'/>", "de") == b"<html lang='de' xml:lang=\"de\" x='1'><p lang='es'/>"
    for bad in ((0, 1), (0, 9), (7, 0)):
        with pytest.raises(ValueError):
            editing.edited(package, {bad: "x"})
    view = readers.epub_blocks(packages.where("content is not null"))
    assert {r.text for r in editing.chapter_view(view, 9).collect()} == {"second"} and editing.chapter_view(view, -1).where("chapter <> 0").count() == 0
    deep = b"<html>" + b"<div>" * 5000 + b"<p>x</p>" + b"</div>" * 5000 + b"</html>"
    assert readers.chapter_blocks(deep) == [("p", "x", True)]


def test_references_dropped(spark):
    docs = spark.createDataFrame([(1, "![a](x.png) b ![c [d](y.png) ![e](x.png)f"), (2, "![](z)"), (3, None)], "doc_id long, text string")
    gone = spark.createDataFrame([(1, "x.png"), (1, "q"), (3, "x")], "doc_id long, name string")
    assert {r.doc_id: r.text for r in images.drop_references(docs, gone).collect()} == {1: " b ![c [d](y.png) f", 2: "![](z)", 3: None}
    assert images.without_images("![a ![b](x) c](x) d](x)", ["x"]) == " d](x)" and images.without_images("](x) ![a](x)", ["x"]) == "](x) ![a](x)"
    assert [r[0] for r in docs.select(images.without_references("text")).collect()] == [" b  f", "", None]


def test_scanned_scores(spark):
    page = "book string, page int, text string"
    wanted = spark.createDataFrame([("b", p) for p in (1, 2, 3, 4)] + [("c", 1), ("d", 1)], "book string, page int")
    refs = spark.createDataFrame([("b", 1, "# One two 33"), ("b", 2, "cafe\u0301 *x*"), ("b", 4, "lost"), ("c", 1, ""), ("b", 9, "not asked for")], page)
    out = spark.createDataFrame([("b", 1, "two one 33"), ("b", 2, "caf\u00e9 x <b>y</b>"), ("b", 3, "more"), ("c", 1, "words")], page)
    got = {r.book: r for r in metrics.scanned_scores(wanted, refs, out).collect()}
    b = got["b"]
    assert (b.words_recall, b.words_precision, b.numbers_recall) == (1.0, 5 / 6, 1.0)
    assert b.order == pytest.approx((2 / 3 + 1) / 2) and b.cer == pytest.approx((6 / 10 + 2 / 6) / 2)
    assert b.notes == ["no reference of page 3", "the output marks no page 4"]
    assert got["c"][1:6] == (None,) * 5 and got["c"].notes == []
    assert got["d"][1:6] == (None,) * 5 and got["d"].notes == ["no reference of page 1"]


def test_conversion(spark):
    words = [f"word{i}" for i in range(40)]
    clear, garbled = " ".join(words), " ".join(words[:25] + [f"g{i}" for i in range(15)])
    md = f"![cover](c.png)\n\n<!-- page: 1 -->\n\n{clear}\n\n<!-- page: 2 -->\n\n{garbled}\n\n<!-- page: 3 -->\n\n{garbled}\n\n<!-- page: 2 -->\n\nagain"
    docs = spark.createDataFrame([(1, md, True), (2, md, False), (3, None, True)], "doc_id long, text string, scanned boolean")
    refs = spark.createDataFrame([(d, p, clear) for d in (1, 2) for p in (1, 2, 3)], REFS)
    better = " ".join(words[:25] + ["now"] * 5) + "\n\n[[figure:1,2,300,400]]"
    rereads = [(1, 1, "not asked", 5.0), (1, 2, f"{better} {' '.join(f'g{i}' for i in range(15))}", 5.0), (1, 3, "nothing alike", 400.0), (2, 2, "x", 1.0)]
    rereads = spark.createDataFrame(rereads, "book long, page int, text string, seconds double")
    ink = spark.createDataFrame([], "book long, page int, ink double")
    lines, outline = spark.createDataFrame([], LINES), spark.createDataFrame([], OUTLINE)
    got = {r.doc_id: r for r in conversion.convert(docs, lines, outline, refs, rereads, ink).collect()}
    assert got[1].reread == [2] and got[2].reread == [] and got[3].text is None and got[3].reread == []
    assert "now now" in got[1].text and "not asked" not in got[1].text and "nothing alike" not in got[1].text
    assert "c.png" not in got[1].text + got[2].text and got[1].text.endswith("<!-- page: 2 -->\n\nagain") and "now" not in got[2].text
    # a refused reading leaves its figures where they are expected
    pages = spark.createDataFrame([(1, 1, "kept words"), (1, 2, "same words here")], "book long, page int, text string")
    again = spark.createDataFrame([(1, 1, "other\n\n[[figure:1,2,300,400]]", 9e9), (1, 2, None, 1.0)], "book long, page int, text string, seconds double")
    full = {r.page: r for r in conversion.reread_pages(pages, again, refs, ink, full=True).collect()}
    assert full[1].text == "kept words\n\n[[figure:1,2,300,400]]" and not full[1].accepted and (full[2].text, full[2].accepted) == (None, False)
