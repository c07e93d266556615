"""Core queries against DuckDB on the smallest tables, and operators on fixtures."""

import duckdb
import pytest
from pyspark.sql import functions as F

from quirework import catalog
from quirework.functions import maths
from quirework.functions import text as T
from quirework.operators import blocks as B
from quirework.operators import cleanup, doubt, headings, images, library, metrics, repair, review, tables, translation
from quirework.sources import readers, writers
from quirework.streaming import progress

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    if name not in catalog.ORACLES:
        assert got
        return
    out = con.execute(catalog.ORACLES[name])
    names = [x[0] for x in out.description]
    assert sorted(names) == cols
    assert got == sorted(repr(tuple(r[names.index(c)] for c in cols)) for r in out.fetchall())


def one(spark, **cols):
    names = list(cols)
    return spark.createDataFrame([tuple(cols.values())], ", ".join(f"{n} {'string' if isinstance(v, str) or v is None else 'long'}" for n, v in zip(names, cols.values(), strict=True)))


def value(spark, column, **cols):
    return one(spark, **cols).select(column.alias("v")).first().v


def test_scalar_functions(spark):
    v = lambda c, t: value(spark, c, t=t)
    assert v(T.tok_alnum("t"), "It's A-1 été!") == ["it", "s", "a", "1", "été"]
    assert v(T.key_cleanup("t"), " Page 12, of 134 ") == v(T.key_cleanup("t"), "page 9 of 7")
    assert v(T.key_heading("t"), "p 9") != v(T.key_heading("t"), "p 10")
    assert v(T.key_evaluation("t"), "Head 12") == v(T.key_evaluation("t"), "head 134")
    assert v(T.inline_marks("t"), "**a** *b* [c](d) `e`").asDict() == {"strong": 2, "under": 0, "code": 2, "links": 1, "open": 1, "close": 1, "odd": 0}
    assert v(T.link_targets("t"), "[a](b) ![c](d e)") == ["b", "d e"]
    assert v(T.strip_inline("t"), "**a** [b](c) _d") == "a b _d"
    assert v(T.xml_escape("t"), '<a b="&">') == "&lt;a b=&quot;&amp;&quot;&gt;"
    assert v(T.decimal_numbers("t"), "1,000.50 x 7") == ["1.000.50", "7"]
    assert [v(T.is_odd("t"), x) for x in ("m0rn1ng", "3rd", "1998", "A4", "x�", "word")] == [True, False, False, False, True, False]
    assert v(T.main_script("t"), "αβγ ab") == "greek" and v(T.main_script("t"), "12") is None
    assert v(T.supported("t"), "a/B.MD") and not v(T.supported("t"), "a.exe")
    assert v(T.contains_word("t", F.lit("in the")), "Rain; IN the_sun") and not v(T.contains_word("t", F.lit("ai")), "rain")
    assert v(T.excerpt("t"), "x " * 200).endswith("…")
    assert len(v(T.block_key("t"), " a ")) == 16 and v(T.block_key("t"), "a") == v(T.block_key("t"), "\na\n")


MD = "front\n\n<!-- page: 1 -->\n\n# One\n\nText that goes\n\n<!-- page: 2 -->\n\n![i](img/a.png)\n\non and on.\n\n# Two\n\n<!-- page: 3 -->\n\nLast."


def test_blocks(spark):
    docs = one(spark, doc_id=1, text=MD)
    parts = B.with_pages(B.blocks(docs)).cache()
    assert [(r.page, r.block) for r in B.numbered(parts).orderBy("pos").collect()] == [(None, 0), (1, 0), (1, 1), (2, 0), (2, 1), (3, 0)]
    assert {r.page: r.text for r in B.page_texts(parts).collect()}[3] == "Last."
    assert [r.text for r in B.only_pages(parts, 2, 2).where("not is_marker").orderBy("pos").collect()][-1] == "# Two"
    with pytest.raises(ValueError):
        B.only_pages(parts, 3, 2)
    assert "page:" not in B.without_markers(parts).first().text
    pair = B.continuations(parts).first()
    assert (pair.pos, pair.next_pos) == (3, 6)
    edits = spark.createDataFrame(
        [(1, 3, 0, parts.where("text = 'Last.'").select(T.block_key("text")).first()[0], "New.\n\n\nEnd"), (1, 1, 1, "stale", "No")],
        "doc_id long, page int, block int, key string, text string",
    )
    fixed = {r.text for r in B.correct_blocks(B.numbered(parts), edits).collect()}
    assert "New.\nEnd" in fixed and "No" not in fixed and "Last." not in fixed
    fenced = one(spark, doc_id=1, text="a\n\n```\nx\n\n# y\n```\n\nb")
    assert [r.text for r in B.fenced_blocks(fenced).orderBy("pos").collect()] == ["a", "```\nx\n\n# y\n```", "b"]
    book = one(spark, doc_id=1, text="intro\n# A\nx\n## A1\n# B\n```\n# no\n```\n| a | b |\n| - | - |\n| c | d |")
    lines = B.lines_of(book)
    assert B.split_levels(lines).first().split_level == 1
    assert {r.chapter for r in B.chapters(lines).collect()} == {0, 1, 2}
    assert {(r.title, r.is_title) for r in B.contents(lines).collect()} == {("A", True), ("A1", False), ("B", True)}
    assert B.structure(lines).first()[1:] == (3, 1, 0)
    shapes = [value(spark, B.shape("t"), t=t) for t in ("<!-- page: 2 -->", "```\nx", "![a](b)", "| a | b |\n| - | - |", "## x", "- a", "1. b", "plain")]
    assert shapes == ["page", "literal", "image", "table:2x2", "heading:2", "list", "list", "paragraph"]
    cut = value(spark, B.split_translation(F.split("t", " "), F.lit(1), F.lit(3)), t="a b c d e")
    assert (cut.first, cut.second) == ("a b", "c d e")


def test_running_matter(spark):
    rows = []
    for p in range(1, 7):
        for i, t in enumerate(("THE TITLE", f"unique {chr(96 + p)} first", "body", f"other {chr(104 + p)} last", f"{p * 7}")):
            rows.append(("b", p, i, t))
    df = spark.createDataFrame(rows, "book string, page long, pos int, text string")
    assert cleanup.running_matter(df).count() == 12
    assert cleanup.remove_running_matter(df).count() == 18
    assert cleanup.running_matter(df.where("page < 3")).count() == 0
    runs = spark.createDataFrame([("b", "k", p) for p in (1, 3, 5, 6, 8, 20)] + [("b", "l", p) for p in (1, 10, 20)], "book string, key string, page long")
    assert {r.key: r.run for r in cleanup.longest_runs(runs).collect()} == {"k": 5, "l": 1}
    refs = spark.createDataFrame([("b", 2, "文 x")], "book string, page long, text string")
    marks = spark.createDataFrame([("b", 1, 0, "文"), ("b", 1, 1, "§"), ("b", 1, 2, "12"), ("b", 2, 0, "文")], "book string, page long, pos int, text string")
    assert cleanup.ornaments(marks, refs).count() == 2 and cleanup.ornaments(marks, refs.limit(0)).count() == 0
    text = spark.createDataFrame(
        [("b", 1, 0, "it was ex- plained by stepping- stones and long- term plans"), ("b", 1, 1, "explained stones stepping long-term")],
        "book string, page long, pos int, text string",
    )
    assert {r.l: r.how for r in cleanup.hyphen_candidates(text).collect()} == {"ex": "joined", "stepping": "compound", "long": "compound"}


def test_doubt(spark):
    ink = spark.createDataFrame([("b", p, 0.03, 300) for p in range(10)] + [("b", 11, 0.25, 8), ("b", 12, 0.005, 0), ("b", 13, 0.09, 300)], "book string, page int, ink double, words int")
    assert {r.page for r in doubt.figure_pages(ink).collect()} == {11, 13}
    assert [value(spark, doubt.reread_budget(F.col("n")), n=n) for n in (1, 16, 88)] == [300, 320, 1760]
    facts = [("none", 30, 0.0)] * 10 + [("half", 30, 0.0)] * 5 + [("half", 0, 0.9)] * 5 + [("few", 30, None)] * 6 + [("few", 0, 0.8)] * 4 + [("blank", 0, 0.0)]
    df = spark.createDataFrame([(b, i, v, c) for i, (b, v, c) in enumerate(facts)], "book string, page int, visible_letters int, image_coverage double")
    assert {r.book: r.scanned for r in doubt.scanned_documents(df).collect()} == {"none": False, "half": True, "few": False, "blank": False}
    a = spark.createDataFrame([("b", 1, "one two " * 20), ("b", 2, "x")], "book string, page int, text string")
    got = {r.page: r.agreement for r in doubt.agreement(a, a, ["book", "page"]).collect()}
    assert got == {1: 1.0, 2: None}


def test_review(spark):
    rows = [("b", p, 0, "a m0rn1ng here") for p in range(1, 6)] + [("b", 6, 0, "str4ng3 here"), ("b", 6, 1, "plain here")]
    df = spark.createDataFrame(rows, "book string, page long, block int, text string")
    none = spark.createDataFrame([], "book string, page long, text string")
    states = spark.createDataFrame([("b", 1, True, False), ("b", 2, True, True), ("b", 3, False, False)], "book string, page long, doubtful boolean, reread boolean")
    items = review.review(df, none, states)
    first = review.ordered(items).collect()
    assert (first[0].page, first[0].block, first[0].risk) == (1, None, 3.0)
    assert [r.risk for r in first if r.reasons == "odd"] == [2.0] + [0.25] * 5
    d = spark.createDataFrame([("b", first[0].key, "correcto")], "book string, key string, decision string")
    assert review.review_counts(review.review_view(items, d)).first().pending == len(first) - 1
    words = spark.createDataFrame([("b", 1, 0, "morning " * 3 + "mourning mornin rnorning"), ("b", 1, 1, "through " * 3 + "thr ough")], "book string, page long, block int, text string")
    v = review.vocabulary(words)
    # a letter that is missing at the end is another form of the word, no error
    assert {r.word: (r.suggestion, r.strict) for r in review.looks_like(v).collect()} == {"mourning": ("morning", None)}
    assert review.split_suspects(words, v).first().suggestion == "through"
    broken = spark.createDataFrame([("b", 1, "half-\nway there")], "book string, page long, text string")
    assert "halfway" in {r.word for r in review.reference_words(broken).collect()}
    marked = spark.createDataFrame([("b", 1, "a\u00adb c-\nd-\ne x - y")], "book string, page long, text string")
    assert {r.word for r in review.reference_words(marked).collect()} == {"ab", "cd", "de"}


def test_suspects_by_precedence(spark):
    often = "through morning river bank the of them " * 5
    text = "thr ough moming rnorning riverbank ofthem throuh"
    df = spark.createDataFrame([("b", 1, 0, often), ("b", 1, 1, text), ("b", 2, 0, "throug moning")], "book string, page long, block int, text string")
    v = review.vocabulary(df)
    found = lambda refs: [(r.page, r.block, r.kind, r.found) for r in review.suspects(df, review.missing_words(df, refs, v), v).orderBy("page", "block", "pos").collect()]
    refs = spark.createDataFrame([("b", 1, often + " allmoming riverbank")], "book string, page long, text string")
    # "riverbank" stands in the reference, "moming" is no glued word there as "all" is not frequent
    assert found(refs) == [(1, 1, "split", "thr ough"), (1, 1, "alike", "throuh (through?)"), (2, 0, "alike", "moning (morning?)")]
    glued = spark.createDataFrame([("b", 1, often + " throuhof")], "book string, page long, text string")
    assert (1, 1, "alike", "throuh (through?)") not in found(glued) and (1, 1, "glued", "riverbank") in found(glued)
    none = refs.limit(0)
    assert (1, 1, "glued", "riverbank") in found(none)
    # without a reference only thin letters and confusions count: "h" is not thin, "r" is
    assert (1, 1, "alike", "throuh (through?)") not in found(none) and (2, 0, "alike", "moning (morning?)") in found(none)


def test_odd_tokens_and_symbols(spark):
    odd = lambda t, main=None: value(spark, T.is_odd("t", F.lit(main) if main else None), t=t)
    assert [odd(x) for x in ("wa5", "0f", "l1ne", "(19th)", "2º", "A25", "5a", "5x", "01st", "AB2", "a](u5)")] == [
        True, True, True, False, False, False, False, True, True, True, False,
    ]
    assert odd("слово", "latin") and not odd("слово", "cyrillic") and odd("word", "cyrillic") and not odd("word")
    df = spark.createDataFrame([("b", 1, 0, "a † b ‡ †"), ("b", 2, 0, "x ‡")], "book string, page long, block int, text string")
    refs = spark.createDataFrame([("b", 1, "a b"), ("b", 0, "†")], "book string, page long, text string")
    assert [(r.page, r.token) for r in review.lone_symbols(df, refs).collect()] == [(1, "‡")]
    assert [(r.n, r.risk) for r in review.odd_risks(df, refs).collect()] == [(1, 2.0)]


def test_translation(spark):
    pairs = [("one two three four five", "one two three four five", "untranslated"), ("a text of twenty characters", "x", "length"), ("abc", " ", "empty"), ("abc", "xyz", None)]
    for s, t, doubt_ in pairs:
        assert value(spark, translation.judged(F.col("s"), F.col("t")), s=s, t=t) == doubt_
    lost = lambda s, t: value(spark, translation.lost_numbers(F.col("s"), F.col("t")), s=s, t=t)
    assert lost("in 1998 and 7, 7", "7 in") == ["1998", "7"] and lost("1,000.50", "1.000,50") == []
    units = spark.createDataFrame([(1, "first **text** 12"), (2, "second")], "id int, text string")
    first = translation.translate(units, lambda s: s.str.upper().str.replace("*", ""), "m1")
    assert {r.id: (r.doubt, r.cached) for r in first.collect()} == {1: ("formatting_lost", False), 2: (None, False)}
    again = translation.translate(units, lambda s: s.str.upper(), "m1", first)
    assert {r.cached for r in again.collect()} == {True}
    assert {r.cached for r in translation.translate(units, lambda s: s.str.upper(), "m2", first).collect()} == {False}
    good = spark.createDataFrame([(0, "a = b"), (1, ""), (2, "c=d = e")], "ord int, value string")
    assert {(r.source, r.target) for r in translation.parse_glossary(good).collect()} == {("a", "b"), ("c", "d = e")}
    with pytest.raises(ValueError):
        translation.parse_glossary(spark.createDataFrame([(0, "only")], "ord int, value string"))


def test_metrics(spark):
    assert metrics.lcs_length("a b c d".split(), "b c d a".split()) == 3
    assert metrics.lcs_length([], ["x"]) == 0
    assert value(spark, metrics.char_error_rate("r", "o"), r="casa", o="cosa") == 0.25
    assert value(spark, metrics.char_error_rate("r", "o"), r="", o="x") == 1.0
    a = spark.createDataFrame([("b", "x", "1"), ("b", "x", "1"), ("b", "y", "2")], "book string, id string, m string")
    assert metrics.new_findings(a.limit(1), a, ["book", "id", "m"]).count() == 2
    m = spark.createDataFrame([("a", "00"), ("b", "11"), ("c", "22")], "path string, sha256 string")
    f = spark.createDataFrame([("a", "00"), ("b", "99")], "path string, sha256 string")
    assert {r.path: r.status for r in metrics.verified(m, f).collect()} == {"a": "ok", "b": "different", "c": "missing"}
    p = spark.createDataFrame([("k", 1, "same words", "same words"), ("l", 1, "abc", "xyz")], "k string, id int, reference string, output string")
    assert {r.k: round(r.chrf, 6) for r in metrics.chrf(p, ["k"]).collect()} == {"k": 100.0, "l": 0.0}


def test_tables_and_images(spark):
    html = "<table><tr><td rowspan=2>a|b</td><td colspan=2>c<br>d</td></tr><tr><td>e</td></tr></table>"
    assert tables.table_rows(html) == [["a|b", "c d", ""], ["", "e"]]
    md = spark.createDataFrame([(tables.table_rows(html),)], "r array<array<string>>").select(tables.pipe_table(F.col("r"))).first()[0]
    assert md == "| a\\|b | c d |  |\n| --- | --- | --- |\n|  | e |  |"
    refs = spark.createDataFrame([(1, p, i, n) for i, (p, n) in enumerate([(1, "logo"), (2, "logo"), (3, "logo"), (1, "icon"), (1, "page"), (2, "fig"), (2, "mask"), (3, "fill")])], "doc_id int, page int, ord int, name string")
    facts = spark.createDataFrame(
        [(1, "logo", 90, 90, "h1", False, False), (1, "icon", 32, 32, "h2", False, False), (1, "page", 1000, 1400, "h3", False, False),
         (1, "fig", 300, 200, "h4", False, False), (1, "mask", 300, 200, "h5", False, True), (1, "fill", 300, 300, "h6", True, False)],
        "doc_id int, name string, width int, height int, content_hash string, uniform boolean, grayscale boolean",
    )
    words = spark.createDataFrame([(1, 1, 300), (1, 2, 10), (1, 3, 5)], "doc_id int, page int, words int")
    gone = images.rejected(refs, facts, words)
    assert {r.name: r.why for r in gone.collect()} == {"logo": "repeated", "icon": "tiny", "page": "background", "mask": "mask", "fill": "uniform"}
    assert [r.name for r in images.kept_references(refs, gone).collect()] == ["fig"]
    pieces = spark.createDataFrame([(1, 1, 100.0, 10.0, 50.0, 60.0, "b", 10.0), (1, 1, 101.0, 10.0, 10.0, 40.0, "a", 10.0), (1, 1, 80.0, 10.0, 10.0, 20.0, "c", 10.0)], "doc_id int, page int, center double, height double, left double, right double, text string, size double")
    assert [r.text for r in images.joined_pieces(images.bands(pieces)).orderBy("band").collect()] == ["a b", "c"]


def test_library_and_progress(spark):
    lib = spark.createDataFrame([("a", "A", "/a", 1, True, "2020")], "id string, name string, path string, pages int, visual_full boolean, added_at string")
    new = spark.createDataFrame([("a", "A2", "/a2", 9, "2021"), ("b", "B", "/b", 2, "2021")], "id string, name string, path string, pages int, added_at string")
    got = {r.id: r for r in library.upsert_documents(lib, new).collect()}
    assert (got["a"].name, got["a"].pages, got["a"].visual_full, got["a"].added_at) == ("A2", 1, True, "2020") and not got["b"].visual_full
    d = spark.createDataFrame([("a", "k", "despues", 1), ("a", "k", "correcto", 2)], "doc_id string, key string, decision string, decided_at int")
    assert library.decided(d).first().decision == "correcto"
    kept, left = library.remove_documents(lib, d, lib.select("id"))
    assert kept.count() == left.count() == 0
    names = spark.createDataFrame([("vol 10",), ("vol 9",), ("Ácaro",)], "name string")
    assert [r.name for r in names.orderBy(library.natural_key("name")).collect()] == ["Ácaro", "vol 9", "vol 10"]
    assert library.found(names, "acaro").count() == 1
    records = spark.createDataFrame([("i", 1, 1, 0.5), ("other", 1, 2, 0.5), ("i", 1, None, None)], "identity string, doc_id int, page int, seconds double")
    usable = progress.usable_records(records, "i")
    pages = spark.createDataFrame([(1, 1), (1, 2)], "doc_id int, page int")
    assert [r.page for r in progress.remaining(pages, usable).collect()] == [2]


def test_streamed_states(spark, tmp_path):
    schema = "event_id long, id long, state string, ts timestamp"
    rows = [(i, i % 3, f"s{i}", f"2024-01-01 00:{i:02d}:00") for i in range(9)]
    spark.createDataFrame(rows, "event_id long, id long, state string, ts string").selectExpr("event_id", "id", "state", "cast(ts as timestamp) ts").write.parquet(str(tmp_path / "in"))
    s = progress.latest_states(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = s.writeStream.format("memory").queryName("states").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert {r.id: r.state for r in spark.table("states").collect()} == {0: "s6", 1: "s7", 2: "s8"}


def test_epub_round_trip(spark):
    rows = [("d", "Title & Co", "en", 0, "One", "<h1>One</h1><p>First &amp; <em>last</em></p>"), ("d", "Title & Co", "en", 1, "Two", "<ul><li><p>x</p></li></ul>")]
    made = writers.epubs(spark.createDataFrame(rows, "id string, title string, language string, ord int, chapter string, body string"))
    got = [(r.chapter, r.block, r.tag, r.text, r.editable) for r in readers.epub_blocks(made).orderBy("chapter", "block").collect()]
    assert got == [(0, 0, "h1", "One", True), (0, 1, "p", "First & last", False), (1, 0, "p", "x", True)]
    assert value(spark, readers.normalized_markers("t"), t="a\r\n<!-- page: 1 --> b") == "a\n\n<!-- page: 1 -->\n\nb"
    assert tuple(value(spark, readers.page_range(F.lit(0), F.lit(50), F.lit(10)), t="")) == (1, 10)


def test_simple_formulas():
    assert maths.math_html("C_6H_{12}O_6") == "C<sub>6</sub>H<sub>12</sub>O<sub>6</sub>"
    assert maths.math_html(r"\text{m}^{a_{b}}\,\cdot 2") == "m<sup>a<sub>b</sub></sup> · 2"
    assert maths.math_html("x^+") == "x<sup>+</sup>"
    for bad in (r"\sqrt{2}", "{a", "a}", "", "  ", "a<b", "a_", "a__b", r"a_\cdot", "\\", None):
        assert maths.math_html(bad) is None


def test_headings_applied_in_order():
    h = lambda *x: [{"text": t, "level": n} for t, n in x]
    apply = headings.apply_headings
    # a short title needs the whole block; a long one splits its block
    assert apply("I came.\r\n\r\nI\r\n\r\nThe *Sea*: it is wide.", h(("I", 1), ("THE SEA", 2))) == (
        "I came.\n\n# I\n\n## The Sea:\n\nit is wide."
    )
    # spacing differs, a later title stands earlier, headings and comments stay
    assert apply("Last Part\n\n<!-- page: 1 -->\n\n# Heart\n\nH EA RT *soft*", h(("Heart", 2), ("Last part", 1), ("none here", 1))) == (
        "# Last Part\n\n<!-- page: 1 -->\n\n# Heart\n\n## H EA RT\n\n*soft*"
    )
    # the rest may be a title too
    assert apply("Part One Chapter Two text", h(("Part One", 1), ("Chapter Two", 2))) == "# Part One\n\n## Chapter Two\n\ntext"
    assert apply(None, h(("a", 1))) is None and apply("x", None) == "x" and apply("", h(("", 1), (None, 1))) == ""


def test_headings_with_nulls_in_columns(spark):
    x = spark.createDataFrame(
        [(1, "Alpha beta", [("alpha", 1)]), (2, None, [("alpha", 1)]), (3, "Alpha", None)],
        "id int, text string, headings array<struct<text string, level int>>",
    )
    assert [r.text for r in headings.with_headings(x).orderBy("id").collect()] == ["# Alpha\n\nbeta", None, "Alpha"]


def test_dashes_restored(spark):
    def fix(text, reference):
        x = spark.createDataFrame([("b", 1, text)], "book string, page int, text string")
        y = spark.createDataFrame([("b", 1, reference)], "book string, page int, text string")
        r = repair.restore_dashes(x, y).first()
        return r.text, r.restored

    assert fix("a lamp flickermay go", "a lamp flicker—may go") == ("a lamp flicker—may go", 1)
    assert fix("long ago we met", "long ago — we met") == ("long ago — we met", 1)
    assert fix("since you and me", "since—you and me") == ("since—you and me", 1)
    assert fix("end of it", "end—\nof it") == ("end—of it", 1)
    assert fix("stop\n\n“now", "stop—“now") == ("stop—\n\n“now", 1)
    assert fix("no no no", "no—no—no") == ("no—no—no", 2)
    # dashed already, ambiguous, doubled, part of a longer word, nulls
    for text, reference in (("a—b", "a—b"), ("a b and a b", "a—b"), ("a b", "a——b"), ("xa b", "a—b"), (None, "a—b"), ("a b", None), ("", "a—b")):
        assert fix(text, reference) == (text, 0)


def test_hyphens_joined(spark):
    fix = repair.joined
    assert fix("It ex- plained\nstepping- stones; stepping stones") == ("It explained\nstepping-stones; stepping stones", 2)
    assert fix("a long- term plan, long-term") == ("a long-term plan, long-term", 1)
    assert fix("the wa-\n\n<!-- page: 2 -->\n\nter runs") == ("the water\n\n<!-- page: 2 -->\n\nruns", 1)
    for text in ("well-known", "| ex- plained |", "```\nex- plained\n```", "Anglo- Saxon", "a- side", "", "- item"):
        assert fix(text) == (text, 0)
    x = spark.createDataFrame([(1, None, "k"), (2, "ex- plain", "k")], "id int, text string, joined string")
    assert [(r.text, r.joined) for r in repair.join_hyphens(x).orderBy("id").collect()] == [(None, 0), ("explain", 1)]
