"""Tests of findings of the reviews."""

import random
from collections import defaultdict

import duckdb
from pyspark.sql import functions as F

from quirework.functions import text as T
from quirework.operators import cleanup, polish, review, whole
from quirework.plans import composed


def test_hours_rounded_by_exact_value(spark):
    seconds = [5400, 5580, 5940, 46620, 419580, 6300, 8100, 900 + 7200, 9900, 3600 * 12345 + 2700, 2**40 * 180]
    sql = "select replace(printf('%.1f', unnest(?::bigint[]) / 3600), '.', ',') || ' h'"
    want = [r[0] for r in duckdb.execute(sql, [seconds]).fetchall()]
    rows = spark.createDataFrame(list(enumerate(seconds)), "i int, s long").select("i", T.duration_label("s").alias("label"))
    assert [r.label for r in rows.orderBy("i").collect()] == want
    assert want[2] == "1,6 h" and want[3] == "12,9 h"  # 1.65 and 12.95 are stored a little below
    assert spark.range(1).select(T.duration_label(F.lit(None)).alias("x")).first().x is None


def test_pages_compared_once(spark):
    blocks = spark.createDataFrame([("b", 1, 0, "Lost -x kept"), ("b", 1, 1, "kept kept"), ("b", 2, 0, "bare once")], "book string, page long, block int, text string")
    refs = spark.createDataFrame([("b", 1, "kept")], "book string, page long, text string")
    v = review.vocabulary(blocks)
    got = {r.page: r for r in review.compared(blocks, refs, v).collect()}
    assert (got[1].bare, got[1].lost) == (False, ["lost", "x"]) and [(w.block, w.x) for w in got[1].words] == [(0, ["lost"])]
    assert [(y.pos, y.word, y.next) for b in got[1].toks for y in b.x] == [(0, "lost", "x"), (1, "x", "kept")]
    assert got[2].bare and got[2].lost == [] and [y.word for b in got[2].toks for y in b.x] == ["bare", "once"]
    # a page that is handed over whole gives the same items as its blocks
    states = spark.createDataFrame([], "book string, page long, doubtful boolean, reread boolean")
    items = lambda *pages: sorted(map(str, review.review(blocks, refs, states, *pages).collect()))
    assert items(review.texts_of(blocks)) == items() != []


def test_compared_in_linear_time():
    words = [f"w{i}x" for i in range(60_000)]
    lost, found, _ = review.compare_page([(0, " ".join(words))], "other", [])
    assert len(lost) == len(found[0]["x"]) == 60_000
    many = review.glued_rests(words[:3000], [w + "and" for w in words[:3000]])
    assert len(many) == 3000 and many[0] == ("w0x", "and")


def test_polished_shuffles_nothing(spark, tmp_path):
    rows = [(1, "one\ntwo\nthree\nfour"), (2, None), (3, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    x = composed.polished(spark, str(tmp_path))
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
    got = {r.doc_id: r for r in x.collect()}
    assert got.keys() == {1, 3} and got[3].text == "<!-- page: 1 -->\n\n" and got[1].headings == 2
    assert got[1].text.startswith("<!-- page: 1 -->\n\n# one\n\n## two\n\n")


def test_whole_documents_by_the_same_rules(spark):
    pick = random.Random(5).choice
    texts = ["Head", "Head one", "Big Title", "a1 title,", "7", "8", "# #", "9 9", "§", "", " Ends ", "x y z", "words of a body line " * 4, "# " * 9 + "A", "1 " * 9 + "A", "# " * 20 + "A", None]
    lines, outline, blocks = [], [], []
    for book in range(60):
        for page in [None, *range(1, pick([2, 4, 9]))]:
            for n in range(1, pick([3, 5, 12])):
                size = pick([10.0, 10.0, 10.1, 9.4, 11.3, 18.0, 18.2, None])
                lines.append((book, page, n, pick(texts), size, pick([False, False, True, None]), pick([False, False, True]), pick([None, 12.0, 16.0, 17.0, 90.0])))
            outline += [(book, page, i, pick([*texts, "Chapter Head", "Ends"]), pick([0, 1, 5, None])) for i in range(pick([0, 0, 2]))]
        for page in range(pick([2, 3, 12, 40])):
            blocks += [(book, page, page * 100 + i, pick(["Running", "Running 7", "p 12", "p 3", "...", "", " ", "a|b", "long " * 9, f"text {chr(97 + page)}"])) for i in range(pick([0, 1, 3, 6]) + 1)]
    lines = spark.createDataFrame(lines, "book long, page long, line_no int, text string, size double, bold boolean, centered boolean, gap_before double")
    outline = spark.createDataFrame(outline, "book long, page long, ord int, title string, depth int")
    want = defaultdict(list)
    for r in cleanup.proposed_headings(lines, outline).collect():
        want[r.book].append(((r.page is not None, r.page), r.line_no, r.text, r.level))
    want = {b: [h[2:] for h in sorted(hs)] for b, hs in want.items()}
    marked = polish.gathered(lines, polish.line_marks(F.array(F.struct(*polish.LINE)))[0], "lines")
    given = marked.join(polish.gathered(outline, polish.outline_marks(F.struct(*polish.MARK)), "outline"), "doc_id", "left")
    for r in (r.asDict(True) for r in given.collect()):
        assert [(h["text"], h["level"]) for h in whole.proposed_headings(r["lines"], r["outline"])] == want.pop(r["doc_id"], [])
    assert not want
    frame = spark.createDataFrame(blocks, "book long, page long, pos long, text string")
    gone = {(r.book, r.pos) for r in cleanup.running_matter(frame).collect()}
    kept = frame.groupBy("book").agg(F.array_sort(F.collect_list(F.struct("pos", "page", "text"))).alias("x"))
    found = set()
    for r in kept.select("book", "x", polish.block_marks("x.text").alias("m")).collect():
        pages = defaultdict(list)
        for i, (x, m) in enumerate(zip(r.x, r.m, strict=True)):
            pages[x.page] += [i] if m.filled else []
        found |= {(r.book, r.x[i].pos) for i in whole.without_margins(list(pages.values()), [m.key for m in r.m])}
    assert found == gone != set()
