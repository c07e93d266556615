"""Queries of the library, review lists, doubt, margins and small functions.

The library's documents are the rows of ``documents``; what else an operator
needs is made from their columns by fixed rules.  Each query has its SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.functions import text as T
from quirework.operators import cleanup, doubt, images, library, metrics, review, translation
from quirework.plans.standard import EDGES, KEY_EVAL, LINES, STYLED, TRIM, WORDS, lines, pages, query, read, styled
from quirework.sources import readers


def shelf(spark, sf_dir) -> DataFrame:
    """The library: every third document is missing."""
    d = read(spark, sf_dir, "documents").where("doc_id % 3 <> 0")
    return d.select(
        F.col("doc_id").alias("id"), F.concat("source", F.lit(" "), "doc_id").alias("name"), F.concat(F.lit("/a/"), "doc_id").alias("path"),
        (F.col("doc_id") % 40).alias("pages"), (F.col("doc_id") % 5 == 0).alias("visual_full"), (F.col("doc_id") % 17).alias("added_at"),
    )


SHELF = """
sh as (select doc_id as id, source || ' ' || doc_id as name, '/a/' || doc_id as path, doc_id % 40 as pages, doc_id % 5 = 0 as visual_full, doc_id % 17 as added_at
  from documents where doc_id % 3 <> 0)"""


@query(
    f"with {SHELF}, ad as (select doc_id as id, 'new ' || doc_id as name, '/b/' || doc_id as path, 7::bigint as pages, 99::bigint as added_at from documents where doc_id % 2 = 0) "
    "select id, coalesce(ad.name, sh.name) as name, coalesce(ad.path, sh.path) as path, coalesce(sh.pages, ad.pages) as pages, "
    "coalesce(visual_full, false) as visual_full, coalesce(sh.added_at, ad.added_at) as added_at from sh full join ad using (id)"
)
def library_upsert(spark, sf_dir):
    d = read(spark, sf_dir, "documents").where("doc_id % 2 = 0")
    added = d.select(
        F.col("doc_id").alias("id"), F.concat(F.lit("new "), "doc_id").alias("name"), F.concat(F.lit("/b/"), "doc_id").alias("path"),
        F.lit(7).cast("long").alias("pages"), F.lit(99).cast("long").alias("added_at"),
    )
    return library.upsert_documents(shelf(spark, sf_dir), added)


def decisions(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("page:"), "quality").alias("key"), F.col("toxic").alias("decision"))


@query(
    f"with {SHELF}, g as (select doc_id from documents where doc_id % 10 = 1) "
    "select 'document' as kind, id from sh where id not in (select doc_id from g) "
    "union all select 'decision', doc_id from labels where doc_id not in (select doc_id from g)"
)
def library_remove(spark, sf_dir):
    """What is left when every tenth document goes, with its decisions."""
    gone = read(spark, sf_dir, "documents").where("doc_id % 10 = 1").select(F.col("doc_id").alias("id"))
    left, kept = library.remove_documents(shelf(spark, sf_dir), decisions(spark, sf_dir), gone)
    return left.select(F.lit("document").alias("kind"), "id").unionAll(kept.select(F.lit("decision").alias("kind"), F.col("doc_id").alias("id")))


@query(
    "select doc_id, 'page:' || quality as key, toxic as decision from labels where doc_id not in (select doc_id from documents where source = "
    "(select min(source) from documents))"
)
def decisions_cleared(spark, sf_dir):
    """Decisions without those of one source's documents."""
    d = read(spark, sf_dir, "documents")
    one = d.agg(F.min("source").alias("source"))
    docs = d.join(one, "source", "left_semi").select(F.col("doc_id").alias("id"))
    return library.without_decisions(decisions(spark, sf_dir), docs)


@query(f"with {SHELF} select id, name, added_at, case when id = 7 then true else visual_full end as visual_full from sh")
def library_option(spark, sf_dir):
    """The library in its order, with an option set for one document."""
    changed, _ = library.set_option(shelf(spark, sf_dir), 7, True)
    return library.listed(changed).select("id", "name", "added_at", "visual_full")


@query(
    f"with {SHELF}, r as (select distinct doc_id as id from labels), t as (select user_id as id, string_agg(distinct event_type, ',' order by event_type) as tasks from events group by all), "
    "n as (select conv_id as id, count(*) as translations from conversations group by all), "
    "v as (select doc_id as id, len(string_split(text, chr(10))) as items, len(list_filter(string_split(text, chr(10)), lambda x: length(x) > 80)) as pending from documents where text is not null) "
    "select sh.*, r.id is not null as converted, coalesce(tasks, '') as tasks, coalesce(translations, 0) as translations, coalesce(items, 0)::bigint as items, coalesce(pending, 0)::bigint as pending "
    "from sh left join r using (id) left join t using (id) left join n using (id) left join v using (id)"
)
def document_view(spark, sf_dir):
    running = read(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("task"))
    done = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"))
    ls = F.split("text", "\n")
    reviews = read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.size(ls).cast("long").alias("items"), F.size(F.filter(ls, lambda x: F.length(x) > 80)).cast("long").alias("pending")
    )
    results = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    return library.document_view(shelf(spark, sf_dir), results, running, done, reviews.where("items >= 0"))


@query(
    f"with {SHELF}, k as (select id, name, case when id % 4 = 0 then null else id % 3 end as pending, regexp_extract_all(lower(name), '[0-9]+|[^0-9]+') as p from sh) "
    "select id, name, array_to_string(list_transform(p, lambda x: case when regexp_matches(x, '[0-9]') then lpad(x, 12, '0') else x end), '') as key, "
    "case when id % 2 = 1 then 'convert' when pending > 0 then 'review' when id % 3 = 1 then 'export' else 'done' end as step from k"
)
def library_order(spark, sf_dir):
    """Natural sort keys and the next step of each document."""
    view = shelf(spark, sf_dir).select(
        "id", "name", library.natural_key("name").alias("key"), (F.col("id") % 2 == 0).alias("converted"),
        F.when(F.col("id") % 4 != 0, F.col("id") % 3).alias("pending"), (F.col("id") % 3 != 1).alias("exported"),
    )
    return library.next_step(view).select("id", "name", "key", "step")


@query(
    "select label from (select p_name as label, not starts_with(lower(p_name), 'b') as later from part where contains(lower(p_name), 'b')) order by later, label limit 60"
)
def palette(spark, sf_dir):
    """The sixty entries that a search shows."""
    return library.palette(read(spark, sf_dir, "part").select(F.col("p_name").alias("label")), "B").select("label")


@query("select source, lang, n_chars % 10 as kind from documents except all select source, lang, n_chars % 10 from documents where doc_id % 2 = 0")
def new_findings(spark, sf_dir):
    x = read(spark, sf_dir, "documents").withColumn("kind", F.col("n_chars") % 10)
    return metrics.new_findings(x.where("doc_id % 2 = 0"), x, ["source", "lang", "kind"])


@query(
    "select doc_id as path, case when doc_id % 5 = 0 then 'missing' when doc_id % 5 = 1 then 'different' else 'ok' end as status from documents where text is not null"
)
def verified_files(spark, sf_dir):
    d = read(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("path"), "text")
    files = d.where("path % 5 <> 0").select(
        "path", F.upper(F.sha2(F.when(F.col("path") % 5 == 1, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256)).alias("sha256")
    )
    return metrics.verified(d.select("path", F.sha2("text", 256).alias("sha256")), files).select("path", "status")


@query(
    "with c as (select lang as book, doc_id as ord, split_part(text, chr(10), 1) as title from documents where text is not null and lang in ('en', 'de') and doc_id % 9 = 0), "
    "o as (select lang as book, doc_id as ord, source as title from documents) "
    f"select book, ord, {TRIM.format('title')} as title from c where {TRIM.format('title')} <> '' union all select * from o where book is null or book not in (select book from c)"
)
def expected_titles(spark, sf_dir):
    d = read(spark, sf_dir, "documents").withColumnsRenamed({"lang": "book", "doc_id": "ord"})
    curated = d.where("book in ('en', 'de') and ord % 9 = 0 and text is not null").select("book", "ord", F.split("text", "\n")[0].alias("title"))
    return metrics.expected_titles(curated, d.select("book", "ord", F.col("source").alias("title")))


RIGHT = "regexp_replace(text, '(^|[^\\p{L}\\p{N}])(of|der|que|les)([^\\p{L}\\p{N}]|$)', '\\1 \\3', 'g')"


@query(
    f"with {LINES}, w as (select book, page, pos, unnest({WORDS}) as word from l), "
    f"r as (select distinct book, page, unnest({WORDS}) as word from (select lang as book, doc_id as page, {RIGHT} as text from documents)) "
    "select distinct w.book, w.page, w.pos::int as block from w where not exists (from r where r.book = w.book and r.page = w.page and r.word = w.word)"
)
def erroneous_blocks(spark, sf_dir):
    """Blocks with a word that the transcription (some words less) hasn't."""
    right = pages(spark, sf_dir).withColumn("text", F.regexp_replace("text", r"(^|[^\p{L}\p{N}])(of|der|que|les)([^\p{L}\p{N}]|$)", "$1 $3"))
    return review.erroneous_blocks(lines(spark, sf_dir).withColumnRenamed("pos", "block"), right)


VIEW = """
vw as (select lang as book, doc_id as page, case when doc_id % 6 = 0 then null else doc_id % 4 end as block, 'k' || doc_id as key, (doc_id % 13 + 0.5)::double as risk,
  case doc_id % 3 when 0 then null when 1 then 'despues' else 'correcto' end as decision from documents where lang is not null)"""


def view(spark, sf_dir) -> DataFrame:
    i = F.col("doc_id")
    items = read(spark, sf_dir, "documents").where("lang is not null").select(
        F.col("lang").alias("book"), i.alias("page"), F.when(i % 6 != 0, i % 4).alias("block"), F.concat(F.lit("k"), i).alias("key"), (i % 13 + F.lit(0.5)).alias("risk")
    )
    made = items.where("page % 3 <> 0").select("book", "key", F.when(F.col("page") % 3 == 1, "despues").otherwise("correcto").alias("decision"))
    return review.review_view(items, made)


@query(
    f"with {VIEW}, p as (select *, max(risk) over (partition by book) as top from vw where decision is null or decision = 'despues') "
    "select book, page, block, risk, greatest(1, floor(3 * risk / greatest(1.0, top) + 0.5))::int as dots from p"
)
def review_queue(spark, sf_dir):
    return review.queue(view(spark, sf_dir), "pending").select("book", "page", "block", "risk", "dots")


@query(
    f"with {VIEW} select book, count(*) as items, count(*) filter (where decision = 'correcto') as decided, "
    "floor(100 * coalesce(sum(risk) filter (where decision is null or decision = 'despues'), 0) / sum(risk) + 0.5)::int as share from vw group by book"
)
def review_progress(spark, sf_dir):
    return review.progress(view(spark, sf_dir))


@query(f"with {VIEW} select distinct book, page, block from vw")
def flagged(spark, sf_dir):
    """Flagged blocks, and flagged pages with no block."""
    blocks, whole = review.flagged(view(spark, sf_dir))
    return blocks.unionByName(whole.withColumn("block", F.lit(None).cast("long")))


@query(
    "select doc_id, case doc_id % 5 when 0 then 'Words that the source text doesn''t have: ' || a when 1 then 'Odd characters or words: ' || a when 2 then 'Possible reading errors: ' || a "
    "when 3 then 'Doubtful page, not read again' else 'Page read again by the visual model: compare it with the original' end as said from "
    "(select doc_id, lang || ', ' || source as a from documents)"
)
def reason_texts(spark, sf_dir):
    kinds = F.array(*(F.lit(x) for x in ("unsupported", "odd", "suspect", "doubtful", "reread")))
    x = read(spark, sf_dir, "documents")
    return x.select("doc_id", review.reason_text(F.get(kinds, (F.col("doc_id") % 5).cast("int")), F.array("lang", "source")).alias("said"))


@query(
    f"with {LINES}, f as (select book, page, pos, text || ' †‡† ☞' as t, case when page % 2 = 0 then text || '†' else text end as ref from l where text is not null), "
    "c as (select book, page, pos, ref, list_distinct(string_split(t, '')) as cs from f) "
    "select book, page, pos::int as pos, array_to_string(list_sort(list_filter(cs, lambda x: not contains(ref, x) and not "
    "regexp_matches(x, '[\\p{L}\\p{N}\\s!-/:-@\\[-`{-~«»“”‘’—–…·•°%€£§¶©®™¿¡]'))), '') as symbols from c"
)
def foreign_symbols(spark, sf_dir):
    x = lines(spark, sf_dir).where("text is not null")
    ref = F.when(F.col("page") % 2 == 0, F.concat("text", F.lit("†"))).otherwise(F.col("text"))
    found = T.foreign_symbols(F.concat("text", F.lit(" †‡† ☞")), ref)
    return x.select("book", "page", "pos", F.array_join(F.array_sort(found), "").alias("symbols"))


@query("select doc_id, " + TRIM.format("replace(text, '<<', '')") + " as text from documents where text is not null")
def cleaned_output(spark, sf_dir):
    """Texts within terminal codes, taken out again."""
    esc = "\u001b"
    t = F.concat(F.lit(f"{esc}[31m "), F.replace("text", F.lit("<<"), F.lit("")), F.lit(f" {esc}[0;1m[end of text]\n"))
    return read(spark, sf_dir, "documents").where("text is not null").select("doc_id", T.clean_output(t).alias("text"))


@query(
    "with n as (select doc_id, doc_id % 1300 as a, (doc_id * 7) % 1300 as b, (doc_id * 13) % 1300 as c, (doc_id * 3) % 1300 as d from documents), "
    "m as (select doc_id, least(a, 1000)::int as l, least(b, 1000)::int as t, least(c, 1000)::int as r, least(d, 1000)::int as o from n) "
    'select doc_id, l as "left", t as top, r as "right", o as bottom from m where r >= l + 40 and o >= t + 40'
)
def figure_boxes(spark, sf_dir):
    i = F.col("doc_id")
    side = lambda k: (i * k % 1300).cast("string")
    tag = F.concat(F.lit('<img src="images/bbox_'), side(1), F.lit("_"), side(7), F.lit("_"), side(13), F.lit("_"), side(3), F.lit('.jpg">'))
    return read(spark, sf_dir, "documents").select("doc_id", T.figure_box(tag).alias("x")).where("x is not null").select("doc_id", "x.*")


@query(
    "with f as (select doc_id, 'a.b' || doc_id || (case doc_id % 4 when 0 then '.MARKDOWN' when 1 then '.htm' when 2 then '.Pdf' else '.epub' end) as name, "
    "case when doc_id % 7 = 0 then doc_id * 37 else doc_id % 6000 end as s from documents) "
    "select doc_id, case doc_id % 4 when 0 then 'md' when 1 then 'html' when 2 then 'pdf' else 'epub' end as format, 'a.b' || doc_id as stem, "
    "case when s < 90 then greatest(1, s) || ' s' when s < 5400 then floor(s / 60 + 0.5)::bigint || ' min' else replace(printf('%.1f', s / 3600), '.', ',') || ' h' end as duration, "
    "case when doc_id * 997 >= 10000 then replace(format('{:,}', doc_id * 997), ',', '.') else (doc_id * 997)::varchar end || (case when doc_id * 997 = 1 then ' page' else ' pages' end) as pages, "
    "case when doc_id % 4 = 3 then null else null end::varchar as media from f"
)
def labels_shown(spark, sf_dir):
    """Format, stem, duration and number labels."""
    i = F.col("doc_id")
    ext = F.when(i % 4 == 0, ".MARKDOWN").when(i % 4 == 1, ".htm").when(i % 4 == 2, ".Pdf").otherwise(".epub")
    x = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("a.b"), i, ext).alias("name"), F.when(i % 7 == 0, i * 37).otherwise(i % 6000).alias("s"))
    return x.select(
        "doc_id", T.format_of("name").alias("format"), T.stem("name").alias("stem"), T.duration_label("s").alias("duration"),
        T.plural(i * 997, "page", "pages").alias("pages"), T.media_type("name").alias("media"),
    )


@query(
    "with w as (select doc_id, text, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) as words from documents where text is not null), "
    "t as (select *, least(6144, greatest(64, words * 4)) as tokens from w) "
    "select doc_id, tokens::int as tokens, greatest(8192, least(16384, ceil((strlen(text) // 3 + 400 + tokens) / 1024) * 1024))::int as context, "
    "greatest(120, words * 2)::int as seconds, least(4096, greatest(1024, words * 6))::int as reread, 'data:image/png;base64,' || to_base64(encode(left(text, 50))) as uri from t"
)
def model_limits(spark, sf_dir):
    x = read(spark, sf_dir, "documents").where("text is not null").withColumn("x", T.translation_limits("text", 8192, 16384))
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    uri = T.data_uri(F.lit("a/b.PNG"), F.substring("text", 1, 50).cast("binary"))
    return x.select("doc_id", "x.tokens", "x.context", "x.seconds", T.reread_tokens(words).alias("reread"), F.replace(uri, F.lit("\r\n"), F.lit("")).alias("uri"))


INK = "ik as (select lang as book, doc_id as page, (doc_id * 31 % 100) / 1000.0::double as ink, length(text) // 7 as words from documents where text is not null)"


@query(
    f"with {INK}, m as (select book, list_sort(list(ink / words) filter (where words >= 50)) as x from ik group by book) "
    "select ik.book, page from ik join m on m.book = ik.book where ink > 0.02::double and ink > 2.5::double * (x[len(x) // 2 + 1] * greatest(words, 20))"
)
def figure_pages(spark, sf_dir):
    """Pages whose ink is over what their words explain."""
    return doubt.figure_pages(ink(spark, sf_dir)).select("book", "page")


def ink(spark, sf_dir) -> DataFrame:
    x = read(spark, sf_dir, "documents").where("text is not null")
    return x.select(
        F.col("lang").alias("book"), F.col("doc_id").alias("page"), (F.col("doc_id") * 31 % 100 / F.lit(1000.0)).alias("ink"), F.floor(F.length("text") / 7).alias("words")
    )


@query(
    f"with {INK}, m as (select book, list_sort(list(ink / words) filter (where words >= 50)) as x from ik group by book) "
    "select ik.book, page from ik join m on m.book = ik.book where ink > 0.02::double and ink > 2.5::double * (x[len(x) // 2 + 1] * greatest(words, 20)) "
    "union select lang, doc_id from documents where doc_id % 8 = 3 and lang is not null"
)
def pages_to_reread(spark, sf_dir):
    doubtful = pages(spark, sf_dir).where("page % 8 = 3 and book is not null")
    return doubt.pages_to_reread(doubtful, doubt.figure_pages(ink(spark, sf_dir)))


@query(
    "with l as (select doc_id // 10 as book, doc_id as page, text from documents), "
    "v as (select book, page, sum(length(regexp_replace(t, '[^\\p{L}\\p{N}]', '', 'g'))) as n from (select book, page, unnest(string_split(left(text, doc_id_len), chr(10))) as t from "
    "(select *, case when page % 2 = 0 then 10 else 10000000 end as doc_id_len from l)) group by all), "
    "i as (select book, page, max((page * k) % 700 * 900.0::double) as a from l, (values (3), (5)) t(k) where page % 4 <> 0 group by all), "
    "f as (select l.book, coalesce(n, 0) >= 20 as t, coalesce(a, 0) / 540000 >= 0.5::double as c from l left join v using (book, page) left join i using (book, page)), "
    "s as (select book, count(*) filter (where t) as text_pages, count(*) filter (where not t and c) as scan_pages from f group by book) "
    "select book, text_pages, scan_pages, scan_pages > 0 and scan_pages >= text_pages as scanned from s"
)
def scanned_documents(spark, sf_dir):
    """Votes of the pages: visible letters, or the largest image's share."""
    p = read(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 10).alias("book"), F.col("doc_id").alias("page"), "text")
    shown = F.when(F.col("page") % 2 == 0, F.substring("text", 1, 10)).otherwise(F.col("text"))
    visible = p.select("book", "page", F.explode(F.split(shown, "\n")).alias("text"))
    pictures = p.where("page % 4 <> 0").select("book", "page", F.explode(F.array(F.lit(3), F.lit(5))).alias("k"))
    pictures = pictures.select("book", "page", (F.col("page") * F.col("k") % 700).cast("double").alias("w"), F.lit(900.0).alias("h"))
    own = p.select("book", "page").withColumn("width", F.lit(600.0)).withColumn("height", F.lit(900.0))
    return doubt.scanned_documents(doubt.image_coverage(doubt.visible_letters(own, visible), pictures))


@query(
    "with i as (select doc_id // 20 as d, doc_id % 20 // 2 as page, doc_id % 20 as ord, 'i' || doc_id as name, 20 + doc_id * 37 % 900 as width, 20 + doc_id * 53 % 900 as height, "
    "doc_id % 7 as content_hash, doc_id % 11 = 0 as uniform, doc_id % 5 = 0 as grayscale from documents), "
    "s as (select d, content_hash, count(distinct page) as pages from i group by all), "
    "x as (select i.*, pages, page * 13 % 60 as words, lag(width) over w as lw, lag(height) over w as lh, lag(page) over w as lp, lag(grayscale) over w as lg from i join s using (d, content_hash) window w as (partition by d order by ord)), "
    "y as (select *, case when least(width, height) < 48 then 'tiny' when pages >= 3 then 'repeated' when greatest(width, height) / least(width, height) between 1.2 and 1.8 "
    "and width >= 600 and height >= 600 and words >= 25 then 'background' when uniform then 'uniform' when grayscale and lw = width and lh = height and lp = page and not lg then 'mask' end as why from x) "
    "select d as doc_id, page, ord, name, why from y where why is not null"
)
def rejected_images(spark, sf_dir):
    i = F.col("doc_id")
    x = read(spark, sf_dir, "documents").select(
        F.floor(i / 20).alias("d"), F.floor(i % 20 / 2).alias("page"), (i % 20).alias("ord"), F.concat(F.lit("i"), i).alias("name"), (20 + i * 37 % 900).alias("width"),
        (20 + i * 53 % 900).alias("height"), (i % 7).alias("content_hash"), (i % 11 == 0).alias("uniform"), (i % 5 == 0).alias("grayscale"),
    ).withColumnRenamed("d", "doc_id")
    refs, facts = x.select("doc_id", "page", "ord", "name"), x.drop("page", "ord")
    words = refs.select("doc_id", "page", (F.col("page") * 13 % 60).alias("words")).distinct()
    return images.rejected(refs, facts, words)


@query(
    f"with {LINES}, m as (select book, page, pos, case pos % 6 when 2 then ' ❦ ' when 4 then '§§' when 3 then '**' when 5 then '· ·' else text end as text from l), "
    "r as (select lang as book, doc_id as page, case when doc_id % 2 = 0 then text || '§' else text end as ref from documents where doc_id % 7 <> 0), "
    "s as (select m.*, ref, regexp_replace(m.text, '\\s+', '', 'g') as y from m left join r on r.book = m.book and r.page = m.page "
    "where m.page is not null and m.book in (select book from r where book is not null)) "
    f"select book, page, pos::int as pos, {TRIM.format('text')} as mark from s where regexp_matches(y, '^[^0-9A-Za-z!\\[\\]()|#*_]{{1,3}}$') "
    "and not coalesce(contains(ref, y[1]) or contains(ref, y[2]) and length(y) > 1 or contains(ref, y[3]) and length(y) > 2, false)"
)
def foreign_ornaments(spark, sf_dir):
    k = F.col("pos") % 6
    x = lines(spark, sf_dir).withColumn("text", F.when(k == 2, " ❦ ").when(k == 4, "§§").when(k == 3, "**").when(k == 5, "· ·").otherwise(F.col("text")))
    ref = pages(spark, sf_dir).where("page % 7 <> 0").withColumn("text", F.when(F.col("page") % 2 == 0, F.concat("text", F.lit("§"))).otherwise(F.col("text")))
    return cleanup.ornaments(x, ref).select("book", "page", "pos", T.trim_space("text").alias("mark"))


MARGINS = f"""{LINES}, {EDGES}, mk as (select book, page, {KEY_EVAL} as key from e), mp as (select book, count(distinct page) as pages from l group by book),
mg as (select book, key from mk join mp using (book) group by book, key, pages having count(distinct page) >= greatest(3, ceil(pages * 0.15::double)))"""


@query(
    f"with {MARGINS}, k as (select *, {KEY_EVAL} as key from l) select book, page, count(*) as n, sum(length(text))::bigint as chars from k "
    "where not exists (from mg where mg.book = k.book and mg.key = k.key) group by all"
)
def lines_without_margins(spark, sf_dir):
    x = cleanup.without_margins(lines(spark, sf_dir))
    return x.groupBy("book", "page").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).cast("long").alias("chars"))


@query(
    f"with {LINES}, o as (select book, page, pos, case when pos = 0 then '<!-- page: 1 -->' when pos % 4 = 1 then '- 12 -' when pos % 9 = 5 then '7' else text end as text from l), "
    "mg(key) as (values ('- # -'), ('#')), "
    f"k as (select *, {KEY_EVAL} as key, max(starts_with({TRIM.format('text')}, '<!-- page:')::int) over (partition by book, page order by pos rows between 2 preceding and 2 following) as near from o) "
    "select book, page, pos::int as pos, key from k join mg using (key) where book is not null and (not regexp_matches(key, '^[# ]+$') or near = 1)"
)
def margin_leaks(spark, sf_dir):
    """Margin lines in an output; bare numbers only near a page marker."""
    p = F.col("pos")
    x = lines(spark, sf_dir)
    x = x.withColumn("text", F.when(p == 0, "<!-- page: 1 -->").when(p % 4 == 1, "- 12 -").when(p % 9 == 5, "7").otherwise(F.col("text")))
    margins = x.select("book").distinct().select("book", F.explode(F.array(F.lit("- # -"), F.lit("#"))).alias("key"))
    return cleanup.margin_leaks(x, margins).select("book", "page", "pos", "key")


@query(
    "select source, target from (select trim(case when doc_id % 3 = 0 then '' else lang || doc_id end) as source, case when doc_id % 5 = 0 then null else source end as target from documents) "
    "where source <> '' and target is not null"
)
def loose_terms(spark, sf_dir):
    """A tab-separated glossary with bad lines in it."""
    i = F.col("doc_id")
    left = F.when(i % 3 == 0, F.lit(" ")).otherwise(F.concat("lang", i))
    right = F.when(i % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("\t"), "source", F.lit(" \tmore")))
    return readers.loose_terms(read(spark, sf_dir, "documents").select(F.concat(left, right).alias("value")))


@query(
    "with r as (select doc_id // 10 as d, doc_id as i, '../x/./img' || (doc_id % 10) || '.png' as name from documents), "
    "e as (select doc_id // 10 as d, case doc_id % 10 when 1 then 'x/img1.png' when 2 then 'OEBPS/x/img2.png' when 3 then 'OEBPSx/img3.png' "
    "when 4 then 'a/x/img4.png' when 5 then 'b/x/img4.png' else 'x/y/img' || (doc_id % 10) || '.png' end as entry from documents), "
    "m as (select distinct r.d, name, entry from r join e on e.d = r.d and (entry = 'x/img' || (i % 10) || '.png' or ends_with(entry, '/x/img' || (i % 10) || '.png'))) "
    "select d as doc_id, name, min(entry) as entry from m group by all having count(*) = 1"
)
def package_images(spark, sf_dir):
    """Referenced images of a package: one entry that ends with the path."""
    i = F.col("doc_id")
    k = i % 10
    d = read(spark, sf_dir, "documents").select(F.floor(i / 10).alias("d"), F.concat(F.lit("../x/./img"), k, F.lit(".png")).alias("name"), F.when(k == 1, "x/img1.png")
        .when(k == 2, "OEBPS/x/img2.png").when(k == 3, "OEBPSx/img3.png").when(k == 4, "a/x/img4.png").when(k == 5, "b/x/img4.png")
        .otherwise(F.concat(F.lit("x/y/img"), k, F.lit(".png"))).alias("entry"))
    d = d.withColumnRenamed("d", "doc_id")
    return readers.package_images(d.select("doc_id", "name"), d.select("doc_id", "entry").distinct())


@query(
    f"with d as (select case when length(text) > 2000 then 'length' when regexp_matches(text, '[0-9]') then 'numbers' else 'none' end as doubt from documents where text is not null) "
    "select doubt, count(*) as n from d group by doubt"
)
def doubt_counts(spark, sf_dir):
    t = F.col("text")
    d = F.when(F.length(t) > 2000, "length").when(t.rlike("[0-9]"), "numbers").otherwise("none")
    return translation.doubt_counts(read(spark, sf_dir, "documents").where("text is not null").select(d.alias("doubt")))


@query(
    "select l.doc_id, case lang when 'es' then 'Spanish' when 'en' then 'English' when 'fr' then 'French' when 'de' then 'German' when 'it' then 'Italian' when 'pt' then 'Portuguese' end as label "
    "from labels l join documents d on d.doc_id = l.doc_id"
)
def saved_translations(spark, sf_dir):
    """Finished translations of documents with their language's name."""
    d = read(spark, sf_dir, "documents")
    done = read(spark, sf_dir, "labels").select("doc_id").join(d.select("doc_id", "lang"), "doc_id")
    return translation.saved_translations(d, done, T.language_name("lang")).select("doc_id", "label")
