"""Queries over documents written as Markdown with page markers.

A document's lines become blocks: every third opens a page (some markers have no
number), some are fenced, headings or images.  Each query has its DuckDB SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.functions import text as T
from quirework.operators import blocks as B
from quirework.operators import images
from quirework.plans.standard import SQUEEZE, TRIM, query, read

NL = "\n"


def marked_text(text) -> Column:
    """A text's lines as Markdown with page markers."""

    def block(s, i):
        page = F.concat(F.lit("<!-- page: "), (F.floor(i / 3) + 1).cast("string"), F.lit(" -->\n\n"))
        mark = F.when(i % 12 == 9, F.lit("<!-- page: x -->\n\n")).when(i % 3 == 0, page).otherwise(F.lit(""))
        body = (
            F.when(i % 7 == 3, F.concat(F.lit("```\n"), s, F.lit("\n\nx\n```")))
            .when(i % 5 == 1, F.concat(F.lit("## "), s))
            .when(i % 11 == 2, F.concat(F.lit("![p](img"), (i % 4).cast("string"), F.lit(".png)")))
            .when(i % 13 == 5, F.concat(F.lit("# "), s))
            .otherwise(s)
        )
        return F.concat(mark, body)

    return F.array_join(F.transform(F.split(text, "\n"), block), "\n\n")


def marked(spark, sf_dir, text=None) -> DataFrame:
    """(doc_id, text): the Markdown of the documents' texts (or of what is made
    of them)."""
    docs = read(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", marked_text("text" if text is None else text).alias("text"))


def parts(spark, sf_dir) -> DataFrame:
    return B.with_pages(B.blocks(marked(spark, sf_dir)))


MD = """
md as (select doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda s, k:
   (case when (k - 1) % 12 = 9 then '<!-- page: x -->' || chr(10) || chr(10)
         when (k - 1) % 3 = 0 then '<!-- page: ' || ((k - 1) // 3 + 1) || ' -->' || chr(10) || chr(10) else '' end) ||
   (case when (k - 1) % 7 = 3 then '```' || chr(10) || s || chr(10) || chr(10) || 'x' || chr(10) || '```'
         when (k - 1) % 5 = 1 then '## ' || s when (k - 1) % 11 = 2 then '![p](img' || ((k - 1) % 4) || '.png)'
         when (k - 1) % 13 = 5 then '# ' || s else s end)), chr(10) || chr(10)) as text from documents where text is not null)"""
PARTS = f"""{MD},
b0 as (select doc_id, unnest(bs) as text, generate_subscripts(bs, 1) - 1 as pos from (select doc_id, string_split(text, chr(10) || chr(10)) as bs from md)),
b1 as (select *, {TRIM.format('text')} as t from b0),
b2 as (select *, starts_with(t, '<!-- page:') as m, try_cast({TRIM.format("regexp_replace(substr(t, 11), '(-->)+$', '')")} as int) as n from b1),
b as (select *, last_value(case when m then {{'n': n}} end ignore nulls) over (partition by doc_id order by pos).n as page,
   t <> '' and not starts_with(t, '![') and not starts_with(t, '<!--') as c from b2)"""
RUN_ON = "from (select doc_id, lower(replace(text, '.', '')) as text from documents)"
LINE = f"""{MD},
l0 as (select doc_id, unnest(ls) as s, generate_subscripts(ls, 1) - 1 as line from (select doc_id, string_split(text, chr(10)) as ls from md)),
l1 as (select *, starts_with(ltrim(s, ' '), '```') as f, sum(starts_with(ltrim(s, ' '), '```')::int) over (partition by doc_id order by line) % 2 = 1 as o from l0),
ln as (select *, f or o as fenced, case when not (f or o) then nullif(length(regexp_extract(s, '^(#{{1,6}}) ', 1)), 0) end as level from l1)"""


@query(
    f"with {LINE}, g as (select *, sum(({TRIM.format('s')} = '' and not fenced)::int) over (partition by doc_id order by line) as g from ln), "
    f"k as (select doc_id, g, string_agg(s, chr(10) order by line) as text from g where not ({TRIM.format('s')} = '' and not fenced) group by all) "
    "select doc_id, (row_number() over (partition by doc_id order by g) - 1)::int as pos, text from k"
)
def fenced_blocks(spark, sf_dir):
    return B.fenced_blocks(marked(spark, sf_dir))


@query(
    f"with {PARTS}, h as (select *, count(case when m then n end) over (partition by doc_id order by pos) as g from b), "
    "a as (select *, coalesce(last_value(case when m then n end ignore nulls) over (partition by doc_id order by pos), 0) "
    "+ sum((m and n is null)::int) over (partition by doc_id, g order by pos) as counted from h) "
    "select doc_id, pos::int as pos, page, counted::int as counted from a where not m"
)
def block_pages(spark, sf_dir):
    """The page of each block, and the page with unreadable markers counted on."""
    own = parts(spark, sf_dir).where("not is_marker").select("doc_id", "pos", "page")
    counted = B.with_counted_pages(B.blocks(marked(spark, sf_dir))).select("doc_id", "pos", F.col("page").alias("counted"))
    return own.join(counted, ["doc_id", "pos"])


@query(
    f"with {PARTS} select doc_id, page, string_agg(text, chr(10) || chr(10) order by pos) as text from b where page is not null and not m group by all"
)
def page_texts(spark, sf_dir):
    return B.page_texts(parts(spark, sf_dir))


@query(
    f"with {MD}, s as (select doc_id, unnest(p) as s, generate_subscripts(p, 1) as pos from (select doc_id, string_split(text, '<!-- page:') as p from md)), "
    f"x as (select doc_id, pos, try_cast({TRIM.format('split_part(s, $$-->$$, 1)')} as int) as page, substr(s, strpos(s, '-->') + 3) as t from s where pos > 1) "
    "select doc_id, page, string_agg(t, '' order by pos) as text from x where page is not null group by all"
)
def split_pages(spark, sf_dir):
    return B.split_pages(marked(spark, sf_dir))


@query(
    f"with {PARTS} select doc_id, page, pos::int as pos, (row_number() over (partition by doc_id, page order by pos) - 1)::int as block from b where c"
)
def numbered_blocks(spark, sf_dir):
    return B.numbered(parts(spark, sf_dir)).select("doc_id", "page", "pos", "block")


@query(
    f"with {PARTS}, r as (select *, row_number() over (partition by doc_id, page order by pos) - 1 as block from b where c) "
    "select doc_id, t as text from r where page = 2 and block = 1"
)
def located_blocks(spark, sf_dir):
    return B.located(parts(spark, sf_dir), 2, 1)


@query(f"with {PARTS} select doc_id, pos::int as pos, text from (select *, sum(c::int) over (partition by doc_id order by pos) as k from b) where k <= 5")
def first_blocks(spark, sf_dir):
    return B.first_blocks(parts(spark, sf_dir), 5).select("doc_id", "pos", "text")


@query(
    f"with {PARTS} select doc_id, pos::int as pos, page + 40 as page, case when m then '<!-- page: ' || (page + 40) || ' -->' else text end as text "
    "from b where page between 2 and 3"
)
def page_subset(spark, sf_dir):
    return B.page_subset(parts(spark, sf_dir), 2, 3, 40).select("doc_id", "pos", "page", "text")


@query(f"with {PARTS} select doc_id, {TRIM.format('string_agg(text, chr(10) || chr(10) order by pos)')} || chr(10) as text from b where not m group by doc_id")
def exported_texts(spark, sf_dir):
    return B.without_markers(parts(spark, sf_dir))


@query(
    f"with {PARTS}, e as (select doc_id, page, string_agg(text, chr(10) || chr(10) order by pos) as text from b where page is not null and not m group by all) "
    "select doc_id, page, case when page = 2 and doc_id % 3 = 1 then 'new' else text end as text from e"
)
def edited_pages(spark, sf_dir):
    """Page 2 of each third document is rewritten; a third more edits hold a
    marker and a third name a page that isn't there."""
    ids = read(spark, sf_dir, "documents").where("text is not null").select("doc_id").distinct()
    kind = F.col("doc_id") % 3
    edits = ids.select(
        "doc_id", F.when(kind == 2, F.lit(999)).otherwise(F.lit(2)).alias("page"),
        F.when(kind == 0, F.lit("a <!-- page: 9 --> b")).otherwise(F.lit("new")).alias("text"),
    )
    return B.edited_pages(B.page_texts(parts(spark, sf_dir)), edits)


CHAPTERS = f"""{LINE},
sl as (select doc_id, min(level) as split_level from (select doc_id, level from ln where level is not null group by all having count(*) >= 2) group by doc_id),
cs as (select ln.*, split_level, coalesce(max(({TRIM.format('s')} <> '')::int) over (partition by doc_id order by line rows between unbounded preceding and 1 preceding), 0) = 1 as started from ln left join sl using (doc_id)),
ch as (select *, sum((started and coalesce(level <= split_level, false))::int) over (partition by doc_id order by line) as chapter from cs)"""


@query(f"with {CHAPTERS} select doc_id, chapter::bigint as chapter, min(line)::int as first_line, count(*) as n_lines, any_value(split_level)::int as split_level from ch group by all")
def chapters(spark, sf_dir):
    x = B.chapters(B.lines_of(marked(spark, sf_dir)))
    return x.groupBy("doc_id", "chapter").agg(
        F.min("line").alias("first_line"), F.count(F.lit(1)).alias("n_lines"), F.first("split_level", ignorenulls=True).alias("split_level")
    )


@query(
    f"with {CHAPTERS}, h as (select doc_id, chapter, line, level, replace(regexp_replace(s, '^#+ ', ''), '*', '') as title, "
    "min(level) over (partition by doc_id, chapter) as base, row_number() over (partition by doc_id, chapter order by line) as n from ch where level is not null) "
    "select doc_id, chapter::bigint as chapter, line::int as line, level::int as level, title, n = 1 as is_title from h where title <> '' and (n = 1 or level = base + 1)"
)
def contents(spark, sf_dir):
    return B.contents(B.lines_of(marked(spark, sf_dir))).select("doc_id", "chapter", "line", "level", "title", "is_title")


@query(
    f"with {PARTS.replace('from documents', RUN_ON)}, x as (select doc_id, pos, t, sum(m::int) over (partition by doc_id order by pos) as marks, c from b), "
    "y as (select *, lead(pos) over w as np, lead(t) over w as nt, lead(marks) over w as nm from x where c window w as (partition by doc_id order by pos)), "
    "p as (select *, not regexp_matches(t, '^(```|\\$\\$|!\\[|\\||#{1,6} |[-*] |[0-9]+\\. )') as plain, "
    "not regexp_matches(nt, '^(```|\\$\\$|!\\[|\\||#{1,6} |[-*] |[0-9]+\\. )') as nplain from y), "
    "r as (select *, coalesce(plain and nplain and nm - marks = 1 and not regexp_matches(t, '[.!?:;…\"”»)]$') and regexp_matches(nt, '^\\p{Ll}'), false) as runs from p), "
    "i as (select *, sum((not runs)::int) over (partition by doc_id order by pos) as island from r) "
    "select doc_id, pos::int as pos, np::int as next_pos from (select *, row_number() over (partition by doc_id, island order by pos) "
    "as k, min(runs) over (partition by doc_id, island) as pure from i) where runs and (case when pure then k else k - 1 end) % 2 = 1"
)
def continuations(spark, sf_dir):
    """Paragraphs that run on over a page, in texts without full stops."""
    return B.continuations(B.with_pages(B.blocks(marked(spark, sf_dir, F.lower(F.replace("text", F.lit("."), F.lit("")))))))


@query(
    f"with {PARTS}, r as (select doc_id, page, pos, unnest(ns) as name, generate_subscripts(ns, 1) as k from "
    "(select doc_id, page, pos, regexp_extract_all(text, '!\\[[^\\]]*\\]\\(([^)]*)\\)', 1) as ns from b)) "
    "select doc_id, page, (row_number() over (partition by doc_id order by pos, k) - 1)::int as ord, name from r"
)
def image_references(spark, sf_dir):
    return images.references(parts(spark, sf_dir))


@query(
    f"with {PARTS}, w as (select doc_id, page, sum(len(list_filter(regexp_split_to_array(array_to_string(list_filter(string_split(text, chr(10)), lambda x: not starts_with(x, '![')), chr(10)), '\\s+'), "
    "lambda x: regexp_matches(x, '[\\p{L}\\p{N}]')))) as words from b where not m group by all) select doc_id, page, words::bigint as words from w"
)
def page_words(spark, sf_dir):
    """Words of each page without its image lines."""
    return images.words_per_page(parts(spark, sf_dir))


FORMED = "replace(replace(replace(text, 'the ', '**the** '), 'de ', '[de](u/' || doc_id || ') '), 'a ', '`a` ')"


@query(
    f"with f as (select doc_id, {FORMED} as t from documents where text is not null) "
    "select doc_id, md5(lower(regexp_replace(t, '[^\\p{L}\\p{N}]', '', 'g'))) as letters, "
    "((length(t) - length(replace(t, '**', ''))) // 2)::int as strong, (length(t) - length(replace(t, '`', '')))::int as code, "
    "((length(t) - length(replace(t, '](', ''))) // 2)::int as links, (length(t) - length(replace(t, '[', '')))::int as opened, "
    "((length(replace(t, '**', '')) - length(replace(replace(t, '**', ''), '*', ''))) % 2)::int as odd, "
    "array_to_string(regexp_extract_all(t, '\\]\\(([^)]*)\\)', 1), ' ') as targets, "
    "md5(regexp_replace(regexp_replace(t, '!?\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), '\\*\\*|__|`|\\*', '', 'g')) as plain from f"
)
def inline_forms(spark, sf_dir):
    """Letters, inline marks, link targets and the text without markup."""
    t = F.replace(F.col("text"), F.lit("the "), F.lit("**the** "))
    t = F.replace(t, F.lit("de "), F.concat(F.lit("[de](u/"), F.col("doc_id").cast("string"), F.lit(") ")))
    t = F.replace(t, F.lit("a "), F.lit("`a` "))
    x = read(spark, sf_dir, "documents").where("text is not null").select("doc_id", t.alias("t")).withColumn("m", T.inline_marks("t"))
    return x.select(
        "doc_id", F.md5(T.letters_only("t")).alias("letters"), F.col("m.strong").alias("strong"), F.col("m.code").alias("code"),
        F.col("m.links").alias("links"), F.col("m.open").alias("opened"), F.col("m.odd").alias("odd"),
        F.array_join(T.link_targets("t"), " ").alias("targets"), F.md5(T.strip_inline("t")).alias("plain"),
    )


@query(
    f"with {PARTS} select doc_id, pos::int as pos, case when regexp_matches(t, '^<!-- page: *[0-9]+ *-->$') then 'page' when regexp_matches(t, '^(```|\\$\\$)') then 'literal' "
    "when starts_with(t, '![') then 'image' when starts_with(t, '|') then 'table:' || len(string_split(t, chr(10))) || 'x' || "
    "(length(string_split(t, chr(10))[1]) - length(replace(string_split(t, chr(10))[1], '|', '')) - 1) "
    "when regexp_matches(t, '^#{1,6} ') then 'heading:' || length(regexp_extract(t, '^(#+)', 1)) when regexp_matches(t, '^([-*] |[0-9]+\\. )') then 'list' else 'paragraph' end as shape from b"
)
def block_shapes(spark, sf_dir):
    return parts(spark, sf_dir).select("doc_id", "pos", B.shape().alias("shape"))


@query(
    f"with {PARTS}, r as (select *, row_number() over (partition by doc_id, page order by pos) - 1 as block from b where c and page is not null) "
    f"select doc_id, page, block::int as block, case when block = 0 and page % 2 = 1 then 'corrected' else text end as text from r"
)
def corrected_blocks(spark, sf_dir):
    """The first block of odd pages is corrected; edits with another key, an
    empty text or of another block change nothing."""
    own = B.numbered(parts(spark, sf_dir).where("page is not null")).select("doc_id", "page", "block", "text")
    first = own.where("block = 0")
    key = F.when(F.col("page") % 2 == 1, T.block_key("text")).otherwise(F.lit("stale"))
    edits = first.select("doc_id", "page", "block", key.alias("key"), F.lit(" corrected ").alias("text"))
    blank = own.where("block = 1").select("doc_id", "page", "block", T.block_key("text").alias("key"), F.lit(" ").alias("text"))
    return B.correct_blocks(own, edits.unionByName(blank))


@query(
    f"with {PARTS}, d as (select *, row_number() over (partition by doc_id, page order by pos) - 1 as block from b where c and page is not null), "
    "x as (select doc_id, page, block, case when length(t) > 400 then 'length' when regexp_matches(t, '[0-9]') then 'numbers' end as doubt, t from d) "
    "select doc_id, page, block::int as block, doubt, replace(left(t, 160), chr(10), ' ') as excerpt from x where doubt is not null"
)
def translation_doubts(spark, sf_dir):
    """Doubts of a translation with an excerpt of their block."""
    from quirework.operators import translation

    own = B.numbered(parts(spark, sf_dir).where("page is not null"))
    t = T.trim_space("text")
    doubt = F.when(F.length(t) > 400, "length").when(t.rlike("[0-9]"), "numbers")
    doubts = own.select("doc_id", "page", "block", doubt.alias("doubt")).where("doubt is not null")
    return translation.doubts_view(doubts, own)
