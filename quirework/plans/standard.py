"""Queries of the core operators over whole tables, each with its DuckDB SQL.

Books are languages, pages are documents (numbered by doc_id), blocks are lines.
A second reading of a page is its text altered by a fixed rule of doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.functions import maths
from quirework.functions import text as T
from quirework.operators import blocks as B
from quirework.operators import cleanup, doubt, headings, library, metrics, repair, review, tables, translation
from quirework.shipping import ship
from quirework.staging import staged

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select(F.col("lang").alias("book"), F.col("doc_id").alias("page"), "text")
    return d.select("book", "page", F.posexplode(F.split("text", "\n")).alias("pos", "text"))


def content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as content blocks; no line is empty, so the position is the number."""
    return lines(spark, sf_dir).where(B.is_content()).withColumnRenamed("pos", "block")


def content_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same blocks, a page a row: they come so, and needn't be dealt out."""
    texts = F.transform(F.split("text", "\n"), lambda t, i: F.struct(i.alias("block"), t.alias("text")))
    return pages(spark, sf_dir).select("book", "page", F.filter(texts, lambda b: B.is_content(b["text"])).alias("texts"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("lang").alias("book"), F.col("doc_id").alias("page"), "text")


def altered(p: DataFrame) -> DataFrame:
    """Another reading of each page."""
    k = F.col("page") % 4
    half = F.substring("text", F.lit(1), (F.length("text") / 2).cast("int"))
    t = F.when(k == 0, F.col("text")).when(k == 1, F.replace("text", F.lit("the "), F.lit("tbe "))).when(k == 2, half)
    return p.withColumn("text", t.otherwise(F.concat("text", F.lit(" "), "text")))


LINES = """
l as (select lang as book, doc_id as page, unnest(string_split(text, chr(10))) as text,
        generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from documents)"""
ALTERED = """
p as (select lang as book, doc_id as page, text from documents),
q as (select book, page, case page % 4 when 0 then text when 1 then replace(text, 'the ', 'tbe ')
        when 2 then left(text, length(text) // 2) else text || ' ' || text end as text from p)"""
WORDS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
BAGS = f"""
a as (select book, page, word, count(*) as na from (select book, page, unnest({WORDS}) as word from p) group by all),
b as (select book, page, word, count(*) as nb from (select book, page, unnest({WORDS}) as word from q) group by all),
m as (select coalesce(a.book, b.book) as book, coalesce(a.page, b.page) as page, sum(coalesce(na, 0)) as words_a,
        sum(coalesce(nb, 0)) as words_b, sum(least(coalesce(na, 0), coalesce(nb, 0))) as matches
      from a full join b on a.book = b.book and a.page = b.page and a.word = b.word group by all)"""
SQUEEZE = "regexp_replace(regexp_replace({0}, '\\s+', ' ', 'g'), '^ | $', '', 'g')"
TRIM = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
KEY = SQUEEZE.format("regexp_replace(regexp_replace(lower(text), '[0-9]', '#', 'g'), '[^\\p{L}\\p{N}#\\s]', '', 'g')")
KEY_CLEANUP = f"regexp_replace({KEY}, '##+', '#', 'g')"
KEY_EVAL = "regexp_replace(" + SQUEEZE.format("regexp_replace(lower(text), '[0-9]', '#', 'g')") + ", '##+', '#', 'g')"
EDGES = f"""
o as (select *, row_number() over (partition by book, page order by pos) as a,
        row_number() over (partition by book, page order by pos desc) as z from l where {TRIM.format('text')} <> ''),
e as (select * from o where a <= 2 or z <= 2)"""
SHORT = "len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) <= 8 and not contains(text, '|')"
RUNNING = f"""with {LINES}, {EDGES},
k as (select book, page, pos, text, {KEY_CLEANUP} as key from e where {SHORT}),
kd as (select distinct book, page, key from k where key <> ''),
np as (select book, count(distinct page) as pages from l group by book having count(distinct page) >= 3),
s as (select book, key, count(*) as n, any_value(pages) as pages from kd join np using (book) group by book, key having count(*) >= 3),
g as (select *, case when page - lag(page) over (partition by book, key order by page) > 2 then 1 else 0 end as new from kd),
i as (select *, sum(new) over (partition by book, key order by page) as island from g),
r as (select book, key, max(n) as run from (select book, key, island, count(*) as n from i group by all) group by all),
rk as (select s.book, s.key, s.n, r.run from s join r using (book, key) where n >= greatest(3, ceil(pages * 0.15::double)) or run >= 5)"""


@query(RUNNING + " select k.book, k.page, k.pos::int as pos, k.text, k.key from k join rk using (book, key)")
def running_matter(spark, sf_dir):
    return cleanup.running_matter(lines(spark, sf_dir)).select("book", "page", "pos", "text", "key")


@query(RUNNING + " select book, key, n, run from rk")
def running_keys(spark, sf_dir):
    return cleanup.running_keys(lines(spark, sf_dir))


@query(
    f"with {LINES} select book, page, pos::int as block, substr(sha256({TRIM.format('text')}), 1, 16) as key, "
    f"case when length({SQUEEZE.format('text')}) > 180 then left({SQUEEZE.format('text')}, 180) || '…' else {SQUEEZE.format('text')} end as excerpt "
    f"from l where {TRIM.format('text')} <> '' and not starts_with({TRIM.format('text')}, '![') and not starts_with({TRIM.format('text')}, '<!--')"
)
def content_blocks(spark, sf_dir):
    return content(spark, sf_dir).select("book", "page", "block", T.block_key("text").alias("key"), T.excerpt("text").alias("excerpt"))


@query(
    f"select doc_id, len({WORDS})::int as alnum, len(list_filter({WORDS}, lambda x: length(x) >= 2))::int as alnum2, "
    "len(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}-]+'), lambda x: x <> ''))::int as hyphen, "
    "len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: regexp_matches(x, '[\\p{L}\\p{N}]')))::int as spaces, "
    f"len(list_filter({WORDS}, lambda x: regexp_matches(x, '^\\p{{L}}+$')))::int as letters, "
    f"len(list_filter({WORDS}, lambda x: regexp_matches(x, '[0-9]')))::int as numbers from documents"
)
def tokenizers(spark, sf_dir):
    words = T.tok_alnum("text")
    return read(spark, sf_dir, "documents").select(
        "doc_id",
        F.size(words).alias("alnum"),
        F.size(T.tok_alnum2("text")).alias("alnum2"),
        F.size(T.tok_alnum_hyphen("text")).alias("hyphen"),
        F.size(T.tok_spaces("text")).alias("spaces"),
        F.size(T.tok_vocabulary("text")).alias("letters"),
        F.size(T.numbers_in(words)).alias("numbers"),
    )


@query(
    f"with {LINES}, k as (select book, {KEY_CLEANUP} as c, {SQUEEZE.format('regexp_replace(lower(text), $$[0-9]$$, $$#$$, $$g$$)')} as h, {KEY_EVAL} as e from l) "
    "select book, count(distinct c) as cleanup, count(distinct h) as heading, count(distinct e) as evaluation from k group by book"
)
def margin_keys(spark, sf_dir):
    x = lines(spark, sf_dir).select(
        "book", T.key_cleanup("text").alias("c"), T.key_heading("text").alias("h"), T.key_evaluation("text").alias("e")
    )
    return x.groupBy("book").agg(
        F.countDistinct("c").alias("cleanup"), F.countDistinct("h").alias("heading"), F.countDistinct("e").alias("evaluation")
    )


@query(
    f"with {ALTERED}, {BAGS} select book, page, words_a::bigint as words_a, words_b::bigint as words_b, matches::bigint as matches, "
    "case when words_a >= 20 and words_b >= 20 then round(least(matches / words_a, matches / words_b), 9) end as agreement from m"
)
def page_agreement(spark, sf_dir):
    p = pages(spark, sf_dir)
    x = doubt.agreement(p, altered(p), ["book", "page"])
    return x.select("book", "page", "words_a", "words_b", "matches", F.round("agreement", 9).alias("agreement"))


@query(f"with {ALTERED}, {BAGS} select book, page from m where words_a >= 20 and words_b >= 20 and least(matches / words_a, matches / words_b) < 0.8::double")
def doubtful_pages(spark, sf_dir):
    p = pages(spark, sf_dir)
    return doubt.doubtful_pages(p, altered(p), ["book", "page"]).select("book", "page")


@query(
    f"with {ALTERED}, {BAGS} select book, page, words_b > 0 and matches >= 0.75::double * words_a and words_b <= 1.5::double * words_a as accepted from m"
)
def reread_acceptance(spark, sf_dir):
    p = pages(spark, sf_dir)
    return doubt.accepted_rereads(p, altered(p), ["book", "page"]).select("book", "page", "accepted")


@query(
    "with s as (select lang as book, source, doc_id as page, length(text) as seconds from documents), "
    "r as (select *, coalesce(sum(seconds) over (partition by book, source order by page rows between unbounded preceding and 1 preceding), 0) as spent, "
    "count(*) over (partition by book, source) as n from s) "
    "select book, source, page, spent::bigint as spent from r where spent <= greatest(20 * n, 300)"
)
def reread_plan(spark, sf_dir):
    """Pages of a book's source that fit the time budget, a character a second."""
    x = pages(spark, sf_dir).join(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), "source"), "page")
    x = x.select(F.struct("book", "source").alias("g"), "page", F.length("text").cast("long").alias("seconds"))
    n = x.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    out = doubt.within_budget(x.join(n, "g"), "g", "page", "seconds", doubt.reread_budget(F.col("n")))
    return out.select("g.book", "g.source", "page", "spent")


VOCAB = f"""with {LINES},
v as (select book, word, count(*) as n from (select book, unnest({WORDS}) as word from l) where regexp_matches(word, '^\\p{{L}}+$') group by all),
kn as (select book, word from v where n >= 3),
fr as (select book, word from kn where length(word) >= 4),
ra as (select book, word from v where n = 1 and length(word) >= 4),
fv as (select book, word, i, left(word, i - 1) || substr(word, i + 1) as var, substr(word, i, 1) as c from (select book, word, unnest(range(1, length(word) + 1)) as i from fr)),
rv as (select book, word, i, left(word, i - 1) || substr(word, i + 1) as var, substr(word, i, 1) as c from (select book, word, unnest(range(1, length(word) + 1)) as i from ra)),
cf as (select rv.book, rv.word, fv.word as s, rv.i, least(rv.c, fv.c) || greatest(rv.c, fv.c) in ('ce', 'eo', 'nu', 'il', 'lt', 'ft', 'ao') as pair
   from rv join fv on rv.book = fv.book and rv.var = fv.var and rv.i = fv.i and rv.c <> fv.c),
pr as (select ra.book, ra.word, fv.word as s, 0 as o, contains('iljtrf', fv.c) as thin from ra join fv on ra.book = fv.book and ra.word = fv.var where fv.i > 1 and fv.i < length(fv.word)
   union all select rv.book, rv.word, kn.word, rv.i * 2, contains('iljtrf', rv.c) from rv join kn on rv.book = kn.book and rv.var = kn.word where rv.i > 1 and rv.i < length(rv.word)
   union all select book, word, s, i * 2 + 1, pair from cf where pair or (i > 1 and i < length(word) - 1)),
ll as (select book, word, arg_min(s, (o, s)) as suggestion, arg_min(s, (o, s)) filter (where thin) as strict from pr group by all)"""


@query(VOCAB + " select * from ll")
def altered_words(spark, sf_dir):
    return review.looks_like(review.vocabulary(content(spark, sf_dir)))


GLUED = """
gl as (select v.book, v.word, min(k) as k from (select book, word, unnest(range(3, length(word) - 2)) as k from v where n = 1 and length(word) >= 8) v
       join v a on a.book = v.book and a.word = left(v.word, k) and a.n >= 5
       join v b on b.book = v.book and b.word = substr(v.word, k + 1) and b.n >= 5 group by all)"""


@query(f"{VOCAB}, {GLUED} select book, word, k::int as k from gl")
def glued_words(spark, sf_dir):
    return review.glued_suspects(review.vocabulary(content(spark, sf_dir)))


TOKENS = "list_filter(list_transform(regexp_split_to_array(lower(text), '\\s+'), lambda x: regexp_replace(x, '^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$', '', 'g')), lambda x: x <> '')"
PAIRED = f"""
tp as (select book, page, pos, unnest(ts) as word, generate_subscripts(ts, 1) as i, ts from (select book, page, pos, {TOKENS} as ts from l)),
tx as (select book, page, pos, i, word, ts[i + 1] as nxt from tp),
lo as (select book, word from v where n > 1)"""
SPLIT = """regexp_matches(word, '^\\p{L}+$') and regexp_matches(nxt, '^\\p{L}+$') and exists (from kn where kn.book = tx.book and kn.word = tx.word || nxt)
  and (not exists (from lo where lo.book = tx.book and lo.word = tx.word) or not exists (from lo where lo.book = tx.book and lo.word = nxt))"""


@query(
    f"{VOCAB}, {PAIRED} select book, page, pos::int as block, (i - 1)::int as pos, word, nxt as next, word || nxt as suggestion from tx where {SPLIT}"
)
def split_words(spark, sf_dir):
    c = content(spark, sf_dir)
    return review.split_suspects(c, review.vocabulary(c))


ODD = """
sc as (select book, unnest(['arabic', 'cjk', 'cyrillic', 'greek', 'hebrew', 'latin', 'other']) as s, unnest([
   sum(length(regexp_replace(text, '[^\\x{600}-\\x{6FF}]', '', 'g'))), sum(length(regexp_replace(text, '[^\\x{3040}-\\x{30FF}\\x{3400}-\\x{9FFF}\\x{AC00}-\\x{D7AF}]', '', 'g'))),
   sum(length(regexp_replace(text, '[^\\x{400}-\\x{52F}]', '', 'g'))), sum(length(regexp_replace(text, '[^\\x{370}-\\x{3FF}\\x{1F00}-\\x{1FFF}]', '', 'g'))),
   sum(length(regexp_replace(text, '[^\\x{590}-\\x{5FF}]', '', 'g'))), sum(length(regexp_replace(text, '[^A-Za-zªµºÀ-ÖØ-öø-\\x{24F}\\x{1E00}-\\x{1EFF}]', '', 'g'))),
   sum(length(regexp_replace(text, '[^\\p{L}]|[\\x{0}-\\x{24F}\\x{1E00}-\\x{1EFF}\\x{370}-\\x{52F}\\x{1F00}-\\x{1FFF}\\x{590}-\\x{6FF}\\x{3040}-\\x{30FF}\\x{3400}-\\x{9FFF}\\x{AC00}-\\x{D7AF}]', '', 'g')))]) as n from l group by book),
ms as (select book, case when max(n) > 0 then arg_min(s, (-n, s)) end as main from sc group by book),
tk as (select book, page, pos, unnest(ts) as token, generate_subscripts(ts, 1) as i from (select book, page, pos, regexp_split_to_array(text, '\\s+') as ts from l)),
tt as (select book, page, pos, i, regexp_replace(token, '^[^\\p{L}\\p{N}\\x{FFFD}]+|[^\\p{L}\\p{N}\\x{FFFD}]+$', '', 'g') as t from tk),
tr as (select tt.*, main, regexp_replace(regexp_replace(regexp_replace(t, '[^\\p{L}\\p{N}]', '', 'g'), '\\p{N}+', '0', 'g'), '\\p{L}+', 'a', 'g') as r,
   length(regexp_replace(t, '[^\\p{L}]', '', 'g')) as letters, lower(regexp_replace(t, '^\\p{N}+', '')) as rest from tt left join ms using (book) where t <> '' and not contains(t, '](')),
od as (select book, page, pos, i, t as token from tr where contains(t, chr(65533)) or (main = 'latin' and regexp_matches(t, '[\\x{370}-\\x{52F}\\x{590}-\\x{6FF}\\x{1F00}-\\x{1FFF}\\x{3040}-\\x{30FF}\\x{3400}-\\x{9FFF}\\x{AC00}-\\x{D7AF}]'))
   or (length(r) >= 2 and not (r = '0a' and not starts_with(t, '0') and rest in ('st', 'nd', 'rd', 'th', 'd', 'o', 'a', 'er', 'e', 're', 'eme', 'ème', 'º', 'ª', 'os', 'as', 'do', 'to'))
   and not (r = 'a0' and letters = 1))),
sp as (select book, token, count(distinct (page, pos)) as spread from od group by all)"""
RISKS = """
us as (select book, page, pos, text, list_filter(list_distinct(string_split(text, '')), lambda x: x <> '' and not regexp_matches(x, '[\\p{L}\\p{N}\\s!-/:-@\\[-`{-~«»“”‘’—–…·•°%€£§¶©®™¿¡]')) as u from l),
sy as (select us.book, us.page, pos, unnest(u) as token from us join q on q.book = us.book and q.page = us.page),
nb as (select sy.book, sy.page, pos, token from sy where not exists (from q where q.book = sy.book and q.page between sy.page - 1 and sy.page + 1 and contains(q.text, token))),
om as (select book, page, pos, 0 as o, i, token from od union all select nb.book, nb.page, nb.pos, 1, strpos(l.text, token), token from nb join l using (book, page, pos)),
orr as (select book, page, pos, count(*) as n, sum(case when r > 10 then 0.0 when coalesce(spread, 0) >= 3 then 0.25 else 2.0 end)::double as risk
   from (select *, row_number() over (partition by book, page, pos order by o, i) as r from om left join sp using (book, token)) group by all)"""


@query(f"with {LINES}, {ODD} select book, page, pos::int as block, (i - 1)::int as pos, token, spread from od join sp using (book, token)")
def odd_tokens(spark, sf_dir):
    return review.odd_tokens(content(spark, sf_dir))


BROKEN = "string_split(regexp_replace(text, '[-\\x{AD}\\x{2}\\x{2010}\\x{2011}\\x{FFFE}]\\s*\\n\\s*|[\\x{AD}\\x{2}\\x{FFFE}]\\s*', chr(1), 'g'), chr(1))"
SUPPORTED = f"""
rt as (select book, page, unnest(list_filter({WORDS}, lambda x: length(x) >= 2)) as word from q
   union all select book, page, unnest(list_transform(range(1, len(p)), lambda i: lower(regexp_extract(p[i], '([\\p{{L}}\\p{{N}}]*)$', 1) || regexp_extract(p[i + 1], '^([\\p{{L}}\\p{{N}}]*)', 1))))
   from (select book, page, {BROKEN} as p from q)),
own as (select distinct book, page from q),
nr as (select distinct book, page + unnest([-1, 0, 1]) as page, word from rt),
ds as (select book, word, unnest(range(1, length(word))) as k from (select distinct book, word from nr)),
gp as (select distinct ds.book, ds.word as token, left(ds.word, k) as word from ds join kn on kn.book = ds.book and kn.word = substr(ds.word, k + 1)
   union select distinct ds.book, ds.word, substr(ds.word, k + 1) from ds join kn on kn.book = ds.book and kn.word = left(ds.word, k)),
su as (select * from nr union select nr.book, nr.page, gp.word from nr join gp on gp.book = nr.book and gp.token = nr.word)"""
UNSUPPORTED = f"""{SUPPORTED},
un as (select w.book, w.page, w.pos, count(*) as n from (select book, page, pos, unnest(list_filter({WORDS}, lambda x: length(x) >= 2)) as word from l) w
   join own on own.book = w.book and own.page = w.page left join su on su.book = w.book and su.page = w.page and su.word = w.word where su.word is null group by all)"""


def halved(p: DataFrame) -> DataFrame:
    """The other reading; none of every sixth page, words broken in others."""
    x = altered(p).where("page % 6 <> 5")
    return x.withColumn("text", F.when(F.col("page") % 6 == 1, F.replace("text", F.lit("ing"), F.lit("-\n ing"))).otherwise(F.col("text")))


HALVED = f"""{ALTERED.replace('q as (', 'qa as (')},
q as (select book, page, case when page % 6 = 1 then replace(text, 'ing', '-' || chr(10) || ' ing') else text end as text from qa where page % 6 <> 5)"""


@query(f"{VOCAB}, {HALVED}, {UNSUPPORTED} select book, page, pos::int as block, n from un")
def unsupported_words(spark, sf_dir):
    refs = halved(pages(spark, sf_dir))
    vocab = staged(review.vocabulary(content(spark, sf_dir)), "vocabulary")
    c = staged(review.compared(content_pages(spark, sf_dir), refs, vocab), "compared")
    return review.unsupported(c, review.missing_words(c, refs, vocab)).select("book", "page", "block", "n")


SUSPECTS = f"""{PAIRED},
ty as (select tx.*, own.page is null as bare, a.word is not null as known, b.word is not null as knext from tx left join own on own.book = tx.book and own.page = tx.page
   left join su a on a.book = own.book and a.page = own.page and a.word = tx.word left join su b on b.book = own.book and b.page = own.page and b.word = tx.nxt),
tz as (select * from ty where not known and regexp_matches(word, '^\\p{{L}}+$')),
sl as (select tx.book, tx.page, pos, i, 1 as o, tx.word || ' (' || case when bare then strict else suggestion end || '?)' as found from tz tx join ll on ll.book = tx.book and ll.word = tx.word
   union all select book, page, pos, i, 2, word || ' ' || nxt from tz tx where not knext and {SPLIT}
   union all select tx.book, tx.page, pos, i, 3, tx.word from tz tx join (select distinct book, word from gl) g on g.book = tx.book and g.word = tx.word),
ss as (select book, page, pos, i, min(o) as o, arg_min(found, o) as found from sl where found is not null group by all)"""


@query(
    f"{VOCAB}, {GLUED}, {HALVED}, {SUPPORTED}, {SUSPECTS} select book, page, pos::int as block, (i - 1)::int as pos, "
    "case o when 1 then 'alike' when 2 then 'split' else 'glued' end as kind, found from ss"
)
def suspect_words(spark, sf_dir):
    """Suspect tokens by precedence, on pages with and without a reference."""
    refs = halved(pages(spark, sf_dir))
    vocab = staged(review.vocabulary(content(spark, sf_dir)), "vocabulary")
    c = staged(review.compared(content_pages(spark, sf_dir), refs, vocab), "compared")
    return review.suspects(c, review.missing_words(c, refs, vocab), vocab).drop("key")


STATES = "st as (select book, page, case when page % 50 = 0 then 1.0 else 3.0 end as risk from p where page % 50 = 0 or page % 20 = 3)"
REVIEW = f"""{VOCAB}, {GLUED}, {HALVED}, {ODD}, {RISKS}, {UNSUPPORTED}, {SUSPECTS}, {STATES},
rk as (select book, page, pos, least(n, 10)::double as risk, 'unsupported' as reason from un union all select book, page, pos, risk, 'odd' from orr
   union all select book, page, pos, least(count(*), 10) * 2.0, 'suspect' from ss group by book, page, pos),
it as (select rk.book, rk.page, rk.pos::int as block, any_value(substr(sha256({TRIM.format('l.text')}), 1, 16)) as key, sum(risk)::double as risk,
   array_to_string(list_sort(list(distinct reason)), ',') as reasons from rk join l on l.book = rk.book and l.page = rk.page and l.pos = rk.pos
   group by rk.book, rk.page, rk.pos having sum(risk) > 0),
ri as (select * from it union all select book, page, null, 'page:' || page, risk::double, 'page' from st)"""


def review_items_of(spark, sf_dir) -> DataFrame:
    p = pages(spark, sf_dir)
    states = p.select("book", "page", (F.col("page") % 20 == 3).alias("doubtful"), (F.col("page") % 50 == 0).alias("reread"))
    return review.review(content(spark, sf_dir), halved(p), states, content_pages(spark, sf_dir))


@query(REVIEW + " select * from ri")
def review_items(spark, sf_dir):
    return review_items_of(spark, sf_dir)


@query(
    REVIEW + ", de as (select distinct d.lang as book, 'page:' || d.doc_id as key, case quality when 0 then 'despues' else 'correcto' end as decision "
    "from labels join documents d using (doc_id)), "
    "vi as (select ri.*, decision is null or decision = 'despues' as pending from ri left join de using (book, key)) "
    "select book, count(*) as items, count(*) filter (where pending) as pending, sum(risk)::double as risk, "
    "coalesce(sum(risk) filter (where pending), 0)::double as pending_risk from vi group by book"
)
def review_counts(spark, sf_dir):
    d = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    decisions = d.select(
        F.col("lang").alias("book"),
        F.concat(F.lit("page:"), F.col("doc_id").cast("string")).alias("key"),
        F.when(F.col("quality") == 0, "despues").otherwise("correcto").alias("decision"),
    ).distinct()
    return review.review_counts(review.review_view(review_items_of(spark, sf_dir), decisions))


@query(
    f"with {ALTERED}, {BAGS} select book, page, round(matches / nullif(words_a, 0), 9) as words_recall, "
    "round(matches / nullif(words_b, 0), 9) as words_precision from m"
)
def word_scores(spark, sf_dir):
    p = pages(spark, sf_dir)
    x = metrics.word_scores(altered(p), p, ["book", "page"])
    return x.select("book", "page", F.round("words_recall", 9).alias("words_recall"), F.round("words_precision", 9).alias("words_precision"))


PAIRS = """
cv as (select conv_id, turn, text as src, lead(text) over (partition by conv_id order by turn) as dst from conversations),
pa as (select * from cv where dst is not null)"""


def turns(spark, sf_dir) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    x = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("src"), F.lead("text").over(w).alias("dst"))
    return x.where("dst is not null")


@query(
    f"with {PAIRS} select conv_id, turn, case when {TRIM.format('dst')} = '' then 'empty' when {SQUEEZE.format('lower(src)')} = {SQUEEZE.format('lower(dst)')} "
    "and len(list_filter(regexp_split_to_array(lower(src), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) >= 5 then 'untranslated' "
    "when length(src) >= 20 and (length(dst) * 10 < length(src) * 3 or length(dst) > length(src) * 3) then 'length' end as doubt, "
    "coalesce(array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(src, '[0-9]+')), "
    "lambda x: len(list_filter(regexp_extract_all(src, '[0-9]+'), lambda y: y = x)) > len(list_filter(regexp_extract_all(dst, '[0-9]+'), lambda y: y = x)))), ','), '') as lost from pa"
)
def translation_guards(spark, sf_dir):
    lost = F.array_join(F.array_sort(translation.lost_numbers(F.col("src"), F.col("dst"))), ",")
    return turns(spark, sf_dir).select("conv_id", "turn", translation.judged(F.col("src"), F.col("dst")).alias("doubt"), lost.alias("lost"))


GLOSSARY = (("the", "der"), ("of the", "des"), ("de la", "of"), ("ist", "is"), ("license", "lizenz"))


@query(
    "with g(ord, source) as (values " + ", ".join(f"({i}, '{s}')" for i, (s, _) in enumerate(GLOSSARY)) + "), "
    "d as (select doc_id, ' ' || regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', '  ', 'g') || ' ' as t from documents) "
    "select doc_id, string_agg(source, ',' order by ord) as terms from d join g on contains(t, ' ' || replace(source, ' ', '  ') || ' ') group by doc_id"
)
def glossary_terms(spark, sf_dir):
    g = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(GLOSSARY)], "ord int, source string, target string")
    x = translation.terms_in(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), g)
    return x.select(F.col("id").alias("doc_id"), F.array_join("terms", ",").alias("terms"))


CHRF = f"""with {PAIRS},
ng as (select role, id, o, s, unnest(range(1, length(t) - o + 2)) as i, t from
  (select conv_id % 4 as role, conv_id * 1000 + turn as id, unnest(range(1, 7)) as o, s, regexp_replace(t, '\\s+', '', 'g') as t from
    (select conv_id, turn, unnest(['r', 'o']) as s, unnest([src, dst]) as t from pa)) where length(t) >= o),
gr as (select role, id, o, substr(t, i, o) as g, count(*) filter (where s = 'r') as a, count(*) filter (where s = 'o') as b from ng group by all),
oo as (select role, o, sum(least(a, b)) as m, sum(a) as a, sum(b) as b from gr group by all),
pr as (select role, avg(case when b > 0 then m / b else 0 end) as p, avg(case when a > 0 then m / a else 0 end) as r from oo group by all)
select role as part, round(100 * case when p + r > 0 then 5 * p * r / (4 * p + r) else 0 end, 6) as chrf from pr"""


@query(CHRF)
def chrf(spark, sf_dir):
    x = turns(spark, sf_dir).select(
        (F.col("conv_id") % 4).alias("part"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("src").alias("reference"), F.col("dst").alias("output")
    )
    return metrics.chrf(x, ["part"]).select("part", F.round("chrf", 6).alias("chrf"))


@query(
    f"with {LINES}, {EDGES}, k as (select book, page, {KEY_EVAL} as key from e), np as (select book, count(distinct page) as pages from l group by book) "
    "select book, key, count(distinct page) as n from k join np using (book) group by book, key, pages "
    "having count(distinct page) >= greatest(3, ceil(pages * 0.15::double))"
)
def evaluation_margins(spark, sf_dir):
    return cleanup.repeated_margins(lines(spark, sf_dir))


STYLED = """
sl as (select *, case when line_no = 1 then null when line_no % 7 = 0 then size * 2 else size * 1.5::double end as gap_before from
  (select (page_id % 10)::bigint as book, page_id as page, i as line_no, tag, txt as text,
   case tag when 'h1' then 18.0 when 'li' then case when i % 4 = 0 then 10.2 else 9.0 end else 10.0 end::double as size,
   tag = 'h1' or i % 9 = 5 as bold, i % 6 = 5 as centered
   from (select page_id, unnest(tags) as tag, unnest(txts) as txt, generate_subscripts(tags, 1) as i from
     (select page_id, regexp_extract_all(html, '<(h1|p|li)>([^<]+)', 1) as tags, regexp_extract_all(html, '<(h1|p|li)>([^<]+)', 2) as txts from pages))))"""


def styled(spark, sf_dir) -> DataFrame:
    """Lines of the pages' HTML with styles by tag and line number."""
    rx = F.lit("<(h1|p|li)>([^<]+)")
    x = read(spark, sf_dir, "pages").select(
        (F.col("page_id") % 10).cast("long").alias("book"),
        F.col("page_id").alias("page"),
        F.posexplode(F.arrays_zip(F.regexp_extract_all("html", rx, 1).alias("tag"), F.regexp_extract_all("html", rx, 2).alias("text"))).alias("i", "x"),
    )
    n = F.col("i") + 1
    size = F.when(F.col("x.tag") == "h1", 18.0).when(F.col("x.tag") == "li", F.when(n % 4 == 0, 10.2).otherwise(9.0)).otherwise(10.0)
    x = x.select(
        "book", "page", n.alias("line_no"), F.col("x.text").alias("text"), size.alias("size"),
        ((F.col("x.tag") == "h1") | (n % 9 == 5)).alias("bold"), (n % 6 == 5).alias("centered"),
    )
    gap = F.when(F.col("line_no") % 7 == 0, F.col("size") * 2).when(F.col("line_no") > 1, F.col("size") * 1.5)
    return x.withColumn("gap_before", gap)


KEY_HEAD = SQUEEZE.format("regexp_replace(lower(text), '[0-9]', '#', 'g')")
HEADINGS = f"""with {STYLED},
bw as (select book, round(size * 2) / 2 as h, sum(length(text)) as n from sl group by all),
bo as (select book, arg_max(h, (n, -h)) as body from bw group by book),
ed as (select *, row_number() over (partition by book, page order by line_no) as a, row_number() over (partition by book, page order by line_no desc) as z from sl),
ks as (select distinct book, page, {KEY_HEAD} as key from ed where a <= 2 or z <= 2),
np as (select book, count(distinct page) as pages from sl group by book),
rn as (select book, key from ks join np using (book) group by book, key, pages having count(*) >= greatest(3, ceil(pages / 4))),
jl as (select *, round(size * 2) as half, size >= body * 1.12::double as large from (select *, {KEY_HEAD} as key, {WORDS} as w from sl) join bo using (book)),
cf as (select jl.* from jl left join rn on rn.book = jl.book and rn.key = jl.key where rn.key is null
  and len(w) between 1 and 15 and regexp_matches(text, '\\p{{L}}') and not regexp_matches({TRIM.format('text')}, '[,;]$')
  and (large or ((bold or centered) and size >= body * 0.95::double))),
lv as (select book, half, bold, centered, least(dense_rank() over (partition by book order by half desc, bold desc, centered desc), 4) as level from (select distinct book, half, bold, centered from cf))"""


@query(HEADINGS + " select book, page, line_no::int as line_no, text, size, level::int as level from cf join lv using (book, half, bold, centered)")
def heading_candidates(spark, sf_dir):
    return cleanup.heading_candidates(styled(spark, sf_dir)).select("book", "page", "line_no", "text", "size", "level")


def bookmarks(spark, sf_dir) -> DataFrame:
    """An outline: of every third page the second line, with a dash before it,
    then the fifth with a word before it."""
    x = styled(spark, sf_dir).where("page % 3 = 0 and line_no in (2, 5)")
    title = F.when(F.col("line_no") == 2, F.concat(F.lit("– "), "text")).otherwise(F.concat(F.lit("Part. "), "text"))
    return x.select("book", "page", F.col("line_no").alias("ord"), title.alias("title"), F.col("line_no").alias("depth"))


@query(
    HEADINGS
    + """, ol as (select book, page, line_no as ord, case line_no when 2 then w else ['part'] || w end as title, least(line_no + 1, 4) as level from jl where page % 3 = 0 and line_no in (2, 5)),
hit as (select book, page, line_no, arg_min(level, ord) as olevel from jl join ol using (book, page) where line_no <= 8 and len(w) between 1 and 15 and len(title) > 0
  and (title = w or (len(w) <= 4 and (centered or bold or large) and len(title) >= len(w) and title[len(title) - len(w) + 1:] = w)) group by all),
al as (select jl.*, lv.level, olevel, lv.level is not null and olevel is null as run from jl left join (select book, page, line_no, level from cf join lv using (book, half, bold, centered)) lv using (book, page, line_no)
  left join hit using (book, page, line_no)),
br as (select *, case when run and lag(run) over w0 and lag(half) over w0 = half and lag(bold) over w0 = bold and lag(centered) over w0 = centered and gap_before <= size * 1.6::double then 0 else 1 end as new
  from al window w0 as (partition by book, page order by line_no)),
gr as (select *, sum(new) over (partition by book, page order by line_no) as g from br)
select book, page, min(line_no)::int as line_no, min(coalesce(olevel, level))::int as level, string_agg("""
    + TRIM.format("text")
    + """, ' ' order by line_no) as text from gr where run or olevel is not null group by book, page, g"""
)
def proposed_headings(spark, sf_dir):
    return cleanup.proposed_headings(styled(spark, sf_dir), bookmarks(spark, sf_dir))


@query(f"with {STYLED}, bw as (select book, round(size * 2) / 2 as h, sum(length(text)) as n from sl group by all) select book, arg_max(h, (n, -h)) as body from bw group by book")
def body_sizes(spark, sf_dir):
    return cleanup.body_sizes(styled(spark, sf_dir))


@query(
    "with u as (select event_id, user_id as id, event_type as state, ts from events) "
    "select id, state, event_id from (select *, row_number() over (partition by id order by ts desc, event_id desc) as r from u) where r = 1"
)
def latest_states(spark, sf_dir):
    from quirework.streaming import progress

    x = read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("id"), F.col("event_type").alias("state"), "ts")
    return progress.latest_states(x).select("id", "state", "event_id")


@query(
    "select source, count(*) as every, count(*) filter (where length(text) > 2000) as long, count(*) filter (where quality = 0) as poor, "
    "count(*) filter (where quality is null) as undecided, count(*) filter (where contains(translate(lower(text), 'áàâäãåéèêëíìîïóòôöõúùûüñçýÿ', 'aaaaaaeeeeiiiiooooouuuuncyy'), 'cion')) as found "
    "from documents left join labels using (doc_id) group by source"
)
def library_facets(spark, sf_dir):
    x = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return library.facets(
        x,
        "source",
        {
            "every": F.lit(True),
            "long": F.length("text") > 2000,
            "poor": F.col("quality") == 0,
            "undecided": F.col("quality").isNull(),
            "found": F.contains(library.search_key("text"), F.lit("cion")),
        },
    )


@query(
    "select r_name, '| ' || 'key' || ' | ' || 'nation' || ' |' || chr(10) || '| --- | --- |' || chr(10) || "
    "string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) order by n_nationkey) as md from nation join region on r_regionkey = n_regionkey group by r_name"
)
def html_tables(spark, sf_dir):
    """Nations rendered as HTML tables, parsed back and written as pipe tables."""
    ship(spark)
    cell = F.concat(F.lit("<tr><td>"), F.col("n_nationkey").cast("string"), F.lit("</td><td>"), F.col("n_name"), F.lit("</td></tr>"))
    x = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    x = x.groupBy("r_name").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", cell.alias("c")))).alias("x"))
    html = F.concat(F.lit("<table><tr><th>key</th><th>nation</th></tr>"), F.array_join("x.c", ""), F.lit("</table>"))
    return x.select("r_name", tables.rows_of(html).alias("cells")).select("r_name", tables.pipe_table(F.col("cells")).alias("md"))


@query(
    "with d as (select doc_id, string_split(text, chr(10)) as ls from documents), x as (select doc_id, ls, unnest(ls) as s, generate_subscripts(ls, 1) as i from d) "
    "select doc_id, count(*) filter (where regexp_matches(s, '^#{1,6} '))::bigint as headings, "
    "count(*) filter (where contains(s, '<table'))::bigint as tables, count(*) filter (where contains(s, '!['))::bigint as images from x group by doc_id"
)
def structure(spark, sf_dir):
    x = B.structure(B.lines_of(read(spark, sf_dir, "documents")))
    return x.select("doc_id", F.col("headings").cast("long").alias("headings"), F.col("tables").cast("long").alias("tables"), F.col("images").cast("long").alias("images"))


@query(
    f"with {LINES}, t as (select book, lower(text) as x, text from l) select book, count(*) as n, "
    "sum(length(text) - length(regexp_replace(text, '[A-Za-zÀ-ɏḀ-ỿ]', '', 'g')))::bigint as latin, "
    "sum(length(text) - length(regexp_replace(text, '[Ͱ-Ͽἀ-῿]', '', 'g')))::bigint as greek from t group by book"
)
def scripts(spark, sf_dir):
    return lines(spark, sf_dir).groupBy("book").agg(
        F.count(F.lit(1)).alias("n"), F.sum(T.script_letters("text", "latin")).alias("latin"), F.sum(T.script_letters("text", "greek")).alias("greek")
    )


@query(
    f"with {REVIEW[5:]}, rr as (select book, page, row_number() over (partition by book order by risk desc, page, block nulls first, key) as rank, "
    "count(*) over (partition by book) as n, page % 7 = 0 as planted from ri), sh(share) as (values (0.1::double), (0.2::double), (0.5::double)) "
    "select book, share, count(*) filter (where planted and rank <= greatest(1, round_even(n * share, 0))) as found, "
    "count(*) filter (where planted) as planted, round(count(*) filter (where planted and rank <= greatest(1, round_even(n * share, 0))) / "
    "nullif(count(*) filter (where planted), 0), 9) as recall from rr, sh group by all"
)
def review_recall(spark, sf_dir):
    from pyspark.sql import Window

    # ranks are within a book: a book's review list is what a person reads
    w = Window.partitionBy("book").orderBy(F.desc("risk"), "page", F.asc_nulls_first("block"), "key")
    x = review_items_of(spark, sf_dir).select("book", F.row_number().over(w).alias("rank"), (F.col("page") % 7 == 0).alias("planted"))
    return metrics.recall_in_top(x).withColumn("recall", F.round("recall", 9))


@query(
    "with t as (select l.lang as book, i.item_id as ord, i.text as title from benchmark i join (select distinct lang from documents) l on true), "
    f"p as (select lang as book, unnest(string_split(text, chr(10))) as text from documents), "
    f"h as (select distinct book, ' ' || array_to_string({WORDS}, ' ') || ' ' as h from p where len({WORDS}) > 0), "
    "tt as (select book, ord, ' ' || array_to_string(list_filter(regexp_split_to_array(lower(split_part(title, chr(10), 1)), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''), ' ') || ' ' as t from t) "
    "select book, count(*) as titles, count(*) filter (where length(t) >= 5 and exists (from h where h.book = tt.book and (contains(h, t) or contains(t, h)))) as found from tt group by book"
)
def outline_recall(spark, sf_dir):
    books = read(spark, sf_dir, "documents").select(F.col("lang").alias("book")).distinct()
    items = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ord"), F.split("text", "\n")[0].alias("title"))
    names = F.array(*(F.lit(r.book) for r in books.where("book is not null").collect()))  # a few languages
    titles = items.withColumn("book", F.explode(names.cast("array<string>")))
    return metrics.outline_recall(titles, lines(spark, sf_dir)).drop("recall")


@query()
def order_scores(spark, sf_dir):
    """Order of words against the other reading; whole texts, bit-parallel."""
    ship(spark)
    p = pages(spark, sf_dir)
    x = p.withColumnRenamed("text", "reference").join(altered(p).withColumnRenamed("text", "output"), ["book", "page"])
    return metrics.order_scores(x, ["book"]).withColumn("order", F.round("order", 9))


@query(
    "select item_id, '## ' || array_to_string(string_split(text, ' ')[1:4], ' ') || "
    "coalesce(chr(10) || chr(10) || nullif(array_to_string(string_split(text, ' ')[5:], ' '), ''), '') as text from benchmark"
)
def applied_headings(spark, sf_dir):
    """Each item's first four words become a heading of level 2."""
    first = F.array_join(F.slice(F.split("text", " "), 1, 4), " ")
    heading = F.array(F.struct(first.alias("text"), F.lit(2).alias("level")))
    x = read(spark, sf_dir, "benchmark").withColumn("headings", heading)
    return headings.with_headings(x).select("item_id", "text")


@query(
    "select n_nationkey, 'N<sub>' || n_nationkey || '</sub><sup>' || n_regionkey || '</sup> × R<sub>' || substr(n_regionkey::varchar, 1, 1) || '</sub>' as html, "
    "null::varchar as unknown from nation"
)
def math_html(spark, sf_dir):
    ship(spark)
    tex = F.concat(F.lit(r"\mathrm{N}_{"), "n_nationkey", F.lit("}^{"), "n_regionkey", F.lit(r"} \times R_"), "n_regionkey")
    return read(spark, sf_dir, "nation").select(
        "n_nationkey", maths.simple_math(tex).alias("html"), maths.simple_math(F.concat(F.lit(r"\frac"), tex)).alias("unknown")
    )


@query(
    "with d as (select doc_id, string_split(replace(text, ', ', ' — '), '—') as p from documents), "
    "x as (select doc_id, unnest(p[1:-2]) as a, unnest(p[2:]) as b from d), "
    "y as (select doc_id, regexp_extract(a, '([\\p{L}\\p{N}]+) *$', 1) as l, "
    "regexp_extract(b, '^[ \\n]*[“\"‘''«¿¡(\\[_]*([\\p{L}\\p{N}]+)', 1) as r from x) "
    "select doc_id, l as left_word, r as right_word, count(*) as n from y where l <> '' and r <> '' group by all"
)
def dash_pairs(spark, sf_dir):
    """Words on both sides of every dash; commas stand in for dashes."""
    x = read(spark, sf_dir, "documents").withColumn("text", F.replace("text", F.lit(", "), F.lit(" — ")))
    x = x.select("doc_id", F.explode(repair.dash_pairs(F.col("text"))).alias("p"))
    return x.groupBy("doc_id", F.col("p.left").alias("left_word"), F.col("p.right").alias("right_word")).agg(F.count(F.lit(1)).alias("n"))


def broken(p: DataFrame) -> DataFrame:
    """Every second page has its words broken before "ta"."""
    return p.withColumn("text", F.when(F.col("page") % 2 == 1, F.replace("text", F.lit("ta"), F.lit("- ta"))).otherwise(F.col("text")))


@query(
    "with l as (select lang as book, case when doc_id % 2 = 1 then replace(text, 'ta', '- ta') else text end as text from documents), "
    "w as (select distinct book, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}-]+')) as word from l), "
    "s as (select book, string_split(regexp_replace(text, '- +', chr(1), 'g'), chr(1)) as p from l where not starts_with(text, '|')), "
    "x as (select book, unnest(p[1:-2]) as a, unnest(p[2:]) as b from s), "
    "y as (select book, lower(regexp_extract(a, '(\\p{L}+\\p{Ll})$', 1)) as l, lower(regexp_extract(b, '^(\\p{Ll}\\p{L}*)', 1)) as r from x), "
    "c as (select book, l, r, count(*) as n from y where l <> '' and r <> '' group by all), "
    "k as (select c.*, exists (from w where w.book = c.book and word = l || '-' || r) as h, exists (from w where w.book = c.book and word = l || r) as j, "
    "exists (from w where w.book = c.book and word = l) as wl, exists (from w where w.book = c.book and word = r) as wr from c) "
    "select book, l, r, n, case when h or (not j and length(l) >= 3 and length(r) >= 3 and wl and wr) then 'compound' else 'joined' end as how from k"
)
def hyphen_joins(spark, sf_dir):
    """Broken words and whether their hyphen stays, by the book's vocabulary."""
    whole = broken(pages(spark, sf_dir)).withColumn("pos", F.lit(0))
    return cleanup.hyphen_candidates(whole).groupBy("book", "l", "r", "how").agg(F.count(F.lit(1)).alias("n"))


@query()
def joined_hyphens(spark, sf_dir):
    """Pages with their broken words made whole, by each page's own words."""
    return repair.join_hyphens(broken(pages(spark, sf_dir)))


@query()
def restored_dashes(spark, sf_dir):
    """Pages that lost the dashes of their reference text."""
    own = pages(spark, sf_dir).where("text is not null")
    reference = own.withColumn("text", F.replace("text", F.lit(", "), F.lit(" — ")))
    return repair.restore_dashes(own.withColumn("text", F.replace("text", F.lit(", "), F.lit(" "))), reference)
