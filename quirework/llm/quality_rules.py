"""Quality rules with risk-controlled thresholds (native DataFrame functions).

Every rule rejects a document whose statistic reaches a cutoff.  The cutoffs
come from fixed grids; labelled good documents are the holdout.  For a stratum
with ``n`` good documents of which a cutoff rejects ``k``, the hypothesis "this
cutoff rejects more than ``alpha`` of good documents" has the exact p-value
``P(Binomial(n, alpha) <= k)``.  Cutoffs with ``p <= delta / m`` are certified,
``m`` being the number of all (stratum, rule, cutoff) tests (Bonferroni), and
each rule takes the strictest certified cutoff.  With probability at least
``1 - delta`` no rule rejects more than ``risk / rules`` of the good documents
of any stratum, so all rules together reject at most ``risk`` of them.  A rule
without a certified cutoff is off in that stratum (it rejects nothing).

Null or empty texts have no words, so they fail the base rules.  A null stratum
is a stratum of its own.  Rows that repeat are judged each.  Other columns are
ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.llm.common import staged, table, text_of

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
RISK, DELTA = 0.02, 0.05
#: (rule, statistic, cutoffs): rejects where the statistic >= the cutoff.  The
#: statistics are integers, shares are in thousandths.
RULES = (
    ("symbols", "symbol_pm", (20, 30, 50, 80, 120, 200)),
    ("lines", "dup_line_pm", (150, 250, 350, 500, 700)),
    ("repeats", "repeat_pm", (100, 150, 200, 300, 400)),
    ("capitals", "upper_pm", (150, 250, 400, 600)),
    ("marks", "mark_pm", (60, 90, 130, 200)),
)


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for each row."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")


def repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more: windows are sorted
    by (hash, text), equal neighbours kept, their starts sorted and the union of
    the three-word ranges summed.  O(n log n) for a text of n words."""

    def windows(w):
        return F.sort_array(
            F.transform(
                F.sequence(F.lit(0), F.size(w) - 3),
                lambda i: bind(
                    F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)),
                    lambda k: F.struct(F.xxhash64(k).alias("h"), k.alias("k"), i.alias("i")),
                ),
            )
        )

    def same(s, j, k):
        a, b = F.get(s, j), F.get(s, k)
        return F.coalesce((a["h"] == b["h"]) & (a["k"] == b["k"]), F.lit(False))

    def starts(s):
        found = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: same(s, j, j - 1) | same(s, j, j + 1))
        return F.sort_array(F.transform(found, lambda j: F.get(s, j)["i"]))

    def covered(p):
        return F.when(F.size(p) == 0, F.lit(0)).otherwise(
            F.aggregate(
                F.sequence(F.lit(0), F.size(p) - 1),
                F.lit(0),
                lambda total, j: total + F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - F.get(p, j), F.lit(3))),
            )
        )

    return F.when(F.size(words) < 3, F.lit(0)).otherwise(bind(windows(words), lambda s: bind(starts(s), covered)))


def statistics(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """The counts of every text and the integer statistics of the rules."""
    text = F.col("_t")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t\\n\\x0B\\f\\r]"))
    base = docs.select("doc_id", F.col(stratum).cast("string").alias("stratum"), text_of().alias("_t")).select(
        "doc_id",
        "stratum",
        F.length(F.translate(text, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length(text) - F.length(F.translate(text, "!?", ""))).cast("long").alias("n_marks"),
        (F.length(text) - F.length(F.regexp_replace(text, "\\p{Lu}+", ""))).cast("long").alias("n_upper"),
        bind(
            lines,
            lambda x: F.struct(
                F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")
            ),
        ).alias("_l"),
        bind(
            words_of(text),
            lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).cast("long").alias("rep")),
        ).alias("_w"),
    )

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, F.floor(part * 1000 / whole)).otherwise(F.lit(0)).cast("long")

    return base.select(
        "doc_id",
        "stratum",
        F.col("_w.n").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.col("_l.dup").alias("n_dup_lines"),
        F.col("_w.rep").alias("n_repeat_words"),
        ((F.col("_w.n") < 50) | (F.col("_w.rep") * 100 > F.col("_w.n") * 50)).alias("base_failed"),
        share(F.col("n_symbols"), F.col("word_chars")).alias("symbol_pm"),
        share(F.col("_l.dup"), F.col("_l.n")).alias("dup_line_pm"),
        share(F.col("_w.rep"), F.col("_w.n")).alias("repeat_pm"),
        share(F.col("n_upper"), F.col("word_chars")).alias("upper_pm"),
        share(F.col("n_marks"), F.col("word_chars")).alias("mark_pm"),
    )


def log_factorial(x: Column) -> Column:
    """ln x! by Stirling's series at x + 9, stepped down (error below 1e-12)."""
    z = x + F.lit(9.0)
    series = 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z)
    steps = F.lit(1.0)
    for i in range(1, 9):
        steps = steps * (x + F.lit(float(i)))
    return (z - 0.5) * F.log(z) - z + F.lit(0.5 * math.log(2 * math.pi)) + series - F.log(steps)


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k), 1 from the mean on.  Below the mean the terms
    fall from k down, so those within 12 deviations are all that counts."""
    k, n = k.cast("double"), n.cast("double")
    top = F.exp(log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * math.log(p) + (n - k) * math.log1p(-p))
    reach = F.least(k, F.ceil(F.sqrt(n * p) * 12) + 64).cast("long")
    total = F.aggregate(
        F.sequence(F.lit(0).cast("long"), reach),
        F.struct(F.lit(1.0).alias("t"), F.lit(0.0).alias("s")),
        lambda a, j: F.struct(
            (a["t"] * (k - j) * (1 - p) / ((n - k + j + 1) * p)).alias("t"), (a["s"] + a["t"]).alias("s")
        ),
        lambda a: a["s"],
    )
    return F.when(k >= n * p, F.lit(1.0)).otherwise(top * total)


def certified(stats: DataFrame, good: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """One row per stratum with the cutoff of each rule, null where off.

    ``good``: the doc_id of labelled good documents (repeats count once)."""
    tests = [(rule, stat, c) for rule, stat, cuts in RULES for c in cuts]
    held = stats.where(~F.col("base_failed")).join(
        good.select("doc_id").where("doc_id is not null").distinct(), "doc_id", "left_semi"
    )
    counts = staged(
        held.groupBy("stratum").agg(
            F.count(F.lit(1)).alias("n"),
            *(F.sum((F.col(stat) >= c).cast("long")).alias(f"{rule}_{c}") for rule, stat, c in tests),
        ),
        "rules",
    )
    level = delta / max(1, counts.count() * len(tests))
    cuts = {
        rule: F.least(
            *(
                F.when(binomial_cdf(F.col(f"{rule}_{c}"), F.col("n"), risk / len(RULES)) <= level, F.lit(c))
                for c in grid
            )
        )
        for rule, _, grid in RULES
    }
    return counts.select("stratum", *(v.alias(f"cut_{k}") for k, v in cuts.items()))


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """Counts, base verdict and the risk-controlled verdict of every document."""
    stats = staged(statistics(docs, stratum), "stats")
    cuts = certified(stats, labels.where("quality = 1"))
    failed = F.lit(False)
    for rule, stat, _ in RULES:
        failed = failed | F.coalesce(F.col(stat) >= F.col(f"cut_{rule}"), F.lit(False))
    joined = stats.join(cuts.withColumnRenamed("stratum", "_s"), F.col("stratum").eqNullSafe(F.col("_s")), "left")
    return joined.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & ~failed).alias("kept"),
    )


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def oracle() -> str:
    """DuckDB SQL for the same rows."""
    tests = [(rule, stat, c) for rule, stat, cuts in RULES for c in cuts]
    alpha = RISK / len(RULES)
    rows = ", ".join(f"('{r}', '{s}', {c})" for r, s, c in tests)
    value = "case stat " + " ".join(f"when '{s}' then {s}" for _, s, _ in RULES) + " end"
    return f"""
with t as (select row_number() over () as rid, doc_id, lang as stratum, coalesce(text, '') as text from documents),
w as (select rid, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') as ws,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]')) as ls from t),
g as (select rid, unnest(range(1, len(ws) - 1)) as i, ws from w where len(ws) >= 3),
gk as (select rid, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] as k from g),
d as (select rid, i, count(*) over (partition by rid, k) as c from gk),
p as (select distinct rid, unnest([i, i+1, i+2]) as pos from d where c > 1),
r as (select rid, count(*) as rep from p group by rid),
s as (select t.doc_id, t.stratum, len(ws) as n_words,
        length(translate(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) as word_chars,
        length(text) - length(translate(text, '{SYMBOLS}', '')) as n_symbols,
        length(text) - length(translate(text, '!?', '')) as n_marks,
        length(text) - length(regexp_replace(text, '\\p{{Lu}}+', '', 'g')) as n_upper,
        len(ls) as n_lines, len(ls) - len(list_distinct(ls)) as n_dup_lines, coalesce(rep, 0) as n_repeat_words
      from t join w using (rid) left join r using (rid)),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
        case when word_chars > 0 then 1000 * n_symbols // word_chars else 0 end as symbol_pm,
        case when n_lines > 0 then 1000 * n_dup_lines // n_lines else 0 end as dup_line_pm,
        case when n_words > 0 then 1000 * n_repeat_words // n_words else 0 end as repeat_pm,
        case when word_chars > 0 then 1000 * n_upper // word_chars else 0 end as upper_pm,
        case when word_chars > 0 then 1000 * n_marks // word_chars else 0 end as mark_pm from s),
tests(rule, stat, cut) as (values {rows}),
held as (select * from f where not base_failed and doc_id in (select doc_id from labels where quality = 1)),
k as (select stratum, rule, cut, count(*) as n, count(*) filter (where {value} >= cut) as k
      from held, tests group by all),
m as (select count(distinct coalesce('v' || stratum, 'n')) * {len(tests)} as m from held),
pv as (select stratum, rule, cut, case when k >= n * {alpha} then 1 else list_sum(list_transform(range(0, k + 1),
        lambda j: exp(lgamma(n + 1.0) - lgamma(j + 1.0) - lgamma(n - j + 1.0) + j * ln({alpha}) + (n - j) * ln(1 - {alpha})))) end as p from k),
c as (select stratum, rule, min(cut) as cut from pv, m where p <= {DELTA} / m group by all),
bad as (select distinct f.doc_id from f join c on f.stratum is not distinct from c.stratum
        join tests on tests.rule = c.rule and tests.cut = c.cut where {value} >= c.cut)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
  n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, base_failed,
  not base_failed and doc_id not in (select doc_id from bad) as kept from f"""
