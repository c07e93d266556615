"""The pipeline's stages against what they must keep and drop."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from quirework.llm import decontaminate, pii, quality_knn, simhash
from quirework.llm.common import table

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, DATA, "documents")
    kept = docs
    for (name, stage), check in zip(corpus_pipeline.STAGES, (quality, near, clean, private, None), strict=True):
        out = stage(spark, kept, DATA).cache()
        if check:
            assert out.columns == docs.columns, name
            check(spark, kept, out)
        kept = out
    assert kept.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


def quality(spark, docs, out):
    scored = quality_knn.quality_scores(docs, table(spark, DATA, "labels"))
    good = {r.doc_id for r in scored.where(f"score >= {quality_knn.THRESHOLD}").collect()}
    assert {r.doc_id for r in out.select("doc_id").collect()} == good and good


def near(spark, docs, out):
    groups = {r.doc_id: r.component_id for r in simhash.simhash_groups(docs).collect()}
    assert sorted(r.doc_id for r in out.select("doc_id").collect()) == sorted(set(groups.values()))


def clean(spark, docs, out):
    bad = decontaminate.decontaminate(docs, table(spark, DATA, "benchmark")).where("contaminated")
    bad = {r.doc_id for r in bad.collect()}
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()} - bad


def private(spark, docs, out):
    before = {r.doc_id: r.text for r in docs.collect()}
    for r in out.collect():
        assert pii.base_spans(r.text) == []
        if not pii.base_spans(before[r.doc_id]) and "<" not in r.text:
            assert r.text == before[r.doc_id]
        assert r.n_chars == len(r.text)


def test_awkward_rows(spark):
    docs = table(spark, DATA, "documents").limit(60)
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (None, "x y", "en", None, 3), (5, "", "en", "s", 0), (5, "", "en", "s", 0)], docs.schema
    )
    kept = docs.unionByName(odd)
    for _, stage in corpus_pipeline.STAGES[1:]:
        kept = stage(spark, kept, DATA).cache()
        kept.count()
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, DATA).count() == 0


def test_each_group_keeps_one(spark):
    words = [" ".join(f"{w}{i}" for i in range(60)) for w in ("ant", "bee", "cat", "dog", "elk")]
    made = [
        (None, words[0], "en", None, 1), (None, words[0], "en", None, 1), (None, words[0], None, "en", 1),
        (None, words[1], "en", "s", 2),
        (None, words[2], "en", "s", 3), (4, words[2], "en", "s", 3), (9, words[2], "en", "s", 3),
        (7, words[3], "en", "s", 4), (7, words[4], "en", "s", 5), (7, words[4], "en", "s", 5),
        (8, words[3], "en", "s", 4),
    ]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    out = corpus_pipeline.near_duplicates(spark, docs, DATA)
    assert out.columns == docs.columns
    assert Counter((r.text, r.doc_id) for r in out.collect()) == Counter(
        [(words[0], None), (words[1], None), (words[2], 4), (words[3], 7), (words[4], 7)]
    )
