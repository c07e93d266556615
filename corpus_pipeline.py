"""The corpus pipeline: five operators in order over ``documents``.

Each stage works on everything its predecessor kept and returns the columns of
``documents``; the last one returns packed pieces.  ``run`` writes every stage
as Parquet to the shared folder and reads it again, so a lost executor costs at
most one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.llm import decontaminate, packing, pii, quality_knn, simhash
from quirework.llm.common import staged, table

#: The stages learn, compare texts and encode: SQL can't express them.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    scored = quality_knn.quality_scores(docs, table(spark, sf_dir, "labels"), tuple(docs.columns))
    return scored.where(F.col("score") >= quality_knn.THRESHOLD).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest doc_id, null
    ids last (of rows that share it, the one with the least hash)."""
    # a row is told by two hashes of all its columns; a null leaves a hash as it is, so nulls are hashed too
    whole = [*docs.columns, *(F.col(c).isNull() for c in docs.columns)]
    marked = docs.withColumn("_a", F.xxhash64(*whole)).withColumn("_b", F.xxhash64(F.lit(1), *whole))
    keepers = simhash.simhash_keepers(marked, ("_a", "_b"))
    # rows that are alike in every column share the hashes: one of them stays
    return marked.join(keepers, ["_a", "_b"], "left_semi").dropDuplicates(["_a", "_b"]).select(docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), keep=tuple(docs.columns))
    return found.where(~F.col("contaminated")).select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data is replaced by its kind; n_chars follows."""
    found = pii.personal_data(docs.withColumn("_text", F.col("text")), keep=(*docs.columns, "_text"))
    text = F.coalesce("redacted", "_text")
    return found.withColumn("text", text).withColumn(
        "n_chars", F.when(F.col("redacted").isNull(), F.col("n_chars")).otherwise(F.length(text).cast("long"))
    ).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Everything that is left, packed into sequences."""
    import public_tokenizers

    return packing.best_fit_packing(docs, public_tokenizers.path(packing.TOKENIZER))


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("PII", personal_data),
    ("best-fit packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), "stage-" + name.split()[0].lower())
    return docs
