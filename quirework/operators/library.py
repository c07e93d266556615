"""The library: documents, decisions, views and searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.functions import text as T


def upsert_documents(library: DataFrame, added: DataFrame) -> DataFrame:
    """New documents join; known ones only get the new name and path."""
    new = added.select("id", F.col("name").alias("_n"), F.col("path").alias("_p"), F.col("pages").alias("_g"), F.col("added_at").alias("_a"))
    x = library.join(new, "id", "full_outer")
    return x.select(
        "id",
        F.coalesce("_n", "name").alias("name"),
        F.coalesce("_p", "path").alias("path"),
        F.coalesce("pages", "_g").alias("pages"),
        F.coalesce("visual_full", F.lit(False)).alias("visual_full"),
        F.coalesce("added_at", "_a").alias("added_at"),
    )


def latest(rows: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """The last row of each key (max_by keeps one row a key on every task)."""
    rest = [c for c in rows.columns if c not in keys]
    x = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*by)).alias("x"))
    return x.select(*keys, *(F.col(f"x.{c}").alias(c) for c in rest))


def decided(decisions: DataFrame) -> DataFrame:
    return latest(decisions, ["doc_id", "key"], ["decided_at", "decision"])


def remove_documents(library: DataFrame, decisions: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    ids = gone.select("id").distinct()
    return library.join(ids, "id", "left_anti"), decisions.join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_anti")


def search_key(text) -> Column:
    """Lower case without the accents of Latin letters."""
    return F.translate(F.lower(T.col(text)), "áàâäãåéèêëíìîïóòôöõúùûüñçýÿ", "aaaaaaeeeeiiiiooooouuuuncyy")


def found(library: DataFrame, query: str) -> DataFrame:
    return library.where(F.contains(search_key("name"), search_key(F.lit(query))))


def facets(library: DataFrame, group: str, filters: dict[str, Column]) -> DataFrame:
    return library.groupBy(group).agg(*(F.count_if(c).alias(n) for n, c in filters.items()))


def natural_key(text) -> Column:
    """Sorts numbers inside names by value: digit runs padded to twelve."""
    t = F.regexp_replace(search_key(text), "([0-9]+)", "000000000000$1")
    return F.regexp_replace(t, "0*([0-9]{12})(?![0-9])", "$1")


def palette(commands: DataFrame, query: str, most: int = 60) -> DataFrame:
    """Entries that contain the query, those that begin with it first."""
    q, k = search_key(F.lit(query)), search_key("label")
    return commands.where(F.contains(k, q)).orderBy((~k.startswith(q)).cast("int"), "label").limit(most)


def next_step(view: DataFrame) -> DataFrame:
    step = F.when(~F.col("converted"), "convert").when(F.col("pending") > 0, "review").when(~F.col("exported"), "export").otherwise("done")
    return view.withColumn("step", step)


def set_option(library: DataFrame, id, value: bool) -> tuple[DataFrame, bool]:
    """The library with a document's option set, and whether there is one."""
    changed = library.withColumn("visual_full", F.when(F.col("id") == id, F.lit(value)).otherwise(F.col("visual_full")))
    return changed, not library.where(F.col("id") == id).isEmpty()


def decisions_of(decisions: DataFrame, doc) -> DataFrame:
    return decisions.where(F.col("doc_id") == doc)


def without_decisions(decisions: DataFrame, docs: DataFrame) -> DataFrame:
    """Decisions of all documents but these."""
    return decisions.join(docs.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_anti")


def listed(library: DataFrame) -> DataFrame:
    """Documents in the order in which they came."""
    return library.orderBy("added_at", "id")


#: Columns that each version of the store added.
VERSIONS = {1: ("id", "name", "path", "pages", "added_at"), 2: ("visual_full",), 3: ("decided",)}


def upgraded(library: DataFrame, version: int) -> DataFrame:
    """A library of an older version with the columns that came since (null);
    a newer one is refused."""
    if version not in VERSIONS:
        raise ValueError(f"version {version} is newer than {max(VERSIONS)}")
    for later in range(version + 1, max(VERSIONS) + 1):
        for c in VERSIONS[later]:
            if c not in library.columns:
                library = library.withColumn(c, F.lit(None).cast("boolean"))
    return library


def document_view(library: DataFrame, results: DataFrame, running: DataFrame, translations: DataFrame, reviews: DataFrame) -> DataFrame:
    """What the library shows of a document: whether it is converted, what runs
    on it, its translations, and its review items (pending ones too)."""
    task = running.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("task")), ",").alias("tasks"))
    done = translations.groupBy("id").agg(F.count(F.lit(1)).alias("translations"))
    zero = F.lit(0).cast("long")
    x = library.join(results.select("id", F.lit(True).alias("converted")).distinct(), "id", "left").join(task, "id", "left")
    x = x.join(done, "id", "left").join(reviews.select("id", "items", "pending"), "id", "left")
    return (
        x.withColumn("converted", F.coalesce("converted", F.lit(False)))
        .withColumn("tasks", F.coalesce("tasks", F.lit("")))
        .withColumns({c: F.coalesce(c, zero) for c in ("translations", "items", "pending")})
    )
