"""Token counts of a SentencePiece model by a join on pre-tokens.

No piece of the model holds a blank after another character nor a line feed
beside another one (checked when the model is loaded), so merges never cross
those places: a text is cut there into pre-tokens, a run of blanks or a line feed
with the word that follows.

1. Every task adds up its distinct pre-tokens; they are summed over the table and
   the pieces of each distinct one are counted once: the dictionary.
2. Pre-tokens that make up more than one in ``OFTEN`` of the table's are fewer
   than ``OFTEN`` (long ones go by their digest): that part of the dictionary is
   broadcast, and the tasks that read the texts sum it per document.
3. All other pre-tokens go, with their frequency in the document, to a shuffle
   join with the rest of the dictionary and are summed per document.  None of
   them is frequent, so no key is hot.

Ids of documents are never made.  Documents are told apart by their place in the
table, so ``docs`` must be read from files (or a written table).  Null and empty
texts have no bytes and no tokens; repeated rows are counted each.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.llm.common import batch_of, map_arrow, staged, table, text_of

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
#: Pre-tokens of more than one in so many are broadcast: fewer than that many.
OFTEN = 1 << 20
#: Characters of a pre-token that is broadcast as it is; longer ones by digest.
SHORT = 64
#: Distinct pre-tokens that a task adds up before it hands them on.
HELD = 500_000
_LOADED: dict[str, tuple] = {}
_PARTS = re.compile(r"\n[^ \n]*| +[^ \n]*|[^ \n]+")
#: A blank without a word; the symbol stands for a blank and is replaced in texts.
ALONE = "▁"


def load(model: str):
    """The model's processor, the pieces of a blank without a word, and whether
    texts may be cut."""
    if model not in _LOADED:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        plain = all(
            "▁" not in p.lstrip("▁") and ("\n" not in p or len(p) == 1)
            for p in map(sp.id_to_piece, range(sp.get_piece_size()))
        )
        alone = len(sp.encode("a ")) - len(sp.encode("a"))
        # what the cuts rest on is checked with the library as well
        for probe in ("é a\nb, c\td\n\ne", " a  b \n c▁d ", "\n\n x", "   "):
            plain = plain and len(sp.encode(probe)) == sum(pieces(sp, alone, cut(probe)))
        _LOADED[model] = (sp, alone, plain)
    return _LOADED[model]


def cut(text: str) -> list[str]:
    """The pre-tokens of a text, each without the blank that the library puts
    first (one that begins with a line feed has none)."""
    if not (text[:1] in (" ", "\n") or text[-1:] == " " or "  " in text or " \n" in text or "▁" in text):
        return text.replace("\n", " \n").split(" ") if text else []
    if not text:
        return []
    parts = _PARTS.findall(" " + text.replace("▁", " "))
    return [p if p[0] != " " else p[1:] or ALONE for p in parts]


def pieces(sp, alone: int, some: list[str]) -> list[int]:
    """The number of pieces of each pre-token."""
    return [
        alone if p == ALONE else len(ids) - p.startswith("\n")  # without the blank that the library puts first
        for p, ids in zip(some, sp.encode(some, num_threads=1), strict=True)
    ]


def frequencies(batches):
    """Distinct pre-tokens of a task with their number."""
    held: Counter[str] = Counter()

    def rows():
        return batch_of(p=pa.array(list(held), pa.string()), n=pa.array(list(held.values()), pa.int64()))

    for batch in batches:
        for text in batch.column("text").to_pylist():
            held.update(cut(text))
            if len(held) > HELD:
                yield rows()
                held.clear()
    yield rows()


def dictionary(model: str):
    """Adds the number of pieces to distinct pre-tokens."""

    def work(batches):
        sp, alone, _ = load(model)
        for batch in batches:
            k = pieces(sp, alone, batch.column("p").to_pylist())
            yield batch_of(p=batch.column("p"), n=batch.column("n"), k=pa.array(k, pa.int64()))

    return work


def digest(p: str) -> str:
    return hashlib.sha256(p.encode("utf-8", "surrogatepass")).hexdigest()


def splitter(often):
    """A row per document with the sum over broadcast pre-tokens (key: two line
    feeds and the document's place, which no pre-token holds), and a row per
    other distinct pre-token of the document."""

    def work(batches):
        known = often.value
        get = known.get
        for batch in batches:
            places, texts = batch.column("rid").to_pylist(), batch.column("text").to_pylist()
            row, head, rid, key, n, size = [], [], [], [], [], []
            for i, (at, text) in enumerate(zip(places, texts, strict=True)):
                here = 0
                parts = cut(text)
                found = list(map(get, parts))
                if None in found:
                    rest = Counter(p for p, k in zip(parts, found, strict=True) if k is None)
                    for p, m in rest.items():
                        k = get(digest(p)) if len(p) > SHORT else None
                        if k is None:
                            row.append(i)
                            head.append(False)
                            rid.append(at)
                            key.append(p)
                            n.append(m)
                            size.append(None)
                        else:
                            here += k * m
                    here += sum(k for k in found if k is not None)
                else:
                    here = sum(found)
                row.append(i)
                head.append(True)
                rid.append(at)
                key.append(f"\n\n{at}")
                n.append(here)
                size.append(len(text.encode("utf-8", "surrogatepass")))
            # the id goes with the document's own row only
            of = pa.array([i if h else None for i, h in zip(row, head, strict=True)], pa.int64())
            yield batch_of(
                doc_id=batch.column("doc_id").take(of),
                rid=pa.array(rid, pa.int64()),
                key=pa.array(key, pa.string()),
                n=pa.array(n, pa.int64()),
                n_bytes=pa.array(size, pa.int64()),
            )

    return work


def whole_counter(model: str):
    """Counts whole texts: for a model whose pieces cross blanks."""

    def work(batches):
        sp = load(model)[0]
        for batch in batches:
            texts = batch.column("text").to_pylist()
            yield batch_of(
                doc_id=batch.column("doc_id"),
                n_bytes=pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()),
                n_tokens=pa.array([len(x) for x in sp.encode(texts, num_threads=1)], pa.int64()),
            )

    return work


def token_counts(docs: DataFrame, model: str, limit: int = LIMIT, often: int = OFTEN) -> DataFrame:
    """Bytes, tokens and whether there are more than ``limit`` of them."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", text_of().alias("text"))
    over = (F.col("n_tokens") > limit).alias("over_limit")
    if not load(model)[2]:
        counted = map_arrow(texts, whole_counter(model), f"doc_id {kind}, n_bytes long, n_tokens long")
        return counted.select("doc_id", "n_bytes", "n_tokens", over)
    distinct = map_arrow(texts.select("text"), frequencies, "p string, n long").groupBy("p").agg(F.sum("n").alias("n"))
    words = staged(map_arrow(distinct, dictionary(model), "p string, n long, k long"), "pretokens")
    total = words.agg(F.sum("n")).first()[0] or 0
    frequent = F.col("n") * F.lit(often) > F.lit(total)
    name = F.when(F.length("p") > SHORT, F.sha2(F.col("p").cast("binary"), 256)).otherwise(F.col("p"))
    top = words.where(frequent).select(name.alias("p"), "k").toArrow().to_pydict()
    shared = docs.sparkSession.sparkContext.broadcast(dict(zip(top["p"], top["k"], strict=True)))
    rows = map_arrow(
        texts.withColumn("rid", F.monotonically_increasing_id()),
        splitter(shared),
        f"doc_id {kind}, rid long, key string, n long, n_bytes long",
    )
    rest = words.where(~frequent).select(F.col("p").alias("key"), "k")
    # a document's own row finds nothing and stands for itself
    return (
        rows.join(rest, "key", "left")
        .groupBy("rid")
        .agg(
            F.first("doc_id", ignorenulls=True).alias("doc_id"),
            F.max("n_bytes").alias("n_bytes"),
            F.sum(F.col("n") * F.coalesce("k", F.lit(1))).alias("n_tokens"),
        )
        .select("doc_id", "n_bytes", "n_tokens", over)
    )


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))
