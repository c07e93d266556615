"""Repairs inside texts: dashes that a reading lost, words broken by a hyphen.

What to repair is decided from whole-page counts; the edits themselves depend on
places in one text, so they run Arrow-batched, a page (dashes) or a document
(hyphens) a row.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from quirework.shipping import ship

# fixed values: the dashes, and what may stand between a dash and its word
DASHES = "—–"
OPENERS = "“\"‘'«¿¡([_"

_OPEN = f"[{re.escape(OPENERS)}]*"
_JAVA_OPEN = r"[“\"‘'«¿¡(\[_]*"
#: Left word, spaces, dash, gap; the right word is only looked at, as it may be
#: the left one of the next pair.
_PAIR = rf"(?<![\p{{L}}\p{{N}}])([\p{{L}}\p{{N}}]++)( *+)([{DASHES}])(?=([ \n]*){_JAVA_OPEN}([\p{{L}}\p{{N}}]+))"


def dash_pairs(text: Column) -> Column:
    """Array of (left, right, dash, before, after): single dashes between two
    words; ``before`` and ``after`` tell whether there is a space, and ``after``
    is null if the dash ends its line.  A null text has null."""
    part = lambda i: F.regexp_extract_all(text, F.lit(_PAIR), F.lit(i))
    zipped = F.arrays_zip(part(1).alias("l"), part(5).alias("r"), part(3).alias("d"), part(2).alias("b"), part(4).alias("g"))
    return F.transform(
        zipped,
        lambda x: F.struct(
            x["l"].alias("left"),
            x["r"].alias("right"),
            x["d"].alias("dash"),
            (x["b"] != "").alias("before"),
            F.when(~F.contains(x["g"], F.lit("\n")), x["g"] != "").alias("after"),
        ),
    )


_WORD = re.compile(r"[^\W_]+")
_DASHED = re.compile(rf"[ \n]*[{DASHES}][ \n]*{_OPEN}")
_GAP = re.compile(rf"([ \n]+){_OPEN}")


def restored(text: str | None, pairs) -> tuple[str | None, int]:
    """The text with lost dashes put back, and how many.  A pair is repaired only
    if it has as many places without a dash as dashes are missing.  The text is
    read once, whatever the number of pairs."""
    if text is None or pairs is None or not len(pairs):
        return text, 0
    wanted = Counter((p["left"], p["right"], p["dash"], p["before"], p["after"]) for p in pairs)
    # where each pair of words stands: (end of the left word, blanks between; None if there is a dash, "" if glued)
    places: dict[tuple[str, str], list[tuple[int, str | None]]] = {(w[0], w[1]): [] for w in wanted}
    glued: dict[str, list[tuple[str, str]]] = {}
    for left, right in places:
        glued.setdefault(left + right, []).append((left, right))
    last, end = "", 0
    for m in _WORD.finditer(text):
        word, start = m[0], m.start()
        for pair in glued.get(word, ()):
            places[pair].append((start + len(pair[0]), ""))
        if (last, word) in places:
            if _DASHED.fullmatch(text, end, start):
                places[last, word].append((end, None))
            elif gap := _GAP.fullmatch(text, end, start):
                places[last, word].append((end, gap[1]))
        last, end = word, m.end()
    edits: dict[int, tuple[int, str]] = {}
    for left, right, dash, before, after in sorted(wanted, key=str):
        found = places[left, right]
        bare = [(at, gap) for at, gap in found if gap is not None]
        if not bare or len(bare) != wanted[left, right, dash, before, after] - (len(found) - len(bare)):
            continue
        lead = " " * before + dash
        for at, gap in bare:
            if gap == "":
                new = (0, lead + " " * bool(after))
            else:  # a closed dash takes the space's place, but no line break's
                new = (0 if before or after or "\n" in gap else len(gap), lead)
            edits.setdefault(at, new)
    out, at = [], 0
    for place in sorted(edits):
        size, new = edits[place]
        out += [text[at:place], new]
        at = place + size
    return "".join([*out, text[at:]]), len(edits)


@F.pandas_udf(StructType().add("text", StringType()).add("restored", IntegerType()))
def _restored(text: pd.Series, pairs: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([restored(t, p) for t, p in zip(text, pairs, strict=True)], columns=["text", "restored"])


def restore_dashes(pages: DataFrame, references: DataFrame) -> DataFrame:
    """``pages`` (book, page, text) with the dashes of ``references`` (same
    columns, one row a page) put back, and their number in ``restored``.  Pages
    without a reference, a page number or a text stay as they are."""
    ship(pages.sparkSession)
    own = references.select(F.col("book").alias("_b"), F.col("page").alias("_p"), dash_pairs(F.col("text")).alias("_pairs"))
    own = own.where(F.size("_pairs") > 0)
    x = pages.join(own, (F.col("book") == F.col("_b")) & (F.col("page") == F.col("_p")), "left")
    kept = [c for c in pages.columns if c not in ("text", "restored")]
    x = x.withColumn("_x", _restored("text", "_pairs"))
    return x.select(*kept, F.col("_x.text").alias("text"), F.col("_x.restored").alias("restored"))


_BREAK = re.compile(r"-(?P<gap>(?:\s+|<!-- page:(?:(?!-->).)*-->)+)(?P<right>[^\W\d_]+)", re.S)
_MARKER = re.compile(r"<!-- page:(?:(?!-->).)*-->", re.S)
_SPACES = re.compile(" *")
_LEFT = re.compile(r"[^\W\d_]+")
_WORDS = re.compile(r"(?:[^\W_]|-)+")


def untouchable(text: str) -> list[tuple[int, int]]:
    """Spans of fenced lines and of table rows."""
    spans, at, fenced = [], 0, False
    for line in text.split("\n"):
        fenced ^= line.startswith("```")
        if fenced or line.startswith("|"):
            spans.append((at, at + len(line) + 1))
        at += len(line) + 1
    return spans


def compound(left: str, right: str, seen: Counter) -> bool:
    """Whether the document itself shows that the hyphen belongs to the word."""
    if seen[f"{left}-{right}"]:
        return True
    return not seen[left + right] and min(len(left), len(right)) >= 3 and seen[left] > 0 and seen[right] > 0


def joined(text: str | None) -> tuple[str | None, int]:
    """The text with words broken at line ends made whole, and how many.  A page
    marker between the halves moves behind the word."""
    if text is None:
        return None, 0
    text = text.replace("\r\n", "\n")
    seen = skip = None  # most texts have no break and need neither
    out, at, n, s = [], 0, 0, 0
    for m in _breaks(text):
        if seen is None:
            seen, skip = Counter(w.lower() for w in _WORDS.findall(text)), untouchable(text)
        hyphen = m.start()
        while s < len(skip) and skip[s][1] <= hyphen:
            s += 1
        if hyphen < at or (s < len(skip) and skip[s][0] <= hyphen):
            continue
        start = hyphen
        while start and _LEFT.fullmatch(text[start - 1]):
            start -= 1
        left, right = text[start:hyphen], m["right"]
        if len(left) < 2 or not left[-1].islower() or not right[0].islower():
            continue
        out += [text[at:hyphen], "-" * compound(left.lower(), right.lower(), seen), right]
        at = m.end()
        markers = _MARKER.findall(m["gap"])
        if markers:
            out.append("\n\n" + "".join(markers) + "\n\n")
            at = _SPACES.match(text, at).end()
        n += 1
    return "".join([*out, text[at:]]), n


def _breaks(text: str):
    """Breaks in order; the right half of one may be the left half of the next."""
    m = _BREAK.search(text)
    while m:
        yield m
        m = _BREAK.search(text, m.start() + 1)


@F.pandas_udf(StructType().add("text", StringType()).add("joined", IntegerType()))
def _joined(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([joined(t) for t in text], columns=["text", "joined"])


def join_hyphens(docs: DataFrame) -> DataFrame:
    """``docs`` with broken words joined in ``text``, and their number in
    ``joined``; each document decides by its own words.  Null stays null."""
    ship(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("text", "joined")]
    x = docs.withColumn("_x", _joined("text"))
    return x.select(*kept, F.col("_x.text").alias("text"), F.col("_x.joined").alias("joined"))
