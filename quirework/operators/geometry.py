"""Lines of text with their styles, from the pieces that a page is drawn of.

A page's pieces are few and a band of text depends on the band before it, so each
page is handled whole, Arrow-batched; pages are independent.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.functions import text as T
from quirework.shipping import ship

#: A gutter: points at least, share of letters that may cross it (1/20) and that
#: each side has at least (1/4); pages narrower than 100 points have none.
GUTTER, CROSSING, SIDE, NARROW = 6.0, 20, 4, 100.0
EDGE = 3.0
WHOLE, LEFT, RIGHT = 0, 1, 2
_STYLED = "page int, line_no int, text string, size double, bold boolean, centered boolean, gap_before double, column int"


def is_bold(font, weight, reinforced) -> Column:
    """By the font's name, its weight (700, 800 or 900) or reinforcement."""
    named = F.lower(T.col(font)).rlike("bold|black|heavy")
    flags = [named, T.col(weight).isin(700, 800, 900), T.col(reinforced)]
    return F.greatest(*(F.coalesce(f, F.lit(False)) for f in flags))


def gutter(pieces: list[dict]) -> tuple[float, float] | None:
    """The widest strip in the middle third that hardly any letter crosses, with
    text enough on both sides; null on pages of one column."""
    letters, left, right = (np.array([p[c] for p in pieces]) for c in ("letters", "left", "right"))
    total = letters.sum()
    if not total:
        return None
    low, high = left.min(), right.max()
    width = high - low
    if width < NARROW:
        return None
    stop = low + width * 2 / 3
    best = start = None
    x = low + width / 3
    while x <= stop + 0.5:
        free = x <= stop and letters[(left < x) & (right > x)].sum() * CROSSING <= total
        if free and start is None:
            start = x
        elif not free and start is not None:
            if best is None or x - 1.0 - start > best[1] - best[0]:
                best = (start, x - 1.0)
            start = None
        x += 1.0
    if best is None or best[1] - best[0] < GUTTER:
        return None
    sides = letters[right <= best[0] + 1.0].sum(), letters[left >= best[1] - 1.0].sum()
    return best if min(sides) * SIDE >= total else None


def banded(pieces: list[dict]) -> list[list[dict]]:
    """Bands from the top down; a piece joins a band whose first piece's centre
    is within half the larger height."""
    bands: list[list[dict]] = []
    for p in sorted(pieces, key=lambda p: (-p["center"], p["left"])):
        if bands and abs(bands[-1][0]["center"] - p["center"]) <= 0.5 * max(bands[-1][0]["height"], p["height"]):
            bands[-1].append(p)
        else:
            bands.append([p])
    return bands


def in_columns(bands: list[list[dict]], strip: tuple[float, float] | None) -> list[tuple[list[dict], int]]:
    """Bands in reading order with their column: between two bands over the whole
    width the left column comes first, then the right one."""
    if strip is None:
        return [(b, WHOLE) for b in bands]
    out, lefts, rights = [], [], []
    for b in bands:
        if any(p["left"] < strip[1] - 0.5 and p["right"] > strip[0] + 0.5 for p in b):
            out += [*lefts, *rights, (b, WHOLE)]
            lefts, rights = [], []
            continue
        on_left = [p for p in b if p["right"] <= strip[0] + 0.5]
        on_right = [p for p in b if p["right"] > strip[0] + 0.5]
        lefts += [(on_left, LEFT)] if on_left else []
        rights += [(on_right, RIGHT)] if on_right else []
    return [*out, *lefts, *rights]


def common_edge(values: list[float]) -> float:
    """The most common value in steps of three points; ties to the smaller."""
    steps = Counter(int(np.floor(v / EDGE + 0.5)) for v in values)
    return min(steps, key=lambda k: (-steps[k], k)) * EDGE


def joined(line: list[dict], size: float) -> str:
    """Pieces joined, with a blank where the gap is over a quarter of the size."""
    out, end = "", None
    for p in line:
        if t := p["text"].strip():
            out += " " * (end is not None and p["left"] - end > max(size, 1.0) * 0.25) + t
            end = p["right"]
    return out


def once(line: list[dict]) -> list[dict]:
    """Pieces drawn twice almost on top of each other, as bold fakes are, once."""
    kept: list[dict] = []
    for p in line:
        if kept:
            overlap = min(kept[-1]["right"], p["right"]) - max(kept[-1]["left"], p["left"])
            if p["text"].strip() == kept[-1]["text"].strip() and overlap > max(p["right"] - p["left"], 0.1) * 0.5:
                continue
        kept.append(p)
    return kept


def left_of(line: list[dict]) -> float:
    return min(p["left"] for p in line)


def right_of(line: list[dict]) -> float:
    return max(p["right"] for p in line)


def page_lines(pieces: list[dict]) -> list[tuple]:
    """(text, size, bold, centered, gap_before, column) of a page's lines, in
    reading order.  Pieces without a letter or digit form no line of their own."""
    lines = in_columns(banded(pieces), gutter(pieces))
    bounds = {}
    for column in (WHOLE, LEFT, RIGHT):
        own = [b for b, c in lines if column in (WHOLE, c)]
        bounds[column] = (common_edge([left_of(b) for b in own]), common_edge([right_of(b) for b in own])) if own else None
    out, above = [], None
    for band, column in lines:
        band = sorted(band, key=lambda p: p["left"])
        line = once(band)
        total = sum(p["letters"] for p in line)
        if not total:
            continue
        weights: Counter = Counter()
        for p in line:
            weights[int(np.floor(p["size"] * 2 + 0.5))] += p["letters"]
        size = min(weights, key=lambda k: (-weights[k], k)) / 2
        bold = len(line) < len(band) or sum(p["letters"] for p in line if p["bold"]) * 5 >= total * 4
        centered = False
        if bounds[column] and bounds[column][1] > bounds[column][0]:
            low, high = bounds[column]
            a, z, width = left_of(line) - low, high - right_of(line), high - low
            centered = a > width * 0.15 and z > width * 0.15 and abs(a - z) < width * 0.08
        center = line[0]["center"]
        out.append((joined(line, size), size, bool(bold), bool(centered), None if above is None else abs(above - center), column))
        above = center
    return out


def styled_lines(pieces: DataFrame) -> DataFrame:
    """(book, page, line_no from 1, text, size, bold, centered, gap_before,
    column) of pieces (book, page, text, left, right, center, height, size, bold).
    Coordinates are points, growing to the right and upwards; pieces with a null
    in any column are left out; of sizes with as many letters the smaller
    counts.  ``column``: 0 the whole width, 1 left, 2 right."""
    ship(pieces.sparkSession)
    cols = ["text", "left", "right", "center", "height", "size", "bold"]
    letters = F.length(F.regexp_replace("text", r"[^\p{L}\p{N}]", ""))
    x = pieces.select("book", "page", F.struct(*cols, letters.alias("letters")).alias("x")).where(" and ".join(f"x.{c} is not null" for c in cols))
    x = x.where("page is not null").groupBy("book", "page").agg(F.sort_array(F.collect_list("x")).alias("x"))

    def styled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [
                (book, page, n, *line)
                for book, page, x in zip(f["book"], f["page"], f["x"], strict=True)
                for n, line in enumerate(page_lines(list(x)), 1)
            ]
            yield pd.DataFrame(rows, columns=["book", "page", "line_no", "text", "size", "bold", "centered", "gap_before", "column"])

    kind = pieces.schema["book"].dataType.simpleString()
    number = pieces.schema["page"].dataType.simpleString()
    return x.mapInPandas(styled, f"book {kind}, {_STYLED.replace('page int', f'page {number}')}")
