"""Running matter and headings of a document that is one row.

The rules of ``cleanup`` for documents whose blocks and lines fit a row: what
columns can tell about a block or a line comes in, what depends on its neighbours
is worked out here, in one pass over the document and without a shuffle.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

from quirework.operators.cleanup import EDGE, GAP, LEAST, LEVELS, REACH, RUN, SHARE, TAIL, WORDS


def running_keys(keyed: dict[str, list[int]], pages: int) -> set[str]:
    """Keys of running headers and footers; ``keyed``: each key's pages in order,
    ``pages``: how many the document has."""
    if pages < LEAST:
        return set()
    least = max(LEAST, math.ceil(pages * SHARE))
    found = set()
    for key, at in keyed.items():
        if len(at) < LEAST:
            continue
        run = longest = 1
        for a, z in zip(at, at[1:]):
            run = run + 1 if z - a <= GAP else 1
            longest = max(longest, run)
        if len(at) >= least or longest >= RUN:
            found.add(key)
    return found


def without_margins(sections: list[list[int]], keys: list[str | None]) -> set[int]:
    """Places of the blocks that are running headers or footers.  ``sections``:
    the places of each page's blocks that aren't empty; ``keys``: every block's
    key, null if it is long."""
    at_edge = [sorted({*own[:EDGE], *own[-EDGE:]}) for own in sections]
    keyed = defaultdict(list)
    for section, own in enumerate(at_edge):
        # empty keys (only punctuation) name nothing
        for key in {keys[i] for i in own} - {None, ""}:
            keyed[key].append(section)
    running = running_keys(keyed, len(sections))
    return {i for own in at_edge for i in own if keys[i] in running}


def body_size(lines: list[dict]) -> float | None:
    """The size (to halves) with most characters; ties to the smaller one."""
    n: dict = {}
    for x in lines:
        n[x["half"]] = n.get(x["half"])
        if x["length"] is not None:
            n[x["half"]] = (n[x["half"]] or 0) + x["length"]
    # nulls count least
    best = max(n, key=lambda h: (n[h] is not None, n[h] or 0, h is not None, -(h or 0)))
    return None if best is None else best / 2


def running_lines(pages: dict[int | None, list[dict]]) -> set[str]:
    """Keys at the edges of at least three pages and a quarter of them."""
    n: Counter = Counter()
    for own in pages.values():
        n.update({x["key"] for x in (*own[:2], *own[-2:])} - {None})
    least = max(3, math.ceil(sum(p is not None for p in pages) / 4))
    return {key for key, times in n.items() if times >= least}


def at_least(size: float | None, body: float | None, share: float) -> bool:
    return size is not None and body is not None and size >= body * share


def style(x: dict) -> tuple:
    """What makes two lines alike."""
    return x["half"], x["bold"], x["centered"]


def levels(candidates: list[dict]) -> dict[tuple, int | None]:
    """Each style's level by its rank; a style with a null has a rank, but no level."""
    ranked = sorted({style(x) for x in candidates}, key=lambda s: [(v is not None, v or 0) for v in s], reverse=True)
    return {s: None if None in s else min(rank, LEVELS) for rank, s in enumerate(ranked, 1)}


def outline_levels(pages: dict[int | None, list[dict]], outline: list[dict]) -> dict[tuple, int | None]:
    """(page, line_no) of the lines that are bookmarks' titles, with their level."""
    marks = defaultdict(list)
    for m in outline:
        if m["page"] is not None and m["words"]:
            marks[m["page"]].append(m)
    hits: dict[tuple, tuple] = {}
    for page, own in marks.items():
        for x in pages.get(page, [])[:REACH]:
            words = x["words"]
            if not words or x["line_no"] is None:
                continue
            tail = len(words) <= TAIL and (x["centered"] or x["bold"] or x["large"])
            for m in own:
                title = m["words"]
                if m["ord"] is not None and (title == words or (tail and title[-len(words) :] == words)):
                    first = hits.get((page, x["line_no"]))
                    if first is None or m["ord"] < first[0]:
                        hits[page, x["line_no"]] = (m["ord"], m["level"])
    return {at: level for at, (_, level) in hits.items()}


def close(x: dict, above: dict | None) -> bool:
    """Whether a line goes on with the heading of the line above it."""
    if above is None or not (x["run"] and above["run"]) or None in style(x) or style(x) != style(above):
        return False
    return x["gap_before"] is not None and x["gap_before"] <= x["size"] * 1.6


def proposed_headings(lines: list[dict] | None, outline: list[dict] | None) -> list[dict]:
    """The headings (text, level) of one document in order, as
    ``cleanup.proposed_headings`` has them.

    ``lines``: page, line_no (one line each), text (trimmed), size, half (size in
    half points), bold, centered, gap_before, key, length, words (null if more
    than ``WORDS``), looks (words, letters and end are a heading's).  ``outline``:
    page, ord, words, level."""
    if not lines:
        return []
    first = lambda v: (v is not None, v or 0)
    lines = sorted(lines, key=lambda x: (first(x["page"]), first(x["line_no"])))
    body = body_size(lines)
    pages = defaultdict(list)
    for x in lines:
        pages[x["page"]].append(x)
    running = running_lines(pages)
    for x in lines:
        x["large"] = at_least(x["size"], body, 1.12)
        marked = (x["bold"] or x["centered"]) and at_least(x["size"], body, 0.95)
        x["candidate"] = bool(x["looks"] and (x["large"] or marked) and x["key"] not in running)
    by_style = levels([x for x in lines if x["candidate"]])
    by_outline = outline_levels(pages, outline or [])
    out = []
    for page, own in pages.items():
        above = None
        for x in own:
            hit = by_outline.get((page, x["line_no"]))
            x["run"] = x["candidate"] and hit is None
            if close(x, above):
                out[-1]["texts"].append(x["text"])
            elif x["candidate"] or hit is not None:
                out.append({"texts": [x["text"]], "level": by_style[style(x)] if hit is None else hit})
            above = x
    return [{"text": " ".join(t for t in h["texts"] if t is not None), "level": h["level"]} for h in out]
