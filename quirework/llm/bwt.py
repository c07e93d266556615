"""Merging shard Burrows-Wheeler transforms by interleave refinement.

Two transforms are merged without sorting their suffixes again: an interleave
(which shard each row comes from) begins in shard order and is refined by one
symbol a pass; after ``k`` passes rows are in order of their first ``k`` symbols.
The passes also carry where classes of equal k-prefixes begin, so after ``depth``
passes the classes of two rows or more are the repeated intervals of that
length.  A pass costs a stable counting sort of all bytes; with 400 passes it is
kept for small shards (README: figures), whole texts take ``exact_substrings``.
"""

from __future__ import annotations

import numpy as np


def transform(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The transform of some texts, each closed by a terminator 0 (texts hold no
    byte 0; terminators are in the texts' order), and the place of every row in
    the concatenated texts."""
    data = b"\0".join(texts) + b"\0"
    ends, at = [], -1
    for t in texts:
        at += len(t) + 1
        ends.append(at)
    text = np.searchsorted(ends, np.arange(len(data)))
    order = sorted(range(len(data)), key=lambda i: (data[i : ends[text[i]]], text[i]))
    rows = np.array(order, np.int64)
    x = np.frombuffer(data, np.uint8)
    starts = np.array([0, *[e + 1 for e in ends[:-1]]])
    before = np.where(np.isin(rows, starts), 0, x[rows - 1])
    return before.astype(np.uint8), rows


def merge(a: np.ndarray, b: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard of every merged row, whether a class of equal ``depth``-prefixes
    begins there)."""
    shard = np.zeros(len(a) + len(b), np.uint8)
    shard[len(a) :] = 1
    head = np.zeros(len(shard), bool)
    head[:1] = True
    for _ in range(depth):
        symbol = np.empty(len(shard), np.uint8)
        symbol[shard == 0] = a
        symbol[shard == 1] = b
        order = np.argsort(symbol, kind="stable")
        group = np.cumsum(head)[order]
        symbol = symbol[order]
        shard = shard[order]
        head = np.ones(len(shard), bool)
        head[1:] = (symbol[1:] != symbol[:-1]) | (group[1:] != group[:-1]) | (symbol[1:] == 0)
    return shard, head


def repeated(a, b, depth: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The repeated intervals of two shards' (transform, rows): per class the
    places in either shard's concatenated texts."""
    shard, head = merge(a[0], b[0], depth)
    rows = np.empty(len(shard), np.int64)
    rows[shard == 0], rows[shard == 1] = a[1], b[1]
    cuts = np.flatnonzero(head)
    return [
        (rows[s:e][shard[s:e] == 0], rows[s:e][shard[s:e] == 1])
        for s, e in zip(cuts, [*cuts[1:], len(rows)], strict=True)
        if e - s > 1
    ]
