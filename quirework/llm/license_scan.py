"""License scans: exact phrases and fuzzy short notices.

The text is lower-cased (A-Z) and cut into words; joined by single blanks it is
the string that is searched.  Base: every place where a phrase's words stand
consecutively.  Method: a notice may differ by at most ``edits`` characters.  It
is split into ``edits + 1`` pieces, at least one of which any match holds
unchanged (pigeonhole), so exact search for the pieces gives all candidate
windows; the ``regex`` library's bounded-error matching verifies each window and
reports the span and its edits.

Null and empty texts have no words, labels are then the empty string and the
score is 0.  Repeated documents are scanned each; other columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from quirework.llm.common import batch_of, map_arrow, table, utf8
from quirework.llm.decontaminate import words

PHRASES = ((b"mit license", "mit"), (b"apache license", "apache"), (b"general public license", "gpl"))
#: Short notices as they are commonly written, in the searched form.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("the software is provided as is without warranty of any kind", "mit"),
    ("released under the mit license", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license", "apache"),
    ("under the terms of the gnu general public license", "gpl"),
    ("under the terms of the gnu lesser general public license", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("licensed under a creative commons attribution", "cc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)
#: One edit is allowed for so many characters of a notice.
CHARS_PER_EDIT = 12


def pieces(notice: str, edits: int) -> list[tuple[int, bytes]]:
    """``edits + 1`` consecutive pieces of the notice with their offsets."""
    raw, n = notice.encode(), edits + 1
    cuts = [len(raw) * i // n for i in range(n + 1)]
    return [(cuts[i], raw[cuts[i] : cuts[i + 1]]) for i in range(n)]


class Notices:
    """Seeds and bounded-error patterns of a set of notices."""

    def __init__(self, notices=NOTICES):
        self.plan = []
        for text, label in notices:
            edits = max(1, len(text) // CHARS_PER_EDIT)
            # the bytes >= 0x80 of other scripts count as one edit each
            fuzzy = regex.compile(b"(?e)(?:" + text.encode() + b"){e<=%d}" % edits)
            self.plan.append((label, len(text.encode()), edits, pieces(text, edits), fuzzy))

    def spans(self, line: bytes) -> list[tuple[int, int, str, int]]:
        """(start byte, end byte, label, edits) of every verified notice."""
        out = []
        for label, size, edits, seeds, fuzzy in self.plan:
            windows = []
            for offset, seed in seeds:
                at = line.find(seed)
                while at >= 0:
                    lo = max(0, at - offset - edits)
                    windows.append((lo, min(len(line), at - offset + size + edits)))
                    at = line.find(seed, at + 1)
            windows.sort()
            done = -1
            for lo, hi in _united(windows):
                for m in fuzzy.finditer(line, lo, hi):
                    if m.start() >= done:
                        out.append((m.start(), m.end(), label, sum(m.fuzzy_counts)))
                        done = m.end()
        return out


def _united(windows):
    """Overlapping windows made one."""
    out = []
    for lo, hi in windows:
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


def places(line: bytes, phrase: bytes) -> list[int]:
    """Word numbers at which the phrase's words stand consecutively."""
    padded, key, out = b" " + line + b" ", b" " + phrase + b" ", []
    at, seen, word = padded.find(key), 0, 0
    while at >= 0:
        word += padded.count(b" ", seen, at)
        seen = at
        out.append(word)
        at = padded.find(key, at + 1)
    return out


def scan(batches):
    notices = Notices()
    for batch in batches:
        rows = []
        for raw in batch.column("raw").to_pylist():
            ws = words(raw)
            line = b" ".join(ws)
            base, labels, score = [], set(), 0.0
            for phrase, label in PHRASES:
                if found := places(line, phrase):
                    base += found
                    labels.add(label)
                    score = 1.0
            spans = []
            for s, e, label, edits in notices.spans(line):
                score = max(score, 1 - edits / (e - s))
                spans.append((line.count(b" ", 0, s), line.count(b" ", 0, e) + 1, label, edits))
            rows.append((
                len(ws), len(base), min(base, default=None), max(base, default=None), ",".join(sorted(labels)),
                ",".join(sorted(labels | {x[2] for x in spans})), score,
                [{"first_word": a, "end_word": b, "label": c, "edits": d} for a, b, c, d in spans],
            ))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
        span = pa.struct([("first_word", pa.int64()), ("end_word", pa.int64()), ("label", pa.string()), ("edits", pa.int32())])
        yield batch_of(
            doc_id=batch.column("doc_id"),
            n_words=pa.array(cols[0], pa.int64()),
            n_base=pa.array(cols[1], pa.int64()),
            first_word=pa.array(cols[2], pa.int64()),
            last_word=pa.array(cols[3], pa.int64()),
            base_labels=pa.array(cols[4], pa.string()),
            labels=pa.array(cols[5], pa.string()),
            score=pa.array(cols[6], pa.float64()),
            notices=pa.array(cols[7], pa.list_(span)),
        )


def license_scan(docs: DataFrame) -> DataFrame:
    """Labels, score and verified notices (word spans, edits) per document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(
        docs.select("doc_id", utf8().alias("raw")),
        scan,
        f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, "
        "labels string, score double, "
        "notices array<struct<first_word: long, end_word: long, label: string, edits: int>>",
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("notices")
