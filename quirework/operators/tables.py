"""HTML tables and simple mathematics."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

SPAN = 64


class _Rows(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows, self.held, self.cell, self.at = [], {}, None, 0

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.rows.append([])
            self.at = 0
        elif tag in ("td", "th") and self.rows:
            self._close()
            a = dict(attrs)
            size = lambda n: min(SPAN, int(a[n])) if (a.get(n) or "").isdigit() and int(a[n]) > 0 else 1
            self._skip()
            self.cell = ["", size("colspan"), size("rowspan")]
        elif tag == "br" and self.cell:
            self.cell[0] += " "

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr"):
            self._close()
        if tag == "tr":
            self._skip()

    def handle_data(self, data):
        if self.cell:
            self.cell[0] += data

    def _skip(self):
        y = len(self.rows) - 1
        while (y, self.at) in self.held:
            self.rows[y].append("")
            self.at += 1

    def _close(self):
        if not self.cell:
            return
        text, wide, high = self.cell
        y = len(self.rows) - 1
        for d in range(wide):
            self.rows[y].append(" ".join(text.split()) if d == 0 else "")
            for below in range(1, high):
                self.held[y + below, self.at + d] = True
        self.at += wide
        self.cell = None


def table_rows(html: str | None) -> list[list[str]] | None:
    """Cells of a table, spans reserved with empty cells."""
    if html is None:
        return None
    p = _Rows()
    p.feed(html)
    p._close()
    return [r for r in p.rows if r]


@F.pandas_udf(ArrayType(ArrayType(StringType())))
def rows_of(html: pd.Series) -> pd.Series:
    return html.map(table_rows)


def pipe_text(rows: list[list[str]]) -> str:
    """``pipe_table`` of one table."""
    wide = max(map(len, rows))
    full = [[c.replace("|", "\\|") for c in r] + [""] * (wide - len(r)) for r in rows]
    lines = ["| " + " | ".join(r) + " |" for r in full]
    return "\n".join([lines[0], "|" + " --- |" * wide, *lines[1:]])


_TABLE = re.compile(r"<table.*?</table>", re.S)


def tables_to_markdown(text: str | None) -> str | None:
    """The text with each HTML table as a pipe table in a block of its own; one
    without cells or without an end stays."""
    if text is None:
        return None

    def written(m):
        rows = table_rows(m[0])
        return f"\n\n{pipe_text(rows)}\n\n" if rows else m[0]

    return _TABLE.sub(written, text)


@F.pandas_udf(StringType())
def with_pipe_tables(text: pd.Series) -> pd.Series:
    return text.map(tables_to_markdown)


def pipe_table(rows: Column) -> Column:
    """Rows of cells as a pipe table, all padded to the widest."""
    wide = F.array_max(F.transform(rows, F.size))
    safe = F.transform(rows, lambda r: F.transform(r, lambda c: F.replace(c, F.lit("|"), F.lit("\\|"))))
    full = F.transform(safe, lambda r: F.concat(r, F.array_repeat(F.lit(""), wide - F.size(r))))
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), wide))
    lines = F.concat(F.array(line(full[0]), rule), F.transform(F.slice(full, 2, F.greatest(F.size(full) - 1, F.lit(0))), line))
    return F.array_join(lines, "\n")
