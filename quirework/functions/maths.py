"""Simple formulas as HTML."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Styles that leave no trace, and symbols.
STYLES = ("mathrm", "text", "mathit", "textrm", "rm", "mathbf")
SYMBOLS = {"cdot": "·", "times": "×", "pm": "±", "circ": "°", "prime": "′", "ldots": "…", "dots": "…", ",": " ", " ": " "}
PLAIN = " +-=()[].,;:/'·×−–"

_PART = re.compile(r"\\(?P<name>[A-Za-z]+|[, ])|(?P<mark>[_^{}])|(?P<char>.)", re.S)
_ESCAPES = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;"}
_TAGS = {"_": "sub", "^": "sup"}


def math_html(tex: str | None) -> str | None:
    """The formula with ``sub`` and ``sup``; null when anything in it is unknown,
    braces don't match or nothing is left."""
    if tex is None:
        return None
    out: list[str] = []
    closers: list[str] = []  # what each open brace writes at its end
    due: str | None = None  # end tag of an index that still lacks its argument
    for part in _PART.finditer(tex):
        name, mark, char = part["name"], part["mark"], part["char"]
        if due is not None and mark != "{" and not (char and (char.isalnum() or char in "+-")):
            return None
        if mark == "{":
            closers.append(due or "")
            due = None
        elif mark == "}":
            if not closers:
                return None
            out.append(closers.pop())
        elif mark:
            out.append(f"<{_TAGS[mark]}>")
            due = f"</{_TAGS[mark]}>"
        elif name:
            if name not in SYMBOLS and name not in STYLES:
                return None
            out.append(SYMBOLS.get(name, ""))
        elif char.isalnum() or char in PLAIN:
            out.append(_ESCAPES.get(char, char))
            if due is not None:
                out.append(due)
                due = None
        else:
            return None
    html = "".join(out)
    return html if html.strip() and not closers and due is None else None


@F.pandas_udf(StringType())
def simple_math(tex: pd.Series) -> pd.Series:
    return tex.map(math_html)
