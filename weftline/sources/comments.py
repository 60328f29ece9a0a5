"""Comments of Java sources with their place, and the nearest tokens around them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PART = re.compile(r'(?P<line>//[^\r\n]*)|(?P<block>/\*.*?(?:\*/|\Z))|(?P<space>\s+)|(?P<string>"""(?:[^\\"]|\\.|"(?!""))*"""|"(?:[^"\\\r\n]|\\.)*"?|\'(?:[^\'\\\r\n]|\\.)*\'?)|(?P<word>\w+)|(?P<other>.)', re.S)
TAB = 8


def column(text: str, at: int) -> int:
    """Column of an offset, counted from 0 after the last line feed, with tab stops of eight."""
    col = 0
    for ch in text[text.rfind("\n", 0, at) + 1 : at]:
        col = (col // TAB + 1) * TAB if ch == "\t" else col + 1
    return col


def scan(text: str) -> list[tuple[int, int, str, int, int, str | None, str | None]]:
    """(start, end, kind, line, column, token before, token after) of every comment."""
    out, before, waiting, line, at = [], None, [], 0, 0
    for match in _PART.finditer(text):
        kind, s, e = match.lastgroup, match.start(), match.end()
        line += text.count("\n", at, s)
        at = s
        if kind in ("line", "block"):
            doc = "doc" if match.group().startswith("/**") and e - s > 4 else kind
            waiting.append(len(out))
            out.append([s, e, doc, line, column(text, s), before, None])
        elif kind != "space":
            before = match.group()
            for k in waiting:
                out[k][6] = before
            waiting = []
    return [tuple(x) for x in out]


def comments(files: DataFrame, key: str, text: str) -> DataFrame:
    """Rows of ``scan`` for all files; a null text has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, *c) for k, body in zip(pdf[key], pdf[text]) for c in scan(body)]
            yield pd.DataFrame(rows, columns=[key, "s", "e", "kind", "lineno", "col", "token_before", "token_after"])

    kind = dict(files.dtypes)[key]
    return files.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, text).mapInPandas(run, f"`{key}` {kind}, s bigint, e bigint, kind string, lineno bigint, col bigint, token_before string, token_after string")
