"""Scalar functions that need a program: name similarity, literals, columns, record properties."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, one row of the table at a time."""
    if not a or not b:
        return 0
    y = np.frombuffer(b.encode("utf-32-le"), dtype=np.uint32)
    row = np.zeros(len(y) + 1, dtype=np.int64)
    for code in np.frombuffer(a.encode("utf-32-le"), dtype=np.uint32):
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(y == code, row[:-1] + 1, 0)))
    return int(row[-1])


@F.pandas_udf(T.DoubleType())
def lcs_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """LCS length over the longer length, 0 where either is null or empty."""
    return pd.Series([0.0 if not x or not y else lcs_length(x, y) / max(len(x), len(y)) for x, y in zip(a, b)])


_QUOTED = {0: "\\0", 8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r", 34: '\\"', 39: "\\'", 92: "\\\\"}


@F.pandas_udf(T.StringType())
def java_literal(s: pd.Series) -> pd.Series:
    """A Java string literal: escapes for controls, \\uXXXX beyond printable ASCII."""

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        units = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), dtype=np.uint16).tolist()
        return '"' + "".join(_QUOTED.get(u) or (chr(u) if 32 <= u <= 126 else f"\\u{u:04x}") for u in units) + '"'

    return s.map(one, na_action=None)


def properties(c: Column) -> Column:
    """'k=v k=v' as a map."""
    return F.str_to_map(c, F.lit(" "), F.lit("="))


def line_feeds(c: Column) -> Column:
    return (F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))).cast("long")


def column_position(c: Column) -> Column:
    """Column after the last line feed of a prefix, with tab stops of 8."""
    last = F.substring_index(c, "\n", -1)
    step = lambda at, ch: F.when(ch == "\t", (F.floor(at / 8) + 1) * 8).otherwise(at + 1)
    return F.aggregate(F.split(last, ""), F.lit(0).cast("long"), lambda at, ch: F.when(ch == "", at).otherwise(step(at, ch)).cast("long"))


def jaccard(a: Column, b: Column) -> Column:
    """Size of the intersection over the union, 0 where either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)
