"""Source lines, spans over them, and annotated text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.stitch import overlaps


def lines(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, lineno, start, end, line): lines with their offsets, the line feed included in a line's range.

    A file is one row, so its offsets need no shuffle. A null text has no lines, an empty one a single empty line.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, body in zip(pdf[key], pdf[text]):
                parts = body.split("\n")
                ends = np.cumsum([len(p) + 1 for p in parts])
                yield pd.DataFrame({key: k, "lineno": range(len(parts)), "start": np.concatenate([[0], ends[:-1]]), "end": ends, "line": parts})

    kind = dict(files.dtypes)[key]
    return files.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, text).mapInPandas(run, f"`{key}` {kind}, lineno bigint, start bigint, end bigint, line string")


def overlapping(line_rows: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """(key, lineno, s, e): the lines that a span (key, s, e) overlaps, ends exclusive.

    Lines and spans meet in bins of a file, so that the work follows the overlaps, not lines times spans.
    """
    own = line_rows.select(key, "lineno", F.col("start").alias("l0"), F.col("end").alias("l1"))
    return overlaps(own, spans.select(key, "s", "e"), [key], "l0", "l1", "s", "e", 2048).select(key, "lineno", "s", "e")


def with_context(line_rows: DataFrame, hits: DataFrame, key: str, around: int) -> DataFrame:
    """Lines within ``around`` of a hit line, marked '+' where hit and ' ' elsewhere; a first line after a gap has ``gap``."""
    near = hits.select(key, F.explode(F.sequence(F.col("lineno") - around, F.col("lineno") + around)).alias("lineno"), F.col("lineno").alias("at"))
    marks = near.groupBy(key, "lineno").agg(F.max((F.col("at") == F.col("lineno")).cast("int")).alias("hit"))
    previous = marks.select(key, (F.col("lineno") + 1).alias("lineno"), F.lit(True).alias("follows"))
    shown = marks.join(previous, [key, "lineno"], "left").join(line_rows.select(key, "lineno", "line"), [key, "lineno"])
    return shown.select(key, "lineno", F.when(F.col("hit") == 1, "+").otherwise(" ").alias("mark"), F.col("follows").isNull().alias("gap"), "line")


def nested_marks(body: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with every span opened as [label| and closed as ]; outer spans open first and close last."""
    events = []
    for n, (s, e, label) in enumerate(spans):
        if s < e:
            events += [(s, 1, -e, n, f"[{label}|"), (e, 0, -s, -n, "]")]
    out, at = [], 0
    for where, _, _, _, mark in sorted(events):
        where = max(0, min(where, len(body)))
        out += [body[at:where], mark]
        at = where
    return "".join(out) + body[at:]
