"""Names of all queries of the core library, with their SQL twins."""

from __future__ import annotations

from weftline.plans import analyses, core_problems, graphs, reports, scans, texts, walks, words

MODULES = (core_problems, scans, words, texts, graphs, walks, reports, analyses)
FLAGSHIP = "stitched_by_label"


def queries() -> dict:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
