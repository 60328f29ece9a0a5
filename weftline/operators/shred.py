"""Deeply nested JSON records to flat tables, by columnar shredding with repetition and definition levels.

A batch of records is shredded into one column per leaf path. An entry of a column has a repetition level (which
repeated ancestor it continues) and a definition level (how much of its path exists). Groups may contain themselves: a
deeper copy is a path of its own, made when it first occurs. An instance of a group gives every group directly below it
at least one entry, a placeholder where there is none, and nothing further below; so, of the entries of a group, those
with a repetition level up to the parent group's begin a new parent instance. A running count of them is the index of
the parent, which is all that is needed to link the rows of a table with those of the table above. As any object may
come as a list of objects, every group counts as repeated.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Group:
    """An object at ``steps`` below its parent group: its leaf values and the groups inside it."""

    name: str
    steps: tuple[str, ...]
    leaves: tuple[str, ...]
    groups: tuple[str, ...] = ()


@dataclass
class Columns:
    """The columns of one group path: levels of its entries, and per leaf the values and definition levels."""

    group: Group
    parent: str
    rep_level: int
    def_level: int
    reps: list[int] = field(default_factory=list)
    defs: list[int] = field(default_factory=list)
    values: dict[str, list] = field(default_factory=dict)


#: The layout of exported classes.
LAYOUT = {
    g.name: g
    for g in (
        Group("class", ("export", "class"), ("name", "path", "extends"), ("field", "method")),
        Group("field", ("fields",), ("name", "type", "static")),
        Group("method", ("methods",), ("id", "name", "style"), ("caller", "mast", "top")),
        Group("caller", ("callers",), ("",)),
        Group("mast", ("ast",), ("type", "start", "end")),
        Group("top", ("scope",), ("name",), ("node", "scope")),
        Group("scope", ("scopes",), ("name",), ("node", "scope")),
        Group("node", ("nodes",), ("id", "kind", "ref", "ndata", "ntype"), ("nast", "link")),
        Group("nast", ("ast",), ("type", "start", "end")),
        Group("link", ("accept",), ("label", "src")),
    )
}
ROOT = "class"


def pruned(leaves: dict[str, tuple[str, ...]], layout: dict[str, Group] = LAYOUT) -> dict[str, Group]:
    """The layout with those groups and leaves only: as in a columnar file, what is not asked for is not shredded."""
    return {g: replace(layout[g], leaves=own, groups=tuple(x for x in layout[g].groups if x in leaves)) for g, own in leaves.items()}


#: What the keys of rows need.
KEYS = {"class": ("name",), "method": ("id",), "top": ("name",), "scope": ("name",), "node": ("id",), "link": ("label", "src")}


def _no_constant(name: str):
    raise ValueError(f"{name} is no JSON value")


def decoded(value):
    """A value that may be JSON text, encoded any number of times, as an object or list; None if it is neither."""
    while isinstance(value, str):
        try:
            value = json.loads(value, parse_constant=_no_constant)
        except (ValueError, RecursionError):
            return None
    return value if isinstance(value, (dict, list)) else None


def text(value) -> str | None:
    """A leaf as text: strings as they are, other values as JSON."""
    return value if value is None or isinstance(value, str) else json.dumps(value, sort_keys=True)


def shred(records: list, layout: dict[str, Group] = LAYOUT, root: str = ROOT) -> dict[str, Columns]:
    """The columns of decoded ``records`` (None where a body is not valid), by group path.

    A group, and what holds it, may be a list, a list of lists, or a single object, and nothing of it is left out; absent,
    null and empty are alike. Groups may be encoded as JSON text. An element that is no object has no leaves, unless the group's only leaf is '' (plain values).
    """
    columns: dict[str, Columns] = {}

    def at(path: str, group: Group, parent: Columns | None, parent_path: str) -> Columns:
        if path not in columns:
            above = (parent.rep_level, parent.def_level) if parent else (0, 0)
            columns[path] = Columns(group, parent_path, above[0] + 1, above[1] + 1, values={leaf: [] for leaf in group.leaves})
        return columns[path]

    def spread(value, plain: bool) -> list:
        if type(value) is dict:
            return [value]
        if type(value) is list and all(type(v) is dict for v in value):
            return value
        flat, stack = [], [value]
        while stack:
            v = stack.pop()
            if not plain and isinstance(v, str):
                v = decoded(v)
            if isinstance(v, list):
                stack.extend(reversed(v))
            elif v is not None:
                flat.append(v)
        return flat

    def items(group: Group, holder) -> list:
        if type(holder) is dict and len(group.steps) == 1:  # the usual shape
            value = holder.get(group.steps[0])
            return [] if value is None else spread(value, group.leaves == ("",))
        found = [holder]
        for step in group.steps:
            found = [v[step] for value in found for v in spread(value, False) if isinstance(v, dict) and v.get(step) is not None]
        return [v for value in found for v in spread(value, group.leaves == ("",))]

    # depth-first with an own stack: nesting may be deeper than Python's calls
    for record in records:
        stack = [(layout[root], record, layout[root].name, None, "", 0)]
        while stack:
            group, holder, path, parent, parent_path, rep = stack.pop()
            c = at(path, group, parent, parent_path)
            found = items(group, holder)
            if not found:
                c.reps.append(rep)
                c.defs.append(c.def_level - 1)
                for column in c.values.values():
                    column.append(None)
                continue
            below = []
            for k, item in enumerate(found):
                own = rep if k == 0 else c.rep_level
                c.reps.append(own)
                c.defs.append(c.def_level)
                for leaf, column in c.values.items():
                    value = item if leaf == "" else item.get(leaf) if isinstance(item, dict) else None
                    column.append(text(value))
                for name in group.groups:
                    below.append((layout[name], item, f"{path}.{name}", c, path, own))
            stack.extend(reversed(below))
    return columns


def tables(columns: dict[str, Columns], root: str = ROOT) -> dict[str, pd.DataFrame]:
    """Per group path: its instances with their leaves, the record's index and the parent instance's index, from the levels."""
    out: dict[str, pd.DataFrame] = {}
    for path, c in columns.items():  # a parent's path always comes before its children's
        reps, defs = np.array(c.reps), np.array(c.defs)
        new_parent = reps <= (columns[c.parent].rep_level if c.parent else 0)
        above = np.cumsum(new_parent) - 1
        there = defs >= c.def_level
        frame = pd.DataFrame({leaf: pd.Series(column, dtype=object)[there] for leaf, column in c.values.items()}).reset_index(drop=True)
        frame["#parent"] = above[there]
        frame["#record"] = out[c.parent]["#record"].to_numpy()[above[there]] if c.parent else above[there]
        out[path] = frame
    return out


ROW = "rec_id bigint, entity string, item_no bigint, parent_no bigint, parent_key string, item_key string, label string, kind string, ref string, ndata string, ntype string"


def _numbers(tabs: dict[str, pd.DataFrame], n_records: int) -> dict[str, np.ndarray]:
    """A number for every instance, unique in its record whatever else the batch holds: paths by name, then their order."""
    used = np.zeros(n_records, dtype=np.int64)
    out = {}
    for path in sorted(tabs):
        rec = tabs[path]["#record"].to_numpy().astype(np.int64)
        counts = np.bincount(rec, minlength=n_records)
        nth = np.arange(len(rec)) - (np.cumsum(counts) - counts)[rec]
        out[path] = used[rec] + nth
        used += counts
    return out


def _rows(tabs: dict[str, pd.DataFrame], columns: dict[str, Columns], ids: np.ndarray, fields: list[str]) -> Iterator[pd.DataFrame]:
    """Method, scope, node and link rows, each with its number, and the number and key of its parent."""
    numbers = _numbers(tabs, len(ids)) if "item_no" in fields else {}
    for path, t in tabs.items():
        group = columns[path].group.name
        if not len(t) or group not in ("method", "top", "scope", "node", "link"):
            continue
        up, at = columns[path].parent, t["#parent"].to_numpy()
        key = {"class": "name", "method": "id", "top": "name", "scope": "name", "node": "id"}[columns[up].group.name]
        out = pd.DataFrame({"rec_id": ids[t["#record"].to_numpy()], "parent_key": tabs[up][key].to_numpy()[at]})
        if numbers:
            out["item_no"], out["parent_no"] = numbers[path], numbers[up][at]
        out["entity"] = "scope" if group == "top" else group
        out["item_key"] = t[{"method": "id", "top": "name", "scope": "name", "node": "id", "link": "src"}[group]].to_numpy()
        out["label"] = t["label"].fillna("").to_numpy() if group == "link" else ""
        for extra in ("kind", "ref", "ndata", "ntype"):
            if extra in fields:
                out[extra] = t[extra].to_numpy() if group == "node" else None
        yield out[fields]


def flat_rows(df: DataFrame, keys_only: bool = False) -> DataFrame:
    """(rec_id, entity, item_no, parent_no, parent_key, item_key, label, kind, ref, ndata, ntype) of all records in ``body``.

    ``item_no`` tells the instances of a record apart, also those of one name; ``parent_no`` is that of the row above.
    A body that is null or not valid JSON, even once decoded, gives no rows, nor does a row without ``rec_id``. Records
    delivered again give the same rows again. A label that is absent is ''. ``keys_only`` leaves the numbers and the
    attributes of nodes out.
    """
    row = ", ".join(c for c in ROW.split(", ") if not keys_only or c.split()[0] in ("rec_id", "entity", "parent_key", "item_key", "label"))
    fields = [c.split()[0] for c in row.split(", ")]
    layout = pruned(KEYS) if keys_only else LAYOUT

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            columns = shred([decoded(b) for b in pdf["body"]], layout)
            yield from _rows(tables(columns), columns, pdf["rec_id"].to_numpy(), fields)

    return df.where(F.col("rec_id").isNotNull() & F.col("body").isNotNull()).select("rec_id", "body").mapInPandas(run, row)


def levels(df: DataFrame) -> DataFrame:
    """(rec_id, leaf_path, nth, rep_level, def_level, value): the shredded columns themselves, per record."""
    schema = "rec_id bigint, leaf_path string, nth bigint, rep_level bigint, def_level bigint, value string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for rec, body in zip(pdf["rec_id"], pdf["body"]):
                for path, c in shred([decoded(body)]).items():
                    for leaf, values in c.values.items():
                        defs = np.array(c.defs) + np.array([v is not None for v in values])
                        yield pd.DataFrame({"rec_id": rec, "leaf_path": f"{path}.{leaf}".rstrip("."), "nth": range(len(values)), "rep_level": c.reps, "def_level": defs, "value": values})

    return df.where(F.col("rec_id").isNotNull() & F.col("body").isNotNull()).select("rec_id", "body").mapInPandas(run, schema)
