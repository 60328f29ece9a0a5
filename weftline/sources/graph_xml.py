"""XML graph documents: a scan that emits flat rows, a writer, and GraphViz text.

A document has classes, in them methods, in these nested scopes with nodes, whose accept elements are links. The root's
name is not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat
from xml.sax.saxutils import quoteattr

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import names as fn

_COLUMNS = ("ord", "entity", "parent_key", "item_key", "label", "kind", "ref", "ndata", "ntype", "ast_start", "ast_end", "attributes")
_FIELDS = "ord bigint, entity string, parent_key string, item_key string, label string, kind string, ref string, ndata string, ntype string, ast_start bigint, ast_end bigint, attributes map<string,string>"


def parse(text: str) -> list[tuple]:
    """Rows of one document in document order; none if it is not well-formed."""
    rows: list[list] = []
    owners: list[str | None] = [None]
    open_: list[list | None] = []

    def start(tag: str, a: dict[str, str]) -> None:
        row = None
        if tag == "class":
            row = ["class", None, a.get("name"), "", None, None, None, None]
        elif tag == "method":
            row = ["method", owners[-1], a.get("id"), "", None, None, None, None]
        elif tag == "scope":
            row = ["scope", owners[-1], a.get("name"), "", None, None, None, None]
        elif tag == "node":
            row = ["node", owners[-1], a.get("id"), "", a.get("kind"), a.get("ref"), a.get("data"), a.get("type")]
        elif tag == "accept":
            rows.append([len(rows), "link", owners[-1], a.get("src"), a.get("label") or "", None, None, None, None, None, None, {}])
        elif tag == "ast" and open_ and open_[-1] is not None:
            for k, name in ((9, "start"), (10, "end")):
                value = a.get(name, "")
                open_[-1][k] = int(value) if value.isdigit() else None
            if a.get("type") and open_[-1][1] == "node":
                open_[-1][11]["ast"] = a["type"]
        if row is not None:
            full = [len(rows), *row, None, None, {k: v for k, v in a.items() if tag in ("class", "method")}]
            rows.append(full)
            owners.append(row[2])
            open_.append(full)

    def end(tag: str) -> None:
        if tag in ("class", "method", "scope", "node"):
            owners.pop()
            open_.pop()

    parser = expat.ParserCreate("utf-8")
    parser.StartElementHandler, parser.EndElementHandler = start, end
    try:
        parser.Parse(text.encode("utf-8"), True)
    except (expat.ExpatError, UnicodeEncodeError):
        return []
    return [tuple(r) for r in rows]


def rows(files: DataFrame, key: str, text: str) -> DataFrame:
    """Flat rows of all documents: (key, ord, entity, parent_key, item_key, label, kind, ref, ndata, ntype, ast_start, ast_end, attributes)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, body in zip(pdf[key], pdf[text]):
                found = parse(body)
                if found:
                    out = pd.DataFrame(found, columns=_COLUMNS)
                    out[["ast_start", "ast_end"]] = out[["ast_start", "ast_end"]].astype("Int64")
                    out.insert(0, key, k)
                    yield out

    kind = dict(files.dtypes)[key]
    return files.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, text).mapInPandas(run, f"`{key}` {kind}, {_FIELDS}")


def _element(entity: str, row: tuple) -> str:
    _, _, _, item, label, kind, ref, ndata, ntype, *_, attributes = row
    given = {
        "node": {"id": item, "kind": kind, "ref": ref, "data": ndata, "type": ntype},
        "link": {"label": label or None, "src": item},
        "scope": {"name": item},
        "class": {**dict(attributes or {}), "name": item},
        "method": {**dict(attributes or {}), "id": item},
    }[entity]
    tag = {"link": "accept"}.get(entity, entity)
    return f"<{tag}" + "".join(f" {k}={quoteattr(v)}" for k, v in given.items() if v is not None)


def render(flat: list[tuple]) -> str:
    """A document of flat rows in document order."""
    level = {"class": 0, "method": 1, "scope": 2, "node": 3, "link": 4}
    out, open_ = ["<graph>"], []  # open: (level, key, tag)

    def close(until) -> None:
        while open_ and until(open_[-1]):
            out.append(f"</{open_.pop()[2]}>")

    for row in flat:
        entity, parent, item = row[1], row[2], row[3]
        own = level[entity]
        # scopes nest: a scope goes into the open scope or method that its parent names
        close(lambda o: o[0] > own or (o[0] == own and not (entity == "scope" and o[1] == parent)) if entity == "scope" else o[0] >= own)
        if entity == "node":
            close(lambda o: o[0] == 2 and o[1] != parent)
        if entity == "link":
            out.append(_element(entity, row) + "/>")
            continue
        out.append(_element(entity, row) + ">")
        if row[9] is not None and row[10] is not None:
            kind = dict(row[11] or {}).get("ast")
            out.append((f'<ast type={quoteattr(kind)}' if kind and entity == "node" else "<ast") + f' start="{int(row[9])}" end="{int(row[10])}"/>')
        open_.append((own, item, entity))
    close(lambda o: True)
    return "\n".join([*out, "</graph>"])


def write(flat: DataFrame, key: str) -> DataFrame:
    """(key, xml): one document per key; a document is as large as its rows, which one record of the source held."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = pdf.sort_values("ord").astype(object).where(lambda x: x.notna(), None)
        return pd.DataFrame({key: [pdf[key].iloc[0]], "xml": [render(list(ordered[list(_COLUMNS)].itertuples(index=False, name=None)))]})

    return flat.groupBy(key).applyInPandas(run, f"`{key}` {dict(flat.dtypes)[key]}, xml string")


# Shapes and styles by kind.
_SHAPES = {"call": "box, style=bold", "new": "box, style=bold", "input": "box, rank=source", "output": "box, rank=sink", "join": "diamond", "begin": "diamond", "end": "diamond", "repeat": "diamond"}


BLOCK = 1024


def dot(nodes: DataFrame, links: DataFrame, block: int = BLOCK) -> DataFrame:
    """(mid, section, sid, block, dot): GraphViz text of every method; informational links are dotted.

    A method of up to ``block`` nodes and links is one row of section 0. A larger one is several rows, whose texts in order of
    section, sid and block are its graph: its head (0), its scopes' clusters (1), its links (2) and its end (3). Clusters and
    links are in blocks by id of at most ``block`` each, so no string holds a hot method; a cluster named again goes on.
    """
    own = nodes.where("mid is not null")
    shape = F.lit("ellipse")
    for kind, look in _SHAPES.items():
        shape = F.when(F.col("kind") == kind, look).otherwise(shape)
    text = F.concat(F.lit("  N"), F.col("nid"), F.lit(' [label="'), fn.dot_escape(F.coalesce(fn.display_text(F.col("kind"), F.col("ref_name"), F.col("ndata")), F.lit(""))), F.lit('", shape='), shape, F.lit("];"))
    lines = F.array_join(F.array_sort(F.collect_list("line")), "\n")
    inside = own.select("mid", "sid", F.floor(F.col("nid") / block).alias("block"), text.alias("line")).groupBy("mid", "sid", "block").agg(lines.alias("t"))
    cluster = F.concat(F.lit(" subgraph cluster_"), F.coalesce(F.col("sid").cast("string"), F.lit("none")), F.lit(" {\n"), F.col("t"), F.lit("\n }"))
    clusters = inside.select("mid", F.lit(1).alias("section"), "sid", "block", cluster.alias("t"))
    style = F.when(F.col("label").startswith("_"), ", style=dotted").otherwise("")
    edge = F.concat(F.lit(" N"), F.col("nid1"), F.lit(" -> N"), F.col("nid0"), F.lit(' [label="'), fn.dot_escape(F.col("label")), F.lit('"'), style, F.lit("];"))
    inner = links.join(own.select(F.col("nid").alias("nid0"), "mid"), "nid0").select("mid", F.floor(F.col("lid") / block).alias("block"), edge.alias("line"))
    edges = inner.groupBy("mid", "block").agg(lines.alias("t")).select("mid", F.lit(2).alias("section"), F.lit(None).cast("long").alias("sid"), "block", "t")
    parts = clusters.unionByName(edges)
    sizes = own.groupBy("mid").agg(F.count(F.lit(1)).alias("n")).unionByName(inner.groupBy("mid").agg(F.count(F.lit(1)).alias("n"))).groupBy("mid").agg((F.sum("n") > block).alias("large"))
    ends = sizes.select("mid", F.explode(F.array(F.struct(F.lit(0).alias("section"), F.lit("digraph {").alias("t")), F.struct(F.lit(3).alias("section"), F.lit("}").alias("t")))).alias("x"))
    ends = ends.select("mid", "x.section", F.lit(None).cast("long").alias("sid"), F.lit(None).cast("long").alias("block"), "x.t")
    every = parts.unionByName(ends).join(sizes, "mid")
    row = [F.when(F.col("large"), F.col("section")).otherwise(0).alias("section"), *(F.when(F.col("large"), F.col(c)).alias(c) for c in ("sid", "block"))]
    in_order = F.transform(F.array_sort(F.collect_list("part")), lambda x: x["t"])
    return every.select("mid", *row, F.struct("section", "sid", "block", "t").alias("part")).groupBy("mid", "section", "sid", "block").agg(F.array_join(in_order, "\n").alias("dot"))
