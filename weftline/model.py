"""The graph stores as clean views: one row per key, labels without null, and the constants of the data model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.common import kept, one_per_key, table

# Fixed values of the data model.
CALL_KINDS = ("call", "new")
PRIMITIVES = ("B", "C", "S", "I", "J", "F", "D", "Z")
STRING_TYPE = "Ljava/lang/String;"
#: Kinds through which a value passes unchanged, and kinds that structure alone needs.
TRANSPARENT = ("assign_var", "ref_var", "join", "begin", "end", "repeat", "passin", "passout", "case", "output", "input", "receive")


def _store(spark: SparkSession, d: str, name: str, key: str, cols: list[str]) -> DataFrame:
    """The clean store of a table: one row per key, kept for all queries of the application."""
    return kept(spark, name, f"{d}/{name}.parquet", lambda: one_per_key(table(spark, d, name), key, cols))


def methods(spark: SparkSession, d: str) -> DataFrame:
    """(mid, kid, method_id, method_name, style, ast_start, ast_end)."""
    return _store(spark, d, "dfmethod", "mid", ["kid", "method_id", "method_name", "style", "ast_start", "ast_end"])


def scopes(spark: SparkSession, d: str) -> DataFrame:
    """(sid, mid, parent, scope_name)."""
    return _store(spark, d, "dfscope", "sid", ["mid", "parent", "scope_name"])


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """(nid, mid, sid, kind, ref_name, ndata, ntype, ast_start, ast_end)."""
    return _store(spark, d, "dfnode", "nid", ["mid", "sid", "kind", "ref_name", "ndata", "ntype", "ast_start", "ast_end"])


def links(spark: SparkSession, d: str) -> DataFrame:
    """(lid, nid0, nid1, label): nid0 accepts from nid1; the default label is ''."""

    def build() -> DataFrame:
        rows = one_per_key(table(spark, d, "dflink").withColumn("label", F.coalesce("label", F.lit(""))), "lid", ["nid0", "nid1", "label"])
        return rows.where(F.col("nid0").isNotNull() & F.col("nid1").isNotNull())

    return kept(spark, "dflink", f"{d}/dflink.parquet", build)


def items(spark: SparkSession, d: str) -> DataFrame:
    """(tid, item)."""
    return _store(spark, d, "items", "tid", ["item"])


def feats(spark: SparkSession, d: str) -> DataFrame:
    """(fid, feat): the text without white space at its ends."""
    return _store(spark, d, "feats", "fid", ["feat"]).select("fid", F.btrim("feat", F.lit(" \t\n")).alias("feat"))


def itemfeats(spark: SparkSession, d: str) -> DataFrame:
    """(sid0, sid1, tid, fid, feat_count): a null count is 0."""
    rows = _store(spark, d, "itemfeats", "sid0", ["sid1", "tid", "fid", "feat_count"])
    return rows.withColumn("feat_count", F.coalesce("feat_count", F.lit(0)))


def counts(spark: SparkSession, d: str) -> DataFrame:
    """(tid, fid, c): the summed counts of every item and feature."""

    def build() -> DataFrame:
        rows = itemfeats(spark, d).where(F.col("tid").isNotNull() & F.col("fid").isNotNull())
        return rows.groupBy("tid", "fid").agg(F.sum("feat_count").alias("c"))

    return kept(spark, "counts", f"{d}/itemfeats.parquet", build)


def sources(spark: SparkSession, d: str) -> DataFrame:
    """(uid, filename, reponame, branchname, commitid, srcpath, src_text)."""
    return _store(spark, d, "sourcemap", "uid", ["filename", "reponame", "branchname", "commitid", "srcpath", "src_text"])


#: The same views for the SQL twins.
SQL_VIEWS = """
    WITH RECURSIVE methods AS (SELECT mid, min(kid) AS kid, min(method_id) AS method_id, min(method_name) AS method_name, min(style) AS style,
              min(ast_start) AS ast_start, min(ast_end) AS ast_end FROM dfmethod WHERE mid IS NOT NULL GROUP BY mid),
         scopes AS (SELECT sid, min(mid) AS mid, min(parent) AS parent, min(scope_name) AS scope_name FROM dfscope WHERE sid IS NOT NULL GROUP BY sid),
         nodes AS (SELECT nid, min(mid) AS mid, min(sid) AS sid, min(kind) AS kind, min(ref_name) AS ref_name, min(ndata) AS ndata,
              min(ntype) AS ntype, min(ast_start) AS ast_start, min(ast_end) AS ast_end FROM dfnode WHERE nid IS NOT NULL GROUP BY nid),
         links AS (SELECT * FROM (SELECT lid, min(nid0) AS nid0, min(nid1) AS nid1, min(coalesce(label, '')) AS label FROM dflink WHERE lid IS NOT NULL GROUP BY lid)
              WHERE nid0 IS NOT NULL AND nid1 IS NOT NULL),
         its AS (SELECT tid, min(item) AS item FROM items WHERE tid IS NOT NULL GROUP BY tid),
         fts AS (SELECT fid, trim(min(feat), ' ' || chr(9) || chr(10)) AS feat FROM feats WHERE fid IS NOT NULL GROUP BY fid),
         ifs AS (SELECT sid0, min(sid1) AS sid1, min(tid) AS tid, min(fid) AS fid, coalesce(min(feat_count), 0) AS feat_count
              FROM itemfeats WHERE sid0 IS NOT NULL GROUP BY sid0),
         cnt AS (SELECT tid, fid, CAST(sum(feat_count) AS BIGINT) AS c FROM ifs WHERE tid IS NOT NULL AND fid IS NOT NULL GROUP BY tid, fid),
         srcs AS (SELECT uid, min(filename) AS filename, min(reponame) AS reponame, min(branchname) AS branchname, min(commitid) AS commitid,
              min(srcpath) AS srcpath, min(src_text) AS src_text FROM sourcemap WHERE uid IS NOT NULL GROUP BY uid),
         calls AS (SELECT nid, mid, unnest(string_split(ndata, ' ')) AS callee FROM nodes WHERE kind IN ('call', 'new') AND ndata IS NOT NULL)
"""

#: The simple name of a class descriptor, and the readable name of a reference, for the SQL twins.
SQL_SIMPLE = "nullif(regexp_extract(split_part(regexp_replace({0}, '^\\[*L?', ''), '<', 1), '([^/;]+);?$', 1), '')"
SQL_REFERENCE = (
    "CASE left({0}, 1) WHEN '$' THEN list_last(string_split({0}, '/$')) WHEN '.' THEN list_last(string_split({0}, '/')) WHEN '#' THEN substr({0}, 2)"
    " WHEN '@' THEN " + SQL_SIMPLE.format("substr({0}, 2)") + " WHEN '%' THEN '[' || coalesce(" + SQL_SIMPLE.format("substr({0}, 2)") + ", substr({0}, 2)) || ']'"
    " WHEN '!' THEN '!' || " + SQL_SIMPLE.format("substr({0}, 2)") + " ELSE {0} END"
)
