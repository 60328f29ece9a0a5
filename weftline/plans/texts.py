"""Scalar functions over the stores, source lines, spans, records and documents of graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline import model as m
from weftline.common import table
from weftline.functions import descriptors
from weftline.functions import names as fn
from weftline.functions import text as tx
from weftline.operators import spans
from weftline.sources import graph_xml, records

V = m.SQL_VIEWS
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = V + sql
        return f

    return add


@query(f"""SELECT nid, {m.SQL_REFERENCE.format('ref_name')} AS name, nullif(regexp_extract(regexp_replace(ref_name, '^%\\[*', ''), '([A-Za-z0-9_]+);?$', 1), '') AS stripped FROM nodes WHERE ref_name IS NOT NULL""")
def decoded_references(spark: SparkSession, d: str) -> DataFrame:
    """Readable and stripped names of all references."""
    own = m.nodes(spark, d).where("ref_name is not null")
    return own.select("nid", fn.reference_name(F.col("ref_name")).alias("name"), fn.strip_id(F.col("ref_name")).alias("stripped"))


@query("""SELECT mid, nullif(regexp_extract(method_id, '^(.*?;)\\.', 1), '') AS class_name, nullif(regexp_extract(method_id, ';\\.:?([^(:]*):?\\(', 1), '') AS name,
    regexp_extract(method_id, '\\(([^)]*)\\)', 1) AS args, nullif(regexp_extract(method_id, '\\)(.*)$', 1), '') AS result FROM methods WHERE method_id IS NOT NULL""")
def decoded_methods(spark: SparkSession, d: str) -> DataFrame:
    """Class, name, arguments and result of method signatures."""
    c = F.col("method_id")
    return m.methods(spark, d).where(c.isNotNull()).select("mid", fn.method_class(c).alias("class_name"), fn.method_simple_name(c).alias("name"), fn.method_args(c).alias("args"), fn.method_result(c).alias("result"))


@query("""SELECT ntype, length(regexp_extract(ntype, '^(\\[*)', 1)) AS dims, CASE WHEN h IN ('B','C','S','I','J','F','D','Z') THEN 'primitive' WHEN h = 'V' THEN 'void' WHEN h = 'L' THEN 'class' WHEN h = 'T' THEN 'variable' WHEN h IN ('+','-','*') THEN 'wildcard' WHEN h = '(' THEN 'function' ELSE 'unknown' END AS form,
    nullif(regexp_extract(split_part(regexp_replace(ntype, '^\\[*L?', ''), '<', 1), '([^/;]+);?$', 1), '') AS simple FROM (SELECT DISTINCT ntype, left(regexp_replace(ntype, '^\\[+', ''), 1) AS h FROM nodes WHERE ntype IS NOT NULL)""")
def decoded_types(spark: SparkSession, d: str) -> DataFrame:
    """Dimensions, form and simple name of type descriptors."""
    c = F.col("ntype")
    return m.nodes(spark, d).where(c.isNotNull()).select("ntype").distinct().select("ntype", fn.type_dims(c).alias("dims"), fn.type_kind(c).alias("form"), fn.class_simple_name(c).alias("simple"))


@query(None)
def parsed_signatures(spark: SparkSession, d: str) -> DataFrame:
    """Arguments and result of every method signature, parsed, with a readable form."""
    own = m.methods(spark, d).where("method_id is not null").select("mid", descriptors.decode(F.regexp_extract("method_id", "(\\(.*)$", 1)).alias("t"))
    return own.select("mid", F.col("t.form").alias("form"), F.col("t.shown").alias("shown"), F.array_join("t.args", " ").alias("args"), F.col("t.result").alias("result"))


@query("SELECT mid, lower(nullif(regexp_extract(method_name, '([A-Z]?[a-z]+|[A-Z]+)$', 1), '')) AS noun FROM methods WHERE method_name IS NOT NULL")
def head_nouns(spark: SparkSession, d: str) -> DataFrame:
    """Head noun of every method name."""
    return m.methods(spark, d).where("method_name is not null").select("mid", fn.head_noun(F.col("method_name")).alias("noun"))


@query("SELECT mid, array_to_string(list_transform(ws, lambda w, i: CASE WHEN i = 1 THEN w ELSE upper(left(w, 1)) || substr(w, 2) END), '') AS renamed FROM (SELECT mid, list_reverse(list_transform(regexp_extract_all(method_name, '[A-Z]+[a-z]*|[a-z]+'), lambda w: lower(w))) AS ws FROM methods WHERE method_name IS NOT NULL)")
def renamed_methods(spark: SparkSession, d: str) -> DataFrame:
    """Camel-case names of the words in reverse order."""
    ws = F.reverse(F.transform(fn.split_camel(F.col("method_name")), F.lower))
    return m.methods(spark, d).where("method_name is not null").select("mid", fn.camel_join(ws).alias("renamed"))


@query("""SELECT fid, CAST(split_part(feat, ',', 1) AS BIGINT) AS dist, split_part(feat, ',', 2) AS prev, split_part(feat, ',', 3) AS own, round(exp(-abs(CAST(split_part(feat, ',', 1) AS BIGINT))), 6) AS weight FROM fts WHERE feat LIKE '%,%,%'""")
def feature_tuples(spark: SparkSession, d: str) -> DataFrame:
    """Features as tuples with the weight of their distance."""
    part = lambda k: F.split_part("feat", F.lit(","), F.lit(k))
    return m.feats(spark, d).where("feat like '%,%,%'").select("fid", part(1).cast("long").alias("dist"), part(2).alias("prev"), part(3).alias("own"), F.round(F.exp(-F.abs(part(1).cast("long"))), 6).alias("weight"))


@query("SELECT nid, replace(replace(replace(replace(ndata, '&', '&amp;'), '>', '&gt;'), '<', '&lt;'), '\"', '&quot;') AS html, replace(ndata, '\"', '\\\"') AS dot, regexp_replace(ndata, '\\s+', '', 'g') AS dense FROM nodes WHERE ndata IS NOT NULL")
def escaped_data(spark: SparkSession, d: str) -> DataFrame:
    """Node data escaped for HTML and DOT, and without white space."""
    c = F.col("ndata")
    return m.nodes(spark, d).where(c.isNotNull()).select("nid", fn.html_escape(c).alias("html"), fn.dot_escape(c).alias("dot"), F.regexp_replace(c, "\\s+", "").alias("dense"))


@query("SELECT nid, concat_ws(':', '', kind, ast_start::VARCHAR, ast_end::VARCHAR) AS span FROM nodes WHERE kind IS NOT NULL AND ast_start IS NOT NULL AND ast_end IS NOT NULL")
def span_ids(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers of node spans."""
    return m.nodes(spark, d).where("kind is not null and ast_start is not null and ast_end is not null").select("nid", fn.span_id(F.col("kind"), F.col("ast_start"), F.col("ast_end")).alias("span"))


@query("""SELECT a.mid AS a, b.mid AS b, round(len(list_intersect(a.w, b.w))::DOUBLE / len(list_distinct(list_concat(a.w, b.w))), 6) AS sim FROM (SELECT mid, list_distinct(list_transform(regexp_extract_all(method_name, '[A-Z]+[a-z]*|[a-z]+'), lambda x: lower(x))) AS w, list_last(regexp_extract_all(method_name, '[A-Z]+[a-z]*|[a-z]+')) AS h, kid FROM methods WHERE kid IS NOT NULL) a
    JOIN (SELECT mid, list_distinct(list_transform(regexp_extract_all(method_name, '[A-Z]+[a-z]*|[a-z]+'), lambda x: lower(x))) AS w, kid FROM methods WHERE kid IS NOT NULL) b ON a.kid = b.kid AND a.mid < b.mid WHERE len(a.w) > 0 AND len(b.w) > 0 AND len(list_intersect(a.w, b.w)) > 0""")
def name_overlap_in_class(spark: SparkSession, d: str) -> DataFrame:
    """Jaccard similarity of the words of two methods' names within a class."""
    own = m.methods(spark, d).where("kid is not null").select("mid", "kid", F.array_distinct(F.transform(fn.split_camel(F.col("method_name")), F.lower)).alias("w"))
    # only pairs with a common word: an index on (class, word) instead of all pairs of a class
    index = own.select("kid", "mid", F.explode("w").alias("word"))
    pairs = index.toDF("kid", "a", "word").join(index.toDF("kid", "b", "word"), ["kid", "word"]).where("a < b").select("a", "b").distinct()
    scored = pairs.join(own.select(F.col("mid").alias("a"), F.col("w").alias("wa")), "a").join(own.select(F.col("mid").alias("b"), F.col("w").alias("wb")), "b")
    return scored.select("a", "b", F.round(tx.jaccard(F.col("wa"), F.col("wb")), 6).alias("sim"))


_LCS = """list_reduce(list_prepend(list_transform(range(0, len(y) + 1), lambda j: CAST(0 AS BIGINT)), list_transform(string_split(x, ''), lambda c: [CAST(unicode(c) AS BIGINT)])),
      lambda row, e: list_reduce(list_prepend([CAST(0 AS BIGINT)], list_transform(range(1, len(y) + 1), lambda j: [CAST(j AS BIGINT)])), lambda r, k: list_append(r, CASE WHEN unicode(y[k[1]]) = e[1] THEN row[k[1]] + 1 ELSE greatest(row[k[1] + 1], r[k[1]]) END)))[len(y) + 1]"""


@query(f""", k AS (SELECT method_id, min(mid) AS mid FROM methods WHERE method_id IS NOT NULL GROUP BY method_id),
    p AS (SELECT DISTINCT c.mid, k.mid AS callee_mid FROM (SELECT mid, split_part(ndata, ' ', 1) AS callee FROM nodes WHERE kind IN ('call', 'new') AND ndata IS NOT NULL AND mid IS NOT NULL) c JOIN k ON k.method_id = c.callee),
    q AS (SELECT p.mid, callee_mid, a.method_name AS x, b.method_name AS y FROM p JOIN methods a ON a.mid = p.mid JOIN methods b ON b.mid = callee_mid)
    SELECT mid, callee_mid, CASE WHEN coalesce(x, '') = '' OR coalesce(y, '') = '' THEN 0.0 ELSE round(CAST({_LCS} AS DOUBLE) / greatest(len(x), len(y)), 6) END AS sim FROM q""")
def name_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Similarity by longest common subsequence of the callee's name and the caller's."""
    from weftline.operators import stitch

    me = m.methods(spark, d)
    pairs = stitch.resolved(m.nodes(spark, d), me).where("mid is not null").select("mid", "callee_mid").distinct()
    named = pairs.join(me.select("mid", F.col("method_name").alias("x")), "mid").join(me.select(F.col("mid").alias("callee_mid"), F.col("method_name").alias("y")), "callee_mid")
    return named.select("mid", "callee_mid", F.round(tx.lcs_similarity("x", "y"), 6).alias("sim"))


_ESCAPED = " ".join("WHEN {} THEN '{}'".format(code, text.replace("'", "''")) for code, text in tx._QUOTED.items())


@query(f"""SELECT ndata, '"' || coalesce(array_to_string(list_transform(list_filter(string_split(ndata, ''), lambda c: c <> ''), lambda c: CASE unicode(c) {_ESCAPED} ELSE
    CASE WHEN unicode(c) BETWEEN 32 AND 126 THEN c WHEN unicode(c) < 65536 THEN format('\\u{{:04x}}', unicode(c)) ELSE format('\\u{{:04x}}\\u{{:04x}}', 55296 + (unicode(c) - 65536) // 1024, 56320 + (unicode(c) - 65536) % 1024) END END), ''), '') || '"' AS literal
    FROM (SELECT DISTINCT ndata FROM nodes WHERE ndata IS NOT NULL)""")
def java_literals(spark: SparkSession, d: str) -> DataFrame:
    """Distinct node data as Java literals."""
    return m.nodes(spark, d).where("ndata is not null").select("ndata").distinct().select("ndata", tx.java_literal("ndata").alias("literal"))


@query("""SELECT doc_id, k AS key, v AS value FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?:^|\\n)\\+([A-Z]+) ([^\\n]*)', 1)) AS k, unnest(regexp_extract_all(text, '(?:^|\\n)\\+([A-Z]+) ([^\\n]*)', 2)) AS v FROM documents WHERE doc_kind = 'report' AND text IS NOT NULL)""")
def record_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields of the record streams in reports."""
    return records.fields(table(spark, d, "documents").where("doc_kind = 'report'"), "doc_id", "text").select("doc_id", "key", "value")


@query("""SELECT count(DISTINCT (doc_id, grp)) AS n_records, count(DISTINCT (doc_id, grp)) AS n_equal FROM (SELECT doc_id, line, sum(CASE WHEN trim(line, ' ' || chr(9) || chr(13)) = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY nth) AS grp
    FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS nth FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE doc_kind = 'report' AND text IS NOT NULL))) WHERE regexp_matches(line, '^[+][A-Z]+( |$)')""")
def record_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Records of reports read, written as streams and read again: the number of records that stay equal."""
    docs = table(spark, d, "documents").where("doc_kind = 'report'")
    once = records.read(docs, "doc_id", "text")
    again = records.read(records.write(once, "doc_id"), "doc_id", "text")
    same = once.select("doc_id", "nth", F.to_json("fields").alias("f")).join(again.select("doc_id", "nth", F.to_json("fields").alias("g")), ["doc_id", "nth"])
    return same.agg(F.count(F.lit(1)).alias("n_records"), F.count_if(F.col("f") == F.col("g")).alias("n_equal"))


@query("""SELECT uid, n - 1 AS lineno, coalesce(sum(length(l) + 1) OVER (PARTITION BY uid ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, sum(length(l) + 1) OVER (PARTITION BY uid ORDER BY n)::BIGINT AS "end" FROM (SELECT uid, unnest(ls) AS l, unnest(range(1, len(ls) + 1)) AS n FROM (SELECT uid, string_split(src_text, chr(10)) AS ls FROM srcs WHERE src_text IS NOT NULL))""")
def line_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Lines of all sources with their offsets in characters."""
    return spans.lines(m.sources(spark, d), "uid", "src_text").select("uid", "lineno", "start", "end")


_SPANS = """, f AS (SELECT uid, src_text, strpos(src_text, '{') - 1 AS s, strpos(src_text, '}') AS e FROM srcs WHERE src_text IS NOT NULL), sp AS (SELECT uid, s::BIGINT AS s, e::BIGINT AS e FROM f WHERE s >= 0 AND e > s),
    ln AS (SELECT uid, n - 1 AS lineno, sum(length(l) + 1) OVER (PARTITION BY uid ORDER BY n) AS e0, length(l) + 1 AS len FROM (SELECT uid, unnest(ls) AS l, unnest(range(1, len(ls) + 1)) AS n FROM (SELECT uid, string_split(src_text, chr(10)) AS ls FROM f)))"""


def _first_blocks(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    s, e = F.instr("src_text", "{").cast("long") - 1, F.instr("src_text", "}").cast("long")
    return spans.lines(files, "uid", "src_text"), files.select("uid", s.alias("s"), e.alias("e")).where("s >= 0 and e > s")


@query(_SPANS + " SELECT ln.uid, lineno FROM ln JOIN sp USING (uid) WHERE sp.s < e0 AND e0 - len < sp.e")
def span_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of each file that its first block overlaps."""
    ln, sp = _first_blocks(m.sources(spark, d))
    return spans.overlapping(ln, sp, "uid").select("uid", "lineno")


@query(_SPANS + """, hit AS (SELECT ln.uid, lineno FROM ln JOIN sp USING (uid) WHERE sp.s < e0 AND e0 - len < sp.e), near AS (SELECT DISTINCT h.uid, h.lineno + k AS lineno FROM hit h, range(-2, 3) t(k))
    SELECT n.uid, n.lineno, CASE WHEN h.lineno IS NULL THEN ' ' ELSE '+' END AS mark, p.lineno IS NULL AS gap FROM near n JOIN ln ON ln.uid = n.uid AND ln.lineno = n.lineno LEFT JOIN hit h ON h.uid = n.uid AND h.lineno = n.lineno LEFT JOIN near p ON p.uid = n.uid AND p.lineno = n.lineno - 1""")
def annotated_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines around each first block, hits marked and gaps noted."""
    ln, sp = _first_blocks(m.sources(spark, d))
    return spans.with_context(ln, spans.overlapping(ln, sp, "uid"), "uid", 2).select("uid", "lineno", "mark", "gap")


@query("SELECT uid, substr(src_text, strpos(src_text, '{'), strpos(src_text, '}') - strpos(src_text, '{') + 1) AS block, length(src_text) - length(replace(src_text, chr(10), '')) AS feeds FROM srcs WHERE strpos(src_text, '{') > 0 AND strpos(src_text, '}') > strpos(src_text, '{')")
def span_text(spark: SparkSession, d: str) -> DataFrame:
    """Text of each first block, and the line feeds of the file."""
    return _block_text(m.sources(spark, d))


def _block_text(files: DataFrame) -> DataFrame:
    s, e = F.instr("src_text", "{"), F.instr("src_text", "}")
    return files.where((s > 0) & (e > s)).select("uid", F.substring("src_text", s, e - s + 1).alias("block"), tx.line_feeds(F.col("src_text")).alias("feeds"))


@query(None)
def graph_documents(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the XML graph documents among the sources: classes, methods, scopes, nodes and links."""
    return graph_xml.rows(m.sources(spark, d).where(F.lower("srcpath").endswith(".graph")), "uid", "src_text")


@query(None)
def graph_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """XML graphs read, written and read again: rows before, after and equal."""
    first = graph_xml.rows(m.sources(spark, d).where(F.lower("srcpath").endswith(".graph")), "uid", "src_text")
    again = graph_xml.rows(graph_xml.write(first, "uid"), "uid", "xml")
    keys = ["uid", "entity", "parent_key", "item_key", "label", "kind", "ref", "ndata", "ntype"]
    a, b = first.select(*keys), again.select(*keys)
    return a.withColumn("o", F.lit(1)).unionByName(b.withColumn("o", F.lit(-1))).groupBy(*keys).agg(F.sum("o").alias("o"), F.count_if(F.col("o") == 1).alias("n")).agg(F.sum("n").alias("n_rows"), F.count_if(F.col("o") != 0).alias("n_different"))


@query(None)
def dot_graphs(spark: SparkSession, d: str) -> DataFrame:
    """GraphViz text of every method, clusters per scope; large methods in several rows."""
    return graph_xml.dot(m.nodes(spark, d), m.links(spark, d))
