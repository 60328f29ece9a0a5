"""Further analyses: matches, overriders, chains, comments, comparisons, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline import model as m
from weftline.common import cut, kept, shared_folder
from weftline.frontend import build
from weftline.functions import names as fn
from weftline.functions import syntax_kinds
from weftline.functions import text as tx
from weftline.operators import bayes, classes, spans, walks
from weftline.plans import graphs, scans, words
from weftline.sources import comments, graph_xml, records, stores
from weftline.streaming import increments

V = m.SQL_VIEWS
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = V + sql
        return f

    return add


@query(graphs.SQL["path_search"].replace(V, "", 1) + " QUALIFY row_number() OVER (PARTITION BY q.mid ORDER BY count(DISTINCT q.nid) DESC, max(q.size) DESC, x.mid) = 1")
def best_matches(spark: SparkSession, d: str) -> DataFrame:
    """The method most alike in shape to each query method."""
    return bayes.top_per_group(graphs.path_search(spark, d), "qmid", 1, F.desc("n_query"), F.desc("depth"), "mid")


@query("""SELECT n.mid, count(*) AS n_nodes, CAST(max(coalesce(i.c, 0)) AS BIGINT) AS branch FROM nodes n LEFT JOIN (SELECT nid0, count(*) AS c FROM links WHERE NOT starts_with(label, '_') GROUP BY nid0) i ON i.nid0 = n.nid WHERE n.mid IS NOT NULL GROUP BY n.mid""")
def tree_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Nodes and greatest branching of every method."""
    ins = m.links(spark, d).where(~F.col("label").startswith("_")).groupBy(F.col("nid0").alias("nid")).agg(F.count(F.lit(1)).alias("c"))
    return m.nodes(spark, d).where("mid is not null").join(ins, "nid", "left").groupBy("mid").agg(F.count(F.lit(1)).alias("n_nodes"), F.max(F.coalesce("c", F.lit(0))).alias("branch"))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the graph documents among the sources, and of the graphs of the Java sources."""
    files = m.sources(spark, d).where(F.lower("srcpath").endswith(".graph"))
    return graph_xml.rows(files, "uid", "src_text").unionByName(_java(spark, d).where("entity <> 'error'"))


def _classes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = _documents(spark, d)
    own = rows.where("entity = 'class' and item_key is not null")
    bases = F.concat(F.array(F.col("attributes")["extends"]), F.split(F.coalesce(F.col("attributes")["implements"], F.lit("")), " "))
    cls = own.select(F.col("item_key").alias("name"), F.explode(bases).alias("base")).where("base is not null and base <> ''").distinct()
    me = rows.where("entity = 'method'").select(F.col("item_key").alias("method_id"), F.col("parent_key").alias("class_name"), F.regexp_extract("item_key", ";\\.(.*\\))", 1).alias("signature"))
    return cut(cls), cut(me.distinct())


@query(None)
def class_ancestors(spark: SparkSession, d: str) -> DataFrame:
    """Ancestors of the classes of graph documents and Java sources, by what they extend and implement."""
    return classes.ancestors(_classes(spark, d)[0])


@query(None)
def overriders(spark: SparkSession, d: str) -> DataFrame:
    """Methods that override others, deepest first."""
    cls, me = _classes(spark, d)
    return classes.overriders(me, classes.ancestors(cls))


@query("""SELECT count(*) AS n_items, CAST(sum(n) AS BIGINT) AS n_common FROM (SELECT a.tid, count(b.fid) AS n FROM (SELECT DISTINCT tid, fid FROM ifs WHERE sid0 % 2 = 0 AND tid IS NOT NULL AND fid IS NOT NULL) a
    LEFT JOIN (SELECT DISTINCT tid, fid FROM ifs WHERE sid0 % 2 = 1) b ON a.tid = b.tid AND a.fid = b.fid WHERE a.tid IN (SELECT tid FROM ifs WHERE sid0 % 2 = 1 AND fid IS NOT NULL) GROUP BY a.tid)""")
def store_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Two stores of the same items, by even and odd positions: shared items and features in both."""
    rows = m.itemfeats(spark, d).where("tid is not null and fid is not null")
    a, b = rows.where("sid0 % 2 = 0").select("tid", "fid").distinct(), rows.where("sid0 % 2 = 1").select("tid", "fid").distinct()
    shared = a.join(b.select("tid").distinct(), "tid", "left_semi").join(b.withColumn("both", F.lit(1)), ["tid", "fid"], "left")
    return shared.groupBy("tid").agg(F.count("both").alias("n")).agg(F.count(F.lit(1)).alias("n_items"), F.sum("n").alias("n_common"))


@query(words._VSM.replace("SELECT a, b, round(dot", ", pr2 AS (SELECT a, b, round(dot", 1) + """), nm AS (SELECT tid, regexp_extract(item, '([A-Za-z0-9_]+);?$', 1) AS n, left(item, 1) AS g FROM its WHERE item IS NOT NULL)
    SELECT count(*) AS n_pairs, CAST(count(*) FILTER (x.n = y.n) AS BIGINT) AS same_name, CAST(count(*) FILTER (x.g = y.g) AS BIGINT) AS same_sigil, round(avg(sim), 6) AS mean_sim FROM pr2 JOIN nm x ON x.tid = a JOIN nm y ON y.tid = b""")
def pair_statistics(spark: SparkSession, d: str) -> DataFrame:
    """How often similar items share their name and their kind of reference."""
    nm = m.items(spark, d).where("item is not null").select("tid", F.coalesce(fn.strip_id(F.col("item")), F.lit("")).alias("n"), F.left("item", F.lit(1)).alias("g"))
    p = words.similar_items(spark, d).join(nm.toDF("a", "na", "ga"), "a").join(nm.toDF("b", "nb", "gb"), "b")
    return p.agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(F.col("na") == F.col("nb")).alias("same_name"), F.count_if(F.col("ga") == F.col("gb")).alias("same_sigil"), F.round(F.avg("sim"), 6).alias("mean_sim"))


@query("""SELECT a.mid AS a, b.mid AS b, a.args = b.args AS same_args, a.res = b.res AS same_result FROM (SELECT mid, kid, method_name, regexp_extract(method_id, '\\(([^)]*)\\)', 1) AS args, regexp_extract(method_id, '\\)(.*)$', 1) AS res FROM methods) a
    JOIN (SELECT mid, kid, method_name, regexp_extract(method_id, '\\(([^)]*)\\)', 1) AS args, regexp_extract(method_id, '\\)(.*)$', 1) AS res FROM methods) b ON a.method_name = b.method_name AND a.kid = b.kid AND a.mid < b.mid""")
def overloads(spark: SparkSession, d: str) -> DataFrame:
    """Methods of one name in a class: equal arguments, equal results."""
    one = m.methods(spark, d).select("mid", "kid", "method_name", fn.method_args(F.col("method_id")).alias("args"), F.regexp_extract("method_id", "\\)(.*)$", 1).alias("res"))
    return one.toDF("a", "kid", "method_name", "xa", "xr").join(one.toDF("b", "kid", "method_name", "ya", "yr"), ["kid", "method_name"]).where("a < b").select("a", "b", (F.col("xa") == F.col("ya")).alias("same_args"), (F.col("xr") == F.col("yr")).alias("same_result"))


@query("SELECT style, string_agg(method_name || '=' || n, ' ' ORDER BY n DESC, method_name) AS names FROM (SELECT style, method_name, count(*) AS n FROM methods WHERE method_name IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3) GROUP BY style")
def grouped_names(spark: SparkSession, d: str) -> DataFrame:
    """Frequent names per style, most frequent first."""
    per = m.methods(spark, d).where("method_name is not null").groupBy("style", "method_name").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    rows = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "method_name", "n")))
    return per.groupBy("style").agg(F.array_join(F.transform(rows, lambda x: F.concat(x["method_name"], F.lit("="), x["n"])), " ").alias("names"))


@query("SELECT tid, item FROM its ORDER BY md5('11:' || tid) LIMIT 50")
def blind_sample(spark: SparkSession, d: str) -> DataFrame:
    """Fifty items in a random order that a seed fixes."""
    return m.items(spark, d).orderBy(F.md5(F.concat(F.lit("11:"), F.col("tid").cast("string")))).limit(50)


@query("SELECT mid, n FROM (SELECT mid, n, row_number() OVER (ORDER BY n DESC, mid) AS k, count(*) OVER () AS t FROM (SELECT mid, count(*) AS n FROM nodes WHERE mid IS NOT NULL GROUP BY mid)) WHERE k <= t // 2")
def larger_half(spark: SparkSession, d: str) -> DataFrame:
    """The larger half of the methods."""
    per = m.nodes(spark, d).where("mid is not null").groupBy("mid").agg(F.count(F.lit(1)).alias("n"))
    half = per.count() // 2
    return words.ranked(per, "n", "mid").where(F.col("place") <= half).select("mid", "n")


@query("SELECT mid, '<' || string_agg(ntype, '' ORDER BY ntype) || '>' AS reified FROM (SELECT DISTINCT mid, ntype FROM nodes WHERE kind = 'input' AND mid IS NOT NULL AND ntype IS NOT NULL) GROUP BY mid")
def reified_names(spark: SparkSession, d: str) -> DataFrame:
    """Name of a method's instance by the sorted types of its inputs."""
    own = m.nodes(spark, d).where("kind = 'input' and mid is not null and ntype is not null")
    return own.groupBy("mid").agg(F.concat(F.lit("<"), F.array_join(F.array_sort(F.collect_set("ntype")), ""), F.lit(">")).alias("reified"))


@query(scans.SQL["rehydrated_nodes"].replace("SELECT n.nid, n.kind, coalesce(l.inputs, '') AS inputs", "SELECT n.nid, len(string_split(l.inputs, ' '))::BIGINT AS n_labels").replace(V, "", 1).replace("LEFT JOIN (", "JOIN ("))
def input_maps(spark: SparkSession, d: str) -> DataFrame:
    """Inputs of a node as a map of properties: how many labels it has."""
    return scans.rehydrated_nodes(spark, d).where("inputs <> ''").select("nid", F.size(tx.properties(F.col("inputs"))).cast("long").alias("n_labels"))


@query("""SELECT uid, CAST(list_reduce(list_prepend(0, list_transform(list_filter(string_split(line, ''), lambda c: c <> ''), lambda c: CASE WHEN c = chr(9) THEN -1 ELSE 1 END)), lambda col, x: CASE WHEN x < 0 THEN (col // 8 + 1) * 8 ELSE col + x END) AS BIGINT) AS col
    FROM (SELECT uid, list_last(string_split(substr(src_text, 1, strpos(src_text, '{') - 1), chr(10))) AS line FROM srcs WHERE strpos(src_text, '{') > 0)""")
def block_columns(spark: SparkSession, d: str) -> DataFrame:
    """Column of the first block of each source that has one, with tab stops of eight."""
    return _block_column(m.sources(spark, d))


def _block_column(files: DataFrame) -> DataFrame:
    at = F.instr("src_text", "{")
    return files.where(at > 0).select("uid", tx.column_position(F.substring("src_text", F.lit(1), at - 1)).alias("col"))


@query(scans._IDF + """, le AS (SELECT DISTINCT src, dst, funcall, way FROM idf WHERE NOT starts_with(label, '_')),
    lw AS (SELECT nid AS start, nid, CAST([] AS BIGINT[]) AS stack, 0 AS a, 1 AS n FROM nodes WHERE kind = 'input' AND nid NOT IN (SELECT dst FROM le)
      UNION SELECT w.start, e.dst, CASE WHEN e.way = 'in' THEN list_append(w.stack, e.funcall) WHEN e.way = 'out' THEN w.stack[1:len(w.stack) - 1] ELSE w.stack END, w.a + (CASE WHEN k.kind = 'assign_var' THEN 1 ELSE 0 END), w.n + 1
        FROM lw w JOIN le e ON e.src = w.nid JOIN nodes k ON k.nid = e.dst WHERE w.n < 12 AND (e.way IS NULL OR (e.way = 'in' AND NOT list_contains(w.stack, e.funcall)) OR (e.way = 'out' AND len(w.stack) > 0 AND w.stack[-1] = e.funcall)))
    SELECT start, w.nid, CAST(max(w.a * 100 + w.n) AS BIGINT) AS longest FROM lw w JOIN nodes k ON k.nid = w.nid AND k.kind IN ('output', 'return') WHERE len(w.stack) = 0 AND w.n > 1 GROUP BY start, w.nid""")
def longest_paths(spark: SparkSession, d: str) -> DataFrame:
    """Longest way from every input that nothing feeds to each output, over calls with their returns matched: assignments count first, then nodes; up to twelve nodes."""
    return walks.longest_ways(scans.stitched(spark, d), m.nodes(spark, d), 12).select("start", "nid", (F.col("assigned") * 100 + F.col("n_nodes")).alias("longest"))


@query(scans._IDF + """, lc AS (SELECT l.nid0, l.nid1, l.label = 'cond' AS c FROM links l JOIN nodes e ON e.nid = l.nid0 AND e.kind = 'end' WHERE NOT starts_with(l.label, '_')),
    lv AS (SELECT nid0 AS start, nid1 AS nid FROM lc WHERE c OR nid0 NOT IN (SELECT nid0 FROM lc WHERE c)
      UNION SELECT v.start, l.nid1 FROM lv v JOIN nodes k ON k.nid = v.nid AND coalesce(k.kind, '') NOT IN ('begin', 'end') JOIN links l ON l.nid0 = v.nid AND NOT starts_with(l.label, '_'))
    SELECT DISTINCT v.start AS nid, k.ref_name FROM lv v JOIN nodes k ON k.nid = v.nid AND k.kind IN ('ref_var', 'ref_field') AND k.ref_name IS NOT NULL""")
def loop_variables(spark: SparkSession, d: str) -> DataFrame:
    """Variables that the condition at the end of a loop depends on, within the loop: up to its beginning and other loops' ends.

    The condition is the input 'cond'; an end without one depends on all of its inputs.
    """
    n = m.nodes(spark, d)
    real = cut(m.links(spark, d).where(~F.col("label").startswith("_")).select("nid0", "nid1").distinct())
    into = m.links(spark, d).where("not startswith(label, '_')").join(n.where("kind = 'end'").select(F.col("nid").alias("nid0")), "nid0")
    named = into.where("label = 'cond'").select("nid0", "nid1")
    conditions = named.unionByName(into.select("nid0", "nid1").join(named.select("nid0"), "nid0", "left_anti"))
    kinds = n.select("nid", "kind")
    front = cut(conditions.select(F.col("nid0").alias("start"), F.col("nid1").alias("nid")).distinct())
    seen = front
    while not front.isEmpty():
        inside = front.join(kinds, "nid").where(~F.coalesce(F.col("kind").isin("begin", "end"), F.lit(False)))
        moved = inside.join(real, F.col("nid") == F.col("nid0")).select("start", F.col("nid1").alias("nid")).distinct()
        front = cut(moved.join(seen, ["start", "nid"], "left_anti"))
        seen = seen.unionByName(front)
    read = n.where("kind in ('ref_var', 'ref_field') and ref_name is not null").select("nid", "ref_name")
    return seen.join(read, "nid").select(F.col("start").alias("nid"), "ref_name").distinct()


@query(None)
def source_comments(spark: SparkSession, d: str) -> DataFrame:
    """Comments of Java sources with their place and the nearest tokens."""
    return comments.comments(m.sources(spark, d).where(F.lower("srcpath").endswith(".java")), "uid", "src_text")


@query(None)
def marked_sources(spark: SparkSession, d: str) -> DataFrame:
    """Java sources with their comments marked."""
    rows = source_comments(spark, d).groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("s", "e", "kind"))).alias("marks"))
    texts_ = m.sources(spark, d).select("uid", "src_text").join(rows, "uid")

    def run(batches):
        for pdf in batches:
            yield pdf[["uid"]].assign(marked=[spans.nested_marks(t, [(x["s"], x["e"], x["kind"]) for x in ms]) for t, ms in zip(pdf["src_text"], pdf["marks"])])

    return texts_.mapInPandas(run, "uid bigint, marked string")


def _java(spark: SparkSession, d: str) -> DataFrame:
    rows = lambda: build.java_graphs(m.sources(spark, d).where(F.lower("srcpath").endswith(".java")), "uid", "src_text", "reponame")
    return kept(spark, "java_graphs", f"{d}/sourcemap.parquet", rows)


@query(None)
def class_details(spark: SparkSession, d: str) -> DataFrame:
    """Classes of graph documents and Java sources: path, base, interfaces and number of methods."""
    rows = _documents(spark, d)
    per = rows.where("entity = 'method'").groupBy("uid", F.col("parent_key").alias("name")).agg(F.count(F.lit(1)).alias("n_methods"))
    own = rows.where("entity = 'class'").select("uid", F.col("item_key").alias("name"), F.col("attributes")["path"].alias("path"), F.col("attributes")["extends"].alias("base"), F.array_join(F.array_sort(F.split(F.coalesce(F.col("attributes")["implements"], F.lit("")), " ")), " ").alias("interfaces"))
    return own.join(per, ["uid", "name"], "left").withColumn("n_methods", F.coalesce("n_methods", F.lit(0)))


@query(None)
def node_places(spark: SparkSession, d: str) -> DataFrame:
    """Every node of the graph documents with its file, the file's number in the order of paths, its span and the name of its syntax kind."""
    files = m.sources(spark, d).where(F.lower("srcpath").endswith(".graph"))
    rows = graph_xml.rows(files, "uid", "src_text")
    at = W.partitionBy("uid").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    path = F.last(F.when(F.col("entity") == "class", F.col("attributes")["path"]), True).over(at)
    nodes = cut(rows.withColumn("path", path).where("entity = 'node' and ast_start is not null and ast_end is not null and path is not null"))
    paths = words.ranked(nodes.select("path").distinct().withColumn("one", F.lit(1)), "one", "path").select("path", (F.col("place") - 1).cast("long").alias("file_no"))
    kinds = F.element_at(syntax_kinds.names(), F.col("attributes")["ast"].cast("int"))
    return nodes.join(paths, "path").select("uid", F.col("item_key").alias("node_id"), "path", "file_no", "ast_start", "ast_end", kinds.alias("syntax"))


@query("SELECT code, name FROM (VALUES " + ", ".join(f"(CAST({c} AS BIGINT), '{n}')" for c, n in syntax_kinds.NAMES.items()) + ") t(code, name)")
def syntax_kind_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of the syntax kinds by code."""
    return spark.createDataFrame(list(syntax_kinds.NAMES.items()), "code bigint, name string")


@query(None)
def java_tree(spark: SparkSession, d: str) -> DataFrame:
    """Parse trees of all Java sources: rule, span and depth of every node, in order."""
    return build.java_trees(m.sources(spark, d).where(F.lower("srcpath").endswith(".java")), "uid", "src_text")


@query(None)
def java_graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of the dataflow graphs of all Java sources."""
    return _java(spark, d).where("entity = 'node'").select("uid", F.col("parent_key").alias("scope_name"), F.col("item_key").alias("node_id"), "kind", "ref", "ndata", "ntype", "ast_start", "ast_end")


@query(None)
def java_graph_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of the dataflow graphs of all Java sources."""
    return _java(spark, d).where("entity = 'link'").select("uid", F.col("parent_key").alias("dst"), F.col("item_key").alias("src"), "label")


@query(None)
def java_graph_methods(spark: SparkSession, d: str) -> DataFrame:
    """Methods of all Java sources with their style and place."""
    return _java(spark, d).where("entity = 'method'").select("uid", F.col("parent_key").alias("class_name"), F.col("item_key").alias("method_id"), F.col("attributes")["style"].alias("style"), "ast_start", "ast_end")


@query(None)
def java_classes(spark: SparkSession, d: str) -> DataFrame:
    """Classes of all Java sources, local and anonymous ones too: what they extend and implement, and their fields."""
    own = _java(spark, d).where("entity = 'class'")
    count = lambda c: F.when(F.coalesce(c, F.lit("")) == "", 0).otherwise(F.size(F.split(c, " "))).cast("long")
    return own.select("uid", F.col("item_key").alias("name"), F.col("attributes")["extends"].alias("base"), count(F.col("attributes")["implements"]).alias("n_interfaces"), count(F.col("attributes")["fields"]).alias("n_fields"))


@query(None)
def java_calls(spark: SparkSession, d: str) -> DataFrame:
    """Calls of all Java sources by callee: how many, and in how many files it is declared within the project."""
    rows = _java(spark, d)
    repo = m.sources(spark, d).select("uid", F.coalesce("reponame", F.lit("")).alias("repo"))
    calls = rows.where("entity = 'node' and kind in ('call', 'new')").join(repo, "uid").groupBy("repo", F.col("ndata").alias("callee")).agg(F.count(F.lit(1)).alias("n_calls"))
    made = rows.where("entity = 'method'").join(repo, "uid").groupBy("repo", F.col("item_key").alias("callee")).agg(F.count_distinct("uid").alias("n"))
    return calls.join(made, ["repo", "callee"], "left").select("repo", "callee", "n_calls", F.coalesce("n", F.lit(0)).alias("n_files"))


@query(None)
def java_syntax_errors(spark: SparkSession, d: str) -> DataFrame:
    """Java sources that have no graph because they do not parse."""
    return _java(spark, d).where("entity = 'error'").select("uid", F.col("label").alias("message"))


@query(None)
def java_graph_documents(spark: SparkSession, d: str) -> DataFrame:
    """XML graph documents of all Java sources that parse."""
    return graph_xml.write(_java(spark, d).where("entity <> 'error'"), "uid")


@query("SELECT count(*) AS n_rows, CAST(sum(c) AS BIGINT) AS total FROM (SELECT i.item, f.feat, sum(c.c) AS c FROM cnt c JOIN its i USING (tid) JOIN fts f USING (fid) WHERE i.item IS NOT NULL GROUP BY 1, 2)")
def feature_text_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Item features written as record streams and read again."""
    again = stores.read_feature_text(stores.feature_text(scans.item_features(spark, d)), "text")
    return again.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("c").alias("total"))


@query("""SELECT 'item' AS what, count(*) AS n_rows, CAST(sum(c) AS BIGINT) AS total, CAST(sum(n) AS BIGINT) AS n_srcs FROM (SELECT i.item, f.feat, sum(s.feat_count) AS c, count(*) AS n FROM ifs s JOIN its i USING (tid) JOIN fts f USING (fid) WHERE i.item IS NOT NULL GROUP BY 1, 2)
    UNION ALL SELECT 'source', count(*), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM srcs""")
def feature_sources_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Item features with the ranges of their sources, and the files' names, written as record streams and read again."""
    rows = m.itemfeats(spark, d).join(m.items(spark, d).where("item is not null"), "tid").join(m.feats(spark, d), "fid")
    per = rows.groupBy("item", "feat").agg(F.sum("feat_count").alias("c"), F.array_sort(F.collect_list(F.array("sid0", "sid1"))).alias("srcs"))
    text = cut(stores.feature_text(per, m.sources(spark, d).select(F.col("uid").alias("id"), F.col("srcpath").alias("path"))))
    feats = stores.read_feature_text(text, "text").agg(F.lit("item").alias("what"), F.count(F.lit(1)).alias("n_rows"), F.sum("c").alias("total"), F.sum("n_srcs").alias("n_srcs"))
    none = F.lit(0).cast("long")
    return feats.unionByName(stores.read_sources(text, "text").agg(F.lit("source").alias("what"), F.count(F.lit(1)).alias("n_rows"), none.alias("total"), none.alias("n_srcs")))


@query("SELECT 'M' || mid AS path, CAST(ast_start AS BIGINT) AS s, CAST(ast_end AS BIGINT) AS e, kind, CAST(nid AS VARCHAR) AS nid FROM nodes WHERE mid IS NOT NULL AND kind IS NOT NULL AND ast_start IS NOT NULL AND ast_end IS NOT NULL")
def place_lines(spark: SparkSession, d: str) -> DataFrame:
    """Nodes as a list of places, one line each, read again."""
    n = m.nodes(spark, d).where("mid is not null and kind is not null and ast_start is not null and ast_end is not null")
    lines = n.select("nid", F.concat_ws(" ", F.lit("@"), F.concat(F.lit("M"), F.col("mid")), "ast_start", "ast_end", F.concat(F.lit("kind="), F.col("kind")), F.concat(F.lit("nid="), F.col("nid"))).alias("text"))
    return records.marks(lines.withColumnRenamed("nid", "k"), "k", "text").select("path", "s", "e", F.col("props")["kind"].alias("kind"), F.col("props")["nid"].alias("nid"))


@query("SELECT ref_name, arg_max(ntype, nid) AS ntype FROM nodes WHERE left(ref_name, 1) IN ('$', '@') AND ntype IS NOT NULL GROUP BY ref_name")
def variable_lines(spark: SparkSession, d: str) -> DataFrame:
    """The variable list written as lines and read again."""
    return stores.read_variable_lines(stores.variable_lines(scans.variable_list(spark, d)))


@query("SELECT event_type AS feat, CAST(sum(CASE WHEN value < 1 THEN -1 ELSE 1 END) AS BIGINT) AS c FROM events GROUP BY event_type")
def streamed_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts of event types kept by a stream, small values taken back with negative weights."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(_as_folder(spark, d, "events"))
    weighted = stream.select(F.col("event_type").alias("feat"), F.when(F.col("value") < 1, -1).otherwise(1).alias("w"))
    return increments.collect_updates(increments.running_counts(weighted, ["feat"], "w"), ["feat"], _scratch(spark))


@query("SELECT CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def streamed_days(spark: SparkSession, d: str) -> DataFrame:
    """Events per day and type in tumbling windows of a stream."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(_as_folder(spark, d, "events"))
    # the event time in seconds since 1970 by the clock on the wall, whatever the session's time zone
    stream = stream.withColumn("ts", F.timestamp_seconds(F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")))
    made = increments.collect_updates(increments.windowed_counts(stream, "ts", "1 day", "30 days", "event_type"), ["window", "event_type"], _scratch(spark))
    return made.select(F.floor(F.unix_seconds("window.start") / 86400).alias("day"), "event_type", "n")


@query("SELECT count(*) AS n_rows FROM (SELECT DISTINCT tid, fid, c FROM cnt)")
def appended_store(spark: SparkSession, d: str) -> DataFrame:
    """The counts store written in two loads by a stream, the second with rows of the first again: each row is there once."""
    folder = _scratch(spark)
    rows = m.counts(spark, d).select(F.concat_ws(":", "tid", "fid").alias("id"), "tid", "fid", "c")
    for load in (rows.where("tid % 2 = 0"), rows):
        load.write.mode("append").parquet(f"{folder}/in")
        increments.append_files(spark, f"{folder}/in", "id string, tid bigint, fid bigint, c bigint", "id", f"{folder}/store", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/store").agg(F.count(F.lit(1)).alias("n_rows"))


@query(None)
def streamed_documents(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the graph documents read as a stream of files: how many of each kind."""
    folder = _scratch(spark)
    schema = spark.read.parquet(f"{d}/sourcemap.parquet").schema
    rows = increments.stream_documents(spark, _as_folder(spark, d, "sourcemap"), schema, "uid", "src_text", F.lower("srcpath").endswith(".graph"))
    once = lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")
    increments.drain(rows, f"{folder}/checkpoint", once)
    return spark.read.parquet(f"{folder}/rows").drop("batch").dropDuplicates(["uid", "ord"]).groupBy("entity").agg(F.count(F.lit(1)).alias("n"))


@query(words.SQL["nb_train"].replace(V, "", 1))
def model_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The counts of the model saved, checked and loaded again."""
    folder = _scratch(spark)
    stores.save_model(*bayes.train(words._observations(spark, d)), folder)
    keys, feats = stores.load_model(spark, folder)
    return feats.unionByName(keys.select(F.lit(None).cast("long").alias("feat"), "key", F.col("k").alias("c"))).select("feat", "key", "c")


@query("SELECT 'dfmethod' AS tbl, count(*) AS n FROM methods WHERE mid IN (412, 977, 1203) UNION ALL SELECT 'dfnode', count(*) FROM nodes WHERE mid IN (412, 977, 1203)")
def store_selection(spark: SparkSession, d: str) -> DataFrame:
    """A store saved and loaded by a path with the ids of three methods behind it."""
    folder = _scratch(spark)
    stores.save({"dfmethod": m.methods(spark, d), "dfnode": m.nodes(spark, d)}, folder)
    loaded = stores.load_spec(spark, f"{folder}:412,977,1203", ("dfmethod", "dfnode"))
    rows = [df.agg(F.lit(name).alias("tbl"), F.count(F.lit(1)).alias("n")) for name, df in loaded.items()]
    return rows[0].unionByName(rows[1])


def _scratch(spark: SparkSession) -> str:
    """A folder for a stream's own state and results, beside the checkpoints."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def _as_folder(spark: SparkSession, d: str, name: str) -> str:
    """A path that a file stream can list: the table's folder, or the folder with a pattern for a single file."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/{name}.parquet")
    single = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isFile()
    return f"{d}/{name}.parque[t]" if single else f"{d}/{name}.parquet"


