"""Scans, projections, filters and joins over the graph stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline import model as m
from weftline.common import kept
from weftline.functions import names as fn
from weftline.operators import stitch

V = m.SQL_VIEWS
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql if "WITH" in sql.split("SELECT")[0] else V + sql
        return f

    return add


@query("SELECT nid0, nid1, label FROM links WHERE NOT starts_with(label, '_')")
def real_inputs(spark: SparkSession, d: str) -> DataFrame:
    """Links that carry data: labels that do not begin with '_'."""
    return m.links(spark, d).where(~F.col("label").startswith("_")).select("nid0", "nid1", "label")


@query("SELECT nid, mid, callee FROM calls")
def function_calls(spark: SparkSession, d: str) -> DataFrame:
    """One row per call node and callee signature."""
    return stitch.calls(m.nodes(spark, d), None)


@query("SELECT callee, count(DISTINCT nid) AS n_calls, count(DISTINCT mid) AS n_callers FROM calls GROUP BY callee")
def callers_multigraph(spark: SparkSession, d: str) -> DataFrame:
    """Calls and calling methods of each callee."""
    return stitch.calls(m.nodes(spark, d), None).groupBy("callee").agg(F.count_distinct("nid").alias("n_calls"), F.count_distinct("mid").alias("n_callers"))


@query("SELECT mid, method_id FROM methods WHERE style <> 'initializer' AND method_id NOT IN (SELECT callee FROM calls)")
def top_level_methods(spark: SparkSession, d: str) -> DataFrame:
    """Methods that nothing calls, without initialisers."""
    called = stitch.calls(m.nodes(spark, d), None).select(F.col("callee").alias("method_id")).distinct()
    return m.methods(spark, d).where("style <> 'initializer'").join(called, "method_id", "left_anti").select("mid", "method_id")


@query("""SELECT mid, CAST(count(*) FILTER (kind = 'input') AS BIGINT) AS n_in, CAST(count(*) FILTER (kind = 'output') AS BIGINT) AS n_out
    FROM nodes WHERE mid IS NOT NULL GROUP BY mid HAVING greatest(count(*) FILTER (kind = 'input'), count(*) FILTER (kind = 'output')) <= 3""")
def small_methods(spark: SparkSession, d: str) -> DataFrame:
    """Methods with at most three inputs and three outputs."""
    per = m.nodes(spark, d).where("mid is not null").groupBy("mid").agg(F.count_if(F.col("kind") == "input").alias("n_in"), F.count_if(F.col("kind") == "output").alias("n_out"))
    return per.where(F.greatest("n_in", "n_out") <= 3)


@query("SELECT nid FROM nodes WHERE nid NOT IN (SELECT nid1 FROM links)")
def terminal_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes from which nothing accepts."""
    return m.nodes(spark, d).join(m.links(spark, d).select(F.col("nid1").alias("nid")), "nid", "left_anti").select("nid")


@query(f"""SELECT CASE WHEN kind IS NULL THEN 'relay' WHEN kind IN {m.TRANSPARENT} THEN 'transparent' WHEN kind IN {m.CALL_KINDS} THEN 'call' ELSE 'value' END AS kind_class,
    count(*) AS n FROM nodes GROUP BY 1""")
def kind_classes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes by what they mean for a walk: relays, transparent kinds, calls, values."""
    k = F.col("kind")
    made = F.when(k.isNull(), "relay").when(k.isin(*m.TRANSPARENT), "transparent").when(k.isin(*m.CALL_KINDS), "call").otherwise("value")
    return m.nodes(spark, d).groupBy(made.alias("kind_class")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT ref_name, arg_max(ntype, nid) AS ntype FROM nodes WHERE left(ref_name, 1) IN ('$', '@') AND ntype IS NOT NULL GROUP BY ref_name""")
def variable_list(spark: SparkSession, d: str) -> DataFrame:
    """Distinct variables with the type seen last."""
    own = m.nodes(spark, d).where(F.left("ref_name", F.lit(1)).isin("$", "@") & F.col("ntype").isNotNull())
    return own.groupBy("ref_name").agg(F.max_by("ntype", "nid").alias("ntype"))


@query("""SELECT nid, mid, CAST(ord AS BIGINT) AS ord FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY nid) AS ord FROM nodes WHERE sid IS NOT NULL)
    WHERE kind = 'call' AND contains(ndata, 'Set;.')""")
def node_search(spark: SparkSession, d: str) -> DataFrame:
    """Nodes by kind and text, with their ordinal within the scope."""
    numbered = stitch.ordinals(m.nodes(spark, d).where("sid is not null").select("nid", "mid", "sid", "kind", "ndata"), "sid", "nid")
    return numbered.where((F.col("kind") == "call") & F.col("ndata").contains("Set;.")).select("nid", "mid", "ord")


@query("""SELECT nid0 AS nid, CAST(-row_number() OVER (PARTITION BY nid0 ORDER BY label, lid) AS BIGINT) AS step, nid1 AS other FROM links
    UNION ALL SELECT nid1, CAST(row_number() OVER (PARTITION BY nid1 ORDER BY label, lid) AS BIGINT), nid0 FROM links""")
def neighbour_steps(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours by signed ordinal: inputs negative, outputs positive."""
    ln = m.links(spark, d)
    back, forth = (stitch.ordinals(ln, end, "label", "lid") for end in ("nid0", "nid1"))
    return back.select(F.col("nid0").alias("nid"), (-F.col("ord")).alias("step"), F.col("nid1").alias("other")).unionByName(forth.select(F.col("nid1").alias("nid"), F.col("ord").alias("step"), F.col("nid0").alias("other")))


@query(f"SELECT ntype, count(*) AS n FROM nodes WHERE ntype IN {(*m.PRIMITIVES, m.STRING_TYPE)} GROUP BY ntype")
def whitelisted_types(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of the primitive types and strings."""
    return m.nodes(spark, d).where(F.col("ntype").isin(*m.PRIMITIVES, m.STRING_TYPE)).groupBy("ntype").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT tid, item FROM its WHERE item IS NOT NULL AND item NOT IN (SELECT ref_name FROM nodes WHERE kind = 'passout' AND ref_name IS NOT NULL)")
def excluded_items(spark: SparkSession, d: str) -> DataFrame:
    """Items without those of an exclusion list."""
    excluded = m.nodes(spark, d).where("kind = 'passout'").select(F.col("ref_name").alias("item"))
    return m.items(spark, d).where("item is not null").join(excluded, "item", "left_anti").select("tid", "item")


@query("SELECT tid, fid, c FROM (SELECT *, max(c) OVER (PARTITION BY tid) AS top FROM cnt) WHERE c >= floor(top * 0.5)")
def prominent_features(spark: SparkSession, d: str) -> DataFrame:
    """Features with at least half the greatest count of their item."""
    cnt = m.counts(spark, d)
    return cnt.join(cnt.groupBy("tid").agg(F.max("c").alias("top")), "tid").where(F.col("c") >= F.floor(F.col("top") * 0.5)).select("tid", "fid", "c")


@query("SELECT CASE WHEN kind IS NULL OR kind IN ('assign_var', 'ref_var') THEN NULL ELSE kind || ':' || coalesce(ndata, '') END AS node_key, count(*) AS n FROM nodes GROUP BY 1")
def structural_keys(spark: SparkSession, d: str) -> DataFrame:
    """Nodes per key of structural matching."""
    return m.nodes(spark, d).groupBy(fn.node_key(F.col("kind"), F.col("ndata")).alias("node_key")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT nid, CASE WHEN kind IS NULL THEN 'relay' WHEN kind IN ('call', 'new') THEN kind || '(' || coalesce(nullif(regexp_extract(split_part(ndata, ' ', 1), ';\\.:?([^(:]*):?\\(', 1), ''), '?') || ')'
    WHEN ref_name IS NOT NULL AND starts_with(kind, 'assign') THEN r || ' =' WHEN ref_name IS NOT NULL THEN r WHEN ndata IS NOT NULL THEN kind || ' ' || ndata ELSE kind END AS shown
    FROM (SELECT *, {m.SQL_REFERENCE.format('ref_name')} AS r FROM nodes)""")
def shown_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Display text of every node."""
    return m.nodes(spark, d).select("nid", fn.display_text(F.col("kind"), F.col("ref_name"), F.col("ndata")).alias("shown"))


@query(""", ring AS (SELECT nid AS start, nid, 0 AS dist FROM nodes WHERE kind = 'return'
      UNION ALL SELECT r.start, l.nid1, r.dist + 1 FROM ring r JOIN links l ON l.nid0 = r.nid AND NOT starts_with(l.label, '_') WHERE r.dist < 3)
    SELECT start, nid, CAST(min(dist) AS BIGINT) AS dist FROM ring GROUP BY start, nid""")
def neighbourhood(spark: SparkSession, d: str) -> DataFrame:
    """What reaches a return within three real links, with the shortest distance."""
    edges = m.links(spark, d).where(~F.col("label").startswith("_")).select(F.col("nid0").alias("nid"), "nid1")
    return stitch.within(m.nodes(spark, d).where("kind = 'return'").select("nid"), edges, 3)


# joins


@query("SELECT c.nid, c.mid, k.mid AS callee_mid FROM calls c JOIN (SELECT method_id, min(mid) AS mid FROM methods GROUP BY method_id) k ON k.method_id = c.callee")
def call_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Calls of methods that are defined."""
    return stitch.resolved(m.nodes(spark, d), m.methods(spark, d), None)


_IDF = """, k AS (SELECT method_id, min(mid) AS mid FROM methods WHERE method_id IS NOT NULL GROUP BY method_id),
    res AS (SELECT c.nid, k.mid AS callee_mid FROM (SELECT nid, split_part(ndata, ' ', 1) AS callee FROM nodes WHERE kind IN ('call', 'new') AND ndata IS NOT NULL) c JOIN k ON k.method_id = c.callee),
    named AS (SELECT mid, ref_name AS label, nid FROM nodes WHERE kind = 'input' AND mid IS NOT NULL AND ref_name IS NOT NULL),
    placed AS (SELECT mid, '#arg' || (row_number() OVER (PARTITION BY mid ORDER BY nid) - 1) AS label, nid FROM named WHERE left(label, 1) = '$'),
    ins AS (SELECT mid, label, nid FROM named UNION ALL SELECT mid, label, nid FROM placed ANTI JOIN named USING (mid, label)),
    outs AS (SELECT mid, ref_name AS wanted, nid FROM nodes WHERE kind = 'output' AND mid IS NOT NULL AND ref_name IS NOT NULL
            UNION ALL SELECT mid, '#return', nid FROM nodes WHERE kind = 'return' AND mid IS NOT NULL AND mid NOT IN (SELECT mid FROM nodes WHERE kind = 'output' AND ref_name = '#return' AND mid IS NOT NULL)),
    arg AS (SELECT l.nid1 AS src, i.nid AS dst, l.label, r.nid AS funcall FROM res r JOIN links l ON l.nid0 = r.nid JOIN ins i ON i.mid = r.callee_mid AND i.label = l.label),
    out AS (SELECT o.nid AS src, l.nid0 AS dst, l.label, r.nid AS funcall FROM res r JOIN links l ON l.nid1 = r.nid JOIN outs o ON o.mid = r.callee_mid AND o.wanted = CASE WHEN l.label = '' THEN '#return' ELSE l.label END),
    idf AS (SELECT src, dst, label, funcall, 'in' AS way FROM arg UNION ALL SELECT src, dst, label, funcall, 'out' FROM out UNION ALL SELECT nid1, nid0, label, NULL, NULL FROM links)
"""


def stitched(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst, label, funcall, way): the interprocedural graph, kept for all queries of the application."""
    return kept(spark, "stitched", d, lambda: stitch.interprocedural(m.nodes(spark, d), m.links(spark, d), m.methods(spark, d)))


@query(_IDF + "SELECT src, dst, label, funcall FROM arg")
def call_argument_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges from a call's arguments to the callee's inputs of that name."""
    return stitch.argument_edges(m.nodes(spark, d), m.links(spark, d), m.methods(spark, d))


@query(_IDF + "SELECT src, dst, label, funcall FROM out")
def call_result_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges from the callee's outputs to what accepts the call's results."""
    return stitch.result_edges(m.nodes(spark, d), m.links(spark, d), m.methods(spark, d))


@query(_IDF + "SELECT src, dst, label, funcall FROM arg UNION ALL SELECT src, dst, label, funcall FROM out")
def first_bound_call_edges(spark: SparkSession, d: str) -> DataFrame:
    """All edges of calls, by name or by position: arguments into inputs, results out of outputs or returns."""
    return stitched(spark, d).where("way is not null").select("src", "dst", "label", "funcall")


@query(_IDF + "SELECT label, (funcall IS NOT NULL) AS between_methods, count(*) AS n FROM idf GROUP BY 1, 2")
def stitched_by_label(spark: SparkSession, d: str) -> DataFrame:
    """The interprocedural graph: edges by label."""
    edges = stitched(spark, d)
    return edges.groupBy("label", F.col("funcall").isNotNull().alias("between_methods")).agg(F.count(F.lit(1)).alias("n"))


@query(_IDF + "SELECT nid, CAST(sum(i) AS BIGINT) AS n_in, CAST(sum(o) AS BIGINT) AS n_out FROM (SELECT dst AS nid, 1 AS i, 0 AS o FROM idf UNION ALL SELECT src, 0, 1 FROM idf) GROUP BY nid")
def vertex_degrees(spark: SparkSession, d: str) -> DataFrame:
    """Edges into and out of each vertex of the interprocedural graph."""
    e = stitched(spark, d)
    both = e.select(F.col("dst").alias("nid"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(e.select(F.col("src").alias("nid"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    return both.groupBy("nid").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))


@query("SELECT n.nid, n.kind, s.scope_name, k.method_id FROM nodes n LEFT JOIN scopes s USING (sid) LEFT JOIN methods k ON k.mid = n.mid")
def nodes_in_place(spark: SparkSession, d: str) -> DataFrame:
    """Every node with the name of its scope and its method, null where there is none."""
    sc, me = m.scopes(spark, d).select("sid", "scope_name"), m.methods(spark, d).select("mid", "method_id")
    return m.nodes(spark, d).join(sc, "sid", "left").join(me, "mid", "left").select("nid", "kind", "scope_name", "method_id")


@query("SELECT n.nid, n.kind, coalesce(l.inputs, '') AS inputs FROM nodes n LEFT JOIN (SELECT nid0, string_agg(label || '=' || src, ' ' ORDER BY label) AS inputs FROM (SELECT nid0, label, max(nid1) AS src FROM links GROUP BY 1, 2) GROUP BY nid0) l ON l.nid0 = n.nid")
def rehydrated_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Every node with its inputs by label; of a repeated label the greatest source stays."""
    per = m.links(spark, d).groupBy("nid0", "label").agg(F.max("nid1").alias("src"))
    text = F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("label", "src"))), lambda x: F.concat(x["label"], F.lit("="), x["src"])))
    inputs = per.groupBy(F.col("nid0").alias("nid")).agg(text.alias("inputs"))
    return m.nodes(spark, d).join(inputs, "nid", "left").select("nid", "kind", F.coalesce("inputs", F.lit("")).alias("inputs"))


@query("SELECT mid, count(*) AS n_calls, count(DISTINCT callee) AS n_callees FROM calls WHERE mid IS NOT NULL GROUP BY mid")
def calls_of_method(spark: SparkSession, d: str) -> DataFrame:
    """Calls and callees of every method."""
    return stitch.calls(m.nodes(spark, d), None).where("mid is not null").groupBy("mid").agg(F.count(F.lit(1)).alias("n_calls"), F.count_distinct("callee").alias("n_callees"))


@query("SELECT i.item, f.feat, sum(c.c)::BIGINT AS c FROM cnt c JOIN its i USING (tid) JOIN fts f USING (fid) WHERE i.item IS NOT NULL GROUP BY 1, 2")
def item_features(spark: SparkSession, d: str) -> DataFrame:
    """The feature store resolved to names."""
    return m.counts(spark, d).join(m.items(spark, d).where("item is not null"), "tid").join(m.feats(spark, d), "fid").groupBy("item", "feat").agg(F.sum("c").alias("c"))


@query("SELECT i.sid0 AS source_pos, i.tid, i.fid, count(p.sid0) AS n_spans, count(DISTINCT p.fid) AS n_feats FROM ifs i LEFT JOIN ifs p ON p.sid0 BETWEEN i.sid0 AND i.sid1 WHERE i.sid1 >= i.sid0 GROUP BY 1, 2, 3")
def source_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Item features with the stored positions that lie in their range of sources, and their features: a range join over bins."""
    rows = m.itemfeats(spark, d)
    hits = stitch.points_in_ranges(rows.select(F.col("sid0").alias("at"), F.col("fid").alias("found")), rows.where("sid1 >= sid0").select("sid0", "sid1", "tid", "fid"), "at", "sid0", "sid1")
    return hits.groupBy(F.col("sid0").alias("source_pos"), "tid", "fid").agg(F.count("at").alias("n_spans"), F.count_distinct("found").alias("n_feats"))


@query("""SELECT n.nid, s.sid FROM nodes n JOIN (SELECT sid, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b FROM (SELECT sid, regexp_extract(scope_name, ':(\\d+):(\\d+)$', 1) AS a, regexp_extract(scope_name, ':(\\d+):(\\d+)$', 2) AS b FROM scopes) WHERE a <> '') s
    USING (sid) WHERE n.ast_start < s.b AND s.a < n.ast_end""")
def spans_in_scope(spark: SparkSession, d: str) -> DataFrame:
    """Nodes whose span overlaps the span of their scope."""
    at = lambda g: F.regexp_extract("scope_name", ":(\\d+):(\\d+)$", g)
    sc = m.scopes(spark, d).select("sid", at(1).alias("a"), at(2).alias("b")).where("a <> ''").select("sid", F.col("a").cast("long"), F.col("b").cast("long"))
    return m.nodes(spark, d).join(sc, "sid").where("ast_start < b and a < ast_end").select("nid", "sid")


@query("""SELECT e.event_id, max(p.event_id) AS before_id, min(s.event_id) AS after_id FROM events e
    LEFT JOIN events p ON p.user_id = e.user_id AND p.event_type = 'view' AND p.event_id < e.event_id LEFT JOIN events s ON s.user_id = e.user_id AND s.event_type = 'view' AND s.event_id > e.event_id
    WHERE e.event_type = 'error' GROUP BY e.event_id""".replace("SELECT e.event_id", "SELECT e.event_id", 1))
def nearest_before_after(spark: SparkSession, d: str) -> DataFrame:
    """As-of join in both directions: the user's views around each error."""
    ev = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", "event_type")
    return stitch.nearest(ev.where("event_type = 'error'").select("event_id", "user_id"), ev.where("event_type = 'view'").select("event_id", "user_id"), "user_id", "event_id")


@query("""SELECT nid, coalesce(c.category, 'other') AS category FROM calls LEFT JOIN (VALUES ('load', 'path'), ('open', 'url'), ('query', 'sql'), ('send', 'host'), ('fetch', 'port')) c(verb, category)
    ON c.verb = regexp_extract(regexp_extract(callee, ';\\.:?([^(:]*):?\\(', 1), '^[a-z]+', 0)""")
def call_categories(spark: SparkSession, d: str) -> DataFrame:
    """Calls looked up in a table of categories, 'other' where it has none."""
    known = spark.createDataFrame([("load", "path"), ("open", "url"), ("query", "sql"), ("send", "host"), ("fetch", "port")], "verb string, category string")
    verb = F.regexp_extract(fn.method_simple_name(F.col("callee")), "^[a-z]+", 0)
    return stitch.calls(m.nodes(spark, d), None).withColumn("verb", verb).join(F.broadcast(known), "verb", "left").select("nid", F.coalesce("category", F.lit("other")).alias("category"))


@query("""SELECT fid, w AS word, min(tid) AS first_tid FROM (SELECT c.fid, c.tid, unnest(list_distinct(regexp_extract_all(lower(regexp_extract(item, '(\\w+);?$', 1)), '[a-z]+'))) AS w FROM cnt c JOIN its i USING (tid) WHERE item IS NOT NULL) GROUP BY 1, 2""")
def first_supporter(spark: SparkSession, d: str) -> DataFrame:
    """For each feature and name word, the first item that has both."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.regexp_extract("item", "(\\w+);?$", 1)), F.lit("[a-z]+"), F.lit(0)))
    named = m.items(spark, d).where("item is not null").select("tid", F.explode(words).alias("word"))
    return m.counts(spark, d).join(named, "tid").groupBy("fid", "word").agg(F.min("tid").alias("first_tid"))


@query("SELECT tid FROM its WHERE nullif(regexp_extract(item, '([A-Za-z0-9_]+);?$', 1), '') IN (SELECT nullif(regexp_extract(regexp_replace(ref_name, '^%\\[*', ''), '([A-Za-z0-9_]+);?$', 1), '') FROM nodes WHERE kind = 'input' AND ref_name IS NOT NULL) INTERSECT SELECT tid FROM cnt WHERE c >= 3")
def items_in_both(spark: SparkSession, d: str) -> DataFrame:
    """Items named like an input of a method that also have a strong feature."""
    inputs = m.nodes(spark, d).where("kind = 'input'").select(fn.strip_id(F.col("ref_name")).alias("name"))
    named = m.items(spark, d).select("tid", fn.strip_id(F.col("item")).alias("name"))
    return named.join(inputs, "name", "left_semi").select("tid").intersect(m.counts(spark, d).where("c >= 3").select("tid"))


@query("SELECT ref_name FROM nodes WHERE kind = 'ref_var' AND ref_name IS NOT NULL EXCEPT SELECT ref_name FROM nodes WHERE kind = 'assign_var'")
def never_assigned(spark: SparkSession, d: str) -> DataFrame:
    """Variables that are read and never assigned."""
    n = m.nodes(spark, d).where("ref_name is not null")
    return n.where("kind = 'ref_var'").select("ref_name").subtract(n.where("kind = 'assign_var'").select("ref_name"))


@query("SELECT uid, 'https://' || coalesce(reponame, '?') || '/blob/' || coalesce(commitid, branchname, 'HEAD') || '/' || srcpath AS url FROM srcs")
def source_urls(spark: SparkSession, d: str) -> DataFrame:
    """Address of every source file in its repository."""
    return m.sources(spark, d).select("uid", F.concat(F.lit("https://"), F.coalesce("reponame", F.lit("?")), F.lit("/blob/"), F.coalesce("commitid", "branchname", F.lit("HEAD")), F.lit("/"), "srcpath").alias("url"))


@query("SELECT uid, srcpath FROM srcs WHERE lower(srcpath) LIKE '%.java'")
def java_files(spark: SparkSession, d: str) -> DataFrame:
    """Discovery of Java sources."""
    return m.sources(spark, d).where(F.lower("srcpath").endswith(".java")).select("uid", "srcpath")


@query("SELECT mid, method_id, (SELECT count(*) FROM nodes n WHERE n.mid = k.mid) AS n_nodes FROM methods k WHERE method_name = 'fill'")
def methods_by_name(spark: SparkSession, d: str) -> DataFrame:
    """Point look-up of methods by name, with their size."""
    own = m.methods(spark, d).where("method_name = 'fill'")
    sizes = m.nodes(spark, d).join(own.select("mid"), "mid", "left_semi").groupBy("mid").agg(F.count(F.lit(1)).alias("n_nodes"))
    return own.join(sizes, "mid", "left").select("mid", "method_id", F.coalesce("n_nodes", F.lit(0)).alias("n_nodes"))
