"""Graph queries: components, levels, main paths, call paths, flows with contexts, path index and search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline import model as m
from weftline.common import cut, kept
from weftline.functions import names as fn
from weftline.operators import bayes, graph, stitch
from weftline.plans import words

V = m.SQL_VIEWS
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = V + sql
        return f

    return add


def call_graph(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst): caller and callee, of the calls that resolve."""
    at = stitch.resolved(m.nodes(spark, d), m.methods(spark, d), None).where("mid is not null")
    return at.select(F.col("mid").alias("src"), F.col("callee_mid").alias("dst")).distinct()


_CG = """, k AS (SELECT method_id, min(mid) AS mid FROM methods WHERE method_id IS NOT NULL GROUP BY method_id),
    cg AS (SELECT DISTINCT c.mid AS src, k.mid AS dst FROM calls c JOIN k ON k.method_id = c.callee WHERE c.mid IS NOT NULL),
    vx AS (SELECT src AS node FROM cg UNION SELECT dst FROM cg),
    reach AS (SELECT src AS a, dst AS b FROM cg UNION SELECT r.a, cg.dst FROM reach r JOIN cg ON r.b = cg.src),
    scc AS (SELECT node, least(node, coalesce((SELECT min(r.b) FROM reach r JOIN reach s ON s.a = r.b AND s.b = r.a WHERE r.a = node), node)) AS cid FROM vx),
    dag AS (SELECT DISTINCT x.cid AS src, y.cid AS dst FROM cg JOIN scc x ON x.node = cg.src JOIN scc y ON y.node = cg.dst WHERE x.cid <> y.cid)"""


@query(_CG + " SELECT node, cid FROM scc")
def call_components(spark: SparkSession, d: str) -> DataFrame:
    """Strongly connected components of the call graph."""
    return graph.strong_components(call_graph(spark, d))


@query(_CG + " SELECT src, dst FROM dag")
def call_condensation(spark: SparkSession, d: str) -> DataFrame:
    """Edges between the components of the call graph."""
    e = cut(call_graph(spark, d))
    return graph.condensed(e, graph.strong_components(e))


@query(_CG + """, lv AS (SELECT node, 0 AS lv FROM (SELECT src AS node FROM dag UNION SELECT dst FROM dag) WHERE node NOT IN (SELECT dst FROM dag) UNION SELECT dag.dst, lv + 1 FROM lv JOIN dag ON dag.src = lv.node)
    SELECT node, CAST(max(lv) AS BIGINT) AS level FROM lv GROUP BY node""")
def call_levels(spark: SparkSession, d: str) -> DataFrame:
    """Topological levels of the call graph's components."""
    e = cut(call_graph(spark, d))
    return graph.topological_levels(graph.condensed(e, graph.strong_components(e)))


_WEIGHTS = _CG + """, ways AS (SELECT node AS start, node FROM (SELECT src AS node FROM dag UNION SELECT dst FROM dag) WHERE node NOT IN (SELECT dst FROM dag) UNION ALL SELECT w.start, dag.dst FROM ways w JOIN dag ON dag.src = w.node),
    inc AS (SELECT node, count(*) AS n FROM ways GROUP BY node),
    yaws AS (SELECT node AS start, node FROM (SELECT src AS node FROM dag UNION SELECT dst FROM dag) WHERE node NOT IN (SELECT src FROM dag) UNION ALL SELECT w.start, dag.src FROM yaws w JOIN dag ON dag.dst = w.node),
    outg AS (SELECT node, count(*) AS n FROM yaws GROUP BY node),
    wt AS (SELECT src, dst, CAST(i.n + o.n AS DOUBLE) AS weight FROM dag JOIN inc i ON i.node = src JOIN outg o ON o.node = dst)"""


@query(_WEIGHTS + " SELECT src, dst, weight FROM wt")
def path_weights(spark: SparkSession, d: str) -> DataFrame:
    """Paths through every edge of the condensed call graph."""
    e = cut(call_graph(spark, d))
    return graph.path_weights(graph.condensed(e, graph.strong_components(e)))


@query(_WEIGHTS + """, r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS f, row_number() OVER (PARTITION BY dst ORDER BY weight DESC, src) AS b FROM wt),
    k0 AS (SELECT src, dst, weight FROM wt WHERE weight >= 0.9 * (SELECT max(weight) FROM wt)),
    kf AS (SELECT src, dst, weight FROM k0 UNION SELECT r.src, r.dst, r.weight FROM kf JOIN r ON r.src = kf.dst AND r.f <= 5),
    kb AS (SELECT src, dst, weight FROM k0 UNION SELECT r.src, r.dst, r.weight FROM kb JOIN r ON r.dst = kb.src AND r.b <= 5)
    SELECT src, dst, weight FROM kf UNION SELECT src, dst, weight FROM kb""")
def main_paths(spark: SparkSession, d: str) -> DataFrame:
    """Main paths of the condensed call graph."""
    e = cut(call_graph(spark, d))
    return graph.main_paths(graph.condensed(e, graph.strong_components(e)))


@query(_CG + """, und AS (SELECT src AS a, dst AS b FROM cg UNION SELECT dst, src FROM cg), cc AS (SELECT node AS a, node AS b FROM vx UNION SELECT cc.a, und.b FROM cc JOIN und ON und.a = cc.b)
    SELECT a AS node, min(b) AS cid FROM cc GROUP BY a""")
def call_islands(spark: SparkSession, d: str) -> DataFrame:
    """Connected components of the call graph, whatever its directions."""
    return graph.components(call_graph(spark, d))


@query(words._VSM.replace("SELECT a, b, round(dot", ", pairs AS (SELECT a, b, round(dot", 1) + "), und AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), cc AS (SELECT a, a AS b FROM und UNION SELECT cc.a, und.b FROM cc JOIN und ON und.a = cc.b) SELECT a AS node, min(b) AS cid FROM cc GROUP BY a")
def item_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups of similar items: components of the pairs above the threshold."""
    return bayes.cosine_groups(words.weighed_items(spark, d), 0.7)


@query(_CG + """, pth AS (SELECT node, [node] AS path, 0 AS len FROM vx WHERE node NOT IN (SELECT dst FROM cg) UNION ALL SELECT cg.dst, list_append(path, cg.dst), len + 1 FROM pth JOIN cg ON cg.src = pth.node AND NOT list_contains(path, cg.dst))
    SELECT array_to_string(path, '>') AS path, CAST(len AS BIGINT) AS len FROM pth""")
def call_paths(spark: SparkSession, d: str) -> DataFrame:
    """All call paths from methods that nothing calls, however deep, without repetition."""
    e = cut(call_graph(spark, d))
    roots = e.select(F.col("src").alias("node")).distinct().join(e.select(F.col("dst").alias("node")), "node", "left_anti")
    return graph.simple_paths(roots, e).select(F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), "len")


_TREE = """, ways AS (SELECT node AS root, node, [node] AS path FROM (SELECT src AS node FROM dag UNION SELECT dst FROM dag) WHERE node NOT IN (SELECT dst FROM dag)
      UNION ALL SELECT w.root, dag.dst, list_append(w.path, dag.dst) FROM ways w JOIN dag ON dag.src = w.node),
    fst AS (SELECT root, node, min(path) AS path FROM ways GROUP BY root, node)"""


def tree_lines(lines: DataFrame) -> DataFrame:
    """(root, path, shown, repeated) of the lines of ``graph.summary_tree``: indented, with dots where shown before."""
    depth = F.size("path") - 1
    text = F.concat(F.repeat(F.lit("  "), depth), F.element_at("path", F.lit(-1)).cast("string"), F.when(F.col("repeated"), " ...").otherwise(""))
    return lines.select("root", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), text.alias("shown"), "repeated")


_TREE_LINES = """ SELECT root, array_to_string(path, '>') AS path, repeat('  ', len(path) - 1) || list_last(path) || CASE WHEN repeated THEN ' ...' ELSE '' END AS shown, repeated FROM (
      SELECT root, path, false AS repeated FROM fst WHERE node = root
      UNION ALL SELECT f.root, list_append(f.path, dag.dst), list_append(f.path, dag.dst) <> g.path FROM fst f JOIN dag ON dag.src = f.node JOIN fst g ON g.root = f.root AND g.node = dag.dst)"""


@query(_CG + _TREE + _TREE_LINES)
def call_tree(spark: SparkSession, d: str) -> DataFrame:
    """The call summary: trees of the components of the call graph, below those that nothing calls; what was shown is not shown again."""
    e = cut(call_graph(spark, d))
    return tree_lines(graph.summary_tree(graph.condensed(e, graph.strong_components(e))))


@query(_CG + """, own AS (SELECT DISTINCT mid, ref_name AS ref FROM nodes WHERE kind IN ('passin', 'passout', 'input', 'output') AND left(ref_name, 1) IN ('.', '@') AND mid IS NOT NULL)
    SELECT DISTINCT r.a AS mid, o.ref FROM reach r JOIN own o ON o.mid = r.b EXCEPT SELECT mid, ref FROM own""")
def passed_references(spark: SparkSession, d: str) -> DataFrame:
    """Fields and objects that only a method's callees use."""
    own = m.nodes(spark, d).where("kind in ('passin', 'passout', 'input', 'output') and left(ref_name, 1) in ('.', '@')").select("mid", F.col("ref_name").alias("ref"))
    e = call_graph(spark, d).toDF("mid", "callee_mid")
    return graph.passed_through(e, own)


_KEY = "CASE WHEN kind IS NULL OR kind IN ('assign_var', 'ref_var') THEN NULL ELSE kind || ':' || coalesce(ndata, '') END"
_INDEX = f""", kn AS (SELECT nid, mid, {_KEY} AS key FROM nodes), real AS (SELECT DISTINCT nid0, label, nid1 FROM links WHERE NOT starts_with(label, '_')),
    fr AS (SELECT r.nid0 AS nid, r.label, r.nid1 AS src FROM real r JOIN kn ON kn.nid = r.nid0 AND kn.key IS NOT NULL UNION SELECT f.nid, f.label, r.nid1 FROM fr f JOIN kn ON kn.nid = f.src AND kn.key IS NULL JOIN real r ON r.nid0 = f.src),
    stp AS (SELECT DISTINCT f.nid, f.label, f.src FROM fr f JOIN kn ON kn.nid = f.src AND kn.key IS NOT NULL),
    chn AS (SELECT ':' || key AS path, 1 AS size, mid, nid, [nid] AS way FROM kn WHERE key IS NOT NULL UNION ALL SELECT i.path || '/' || s.label || ':' || k2.key, i.size + 1, k2.mid, s.src, list_append(i.way, s.src) FROM chn i JOIN stp s ON s.nid = i.nid AND NOT list_contains(i.way, s.src) JOIN kn k2 ON k2.nid = s.src),
    ix AS (SELECT DISTINCT path, size, mid, nid FROM chn)"""


def _index(spark: SparkSession, d: str) -> DataFrame:
    keyed = m.nodes(spark, d).select("nid", "mid", fn.node_key(F.col("kind"), F.col("ndata")).alias("key"))
    return kept(spark, "path_index", d, lambda: graph.path_index(cut(keyed), m.links(spark, d)))


@query(_INDEX + " SELECT path, CAST(size AS BIGINT) AS size, count(DISTINCT mid) AS n_methods, count(*) AS n_nodes FROM ix WHERE mid IS NOT NULL GROUP BY path, size")
def path_index(spark: SparkSession, d: str) -> DataFrame:
    """The index of key paths: methods and nodes of each path."""
    return _index(spark, d).groupBy("path", "size").agg(F.count_distinct("mid").alias("n_methods"), F.count(F.lit(1)).alias("n_nodes"))


@query(_INDEX + """ SELECT q.mid AS qmid, x.mid, count(DISTINCT q.nid) AS n_query, count(DISTINCT x.nid) AS n_found, CAST(max(q.size) AS BIGINT) AS depth FROM ix q JOIN ix x ON x.path = q.path AND x.size = q.size AND x.mid <> q.mid
    WHERE q.mid % 20 = 0 AND q.size >= 2 GROUP BY 1, 2 HAVING count(DISTINCT q.nid) >= 2 AND count(DISTINCT x.nid) >= 2 AND max(q.size) >= 2""")
def path_search(spark: SparkSession, d: str) -> DataFrame:
    """Methods alike in shape to those whose id is divisible by 20, by shared key paths."""
    ix = _index(spark, d)
    return graph.path_votes(ix.where("mid % 20 = 0"), ix, 2, 2)


@query("""SELECT regexp_extract(c.ndata, ';\\.:?([^(:]*):?\\(', 1) AS callee, l.label, coalesce(a.kind, 'relay') AS feat1, coalesce(b.kind, '') AS feat2, count(*) AS n FROM nodes c JOIN links l ON l.nid0 = c.nid AND starts_with(l.label, '#arg') JOIN nodes a ON a.nid = l.nid1 LEFT JOIN links k ON k.nid0 = a.nid AND NOT starts_with(k.label, '_') LEFT JOIN nodes b ON b.nid = k.nid1
    WHERE c.kind = 'call' AND c.ndata IS NOT NULL GROUP BY 1, 2, 3, 4""")
def argument_features(spark: SparkSession, d: str) -> DataFrame:
    """What arguments of calls are made of, two steps back."""
    n, ln = m.nodes(spark, d), m.links(spark, d)
    kinds = n.select("nid", "kind")
    called = n.where("kind = 'call' and ndata is not null").select(F.col("nid").alias("nid0"), F.coalesce(fn.method_simple_name(F.col("ndata")), F.lit("")).alias("callee"))
    one = ln.where(F.col("label").startswith("#arg")).join(called, "nid0").join(kinds.toDF("nid1", "k1"), "nid1").select("callee", "label", "k1", F.col("nid1").alias("nid0"))
    back = ln.where(~F.col("label").startswith("_")).select("nid0", F.col("nid1").alias("far")).join(kinds.toDF("far", "k2"), "far", "left")
    two = one.join(back, "nid0", "left")
    return two.groupBy("callee", "label", F.coalesce("k1", F.lit("relay")).alias("feat1"), F.coalesce("k2", F.lit("")).alias("feat2")).agg(F.count(F.lit(1)).alias("n"))


def prefix_weights(spark: SparkSession, d: str) -> DataFrame:
    """(fid, p, w): the prefixes of every feature path, with the summed rarity of their parts."""
    paths = m.feats(spark, d).where("feat like '%,%,%'").select("fid", F.split(F.split_part("feat", F.lit(","), F.lit(3)), ":").alias("parts"))
    freq = paths.select(F.explode("parts").alias("part")).groupBy("part").agg(F.count(F.lit(1)).alias("pn"))
    total = freq.agg(F.sum("pn")).first()[0] or 1
    rare = freq.select("part", F.log(F.lit(float(total)) / F.col("pn")).alias("r"))
    each = paths.select("fid", "parts", F.posexplode("parts").alias("k", "part")).join(rare, "part")
    weights = each.groupBy("fid", "parts").agg(F.array_sort(F.collect_list(F.struct("k", "r"))).alias("rs"))
    upto = weights.select("fid", "parts", F.posexplode("rs").alias("k", "_"), "rs")
    return upto.select("fid", F.array_join(F.slice("parts", F.lit(1), F.col("k") + 1), ":").alias("p"), F.aggregate(F.slice("rs", F.lit(1), F.col("k") + 1), F.lit(0.0), lambda s, x: s + x["r"]).alias("w"))


@query("""SELECT p AS prefix, CAST(n_items AS BIGINT) AS n_items, round(w, 6) AS weight FROM (SELECT prefix AS p, count(DISTINCT tid) AS n_items, max(w) AS w FROM (SELECT c.tid, array_to_string(parts[1:k], ':') AS prefix, sum(ln(tot::DOUBLE / pn)) OVER (PARTITION BY c.tid, c.fid ORDER BY k) AS w
    FROM (SELECT tid, fid, parts, unnest(range(1, len(parts) + 1)) AS k FROM cnt JOIN (SELECT fid, string_split(split_part(feat, ',', 3), ':') AS parts FROM fts WHERE feat LIKE '%,%,%') USING (fid)) c JOIN (SELECT part, count(*) AS pn, sum(count(*)) OVER () AS tot FROM (SELECT unnest(string_split(split_part(feat, ',', 3), ':')) AS part FROM fts WHERE feat LIKE '%,%,%') GROUP BY part) q ON q.part = parts[k]) GROUP BY prefix) WHERE n_items >= 2""")
def prefix_tree(spark: SparkSession, d: str) -> DataFrame:
    """Prefixes of feature paths with the items below them; the weight sums the rarity of the parts."""
    pre = prefix_weights(spark, d)
    found = m.counts(spark, d).join(pre, "fid").groupBy("p").agg(F.count_distinct("tid").alias("n_items"), F.max("w").alias("w")).where("n_items >= 2")
    return found.select(F.col("p").alias("prefix"), "n_items", F.round("w", 6).alias("weight"))


@query(SQL["main_paths"].replace(V, "", 1).replace("SELECT src, dst, weight FROM kf UNION SELECT src, dst, weight FROM kb", "SELECT 'N' || src || ' -> N' || dst || ' [weight=' || CAST(weight AS BIGINT) || '];' AS line FROM (SELECT src, dst, weight FROM kf UNION SELECT src, dst, weight FROM kb)"))
def main_path_dot(spark: SparkSession, d: str) -> DataFrame:
    """GraphViz lines of the main paths."""
    return main_paths(spark, d).select(F.concat(F.lit("N"), F.col("src"), F.lit(" -> N"), F.col("dst"), F.lit(" [weight="), F.col("weight").cast("long"), F.lit("];")).alias("line"))


