"""Queries that walk over the interprocedural graph: chains, features, flows, orders of calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline import model as m
from weftline.common import cut, kept
from weftline.functions import names as fn
from weftline.operators import graph, stitch, walks
from weftline.plans import graphs, scans

V = m.SQL_VIEWS
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = V + sql
        return f

    return add


def _in(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_REFS, _ASSIGNS = _in(walks.REFS), _in(walks.ASSIGNS)
_NAME = "coalesce(nullif(regexp_extract(split_part(ndata, ' ', 1), ';\\.:?([^(:]*):?\\(', 1), ''), '?')"
_CLASS = "coalesce(" + m.SQL_SIMPLE.format("nullif(regexp_extract(split_part(ndata, ' ', 1), '^(.*?;)\\.', 1), '')") + ", '?')"
_TYPE = "coalesce(" + m.SQL_SIMPLE.format("ndata") + ", ndata, '?')"
#: Features of nodes in chains, and the steps with their alternatives.
_STEPS = scans._IDF + f""", nf AS (SELECT nid, kind, ref_name,
      CASE WHEN kind IS NULL OR kind IN {_in(walks.PLAIN)} OR (kind = 'op_assign' AND coalesce(ndata = '=', false)) THEN NULL WHEN kind = 'call' THEN 'call,' || {_NAME} WHEN kind = 'new' THEN 'new,' || {_CLASS}
        WHEN kind IN {_in(walks.TYPE_OPERATIONS)} THEN kind || ',' || {_TYPE} WHEN ndata IS NULL THEN kind ELSE kind || ',' || ndata END AS f,
      CASE WHEN kind IN ('call', 'new') THEN kind || ',' || {_NAME} WHEN kind IN {_in(walks.REFS + walks.ASSIGNS)} THEN kind || ',' || coalesce({m.SQL_REFERENCE.format('ref_name')}, '?')
        WHEN kind = 'value' AND ntype = '{m.STRING_TYPE}' THEN 'value,STRING' WHEN kind IN {_in(walks.TYPE_OPERATIONS)} THEN kind || ',' || {_TYPE} WHEN kind IN ('op_infix', 'value') THEN kind || ',' || coalesce(ndata, 'None') END AS g FROM nodes),
    stp AS (SELECT DISTINCT e.src AS nid, e.label, e.dst, n.kind, n.ref_name AS to_ref, n.f FROM idf e JOIN nf n ON n.nid = e.dst
      WHERE NOT starts_with(e.label, '_') AND NOT (coalesce(n.kind, '') IN {_in(walks.ENTERED)} AND NOT starts_with(e.label, '#arg'))),
    wid AS (SELECT DISTINCT l.nid0 AS dst, l.label AS k, l.nid1 AS other, l.label || ',' || s.g AS g FROM links l JOIN nf w ON w.nid = l.nid0 AND w.kind IN {_in(walks.WIDENED)} AND w.f IS NOT NULL JOIN nf s ON s.nid = l.nid1 AND s.g IS NOT NULL
      WHERE NOT starts_with(l.label, '_') AND NOT (w.kind IN {_in(walks.ENTERED)} AND NOT starts_with(l.label, '#arg'))),
    alt AS (SELECT nid, label, dst, kind, to_ref, CASE WHEN f IS NULL THEN NULL ELSE label || ',' || f END AS feat FROM stp
      UNION ALL SELECT s.nid, s.label, s.dst, s.kind, s.to_ref, s.label || ',' || s.f || '|' || w.g FROM stp s JOIN wid w ON w.dst = s.dst AND w.other <> s.nid AND w.k <> s.label WHERE s.f IS NOT NULL)"""
_STARTS = f"SELECT nid, ref_name AS from_ref FROM nodes WHERE kind IN {_REFS} AND left(ref_name, 1) NOT IN ('#', '%', '!', '@') AND ref_name <> ''"
_HIT = f"coalesce(kind IN {_ASSIGNS}, false)"
_VAR = "to_ref IS NOT NULL AND to_ref <> '' AND left(to_ref, 1) NOT IN ('#', '%', '!', '@')"


def _steps(spark: SparkSession, d: str) -> DataFrame:
    return kept(spark, "chain_steps", d, lambda: walks.chain_steps(scans.stitched(spark, d), m.nodes(spark, d), m.links(spark, d)))


def _readings(spark: SparkSession, d: str, without: str = "#%!@") -> DataFrame:
    own = F.col("kind").isin(*walks.REFS) & walks.is_variable(F.col("ref_name"), without)
    return m.nodes(spark, d).where(own).select("nid", F.col("ref_name").alias("from_ref"))


@query(_STEPS + f""", ch AS (SELECT nid, from_ref, 1 AS len, false AS hit, CAST(NULL AS VARCHAR) AS to_ref FROM ({_STARTS}) UNION ALL SELECT s.dst, c.from_ref, c.len + 1, {_HIT.replace('kind', 's.kind')}, s.to_ref FROM ch c JOIN stp s ON s.nid = c.nid WHERE NOT c.hit AND c.len < 8)
    SELECT from_ref, to_ref, count(*) AS n_chains, CAST(min(len) AS BIGINT) AS shortest FROM ch WHERE hit AND {_VAR} AND from_ref <> to_ref GROUP BY 1, 2""")
def variable_flows(spark: SparkSession, d: str) -> DataFrame:
    """Chains from the reading of a variable to the next assignment over all methods, up to eight nodes long."""
    chains = walks.variable_chains(_steps(spark, d), _readings(spark, d), 8)
    return chains.groupBy("from_ref", "to_ref").agg(F.sum("n").alias("n_chains"), F.min("n_nodes").alias("shortest"))


@query(_STEPS + f""", ch AS (SELECT nid, from_ref, 1 AS len, false AS hit, CAST(NULL AS VARCHAR) AS to_ref, CAST([] AS VARCHAR[]) AS key FROM ({_STARTS})
      UNION ALL SELECT s.dst, c.from_ref, c.len + 1, {_HIT.replace('kind', 's.kind')}, s.to_ref, CASE WHEN s.feat IS NULL THEN c.key ELSE list_append(c.key, s.feat) END FROM ch c JOIN alt s ON s.nid = c.nid WHERE NOT c.hit AND c.len < 8)
    SELECT from_ref, to_ref, array_to_string(key, ' ') AS chain_key, count(*) AS n FROM ch WHERE hit AND {_VAR} AND from_ref <> to_ref AND len(key) >= 2 GROUP BY 1, 2, 3""")
def chain_keys(spark: SparkSession, d: str) -> DataFrame:
    """The same chains by every combination of their steps' alternative features, for keys of two features or more."""
    return walks.chain_keys(_steps(spark, d), _readings(spark, d), 8, 2)


@query(_STEPS + f""", nw AS (SELECT nid, ref_name AS from_ref, [nid] AS way, CAST([] AS VARCHAR[]) AS key, false AS hit, CAST(NULL AS VARCHAR) AS to_ref FROM nodes WHERE kind IN {_REFS} AND left(ref_name, 1) NOT IN ('#', '%') AND ref_name <> ''
      UNION ALL SELECT s.dst, c.from_ref, list_append(c.way, s.dst), CASE WHEN s.feat IS NULL THEN c.key ELSE list_append(c.key, s.feat) END, {_HIT.replace('kind', 's.kind')} AND coalesce(s.to_ref <> '' AND left(s.to_ref, 1) NOT IN ('#', '%'), false), s.to_ref
        FROM nw c JOIN alt s ON s.nid = c.nid WHERE len(c.key) < 5 AND NOT list_contains(c.way, s.dst)),
    np AS (SELECT from_ref, to_ref, array_to_string(key, ' ') AS chain_key FROM nw WHERE hit AND len(key) > 0 AND from_ref <> to_ref),
    gr AS (SELECT chain_key FROM np GROUP BY 1 HAVING count(*) >= 2)
    SELECT chain_key, x AS from_noun, y AS to_noun, count(*) AS n FROM (SELECT chain_key, lower(nullif(regexp_extract(regexp_extract(from_ref, '([A-Za-z0-9_]+);?$', 1), '([A-Z]?[a-z]+|[A-Z]+)$', 1), '')) AS x, lower(nullif(regexp_extract(regexp_extract(to_ref, '([A-Za-z0-9_]+);?$', 1), '([A-Z]?[a-z]+|[A-Z]+)$', 1), '')) AS y FROM np JOIN gr USING (chain_key)) WHERE x <> y GROUP BY 1, 2, 3""")
def noun_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of head nouns that the same features lead from and to, for keys of two ways or more with up to five features."""
    ways = cut(walks.noun_chains(_steps(spark, d), _readings(spark, d, "#%"), 5))
    shared = ways.groupBy("chain_key").agg(F.sum("n").alias("all")).where("all >= 2").select("chain_key")
    noun = lambda c: fn.head_noun(fn.strip_id(F.col(c)))
    named = ways.join(shared, "chain_key").select("chain_key", noun("from_ref").alias("from_noun"), noun("to_ref").alias("to_noun"), "n")
    return named.where("from_noun <> to_noun").groupBy("chain_key", "from_noun", "to_noun").agg(F.sum("n").alias("n"))


_ALL_REFS = _in(walks.REFS + walks.ASSIGNS + walks.ARRAYS)
_SPLIT = "list_transform(regexp_extract_all(reverse({}), '[0-9]*[a-z]+[A-Z]?|[0-9]*[A-Z]+'), lambda w: lower(reverse(w)))"
_TYPE_WORDS = "CASE WHEN starts_with(regexp_replace({0}, '^\\[+', ''), 'L') THEN list_transform(" + _SPLIT.format("split_part(regexp_replace(regexp_replace({0}, '^\\[+', ''), '^L|;$', '', 'g'), '<', 1)") + ", lambda w: regexp_extract({0}, '^(\\[*)', 1) || 'L' || w) ELSE [{0}] END"
_FEATURES = scans._IDF + f""", ft AS (SELECT nid, kind, ref_name,
      coalesce(CASE WHEN kind IN ('call', 'new') THEN list_transform({_SPLIT.format("nullif(regexp_extract(split_part(ndata, ' ', 1), ';\\.:?([^(:]*):?\\(', 1), '')")}, lambda w: kind || ':' || w)
        WHEN kind IN {_ALL_REFS} AND NOT starts_with(coalesce(ref_name, ''), '%') THEN list_transform({_SPLIT.format("nullif(regexp_extract(ref_name, '([A-Za-z0-9_]+);?$', 1), '')")}, lambda w: kind || ':' || w) END, CAST([] AS VARCHAR[])) AS ws,
      coalesce(CASE WHEN kind IN ('call', 'new') THEN [] WHEN kind IN {_ALL_REFS} AND starts_with(ref_name, '%') THEN list_transform({_TYPE_WORDS.format("substr(ref_name, 2)")}, lambda w: kind || ':%' || w) WHEN kind IN {_ALL_REFS} THEN []
        WHEN kind IN {_in(walks.CONDITIONS)} THEN [kind] WHEN kind = 'value' AND coalesce(ntype = '{m.STRING_TYPE}', false) THEN ['value:STRING'] WHEN kind IN {_in(walks.TYPE_OPERATIONS)} AND ndata IS NOT NULL THEN list_transform({_TYPE_WORDS.format("ndata")}, lambda w: kind || ':' || w)
        WHEN ndata IS NULL THEN [coalesce(kind, '')] ELSE [coalesce(kind || ':', '') || ndata] END, CAST([] AS VARCHAR[])) AS fs FROM nodes),
    wst AS (SELECT DISTINCT e.way AS way, e.nid, e.far, CASE WHEN left(e.label, 1) IN ('@', '%') THEN '' ELSE e.label END AS label, e.funcall, e.via FROM (SELECT -1 AS way, dst AS nid, src AS far, label, funcall, way AS via FROM idf UNION ALL SELECT 1, src, dst, label, funcall, way FROM idf) e JOIN ft o ON o.nid = e.nid
      WHERE (NOT starts_with(e.label, '_') OR e.label = '_end') AND NOT (e.label = '' AND ((e.way = -1 AND coalesce(o.kind, '') = 'ref_array') OR (e.way = 1 AND coalesce(o.kind, '') = 'assign_array')))),
    wk AS (SELECT ref_name AS item, nid AS root, nid, way, CAST(NULL AS VARCHAR) AS lprev, CAST('' AS VARCHAR) AS fprev, 0 AS dist, CAST([] AS BIGINT[]) AS calls, 49 AS lft, CAST(NULL AS VARCHAR) AS feat FROM nodes, (VALUES (-1), (1)) t(way) WHERE kind IN {_ALL_REFS} AND ref_name IS NOT NULL AND left(ref_name, 1) NOT IN ('#', '%')
      UNION SELECT x.item, x.root, x.far, x.way, o.lprev, o.fprev, o.dist, x.calls, o.lft, o.feat FROM (
        SELECT w.item, w.root, s.far, w.way, coalesce(w.lprev, s.label) AS l, w.fprev, w.dist, w.lft - 1 AS lft, n.kind,
          CASE WHEN s.via = CASE WHEN w.way = -1 THEN 'out' ELSE 'in' END THEN list_append(w.calls, s.funcall) WHEN s.via IS NOT NULL AND len(w.calls) > 0 THEN w.calls[1:len(w.calls) - 1] ELSE w.calls END AS calls,
          n.kind IS NULL OR n.kind IN ('receive', 'input', 'output', 'repeat') OR n.kind = CASE WHEN w.way = -1 THEN 'assign_var' ELSE 'ref_var' END AS thin, coalesce(n.kind = CASE WHEN w.way = -1 THEN 'ref_var' ELSE 'assign_var' END, false) AS passing,
          CASE WHEN n.kind IN {_ALL_REFS} AND n.ref_name = w.item THEN CAST([] AS VARCHAR[]) ELSE n.ws END AS ws, CASE WHEN n.kind IN {_ALL_REFS} AND n.ref_name = w.item THEN [n.kind || ':SELF'] ELSE list_concat(n.ws, n.fs) END AS fs
        FROM wk w JOIN wst s ON s.nid = w.nid AND s.way = w.way JOIN ft n ON n.nid = s.far
        WHERE w.lft >= 0 AND w.feat IS NULL AND (s.via IS NULL OR s.via = CASE WHEN w.way = -1 THEN 'out' ELSE 'in' END OR len(w.calls) = 0 OR w.calls[-1] = s.funcall)) x,
        LATERAL (SELECT l AS lprev, fprev, dist, lft, NULL AS feat WHERE thin OR (passing AND len(fs) > 0)
          UNION ALL SELECT NULL, CASE WHEN len(ws) > 0 THEN u.f ELSE l || ':' || fs[1] END, dist + 1, lft - 10, NULL FROM (SELECT unnest(CASE WHEN len(ws) > 0 THEN list_transform(ws, lambda w: l || ':' || w) ELSE [''] END) AS f) u WHERE NOT thin AND NOT passing AND len(fs) > 0
          UNION ALL SELECT NULL, NULL, 0, 0, (way * (dist + 1)) || ',' || fprev || ',' || l || ':' || u.f FROM (SELECT unnest(fs) AS f) u WHERE NOT thin) o)"""


@query(_FEATURES + " SELECT item, feat, count(DISTINCT root) AS n FROM wk WHERE feat IS NOT NULL GROUP BY 1, 2")
def feature_walk(spark: SparkSession, d: str) -> DataFrame:
    """Features around all readings and assignments, backward and forward over all methods, within a budget of 50."""
    n = m.nodes(spark, d)
    starts = n.where(F.col("kind").isin(*walks.REFS, *walks.ASSIGNS, *walks.ARRAYS) & ~F.left("ref_name", F.lit(1)).isin("#", "%")).select("nid", F.col("ref_name").alias("item"))
    found = walks.feature_walk(scans.stitched(spark, d), walks.node_features(n), starts)
    return found.groupBy("item", "feat").agg(F.count_distinct("root").alias("n"))


_FLOWS = scans._IDF + f""", rf AS (SELECT nid, CASE WHEN left(ref_name, 1) IN ('$', '.') AND NOT coalesce(kind IN {_in(walks.VALUE_PASSES)}, false) THEN ref_name END AS ref FROM nodes),
    top AS (SELECT mid FROM methods WHERE method_id IS NULL OR method_id NOT IN (SELECT callee FROM calls)),
    fl AS (SELECT n.nid, CAST([] AS BIGINT[]) AS calls, r.ref AS dst_ref, CASE WHEN left(r.ref, 1) = '$' THEN CAST([] AS BIGINT[]) END AS dst_in, CAST(NULL AS VARCHAR) AS src_ref, CAST(NULL AS BIGINT[]) AS src_in, CAST(NULL AS VARCHAR) AS to_ref, CAST(NULL AS BIGINT[]) AS to_in FROM nodes n JOIN rf r USING (nid) JOIN top USING (mid) WHERE n.nid NOT IN (SELECT src FROM idf WHERE NOT starts_with(label, '_'))
      UNION SELECT x.far, x.calls, coalesce(x.ref, x.dst_ref), CASE WHEN x.ref IS NULL THEN x.dst_in WHEN left(x.ref, 1) = '$' THEN x.calls END, x.ref, CASE WHEN left(x.ref, 1) = '$' THEN x.calls END, x.dst_ref, x.dst_in FROM (
        SELECT e.src AS far, r.ref, f.dst_ref, f.dst_in, CASE WHEN e.way = 'out' THEN list_append(f.calls, e.funcall) WHEN e.way = 'in' THEN f.calls[1:len(f.calls) - 1] ELSE f.calls END AS calls FROM fl f JOIN idf e ON e.dst = f.nid AND NOT starts_with(e.label, '_') JOIN rf r ON r.nid = e.src
        WHERE e.way IS NULL OR (e.way = 'out' AND NOT list_contains(f.calls, e.funcall)) OR (e.way = 'in' AND len(f.calls) > 0 AND f.calls[-1] = e.funcall)) x)
    SELECT src_ref, to_ref AS dst_ref, count(*) AS n_contexts FROM (SELECT DISTINCT src_ref, src_in, to_ref, to_in FROM fl WHERE src_ref IS NOT NULL AND to_ref IS NOT NULL AND (src_ref <> to_ref OR src_in IS DISTINCT FROM to_in)) GROUP BY 1, 2"""


@query(_FLOWS)
def context_flows(spark: SparkSession, d: str) -> DataFrame:
    """Flows between variables and fields, backward from the ends of methods that nothing calls, calls and returns matched."""
    n, e = m.nodes(spark, d), scans.stitched(spark, d)
    called = stitch.calls(n, None).select(F.col("callee").alias("method_id")).distinct()
    top = m.methods(spark, d).join(called, "method_id", "left_anti").select("mid")
    feeding = e.where(~F.col("label").startswith("_")).select(F.col("src").alias("nid"))
    starts = n.join(top, "mid", "left_semi").join(feeding, "nid", "left_anti").select("nid")
    return walks.matched_flows(e, n, starts)


_CHAIN = scans._IDF + f""", ab AS (SELECT nid, coalesce(kind, '') AS kind, CASE WHEN left(ref_name, 1) <> '#' THEN ref_name END AS ref, kind IS NULL OR (kind IN {_in(walks.EQUIVALENT)} AND (kind <> 'op_assign' OR coalesce(ndata = '=', false))) AS plain FROM nodes),
    sl AS (SELECT DISTINCT e.dst AS nid, e.src AS far, f.ref FROM idf e JOIN ab a ON a.nid = e.dst AND a.plain JOIN ab f ON f.nid = e.src
      WHERE NOT starts_with(e.label, '_') AND CASE WHEN a.kind = 'op_assign' THEN e.label = 'R' WHEN a.kind IN ('ref_field', 'assign_field', 'end', 'repeat') THEN e.label = '' WHEN a.kind = 'join' THEN e.label IN ('true', 'false') ELSE true END),
    cw AS (SELECT ref AS to_ref, nid, 1 AS n, CAST(NULL AS VARCHAR) AS from_ref FROM ab WHERE ref IS NOT NULL AND left(ref, 1) <> '%' UNION SELECT c.to_ref, s.far, c.n + 1, s.ref FROM cw c JOIN sl s ON s.nid = c.nid WHERE c.from_ref IS NULL AND c.n < 60),
    pr AS (SELECT from_ref, to_ref, min(n) AS n FROM cw WHERE from_ref IS NOT NULL AND left(from_ref, 1) <> '%' AND from_ref <> to_ref GROUP BY 1, 2)"""


def _links(spark: SparkSession, d: str) -> DataFrame:
    return kept(spark, "shortest_links", d, lambda: walks.shortest_links(scans.stitched(spark, d), m.nodes(spark, d)))


@query(_CHAIN + " SELECT from_ref, to_ref, CAST(n AS BIGINT) AS n FROM pr")
def assignment_chains(spark: SparkSession, d: str) -> DataFrame:
    """Shortest chain, in nodes, from one reference to another over kinds that keep the value, however long."""
    return _links(spark, d)


@query(_CHAIN + " SELECT to_ref AS ref_name, count(*) AS n_sources FROM pr GROUP BY to_ref HAVING count(*) >= 2")
def generalisations(spark: SparkSession, d: str) -> DataFrame:
    """References that two others or more flow into: they generalise them."""
    return _links(spark, d).groupBy(F.col("to_ref").alias("ref_name")).agg(F.count(F.lit(1)).alias("n_sources")).where("n_sources >= 2")


_GENERAL = _CHAIN + """, ge AS (SELECT DISTINCT sup, sub FROM (SELECT to_ref AS sup, from_ref AS sub, count(*) OVER (PARTITION BY to_ref) AS c FROM pr UNION ALL SELECT from_ref, to_ref, count(*) OVER (PARTITION BY from_ref) FROM pr) WHERE c > 1),
    gn AS (SELECT ref, row_number() OVER (ORDER BY ref) AS id FROM (SELECT sup AS ref FROM ge UNION SELECT sub FROM ge)),
    cg AS (SELECT a.id AS src, b.id AS dst FROM ge JOIN gn a ON a.ref = sup JOIN gn b ON b.ref = sub), vx AS (SELECT src AS node FROM cg UNION SELECT dst FROM cg),
    reach AS (SELECT src AS a, dst AS b FROM cg UNION SELECT r.a, cg.dst FROM reach r JOIN cg ON r.b = cg.src),
    scc AS (SELECT node, least(node, coalesce((SELECT min(r.b) FROM reach r JOIN reach s ON s.a = r.b AND s.b = r.a WHERE r.a = node), node)) AS cid FROM vx),
    dag AS (SELECT DISTINCT x.cid AS src, y.cid AS dst FROM cg JOIN scc x ON x.node = cg.src JOIN scc y ON y.node = cg.dst WHERE x.cid <> y.cid)"""


@query(_GENERAL + " SELECT gn.ref AS ref_name, h.ref AS component, (SELECT count(*) FROM dag WHERE dag.src = scc.cid) AS n_below, (SELECT count(*) FROM dag WHERE dag.dst = scc.cid) AS n_above FROM scc JOIN gn ON gn.id = scc.node JOIN gn h ON h.id = scc.cid")
def generalisation_components(spark: SparkSession, d: str) -> DataFrame:
    """The hierarchy of generalisations: every reference with its component, named by its least reference, and the components next to it."""
    ids, comps, dag = _general(spark, d)
    below = dag.groupBy(F.col("src").alias("cid")).agg(F.count(F.lit(1)).alias("n_below"))
    above = dag.groupBy(F.col("dst").alias("cid")).agg(F.count(F.lit(1)).alias("n_above"))
    named = comps.join(ids.toDF("ref_name", "node"), "node").join(ids.toDF("component", "cid"), "cid")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return named.join(below, "cid", "left").join(above, "cid", "left").select("ref_name", "component", zero("n_below"), zero("n_above"))


def _general(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Numbers of the references in their order, their components, and the edges between these, from above to below."""
    e = cut(walks.generalisation_edges(_links(spark, d)))
    refs = e.select(F.col("sup").alias("ref")).union(e.select("sub")).distinct()
    ids = cut(graphs.words.ranked(refs.withColumn("one", F.lit(1)), "one", "ref").select("ref", F.col("place").cast("long").alias("id")))
    edges = cut(e.join(ids.toDF("sup", "src"), "sup").join(ids.toDF("sub", "dst"), "sub").select("src", "dst"))
    comps = cut(graph.strong_components(edges))
    return ids, comps, cut(graph.condensed(edges, comps))


@query(_GENERAL + graphs._TREE + graphs._TREE_LINES)
def generalisation_tree(spark: SparkSession, d: str) -> DataFrame:
    """The same hierarchy as trees from the most general components down; what was shown is not shown again."""
    return graphs.tree_lines(graph.summary_tree(_general(spark, d)[2]))


@query(scans._IDF + """, fs AS (SELECT ref_name AS start, nid, false AS stops FROM nodes WHERE starts_with(ref_name, '.') UNION SELECT f.start, e.src, coalesce(starts_with(n.ref_name, '.') AND n.ref_name <> f.start, false) FROM fs f JOIN idf e ON e.dst = f.nid AND NOT starts_with(e.label, '_') JOIN nodes n ON n.nid = e.src WHERE NOT f.stops)
    SELECT DISTINCT f.start AS field, n.ref_name AS source FROM fs f JOIN nodes n USING (nid) WHERE f.stops""")
def field_sources(spark: SparkSession, d: str) -> DataFrame:
    """For each field the other fields that are reached first on the ways backward from it."""
    n = m.nodes(spark, d)
    starts = n.where("startswith(ref_name, '.')").select(F.col("ref_name").alias("start"), "nid")
    other = lambda x: x["ref_name"].startswith(".") & (x["ref_name"] != x["start"])
    return walks.reach_until(starts, scans.stitched(spark, d), other, n.select("nid", "ref_name")).select(F.col("start").alias("field"), F.col("ref_name").alias("source")).distinct()


_ORDER = graphs._CG + """, oc AS (SELECT DISTINCT c.nid, c.mid, k.mid AS callee_mid FROM calls c JOIN k ON k.method_id = c.callee WHERE c.mid IS NOT NULL), on_ AS (SELECT DISTINCT nid, mid FROM oc),
    oe AS (SELECT DISTINCT n.mid, l.nid1 AS src, l.nid0 AS dst FROM links l JOIN nodes n ON n.nid = l.nid1 AND n.mid IS NOT NULL WHERE NOT starts_with(l.label, '_')),
    os AS (SELECT n.mid, CAST(NULL AS BIGINT) AS first, n.nid, n.nid IN (SELECT nid FROM on_) AS is_call FROM nodes n WHERE n.mid IN (SELECT mid FROM on_) AND n.nid NOT IN (SELECT dst FROM oe)
      UNION SELECT mid, nid, nid, false FROM on_
      UNION SELECT s.mid, s.first, e.dst, e.dst IN (SELECT nid FROM on_) FROM os s JOIN oe e ON e.mid = s.mid AND e.src = s.nid WHERE NOT s.is_call),
    ord AS (SELECT DISTINCT mid, first AS call_before, nid AS call_after FROM os WHERE is_call UNION SELECT DISTINCT mid, first, NULL FROM os WHERE NOT is_call AND nid NOT IN (SELECT src FROM oe))"""


def _order(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n = m.nodes(spark, d)
    at = cut(stitch.resolved(n, m.methods(spark, d), None).where("mid is not null").distinct())
    inner = m.links(spark, d).where(~F.col("label").startswith("_")).select(F.col("nid1").alias("src"), F.col("nid0").alias("dst"))
    return at, kept(spark, "call_order", d, lambda: walks.call_order(at.select("nid", "mid"), inner, n))


@query(_ORDER + " SELECT mid, call_before, call_after FROM ord")
def call_order(spark: SparkSession, d: str) -> DataFrame:
    """Which call of a method comes next after which, by the flow of data; null for entry and exit."""
    return _order(spark, d)[1]


@query(_ORDER + """, tr AS (SELECT node AS mid, [node] AS path FROM vx WHERE node NOT IN (SELECT dst FROM cg) UNION ALL SELECT c.callee_mid, list_append(t.path, c.callee_mid) FROM tr t JOIN (SELECT DISTINCT mid, callee_mid FROM oc) c ON c.mid = t.mid AND NOT list_contains(t.path, c.callee_mid) WHERE len(t.path) <= 5)
    SELECT array_to_string(t.path, '>') AS context, coalesce('call ' || o.call_before, 'enter') AS src, coalesce('call ' || o.call_after, 'exit') AS dst, CAST(len(t.path) - 1 AS BIGINT) AS depth FROM tr t JOIN ord o ON o.mid = t.mid""")
def call_trace(spark: SparkSession, d: str) -> DataFrame:
    """The order of calls in every context of calls, five levels deep: edges between enter, calls and exit of each instance."""
    at, order = _order(spark, d)
    e = cut(at.select(F.col("mid").alias("src"), F.col("callee_mid").alias("dst")).distinct())
    roots = e.select(F.col("src").alias("node")).distinct().join(e.select(F.col("dst").alias("node")), "node", "left_anti")
    contexts = graph.simple_paths(roots, e, 5).select(F.element_at("path", F.lit(-1)).alias("mid"), F.array_join(F.col("path").cast("array<string>"), ">").alias("context"), F.col("len").alias("depth"))
    name = lambda c, end: F.coalesce(F.concat(F.lit("call "), F.col(c).cast("string")), F.lit(end))
    return contexts.join(order, "mid").select("context", name("call_before", "enter").alias("src"), name("call_after", "exit").alias("dst"), "depth")


@query(_STEPS + f""", wy AS (SELECT e.src AS nid, 'forward' AS way, e.dst, n.f FROM (SELECT DISTINCT src, dst, label FROM idf) e JOIN nf n ON n.nid = e.dst WHERE NOT starts_with(e.label, '_') AND NOT (coalesce(n.kind, '') IN ('call', 'new') AND NOT starts_with(e.label, '#arg')) AND NOT (coalesce(n.kind, '') = 'receive' AND e.label NOT IN ('', '#return'))
      UNION ALL SELECT e.dst, 'backward', e.src, s.f FROM (SELECT DISTINCT src, dst, label FROM idf) e JOIN nf n ON n.nid = e.dst JOIN nf s ON s.nid = e.src WHERE NOT starts_with(e.label, '_') AND NOT (coalesce(n.kind, '') IN ('call', 'new') AND NOT starts_with(e.label, '#arg')) AND NOT (coalesce(n.kind, '') = 'receive' AND e.label NOT IN ('', '#return'))),
    cwy AS (SELECT {_NAME} AS callee, nid, way, [nid] AS seen, CAST('' AS VARCHAR) AS feat, 0 AS size, false AS gained FROM nodes, (VALUES ('forward'), ('backward')) t(way) WHERE kind = 'call' AND ndata IS NOT NULL
      UNION ALL SELECT c.callee, w.dst, c.way, list_append(c.seen, w.dst), CASE WHEN w.f IS NULL THEN c.feat ELSE c.feat || '/' || w.f END, c.size + CASE WHEN w.f IS NULL THEN 0 ELSE 1 END, w.f IS NOT NULL FROM cwy c JOIN wy w ON w.nid = c.nid AND w.way = c.way AND NOT list_contains(c.seen, w.dst) WHERE c.size < 5)
    SELECT way, feat, count(DISTINCT callee) AS n_callees, count(*) AS n FROM cwy WHERE gained GROUP BY 1, 2 HAVING count(*) >= 2""")
def call_path_features(spark: SparkSession, d: str) -> DataFrame:
    """Features on the ways forward and backward from calls, up to five of them, where they occur twice or more."""
    n = m.nodes(spark, d)
    about = n.select("nid", "kind", walks.step_feature(F.col("kind"), F.col("ndata")).alias("f"))
    e = scans.stitched(spark, d).where(~F.col("label").startswith("_")).select("src", "dst", "label").distinct().join(about.toDF("dst", "kd", "fd"), "dst").join(about.select(F.col("nid").alias("src"), F.col("f").alias("fs")), "src")
    into_call = F.coalesce(F.col("kd").isin("call", "new"), F.lit(False)) & ~F.col("label").startswith("#arg")
    other_result = F.coalesce(F.col("kd") == "receive", F.lit(False)) & ~F.col("label").isin("", "#return")
    e = e.where(~into_call & ~other_result)
    forth = e.select(F.col("src").alias("nid"), F.lit("forward").alias("way"), "dst", F.col("fd").alias("f"))
    back = e.select(F.col("dst").alias("nid"), F.lit("backward").alias("way"), F.col("src").alias("dst"), F.col("fs").alias("f"))
    starts = n.where("kind = 'call' and ndata is not null").select("nid", walks._call_name(F.col("ndata")).alias("callee"))
    found = walks.call_ways(cut(forth.unionByName(back)), starts, 5)
    return found.groupBy("way", "feat").agg(F.count_distinct("callee").alias("n_callees"), F.sum("n").alias("n")).where("n >= 2")
