"""Smaller analyses: counts per class and type, structural matches, arguments, spans, prefixes, pictures and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline import model as m
from weftline.common import cut, table
from weftline.functions import descriptors
from weftline.functions import names as fn
from weftline.functions import text as tx
from weftline.operators import bayes, graph, hierarchy, matching, stitch, walks
from weftline.plans import core_problems, graphs, scans, walks as wk, words

V = m.SQL_VIEWS
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = V + sql
        return f

    return add


def _count():
    return F.count(F.lit(1))

_STRIP = "nullif(regexp_extract(regexp_replace({0}, '^%\\[*', ''), '([A-Za-z0-9_]+);?$', 1), '')"
_NAME = "nullif(regexp_extract({0}, ';\\.:?([^(:]*):?\\(', 1), '')"
_CAMEL = "list_transform(regexp_extract_all({0}, '[A-Z]+[a-z]*|[a-z]+'), lambda x: lower(x))"


# counts


@query("SELECT k.kid, n.kind, count(*) AS n FROM nodes n JOIN methods k USING (mid) WHERE k.kid IS NOT NULL GROUP BY k.kid, n.kind")
def kinds_by_class(spark: SparkSession, d: str) -> DataFrame:
    """Nodes per class and kind."""
    kid = m.methods(spark, d).where("kid is not null").select("mid", "kid")
    return m.nodes(spark, d).select("mid", "kind").join(kid, "mid").groupBy("kid", "kind").agg(_count().alias("n"))


@query(f"""SELECT place, w AS word, ntype, count(*) AS n FROM (SELECT ntype, unnest(ws) AS w, unnest(list_transform(range(1, len(ws) + 1), lambda k: CASE WHEN k = len(ws) THEN 'suffix' WHEN k = 1 THEN 'prefix' ELSE 'midfix' END)) AS place
    FROM (SELECT DISTINCT ref_name, ntype, {_CAMEL.format(_STRIP.format('ref_name'))} AS ws FROM nodes WHERE ref_name IS NOT NULL AND ntype IS NOT NULL)) GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY place ORDER BY count(*) DESC, w, ntype) <= 5""")
def affix_types(spark: SparkSession, d: str) -> DataFrame:
    """The five most frequent pairs of word and type at the start, inside and at the end of names of references."""
    own = m.nodes(spark, d).where("ref_name is not null and ntype is not null").select("ref_name", "ntype").distinct()
    ws = own.select("ntype", F.transform(fn.split_camel(fn.strip_id(F.col("ref_name"))), F.lower).alias("ws"))
    at = ws.select("ntype", F.size("ws").alias("len"), F.posexplode("ws").alias("k", "word"))
    place = F.when(F.col("k") == F.col("len") - 1, "suffix").when(F.col("k") == 0, "prefix").otherwise("midfix")
    return bayes.top_per_group(at.groupBy(place.alias("place"), "word", "ntype").agg(_count().alias("n")), "place", 5, F.desc("n"), "word", "ntype")


@query("""SELECT word, pos, n_first + n_later AS n FROM (SELECT w AS word, count(*) FILTER (k = 1) AS n_first, count(*) FILTER (k > 1) AS n_later, CASE WHEN count(*) FILTER (k = 1) > count(*) FILTER (k > 1) THEN 'verb' ELSE 'noun' END AS pos
    FROM (SELECT unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS k FROM (SELECT """ + _CAMEL.format("method_name") + """ AS ws FROM methods)) GROUP BY 1)""")
def learned_word_classes(spark: SparkSession, d: str) -> DataFrame:
    """Part of speech of every word of method names, learned from all of them: a verb leads more names than it stands in later on."""
    at = m.methods(spark, d).select(F.posexplode(F.transform(fn.split_camel(F.col("method_name")), F.lower)).alias("k", "word"))
    per = at.groupBy("word").agg(F.count_if(F.col("k") == 0).alias("a"), F.count_if(F.col("k") > 0).alias("b"))
    return per.select("word", F.when(F.col("a") > F.col("b"), "verb").otherwise("noun").alias("pos"), (F.col("a") + F.col("b")).alias("n"))


@query("""SELECT word, tid, round(sum(score), 5) AS score FROM (SELECT word, fid, exp(-abs(CAST(split_part(feat, ',', 1) AS BIGINT))) * ln((SELECT count(*) FROM its)::DOUBLE / t) * n AS score FROM (SELECT w AS word, fid, count(DISTINCT tid) AS n FROM (SELECT tid, fid, unnest(list_distinct(regexp_extract_all(lower(regexp_extract(item, '(\\w+);?$', 1)), '[a-z]+'))) AS w FROM cnt JOIN its USING (tid) WHERE item IS NOT NULL) GROUP BY 1, 2)
      JOIN (SELECT fid, sum(c) AS t FROM cnt GROUP BY fid HAVING sum(c) > 0) USING (fid) JOIN fts USING (fid)) s JOIN (SELECT tid, fid FROM cnt) USING (fid) JOIN (SELECT tid, unnest(list_distinct(regexp_extract_all(lower(regexp_extract(item, '(\\w+);?$', 1)), '[a-z]+'))) AS word FROM its WHERE item IS NOT NULL) USING (tid, word)
    GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY word ORDER BY round(sum(score), 5) DESC, tid) <= 5""")
def word_items(spark: SparkSession, d: str) -> DataFrame:
    """The five items of each name word with the greatest sum of its features' scores."""
    n = float(m.items(spark, d).count())
    split = F.array_distinct(F.regexp_extract_all(F.lower(F.regexp_extract("item", "(\\w+);?$", 1)), F.lit("[a-z]+"), F.lit(0)))
    named = m.items(spark, d).where("item is not null").select("tid", F.explode(split).alias("word"))
    cnt = m.counts(spark, d)
    both = cut(cnt.join(named, "tid").select("tid", "fid", "word"))
    per = both.groupBy("word", "fid").agg(F.count_distinct("tid").alias("n"))
    tot = cnt.groupBy("fid").agg(F.sum("c").alias("t")).where("t > 0")
    dist = m.feats(spark, d).select("fid", F.abs(F.split("feat", ",")[0].cast("long")).alias("d"))
    scored = per.join(tot, "fid").join(dist, "fid").select("word", "fid", (F.exp(-F.col("d")) * F.log(F.lit(n) / F.col("t")) * F.col("n")).alias("s"))
    sums = both.join(scored, ["word", "fid"]).groupBy("word", "tid").agg(F.round(F.sum("s"), 5).alias("score"))
    return bayes.top_per_group(sums, "word", 5, F.desc("score"), "tid")


@query(f"""SELECT a.ref AS a, b.ref AS b, round(len(list_intersect(a.w, b.w))::DOUBLE / len(list_distinct(list_concat(a.w, b.w))), 6) AS sim, coalesce(a.h = b.h, false) AS same_noun, a.t = b.t AS same_type
    FROM fld a JOIN fld b ON a.cls = b.cls AND a.ref < b.ref WHERE len(list_intersect(a.w, b.w)) > 0""".replace("SELECT a.ref", ", fld AS (SELECT ref_name AS ref, regexp_extract(ref_name, '^\\.(.*)/[^/]*$', 1) AS cls, min(coalesce(ntype, '?')) AS t, list_distinct(" + _CAMEL.format("regexp_extract(ref_name, '([^/]*)$', 1)") + ") AS w, lower(nullif(regexp_extract(regexp_extract(ref_name, '([^/]*)$', 1), '([A-Z]?[a-z]+|[A-Z]+)$', 1), '')) AS h FROM nodes WHERE starts_with(ref_name, '.') GROUP BY ref_name) SELECT a.ref", 1))
def field_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Fields of one class with a common word: similarity of names, same head noun, same type."""
    per = m.nodes(spark, d).where("startswith(ref_name, '.')").groupBy(F.col("ref_name").alias("ref")).agg(F.min(F.coalesce("ntype", F.lit("?"))).alias("t"))
    own = F.regexp_extract("ref", "([^/]*)$", 1)
    f = cut(per.select("ref", F.regexp_extract("ref", "^\\.(.*)/[^/]*$", 1).alias("cls"), "t", F.array_distinct(F.transform(fn.split_camel(own), F.lower)).alias("w"), fn.head_noun(own).alias("h")))
    index = f.select("cls", "ref", F.explode("w").alias("word"))
    pairs = index.toDF("cls", "a", "word").join(index.toDF("cls", "b", "word"), ["cls", "word"]).where("a < b").select("a", "b").distinct()
    both = pairs.join(f.select(F.col("ref").alias("a"), F.col("w").alias("wa"), F.col("h").alias("ha"), F.col("t").alias("ta")), "a").join(f.select(F.col("ref").alias("b"), F.col("w").alias("wb"), F.col("h").alias("hb"), F.col("t").alias("tb")), "b")
    return both.select("a", "b", F.round(tx.jaccard(F.col("wa"), F.col("wb")), 6).alias("sim"), F.coalesce(F.col("ha") == F.col("hb"), F.lit(False)).alias("same_noun"), (F.col("ta") == F.col("tb")).alias("same_type"))


# scalar forms


_TYPE_WORDS = wk._TYPE_WORDS


@query(f"SELECT ntype, array_to_string({_TYPE_WORDS.format('ntype')}, ' ') AS words FROM (SELECT DISTINCT ntype FROM nodes WHERE ntype IS NOT NULL)")
def type_words(spark: SparkSession, d: str) -> DataFrame:
    """Words of every type with their dimensions."""
    return m.nodes(spark, d).where("ntype is not null").select("ntype").distinct().select("ntype", F.array_join(fn.type_words(F.col("ntype")), " ").alias("words"))


@query(f"""SELECT mid, CASE WHEN contains(method_id, ';.:init:') THEN {m.SQL_SIMPLE.format("nullif(regexp_extract(method_id, '^(.*?;)\\.', 1), '')")} ELSE {_NAME.format('method_id')} END AS name FROM methods WHERE method_id IS NOT NULL""")
def similarity_names(spark: SparkSession, d: str) -> DataFrame:
    """The name by which methods are compared: of a constructor that of its class."""
    c = F.col("method_id")
    own = F.when(c.contains(";.:init:"), fn.class_simple_name(fn.method_class(c))).otherwise(fn.method_simple_name(c))
    return m.methods(spark, d).where("method_id is not null").select("mid", own.alias("name"))


@query("SELECT uid, len(regexp_extract_all(src_text, '[\\p{L}\\p{N}\\p{M}_\\p{Pc}]+'))::BIGINT AS n_tokens FROM srcs WHERE src_text IS NOT NULL")
def source_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Runs of letters, digits and underscores in every source."""
    return m.sources(spark, d).where("src_text is not null").select("uid", F.size(F.regexp_extract_all("src_text", F.lit("[\\p{L}\\p{N}\\p{M}_\\p{Pc}]+"), F.lit(0))).cast("long").alias("n_tokens"))


@query(wk._STEPS + ", tf AS (SELECT nid, ws, fs FROM ft) SELECT nf.nid, nf.f AS chain, nf.g AS side, array_to_string(ws, ' ') AS name_words, array_to_string(fs, ' ') AS base, array_to_string(list_transform(tw, lambda w: '@' || w), ' ') AS type_words FROM nf JOIN tf USING (nid) JOIN tws USING (nid)".replace(", tf AS", wk._FEATURES[len(scans._IDF):wk._FEATURES.index(",\n    wst AS")] + f", tws AS (SELECT nid, CASE WHEN ntype IS NULL THEN CAST([] AS VARCHAR[]) ELSE {_TYPE_WORDS.format('ntype')} END AS tw FROM nodes), tf AS", 1))
def node_feature_texts(spark: SparkSession, d: str) -> DataFrame:
    """The five forms of a node's feature: in a chain, beside one, by the words of its name, by itself, and by its type."""
    n = m.nodes(spark, d)
    kind, ref, data, type_ = (F.col(c) for c in ("kind", "ref_name", "ndata", "ntype"))
    chain = n.select("nid", walks.step_feature(kind, data).alias("chain"), walks.side_feature(kind, ref, data, type_).alias("side"), F.array_join(F.transform(F.coalesce(fn.type_words(type_), F.array().cast("array<string>")), lambda w: F.concat(F.lit("@"), F.coalesce(w, F.lit("")))), " ").alias("type_words"), type_.alias("t"))
    both = chain.join(walks.node_features(n).select("nid", "ws", "fs"), "nid")
    return both.select("nid", "chain", "side", F.array_join("ws", " ").alias("name_words"), F.array_join("fs", " ").alias("base"), F.when(F.col("t").isNull(), "").otherwise(F.col("type_words")).alias("type_words"))


@query("SELECT mid, '<' || string_agg(ntype, '' ORDER BY slot) || '>' AS reified FROM (SELECT mid, ref_name AS slot, min(ntype) AS ntype FROM nodes WHERE kind = 'input' AND mid IS NOT NULL AND ntype IS NOT NULL AND ref_name IS NOT NULL GROUP BY 1, 2) GROUP BY mid")
def reified_by_slot(spark: SparkSession, d: str) -> DataFrame:
    """Name of a method's instance by the types of its inputs in the order of their slots' names."""
    own = m.nodes(spark, d).where("kind = 'input' and mid is not null and ntype is not null and ref_name is not null").groupBy("mid", F.col("ref_name").alias("slot")).agg(F.min("ntype").alias("t"))
    types = F.transform(F.array_sort(F.collect_list(F.struct("slot", "t"))), lambda x: x["t"])
    return own.groupBy("mid").agg(F.concat(F.lit("<"), F.array_join(types, ""), F.lit(">")).alias("reified"))


# arguments of calls


@query(f"""{wk._STEPS}, af AS (SELECT nid, CASE WHEN kind IN ('value', 'valueset') THEN '#const' WHEN kind IN ('ref_var', 'ref_field') AND NOT starts_with(coalesce(ref_name, '@'), '@') THEN {m.SQL_REFERENCE.format('ref_name')} WHEN kind = 'call' THEN '()' || coalesce({_NAME.format("split_part(ndata, ' ', 1)")}, '?') END AS feat, kind FROM nodes),
    thr AS (SELECT nid0 AS nid, min(nid1) AS nxt FROM links l JOIN nodes n ON n.nid = l.nid0 AND n.kind = 'receive' GROUP BY nid0 HAVING count(*) = 1),
    arg0 AS (SELECT c.nid, c.callee AS func, CAST(substr(l.label, 5) AS BIGINT) AS arg, l.nid1 AS src FROM calls c JOIN links l ON l.nid0 = c.nid AND regexp_full_match(l.label, '#arg[0-9]+')),
    res0 AS (SELECT nid, func, arg, src, 0 AS hop FROM arg0 UNION ALL SELECT r.nid, r.func, r.arg, t.nxt, hop + 1 FROM res0 r JOIN thr t ON t.nid = r.src WHERE hop < 50),
    resl AS (SELECT DISTINCT nid, func, arg, src FROM res0 WHERE src NOT IN (SELECT nid FROM thr)),
    par AS (SELECT method_id AS func, k - 1 AS arg, ps[k] AS type FROM (SELECT method_id, ps, unnest(range(1, len(ps) + 1)) AS k FROM (SELECT DISTINCT method_id, regexp_extract_all(regexp_extract(method_id, '\\(([^)]*)\\)', 1), '\\[*(?:L[^;]*;|T[^;]*;|[A-Z])') AS ps FROM methods WHERE method_id IS NOT NULL)))
    SELECT CASE WHEN p.type IS NULL THEN 'other' WHEN p.type = '{m.STRING_TYPE}' THEN 'text' WHEN p.type IN ('B', 'S', 'I', 'J', 'C') THEN 'whole' WHEN p.type IN ('F', 'D') THEN 'real' WHEN p.type = 'Z' THEN 'flag' WHEN starts_with(p.type, '[') THEN 'array' ELSE 'object' END AS category, r.arg, coalesce(a.feat, '') AS feat, count(*) AS n
    FROM resl r JOIN af a ON a.nid = r.src LEFT JOIN par p ON p.func = r.func AND p.arg = r.arg GROUP BY 1, 2, 3""")
def argument_categories(spark: SparkSession, d: str) -> DataFrame:
    """Arguments of calls by a catalogue of signature and argument index, with what the argument is; 'other' where it has none.

    The catalogue here is made of the signatures in the store: the category of a parameter follows its type.
    """
    n, ln = m.nodes(spark, d), m.links(spark, d)
    me = m.methods(spark, d).where("method_id is not null").select(F.col("method_id").alias("func")).distinct()
    params = me.select("func", F.posexplode(F.regexp_extract_all(fn.method_args(F.col("func")), F.lit("\\[*(?:L[^;]*;|T[^;]*;|[A-Z])"), F.lit(0))).alias("arg", "type"))
    t = F.col("type")
    category = F.when(t == m.STRING_TYPE, "text").when(t.isin("B", "S", "I", "J", "C"), "whole").when(t.isin("F", "D"), "real").when(t == "Z", "flag").when(t.startswith("["), "array").otherwise("object")
    catalogue = params.select("func", F.col("arg").cast("long").alias("arg"), category.alias("category"))
    found = matching.argument_rows(n, ln, catalogue)
    return found.groupBy("category", "arg", F.coalesce("feat", F.lit("")).alias("feat")).agg(_count().alias("n"))


@query("SELECT func, arg, category FROM (VALUES " + ", ".join(f"('{f}', CAST({a} AS BIGINT), '{c}')" for f, a, c in matching.catalogue_rows()) + ") t(func, arg, category)")
def argument_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue of library arguments: signature, argument and category, made of rules over classes and parameters."""
    return spark.createDataFrame(matching.catalogue_rows(), "func string, arg bigint, category string")


# matches


@query(graphs._INDEX + """, vt AS (SELECT q.mid AS qmid, x.mid FROM ix q JOIN ix x ON x.path = q.path AND x.size = q.size AND x.mid <> q.mid WHERE q.mid % 20 = 0 AND q.size >= 2 GROUP BY 1, 2 HAVING count(DISTINCT q.nid) >= 2 AND count(DISTINCT x.nid) >= 2),
    shp AS (SELECT k.nid, k.mid, k.key, coalesce(bit_xor(hash(s.label || ':' || c.key)), 0) AS h FROM kn k LEFT JOIN stp s ON s.nid = k.nid LEFT JOIN kn c ON c.nid = s.src WHERE k.key IS NOT NULL AND k.mid IS NOT NULL GROUP BY 1, 2, 3),
    num AS (SELECT *, row_number() OVER (PARTITION BY mid, key, h ORDER BY nid) AS nth FROM shp),
    sm AS (SELECT v.qmid, v.mid, x.nid AS a, y.nid AS b FROM vt v JOIN num x ON x.mid = v.qmid JOIN num y ON y.mid = v.mid AND y.key = x.key AND y.h = x.h AND y.nth = x.nth),
    ra AS (SELECT v.qmid, v.mid, x.key, x.nid AS a, row_number() OVER (PARTITION BY v.qmid, v.mid, x.key ORDER BY x.nid) AS nth FROM vt v JOIN num x ON x.mid = v.qmid WHERE NOT EXISTS (SELECT 1 FROM sm WHERE sm.qmid = v.qmid AND sm.mid = v.mid AND sm.a = x.nid)),
    rb AS (SELECT v.qmid, v.mid, y.key, y.nid AS b, row_number() OVER (PARTITION BY v.qmid, v.mid, y.key ORDER BY y.nid) AS nth FROM vt v JOIN num y ON y.mid = v.mid WHERE NOT EXISTS (SELECT 1 FROM sm WHERE sm.qmid = v.qmid AND sm.mid = v.mid AND sm.b = y.nid)),
    rt AS (SELECT * FROM sm UNION ALL SELECT qmid, mid, a, b FROM ra JOIN rb USING (qmid, mid, key, nth)),
    ks AS (SELECT s.nid, s.label, s.src, k.key FROM stp s JOIN kn k ON k.nid = s.src AND k.mid IS NOT NULL),
    tr AS (SELECT qmid, mid, a AS ra, b AS rb, a, b, 1 AS level FROM rt
      UNION SELECT t.qmid, t.mid, t.ra, t.rb, x.src, y.src, t.level + 1 FROM tr t JOIN ks x ON x.nid = t.a JOIN ks y ON y.nid = t.b AND y.label = x.label AND y.key = x.key WHERE t.level < 60),
    wd AS (SELECT a, b, count(DISTINCT (x.src, y.src)) AS w FROM (SELECT DISTINCT a, b FROM tr) t JOIN ks x ON x.nid = t.a JOIN ks y ON y.nid = t.b AND y.label = x.label AND y.key = x.key GROUP BY 1, 2),
    mt AS (SELECT qmid, mid, count(DISTINCT a) AS n_nodes, max(level) AS depth, greatest(max(coalesce(w, 0)), 1) AS branch FROM (SELECT qmid, mid, ra, rb, a, b, min(level) AS level FROM tr GROUP BY ALL) LEFT JOIN wd USING (a, b) GROUP BY qmid, mid, ra, rb HAVING count(DISTINCT a) >= 2 AND max(level) >= 2)
    SELECT qmid, mid, n_nodes, CAST(depth AS BIGINT) AS depth, CAST(branch AS BIGINT) AS branch FROM (SELECT * FROM mt QUALIFY row_number() OVER (PARTITION BY qmid, mid ORDER BY n_nodes DESC, depth DESC, branch DESC) = 1) QUALIFY row_number() OVER (PARTITION BY qmid ORDER BY n_nodes DESC, depth DESC, mid) = 1""")
def structural_matches(spark: SparkSession, d: str) -> DataFrame:
    """For every twentieth method the method with the greatest common tree: nodes, depth and branching of the match."""
    keyed = m.nodes(spark, d).select("nid", "mid", fn.node_key(F.col("kind"), F.col("ndata")).alias("key"))
    votes = graph.path_votes(graphs._index(spark, d).where("mid % 20 = 0"), graphs._index(spark, d), 2, 2).select("qmid", "mid")
    found = matching.common_trees(cut(keyed), m.links(spark, d), votes, 2, 2)
    return bayes.top_per_group(found, "qmid", 1, F.desc("n_nodes"), F.desc("depth"), "mid")


@query(graphs.SQL["path_search"].replace(V, "", 1).replace("x.mid <> q.mid", "x.mid > q.mid + 100"))
def later_matches(spark: SparkSession, d: str) -> DataFrame:
    """The same search for methods well behind the query method: the condition of the match is an argument."""
    ix = graphs._index(spark, d)
    return graph.path_votes(ix.where("mid % 20 = 0"), ix, 2, 2, lambda qmid, mid: mid > qmid + 100)


# spans and scopes


@query("""SELECT a.nid AS call_nid, b.nid AS other_nid FROM nodes a JOIN nodes b ON a.mid = b.mid AND a.nid <> b.nid AND a.ast_start < b.ast_end AND b.ast_start < a.ast_end
    WHERE a.kind = 'call' AND a.nid % 20 = 0 AND b.kind IN ('value', 'assign_field') AND NOT (a.ast_start = b.ast_start AND a.ast_end = b.ast_end)""")
def overlapping_spans(spark: SparkSession, d: str) -> DataFrame:
    """Values and assigned fields whose source overlaps that of a call of the same method, equal spans left out; for every twentieth call."""
    n = m.nodes(spark, d).where("mid is not null and ast_start < ast_end").select("nid", "mid", "kind", F.col("ast_start").cast("long").alias("s"), F.col("ast_end").cast("long").alias("e"))
    a = n.where("kind = 'call' and nid % 20 = 0").select("mid", F.col("nid").alias("call_nid"), F.col("s").alias("a0"), F.col("e").alias("a1"))
    b = n.where("kind in ('value', 'assign_field')").select("mid", F.col("nid").alias("other_nid"), F.col("s").alias("b0"), F.col("e").alias("b1"))
    hits = stitch.overlaps(a, b, ["mid"], "a0", "a1", "b0", "b1")
    same = (F.col("a0") == F.col("b0")) & (F.col("a1") == F.col("b1"))
    return hits.where(~same).select("call_nid", "other_nid")


@query(core_problems._TREE.replace("WITH RECURSIVE s AS", ", s AS", 1) + ", up AS (SELECT sid, unnest(way) AS top FROM t) SELECT u.top AS top_sid, count(*) AS n_nodes, count(DISTINCT n.sid) AS n_scopes FROM up u JOIN nodes n ON n.sid = u.sid WHERE u.top % 20 = 0 GROUP BY u.top")
def scope_subtrees(spark: SparkSession, d: str) -> DataFrame:
    """Nodes in every twentieth scope and all scopes below it."""
    ranges = cut(core_problems.scope_hierarchy(spark, d, False))
    tops = ranges.where("sid % 20 = 0 and first is not null")
    inside = hierarchy.below(ranges, "sid", tops).select("top", "sid").unionByName(tops.select(F.col("sid").alias("top"), "sid"))
    per = m.nodes(spark, d).where("sid is not null").groupBy("sid").agg(_count().alias("n"))
    return inside.join(per, "sid").groupBy(F.col("top").alias("top_sid")).agg(F.sum("n").alias("n_nodes"), _count().alias("n_scopes"))


# prefixes


@query("""SELECT prefix, CAST(n_items AS BIGINT) AS n_items, CAST(n_projects AS BIGINT) AS n_projects, round(w, 6) AS weight FROM (SELECT prefix, count(DISTINCT tid) AS n_items, count(DISTINCT regexp_extract(item, 'L([^/;]*)', 1)) AS n_projects, max(w) AS w FROM (SELECT c.tid, array_to_string(parts[1:k], ':') AS prefix, sum(ln(tot::DOUBLE / pn)) OVER (PARTITION BY c.tid, c.fid ORDER BY k) AS w
    FROM (SELECT tid, fid, parts, unnest(range(1, len(parts) + 1)) AS k FROM cnt JOIN (SELECT fid, string_split(split_part(feat, ',', 3), ':') AS parts FROM fts WHERE feat LIKE '%,%,%') USING (fid)) c JOIN (SELECT part, count(*) AS pn, sum(count(*)) OVER () AS tot FROM (SELECT unnest(string_split(split_part(feat, ',', 3), ':')) AS part FROM fts WHERE feat LIKE '%,%,%') GROUP BY part) q ON q.part = parts[k]) JOIN its USING (tid) WHERE item IS NOT NULL GROUP BY prefix) WHERE n_items >= 2 AND n_projects >= 2 AND round(w, 6) >= 3""")
def frequent_prefixes(spark: SparkSession, d: str) -> DataFrame:
    """Prefixes of feature paths of two items and two projects or more with a weight of three at least; a project is the first part of an item's path."""
    pre = graphs.prefix_weights(spark, d)
    project = m.items(spark, d).where("item is not null").select("tid", F.regexp_extract("item", "L([^/;]*)", 1).alias("project"))
    found = m.counts(spark, d).join(pre, "fid").join(project, "tid").groupBy(F.col("p").alias("prefix")).agg(F.count_distinct("tid").alias("n_items"), F.count_distinct("project").alias("n_projects"), F.round(F.max("w"), 6).alias("weight"))
    return found.where("n_items >= 2 and n_projects >= 2 and weight >= 3")


# pictures and pages


@query(wk.SQL["call_trace"].replace(V, "", 1).replace("SELECT array_to_string(t.path, '>') AS context", "SELECT DISTINCT '  \"' || array_to_string(t.path, '>') || ' ' || coalesce('call ' || o.call_before, 'enter') || '\" -> \"' || array_to_string(t.path, '>') || ' ' || coalesce('call ' || o.call_after, 'exit') || '\";' AS line FROM (SELECT array_to_string(t.path, '>') AS context", 1).split(" FROM (SELECT array_to_string(t.path, '>') AS context")[0] + " FROM tr t JOIN ord o ON o.mid = t.mid")
def call_graph_dot(spark: SparkSession, d: str) -> DataFrame:
    """GraphViz edges of the order of calls in every context, between the enter, calls and exit of each."""
    end = lambda c: F.concat(F.lit('"'), F.col("context"), F.lit(" "), F.col(c), F.lit('"'))
    return wk.call_trace(spark, d).select(F.concat(F.lit("  "), end("src"), F.lit(" -> "), end("dst"), F.lit(";")).alias("line")).distinct()


@query(words.SQL["renamed_items"].replace(V, "", 1).replace("SELECT qid, item, array_to_string(", "SELECT qid, '<div class=\"rec\" id=\"R' || qid || '\"><h3>' || replace(replace(replace(replace(item, '&', '&amp;'), '>', '&gt;'), '<', '&lt;'), '\"', '&quot;') || '</h3><p>' || array_to_string(").replace("'') AS renamed FROM nn", "'') || '</p></div>' AS page FROM nn"))
def rename_pages(spark: SparkSession, d: str) -> DataFrame:
    """Page parts for the review of proposed names: the item and its proposal, escaped."""
    r = words.renamed_items(spark, d)
    return r.select("qid", F.concat(F.lit('<div class="rec" id="R'), F.col("qid"), F.lit('"><h3>'), fn.html_escape(F.col("item")), F.lit("</h3><p>"), F.col("renamed"), F.lit("</p></div>")).alias("page"))
