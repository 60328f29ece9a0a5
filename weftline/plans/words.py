"""Word, feature and naming analyses: aggregates, Naive Bayes, vector space, ranks and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline import model as m
from weftline.common import cut, kept
from weftline.functions import names as fn
from weftline.operators import bayes

V = m.SQL_VIEWS
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = V + sql
        return f

    return add


@query("SELECT kind, count(*) AS n FROM nodes GROUP BY ROLLUP (kind) HAVING kind IS NOT NULL OR grouping(kind) = 1")
def kind_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Nodes per kind, and their total under null; relays count in the total only."""
    kinds = m.nodes(spark, d).rollup("kind").agg(F.count(F.lit(1)).alias("n"), F.grouping("kind").alias("g"))
    return kinds.where("kind is not null or g = 1").select("kind", "n")


@query("SELECT mid, count(*) AS n FROM nodes WHERE mid IS NOT NULL GROUP BY mid ORDER BY n DESC, mid DESC LIMIT 10")
def largest_methods(spark: SparkSession, d: str) -> DataFrame:
    """The ten methods with most nodes."""
    return m.nodes(spark, d).where("mid is not null").groupBy("mid").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("mid")).limit(10)


_WORDS = "list_transform(regexp_extract_all(reverse({}), '[0-9]*[a-z]+[A-Z]?|[0-9]*[A-Z]+'), lambda w: lower(reverse(w)))"


@query(f"SELECT mid, array_to_string({_WORDS.format('method_name')}, ' ') AS words, array_to_string(regexp_extract_all(method_name, '[A-Z]+[a-z]*|[a-z]+'), ' ') AS parts FROM methods WHERE method_name IS NOT NULL")
def method_words(spark: SparkSession, d: str) -> DataFrame:
    """Words of method names, last first, and their camel-case parts."""
    own = m.methods(spark, d).where("method_name is not null")
    return own.select("mid", F.array_join(fn.split_words(F.col("method_name")), " ").alias("words"), F.array_join(fn.split_camel(F.col("method_name")), " ").alias("parts"))


@query("""SELECT CASE WHEN k = 1 AND verb THEN 'verb' ELSE 'noun' END AS pos, w AS word, count(*) AS n FROM (SELECT w, k, count(*) FILTER (k = 1) OVER (PARTITION BY w) > count(*) FILTER (k > 1) OVER (PARTITION BY w) AS verb FROM (SELECT unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS k FROM (SELECT list_transform(regexp_extract_all(method_name, '[A-Z]+[a-z]*|[a-z]+'), lambda x: lower(x)) AS ws FROM methods))) GROUP BY 1, 2""")
def word_classes(spark: SparkSession, d: str) -> DataFrame:
    """Words of method names by part of speech: a first word that leads more names than it stands in later on is a verb."""
    at = m.methods(spark, d).select(F.posexplode(F.transform(fn.split_camel(F.col("method_name")), F.lower)).alias("k", "word"))
    per = cut(at.groupBy("word").agg(F.count_if(F.col("k") == 0).alias("a"), F.count_if(F.col("k") > 0).alias("b")))
    verb = F.col("a") > F.col("b")
    rows = per.where(verb).select(F.lit("verb").alias("pos"), "word", F.col("a").alias("n")).unionByName(per.where(verb).select(F.lit("noun").alias("pos"), "word", F.col("b").alias("n")))
    return rows.unionByName(per.where(~verb).select(F.lit("noun").alias("pos"), "word", (F.col("a") + F.col("b")).alias("n"))).where("n > 0")


@query(f"SELECT w AS word, count(*) AS n FROM (SELECT unnest({_WORDS.format('r')}) AS w FROM (SELECT regexp_extract(ref_name, '([A-Za-z0-9_]+);?$', 1) AS r FROM nodes WHERE ref_name IS NOT NULL)) GROUP BY 1")
def reference_words(spark: SparkSession, d: str) -> DataFrame:
    """Word frequency over the names of references."""
    words = fn.split_words(fn.strip_id(F.col("ref_name")))
    return m.nodes(spark, d).where("ref_name is not null").select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT place, w AS word, count(*) AS n FROM (SELECT unnest(ws) AS w, unnest(list_transform(range(1, len(ws) + 1), lambda k: CASE WHEN k = len(ws) THEN 'suffix' WHEN k = 1 THEN 'prefix' ELSE 'midfix' END)) AS place
    FROM (SELECT regexp_extract_all(method_name, '[A-Z]+[a-z]*|[a-z]+') AS ws FROM methods)) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY place ORDER BY count(*) DESC, w) <= 5""")
def affix_words(spark: SparkSession, d: str) -> DataFrame:
    """The five most frequent words at the start, inside and at the end of method names."""
    own = m.methods(spark, d).select(fn.split_camel(F.col("method_name")).alias("ws")).select(F.size("ws").alias("len"), F.posexplode("ws").alias("k", "word"))
    place = F.when(F.col("k") == F.col("len") - 1, "suffix").when(F.col("k") == 0, "prefix").otherwise("midfix")
    return bayes.top_per_group(own.groupBy(place.alias("place"), "word").agg(F.count(F.lit(1)).alias("n")), "place", 5, F.desc("n"), "word")


@query("SELECT fid AS feat, count(DISTINCT tid) AS df, round(CASE WHEN count(DISTINCT tid) <= 1 THEN 0 ELSE ln((SELECT count(DISTINCT tid) FROM cnt)::DOUBLE / count(DISTINCT tid)) END, 6) AS idf FROM cnt GROUP BY fid")
def inverse_document_frequency(spark: SparkSession, d: str) -> DataFrame:
    """Items per feature and the inverse document frequency."""
    return bayes.idf(m.counts(spark, d).select(F.col("tid").alias("doc"), F.col("fid").alias("feat"), F.col("c").alias("w"))).select("feat", "df", F.round("idf", 6).alias("idf"))


_VSM = """, n AS (SELECT count(DISTINCT tid) AS n FROM cnt), df AS (SELECT fid, count(*) AS df FROM cnt GROUP BY fid),
    x AS (SELECT tid, fid, c * CASE WHEN df <= 1 THEN 0 ELSE ln(n::DOUBLE / df) END AS x FROM cnt JOIN df USING (fid), n), y AS (SELECT * FROM x WHERE x <> 0),
    norm AS (SELECT tid, sqrt(sum(x * x)) AS norm FROM y GROUP BY tid),
    pr AS (SELECT DISTINCT p.tid AS a, q.tid AS b FROM y p JOIN y q ON p.fid = q.fid AND p.tid < q.tid),
    s AS (SELECT a, b, sum(p.x * q.x) AS dot FROM pr JOIN y p ON p.tid = a JOIN y q ON q.tid = b AND q.fid = p.fid GROUP BY a, b)
    SELECT a, b, round(dot / (na.norm * nb.norm), 6) AS sim FROM s JOIN norm na ON na.tid = a JOIN norm nb ON nb.tid = b WHERE round(dot / (na.norm * nb.norm), 6) >= 0.7"""


def weighed_items(spark: SparkSession, d: str) -> DataFrame:
    """(doc, feat, w): the items as documents of features."""
    return m.counts(spark, d).select(F.col("tid").alias("doc"), F.col("fid").alias("feat"), F.col("c").alias("w"))


@query(_VSM)
def similar_items(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of items by tf-idf cosine."""
    return kept(spark, "similar_items", f"{d}/itemfeats.parquet", lambda: bayes.cosine_pairs(weighed_items(spark, d), 0.7))


_NB = f""", wt AS (SELECT tid, coalesce(max(c) FILTER (fid = 0), max(c)) AS w FROM cnt GROUP BY tid), fcn AS (SELECT tid, fid, c FROM cnt WHERE fid <> 0),
    w AS (SELECT tid, greatest(coalesce(w, 1), 1) AS n, unnest({_WORDS.format("nullif(regexp_extract(item, '([A-Za-z0-9_]+);?$', 1), '')")}) AS key FROM its LEFT JOIN wt USING (tid) WHERE item IS NOT NULL),
    keys AS (SELECT key, sum(n)::BIGINT AS k FROM w GROUP BY key), fc AS (SELECT fid AS feat, key, sum(c)::BIGINT AS c FROM fcn JOIN w USING (tid) GROUP BY 1, 2 HAVING sum(c) > 0)"""


def _named(spark: SparkSession, d: str) -> DataFrame:
    """(tid, key, n): a row per word of an item's name, with the item's number of observations.

    That is the count of feature 0 where the store has it, else the greatest count of a feature.
    """
    size = m.counts(spark, d).groupBy("tid").agg(F.coalesce(F.max(F.when(F.col("fid") == 0, F.col("c"))), F.max("c")).alias("w"))
    words = m.items(spark, d).where("item is not null").select("tid", F.explode(fn.split_words(fn.strip_id(F.col("item")))).alias("key"))
    return words.join(size, "tid", "left").select("tid", "key", F.greatest(F.coalesce("w", F.lit(1)), F.lit(1)).alias("n"))


def _features(spark: SparkSession, d: str) -> DataFrame:
    return m.counts(spark, d).where("fid <> 0")


def _observations(spark: SparkSession, d: str) -> DataFrame:
    """Items as observations of every word of their names, with their own features."""
    named = _named(spark, d)
    own = _features(spark, d).join(named, "tid").select("tid", "key", F.col("fid").alias("feat"), F.col("c").alias("w"))
    return own.unionByName(named.select("tid", "key", F.lit(None).cast("long").alias("feat"), F.col("n").alias("w")))


@query(_NB + " SELECT feat, key, c FROM fc UNION ALL SELECT NULL, key, k FROM keys")
def nb_train(spark: SparkSession, d: str) -> DataFrame:
    """Counts of a Naive-Bayes model of name words."""
    keys, feats = bayes.train(_observations(spark, d))
    return feats.unionByName(keys.select(F.lit(None).cast("long").alias("feat"), "key", F.col("k").alias("c")))


@query(_NB.replace("WHERE item IS NOT NULL)", "WHERE item IS NOT NULL AND tid % 10 <> 3)") + " SELECT feat, key, c FROM fc UNION ALL SELECT NULL, key, k FROM keys")
def nb_retract(spark: SparkSession, d: str) -> DataFrame:
    """The same counts after every tenth item was taken back with negative weights."""
    obs = _observations(spark, d)
    keys, feats = bayes.train(obs.unionByName(obs.where("tid % 10 = 3").withColumn("w", -F.col("w"))))
    return feats.unionByName(keys.select(F.lit(None).cast("long").alias("feat"), "key", F.col("k").alias("c")))


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return _features(spark, d).where("tid % 20 = 0").select(F.col("tid").alias("qid"), F.col("fid").alias("feat"))


@query(_NB + """, hits AS (SELECT q.tid AS qid, key, count(*) AS n, max(ln(k)) + sum(ln(c.c) - ln(k)) AS p FROM (SELECT DISTINCT tid, fid FROM fcn WHERE tid % 20 = 0) q JOIN fc c ON c.feat = q.fid JOIN keys USING (key) GROUP BY 1, 2),
    kept AS (SELECT * FROM hits QUALIFY n = max(n) OVER (PARTITION BY qid))
    SELECT qid, key, round(p - max(p) OVER (PARTITION BY qid), 6) AS score, n FROM kept""")
def nb_predict_strict(spark: SparkSession, d: str) -> DataFrame:
    """Scores of the keys that share most features, for every item whose id is divisible by 20."""
    return bayes.strict_scores(*bayes.train(_observations(spark, d)), _asked(spark, d))


@query(_NB + """, q AS (SELECT DISTINCT tid AS qid, fid AS feat FROM fcn WHERE tid % 20 = 0), kq AS (SELECT * FROM q WHERE feat IN (SELECT feat FROM fc)),
    a AS (SELECT qid, count(kq.feat) AS asked FROM (SELECT DISTINCT qid FROM q) LEFT JOIN kq USING (qid) GROUP BY qid),
    h AS (SELECT qid, key, sum(ln(c.c)) AS lc FROM kq JOIN fc c USING (feat) GROUP BY 1, 2), s AS (SELECT qid, key, ln(k) + coalesce(lc, 0) - asked * ln(k) AS p FROM a CROSS JOIN keys LEFT JOIN h USING (qid, key)),
    z AS (SELECT qid, key, round(p - max(p) OVER (PARTITION BY qid), 6) AS score FROM s)
    SELECT qid, key, score FROM z QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, key DESC) <= 20""")
def nb_predict_fallback(spark: SparkSession, d: str) -> DataFrame:
    """The twenty best of all keys, lacking features counted as one, also keys that share no feature."""
    return bayes.fallback_scores(*bayes.train(_observations(spark, d)), _asked(spark, d), 20)


_ASKED = """, q AS (SELECT DISTINCT tid AS qid, fid AS feat FROM fcn WHERE tid % 20 = 0 AND fid IN (SELECT feat FROM fc)), a AS (SELECT qid, count(*) AS asked FROM q GROUP BY qid),
    h AS (SELECT qid, key, count(*) AS n, sum(ln(c.c)) AS lc FROM q JOIN fc c USING (feat) JOIN keys USING (key) GROUP BY 1, 2)"""


@query(_NB + _ASKED + " SELECT qid, key, round(ln(k / (SELECT sum(k) FROM keys)::DOUBLE) + lc - asked * ln(k), 6) AS lp FROM h JOIN a USING (qid) JOIN keys USING (key) WHERE n = asked")
def nb_probabilities(spark: SparkSession, d: str) -> DataFrame:
    """Logarithm of the probability form, for all known features of every twentieth item."""
    return bayes.log_probabilities(*bayes.train(_observations(spark, d)), _asked(spark, d))


@query(_NB + _ASKED + " SELECT qid, key, round(ln(k / (SELECT sum(k) FROM keys)::DOUBLE) + coalesce(lc, 0) - asked * ln(k), 6) AS lp FROM a CROSS JOIN keys LEFT JOIN h USING (qid, key)")
def nb_fallback_probabilities(spark: SparkSession, d: str) -> DataFrame:
    """The same for all keys, lacking features counted as one."""
    return bayes.log_probabilities(*bayes.train(_observations(spark, d)), _asked(spark, d), fallback=True)


_LEAVE = _NB + """, own AS (SELECT tid AS qid, key, sum(n)::BIGINT AS n, count(*) AS mult FROM w WHERE tid % 20 = 0 GROUP BY 1, 2), nw AS (SELECT tid AS qid, count(*) AS n_words FROM w WHERE tid % 20 = 0 GROUP BY 1),
    f2 AS (SELECT tid AS qid, fid AS feat, c AS fq FROM fcn WHERE tid % 20 = 0 QUALIFY c >= floor(max(c) OVER (PARTITION BY tid) * 0.5)),
    hh AS (SELECT qid, f.key, k - coalesce(o.n, 0) AS k, c - coalesce(o.mult, 0) * fq AS c, o.qid IS NOT NULL AS own FROM f2 JOIN fc f USING (feat) JOIN keys USING (key) LEFT JOIN own o USING (qid, key)),
    sc AS (SELECT qid, key, own, count(*) AS m, max(ln(k)) + sum(ln(c) - ln(k)) AS p FROM hh WHERE c > 0 AND k > 0 GROUP BY 1, 2, 3),
    mx AS (SELECT qid, key, own, round(p - max(p) OVER (PARTITION BY qid), 6) AS score FROM (SELECT * FROM sc QUALIFY m = max(m) OVER (PARTITION BY qid))),
    cand AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, key DESC) AS place, key AS word, score, own, n_words FROM mx JOIN nw USING (qid) QUALIFY place <= n_words)"""


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    """(qid, place, word, score, own): the words that the prominent features of an item suggest, its own observations left out."""
    keys, feats = bayes.train(_observations(spark, d))
    named = _named(spark, d).where("tid % 20 = 0")
    own = named.groupBy(F.col("tid").alias("qid"), "key").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("mult"))
    n_words = named.groupBy(F.col("tid").alias("qid")).agg(F.count(F.lit(1)).alias("n_words"))
    mine = _features(spark, d).where("tid % 20 = 0").withColumn("top", F.max("c").over(W.partitionBy("tid"))).where(F.col("c") >= F.floor(F.col("top") * 0.5))
    hits = mine.select(F.col("tid").alias("qid"), F.col("fid").alias("feat"), F.col("c").alias("fq")).join(feats, "feat").join(keys, "key").join(own, ["qid", "key"], "left")
    left = hits.select("qid", "key", (F.col("k") - F.coalesce("n", F.lit(0))).alias("k"), (F.col("c") - F.coalesce("mult", F.lit(0)) * F.col("fq")).alias("c"), F.col("n").isNotNull().alias("own")).where("c > 0 and k > 0")
    per = left.groupBy("qid", "key", "own").agg(F.count(F.lit(1)).alias("m"), (F.max(F.log("k")) + F.sum(F.log("c") - F.log("k"))).alias("p"))
    w = W.partitionBy("qid")
    best = per.withColumn("most", F.max("m").over(w)).where("m = most").withColumn("score", F.round(F.col("p") - F.max("p").over(w), 6))
    place = F.row_number().over(w.orderBy(F.desc("score"), F.desc("key"))).cast("long")
    return best.withColumn("place", place).join(n_words, "qid").where("place <= n_words").select("qid", "place", F.col("key").alias("word"), "score", "own")


@query(_LEAVE + " SELECT qid, place, word, score, own FROM cand")
def naming_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Words for the names of every twentieth item, by a model without that item: as many as its name has."""
    return _candidates(spark, d)


@query(_LEAVE + """, cl AS (SELECT qid, list(word ORDER BY place) AS cs FROM cand GROUP BY qid HAVING NOT bool_or(own AND place = 1)), ow AS (SELECT tid AS qid, item, """ + _WORDS.format("nullif(regexp_extract(item, '([A-Za-z0-9_]+);?$', 1), '')") + """ AS ws FROM its),
    rn AS (SELECT qid, item, cs, list_filter(ws, lambda x: list_contains(cs, x)) AS kp, ws FROM cl JOIN ow USING (qid)),
    nn AS (SELECT qid, item, list_transform(cs, lambda x, i: CASE WHEN list_contains(ws, x) THEN kp[1 + len(list_filter(cs[1:i - 1], lambda y: list_contains(ws, y)))] ELSE x END) AS ns FROM rn)
    SELECT qid, item, array_to_string(list_transform(ns, lambda x, i: CASE WHEN i = 1 THEN x ELSE upper(left(x, 1)) || substr(x, 2) END), '') AS renamed FROM nn""")
def renamed_items(spark: SparkSession, d: str) -> DataFrame:
    """Proposed names of the items whose best word is not their own; words that stay keep the order they had."""
    c = _candidates(spark, d)
    lists = c.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]).alias("cs"), F.max(F.col("own") & (F.col("place") == 1)).alias("right")).where("not right")
    its = m.items(spark, d).select(F.col("tid").alias("qid"), "item", fn.split_words(fn.strip_id(F.col("item"))).alias("ws"))
    both = lists.join(its, "qid").withColumn("kept", F.filter("ws", lambda x: F.array_contains("cs", x)))
    before = lambda i: F.size(F.filter(F.slice("cs", F.lit(1), i), lambda y: F.array_contains("ws", y)))
    words = F.transform("cs", lambda x, i: F.when(F.array_contains("ws", x), F.get("kept", before(i))).otherwise(x))
    return both.select("qid", "item", fn.camel_join(words).alias("renamed"))


@query(_VSM.replace("SELECT a, b, round(dot", ", pairs AS (SELECT a, b, round(dot", 1) + ") SELECT tid, other, sim FROM (SELECT a AS tid, b AS other, sim FROM pairs UNION ALL SELECT b, a, sim FROM pairs) WHERE tid % 20 = 0")
def similar_to_item(spark: SparkSession, d: str) -> DataFrame:
    """For every twentieth item all others that are similar to it."""
    return bayes.cosine_matches(weighed_items(spark, d), F.col("doc") % 20 == 0, 0.7).withColumnRenamed("doc", "tid")


@query(_NB + ", s AS (SELECT key, count(DISTINCT feat) AS n FROM fc GROUP BY key), big AS (SELECT key FROM s WHERE n >= 0.8 * (SELECT max(n) FROM s)) SELECT feat FROM fc WHERE key IN (SELECT key FROM big) GROUP BY feat HAVING count(DISTINCT key) = (SELECT count(*) FROM big)")
def nb_common_features(spark: SparkSession, d: str) -> DataFrame:
    """Features common to the keys with most features."""
    return bayes.common_features(bayes.train(_observations(spark, d))[1], 0.8)


@query(_NB + """, t AS (SELECT feat, sum(c) AS t FROM fc GROUP BY feat) SELECT key, feat, round(c * c / t, 6) AS rank FROM fc JOIN t USING (feat) WHERE c >= 3 QUALIFY row_number() OVER (PARTITION BY key ORDER BY round(c * c / t, 6) DESC, feat) <= 3""")
def nb_key_features(spark: SparkSession, d: str) -> DataFrame:
    """The three features that tell most of each key: count squared over the feature's total."""
    feats = bayes.train(_observations(spark, d))[1]
    total = feats.groupBy("feat").agg(F.sum("c").alias("t"))
    ranked = feats.where("c >= 3").join(total, "feat").select("key", "feat", F.round(F.col("c") * F.col("c") / F.col("t"), 6).alias("rank"))
    return bayes.top_per_group(ranked, "key", 3, F.desc("rank"), "feat")


@query("""SELECT tid, fid, round(exp(-0.4 * abs(d)) * ln(n::DOUBLE / tot) * c / tot, 6) AS score FROM (SELECT c.tid, c.fid, c.c, CAST(split_part(feat, ',', 1) AS BIGINT) AS d, sum(c.c) OVER (PARTITION BY c.fid) AS tot, (SELECT count(*) FROM its) AS n FROM cnt c JOIN fts USING (fid)) WHERE tot > 0
    QUALIFY row_number() OVER (PARTITION BY tid ORDER BY round(exp(-0.4 * abs(d)) * ln(n::DOUBLE / tot) * c / tot, 6) DESC, fid) <= 3""")
def naming_supports(spark: SparkSession, d: str) -> DataFrame:
    """The three strongest supporting features of each item: near, rare and prominent ones first."""
    n = m.items(spark, d).count()
    cnt = m.counts(spark, d)
    dist = m.feats(spark, d).select("fid", F.split("feat", ",")[0].cast("long").alias("d"))
    tot = cnt.groupBy("fid").agg(F.sum("c").alias("tot")).where("tot > 0")
    score = F.round(F.exp(-0.4 * F.abs("d")) * F.log(F.lit(float(n)) / F.col("tot")) * F.col("c") / F.col("tot"), 6)
    return bayes.top_per_group(cnt.join(dist, "fid").join(tot, "fid").select("tid", "fid", score.alias("score")), "tid", 3, F.desc("score"), "fid")


@query("SELECT ntype, ref_name FROM (SELECT ntype, ref_name, count(*) AS n, min(nid) AS first FROM nodes WHERE ntype IS NOT NULL AND left(ref_name, 1) = '$' GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY ntype ORDER BY n DESC, first) = 1")
def default_names(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent variable of every type; the first seen wins ties."""
    n = m.nodes(spark, d).where("ntype is not null and left(ref_name, 1) = '$'").groupBy("ntype", "ref_name").agg(F.count(F.lit(1)).alias("n"), F.min("nid").alias("first"))
    return n.groupBy("ntype").agg(F.max_by("ref_name", F.struct("n", -F.col("first"))).alias("ref_name"))


@query("SELECT tid, count(*) AS n_feats, sum(c)::BIGINT AS total, max(fid) AS last_fid FROM cnt GROUP BY tid")
def features_per_item(spark: SparkSession, d: str) -> DataFrame:
    """Features, counts and last feature of each item."""
    return m.counts(spark, d).groupBy("tid").agg(F.count(F.lit(1)).alias("n_feats"), F.sum("c").alias("total"), F.max("fid").alias("last_fid"))


@query("SELECT abs(CAST(split_part(feat, ',', 1) AS BIGINT)) AS distance, count(*) AS n, sum(c.c)::BIGINT AS total FROM cnt c JOIN fts USING (fid) GROUP BY 1")
def feature_distances(spark: SparkSession, d: str) -> DataFrame:
    """Histogram of feature distances."""
    dist = m.feats(spark, d).select("fid", F.abs(F.split("feat", ",")[0].cast("long")).alias("distance"))
    return m.counts(spark, d).join(dist, "fid").groupBy("distance").agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("total"))


@query("""SELECT word, fid, round(exp(-abs(CAST(split_part(feat, ',', 1) AS BIGINT))) * ln((SELECT count(*) FROM its)::DOUBLE / t) * n, 6) AS score FROM (SELECT w AS word, fid, count(DISTINCT tid) AS n FROM (SELECT tid, fid, unnest(list_distinct(regexp_extract_all(lower(regexp_extract(item, '(\\w+);?$', 1)), '[a-z]+'))) AS w FROM cnt JOIN its USING (tid) WHERE item IS NOT NULL) GROUP BY 1, 2)
    JOIN (SELECT fid, sum(c) AS t FROM cnt GROUP BY fid HAVING sum(c) > 0) USING (fid) JOIN fts USING (fid) QUALIFY row_number() OVER (PARTITION BY word ORDER BY round(exp(-abs(CAST(split_part(feat, ',', 1) AS BIGINT))) * ln((SELECT count(*) FROM its)::DOUBLE / t) * n, 6) DESC, fid) <= 5""")
def word_features(spark: SparkSession, d: str) -> DataFrame:
    """The five features that weigh most for each name word."""
    n = float(m.items(spark, d).count())
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.regexp_extract("item", "(\\w+);?$", 1)), F.lit("[a-z]+"), F.lit(0)))
    named = m.items(spark, d).where("item is not null").select("tid", F.explode(words).alias("word"))
    cnt = m.counts(spark, d)
    per = cnt.join(named, "tid").groupBy("word", "fid").agg(F.count_distinct("tid").alias("n"))
    tot = cnt.groupBy("fid").agg(F.sum("c").alias("t")).where("t > 0")
    dist = m.feats(spark, d).select("fid", F.abs(F.split("feat", ",")[0].cast("long")).alias("d"))
    score = F.round(F.exp(-F.col("d")) * F.log(F.lit(n) / F.col("t")) * F.col("n"), 6)
    return bayes.top_per_group(per.join(tot, "fid").join(dist, "fid").select("word", "fid", score.alias("score")), "word", 5, F.desc("score"), "fid")


@query("""SELECT suffix, count(*) AS n FROM (SELECT mid, array_to_string(ws[k:], ' ') AS suffix, len(ws) - k AS size FROM (SELECT mid, ws, unnest(range(2, len(ws) + 1)) AS k FROM (SELECT mid, list_transform(regexp_extract_all(method_name, '[A-Z]+[a-z]*|[a-z]+'), lambda x: lower(x)) AS ws FROM methods WHERE style <> 'initializer')))
    QUALIFY row_number() OVER (PARTITION BY mid ORDER BY size DESC) = 1 GROUP BY suffix HAVING count(*) >= 2""".replace("SELECT suffix, count(*) AS n FROM (", "SELECT suffix, count(*) AS n FROM (SELECT * FROM (", 1).replace("ORDER BY size DESC) = 1 GROUP BY", "ORDER BY size DESC) = 1) GROUP BY"))
def suffix_groups(spark: SparkSession, d: str) -> DataFrame:
    """Methods that share their longest proper suffix of words."""
    ws = F.transform(fn.split_camel(F.col("method_name")), F.lower)
    own = m.methods(spark, d).where("style <> 'initializer'").select(ws.alias("ws")).where("size(ws) >= 2")
    return own.groupBy(F.array_join(F.slice("ws", F.lit(2), F.size("ws") - 1), " ").alias("suffix")).agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


@query("SELECT new, count(DISTINCT old) AS n FROM (SELECT regexp_extract(ref_name, '([A-Za-z0-9_]+);?$', 1) AS old, ntype AS new FROM nodes WHERE ref_name IS NOT NULL AND ntype IS NOT NULL) GROUP BY new HAVING count(DISTINCT old) >= 2")
def synonyms(spark: SparkSession, d: str) -> DataFrame:
    """Types known under two names or more."""
    own = m.nodes(spark, d).where("ref_name is not null and ntype is not null").select(F.coalesce(fn.strip_id(F.col("ref_name")), F.lit("")).alias("old"), F.col("ntype").alias("new"))
    return own.groupBy("new").agg(F.count_distinct("old").alias("n")).where("n >= 2")


@query("SELECT old, count(DISTINCT new) AS n FROM (SELECT regexp_extract(ref_name, '([A-Za-z0-9_]+);?$', 1) AS old, ntype AS new FROM nodes WHERE ref_name IS NOT NULL AND ntype IS NOT NULL) GROUP BY old HAVING count(DISTINCT new) >= 2")
def homonyms(spark: SparkSession, d: str) -> DataFrame:
    """Names that stand for two types or more."""
    own = m.nodes(spark, d).where("ref_name is not null and ntype is not null").select(F.coalesce(fn.strip_id(F.col("ref_name")), F.lit("")).alias("old"), F.col("ntype").alias("new"))
    return own.groupBy("old").agg(F.count_distinct("new").alias("n")).where("n >= 2")


@query("""SELECT count(*) AS n_common FROM (SELECT tid FROM cnt GROUP BY tid ORDER BY sum(c) DESC, tid LIMIT 100) JOIN (SELECT tid FROM cnt GROUP BY tid ORDER BY count(*) DESC, tid LIMIT 100) USING (tid)""")
def result_overlap(spark: SparkSession, d: str) -> DataFrame:
    """How many items are among the top hundred both by counts and by features."""
    per = m.counts(spark, d).groupBy("tid").agg(F.sum("c").alias("t"), F.count(F.lit(1)).alias("n"))
    return per.orderBy(F.desc("t"), "tid").limit(100).select("tid").intersect(per.orderBy(F.desc("n"), "tid").limit(100).select("tid")).agg(F.count(F.lit(1)).alias("n_common"))


@query("SELECT (SELECT count(*) FROM srcs) AS n_sources, (SELECT count(*) FROM methods) AS n_methods, (SELECT count(*) FROM calls) AS n_calls, (SELECT count(*) FROM nodes) AS n_vertices, (SELECT count(*) FROM links) AS n_links")
def load_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each store."""
    parts = {"n_sources": m.sources(spark, d), "n_methods": m.methods(spark, d), "n_calls": m.nodes(spark, d).where("kind in ('call', 'new') and ndata is not null").select(F.explode(F.split("ndata", " "))), "n_vertices": m.nodes(spark, d), "n_links": m.links(spark, d)}
    rows = None
    for name, df in parts.items():
        one = df.agg(F.lit(name).alias("what"), F.count(F.lit(1)).alias("n"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy().agg(*[F.max(F.when(F.col("what") == p, F.col("n"))).alias(p) for p in parts])


@query("SELECT ref_name, count(DISTINCT nid1) AS n_sources FROM nodes n JOIN links l ON l.nid0 = n.nid WHERE ref_name IS NOT NULL GROUP BY ref_name HAVING count(DISTINCT nid1) >= 2")
def source_sets(spark: SparkSession, d: str) -> DataFrame:
    """References fed by two nodes or more."""
    return m.nodes(spark, d).where("ref_name is not null").join(m.links(spark, d), F.col("nid") == F.col("nid0")).groupBy("ref_name").agg(F.count_distinct("nid1").alias("n_sources")).where("n_sources >= 2")


@query("SELECT mid, round((row_number() OVER (ORDER BY n DESC, mid) - 1)::DOUBLE / count(*) OVER (), 6) AS rank FROM (SELECT mid, count(*) AS n FROM nodes WHERE mid IS NOT NULL GROUP BY mid)")
def relative_rank(spark: SparkSession, d: str) -> DataFrame:
    """Relative rank of methods by size: place among all, divided by their number."""
    per = m.nodes(spark, d).where("mid is not null").groupBy("mid").agg(F.count(F.lit(1)).alias("n"))
    total = per.count()
    return ranked(per, "n", "mid").select("mid", F.round((F.col("place") - 1) / F.lit(total), 6).alias("rank"))


@query("""SELECT mid, n FROM (SELECT *, row_number() OVER (ORDER BY n DESC, mid) - 1 AS k, count(*) OVER () AS total FROM (SELECT mid, count(*) AS n FROM nodes WHERE mid IS NOT NULL GROUP BY mid)) WHERE k IN (SELECT (i * total) // 50 FROM range(50) t(i))""")
def systematic_sample(spark: SparkSession, d: str) -> DataFrame:
    """Fifty methods at equal distances in the order of their size."""
    per = m.nodes(spark, d).where("mid is not null").groupBy("mid").agg(F.count(F.lit(1)).alias("n"))
    total = per.count()
    wanted = F.array(*[F.lit(i * total // 50) for i in range(50)])
    return ranked(per, "n", "mid").where(F.array_contains(wanted, (F.col("place") - 1).cast("int"))).select("mid", "n")


def ranked(df: DataFrame, value: str, key: str) -> DataFrame:
    """``df`` with ``place``, its row number by descending value: sorted over all tasks, numbered by per-task offsets."""
    spread = cut(df.repartitionByRange(F.desc(value), F.col(key)).withColumn("__part", F.spark_partition_id()))
    numbered = spread.withColumn("__nth", F.row_number().over(W.partitionBy("__part").orderBy(F.desc(value), key)))
    sizes = numbered.groupBy("__part").agg(F.max("__nth").alias("__size"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__size").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("__part", "__before")
    return numbered.join(F.broadcast(before), "__part").withColumn("place", F.col("__nth") + F.col("__before")).drop("__part", "__nth", "__before")


@query("SELECT bin, tid FROM (SELECT CAST(floor(ln(t + 1) * 2) AS BIGINT) AS bin, tid, t FROM (SELECT tid, sum(c) AS t FROM cnt GROUP BY tid)) QUALIFY row_number() OVER (PARTITION BY bin ORDER BY t DESC, tid) = 1")
def one_per_bin(spark: SparkSession, d: str) -> DataFrame:
    """One item per bin of its logarithmic count."""
    per = m.counts(spark, d).groupBy("tid").agg(F.sum("c").alias("t")).withColumn("bin", F.floor(F.log(F.col("t") + 1) * 2))
    return per.groupBy("bin").agg(F.min_by("tid", F.struct(-F.col("t"), "tid")).alias("tid"))


@query("SELECT event_type, user_id, n FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) <= 3")
def top_per_group(spark: SparkSession, d: str) -> DataFrame:
    """The three users with most events of each type."""
    per = spark.read.parquet(f"{d}/events.parquet").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))
    return bayes.top_per_group(per, "event_type", 3, F.desc("n"), "user_id")


@query("SELECT reponame, branchname, count(*) AS n FROM srcs GROUP BY 1, 2")
def sources_by_branch(spark: SparkSession, d: str) -> DataFrame:
    """Files per repository and branch."""
    return m.sources(spark, d).groupBy("reponame", "branchname").agg(F.count(F.lit(1)).alias("n"))
