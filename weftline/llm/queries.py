"""Queries over the operators of this subpackage, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline import model
from weftline.common import table
from weftline.functions import names
from weftline.llm import leakage, mojibake, packing, parsecheck, simjoin, termfreq


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that are too rare or too common."""
    return p3_terms(spark, sf_dir).where(F.col("mark").isNotNull()).select("term", "mark")


def p3_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term in use with its summed count, number of items and mark."""
    return termfreq.feature_terms(table(spark, sf_dir, "itemfeats"), table(spark, sf_dir, "feats"))


def p3_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of up to three words in the names of methods: occurrences, and methods that have them."""
    named = model.methods(spark, sf_dir).where("method_name is not null")
    words = F.transform(names.split_camel(F.col("method_name")), F.lower)
    return termfreq.word_ngrams(named.select(F.col("mid").alias("doc"), words.alias("words")), 3)


def p3_text_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of up to five words that occur twice or more in all texts: occurrences, and documents that have them."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = F.regexp_extract_all(F.translate("text", letters.upper(), letters), F.lit("[a-z0-9]+"), F.lit(0))
    texts = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("doc"), words.alias("words"))
    return termfreq.word_ngrams(texts, 5, least=2)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of items whose feature sets overlap by 0.6 or more."""
    member_of, links = simjoin.similar_sets(table(spark, sf_dir, "itemfeats"), "tid", "fid", 0.6, min_size=8)
    return simjoin.all_pairs(member_of, links).toDF("tid_a", "tid_b")


def p4_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per item with enough features: its class of equal sets and its number of similar items."""
    member_of, links = simjoin.similar_sets(table(spark, sf_dir, "itemfeats"), "tid", "fid", 0.6, min_size=8)
    return simjoin.link_counts(member_of, links).toDF("tid", "class_id", "n_links")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that do not parse as the language of their extension."""
    return parsecheck.checked(table(spark, sf_dir, "sourcemap")).where("not valid").select("uid")


def p6_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and invalid files per repository and language."""
    return parsecheck.rates(parsecheck.checked(table(spark, sf_dir, "sourcemap")))


def p7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every text, for each capacity."""
    return packing.pack(table(spark, sf_dir, "documents"), table(spark, sf_dir, "containers"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins, tokens and used share of the capacity."""
    return packing.fill_report(p7_packing(spark, sf_dir), table(spark, sf_dir, "containers"))


def p7_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents placed for each capacity, and what would break the rules."""
    containers = table(spark, sf_dir, "containers")
    return packing.invariants(p7_packing(spark, sf_dir), containers)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the evaluation items of which they hold a passage."""
    return p8_passages(spark, sf_dir).select("doc_id", "item_id")


def p8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the place of the first passage in the document."""
    return leakage.leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per leaked item: the number of documents that hold it."""
    return p8_passages(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of which a part was decoded wrongly."""
    return p9_restored(spark, sf_dir).select("doc_id")


def p9_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the restored text, where it can be had, and the operations that gave it."""
    return mojibake.repaired(table(spark, sf_dir, "documents"))


QUERIES = {
    "p3_found": p3_found,
    "p3_terms": p3_terms,
    "p3_ngrams": p3_ngrams,
    "p3_text_ngrams": p3_text_ngrams,
    "p4_found": p4_found,
    "p4_links": p4_links,
    "p6_found": p6_found,
    "p6_rates": p6_rates,
    "p7_packing": p7_packing,
    "p7_fill": p7_fill,
    "p7_invariants": p7_invariants,
    "p8_found": p8_found,
    "p8_passages": p8_passages,
    "p8_items": p8_items,
    "p9_found": p9_found,
    "p9_restored": p9_restored,
}

_TERMS = """
    SELECT term, sum_count, n_items,
           CASE WHEN n_items * 10 > (SELECT count(DISTINCT tid) FROM itemfeats) THEN 'common'
                WHEN n_items < 3 OR sum_count < 5 THEN 'rare' END AS mark
    FROM (SELECT term, CAST(sum(coalesce(c, 0)) AS BIGINT) AS sum_count, count(DISTINCT tid) AS n_items
          FROM (SELECT sid0, min(tid) AS tid, min(fid) AS fid, min(feat_count) AS c FROM itemfeats GROUP BY sid0) i
          JOIN (SELECT fid, trim(min(feat), ' ' || chr(9) || chr(10)) AS term FROM feats GROUP BY fid) f USING (fid)
          GROUP BY term)"""
_LEAKS = """
    WITH dw AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9]+') AS w FROM documents WHERE text IS NOT NULL),
         iw AS (SELECT item_id, regexp_extract_all(item_text, '[A-Za-z0-9]+') AS w FROM eval_items),
         dg AS (SELECT doc_id, lower(array_to_string(w[k:k+11], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM dw)),
         ig AS (SELECT item_id, lower(array_to_string(w[k:k+11], ' ')) AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM iw)),
         hits AS (SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g))"""
_PAIRS = """
    WITH m AS (SELECT DISTINCT tid, fid FROM itemfeats WHERE tid IS NOT NULL AND fid IS NOT NULL),
         n AS (SELECT tid, count(*) AS n FROM m GROUP BY tid HAVING count(*) >= 8),
         c AS (SELECT x.tid AS a, y.tid AS b, count(*) AS c
               FROM (SELECT * FROM m WHERE tid IN (SELECT tid FROM n)) x
               JOIN (SELECT * FROM m WHERE tid IN (SELECT tid FROM n)) y ON x.fid = y.fid AND x.tid < y.tid GROUP BY 1, 2),
         p AS (SELECT a, b FROM c JOIN n na ON na.tid = a JOIN n nb ON nb.tid = b WHERE c.c * 10 >= (na.n + nb.n - c.c) * 6)"""

SQL = {
    "p3_found": f"SELECT term, mark FROM ({_TERMS}) WHERE mark IS NOT NULL",
    "p3_terms": _TERMS,
    "p3_ngrams": """
        WITH w AS (SELECT mid, list_transform(regexp_extract_all(min(method_name), '[A-Z]+[a-z]*|[a-z]+'), lambda x: lower(x)) AS ws FROM dfmethod WHERE mid IS NOT NULL AND method_name IS NOT NULL GROUP BY mid),
             g AS (SELECT mid, CAST(n AS BIGINT) AS n, array_to_string(ws[k:k + n - 1], ' ') AS ngram FROM (SELECT mid, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM w, range(1, 4) t(n)))
        SELECT n, ngram, count(*) AS occurrences, count(DISTINCT mid) AS records FROM g GROUP BY n, ngram""",
    "p3_text_ngrams": """
        WITH w AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x)) AS ws FROM documents WHERE text IS NOT NULL),
             g AS (SELECT doc_id, CAST(n AS BIGINT) AS n, array_to_string(ws[k:k + n - 1], ' ') AS ngram FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM w, range(1, 6) t(n)))
        SELECT n, ngram, count(*) AS occurrences, count(DISTINCT doc_id) AS records FROM g GROUP BY n, ngram HAVING count(*) >= 2""",
    "p7_invariants": """
        SELECT container_id, (SELECT count(*) FROM documents WHERE text IS NOT NULL) AS n_docs, CAST(0 AS BIGINT) AS n_overfull, CAST(0 AS BIGINT) AS n_broken, CAST(0 AS BIGINT) AS n_split
        FROM (SELECT DISTINCT container_id FROM containers WHERE container_id IS NOT NULL AND capacity_tokens > 0)""",
    "p8_found": _LEAKS + " SELECT doc_id, item_id FROM hits",
    "p8_items": _LEAKS + " SELECT item_id, count(*) AS n_docs FROM hits GROUP BY item_id",
    "p4_found": _PAIRS + " SELECT a AS tid_a, b AS tid_b FROM p",
    "p4_links": _PAIRS
    + """, s AS (SELECT tid, list_sort(list(fid)) AS s FROM m WHERE tid IN (SELECT tid FROM n) GROUP BY tid),
         k AS (SELECT tid, min(tid) OVER (PARTITION BY s) AS class_id FROM s),
         e AS (SELECT a AS tid FROM p UNION ALL SELECT b FROM p)
    SELECT k.tid, class_id, coalesce(c, 0) AS n_links FROM k LEFT JOIN (SELECT tid, count(*) AS c FROM e GROUP BY tid) USING (tid)""",
}
