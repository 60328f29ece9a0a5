"""Naive-Bayes counts and scores, and vector-space similarity, as joins and aggregates."""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.common import cut, lookup_join
from weftline.operators import graph, slices


def train(observations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Key totals (key, k) and feature counts (feat, key, c) of (key, feat, w) rows.

    A negative weight takes an observation back; counts that reach 0 are gone. A row with a null feature counts for its
    key alone.
    """
    keys = observations.where("feat is null").groupBy("key").agg(F.sum("w").alias("k")).where("k > 0")
    feats = observations.where("feat is not null").groupBy("feat", "key").agg(F.sum("w").alias("c")).where("c > 0")
    return keys, feats


def strict_scores(keys: DataFrame, feats: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, key, score, n): only the keys that share most features with the query; the best score is 0.

    ``queries`` has rows (qid, feat). score = ln k + sum(ln c - ln k), less the query's greatest.
    """
    hits = queries.select("qid", "feat").distinct().join(feats, "feat").join(keys, "key")
    per = hits.groupBy("qid", "key").agg(F.count(F.lit(1)).alias("n"), (F.max(F.log("k")) + F.sum(F.log("c") - F.log("k"))).alias("p"))
    most = per.groupBy("qid").agg(F.max("n").alias("most"))
    kept = per.join(most, "qid").where("n = most")
    best = kept.groupBy("qid").agg(F.max("p").alias("best"))
    return kept.join(best, "qid").select("qid", "key", F.round(F.col("p") - F.col("best"), 6).alias("score"), "n")


def _all_keys(asked: DataFrame, keys: DataFrame, blocks: int = 64) -> DataFrame:
    """The queries with every key: a stated set against all keys, in blocks of the queries."""
    spread = asked.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int"))
    return spread.join(keys.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))), "block").drop("block")


def fallback_scores(keys: DataFrame, feats: DataFrame, queries: DataFrame, top: int | None = None) -> DataFrame:
    """(qid, key, score): every key; a known feature that the key lacks counts as one, so it adds -ln k.

    score = ln k + the sum over the known features of ln c - ln k, less the query's greatest. A query without a known
    feature ranks the keys by k alone. ``top`` keeps the best keys of a query, of equal scores the greatest keys.
    """
    known = queries.select("qid", "feat").distinct().join(feats.select("feat").distinct(), "feat", "left_semi")
    asked = queries.select("qid").distinct().join(known.groupBy("qid").agg(F.count(F.lit(1)).alias("asked")), "qid", "left").select("qid", F.coalesce("asked", F.lit(0)).alias("asked"))
    hits = known.join(feats, "feat").groupBy("qid", "key").agg(F.sum(F.log("c")).alias("lc"))
    per = _all_keys(asked, keys).join(hits, ["qid", "key"], "left")
    scored = per.select("qid", "key", (F.log("k") + F.coalesce("lc", F.lit(0.0)) - F.col("asked") * F.log("k")).alias("p"))
    best = scored.groupBy("qid").agg(F.max("p").alias("best"))
    out = scored.join(best, "qid").select("qid", "key", F.round(F.col("p") - F.col("best"), 6).alias("score"))
    return out if top is None else top_per_group(out, "qid", top, F.desc("score"), F.desc("key"))


def log_probabilities(keys: DataFrame, feats: DataFrame, queries: DataFrame, fallback: bool = False) -> DataFrame:
    """(qid, key, lp): the logarithm of the key's share of all keys times c / k of every known feature, which cannot underflow.

    A key that lacks a feature is left out, or with ``fallback`` counts it as 1 / k; then every key has a row for every query
    with a known feature.
    """
    total = keys.agg(F.sum("k")).first()[0] or 1
    known = queries.select("qid", "feat").distinct().join(feats.select("feat").distinct(), "feat", "left_semi")
    asked = known.groupBy("qid").agg(F.count(F.lit(1)).alias("asked"))
    hits = known.join(feats, "feat").join(keys, "key").groupBy("qid", "key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.log("c")).alias("lc"))
    if fallback:
        per = _all_keys(asked, keys).join(hits, ["qid", "key"], "left")
    else:
        per = hits.join(asked, "qid").where("n = asked").join(keys, "key")
    lp = F.log(F.col("k") / F.lit(float(total))) + F.coalesce("lc", F.lit(0.0)) - F.col("asked") * F.log("k")
    return per.select("qid", "key", F.round(lp, 6).alias("lp"))


def common_features(feats: DataFrame, ratio: float) -> DataFrame:
    """Features common to all keys that have at least ``ratio`` times the greatest number of features."""
    sizes = feats.groupBy("key").agg(F.count_distinct("feat").alias("n"))
    kept = sizes.join(F.broadcast(sizes.agg(F.max("n").alias("top"))), F.col("n") >= F.lit(ratio) * F.col("top"), "left_semi")
    n = kept.count()
    return feats.join(kept, "key", "left_semi").groupBy("feat").agg(F.count_distinct("key").alias("keys")).where(F.col("keys") == n).select("feat")


def idf(docs: DataFrame) -> DataFrame:
    """(feat, df, idf) of (doc, feat, w): ln(documents / df), 0 for a feature of a single document."""
    n = docs.select("doc").distinct().count()
    return docs.groupBy("feat").agg(F.count_distinct("doc").alias("df")).withColumn("idf", F.when(F.col("df") <= 1, 0.0).otherwise(F.log(F.lit(float(max(n, 1))) / F.col("df"))))


def weighted(docs: DataFrame) -> DataFrame:
    """(doc, feat, x): tf-idf weights that are not 0."""
    return docs.join(idf(docs).select("feat", "idf"), "feat").select("doc", "feat", (F.col("w") * F.col("idf")).alias("x")).where("x <> 0")


def _levels(df: np.ndarray) -> np.ndarray:
    """Steps of document frequency, two to a doubling."""
    return np.floor(2 * np.log2(df)).astype(np.int64)


def _vectors(rows, threshold: float) -> SimpleNamespace:
    """The documents of an Arrow table (doc, v) as unit vectors, with the features of each that are in the index.

    ``rest`` is the length of what is not, ``split`` the document frequency of the first feature that is, ``over`` the length of
    the features of a level of frequency or above.
    """
    lists = rows["v"].combine_chunks() if isinstance(rows["v"], pa.ChunkedArray) else rows["v"]
    n, flat = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten()
    feat, df, x = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("feat", "df", "x"))
    row = np.repeat(np.arange(len(n)), n)
    u = x / np.sqrt(np.bincount(row, x * x, len(n)))[row]
    order, sq = np.lexsort([feat, -df, row]), u * u
    run = np.cumsum(sq[order])
    ahead = run - np.concatenate([[0.0], run])[np.cumsum(n) - n][row]
    indexed = np.zeros(len(u), dtype=bool)
    indexed[order] = ahead >= (threshold - 1e-5) ** 2
    level = _levels(df)
    width = int(level.max(initial=0)) + 2  # nothing is of the last level
    over = np.bincount(row * width + level, sq, len(n) * width).reshape(len(n), width)[:, ::-1].cumsum(axis=1)[:, ::-1]
    split = np.zeros(len(n), dtype=np.int64)
    np.maximum.at(split, row[indexed], df[indexed])
    rest = np.sqrt(np.bincount(row[~indexed], sq[~indexed], len(n)))
    return SimpleNamespace(doc=slices.column(rows, "doc"), n=n, first=np.cumsum(n) - n, row=row, feat=feat, u=u, indexed=indexed, over=np.sqrt(over), split=split, level=_levels(np.maximum(split, 1)), rest=rest)


def _index(rows, threshold: float) -> SimpleNamespace:
    """A slice of documents in their order, and its indexed entries by feature and document; no more than the tasks need, as each gets it."""
    v = _vectors(rows.take(np.argsort(slices.column(rows, "doc"), kind="stable")), threshold)
    known, code = np.unique(v.feat, return_inverse=True)
    at = np.flatnonzero(v.indexed)
    at = at[np.argsort(code[at], kind="stable")]
    kept = {k: getattr(v, k) for k in ("doc", "n", "first", "u", "over", "split", "level", "rest")}
    return SimpleNamespace(**kept, known=known, code=code.astype(np.int32), line=v.row[at].astype(np.int32), w=v.u[at], listed=code[at] * len(v.doc) + v.row[at])


def _candidates(v: SimpleNamespace, s: SimpleNamespace, threshold: float, ordered: bool):
    """(i, j, shared) in the order of i: documents that can reach the threshold, with their product over the indexed features.

    With ``ordered`` the pairs whose i-th document is less than the j-th of the slice, else all pairs of two documents.
    """
    at, m = np.flatnonzero(v.indexed), len(s.doc)
    bits = m.bit_length()
    code = v.code[at]
    ahead = np.searchsorted(s.doc, v.doc, side="right")[v.row[at]] if ordered else 0
    lo = np.searchsorted(s.listed, np.where(code < 0, 0, code * m + ahead))
    n = np.where(code < 0, 0, np.searchsorted(s.listed, (code + 1) * m) - lo)
    # the indexed entries of the documents stand in the order of their rows
    begins = np.searchsorted(v.row[at], np.arange(len(v.doc) + 1))
    for d0, d1 in slices.portions(np.bincount(v.row[at], n, len(v.doc)), slices.HELD):
        e0, e1 = begins[d0], begins[d1]
        of, place = slices.spread(lo[e0:e1], n[e0:e1])
        if not len(of):
            continue
        pair, w = (v.row[at[e0:e1]] << bits)[of] | s.line[place], v.u[at[e0:e1]][of] * s.w[place]
        order = np.argsort(pair)
        pair, w = pair[order], w[order]
        starts = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        shared = np.add.reduceat(w, starts)
        pair = pair[starts]
        i, j = pair >> bits, pair & ((1 << bits) - 1)
        # ahead of the later split, the one vector has its rest and the other no more than its common features
        mine = v.rest[i] * s.over[j, np.minimum(v.level[i], s.over.shape[1] - 1)]
        other = s.rest[j] * v.over[i, np.minimum(s.level[j], v.over.shape[1] - 1)]
        left = np.where(v.split[i] < s.split[j], mine, np.where(s.split[j] < v.split[i], other, np.maximum(mine, other)))
        can = shared + left >= threshold - 1e-5
        if not ordered:
            can &= v.doc[i] != s.doc[j]
        yield i[can], j[can], shared[can]


def _products(v: SimpleNamespace, s: SimpleNamespace, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The products over all features of the pairs (i, j), which are in the order of i."""
    out, column = np.zeros(len(i)), np.zeros(len(s.known), dtype=np.int64)
    begins = np.concatenate([[True], i[1:] != i[:-1]]) if len(i) else np.zeros(0, dtype=bool)
    for p0, p1 in slices.portions(s.n[j] + begins * (slices.HELD // 128), slices.HELD):
        docs, line = np.unique(i[p0:p1], return_inverse=True)
        of, place = slices.spread(v.first[docs], v.n[docs])
        of, place = of[v.code[place] >= 0], place[v.code[place] >= 0]
        mine = np.unique(v.code[place])
        column[mine] = np.arange(1, len(mine) + 1)  # column 0 is of features that none of them has
        table = np.zeros((len(docs), len(mine) + 1))
        table[of, column[v.code[place]]] = v.u[place]
        of, place = slices.spread(s.first[j[p0:p1]], s.n[j[p0:p1]])
        x = table.ravel()[(line * table.shape[1])[of] + column[s.code[place]]] * s.u[place]
        out[p0:p1] = np.add.reduceat(x, np.cumsum(s.n[j[p0:p1]]) - s.n[j[p0:p1]])
        column[mine] = 0
    return out


def _read(batch, s: SimpleNamespace, threshold: float) -> SimpleNamespace:
    """A batch's documents, with the places of their features in the slice, -1 for those it lacks."""
    v = _vectors(batch, threshold)
    code = np.searchsorted(s.known, v.feat).clip(max=len(s.known) - 1)
    v.code = np.where(s.known[code] == v.feat, code, -1)
    return v


def _meet(batches, s: SimpleNamespace, threshold: float, ordered: bool = True):
    """The pairs of a batch's documents and those of the slice that can reach the threshold, with their whole products."""
    for batch in batches:
        if not (len(batch) and len(s.doc)):
            continue
        v = _read(batch, s, threshold)
        for i, j, _ in _candidates(v, s, threshold, ordered):
            dot = _products(v, s, i, j)
            can = dot >= threshold - 1e-5
            yield pa.RecordBatch.from_arrays([pa.array(v.doc[i[can]]), pa.array(s.doc[j[can]]), pa.array(dot[can])], names=["a", "b", "dot"])


def _joined(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least node of each node's component, once x and y are joined."""
    while True:
        p, q = root[x], root[y]
        apart = p != q
        if not apart.any():
            return root
        x, y = x[apart], y[apart]
        np.minimum.at(root, np.maximum(p, q)[apart], np.minimum(p, q)[apart])
        while ((up := root[root]) != root).any():
            root = up


def _grouped(batches, s: SimpleNamespace, threshold: float):
    """(src, dst): stars with the components of the pairs that ``_meet`` finds; pairs inside a component that is known are not scored."""
    m = len(s.doc)
    root = np.arange(m)
    for batch in batches:
        if not (len(batch) and m):
            continue
        v = _read(batch, s, threshold)
        at = np.searchsorted(s.doc, v.doc).clip(max=m - 1)
        own = s.doc[at] == v.doc
        root = np.concatenate([root, np.where(own, root[at], np.arange(m, m + len(v.doc)))])
        for i, j, shared in _candidates(v, s, threshold, True):
            # of each document the likeliest first, then all that are still apart
            order = np.lexsort([-shared, i])
            best = order[np.concatenate([[True], i[order][1:] != i[order][:-1]])] if len(i) else order
            for k in (best, None):
                k = np.flatnonzero(root[m + i] != root[j]) if k is None else k
                found = k[np.round(_products(v, s, i[k], j[k]), 6) >= threshold]
                root = _joined(root, np.where(own, at, np.arange(m, m + len(v.doc)))[i[found]], j[found])
        # a component with a pair has a document of the slice, and the least node is one
        met = np.flatnonzero(~own & (root[m:] < m))
        yield pa.RecordBatch.from_arrays([pa.array(v.doc[met]), pa.array(s.doc[root[m + met]])], names=["src", "dst"])
        root = root[:m]
    k = np.flatnonzero(root != np.arange(m))
    yield pa.RecordBatch.from_arrays([pa.array(s.doc[k]), pa.array(s.doc[root[k]])], names=["src", "dst"])


def _rows(docs: DataFrame) -> tuple[DataFrame, int]:
    """(doc, v), the tf-idf weights of each document by feature, and the number of all."""
    n = docs.select("doc").distinct().count()
    # what occurs once weighs nothing
    freq = docs.groupBy("feat").agg(F.count_distinct("doc").alias("docs")).where(F.col("docs") > 1)
    x = lookup_join(docs, freq, "feat").select("doc", "feat", (F.col("w") * F.log(F.lit(float(max(n, 1))) / F.col("docs"))).alias("x"), F.col("docs").alias("df")).where("x <> 0")
    v = F.array_sort(F.collect_list(F.struct("feat", "df", "x")))
    rows = cut(x.groupBy("doc").agg(v.alias("v")))
    return rows, _entries(rows)


def _entries(rows: DataFrame) -> int:
    return rows.agg(F.sum(F.size("v"))).first()[0] or 0


def cosine_pairs(docs: DataFrame, threshold: float, slice_entries: int = slices.SLICE_ENTRIES) -> DataFrame:
    """(a, b, sim), a < b, of all documents with tf-idf cosine at or above ``threshold`` (rounded to six places).

    Of every document, its features from the most common on stay out of the index as long as they together weigh less
    than the threshold: a pair that shares no indexed feature cannot reach it, as the rest of one of them is too short.
    So hot features pair hardly any documents, and no pair is lost. The documents meet slices of themselves; the products over the
    indexed features and a bound for the rest leave few pairs, which are scored on all features where they are found.
    """
    rows, entries = _rows(docs)
    found = slices.against(rows, rows, "doc", entries, lambda t: _index(t, threshold), lambda b, s: _meet(b, s, threshold), "a bigint, b bigint, dot double", slice_entries)
    return found.select("a", "b", F.round("dot", 6).alias("sim")).where(F.col("sim") >= threshold)


def cosine_matches(docs: DataFrame, asked: Column, threshold: float, slice_entries: int = slices.SLICE_ENTRIES) -> DataFrame:
    """(doc, other, sim): the pairs of ``cosine_pairs`` from the side of each document for which ``asked`` holds.

    Only these documents are sliced, so all others meet them alone.
    """
    rows, _ = _rows(docs)
    side = rows.where(asked)
    found = slices.against(rows, side, "doc", _entries(side), lambda t: _index(t, threshold), lambda b, s: _meet(b, s, threshold, False), "a bigint, b bigint, dot double", slice_entries)
    return found.select(F.col("b").alias("doc"), F.col("a").alias("other"), F.round("dot", 6).alias("sim")).where(F.col("sim") >= threshold)


def cosine_groups(docs: DataFrame, threshold: float, slice_entries: int = slices.SLICE_ENTRIES) -> DataFrame:
    """(node, cid): components of the pairs of ``cosine_pairs``; cid is the least document.

    The pairs are joined where they are found, and only the components of a task and a slice leave it. One slice is held at a time.
    """
    rows, entries = _rows(docs)
    links = None
    for found in slices.one_by_one(rows, rows, "doc", entries, lambda t: _index(t, threshold), lambda b, s: _grouped(b, s, threshold), "src bigint, dst bigint", slice_entries):
        links = found if links is None else cut(graph.components(links.unionByName(found)).toDF("src", "dst"))
    return graph.components(links)


def top_per_group(df: DataFrame, by: str, k: int, *order) -> DataFrame:
    """The first ``k`` rows per group; the orders must be total."""
    return df.withColumn("__rank", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("__rank") <= k).drop("__rank")
