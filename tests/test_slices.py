"""Joins by slices: results against plain Python, and what they write to disk."""

import math
import random
import time
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from weftline import common
from weftline.llm import simjoin
from weftline.operators import bayes, graph, matching, slices
from weftline.plans import graphs, words


def shuffled(spark) -> int:
    """Bytes of shuffles that the application has written so far."""
    time.sleep(1)
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    return sum(executors.apply(k).totalShuffleWrite() for k in range(executors.size()))


def test_cosine_pairs_stay_in_their_tasks(spark):
    # 1,500 documents share a rare feature of little weight each with 100 others: some 300,000 pairs meet
    rnd = random.Random(3)
    rows = {(d, f"c{d % 15}"): 1 for d in range(1500)} | {(d, f"m{rnd.randrange(60)}"): 2 for d in range(1500) for _ in range(4)}
    for d in range(0, 50, 10):
        rows |= {(d + 1, f): w for (e, f), w in list(rows.items()) if e == d}
        rows = {k: w for k, w in rows.items() if k[0] != d + 1 or (d, k[1]) in rows}
    df = spark.createDataFrame([(d, f, w) for (d, f), w in rows.items()], "doc bigint, feat string, w bigint").coalesce(2)
    n, docs = 1500, {}
    freq = {}
    for _, f in rows:
        freq[f] = freq.get(f, 0) + 1
    for (d, f), w in rows.items():
        if freq[f] > 1:
            docs.setdefault(d, {})[f] = w * math.log(n / freq[f])
    norm = {d: math.sqrt(sum(x * x for x in v.values())) for d, v in docs.items()}
    want = {}
    for a in docs:
        for b in docs:
            if a < b and (common := docs[a].keys() & docs[b].keys()) and (sim := sum(docs[a][f] * docs[b][f] for f in common) / norm[a] / norm[b]) > 0.69:
                want[a, b] = sim
    before = shuffled(spark)
    got = {(r.a, r.b): r.sim for r in bayes.cosine_pairs(df, 0.7).collect()}
    assert shuffled(spark) - before < 800_000
    few = {(r.a, r.b): r.sim for r in bayes.cosine_pairs(df, 0.7, slice_entries=900).collect()}
    assert got == few and got.keys() == {p for p, s in want.items() if round(s, 6) >= 0.7} and len(got) >= 5
    assert all(abs(s - want[p]) < 1e-5 for p, s in got.items())


def test_path_votes_stay_in_their_tasks(spark):
    # 400 methods of 5 nodes, the paths of each node out of 30 common ones: any two methods share some
    rnd = random.Random(4)
    rows = sorted({(f"p{rnd.randrange(30)}", rnd.choice([1, 2, 3]), m, m * 10 + rnd.randrange(5)) for m in range(400) for _ in range(10)})
    rows += [("p1", 2, None, 7)]
    ix = spark.createDataFrame(rows, "path string, size bigint, mid bigint, nid bigint").coalesce(2)
    at = {}
    for p, k, m, n in rows:
        if k >= 2 and m is not None:
            at.setdefault(m, {}).setdefault((p, k), set()).add(n)
    want = set()
    for q in range(0, 400, 20):
        for m in at:
            common = at.get(q, {}).keys() & at[m].keys()
            asked, found = ({n for p in common for n in at[x].get(p, ())} for x in (q, m))
            if m != q and len(asked) >= 2 and len(found) >= 2 and (depth := max(k for _, k in common)) >= 3:
                want.add((q, m, len(asked), len(found), depth))
    before = shuffled(spark)
    got = [tuple(r) for r in graph.path_votes(ix.where("mid % 20 = 0"), ix, 2, 3).collect()]
    assert shuffled(spark) - before < 80_000
    assert set(got) == want and len(got) == len(want) > 100
    few = [tuple(r) for r in graph.path_votes(ix.where("mid % 20 = 0"), ix, 2, 3, slice_entries=50).collect()]
    assert sorted(few) == sorted(got)


def test_methods_with_many_meetings(monkeypatch):
    rnd = np.random.default_rng(5)
    s = graph._asked(*(rnd.integers(0, k, 300) for k in (20, 8, 60, 4)))
    rows = np.unique(np.stack([rnd.integers(0, 6, 400), rnd.integers(0, 20, 400), rnd.integers(0, 90, 400)]), axis=1)
    whole = [r for b in graph._voted(*rows, s, 2) for r in zip(*b.to_pydict().values())]
    monkeypatch.setattr(slices, "HELD", 300)
    assert sorted(r for b in graph._voted(*rows, s, 2) for r in zip(*b.to_pydict().values())) == sorted(whole) and whole


def test_a_cut_leaves_no_shuffle_files(spark):
    def files() -> set[str]:
        return {p.name for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs() for p in Path(d.getPath()).rglob("shuffle_*.data")}

    before, setting = files(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    df = common.cut(spark.range(1000).selectExpr("id % 10 as k", "id").groupBy("k").sum("id"))
    assert not files() - before and df.count() == 10
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == setting


def test_candidates_below_the_threshold_are_not_written(spark):
    # 600 sets that share half of their members: many pairs meet in a band, few of them are alike
    rnd = random.Random(8)
    sets = {k: sorted(rnd.sample(range(14), 7)) + [100 + k * 10 + j for j in range(5)] for k in range(600)}
    sets |= {k + 600: sets[k][:-1] + [-k] for k in range(5)}
    df = spark.createDataFrame([(k, m) for k, v in sets.items() for m in v], "id bigint, m bigint")
    reps = common.cut(simjoin.sets_of(df, "id", "m"))
    jaccard = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    want = {(a, b) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) >= 0.6}
    before = shuffled(spark)
    got = {(r.a, r.b) for r in simjoin.similar_reps(reps, 0.6, bands=256, rows=2, bucket_cap=1000).collect()}
    assert shuffled(spark) - before < 2_800_000
    assert got == want and len(got) >= 5
    exact = {(r.a, r.b) for r in simjoin.prefix_pairs(reps, 0.6).collect()}
    assert exact >= want


def test_roots_of_large_methods_are_no_more_than_their_partners(spark):
    # method 0 has 3,000 nodes of two keys, 60 others have four nodes each: two that feed a third, and one of another key
    rows = [(k, 0, "xy"[k % 2]) for k in range(3000)] + [(10_000 + m * 10 + k, m, "xxyz"[k]) for m in range(1, 61) for k in range(4)]
    links = [(k, k + 1, "") for k in range(0, 2998, 4)] + [(10_000 + m * 10 + 2, 10_000 + m * 10 + k, "") for m in range(1, 61) for k in (0, 1)]
    n = spark.createDataFrame(rows, "nid bigint, mid bigint, key string").coalesce(2)
    e = spark.createDataFrame(links, "nid0 bigint, nid1 bigint, label string").coalesce(2)
    pairs = spark.createDataFrame([(0, m) for m in range(1, 61)] + [(m, 0) for m in range(1, 61)] + [(1, 2)], "qmid bigint, mid bigint").coalesce(2)
    before = shuffled(spark)
    got = {(r.qmid, r.mid): tuple(r)[2:] for r in matching.common_trees(n, e, pairs, 1, 1).collect()}
    assert shuffled(spark) - before < 2_500_000
    assert got == {(1, 2): (3, 2, 4)} | {p: (1, 1, 1) for m in range(1, 61) for p in ((0, m), (m, 0))}


def items_in_clusters(spark, folder: Path) -> tuple[str, dict[tuple[int, int], float]]:
    """A folder with 903 items, of which 900 are in three clusters of some 45,000 similar pairs each, and the pairs of plain Python."""
    rnd, items = random.Random(6), {}
    for t in range(900):
        items[t] = {t % 3 * 100 + k: 12 for k in range(8)} | {1000 + k: rnd.randrange(1, 4) for k in rnd.sample(range(40), 2)}
    # one links two clusters, one has a feature alone, one is apart
    items[900] = {k: 12 for k in range(8)} | {100 + k: 12 for k in range(8)}
    items[901], items[902] = {5000: 2}, {1000: 1, 1039: 1}
    rows = [(t, f, w) for t, v in items.items() for f, w in v.items()]
    made = spark.createDataFrame([(k, k, *r) for k, r in enumerate(rows)], "sid0 bigint, sid1 bigint, tid bigint, fid bigint, feat_count bigint")
    made.coalesce(2).write.parquet(f"{folder}/itemfeats.parquet")
    freq = {}
    for _, f, _ in rows:
        freq[f] = freq.get(f, 0) + 1
    unit, place = np.zeros((len(items), len(freq))), {f: k for k, f in enumerate(freq)}
    for t, f, w in rows:
        unit[t, place[f]] = w * math.log(len(items) / freq[f]) if freq[f] > 1 else 0
    unit /= np.maximum(np.sqrt((unit**2).sum(axis=1)), 1e-300)[:, None]
    sims = unit @ unit.T
    return str(folder), {(a, b): sims[a, b] for a in items for b in items if a < b and round(sims[a, b], 6) >= 0.7}


def stored(spark) -> int:
    """Bytes of the tables that the application keeps."""
    return sum(p.stat().st_size for p in (Path(common.shared_folder(spark)) / "stores").rglob("*.parquet"))


def groups_of(pairs) -> dict[int, int]:
    up = {}

    def top(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for a, b in pairs:
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    return {x: top(x) for x in up}


def test_item_groups_keep_no_pairs(spark, tmp_path):
    d, pairs = items_in_clusters(spark, tmp_path)
    before = stored(spark)
    want = groups_of(pairs)
    assert {r.node: r.cid for r in graphs.item_groups(spark, d).collect()} == want and len(set(want.values())) == 2 and len(pairs) > 50_000
    assert stored(spark) - before < 300_000
    few = bayes.cosine_groups(words.weighed_items(spark, d), 0.7, slice_entries=1500)
    assert {r.node: r.cid for r in few.collect()} == want
    # over many small components, joined over slices and tasks
    rnd = random.Random(9)
    rows = [(t, f"{t % 60}-{k}", rnd.randrange(1, 5)) for t in range(600) for k in range(6)]
    docs = spark.createDataFrame(rows, "doc bigint, feat string, w bigint").repartition(3)
    want = groups_of((r.a, r.b) for r in bayes.cosine_pairs(docs, 0.9).collect())
    assert {r.node: r.cid for r in bayes.cosine_groups(docs, 0.9, slice_entries=900).collect()} == want and len(set(want.values())) > 60


def test_similar_to_item_keeps_no_pairs(spark, tmp_path):
    d, pairs = items_in_clusters(spark, tmp_path)
    before = stored(spark)
    got = {(r.tid, r.other): r.sim for r in words.similar_to_item(spark, d).collect()}
    assert stored(spark) - before < 300_000
    want = {p: s for (a, b), s in pairs.items() for p in ((a, b), (b, a)) if p[0] % 20 == 0}
    assert got.keys() == want.keys() and len(got) > 5_000 and all(abs(s - want[p]) < 1e-5 for p, s in got.items())
    few = bayes.cosine_matches(words.weighed_items(spark, d), F.col("doc") % 20 == 0, 0.7, slice_entries=100)
    assert {(r.doc, r.other): r.sim for r in few.collect()} == got
    none = bayes.cosine_matches(words.weighed_items(spark, d), F.col("doc") < 0, 0.7)
    assert none.count() == 0
