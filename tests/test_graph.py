"""The two ways of every graph operator agree with plain Python on random graphs."""

import random
from collections import defaultdict

import pytest

from weftline.operators import graph as g


def reach(edges):
    out = defaultdict(set)
    for a, b in edges:
        out[a].add(b)
    nodes = {x for e in edges for x in e}
    r = {}
    for v in nodes:
        seen, todo = set(), [v]
        while todo:
            for w in out[todo.pop()]:
                if w not in seen:
                    seen.add(w)
                    todo.append(w)
        r[v] = seen
    return nodes, r


def frame(spark, edges):
    rows = [(*e, "x") for e in edges] * 2 + [(None, 1, "x"), (2, None, "x")]
    return spark.createDataFrame(rows, "src bigint, dst bigint, node string")


def draw(seed, n=22, m=30):
    rnd = random.Random(seed)
    return [(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)]


@pytest.mark.parametrize("seed,limit", [(1, 10**6), (1, 0), (2, 0)])
def test_components(spark, seed, limit):
    edges = draw(seed, 40, 26)
    nodes, r = reach([*edges, *((b, a) for a, b in edges)])
    assert {x["node"]: x["cid"] for x in g.components(frame(spark, edges), limit).collect()} == {v: min({v} | r[v]) for v in nodes}


@pytest.mark.parametrize("seed,limit", [(3, 10**6), (4, 10**6), (3, 0)])
def test_strong_components(spark, seed, limit):
    edges = draw(seed)
    nodes, r = reach(edges)
    want = {v: min({v} | {w for w in r[v] if v in r[w]}) for v in nodes}
    assert {x["node"]: x["cid"] for x in g.strong_components(frame(spark, edges), limit).collect()} == want


@pytest.mark.parametrize("limit", [10**6, 0])
def test_levels_and_weights(spark, limit):
    edges = [(a, b) for a, b in draw(6, 14, 24) if a < b]
    nodes, _ = reach(edges)
    level = {v: 0 for v in nodes}
    into, out = {}, {}
    uniq = sorted(set(edges))
    for v in sorted(nodes):
        src = [a for a, b in uniq if b == v]
        level[v] = max((level[a] + 1 for a in src), default=0)
        into[v] = sum(into[a] for a in src) or 1
    for v in sorted(nodes, reverse=True):
        out[v] = sum(out[b] for a, b in uniq if a == v) or 1
    df = frame(spark, edges)
    assert {x["node"]: x["level"] for x in g.topological_levels(df, limit).collect()} == level
    got = {(x["src"], x["dst"]): x["weight"] for x in g.path_weights(df, limit).collect()}
    assert got == {(a, b): into[a] + out[b] for a, b in uniq}
    assert {(x["src"], x["dst"]) for x in g.main_paths(df, 0.9, 5, limit).collect()} <= set(uniq)
    with pytest.raises(g.CycleError):
        g.topological_levels(frame(spark, [(1, 2), (2, 3), (3, 2)]), limit).collect()


def test_empty(spark):
    df = frame(spark, [(1, 2)]).limit(0)
    for limit in (10, -1):
        assert g.components(df, limit).count() == 0 and g.strong_components(df, limit).count() == 0 and g.topological_levels(df, limit).count() == 0


@pytest.mark.parametrize("limit", [10**6, 0])
def test_main_paths_walk_back_from_heavy_edges_only(spark, limit):
    # ten ways into a, one heavy edge a > b, another source of b, many ways out of b
    edges = [(k, 100) for k in range(10)] + [(100, 101), (50, 101)] + [(101, 200 + k) for k in range(30)]
    got = {(x["src"], x["dst"]) for x in g.main_paths(frame(spark, edges), 0.9, 5, limit).collect()}
    assert got == {(100, 101)} | {(k, 100) for k in range(5)} | {(101, 200 + k) for k in range(5)}


def test_summary_tree_shows_each_node_once(spark):
    edges = [(1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (6, 3)]
    got = {(x["root"], tuple(x["path"]), x["repeated"]) for x in g.summary_tree(frame(spark, edges)).collect()}
    assert got == {(1, (1,), False), (1, (1, 2), False), (1, (1, 3), False), (1, (1, 2, 4), False), (1, (1, 3, 4), True), (1, (1, 2, 4, 5), False), (6, (6,), False), (6, (6, 3), False), (6, (6, 3, 4), False), (6, (6, 3, 4, 5), False)}


def test_index_has_every_chain(spark):
    nodes = [(k, 10 + k % 2, None if k in (3, 4) else f"k{k}") for k in range(1, 9)]
    links = [(1, 2, "a"), (2, 3, "b"), (3, 4, "c"), (4, 5, "d"), (5, 6, "e"), (6, 7, "f"), (7, 8, "g"), (8, 1, "h"), (4, 3, "x"), (5, 2, "_no")]
    n = spark.createDataFrame(nodes, "nid bigint, mid bigint, key string")
    e = spark.createDataFrame(links, "nid0 bigint, nid1 bigint, label string")
    paths = {(r.path, r.nid) for r in g.path_index(n, e).collect()}
    assert (":k1/a:k2/b:k5/e:k6/f:k7/g:k8", 8) in paths and (":k5/e:k6/f:k7/g:k8/h:k1/a:k2", 2) in paths
    assert len(paths) == 36  # six nodes with keys on one circle


def test_fallback_scores_rank_every_key(spark):
    from weftline.operators import bayes

    # a hundred observations of three keys
    counts = {"yellow": {"banana": 45, "orange": 30, "other": 5}, "long": {"banana": 40, "other": 10}, "sweet": {"banana": 35, "orange": 15, "other": 15}}
    keys = spark.createDataFrame([("banana", 50), ("orange", 30), ("other", 20), ("none", 7)], "key string, k bigint")
    feats = spark.createDataFrame([(f, k, c) for f, per in counts.items() for k, c in per.items()], "feat string, key string, c bigint")
    asked = spark.createDataFrame([(1, f) for f in (*counts, "unknown")] + [(2, "unknown"), (3, "long"), (3, "long")], "qid bigint, feat string")
    import math

    size = {"banana": 50, "orange": 30, "other": 20, "none": 7}
    want = {}
    for q, fs in ((1, counts), (2, {}), (3, {"long": 0})):
        p = {k: math.log(n) + sum(math.log(counts[f].get(k, 1)) - math.log(n) for f in fs) for k, n in size.items()}
        want |= {(q, k): round(v - max(p.values()), 6) for k, v in p.items()}
    got = {(r.qid, r.key): r.score for r in bayes.fallback_scores(keys, feats, asked).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)
    assert {(r.qid, r.key) for r in bayes.fallback_scores(keys, feats, asked, 1).collect()} == {(1, "banana"), (2, "banana"), (3, "banana")}
    strict = {(r.qid, r.key) for r in bayes.strict_scores(keys, feats, asked.where("qid = 1")).collect()}
    assert strict == {(1, "banana"), (1, "other")}
