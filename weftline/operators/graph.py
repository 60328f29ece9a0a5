"""Directed-graph operators over edge tables (src, dst).

Each global operator has two ways with the same result. Up to ``TASK_EDGES`` edges, measured before, one task solves the
graph with a linear algorithm. Beyond that, rounds of joins do: only what still changes takes part in a round, and each
round is cut by a reliable checkpoint.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.common import cut
from weftline.operators import slices

#: Edges that one task solves: some hundred MB of its memory.
TASK_EDGES = 1_000_000


class CycleError(ValueError):
    """The graph has a cycle where an order was asked for."""


def _clean(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull()).select("src", "dst").distinct()


def _in_task(edges: DataFrame, run, schema: str) -> DataFrame:
    return edges.groupBy(F.lit("all")).applyInPandas(run, schema)


def _adjacency(pdf: pd.DataFrame) -> tuple[list[int], list[list[int]]]:
    codes, ids = pd.factorize(pd.concat([pdf["src"], pdf["dst"]], ignore_index=True), sort=True)
    n = len(pdf)
    out: list[list[int]] = [[] for _ in range(len(ids))]
    for a, b in zip(codes[:n].tolist(), codes[n:].tolist()):
        out[a].append(b)
    return ids.tolist(), out


def components(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """(node, cid): connected components of the undirected graph; cid is the least node. Loops make single nodes."""
    e = cut(_clean(edges))
    if e.count() <= task_edges:

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            ids, out = _adjacency(pdf)
            parent = list(range(len(ids)))

            def find(v: int) -> int:
                while parent[v] != v:
                    parent[v] = parent[parent[v]]
                    v = parent[v]
                return v

            for a, bs in enumerate(out):
                for b in bs:
                    x, y = find(a), find(b)
                    if x != y:
                        parent[max(x, y)] = min(x, y)
            return pd.DataFrame({"node": ids, "cid": [ids[find(v)] for v in range(len(ids))]})

        return _in_task(e, run, "node bigint, cid bigint")
    # alternating stars: every node points to the least neighbour it knows, until nothing moves
    pairs = cut(e.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    while True:
        both = pairs.where("u <> v").unionByName(pairs.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).where("u <> v")
        new = cut(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        if new.exceptAll(pairs).limit(1).count() == 0 and pairs.exceptAll(new).limit(1).count() == 0:
            break
        pairs = new
    return nodes.join(pairs.select(F.col("u").alias("node"), F.col("v").alias("cid")), "node", "left").select("node", F.coalesce("cid", "node").alias("cid"))


def _tarjan(out: list[list[int]]) -> list[int]:
    """Component number of each vertex; an own stack instead of recursion."""
    n = len(out)
    index, low, comp = [-1] * n, [0] * n, [-1] * n
    stack: list[int] = []
    count = made = 0
    for root in range(n):
        if index[root] >= 0:
            continue
        work = [(root, 0)]
        while work:
            v, k = work.pop()
            if k == 0:
                index[v] = low[v] = count
                count += 1
                stack.append(v)
            descend = False
            while k < len(out[v]):
                w = out[v][k]
                k += 1
                if index[w] < 0:
                    work += [(v, k), (w, 0)]
                    descend = True
                    break
                if comp[w] < 0:
                    low[v] = min(low[v], index[w])
            if descend:
                continue
            if low[v] == index[v]:
                while True:
                    w = stack.pop()
                    comp[w] = made
                    if w == v:
                        break
                made += 1
            if work:
                p = work[-1][0]
                low[p] = min(low[p], low[v])
    return comp


def strong_components(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """(node, cid): strongly connected components; cid is the least node of each."""
    e = cut(_clean(edges))
    if e.count() <= task_edges:

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            ids, out = _adjacency(pdf)
            comp = _tarjan(out)
            least: dict[int, int] = {}
            for v, c in enumerate(comp):
                least.setdefault(c, ids[v])
            return pd.DataFrame({"node": ids, "cid": [least[c] for c in comp]})

        return _in_task(e, run, "node bigint, cid bigint")
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    left, done = e, None
    while True:
        # trim: nodes without an edge in or out within the rest are components of their own
        while True:
            inside = left.select(F.col("src").alias("node")).intersect(left.select("dst"))
            kept = cut(left.join(inside.withColumnRenamed("node", "src"), "src", "left_semi").join(inside.withColumnRenamed("node", "dst"), "dst", "left_semi"))
            same = kept.count() == left.count()
            left = kept
            if same:
                break
        if left.limit(1).count() == 0:
            break
        # colour: the least node that reaches each node; backward from each colour's root within the colour
        colour = cut(left.select(F.col("src").alias("node")).union(left.select("dst")).distinct().withColumn("c", F.col("node")))
        while True:
            offered = left.join(colour.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("c").alias("o"))
            new = cut(colour.join(offered, "node", "left").select("node", F.least("c", F.coalesce("o", "c")).alias("c"), (F.col("o") < F.col("c")).alias("moved")))
            colour = new.select("node", "c")
            if new.where("moved").limit(1).count() == 0:
                break
        inner = cut(left.join(colour.toDF("src", "cs"), "src").join(colour.toDF("dst", "cd"), "dst").where("cs = cd").select("src", "dst", F.col("cs").alias("c")))
        found = cut(colour.where("node = c"))
        front = found
        while True:
            front = cut(inner.join(front.withColumnRenamed("node", "dst"), ["dst", "c"]).select(F.col("src").alias("node"), "c").distinct().join(found, ["node", "c"], "left_anti"))
            if front.limit(1).count() == 0:
                break
            found = cut(found.unionByName(front))
        done = found if done is None else done.unionByName(found)
        left = cut(left.join(found.select(F.col("node").alias("src")), "src", "left_anti").join(found.select(F.col("node").alias("dst")), "dst", "left_anti"))
    if done is None:
        return nodes.select("node", F.col("node").alias("cid"))
    named = done.groupBy("c").agg(F.min("node").alias("cid")).join(done, "c").select("node", "cid")
    return nodes.join(named, "node", "left").select("node", F.coalesce("cid", "node").alias("cid"))


def condensed(edges: DataFrame, comps: DataFrame) -> DataFrame:
    """(src, dst): distinct edges between components."""
    e = _clean(edges).join(comps.toDF("src", "cs"), "src").join(comps.toDF("dst", "cd"), "dst")
    return e.where("cs <> cd").select(F.col("cs").alias("src"), F.col("cd").alias("dst")).distinct()


def topological_levels(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """(node, level): the longest distance from a node without incoming edges. Raises CycleError on a cycle."""
    e = cut(_clean(edges))
    n = e.count()
    if n <= task_edges:

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            ids, out = _adjacency(pdf)
            waits, level = [0] * len(ids), [0] * len(ids)
            for bs in out:
                for b in bs:
                    waits[b] += 1
            ready = [v for v, w in enumerate(waits) if not w]
            for v in ready:
                for b in out[v]:
                    level[b] = max(level[b], level[v] + 1)
                    waits[b] -= 1
                    if not waits[b]:
                        ready.append(b)
            return pd.DataFrame({"node": ids, "level": [lv if not w else -1 for lv, w in zip(level, waits)]})

        out = cut(_in_task(e, run, "node bigint, level bigint"))
        if out.where("level < 0").limit(1).count():
            raise CycleError("the graph has a cycle")
        return out
    levels, left, k = None, e, 0
    rest = cut(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct())
    while rest.limit(1).count():
        front = cut(rest.join(left.select(F.col("dst").alias("node")), "node", "left_anti"))
        if front.limit(1).count() == 0:
            raise CycleError("the graph has a cycle")
        placed = front.withColumn("level", F.lit(k).cast("long"))
        levels = placed if levels is None else levels.unionByName(placed)
        left = cut(left.join(front.withColumnRenamed("node", "src"), "src", "left_anti"))
        rest = cut(rest.join(front, "node", "left_anti"))
        k += 1
    return levels if levels is not None else rest.withColumn("level", F.lit(0).cast("long"))


def path_weights(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """(src, dst, weight) of a graph without cycles: paths into the edge's source plus paths out of its target.

    A node without incoming edges has one path into it, others the sum over their sources; likewise outward. Counts are
    doubles, as they may grow exponentially.
    """
    e = cut(_clean(edges))
    levels = topological_levels(e, task_edges)
    if e.count() <= task_edges:

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            ids, out = _adjacency(pdf)
            n = len(ids)
            waits, into, outof, order = [0] * n, [0.0] * n, [0.0] * n, []
            for bs in out:
                for b in bs:
                    waits[b] += 1
            order = [v for v in range(n) if not waits[v]]
            for v in order:
                into[v] = into[v] or 1.0
                for b in out[v]:
                    into[b] += into[v]
                    waits[b] -= 1
                    if not waits[b]:
                        order.append(b)
            for v in reversed(order):
                outof[v] = sum(outof[b] for b in out[v]) or 1.0
            rows = [(ids[v], ids[b], into[v] + outof[b]) for v in range(n) for b in out[v]]
            return pd.DataFrame(rows, columns=["src", "dst", "weight"])

        return _in_task(e, run, "src bigint, dst bigint, weight double")
    into = _level_sums(e, levels)
    outof = _level_sums(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), topological_levels(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), task_edges))
    return e.join(into.toDF("src", "wi"), "src").join(outof.toDF("dst", "wo"), "dst").select("src", "dst", (F.col("wi") + F.col("wo")).alias("weight"))


def _level_sums(e: DataFrame, levels: DataFrame) -> DataFrame:
    levels = cut(levels)
    sums = levels.where("level = 0").select("node", F.lit(1.0).alias("w"))
    top = levels.agg(F.max("level")).first()[0] or 0
    for k in range(1, top + 1):
        at = levels.where(F.col("level") == k).select(F.col("node").alias("dst"))
        new = e.join(at, "dst").join(sums.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum("w").alias("w"))
        sums = cut(sums.unionByName(new))
    return sums


def main_paths(edges: DataFrame, ratio: float = 0.9, fan: int = 5, task_edges: int = TASK_EDGES) -> DataFrame:
    """(src, dst, weight): edges of at least ``ratio`` of the greatest weight, and from them the ``fan`` heaviest ways on and back."""
    w = cut(path_weights(edges, task_edges))
    top = w.agg(F.max("weight")).first()[0] or 0.0
    from pyspark.sql import Window as W

    # the rank of an edge among those out of its source and into its target, by the paths on its far side
    forth = F.row_number().over(W.partitionBy("src").orderBy(F.desc("weight"), "dst"))
    back = F.row_number().over(W.partitionBy("dst").orderBy(F.desc("weight"), "src"))
    ranked = cut(w.withColumn("f", forth).withColumn("b", back))
    heavy = cut(w.where(F.col("weight") >= ratio * top))
    found = heavy
    # onward from the targets of the heavy edges, and back from their sources: neither walk goes on from the other's edges
    for own, far, rank in (("dst", "src", "f"), ("src", "dst", "b")):
        ways = ranked.where(F.col(rank) <= fan).select("src", "dst", "weight")
        points = heavy.select(F.col(own).alias(far)).distinct()
        reached, walked = points, None
        while True:
            step = cut(ways.join(points, far, "left_semi"))
            walked = step if walked is None else walked.unionByName(step)
            points = cut(step.select(F.col(own).alias(far)).distinct().join(reached, far, "left_anti"))
            if points.isEmpty():
                break
            reached = reached.unionByName(points)
        found = found.unionByName(walked)
    return found.distinct()


def simple_paths(starts: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """(path array, len): all paths of ``edges`` from ``starts`` (node) that visit no node twice, up to ``most`` edges if given."""
    e = _clean(edges)
    front = starts.select("node", F.array("node").alias("path"), F.lit(0).cast("long").alias("len"))
    out = front
    for k in itertools.count(1) if most is None else range(1, most + 1):
        step = front.join(e.toDF("node", "nxt"), "node").where(~F.array_contains("path", F.col("nxt")))
        front = cut(step.select(F.col("nxt").alias("node"), F.concat("path", F.array("nxt")).alias("path"), F.lit(k).cast("long").alias("len")))
        if front.isEmpty():
            break
        out = out.unionByName(front)
    return out.select("path", "len")


def passed_through(calls: DataFrame, own: DataFrame) -> DataFrame:
    """(mid, ref): references that a method's callees use, directly or further down, and the method itself does not.

    ``calls`` has (mid, callee_mid), ``own`` (mid, ref). Only what is new travels upward in a round.
    """
    up = _clean(calls.select(F.col("callee_mid").alias("src"), F.col("mid").alias("dst")))
    have = cut(own.where("mid is not null and ref is not null").select("mid", "ref").distinct())
    mine, front = have, have
    while True:
        moved = front.join(up.withColumnRenamed("src", "mid"), "mid").select(F.col("dst").alias("mid"), "ref").distinct()
        front = cut(moved.join(have, ["mid", "ref"], "left_anti"))
        if front.limit(1).count() == 0:
            break
        have = cut(have.unionByName(front))
    return have.join(mine, ["mid", "ref"], "left_anti")


def keyed_steps(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(nid, label, src): from each node with a key to the next ones that feed it, over any number of nodes without.

    ``nodes`` has (nid, key); the label is that of the first link. Nodes without key pass their inputs on.
    """
    real = cut(links.where(~F.col("label").startswith("_")).select(F.col("nid0").alias("nid"), "label", F.col("nid1").alias("src")).distinct())
    keyed, plain = nodes.where("key is not null").select("nid"), nodes.where("key is null").select(F.col("nid").alias("src"))
    seen = front = cut(real.join(keyed, "nid", "left_semi"))
    while True:
        through = front.join(plain, "src", "left_semi").join(real.select(F.col("nid").alias("src"), F.col("src").alias("far")), "src")
        front = cut(through.select("nid", "label", F.col("far").alias("src")).distinct().join(seen, ["nid", "label", "src"], "left_anti"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.join(keyed.withColumnRenamed("nid", "src"), "src", "left_semi").select("nid", "label", "src")


def path_index(nodes: DataFrame, links: DataFrame, depth: int | None = None) -> DataFrame:
    """(path, size, mid, nid): every chain of keys that ends at a node, as text 'label:key/label:key', up to ``depth`` keys if given.

    ``nodes`` has (nid, mid, key). The first part of a path has no label. This is the exhaustive form: a node that is
    reached on several ways is indexed on each; a chain has no node twice.
    """
    steps = cut(keyed_steps(nodes, links))
    named = nodes.where("key is not null").select("nid", "mid", "key")
    front = named.select("nid", "mid", F.concat(F.lit(":"), "key").alias("path"), F.array("nid").alias("way"))
    out = front.select("path", F.lit(1).cast("long").alias("size"), "mid", "nid")
    far = cut(steps.join(named.select(F.col("nid").alias("src"), F.col("key").alias("skey"), F.col("mid").alias("smid")), "src"))
    for k in itertools.count(2) if depth is None else range(2, depth + 1):
        moved = front.join(far, "nid").where(~F.array_contains("way", F.col("src")))
        front = cut(moved.select(F.col("src").alias("nid"), F.col("smid").alias("mid"), F.concat("path", F.lit("/"), "label", F.lit(":"), "skey").alias("path"), F.concat("way", F.array("src")).alias("way")))
        if front.isEmpty():
            break
        out = out.unionByName(front.select("path", F.lit(k).cast("long").alias("size"), "mid", "nid"))
    return out.where("mid is not null").distinct()


def _asked(h: np.ndarray, qmid: np.ndarray, q: np.ndarray, size: np.ndarray) -> SimpleNamespace:
    """Paths of query methods, sorted by hash: the hashes, the methods and nodes by number, and each hash's methods once."""
    order = np.lexsort([qmid, h])
    h, qmid, q, size = h[order], qmid[order], q[order], size[order]
    hashes, first, n = np.unique(h, return_index=True, return_counts=True)
    methods, m = np.unique(qmid, return_inverse=True)
    # the entries at which another method or hash begins
    new = np.flatnonzero(np.concatenate([np.ones(min(1, len(h)), dtype=bool), (h[1:] != h[:-1]) | (m[1:] != m[:-1])]))
    m_first = np.searchsorted(new, first)
    return SimpleNamespace(h=h, qmid=qmid, q=q, size=size, hashes=hashes, first=first, n=n, methods=methods, m=m, new=new, m_first=m_first, m_n=np.diff(np.append(m_first, len(new))))


def _counted(pair: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs in order, and the distinct nodes of each."""
    order = np.lexsort([node, pair])
    pair, node = pair[order], node[order]
    begins = np.concatenate([np.ones(min(1, len(pair)), dtype=bool), pair[1:] != pair[:-1]])
    fresh = begins | np.concatenate([np.ones(min(1, len(pair)), dtype=bool), node[1:] != node[:-1]])
    return pair[begins], np.add.reduceat(fresh.astype(np.int64), np.flatnonzero(begins)) if len(pair) else np.empty(0, np.int64)


def _voted(mid: np.ndarray, h: np.ndarray, x: np.ndarray, s: SimpleNamespace, least: int) -> Iterator[pa.RecordBatch]:
    """The votes between whole methods, sorted by (mid, h), and a slice."""
    at = np.searchsorted(s.hashes, h).clip(max=max(0, len(s.hashes) - 1))
    known = s.hashes[at] == h if len(s.hashes) else np.zeros(len(h), dtype=bool)
    mid, at, x = mid[known], at[known], x[known]
    if not len(mid):
        return
    fresh = np.concatenate([[True], (mid[1:] != mid[:-1]) | (at[1:] != at[:-1])])
    begins = np.flatnonzero(np.concatenate([[True], mid[1:] != mid[:-1]]))
    heavy = np.add.reduceat(s.m_n[at] + np.where(fresh, s.n[at], 0), begins)
    ends = np.append(begins[1:], len(mid))
    for k0, k1 in slices.portions(heavy, slices.HELD):
        b, e = begins[k0], ends[k1 - 1]
        parts = min(-(-int(heavy[k0]) // slices.HELD), len(s.methods)) if k1 == k0 + 1 else 1
        if parts > 1:
            # a method with more meetings than a task should hold meets one part of the query methods after the other
            for part in range(parts):
                some = s.m % parts == part
                yield from _voted(mid[b:e], s.hashes[at[b:e]], x[b:e], _asked(*(c[some] for c in (s.h, s.qmid, s.q, s.size))), least)
            continue
        own, place = np.repeat(np.arange(k1 - k0), ends[k0:k1] - begins[k0:k1]), at[b:e]
        once = np.flatnonzero(fresh[b:e])
        of, entry = slices.spread(s.first[place[once]], s.n[place[once]])
        pair_q = own[once][of] * len(s.methods) + s.m[entry]
        pair, n_query = _counted(pair_q, s.q[entry])
        depth = np.zeros(len(pair), dtype=np.int64)
        np.maximum.at(depth, np.searchsorted(pair, pair_q), s.size[entry])
        of, entry = slices.spread(s.m_first[place], s.m_n[place])
        _, n_found = _counted(own[of] * len(s.methods) + s.m[s.new[entry]], x[b:e][of])
        ok = (n_query >= least) & (n_found >= least)
        which, method = np.divmod(pair[ok], len(s.methods))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (s.methods[method], mid[begins[k0 + which]], n_query[ok], n_found[ok], depth[ok])], names=["qmid", "mid", "n_query", "n_found", "depth"])


def _votes(batches: Iterator[pa.RecordBatch], s: SimpleNamespace, least: int) -> Iterator[pa.RecordBatch]:
    """The votes of rows (mid, h, x) sorted by (mid, h) and a slice; a method may go on in the next batch."""
    held = [np.empty(0, np.int64)] * 3
    for batch in batches:
        held = [np.concatenate(c) for c in zip(held, (slices.column(batch, c) for c in ("mid", "h", "x")))]
        if len(held[0]):
            last = int(np.searchsorted(held[0], held[0][-1]))
            yield from _voted(*(c[:last] for c in held), s, least)
            held = [c[last:] for c in held]
    yield from _voted(*held, s, least)


def path_votes(queries: DataFrame, index: DataFrame, least_nodes: int, least_depth: int, check: Callable[[Column, Column], Column] | None = None, slice_entries: int = slices.SLICE_ENTRIES) -> DataFrame:
    """(qmid, mid, n_query, n_found, depth): methods that share paths with a query method, by the nodes and depth matched.

    Paths meet by a hash of their text. The paths of a method are in one task, which meets the query methods' paths in slices and counts
    the nodes of either side there; so only the votes leave it. ``check`` tells which methods may match a query method, by
    their ids; all others by default.
    """
    allowed = F.col("qmid") != F.col("mid") if check is None else check(F.col("qmid"), F.col("mid"))
    h = F.xxhash64("path", "size")
    q = queries.where("size >= 2 and mid is not null").select(h.alias("h"), F.col("mid").cast("long").alias("qmid"), F.col("nid").cast("long").alias("q"), F.col("size").cast("long").alias("size"))
    x = index.where("size >= 2 and mid is not null").select(F.col("mid").cast("long").alias("mid"), h.alias("h"), F.col("nid").cast("long").alias("x"))
    rows = x.repartition("mid").sortWithinPartitions("mid", "h")
    found = slices.against(rows, q, "qmid", q.count(), lambda t: _asked(*(slices.column(t, c) for c in ("h", "qmid", "q", "size"))), lambda b, s: _votes(b, s, least_nodes), "qmid bigint, mid bigint, n_query bigint, n_found bigint, depth bigint", slice_entries)
    return found.where(allowed & (F.col("depth") >= least_depth))


def summary_tree(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """(root, path array, repeated): the lines of the trees below the nodes without incoming edges of a graph without cycles.

    Children come in the order of their ids. Below a node that was shown before in the same tree nothing is shown again; that
    line is ``repeated``. The first visit of a node is on the least path that leads to it, found level by level.
    """
    e = cut(_clean(edges))
    levels = cut(topological_levels(e, task_edges))
    top = levels.agg(F.max("level")).first()[0] or 0
    below = cut(e.join(levels.select(F.col("node").alias("dst"), "level"), "dst"))
    first = levels.where("level = 0").select(F.col("node").alias("root"), "node", F.array("node").alias("path"))
    for k in range(1, top + 1):
        step = below.where(F.col("level") == k).join(first.withColumnRenamed("node", "src"), "src")
        new = step.groupBy("root", F.col("dst").alias("node")).agg(F.min(F.concat("path", F.array("dst"))).alias("path"))
        first = cut(first.unionByName(new))
    lines = first.join(e.withColumnRenamed("src", "node"), "node").select("root", F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("node"))
    shown = lines.join(first.select("root", "node", F.col("path").alias("least")), ["root", "node"]).select("root", "path", (F.col("path") != F.col("least")).alias("repeated"))
    return first.where("node = root").select("root", "path", F.lit(False).alias("repeated")).unionByName(shown)
