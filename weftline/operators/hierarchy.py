"""Parent-child links to full hierarchies, by nested-set ranges.

Subtree sizes go upward, then every node hands its children consecutive preorder ranges (prefix sums over the siblings)
downward. What the upward pass never finishes lies on a circle; what the downward pass never reaches leads into one.

To keep the number of Spark jobs independent of the depth, the rows are cut into blocks (ranges of equal size in the
order of a locality key and the id, so that a large key is split), and both passes run inside a block at once. A fragment is what hangs together within a block; a link
between blocks makes the child's fragment a virtual leaf of the parent's block. Three steps:

1. per block: the fragments' own sizes, and the fragment to which each virtual leaf belongs;
2. on the fragments alone: whole sizes and circles; per block again, with them: all sizes, and the ranges relative to the
   fragment's root; on the fragments: ranges, depth and root, downward;
3. a join that adds the fragment's range start, depth and root to its nodes.

Fragments that take part in links between blocks are solved in one task up to ``TASK_LINKS`` of them, beyond that by
pointer doubling over DataFrames.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.common import cut

#: Rows of a block, and links between blocks that one task resolves.
BLOCK_ROWS, TASK_LINKS = 100_000, 2_000_000
#: Places of a bin when ranges are joined.
BIN_ROWS = 4096
#: Depths of nodes on a circle and of nodes whose parents lead into one.
ON_CIRCLE, INTO_CIRCLE = -1, -2
#: Stand for "no parent" and for "no fragment, as on a circle" where arrays have no null; no id may be one of these two.
NONE, CIRCLED = -(1 << 63), -(1 << 63) + 1


def _positions(ids: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Index of each wanted id in ``ids``, -1 where it is missing."""
    if not len(ids):
        return np.full(len(wanted), -1, dtype=np.int64)
    order = np.argsort(ids, kind="stable")
    at = np.searchsorted(ids[order], wanted).clip(max=len(ids) - 1)
    found = order[at]
    return np.where(ids[found] == wanted, found, -1)


def solve(ids: np.ndarray, up: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """The forest of ``up`` (index of the parent, -1 at a root): order, size, offset, depth, root index, circle state.

    ``weight`` is a node's own share of the sizes. ``state`` is 0 for nodes of trees, else ON_CIRCLE or INTO_CIRCLE.
    Siblings take their ranges in the order of their ids. The offset of a node is relative to its root.
    """
    n = len(ids)
    size, pending = weight.astype(np.int64).copy(), np.zeros(n, dtype=np.int64)
    inner = up >= 0
    np.add.at(pending, up[inner], 1)
    order: list[int] = np.flatnonzero(pending == 0).tolist()
    left, parent, total = pending.tolist(), up.tolist(), size.tolist()
    k = 0
    while k < len(order):
        v = order[k]
        k += 1
        p = parent[v]
        if p >= 0:
            total[p] += total[v]
            left[p] -= 1
            if not left[p]:
                order.append(p)
    state = np.full(n, ON_CIRCLE, dtype=np.int64)
    state[order] = INTO_CIRCLE
    size = np.array(total, dtype=np.int64) if n else size
    # the sibling's range starts after its elder siblings
    ahead = np.zeros(n, dtype=np.int64)
    kids = np.flatnonzero(inner)
    kids = kids[np.lexsort([ids[kids], up[kids]])]
    if len(kids):
        before = np.concatenate([[0], np.cumsum(size[kids])[:-1]])
        first = np.concatenate([[True], up[kids][1:] != up[kids][:-1]])
        ahead[kids] = before - np.maximum.accumulate(np.where(first, before, 0))
    own, skip = weight.tolist(), ahead.tolist()
    depth, offset, root, st = [0] * n, [0] * n, list(range(n)), state.tolist()
    for v in reversed(order):
        p = parent[v]
        if p < 0:
            st[v] = 0
        else:
            root[v], st[v] = root[p], st[p]
            if st[p] == ON_CIRCLE:
                st[v] = INTO_CIRCLE
            depth[v], offset[v] = depth[p] + 1, offset[p] + own[p] + skip[v]
    return {"size": size, "offset": np.array(offset, dtype=np.int64), "depth": np.array(depth, dtype=np.int64), "root": np.array(root, dtype=np.int64), "state": np.array(st, dtype=np.int64)}


def _block(pdf: pd.DataFrame, weight: np.ndarray | None):
    """Solve one block; virtual leaves have a parent in it but no children."""
    ids, leaf, parent = pdf["sid"].to_numpy(np.int64), pdf["leaf"].to_numpy(bool), pdf["parent"].to_numpy(np.int64)
    real = np.flatnonzero(~leaf)
    at = _positions(ids[real], parent)
    up = np.where((at >= 0) & (parent != NONE), real[at] if len(real) else -1, -1)
    s = solve(ids, up, (~leaf).astype(np.int64) if weight is None else weight)
    frag = np.where(s["state"] == 0, ids[s["root"]], CIRCLED) if len(ids) else ids
    return s, ids, up, leaf, frag, (up < 0) & (parent != NONE)


def _fragments(pdf: pd.DataFrame) -> pd.DataFrame:
    """Step 1: the fragments below another block's, and the virtual leaves, with the own size of the fragment.

    A leaf's ``frag`` is the fragment that holds its parent, CIRCLED if that lies on a circle within the block or leads there.
    """
    _, ids, _, leaf, frag, foreign = _block(pdf, None)
    kinds, which = np.unique(frag, return_inverse=True)
    own = np.bincount(which, weights=~leaf, minlength=len(kinds)).astype(np.int64)
    keep = np.flatnonzero(foreign | leaf)
    return pd.DataFrame({"sid": ids[keep], "frag": frag[keep], "size": own[which[keep]], "leaf": leaf[keep]})


def _ranges(pdf: pd.DataFrame) -> pd.DataFrame:
    """Step 2: all nodes and leaves with size, and offset, depth and path relative to their fragment's root."""
    leaf = pdf["leaf"].to_numpy(bool)
    s, ids, up, leaf, frag, _ = _block(pdf, np.where(leaf, pdf["size"].to_numpy(np.int64), 1))
    state = s["state"].copy()
    # the way from a leaf that closes a circle of fragments to its fragment's root is on the circle
    for v in np.flatnonzero(leaf & pdf["circle"].to_numpy(bool)).tolist():
        v = int(up[v])
        while v >= 0 and state[v] != ON_CIRCLE:
            state[v] = ON_CIRCLE
            v = int(up[v])
    path: list[str | None] = [None] * len(ids)
    if len(ids) and pdf["with_path"].iloc[0]:
        names = pdf["name"].fillna("").tolist()
        for v in np.argsort(s["depth"], kind="stable").tolist():
            if s["state"][v] == 0:
                p = int(up[v])
                # a leaf gets what stands before its own name
                path[v] = f"{path[p]}/" if leaf[v] else names[v] if p < 0 else f"{path[p]}/{names[v]}"
    return pd.DataFrame({"sid": ids, "frag": frag, "leaf": leaf, "off": s["offset"], "dep": s["depth"], "size": s["size"], "state": state, "path": path})


def _sizes(pdf: pd.DataFrame) -> pd.DataFrame:
    ids, parent = pdf["frag"].to_numpy(np.int64), pdf["up"].to_numpy(np.int64)
    s = solve(ids, np.where(parent == NONE, -1, _positions(ids, parent)), pdf["w"].to_numpy(np.int64))
    return pd.DataFrame({"frag": ids, "total": s["size"], "state": s["state"]})


def _sizes_by_doubling(links: DataFrame) -> DataFrame:
    """As ``_sizes`` over any number of fragments: every round adds to a node what its 2^k-th descendants have gathered."""
    cur = cut(links.select(F.col("frag").alias("id"), F.when(F.col("up") != NONE, F.col("up")).alias("anc"), F.col("w").alias("val")))
    active, before = cur.where("anc is not null").count(), -1
    while active not in (0, before):
        added = cur.where("anc is not null").groupBy(F.col("anc").alias("id")).agg(F.sum("val").alias("more"))
        jump = cur.select(F.col("id").alias("anc"), F.col("anc").alias("far"))
        cur = cut(cur.join(jump, "anc", "left").join(added, "id", "left").select("id", F.col("far").alias("anc"), (F.col("val") + F.coalesce("more", F.lit(0))).alias("val")))
        active, before = cur.where("anc is not null").count(), active
    # whatever still has an ancestor is on a circle or leads into one; the far ancestors of all of them end up on the circles
    endless = cur.where("anc is not null").select("id", "anc")
    seen, images = -1, endless.select("anc").distinct().count() if active else 0
    while images and images != seen:
        endless = cut(endless.join(endless.toDF("anc", "far"), "anc").select("id", F.col("far").alias("anc")))
        seen, images = images, endless.select("anc").distinct().count()
    on = endless.select(F.col("anc").alias("id")).distinct().withColumn("on", F.lit(True))
    state = F.when(F.col("on"), ON_CIRCLE).when(F.col("anc").isNotNull(), INTO_CIRCLE).otherwise(0).cast("long")
    return cur.join(on, "id", "left").select(F.col("id").alias("frag"), F.col("val").alias("total"), state.alias("state"))


def _heads(pdf: pd.DataFrame) -> pd.DataFrame:
    ids, parent = pdf["frag"].to_numpy(np.int64), pdf["up"].to_numpy(np.int64)
    up = np.where(parent == NONE, -1, _positions(ids, parent))
    s = solve(ids, up, np.ones(len(ids), dtype=np.int64))
    start, depth, head = [0] * len(ids), [0] * len(ids), [""] * len(ids)
    off, dep, path, above = pdf["off"].tolist(), pdf["dep"].tolist(), pdf["path"].fillna("").tolist(), up.tolist()
    for v in np.argsort(s["depth"], kind="stable").tolist():
        p = above[v]
        if p >= 0:
            start[v], depth[v], head[v] = start[p] + off[v], depth[p] + dep[v], head[p] + path[v]
    return pd.DataFrame({"frag": ids, "root": ids[s["root"]], "start": start, "depth": depth, "head": head})


def _heads_by_doubling(links: DataFrame) -> DataFrame:
    """As ``_heads`` over any number of fragments."""
    start = F.when(F.col("up") != NONE, F.col("up"))
    cur = cut(links.select(F.col("frag").alias("id"), start.alias("anc"), F.coalesce(start, "frag").alias("root"), "off", "dep", F.coalesce("path", F.lit("")).alias("path")))
    while cur.where("anc is not null").count():
        jump = cur.select(F.col("id").alias("anc"), F.col("anc").alias("far"), F.col("root").alias("r"), F.col("off").alias("o"), F.col("dep").alias("d"), F.col("path").alias("p"))
        zero = lambda c: F.coalesce(c, F.lit(0))
        cur = cut(cur.join(jump, "anc", "left").select("id", F.col("far").alias("anc"), F.coalesce("r", "root").alias("root"), (F.col("off") + zero("o")).alias("off"), (F.col("dep") + zero("d")).alias("dep"), F.concat(F.coalesce("p", F.lit("")), "path").alias("path")))
    return cur.select(F.col("id").alias("frag"), "root", F.col("off").alias("start"), F.col("dep").alias("depth"), F.col("path").alias("head"))


def hierarchy(df: DataFrame, key: str, parent: str, name: str | None = None, locality: str | None = None, block_rows: int = BLOCK_ROWS, task_links: int = TASK_LINKS) -> DataFrame:
    """(key, root, depth, first, last, path): one row per distinct non-null ``key``.

    ``first`` .. ``last`` is the nested-set range within the tree of ``root``: b lies below a if they share the root and
    a.first < b.first <= a.last. ``path`` joins the names from the root by '/', null without ``name``; a null name counts
    as ''. A null parent, or one that is no key, makes a root of depth 0. On a circle of parents root and depth are -1,
    on a way into one -1 and -2; range and path are null there. Repeated rows of a key count once. ``locality`` only
    decides which rows share a block. The ids -2^63 and -2^63 + 1 are reserved.
    """
    picked = [F.min(parent).alias("parent"), (F.min(name) if name else F.lit(None).cast("string")).alias("name"), (F.min(locality) if locality else F.lit(None).cast("long")).alias("loc")]
    rows = cut(df.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("sid")).agg(*picked))
    n = rows.count()
    blocks = max(1, n // block_rows)
    ranged = rows.repartitionByRange(blocks, "loc", "sid")
    placed = cut(ranged.select("sid", "parent", "name", F.spark_partition_id().cast("long").alias("block")))
    above = placed.select(F.col("sid").alias("parent"), F.col("block").alias("pblock"))
    linked = cut(placed.join(above, "parent", "left").select("sid", F.when(F.col("pblock").isNotNull(), F.col("parent")).otherwise(F.lit(NONE)).alias("parent"), "name", "block", "pblock"))
    nodes = linked.select("block", "sid", "parent", "name", F.lit(False).alias("leaf"))
    # a virtual leaf stands for the child in its parent's block
    leaves = linked.where("pblock <> block").select(F.col("pblock").alias("block"), "sid", "parent", F.lit(None).cast("string").alias("name"), F.lit(True).alias("leaf"))
    step1 = cut(nodes.unionByName(leaves).groupBy("block").applyInPandas(_fragments, "sid bigint, frag bigint, size bigint, leaf boolean"))
    joint = step1.where("leaf").select(F.col("sid").alias("frag"), F.col("frag").alias("up"), "size")
    upper = joint.where(F.col("up") != CIRCLED).select(F.col("up").alias("frag"), "size")
    sizes = step1.where("not leaf").select("frag", "size").unionByName(upper).groupBy("frag").agg(F.max("size").alias("w"))
    # a fragment below a circle within a block gets itself as parent: whatever the fragments say, it is in no tree
    in_circle = F.coalesce(F.col("up") == CIRCLED, F.lit(False))
    links = sizes.join(joint.select("frag", "up"), "frag", "left").select("frag", F.when(in_circle, F.col("frag")).otherwise(F.coalesce("up", F.lit(NONE))).alias("up"), "w", in_circle.alias("below"))
    links = cut(links)
    in_task = links.count() <= task_links
    up_links = links.select("frag", "up", "w")
    solved = cut(up_links.groupBy(F.lit("all")).applyInPandas(_sizes, "frag bigint, total bigint, state bigint") if in_task else _sizes_by_doubling(up_links))
    closing = solved.join(links.select("frag", "below"), "frag").select(F.col("frag").alias("sid"), F.col("total").alias("size"), ((F.col("state") == ON_CIRCLE) & ~F.col("below")).alias("circle"))
    grown = nodes.select("*", F.lit(0).cast("long").alias("size"), F.lit(False).alias("circle")).unionByName(leaves.join(closing, "sid").select(*nodes.columns, "size", "circle"))
    grown = grown.withColumn("with_path", F.lit(name is not None))
    step2 = cut(grown.groupBy("block").applyInPandas(_ranges, "sid bigint, frag bigint, leaf boolean, off bigint, dep bigint, size bigint, state bigint, path string"))
    joints = step2.where("leaf").select(F.col("sid").alias("frag"), F.col("frag").alias("up"), "off", "dep", "path")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    placing = cut(solved.where("state = 0").select("frag").join(joints, "frag", "left").select("frag", F.coalesce("up", F.lit(NONE)).alias("up"), zero("off"), zero("dep"), "path"))
    head_schema = "frag bigint, root bigint, start bigint, depth bigint, head string"
    heads = placing.groupBy(F.lit("all")).applyInPandas(_heads, head_schema) if in_task else _heads_by_doubling(placing)
    per_frag = cut(solved.select("frag", F.col("state").alias("frag_state")).join(heads, "frag", "left"))
    out = step2.where("not leaf").join(per_frag, "frag", "left")
    lost = (F.col("state") != 0) | (F.coalesce("frag_state", F.lit(0)) != 0)
    flag = F.when(F.col("state") == ON_CIRCLE, ON_CIRCLE).otherwise(INTO_CIRCLE)
    first = F.coalesce("start", F.lit(0)) + F.col("off")
    return out.select(
        F.col("sid").alias(key),
        F.when(lost, F.lit(-1)).otherwise(F.coalesce("root", "frag")).cast("long").alias("root"),
        F.when(lost, flag).otherwise(F.coalesce("depth", F.lit(0)) + F.col("dep")).cast("long").alias("depth"),
        F.when(~lost, first).alias("first"),
        F.when(~lost, first + F.col("size") - 1).alias("last"),
        F.when(~lost, F.concat(F.coalesce("head", F.lit("")), F.col("path"))).alias("path"),
    )


def below(ranges: DataFrame, key: str, tops: DataFrame, bin_rows: int = BIN_ROWS) -> DataFrame:
    """(top, key): the nodes below each of ``tops`` (column ``key``), by the ranges of their tree.

    The places of a tree are cut into bins of ``bin_rows``; a top meets only the bins that its range touches, so even a
    tree with most of the rows is spread over many tasks and every pair that meets lies in the result or in an end bin.
    """
    placed = ranges.where("first is not null").withColumn("bin", F.floor(F.col("first") / bin_rows))
    t = ranges.join(tops.select(key).distinct(), key, "left_semi").where("first is not null and last > first")
    touched = F.explode(F.sequence(F.floor((F.col("first") + 1) / bin_rows), F.floor(F.col("last") / bin_rows)))
    t = t.select(F.col(key).alias("top"), "root", F.col("first").alias("t_first"), F.col("last").alias("t_last"), touched.alias("bin"))
    inside = (F.col("first") > F.col("t_first")) & (F.col("first") <= F.col("t_last"))
    return placed.join(t, ["root", "bin"]).where(inside).select("top", key)
