"""Calls, the interprocedural graph, bounded reach and as-of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.common import cut
from weftline.model import CALL_KINDS

#: A method has no more parameters than this (fixed value of the class file format).
MOST_PARAMETERS = 255


def calls(nodes: DataFrame, most: int | None = 1) -> DataFrame:
    """(nid, mid, callee): the signatures of every call node, at most the first ``most``; none without data."""
    callees = F.split("ndata", " ")
    own = nodes.where(F.col("kind").isin(*CALL_KINDS) & F.col("ndata").isNotNull())
    return own.select("nid", "mid", F.explode(F.slice(callees, 1, most) if most else callees).alias("callee"))


def resolved(nodes: DataFrame, methods: DataFrame, most: int | None = 1) -> DataFrame:
    """(nid, mid, callee_mid) of the calls whose callee is defined; of equal signatures the least method counts."""
    defined = methods.where("method_id is not null").groupBy(F.col("method_id").alias("callee")).agg(F.min("mid").alias("callee_mid"))
    return calls(nodes, most).join(defined, "callee").select("nid", "mid", "callee_mid")


def entries(nodes: DataFrame) -> DataFrame:
    """(callee_mid, label, dst): the inputs of methods by the label of what they take.

    The label is the input's reference. Where a store keeps variable names instead of #arg0, #arg1 and so on, the k-th variable
    input of a method takes #arg<k> as well, unless an input has that name.
    """
    own = nodes.where("kind = 'input' and mid is not null and ref_name is not null")
    named = own.select(F.col("mid").alias("callee_mid"), F.col("ref_name").alias("label"), F.col("nid").alias("dst"))
    place = F.row_number().over(W.partitionBy("mid").orderBy("nid"))
    placed = own.where(F.left("ref_name", F.lit(1)) == "$").withColumn("k", place).where(F.col("k") <= MOST_PARAMETERS)
    placed = placed.select(F.col("mid").alias("callee_mid"), F.concat(F.lit("#arg"), F.col("k") - 1).alias("label"), F.col("nid").alias("dst"))
    return named.unionByName(placed.join(named.select("callee_mid", "label"), ["callee_mid", "label"], "left_anti"))


def exits(nodes: DataFrame) -> DataFrame:
    """(callee_mid, wanted, src): the outputs of methods by reference; without an output #return, the return nodes stand for it."""
    named = nodes.where("kind = 'output' and mid is not null and ref_name is not null").select(F.col("mid").alias("callee_mid"), F.col("ref_name").alias("wanted"), F.col("nid").alias("src"))
    returns = nodes.where("kind = 'return' and mid is not null").select(F.col("mid").alias("callee_mid"), F.lit("#return").alias("wanted"), F.col("nid").alias("src"))
    return named.unionByName(returns.join(named.where("wanted = '#return'").select("callee_mid"), "callee_mid", "left_anti"))


def argument_edges(nodes: DataFrame, links: DataFrame, methods: DataFrame, most: int | None = 1) -> DataFrame:
    """(src, dst, label, funcall): argument to the callee's input that takes the link's label."""
    at = resolved(nodes, methods, most).select(F.col("nid").alias("nid0"), "callee_mid")
    return links.join(at, "nid0").join(entries(nodes), ["callee_mid", "label"]).select(F.col("nid1").alias("src"), "dst", "label", F.col("nid0").alias("funcall"))


def result_edges(nodes: DataFrame, links: DataFrame, methods: DataFrame, most: int | None = 1) -> DataFrame:
    """(src, dst, label, funcall): the callee's output to what accepts that result of the call; '' means #return."""
    at = resolved(nodes, methods, most).select(F.col("nid").alias("nid1"), "callee_mid")
    wanted = F.when(F.col("label") == "", "#return").otherwise(F.col("label"))
    return links.join(at, "nid1").withColumn("wanted", wanted).join(exits(nodes), ["callee_mid", "wanted"]).select("src", F.col("nid0").alias("dst"), "label", F.col("nid1").alias("funcall"))


def interprocedural(nodes: DataFrame, links: DataFrame, methods: DataFrame, most: int | None = 1) -> DataFrame:
    """(src, dst, label, funcall, way): links within methods, and the edges of calls with their call node.

    ``way`` is 'in' for an argument, 'out' for a result and null within a method.
    """
    inner = links.select(F.col("nid1").alias("src"), F.col("nid0").alias("dst"), "label", F.lit(None).cast("long").alias("funcall"), F.lit(None).cast("string").alias("way"))
    into = argument_edges(nodes, links, methods, most).withColumn("way", F.lit("in"))
    return inner.unionByName(into).unionByName(result_edges(nodes, links, methods, most).withColumn("way", F.lit("out")))


def within(starts: DataFrame, edges: DataFrame, steps: int) -> DataFrame:
    """(start, nid, dist) reachable over ``edges`` (nid, nid1) in at most ``steps``, with the shortest distance."""
    seen = starts.select(F.col("nid").alias("start"), "nid", F.lit(0).cast("long").alias("dist"))
    front = seen
    for k in range(1, steps + 1):
        front = front.join(edges, "nid").select("start", F.col("nid1").alias("nid"), F.lit(k).cast("long").alias("dist")).distinct()
        front = cut(front.join(seen.select("start", "nid"), ["start", "nid"], "left_anti"))
        seen = seen.unionByName(front)
    return seen


def nearest(points: DataFrame, others: DataFrame, by: str, at: str, slots: int = 64) -> DataFrame:
    """As-of join: for each point the last other before it and the first after it, within ``by``.

    One union, sorted once upward and once downward with running frames, so the work is linear in the rows of a key. A key's
    rows are cut into ``slots`` ranges of ``at``, so that a key with most of the rows is spread over many tasks; what a
    range lacks comes from the ends of its neighbours, which are ``slots`` rows per key.
    """
    both = points.select(by, at).withColumn("o", F.lit(None).cast("long")).unionByName(others.select(by, at).withColumn("o", F.col(at)))
    span = both.groupBy(by).agg(F.min(at).alias("lo"), F.max(at).alias("hi"))
    share = (F.col(at).cast("double") - F.col("lo")) / (F.col("hi").cast("double") - F.col("lo") + 1.0)
    placed = both.join(span, by).withColumn("slot", F.least(F.lit(slots - 1), F.floor(share * slots))).drop("lo", "hi")
    up, down = W.partitionBy(by, "slot").orderBy(at), W.partitionBy(by, "slot").orderBy(F.desc(at))
    # rows of the same place: an other there is neither before nor after
    before = F.last("o", True).over(up.rangeBetween(W.unboundedPreceding, -1))
    after = F.last("o", True).over(down.rangeBetween(W.unboundedPreceding, -1))
    inside = placed.withColumn("b", before).withColumn("a", after).where("o is null")
    ends = placed.where("o is not null").groupBy(by, "slot").agg(F.min("o").alias("first"), F.max("o").alias("last"))
    grid = placed.select(by, "slot").distinct().join(ends, [by, "slot"], "left")
    w, v = W.partitionBy(by).orderBy("slot").rowsBetween(W.unboundedPreceding, -1), W.partitionBy(by).orderBy(F.desc("slot")).rowsBetween(W.unboundedPreceding, -1)
    grid = grid.select(by, "slot", F.last("last", True).over(w).alias("pb"), F.last("first", True).over(v).alias("pa"))
    return inside.join(grid, [by, "slot"]).select(at, F.coalesce("b", "pb").alias("before_id"), F.coalesce("a", "pa").alias("after_id"))


def points_in_ranges(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, bin_size: int = 256) -> DataFrame:
    """Every range with the points inside it, both ends included: an equi-join over the bins that a range touches."""
    placed = points.withColumn("bin", F.floor(F.col(at) / bin_size))
    touched = ranges.withColumn("bin", F.explode(F.sequence(F.floor(F.col(low) / bin_size), F.floor(F.col(high) / bin_size))))
    return placed.join(touched, "bin").where((F.col(at) >= F.col(low)) & (F.col(at) <= F.col(high))).drop("bin")


def overlaps(a: DataFrame, b: DataFrame, by: list[str], a0: str, a1: str, b0: str, b1: str, bin_size: int = 256) -> DataFrame:
    """Pairs of ranges that overlap, ends exclusive, within ``by``: an equi-join over bins.

    A pair meets in one bin only: that of the later of its two starts.
    """
    spread = lambda df, s, e: df.withColumn("bin", F.explode(F.sequence(F.floor(F.col(s) / bin_size), F.floor((F.col(e) - 1) / bin_size))))
    met = spread(a.where(F.col(a0) < F.col(a1)), a0, a1).join(spread(b.where(F.col(b0) < F.col(b1)), b0, b1), [*by, "bin"])
    first = F.floor(F.greatest(a0, b0) / bin_size)
    return met.where((F.col(a0) < F.col(b1)) & (F.col(b0) < F.col(a1)) & (F.col("bin") == first)).drop("bin")


def ordinals(df: DataFrame, by: str, *order: str) -> DataFrame:
    """``df`` with ``ord``, the number of each row within ``by`` in the given total order, from 1.

    The rows are sorted over all tasks by key and order, numbered inside of each range, and shifted by what lies in the
    ranges before: a key with most of the rows is numbered by as many tasks as its rows fill.
    """
    spread = cut(df.repartitionByRange(by, *order).withColumn("__part", F.spark_partition_id()))
    inside = F.row_number().over(W.partitionBy("__part", by).orderBy(*order))
    sizes = spread.groupBy(by, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy(by).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shift = sizes.select(F.col(by).alias("__by"), F.col("__part").alias("__p"), before.alias("__before"))
    numbered = spread.withColumn("__nth", inside)
    joined = numbered.join(shift, (F.col("__part") == F.col("__p")) & F.col(by).eqNullSafe(F.col("__by")))
    return joined.withColumn("ord", (F.col("__nth") + F.col("__before")).cast("long")).drop("__part", "__nth", "__before", "__by", "__p")
