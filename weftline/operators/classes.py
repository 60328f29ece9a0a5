"""Class hierarchies: ancestors, and the methods that override others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.common import cut


def ancestors(classes: DataFrame) -> DataFrame:
    """(name, ancestor, dist) of (name, base) rows, one per base; a cycle of bases ends where a pair repeats."""
    base = cut(classes.where("name is not null and base is not null").select("name", "base").distinct())
    front = base.select("name", F.col("base").alias("ancestor"), F.lit(1).cast("long").alias("dist"))
    seen = front
    while True:
        step = front.join(base.toDF("ancestor", "far"), "ancestor").select("name", F.col("far").alias("ancestor"), (F.col("dist") + 1).alias("dist"))
        front = cut(step.groupBy("name", "ancestor").agg(F.min("dist").alias("dist")).join(seen, ["name", "ancestor"], "left_anti"))
        if front.limit(1).count() == 0:
            return seen
        seen = cut(seen.unionByName(front))


def overriders(methods: DataFrame, closure: DataFrame) -> DataFrame:
    """(method_id, overriders array): for each method those of subclasses with its name and arguments, deepest first.

    ``methods`` has (method_id, class_name, signature), where the signature is name and arguments.
    """
    own = methods.where("class_name is not null and signature is not null").distinct()
    sub = own.select(F.col("method_id").alias("over"), F.col("class_name").alias("name"), "signature")
    base = own.select("method_id", F.col("class_name").alias("ancestor"), "signature")
    hits = sub.join(closure, "name").join(base, ["ancestor", "signature"])
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("dist")).alias("d"), "over")))
    return hits.groupBy("method_id").agg(F.transform(ordered, lambda x: x["over"]).alias("overriders"))
