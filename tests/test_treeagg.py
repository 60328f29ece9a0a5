from collections import Counter, defaultdict

from pyspark.sql import functions as F

from weftline.operators import treeagg as ta


def test_hot_key_over_many_rounds(spark):
    rows = [(1 if k % 3 else None if k % 9 == 0 else k, k, None if k % 5 == 0 else k % 7, "x") for k in range(4000)]
    df = spark.createDataFrame(rows, "mid bigint, v bigint, w bigint, n string").repartition(7)
    states = [ta.count_rows("n"), ta.total("s", F.col("w")), ta.least("lo", F.col("v")), ta.greatest("hi", F.col("v")), ta.distinct_sketch("d", F.col("v"))]
    assert ta.tree_rounds(4000, 50, 4) > 3
    got = {r["mid"]: r for r in ta.tree_aggregate(df, "mid", states, rows=4000, chunk_rows=50, fan_in=4).withColumn("d", F.hll_sketch_estimate("d")).collect()}
    n, s, vs = Counter(r[0] for r in rows), Counter(), defaultdict(list)
    for m, v, w, _ in rows:
        s[m] += w or 0
        vs[m].append(v)
    assert {m: (r["n"], r["s"], r["lo"], r["hi"]) for m, r in got.items()} == {m: (n[m], s[m], min(vs[m]), max(vs[m])) for m in n}
    assert abs(got[1]["d"] - n[1]) < 0.05 * n[1]
    rough = {r[0]: r[1] for r in ta.tree_aggregate(df, "mid", [ta.count_rows("n")]).collect()}
    assert rough == dict(n)
    assert ta.tree_aggregate(df.limit(0), "mid", states).count() == 0
