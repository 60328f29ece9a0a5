"""Structural matches, arguments of calls, ranges and stores, against plain Python."""

import random

from pyspark.sql import functions as F

from weftline import common
from weftline.operators import matching, spans, stitch
from weftline.sources import records, stores


def test_common_trees(spark):
    # method 1: a(b, c(d)), method 2: the same behind a relay, method 3: only a(b)
    nodes = [(1, 1, "a"), (2, 1, "b"), (3, 1, "c"), (4, 1, "d"), (11, 2, "a"), (12, 2, "b"), (13, 2, None), (14, 2, "c"), (15, 2, "d"), (21, 3, "a"), (22, 3, "b")]
    links = [(1, 2, "L"), (1, 3, "R"), (3, 4, ""), (11, 12, "L"), (11, 13, "R"), (13, 14, ""), (14, 15, ""), (21, 22, "L"), (21, 22, "_x")]
    n = spark.createDataFrame(nodes, "nid bigint, mid bigint, key string")
    e = spark.createDataFrame(links, "nid0 bigint, nid1 bigint, label string")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "qmid bigint, mid bigint")
    got = {tuple(r) for r in matching.common_trees(n, e, pairs, 2, 2).collect()}
    assert got == {(1, 2, 4, 3, 2), (1, 3, 2, 2, 1), (2, 3, 2, 2, 1)}
    assert matching.common_trees(n, e, pairs.limit(0), 2, 2).count() == 0


def test_arguments_of_calls(spark):
    f = matching.catalogue_rows()[0][0]
    nodes = [(1, 1, "call", None, f), (2, 1, "receive", None, None), (3, 1, "call", None, "LA;.name()I"), (4, 1, "new", None, f + " LB;.x(I)V"), (5, 1, "value", None, "1"), (6, 1, "ref_var", "$.:f/$path", None), (7, 1, "ref_var", "@LA;", None)]
    links = [(1, 1, 2, "#arg0"), (2, 2, 3, ""), (3, 4, 5, "#arg0"), (4, 4, 6, "#arg1"), (5, 1, 7, "#arg2"), (6, 1, 6, "@LA;"), (7, 1, 2, "#arg0")]
    n = spark.createDataFrame(nodes, "nid bigint, mid bigint, kind string, ref_name string, ndata string")
    e = spark.createDataFrame(links, "lid bigint, nid0 bigint, nid1 bigint, label string")
    catalogue = spark.createDataFrame(matching.catalogue_rows(), "func string, arg bigint, category string")
    got = {tuple(r) for r in matching.argument_rows(n, e, catalogue).collect()}
    assert got == {(1, f, 0, "path", "()name"), (1, f, 2, "other", None), (4, f, 0, "path", "#const"), (4, "LB;.x(I)V", 0, "other", "#const"), (4, f, 1, "other", "path"), (4, "LB;.x(I)V", 1, "other", "path")}
    assert len(set(matching.catalogue_rows())) == len(matching.catalogue_rows()) and len({c for *_, c in matching.catalogue_rows()}) == 12


def test_ranges(spark):
    rnd = random.Random(6)
    points = [rnd.randrange(-300, 900) for _ in range(80)]
    ranges = [(k, a, a + rnd.randrange(-2, 400)) for k, a in enumerate(rnd.randrange(-300, 900) for _ in range(40))]
    p = spark.createDataFrame([(x, i) for i, x in enumerate(points)], "at bigint, i bigint")
    r = spark.createDataFrame(ranges, "k bigint, a bigint, b bigint")
    got = {(x.i, x.k) for x in stitch.points_in_ranges(p, r.where("a <= b"), "at", "a", "b", 64).collect()}
    assert got == {(i, k) for i, x in enumerate(points) for k, a, b in ranges if a <= x <= b}
    for size in (1, 16, 1000):
        pairs = stitch.overlaps(r.select("k", "a", "b", F.lit(1).alias("g")), r.select(F.col("k").alias("j"), F.col("a").alias("c"), F.col("b").alias("d"), F.lit(1).alias("g")), ["g"], "a", "b", "c", "d", size)
        found = [(x.k, x.j) for x in pairs.collect()]
        want = {(k, j) for k, a, b in ranges for j, c, d in ranges if a < b and c < d and a < d and c < b}
        assert set(found) == want and len(found) == len(want)
    lines = spark.createDataFrame([(1, 0, 0, 10), (1, 1, 10, 5000), (1, 2, 5000, 5001)], "uid bigint, lineno bigint, start bigint, end bigint")
    over = spans.overlapping(lines, spark.createDataFrame([(1, 5, 11), (1, 4000, 5001), (2, 0, 9), (1, 7, 7)], "uid bigint, s bigint, e bigint"), "uid")
    assert sorted((r.lineno, r.s) for r in over.collect()) == [(0, 5), (1, 5), (1, 4000), (2, 4000)]


def test_kept_tables_follow_their_source(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(5).write.parquet(path)
    built = []

    def build():
        built.append(1)
        return spark.read.parquet(path).where("id > 1")

    assert common.kept(spark, "t", path, build).count() == 3 and common.kept(spark, "t", path, build).count() == 3 and len(built) == 1
    spark.range(50).write.mode("overwrite").parquet(path)
    assert common.kept(spark, "t", path, build).count() == 48 and len(built) == 2
    assert common.fits_broadcast(spark.range(10), 200) and not common.fits_broadcast(spark.range(1).select(F.array_repeat(F.lit("x" * 100), 100).alias("a")), 5000)


def test_store_specs(spark, tmp_path):
    folder = str(tmp_path / "s")
    stores.save({"dfmethod": spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "mid bigint, method_name string"), "feats": spark.createDataFrame([(1, "x")], "fid bigint, feat string")}, folder)
    some = stores.load_spec(spark, f"{folder}:1,3", ("dfmethod", "feats"))
    assert sorted(r.mid for r in some["dfmethod"].collect()) == [1, 3] and some["feats"].count() == 1
    assert stores.load_spec(spark, folder, ("dfmethod",))["dfmethod"].count() == 3


def test_lists_of_places(spark):
    text = "# no\n- 1 2 a=b\n+ x y.java\n- 3 4 key=v key=w z\n\n@ q.java 5 6 k=1=2\n - 7 x n=\n"
    df = spark.createDataFrame([(1, text, "p"), (2, None, "p"), (3, "", "p")], "id bigint, body string, path string")
    got = sorted((r.id, r.ord, r.path, r.s, r.e, dict(r.props)) for r in records.marks(df, "id", "body").collect())
    assert got == [(1, 3, "x y.java", 3, 4, {"key": "w"}), (1, 5, "q.java", 5, 6, {"k": "1=2"}), (1, 6, "x y.java", 7, None, {"n": ""})]


def test_feature_streams_in_parts(spark):
    rows = [("a", f"f{k}", k, [[k, k + 1]]) for k in range(10)] + [("b", "é\"", 3, []), (None, "x", 1, [])]
    df = spark.createDataFrame(rows, "item string, feat string, c bigint, srcs array<array<bigint>>")
    names = spark.createDataFrame([(1, "p/q.java"), (2, None), (None, "z")], "id bigint, path string")
    text = stores.feature_text(df, names, 3)
    assert text.where("item = 'a'").count() > 2
    assert {tuple(r) for r in stores.read_feature_text(text, "text").collect()} == {(i, f, c, len(s)) for i, f, c, s in rows if i}
    assert {tuple(r) for r in stores.read_sources(text, "text").collect()} == {(1, "p/q.java"), (2, "")}
