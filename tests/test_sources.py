import json

import pytest
from pyspark.sql import functions as F

from weftline.operators import bayes, classes, spans, stitch
from weftline.sources import comments, graph_xml, records, stores
from weftline.streaming import increments

XML = """<?xml version="1.0"?><g><class name="LA;" extends="LB;" path="x"><method id="LA;.f()V" name="f" style="static"><ast type="31" start="1" end="9"/>
<scope name="s"><node id="n1" kind="value" data="&lt;1&quot;" type="I"><ast type="1" start="2" end="3"/></node><scope name="s.a"><node id="n2" type="I"><accept src="n1"/><accept label="L" src="n1"/></node></scope></scope></method></class></g>"""


def test_graph_documents(spark):
    df = spark.createDataFrame([(1, XML, "x"), (2, "<broken", "x"), (3, None, "x"), (4, "", "x"), (None, XML, "x")], "uid bigint, t string, kind string")
    rows = graph_xml.rows(df, "uid", "t")
    got = [tuple(r) for r in rows.orderBy("ord").select("entity", "parent_key", "item_key", "label", "kind", "ndata", "ast_start").collect()]
    assert got == [("class", None, "LA;", "", None, None, None), ("method", "LA;", "LA;.f()V", "", None, None, 1), ("scope", "LA;.f()V", "s", "", None, None, None), ("node", "s", "n1", "", "value", '<1"', 2), ("scope", "s", "s.a", "", None, None, None), ("node", "s.a", "n2", "", None, None, None), ("link", "n2", "n1", "", None, None, None), ("link", "n2", "n1", "L", None, None, None)]
    again = graph_xml.rows(graph_xml.write(rows, "uid"), "uid", "xml")
    assert [tuple(r) for r in again.orderBy("ord").select("entity", "parent_key", "item_key", "label", "kind", "ndata", "ast_start").collect()] == got
    assert graph_xml.rows(df.limit(0), "uid", "t").count() == 0


def test_records(spark):
    text = '+ITEM "a"\n+SCORE 1\n# note\n\n\n+ITEM "b"\nnoise\n+X'
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id bigint, text string")
    got = [(r["nth"], r["fields"]) for r in records.read(df, "id", "text").orderBy("nth").collect()]
    assert got == [(0, {"ITEM": '"a"', "SCORE": "1"}), (1, {"ITEM": '"b"', "X": ""})]
    back = records.read(records.write(records.read(df, "id", "text"), "id"), "id", "text")
    assert [(r["nth"], r["fields"]) for r in back.orderBy("nth").collect()] == got
    assert records.fields(df, "id", "text").count() == 3


def test_comments_and_marks(spark):
    text = 'int a; // x "y"\n\tString s = "/* no */"; /** doc */ b();\n/* open'
    got = comments.scan(text)
    assert [(text[s:e], k, line, col, b, a) for s, e, k, line, col, b, a in got] == [('// x "y"', "line", 0, 7, ";", "String"), ("/** doc */", "doc", 1, 31, ";", "b"), ("/* open", "block", 2, 0, ";", None)]
    assert spans.nested_marks("abcdef", [(1, 5, "o"), (2, 4, "i"), (1, 2, "x"), (3, 3, "e")]) == "a[o|[x|b][i|cd]e]f"
    files = spark.createDataFrame([(1, "ab\n\nc"), (2, ""), (3, None)], "uid bigint, t string")
    assert sorted(tuple(r) for r in spans.lines(files, "uid", "t").collect()) == [(1, 0, 0, 3, "ab"), (1, 1, 3, 4, ""), (1, 2, 4, 6, "c"), (2, 0, 0, 1, "")]


def test_stores_and_models(spark, tmp_path):
    feats = spark.createDataFrame([("x", "1,a,b", 2), ("x", "2,a,b", 1), ("y", "1,a,b", 5), (None, "1", 1)], "item string, feat string, c bigint")
    again = stores.read_feature_text(stores.feature_text(feats), "text")
    assert sorted(tuple(r)[:3] for r in again.collect()) == [("x", "1,a,b", 2), ("x", "2,a,b", 1), ("y", "1,a,b", 5)]
    obs = spark.createDataFrame([("k", None, 2), ("k", "f", 3), ("k", "f", -1), ("j", None, 1), ("j", "f", 1), ("j", "f", -1), ("i", None, 0)], "key string, feat string, w bigint")
    keys, fs = bayes.train(obs)
    stores.save_model(keys, fs, str(tmp_path / "m"))
    k, f = stores.load_model(spark, str(tmp_path / "m"))
    assert sorted(map(tuple, k.collect())) == [("j", 1), ("k", 2)] and [tuple(r) for r in f.collect()] == [("f", "k", 2)]
    fs.withColumn("c", F.lit(0)).write.mode("overwrite").parquet(str(tmp_path / "m/feats.parquet"))
    with pytest.raises(ValueError):
        stores.load_model(spark, str(tmp_path / "m"))


def test_stream_appends_once(spark, tmp_path):
    schema = "sid bigint, v string"
    spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    go = lambda: increments.append_files(spark, str(tmp_path / "in"), schema, "sid", str(tmp_path / "out"), str(tmp_path / "cp"))
    go()
    spark.createDataFrame([(2, "again"), (3, "d")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    go()
    go()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == [(1, "a"), (2, "b"), (3, "d")]


def test_stitching(spark):
    nodes = spark.createDataFrame([(1, 10, "value", None, None), (2, 10, "call", None, "LA;.g(I)I LB;.g(I)I"), (3, 10, "receive", None, None), (4, 20, "input", "#arg0", None), (5, 20, "output", "#return", None), (6, 30, "input", "#arg0", None), (7, None, "call", None, None)], "nid bigint, mid bigint, kind string, ref_name string, ndata string")
    links = spark.createDataFrame([(1, 2, 1, "#arg0"), (2, 3, 2, ""), (3, 5, 4, "")], "lid bigint, nid0 bigint, nid1 bigint, label string")
    methods = spark.createDataFrame([(20, "LA;.g(I)I"), (30, "LB;.g(I)I"), (31, "LB;.g(I)I"), (40, None)], "mid bigint, method_id string")
    got = {tuple(r) for r in stitch.interprocedural(nodes, links, methods).collect()}
    assert got == {(1, 2, "#arg0", None, None), (2, 3, "", None, None), (4, 5, "", None, None), (1, 4, "#arg0", 2, "in"), (5, 3, "", 2, "out")}
    assert {tuple(r) for r in stitch.argument_edges(nodes, links, methods, None).collect()} == {(1, 4, "#arg0", 2), (1, 6, "#arg0", 2)}


def test_all_arguments_and_fields_are_bound(spark):
    nodes = [(1, 10, "value", None, None), (2, 10, "value", None, None), (3, 10, "call", None, "LA;.g(II)I"), (4, 10, "receive", None, None), (8, 10, "value", None, None)]
    nodes += [(20, 20, "input", "$.:g/$a", None), (21, 20, "input", "$.:g/$b", None), (22, 20, "input", ".LA;/.f", None), (23, 20, "return", None, None), (24, 20, "return", None, None), (25, 20, "output", ".LA;/.f", None)]
    links = [(1, 3, 1, "#arg0"), (2, 3, 2, "#arg1"), (3, 3, 8, ".LA;/.f"), (4, 4, 3, ""), (5, 4, 3, ".LA;/.f")]
    nodes = spark.createDataFrame(nodes, "nid bigint, mid bigint, kind string, ref_name string, ndata string")
    links = spark.createDataFrame(links, "lid bigint, nid0 bigint, nid1 bigint, label string")
    methods = spark.createDataFrame([(20, "LA;.g(II)I")], "mid bigint, method_id string")
    edges = {(r.src, r.dst) for r in stitch.interprocedural(nodes, links, methods).where("way is not null").collect()}
    assert edges == {(1, 20), (2, 21), (8, 22), (23, 4), (24, 4), (25, 4)}


def test_nearest_around_points(spark):
    import random

    rnd = random.Random(2)
    at = rnd.sample(range(-500, 5000), 120) + [1 << 61, -(1 << 61)]
    rows = [(t, rnd.choice([1, 1, 1, 2]), rnd.random() < 0.4) for t in at]
    df = spark.createDataFrame(rows, "at bigint, who bigint, point boolean")
    for slots in (1, 5, 64):
        got = {tuple(r) for r in stitch.nearest(df.where("point"), df.where("not point"), "who", "at", slots).collect()}
        others = {w: sorted(t for t, x, p in rows if x == w and not p) for w in (1, 2)}
        assert got == {(t, max((o for o in others[w] if o < t), default=None), min((o for o in others[w] if o > t), default=None)) for t, w, p in rows if p}


def test_classes(spark):
    cls = spark.createDataFrame([("C", "B"), ("B", "A"), ("B", "A"), ("X", "Y"), ("Y", "X"), (None, "A"), ("D", None)], "name string, base string")
    closure = classes.ancestors(cls)
    assert {tuple(r) for r in closure.collect()} == {("C", "B", 1), ("C", "A", 2), ("B", "A", 1), ("X", "Y", 1), ("Y", "X", 1), ("X", "X", 2), ("Y", "Y", 2)}
    me = spark.createDataFrame([(c + ".f", c, "f()") for c in "ABC"] + [("A.g", "A", "g()"), ("q", None, "f()")], "method_id string, class_name string, signature string")
    assert {r["method_id"]: list(r["overriders"]) for r in classes.overriders(me, closure).collect()} == {"A.f": ["C.f", "B.f"], "B.f": ["C.f"]}


def test_cosine_keeps_pairs_of_hot_features(spark):
    import math
    import random

    rnd = random.Random(4)
    docs = {d: {rnd.choice([1, 2, 3, rnd.randrange(4, 40)]): rnd.randrange(1, 6) for _ in range(rnd.randrange(1, 7))} for d in range(60)}
    df = spark.createDataFrame([(d, f, w) for d, fs in docs.items() for f, w in fs.items()], "doc bigint, feat bigint, w bigint")
    count = {f: sum(f in fs for fs in docs.values()) for fs in docs.values() for f in fs}
    x = {d: {f: w * math.log(60 / count[f]) for f, w in fs.items() if count[f] > 1} for d, fs in docs.items()}
    norm = {d: math.sqrt(sum(v * v for v in fs.values())) for d, fs in x.items()}
    want = {(a, b) for a in x for b in x if a < b and norm[a] and norm[b] and round(sum(v * x[b].get(f, 0) for f, v in x[a].items()) / norm[a] / norm[b], 6) >= 0.6}
    assert {(r["a"], r["b"]) for r in bayes.cosine_pairs(df, 0.6).collect()} == want and want
    assert json.dumps(len(want))
