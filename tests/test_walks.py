"""Walks over a small program of two methods, worked out by hand."""

import pytest

from weftline.operators import stitch, walks

# caller 1: x = ...; y = g(x); z = y      callee 2: g(a) { b = a + 1; return b; }
NODES = [
    (10, 1, "ref_var", "$.:f/$x", None, "I"), (11, 1, "call", None, "LA;.g(I)I", "I"), (12, 1, "receive", None, None, "I"), (13, 1, "assign_var", "$.:f/$y", None, "I"), (14, 1, "ref_var", "$.:f/$y", None, "I"), (15, 1, "assign_var", "$.:f/$z", None, "I"),
    (20, 2, "input", "#arg0", None, "I"), (21, 2, "assign_var", "$.:g/$a", None, "I"), (22, 2, "ref_var", "$.:g/$a", None, "I"), (23, 2, "op_infix", None, "+", "I"), (24, 2, "assign_var", "$.:g/$b", None, "I"), (25, 2, "ref_var", "$.:g/$b", None, "I"), (26, 2, "return", None, None, "I"), (27, 2, "output", "#return", None, "I"), (28, 2, "value", None, "1", "I"),
    (30, 3, "ref_var", "$.:h/$p", None, "I"), (31, 3, "call", None, "LA;.g(I)I", "I"), (32, 3, "receive", None, None, "I"), (33, 3, "assign_var", "$.:h/$q", None, "I"),
]
LINKS = [(11, 10, "#arg0"), (12, 11, ""), (13, 12, ""), (14, 13, ""), (15, 14, ""), (21, 20, ""), (22, 21, ""), (23, 22, "L"), (23, 28, "R"), (24, 23, ""), (25, 24, ""), (26, 25, ""), (27, 26, ""), (31, 30, "#arg0"), (32, 31, ""), (33, 32, ""), (15, 10, "_x")]


@pytest.fixture(scope="module")
def program(spark):
    nodes = spark.createDataFrame(NODES, "nid bigint, mid bigint, kind string, ref_name string, ndata string, ntype string")
    links = spark.createDataFrame([(k, *e) for k, e in enumerate(LINKS)], "lid bigint, nid0 bigint, nid1 bigint, label string")
    methods = spark.createDataFrame([(1, "LA;.f()V"), (2, "LA;.g(I)I"), (3, "LA;.h()V")], "mid bigint, method_id string")
    return nodes, links, stitch.interprocedural(nodes, links, methods)


def readings(nodes):
    return nodes.where("kind = 'ref_var'").selectExpr("nid", "ref_name as from_ref")


def test_chains_cross_calls(program):
    nodes, links, edges = program
    steps = walks.chain_steps(edges, nodes, links)
    got = {(r.from_ref[-1], r.to_ref[-1], r.n_nodes, r.n) for r in walks.variable_chains(steps, readings(nodes)).collect()}
    # the input of a callee is entered over its argument; receive nodes take results of both the call and the callee
    assert got == {("x", "a", 3, 1), ("x", "y", 4, 1), ("y", "z", 2, 1), ("a", "b", 3, 1), ("b", "y", 5, 1), ("b", "q", 5, 1), ("p", "a", 3, 1), ("p", "q", 4, 1)}
    assert {r.n_nodes for r in walks.variable_chains(steps, readings(nodes), 3).collect()} == {2, 3}
    keys = {(r.from_ref[-1], r.to_ref[-1], r.chain_key) for r in walks.chain_keys(steps, readings(nodes), 8, 2).collect()}
    assert keys == {("x", "y", "#arg0,call,g ,assign_var"), ("p", "q", "#arg0,call,g ,assign_var"), ("a", "b", "L,op_infix,+ ,assign_var"), ("a", "b", "L,op_infix,+|R,value,1 ,assign_var")}


def test_feature_walk_matches_calls(program, spark):
    nodes, _, edges = program
    starts = spark.createDataFrame([(13, "$.:f/$y")], "nid bigint, item string")
    feats = {r.feat for r in walks.feature_walk(edges, walks.node_features(nodes), starts, 80).collect()}
    assert "-1,,:call:g" in feats and "-2,:call:g,#arg0:ref_var:x" in feats
    # into the callee by its result and out by its argument: x of this call, and p of the other call never
    assert any("ref_var:b" in f for f in feats) and not any("ref_var:p" in f for f in feats)
    assert "1,,:ref_var:y" not in feats and any(f.startswith("1,,") and "SELF" not in f for f in feats)
    assert {r.feat for r in walks.feature_walk(edges, walks.node_features(nodes), starts, 3).collect()} < feats
    assert walks.feature_walk(edges, walks.node_features(nodes), starts.limit(0)).count() == 0


def test_flows_with_contexts(program):
    nodes, _, edges = program
    got = {(r.src_ref[-1], r.dst_ref[-1], r.n_contexts) for r in walks.matched_flows(edges, nodes, nodes.where("nid in (15, 33)").select("nid")).collect()}
    # what happens inside of the callee happens once per call of it
    assert got == {("y", "z", 1), ("b", "y", 1), ("b", "q", 1), ("a", "b", 2), ("x", "a", 1), ("p", "a", 1), ("x", "y", 1), ("p", "q", 1)}


def test_order_of_calls(spark):
    nodes = spark.createDataFrame([(k, 1) for k in range(1, 8)] + [(9, 2), (None, 1)], "nid bigint, mid bigint")
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (3, 6), (7, 5)], "src bigint, dst bigint")
    calls = spark.createDataFrame([(2, 1), (4, 1), (6, 1), (8, None)], "nid bigint, mid bigint")
    got = {tuple(r) for r in walks.call_order(calls, edges, nodes).collect()}
    assert got == {(1, None, 2), (1, 2, 4), (1, 2, 6), (1, 4, None), (1, 6, None), (1, None, None)}


def test_longest_ways_match_returns(program):
    nodes, links, edges = program
    # the callee's input is fed, so the ways from unfed inputs need one
    from pyspark.sql import functions as F

    more = nodes.unionByName(nodes.limit(1).select(F.lit(9).cast("long").alias("nid"), F.lit(1).cast("long").alias("mid"), F.lit("input").alias("kind"), F.lit("#arg0").alias("ref_name"), F.lit(None).cast("string").alias("ndata"), "ntype"))
    more = more.unionByName(more.limit(1).select(F.lit(16).cast("long").alias("nid"), F.lit(1).cast("long").alias("mid"), F.lit("output").alias("kind"), F.lit("#return").alias("ref_name"), F.lit(None).cast("string").alias("ndata"), "ntype"))
    extra = links.limit(2).withColumn("k", F.monotonically_increasing_id() % 2)
    joined = links.unionByName(extra.select(F.lit(90).cast("long").alias("lid"), F.lit(10).cast("long").alias("nid0"), F.lit(9).cast("long").alias("nid1"), F.lit("").alias("label")).limit(1)).unionByName(extra.select(F.lit(91).cast("long").alias("lid"), F.lit(16).cast("long").alias("nid0"), F.lit(15).cast("long").alias("nid1"), F.lit("").alias("label")).limit(1))
    inner = joined.selectExpr("nid1 as src", "nid0 as dst", "label", "cast(null as bigint) as funcall", "cast(null as string) as way")
    both = inner.unionByName(edges.where("way is not null"))
    got = {tuple(r) for r in walks.longest_ways(both, more, 16).collect()}
    # 9 10 | 20 21 22 23 24 25 26 27 | 12 13 14 15 16: a, b, y and z are assigned
    assert got == {(9, 16, 4, 15)}
    assert {tuple(r) for r in walks.longest_ways(both, more, 8).collect()} == {(9, 16, 2, 8)}
