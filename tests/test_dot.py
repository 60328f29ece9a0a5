"""Every method has its graph, large ones in several rows."""

import re

import pytest

from weftline.sources import graph_xml


@pytest.mark.parametrize("block", [4, 1024])
def test_large_methods_have_graphs(spark, block):
    nodes = [(k, 1, 7 if k % 3 else None, "ref_var", "$x", None) for k in range(120)] + [(k, 2, 8, "call", None, 'LA;.f()V "q"') for k in range(200, 203)] + [(300, None, 9, "value", None, "1"), (400, 3, 9, "value", None, "1")]
    links = [(k, k + 1, k, "_end" if k % 2 else "") for k in range(119)] + [(500, 201, 200, "L"), (501, 202, 300, ""), (502, 300, 200, "")]
    n = spark.createDataFrame(nodes, "nid bigint, mid bigint, sid bigint, kind string, ref_name string, ndata string")
    ln = spark.createDataFrame(links, "lid bigint, nid0 bigint, nid1 bigint, label string")
    rows = graph_xml.dot(n, ln, block).collect()
    text = {}
    for r in sorted(rows, key=lambda r: (r["mid"], r["section"], r["sid"] or -1, r["block"] or -1)):
        text[r["mid"]] = text.get(r["mid"], "") + r["dot"] + "\n"
    assert set(text) == {1, 2, 3}
    for mid, t in text.items():
        assert t.startswith("digraph {\n") and t.endswith("\n}\n") and t.count("{") == t.count("}") and t.count("digraph") == 1
        assert sorted(map(int, re.findall(r"^  N(\d+) \[", t, re.M))) == sorted(x[0] for x in nodes if x[1] == mid)
        own = {x[0] for x in nodes if x[1] == mid}
        assert sorted((int(b), int(a)) for a, b in re.findall(r"^ N(\d+) -> N(\d+) ", t, re.M)) == sorted((x[1], x[2]) for x in links if x[1] in own)
    assert all(len(re.findall(r"^ *N\d+", r["dot"], re.M)) <= block for r in rows)
    assert len([r for r in rows if r["mid"] == 3]) == 1 and (len(rows) == 3) == (block == 1024)
