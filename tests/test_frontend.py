from collections import Counter

import pytest
from test_java_syntax import BAD, GOOD

from weftline.frontend import build
from weftline.frontend.build import File, graph_rows, java_graphs
from weftline.sources import graph_xml

CODE = """package a.b; import c.D; import java.util.*;
class T extends D implements E {
  int sum; static String[] names = {"x", "y"};
  T(int k) { super(k); sum = k; }
  int loop(int n, D d) { int s = 0; for (int i = 0; i < n; i++) { if (i % 2 == 0) { s += i; continue; } s -= half(i); } return s; }
  int half(long x) { return 1; }
  int half(int x) { return x > 0 ? x / 2 : -x; }
  int each(List<String> xs) { int c = 0; for (String x : xs) c += x.length(); do { c--; } while (c > 9); return c; }
  void risky(Object o) { try { if (o instanceof String q) throw new Error(q); sum = 2; } catch (Error | Oops e) { sum = 3; } finally { sum++; } }
  int pick(int k) { switch (k) { case 1: return 5; case 2: k = 7; break; default: k = 9; } return k; }
  Runnable later(int v) { int[] a = new int[3]; a[v] = 1; return () -> half(v); }
  class In<X> { X it; X get() { return this.it; } }
}"""


def rows_of(text):
    rows = graph_rows(text)
    nodes = {r[3]: r for r in rows if r[1] == "node"}
    links = [(r[2], r[4], r[3]) for r in rows if r[1] == "link"]
    return rows, nodes, links


def test_structure():
    rows, nodes, links = rows_of(CODE)
    assert [r[3] for r in rows if r[1] == "class"] == ["La/b/T;", "La/b/T$In;"]
    top = next(r for r in rows if r[1] == "class")[11]
    assert top["extends"] == "Lc/D;" and top["implements"] == "La/b/E;" and top["fields"] == "sum:I names:[Ljava/lang/String;"
    ids = [r[3] for r in rows if r[1] == "method"]
    assert "La/b/T;.:init:(I)V" in ids and "La/b/T;.loop(ILc/D;)I" in ids and "La/b/T;.:clinit:()V" in ids and "La/b/T$In;.get()TX;" in ids
    assert all(src in nodes and dst in nodes for dst, _, src in links)
    scopes = {r[3]: r[2] for r in rows if r[1] == "scope"}
    assert all(r[2] in scopes for r in nodes.values()) and all(p in scopes or p in ids for p in scopes.values())
    assert CODE[nodes["M3_loop_N0"][9] or 0 :]  # spans are offsets into the text


def test_flow():
    _, nodes, links = rows_of(CODE)
    kind = {k: v[5] for k, v in nodes.items()}
    into = {(dst, label): src for dst, label, src in links}
    calls = [v[7] for v in nodes.values() if v[5] == "call"]
    assert "La/b/T;.half(I)I" in calls and "La/b/T;.half(J)I" not in calls and "!length" in calls
    for dst, label, src in links:
        if kind[dst] == "begin":
            assert label in ("init", "cont") and (label != "cont" or kind[src] == "repeat")
        if label == "_end":
            assert kind[dst] == "repeat" and kind[src] == "end" and into[src, "_repeat"] == dst
        if kind[dst] == "receive":
            assert kind[src] in ("call", "new")
    n = Counter(kind.values())
    assert n["op_iter"] == 1 and n["throw"] == 1 and n["op_typecheck"] == 1 and n["capture"] == 1 and n["case"] == 3 and n["assign_array"] == 1
    assert n["begin"] == n["end"] and n["catchjoin"] >= 1
    returns = [(dst, src) for dst, label, src in links if kind[dst] == "output" and nodes[dst][6] == "#return"]
    assert all(kind[src] in ("return", "join") for _, src in returns) and len(returns) == 8


@pytest.mark.parametrize("text", GOOD)
def test_all_forms_build(text):
    rows, nodes, links = rows_of(text)
    assert all(src in nodes and dst in nodes for dst, _, src in links) and not any(r[1] == "error" for r in rows)
    File(text)


def test_frame_and_errors(spark):
    df = spark.createDataFrame([(1, CODE, "x"), (2, BAD[0], "x"), (3, None, "x"), (4, "", "x"), (None, CODE, "x")], "uid bigint, t string, kind string")
    rows = java_graphs(df, "uid", "t").cache()
    assert {(r["uid"], r["entity"]) for r in rows.select("uid", "entity").collect()} == {(1, e) for e in ("class", "method", "scope", "node", "link")} | {(2, "error")}
    again = graph_xml.rows(graph_xml.write(rows.where("entity <> 'error'"), "uid"), "uid", "xml")
    keys = ["entity", "parent_key", "item_key", "label", "kind", "ref", "ndata", "ntype"]
    count = lambda x: Counter(map(tuple, x.where("uid = 1").select(*keys).collect()))
    assert count(again) == count(rows)


BASE = """package a.b;
import java.util.*;
public class Base implements Shape { protected int size; int grow(int by) { return size + by; } long grow(long by) { return by; } }
"""
SUB = """package c;
import a.b.*;
import static c.d.Util.twice;
public class Sub extends Base {
  enum Color { RED, GREEN }
  int f(short s, Integer boxed) {
    Runnable r = () -> { size = grow(s); };
    Object o = new Base() { int grow(int by) { return twice(by); } };
    java.util.function.Function<Integer, Integer> g = this::grow;
    Color[] all = Color.values();
    class Inner { int k() { return size; } }
    assert s > boxed;
    return grow(s) + grow(boxed);
  }
}
"""
UTIL = "package c.d; public class Util { public static int twice(int v) { return 2 * v; } static int twice(Object o) { return 0; } }"


def test_names_over_several_files(spark):
    df = spark.createDataFrame([(1, BASE, "r"), (2, SUB, "r"), (3, UTIL, "r"), (4, UTIL, None), (5, "class {", "r"), (6, None, "r"), (7, SUB, "other")], "uid bigint, src_text string, reponame string")
    rows = build.java_graphs(df, "uid", "src_text", "reponame").collect()
    data = lambda uid, kind: [r.ndata for r in rows if r.uid == uid and r.entity == "node" and r.kind == kind]
    refs = {r.ref for r in rows if r.uid == 2 and r.entity == "node"}
    # a short widens to int before long; a box gives its int
    assert data(2, "call").count("La/b/Base;.grow(I)I") == 3 and "La/b/Base;.grow(J)J" not in data(2, "call")
    assert "Lc/Sub$Color;.values()[Lc/Sub$Color;" in data(2, "call") and ".La/b/Base;/.size" in refs
    assert "La/b/Base;.grow(I)I" in data(2, "capture") and any(":lambda" in x for x in data(2, "capture"))
    styles = {r.item_key: r.attributes["style"] for r in rows if r.uid == 2 and r.entity == "method"}
    assert sum(s == "lambda" for s in styles.values()) == 1 and any(k.endswith("Inner;.k()I") for k in styles)
    names = {r.item_key for r in rows if r.uid == 2 and r.entity == "class"}
    assert len(names) == 4  # with the enum, the local and the anonymous class
    assert "Lc/d/Util;.twice(I)I" in data(2, "call")
    # another project does not know the classes
    assert "!grow" in data(7, "call") and {r.entity for r in rows if r.uid == 5} == {"error"}
    alone = build.java_graphs(df, "uid", "src_text").where("uid = 2").collect()
    assert "!grow" in [r.ndata for r in alone if r.kind == "call"]
    assert build.java_graphs(df.limit(0), "uid", "src_text", "reponame").count() == 0


def test_purge_takes_out_joins_of_one_value():
    g = build.MethodGraph.__new__(build.MethodGraph)
    row = lambda kind, *links: {"kind": kind, "ref": "$x", "scope": "s", "links": list(links)}
    g.rows = [row("value"), row("value"), row("join", ("cond", 1), ("true", 0), ("false", 0)), row("join", ("cond", 1), ("true", 0), ("false", 1)), row("join", ("cond", 1), ("true", 2), ("false", 1)), row("output", ("", 4))]
    g.purge()
    assert [r["kind"] for r in g.rows] == ["value", "value", "join", "output"] and g.rows[3]["links"] == [("", 2)]
