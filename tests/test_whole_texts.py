"""Literals, other values and the tokens beside comments are whole, however long."""

from weftline.frontend.build import graph_rows
from weftline.sources import comments, graph_xml

ONE, TWO = '"' + "x" * 300 + 'a"', '"' + "x" * 300 + 'b"'
BLOCK = '"""\n' + "  select a from b where c\n" * 40 + '"""'


def test_long_literals():
    chain = "java.util." + "inner." * 60 + "Last[].class"
    rows = graph_rows(f"class T {{ String a = {ONE}; String b() {{ Object k = {chain}; return {TWO} + {BLOCK}; }} }}")
    data = {r[7] for r in rows if r[1] == "node"}
    assert {ONE, TWO, BLOCK} <= data
    assert any(v.endswith("class") and len(v) > 300 for v in data if v)
    again = graph_xml.parse(graph_xml.render(rows))
    assert {r[7] for r in again if r[1] == "node"} >= {ONE, TWO}


def test_long_tokens_beside_comments():
    got = comments.scan(f"a = {ONE} /* c */ + /* d */ {BLOCK};")
    assert [(x[5], x[6]) for x in got] == [(ONE, "+"), ("+", BLOCK)]
