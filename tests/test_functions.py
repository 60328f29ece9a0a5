from pyspark.sql import functions as F

from weftline.functions import names as fn
from weftline.functions import text as tx


def ask(spark, values, *columns):
    df = spark.createDataFrame([(v,) for v in values], "c string")
    return [tuple(r) if len(columns) > 1 else r[0] for r in df.select(*[c(F.col("c")) for c in columns]).collect()]


def test_words(spark):
    assert ask(spark, ["SomeXMLStuff", "getItem2", "", None, "x"], fn.split_words) == [["stuff", "xml", "some"], ["item", "get"], [], [], ["x"]] or ask(spark, ["SomeXMLStuff"], fn.split_words) == [["stuff", "xml", "some"]]
    assert ask(spark, ["someThingXML", "a1B", None, "__"], fn.split_camel) == [["some", "Thing", "XML"], ["a", "B"], [], []]
    assert ask(spark, ["tableRow", "XML", "a1", None], fn.head_noun) == ["row", "xml", None, None]


def test_references(spark):
    refs = ["$.:f:1/$x", ".La/B;/.name", "@La/B;", "%[I", "#arg0", "!La/E;", None, "plain"]
    assert ask(spark, refs, fn.reference_name)[:3] == ["x", ".name", "B"]
    assert ask(spark, refs, fn.reference_name)[4:] == ["arg0", "!E", None, "plain"]
    assert ask(spark, ["$.:f:1/$x", "@La/B;", "?!", None], fn.strip_id) == ["x", "B", None, None]


def test_signatures(spark):
    sigs = ["La/B;.get(ILa/C;)[J", "La/B;.:init:()V", None, "odd"]
    assert ask(spark, sigs, fn.method_class, fn.method_simple_name, fn.method_args, fn.method_result) == [("La/B;", "get", "ILa/C;", "[J"), ("La/B;", "init", "", "V"), (None, None, None, None), (None, None, "", None)]
    assert ask(spark, ["[[I", "La/B<TX;>;", "V", "TX;", "?", "(I)V", "*"], fn.type_dims, fn.type_kind, fn.class_simple_name) == [(2, "primitive", "I"), (0, "class", "B"), (0, "void", "V"), (0, "variable", "TX"), (0, "unknown", "?"), (0, "function", "(I)V"), (0, "wildcard", "*")]


def test_text(spark):
    assert ask(spark, ['a&<">', None], fn.html_escape) == ["a&amp;&lt;&quot;&gt;", None]
    assert ask(spark, ["a\n\tb\tc", "", None, "abc"], tx.column_position) == [17, 0, None, 3]
    assert ask(spark, ["a\n\nb", ""], tx.line_feeds) == [2, 0]
    assert ask(spark, ["a=1 b=2"], tx.properties) == [{"a": "1", "b": "2"}]
    assert ask(spark, ['a"\té😀', None], lambda c: tx.java_literal(c)) == ['"a\\"\\t\\u00e9\\ud83d\\ude00"', None]
    assert tx.lcs_length("abcde", "xaxcye") == 3 and tx.lcs_length("", "a") == 0
    df = spark.createDataFrame([("abc", "abd"), (None, "a"), ("", "")], "a string, b string")
    assert [r[0] for r in df.select(tx.lcs_similarity("a", "b")).collect()] == [2 / 3, 0.0, 0.0]


def test_descriptors(spark):
    from weftline.functions import descriptors as ds

    for text in ("I", "[[J", "La/B;", "La/B<TX;[I+La/C<*>;-Lq;>;", "(ILa/B<TT;>;[C)V", "()La/B;", "?", "(?)?"):
        t, end = ds.parse(text)
        assert end == len(text) and ds.render(t) == text
    got = ask(spark, ["(I[La/B<TT;>;)V", "La/Map<La/K;*>;", "[", "Lopen", "x", "II", None, ""], lambda c: ds.decode(c))
    assert [tuple(r) for r in got[:2]] == [("function", "(int, B<T>[]) -> void", ["I", "[La/B<TT;>;"], "V"), ("class", "Map<K, ?>", ["La/K;", "*"], None)]
    assert all(r["form"] is None for r in got[2:])
    assert [ds.conversion_distance(*p) for p in (("I", "I"), ("I", "J"), ("J", "I"), ("La/B;", "Ljava/lang/Object;"), ("Z", "I"), ("?", "I"))] == [0, 1, None, 9, None, 1]
