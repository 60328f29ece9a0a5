import random

from weftline.llm import parsecheck as pc

JAVA = 'class A {\n  /* { " */ int x = 1; // }\n  String s = "{\\"", t = """\n   } "q" \\""" {\n  """;\n  char c = \'}\';\n  void f() {\n  }\n}\n'


def test_chunk_maps_compose():
    rnd = random.Random(1)
    texts = [JAVA * 3]
    for _ in range(150):
        t = list(JAVA)
        for _ in range(rnd.randrange(1, 3)):
            t[rnd.randrange(len(t))] = rnd.choice(["{", "}", '"', "\n", "/*", "", "(", "*/", '"""'])
        texts.append("".join(t))
    for text in texts:
        whole = pc.summary("java", text)
        for size in (1, 7, 40):
            parts = pc.maps("java", text, size)
            assert "".join(pc.chunks(text, size)) == text
            while len(parts) > 1:  # any bracketing of the reduction
                k = rnd.randrange(len(parts) - 1)
                parts[k : k + 2] = [pc.compose("java", parts[k], parts[k + 1])]
            assert pc.balanced(parts[0]) == pc.balanced(whole)
            if pc.java_syntax.parses(text):
                assert pc.balanced(whole)


def test_languages_and_nulls(spark):
    rows = [
        (1, "a/X.JAVA", JAVA, "r"), (1, "a/X.JAVA", JAVA, "r"), (2, "x.java", JAVA[:-3], "r"), (3, "x.py", "def f(:\n", None), (4, "x.Py", "print(1)\r\n", None), (5, "x.py", "print 1\n", "q"),
        (6, "x.xml", "<a><b/></a>", "q"), (7, "x.graph", "<a>", "q"), (8, "x.json", "[1, 2]", "q"), (9, "x.json", "[1, 2", "q"), (10, "x.json", "NaN", "q"), (11, "x.txt", "}{", "q"), (12, "x.java", None, "q"),
        (13, None, "x", "q"), (14, "json", "x", "q"), (15, "x.java", "", "q"), (16, "x.json", "", "q"), (17, "x.json", '{"a": "\\u007d"}', "q"), (18, "x.xml", "<a>&b;</a>", "q"), (19, "x.xml", "é<a/>", "q"), (None, "x.json", "}", "q"),
        (20, "x.java", JAVA * 40 + "}", "q"), (21, "x.java", JAVA * 40, "q"), (22, "x.java", 'class A { String s = "\\u0022; }', "q"), (23, "x.py", "x = 1\x00", "q"), (24, "x.py", "\ufeffx = 1", "q"), (25, "x.json", "1" * 6000, "q"), (26, "x.py", "x = " + "1" * 6000, "q"), (27, "x.json", "\ufeff1", "q"),
    ]
    df = spark.createDataFrame([(*r, "z") for r in rows], "uid bigint, srcpath string, src_text string, reponame string, language string")
    for size, spread in ((64, 1 << 20), (64, 100), (1 << 16, 1 << 20)):
        got = {r["uid"]: r["valid"] for r in pc.checked(df, size, spread).collect()}
        assert {u for u, ok in got.items() if not ok} == {2, 3, 5, 7, 9, 10, 16, 18, 19, 20, 23, 27}
        assert set(got) == set(range(1, 28)) - {11, 12, 13, 14}
    rate = {(r["reponame"], r["language"]): (r["n_files"], r["n_invalid"]) for r in pc.rates(pc.checked(df)).collect()}
    assert rate["r", "java"] == (2, 1) and rate[None, "python"] == (2, 1)
    assert pc.checked(df.limit(0)).count() == 0


PYTHON = 'import a\n@d\n# c\nclass A:\n  """x\ny = ( """\n  def f(self):\n    return {1: [\n2]}\nif a:\n  b = \'(\' \\\n+ "\\\n"\nelse:\n  c = f"{a["b"]}("\ntry:\n  pass\nexcept E:\n  pass\n'
XML = '<?xml version="1.0"?>\n<!-- <a> -->\n<r a=">\n/>">\n<b><c/>x</b>\n<![CDATA[</b>]]><d\ne=\'/>\'/>\n<f>]]</f>&amp;\n</r>\n<!-- x -->'
JSON = '{"a": [1, {"b": "}\\"],"}],\n"c": null,\n\n"d": {"e": []}}'


def test_local_grammars_agree_with_whole_texts():
    rnd = random.Random(3)
    java = JAVA[:-2] + "  static int[] a = {1, 2}; int g() { return 1; }\n  private Object o = new Object() { void h() {} };\n  @B({1}) public void k() { }\n}\n"
    for language, text in (("java", java), ("java", java.replace("class A {", "interface A<T> {")), ("python", PYTHON * 2), ("xml", XML), ("json", JSON)):
        assert pc.GRAMMARS[language](text) and len(pc.groups(language, text, 10)) > 2
        good = 0
        for _ in range(500):
            t = list(text)
            for _ in range(rnd.randrange(0, 3)):
                t[rnd.randrange(len(t))] = rnd.choice(["{", "}", '"', "\n", "/*", "", "", "(", "*/", '"""', ",", "<", "/", " ", "else:", ">", ";", "'"])
            t = "".join(t)
            assert pc.valid(language, t, rnd.choice((1, 10, 30, 4096))) == pc.GRAMMARS[language](t), t
            good += pc.GRAMMARS[language](t)
        assert 30 < good < 480


def test_long_files_are_spread(spark):
    member = "  /* { */ int f%d(int a) { String s = \"}\"; return g(a, new int[] {1, 2}); }\n"
    body = "package p;\nimport q.R;\npublic class A {\n" + "".join(member % k for k in range(2500)) + "}\n"
    python = "".join(f"def f{k}(a):\n    return f'{{a['x']}}(' + a\n" for k in range(3000))
    xml = "<r>" + "".join(f"<a k='{k}'>x</a>\n" for k in range(6000)) + "</r>"
    rows = [("A.java", body), ("B.java", body.replace("f2000(int a)", "f2000(int)")), ("C.java", body[:-2]), ("d.py", python), ("e.py", python.replace("f77(a)", "f77(a:)")), ("f.xml", xml), ("g.xml", xml.replace("k='9'", "k=9")), ("h.json", "[" + "1,\n" * 40000 + "2]"), ("i.json", "[" + "1,\n" * 40000 + "]")]
    assert all(len(b) > 1 << 16 for _, b in rows)
    df = spark.createDataFrame([(k, n, b, None) for k, (n, b) in enumerate(rows)] * 2, "uid bigint, srcpath string, src_text string, reponame string")
    got = {r.uid: r.valid for r in pc.checked(df, 4096, 1 << 16).collect()}
    assert [rows[u][0] for u, ok in sorted(got.items()) if not ok] == ["B.java", "C.java", "e.py", "g.xml", "i.json"] and len(got) == len(rows)
