"""Lines, spans and columns of files beyond ASCII, against plain Python."""

from weftline.plans import reports, texts

TEXTS = {1: "a{b}\nc", 2: "é\tü{\nß😀}\nz", 3: "\t\t日本 {x\n\n}\n\n\n\nend\n", 4: "😀\n😀😀 } {", 5: "", 6: "ключ\nno block", 7: None}


def column(line):
    at = 0
    for ch in line:
        at = (at // 8 + 1) * 8 if ch == "\t" else at + 1
    return at


def test_spans_of_all_files(spark, tmp_path):
    fields = "uid bigint, filename string, reponame string, branchname string, commitid string, srcpath string, src_text string"
    spark.createDataFrame([(k, "f", "r", "b", "c", "p", t) for k, t in TEXTS.items()], fields).write.parquet(str(tmp_path / "sourcemap.parquet"))
    d = str(tmp_path)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    offsets, hits, blocks, columns, shown = [], [], [], [], []
    for uid, t in TEXTS.items():
        if t is None:
            continue
        s, e, at, own, count = t.find("{"), t.find("}") + 1, 0, [], t.count("\n") + 1
        for n, line in enumerate(t.split("\n")):
            offsets.append((uid, n, at, at + len(line) + 1))
            if 0 <= s < e and s < at + len(line) + 1 and at < e:
                own.append(n)
            at += len(line) + 1
        hits += [(uid, n) for n in own]
        near = {n + k for n in own for k in range(-2, 3)} & set(range(count))
        shown += [(uid, n, "+" if n in own else " ") for n in near]
        if s >= 0:
            columns.append((uid, column(t[:s].split("\n")[-1])))
        if 0 <= s < e:
            blocks.append((uid, t[s:e], t.count("\n")))
    assert rows(texts.line_offsets(spark, d)) == sorted(offsets)
    assert rows(texts.span_lines(spark, d)) == sorted(hits) and {u for u, _ in hits} == {1, 2, 3}
    assert rows(texts.span_text(spark, d)) == sorted(blocks)
    assert rows(reports.block_columns(spark, d)) == sorted(columns)
    assert rows(texts.annotated_lines(spark, d).drop("gap")) == sorted(shown)
