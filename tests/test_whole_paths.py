"""Simple paths without a bound of their length, against plain Python."""

from weftline.operators import graph


def test_paths_of_any_length(spark):
    edges = [(k, k + 1) for k in range(9)] + [(5, 2), (3, 20), (20, 5), (9, 0), (30, 4)]
    out = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
    want, todo = set(), [(30,), (0,)]
    while todo:
        path = todo.pop()
        want.add(path)
        todo += [(*path, b) for b in out.get(path[-1], []) if b not in path]
    df = spark.createDataFrame(edges, "src bigint, dst bigint")
    got = graph.simple_paths(spark.createDataFrame([(30,), (0,)], "node bigint"), df).collect()
    assert sorted((tuple(r["path"]), r["len"]) for r in got) == sorted((p, len(p) - 1) for p in want)
    assert max(map(len, want)) > 9
    assert max(r["len"] for r in graph.simple_paths(spark.createDataFrame([(0,)], "node bigint"), df, 4).collect()) == 4
