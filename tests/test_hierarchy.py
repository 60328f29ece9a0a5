import random

import pytest

from weftline.operators.hierarchy import below, hierarchy

SCHEMA = "sid bigint, parent bigint, nm string, mid bigint, root string"


def brute(rows):
    parent = {r[0]: r[1] for r in rows if r[0] is not None}
    name = {r[0]: r[2] or "" for r in rows}
    out = {}
    for s in parent:
        seen, v = [s], s
        while parent[v] is not None and parent[v] in parent and parent[v] not in seen:
            v = parent[v]
            seen.append(v)
        if parent[v] in parent and parent[v] is not None:
            at, on = s, False
            for _ in range(len(parent)):
                at = parent[at]
                on = on or at == s
            out[s] = (-1, -1 if on else -2, None)
        else:
            out[s] = (v, len(seen) - 1, "/".join(name[x] for x in reversed(seen)))
    return out


def forest(seed, n):
    rnd = random.Random(seed)
    rows = []
    for k in range(n):
        p = rnd.choice([None, rnd.randrange(n), 10**6, max(0, k - 1), max(0, k - 1), max(0, k - 1), rnd.randrange(max(1, k))])
        rows.append((k, p, rnd.choice(["a", "b", None]), rnd.choice([None, 1, 1, 1, k // 7]), "x"))
    return rows + rows[: n // 5] + [(None, 1, "n", 1, "x")]


@pytest.mark.parametrize("seed,block_rows,task_links", [(1, 10**6, 10**6), (2, 7, 10**6), (3, 7, 0), (4, 3, 0), (5, 3, 10**6)])
def test_against_brute_force(spark, seed, block_rows, task_links):
    rows = forest(seed, 60)
    df = spark.createDataFrame(rows, SCHEMA)
    got = hierarchy(df, "sid", "parent", "nm", "mid", block_rows, task_links).collect()
    assert {r["sid"]: (r["root"], r["depth"], r["path"]) for r in got} == brute(rows)
    assert len(got) == 60
    trees = [r for r in got if r["first"] is not None]
    parent = {r[0]: r[1] for r in rows}
    for a in trees:
        inside = {b["sid"] for b in trees if b["root"] == a["root"] and a["first"] < b["first"] <= a["last"]}
        under = set()
        for b in trees:
            v = parent[b["sid"]]
            while v in parent and v is not None and v != a["sid"]:
                v = parent[v]
            if v == a["sid"]:
                under.add(b["sid"])
        assert inside == under


def test_long_circle_and_tail_over_many_blocks(spark):
    rows = [(k, (k + 1) % 40, None, k, "x") for k in range(40)] + [(100 + k, 99 + k if k else 5, None, k, "x") for k in range(30)]
    df = spark.createDataFrame(rows, SCHEMA)
    for links in (0, 10**6):
        got = {r["sid"]: r["depth"] for r in hierarchy(df, "sid", "parent", None, "mid", 2, links).collect()}
        assert got == {k: -1 for k in range(40)} | {100 + k: -2 for k in range(30)}


def test_empty_and_below(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert hierarchy(df, "sid", "parent", "nm", "mid").count() == 0
    df = spark.createDataFrame([(1, None, "r", 1, "x"), (2, 1, "k", 1, "x"), (3, 2, "g", 2, "x")], SCHEMA)
    ranges = hierarchy(df, "sid", "parent", "nm", "mid")
    assert sorted(map(tuple, below(ranges, "sid", df).collect())) == [(1, 2), (1, 3), (2, 3)]
    assert sorted(map(tuple, below(ranges, "sid", df, 1).collect())) == [(1, 2), (1, 3), (2, 3)]


def test_ids_of_the_full_range_and_an_outlier(spark):
    rnd = random.Random(9)
    ids = [rnd.randrange(-(1 << 62), 1 << 62) for _ in range(60)] + [-1, -(1 << 63) + 2, (1 << 63) - 1]
    rows = [(s, rnd.choice([None, *ids[:k]]) if k else None, "n", 7, "x") for k, s in enumerate(ids)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = hierarchy(df, "sid", "parent", "nm", "mid", 10, 10**6).collect()
    assert {r["sid"]: (r["root"], r["depth"], r["path"]) for r in got} == brute(rows)
    dense = [(k, k // 3 if k else None, "n", 7, "x") for k in range(200)] + [(1 << 60, 0, "n", 7, "x")]
    got = hierarchy(spark.createDataFrame(dense, SCHEMA), "sid", "parent", "nm", "mid", 50, 10**6)
    assert {r["sid"]: (r["root"], r["depth"], r["path"]) for r in got.collect()} == brute(dense)
    pairs = {tuple(r) for r in below(got, "sid", got, 16).collect()}
    want = set()
    for s, p, *_ in dense:
        while p is not None:
            want.add((p, s))
            p = dense[p][1]
    assert pairs == want
