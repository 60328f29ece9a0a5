import json
import random

from weftline.operators import shred as sh


def brute(body):
    """Rows of one record, by plain recursion."""
    rec = sh.decoded(body)
    rows = []

    def many(x):
        x = sh.decoded(x) if isinstance(x, str) else x
        if x is None:
            return []
        return [z for y in x for z in many(y)] if isinstance(x, list) else [x]

    def scope(s, parent):
        rows.append(("scope", parent, s.get("name"), ""))
        for n in many(s.get("nodes")):
            rows.append(("node", s.get("name"), n.get("id"), ""))
            for a in many(n.get("accept")):
                rows.append(("link", n.get("id"), a.get("src"), a.get("label") or ""))
        for c in many(s.get("scopes")):
            scope(c, s.get("name"))

    for c in [c for r in many(rec) for ex in many(r.get("export")) if isinstance(ex, dict) for c in many(ex.get("class"))]:
        for m in many(c.get("methods")):
            rows.append(("method", c.get("name"), m.get("id"), ""))
            for s in many(m.get("scope")):
                scope(s, m.get("id"))
    return rows


def record(rnd):
    def maybe(items):
        if not items:
            return rnd.choice([None, [], "absent"])
        if len(items) == 1 and rnd.random() < 0.5:
            return items[0]
        return json.dumps(items) if rnd.random() < 0.1 else items

    def put(d, k, v):
        if v != "absent":
            d[k] = v
        return d

    count = [0]

    def scope(depth, name):
        nodes = []
        for _ in range(rnd.randrange(4)):
            count[0] += 1
            links = [put({"src": f"N{rnd.randrange(9)}"}, "label", rnd.choice(["", None, "absent", "L"])) for _ in range(rnd.randrange(3))]
            nodes.append(put({"id": f"N{count[0]}", "kind": None}, "accept", maybe(links)))
        kids = [scope(depth + 1, f"{name}.{k}") for k in range(rnd.randrange(3 if depth < 6 else 1))]
        s = put(put({"name": name}, "nodes", maybe(nodes)), "scopes", maybe(kids))
        return json.dumps(s) if rnd.random() < 0.1 else s

    methods = []
    for m in range(rnd.randrange(4)):
        methods.append(put({"id": f"m{m}", "callers": rnd.choice([None, "x", ["x", "y"]])}, "scope", rnd.choice([None, "absent", scope(0, f"s{m}"), scope(0, f"s{m}"), [scope(0, f"s{m}"), scope(0, "t")]])))
    one = put({"name": "C"}, "methods", maybe(methods))
    body = json.dumps({"export": {"class": one if rnd.random() < 0.8 else [one, {"name": "D", "methods": {"id": "d"}}]}})
    for _ in range(rnd.choice([0, 0, 0, 1, 2])):
        body = json.dumps(body)
    return body if rnd.random() < 0.9 else body[:-3]


def test_against_recursion(spark):
    rnd = random.Random(5)
    bodies = [record(rnd) for _ in range(120)] + [None, "", "null", "[]", "7", '"x"', "NaN", "{}", '{"export": 3}', '{"export": {"class": []}}']
    df = spark.createDataFrame([(k, b, "x") for k, b in enumerate(bodies)] + [(None, bodies[0], "x")], "rec_id bigint, body string, entity string")
    got = sorted(map(repr, ((r.rec_id, r.entity, r.parent_key, r.item_key, r.label) for r in sh.flat_rows(df).collect())))
    want = sorted(repr((k, *r)) for k, b in enumerate(bodies) if b is not None for r in brute(b))
    assert got == want and len(want) > 300


def test_levels_and_depth():
    body = {"name": "s0", "nodes": []}
    for k in range(1, 3000):
        body = {"name": f"s{k}", "scopes": [body]}
    columns = sh.shred([{"export": {"class": {"name": "C", "methods": {"id": "m", "scope": body}}}}])
    deep = [p for p in columns if p.endswith("scope")]
    assert len(deep) == 3000 and columns[deep[-1]].defs == [columns[deep[-1]].def_level - 1]
    assert columns["class.method"].reps == [0] and columns["class.method"].rep_level == 2
    two = sh.shred([{"export": {"class": {"methods": [{"id": "a", "callers": ["x", "y"]}, {"id": "b"}]}}}, None])
    assert two["class.method.caller"].reps == [0, 3, 2] and two["class.method.caller"].defs == [3, 3, 2]
    assert two["class"].defs == [1, 0]


def test_lists_of_classes_and_equal_names(spark):
    body = json.dumps({"export": {"class": [{"name": "A", "methods": {"id": "m1", "scope": [{"name": "s", "nodes": [{"id": "N1"}, {"id": "N1"}]}, {"name": "s", "nodes": {"id": "N1"}}]}}, {"name": "B", "methods": {"id": "m2"}}]}})
    rows = sh.flat_rows(spark.createDataFrame([(1, body), (2, body), (1, body)], "rec_id bigint, body string")).collect()
    assert {(r.entity, r.parent_key, r.item_key) for r in rows} == {("method", "A", "m1"), ("method", "B", "m2"), ("scope", "m1", "s"), ("node", "s", "N1")}
    for rec in (1, 2):
        own = {r for r in rows if r.rec_id == rec}
        scopes = {r.item_no for r in own if r.entity == "scope"}
        assert len(own) == len({r.item_no for r in own}) == 7 and len(scopes) == 2
        assert sorted(sum(r.parent_no == s for r in own) for s in scopes) == [1, 2]
        assert {r.parent_no for r in own if r.entity == "scope"} == {r.item_no for r in own if r.item_key == "m1"}
    # the number does not depend on what else is in the batch
    assert {tuple(r)[1:] for r in rows if r.rec_id == 1} == {tuple(r)[1:] for r in rows if r.rec_id == 2}


def test_empty(spark):
    df = spark.createDataFrame([], "rec_id bigint, body string")
    assert sh.flat_rows(df).count() == 0 and sh.levels(df).count() == 0
