"""Term counts, similarity join, packing and leakage against brute force, with nulls, ties, repeats and empty tables."""

import random
from collections import Counter, defaultdict

import pytest

from weftline.llm import leakage, packing, simjoin, termfreq


@pytest.mark.parametrize("max_n,least,block", [(3, 1, 1 << 20), (3, 1, 5), (4, 2, 30), (4, 2, 31), (5, 3, 1 << 20), (None, 2, 50), (None, 3, 1 << 20)])
def test_ngrams_against_counting(spark, monkeypatch, max_n, least, block):
    if block in (30, 50):  # as if the repeated n-grams were too many to be held by every task
        monkeypatch.setattr(termfreq, "fits_broadcast", lambda df: False)
    rnd = random.Random(3)
    docs = {d: [rnd.choice(["a", "a", "a", "b", "é c"]) for _ in range(rnd.randrange(12))] for d in range(25)}
    docs[98] = docs[97] = [str(k) for k in range(40)]
    docs[99] = ["a"] * 60
    rows = [(d, t, "x") for d, t in docs.items()] + [(None, ["b", None, "b"], "x"), (7000, None, "x"), (7001, [], "x"), (7002, [None], "x")]
    df = spark.createDataFrame(rows, "doc bigint, words array<string>, ngram string").repartition(3)
    occ, recs = Counter(), defaultdict(set)
    for d, t, _ in rows:
        t = [w for w in t or [] if w is not None]
        for i in range(len(t)):
            for k in range(i + 1, min(len(t), i + (max_n or len(t))) + 1):
                g = (k - i, " ".join(t[i:k]))
                occ[g] += 1
                recs[g].update({d} - {None})
    got = {(r["n"], r["ngram"]): (r["occurrences"], r["records"]) for r in termfreq.word_ngrams(df, max_n, least, block).collect()}
    assert got == {g: (c, len(recs[g])) for g, c in occ.items() if c >= least}
    assert termfreq.word_ngrams(df.limit(0), max_n, least).count() == 0


@pytest.mark.parametrize("block", [1, 7, 1 << 20])
def test_terms_of_records_in_pieces(spark, block):
    rnd = random.Random(4)
    rows = [(rnd.choice([None, 1, 1, 1, rnd.randrange(9)]), rnd.choice([None, 5, 5, 5, rnd.randrange(9)]), rnd.choice([None, 1, 2]), "x") for _ in range(400)]
    df = spark.createDataFrame(rows, "doc bigint, term bigint, weight bigint, records string").repartition(4)
    want = {}
    for t in {r[1] for r in rows} - {None}:
        own = [r for r in rows if r[1] == t]
        want[t] = (len(own), sum(r[2] or 0 for r in own), len({r[0] for r in own} - {None}))
    got = {r["term"]: (r["occurrences"], r["weight"], r["records"]) for r in termfreq.term_counts(df, block).collect()}
    assert got == want and termfreq.term_counts(df.limit(0)).count() == 0


def test_feature_terms_with_nulls(spark):
    feats = spark.createDataFrame([(1, " a\t", 0), (1, " a\t", 0), (2, "a", 0), (3, "b\n", 0), (4, None, 0), (None, "z", 0), (5, "", 0), (6, "unused", 0)], "fid bigint, feat string, term int")
    rows = [(1, 10, 1, 2), (1, 10, 1, 2), (2, 10, 2, None), (3, 11, 2, 4), (4, 12, 3, 9), (5, 12, None, 5), (6, 12, 77, 5), (7, None, 3, 1), (8, 12, 4, 1), (9, 12, 5, 1), (None, 12, 3, 100)]
    items = spark.createDataFrame([(*r, 0) for r in rows], "sid0 bigint, tid bigint, fid bigint, feat_count bigint, n_items int")
    got = {r["term"]: (r["sum_count"], r["n_items"], r["mark"]) for r in termfreq.feature_terms(items, feats, common_share=0.5).collect()}
    assert got == {"a": (6, 2, "common"), "b": (10, 1, "rare"), "": (1, 1, "rare")}
    assert termfreq.feature_terms(items.limit(0), feats).count() == 0


def brute_pairs(sets, t, least):
    ok = {k: s for k, s in sets.items() if len(s) >= least}
    return {(a, b) for a in ok for b in ok if a < b and len(ok[a] & ok[b]) * 1000 >= t * 1000 * len(ok[a] | ok[b])}


@pytest.mark.parametrize("cap", [1, 3, 1000])
def test_similar_sets(spark, cap):
    rnd = random.Random(11)
    sets = {}
    for k in range(160):
        base = sets[rnd.choice(list(sets))] if sets and rnd.random() < 0.7 else {rnd.randrange(300) for _ in range(rnd.randrange(3, 25))}
        s = set(base)
        for _ in range(rnd.randrange(0, 5)):
            s ^= {rnd.randrange(300)}
        sets[k] = s or {1}
    for k in range(200, 230):
        sets[k] = set(range(1000, 1012))
    rows = [(k, m, "x") for k, s in sets.items() for m in s] * 2 + [(None, 1, "x"), (5, None, "x"), (900, None, "x")]
    df = spark.createDataFrame(rows, "tid bigint, fid bigint, rep string")
    member_of, links = simjoin.similar_sets(df, "tid", "fid", 0.6, 8, bucket_cap=cap)
    want = brute_pairs(sets, 0.6, 8)
    got = [tuple(r) for r in simjoin.all_pairs(member_of, links).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    n = Counter(x for p in want for x in p)
    assert {r["id"]: r["n_links"] for r in simjoin.link_counts(member_of, links).collect()} == {k: n[k] for k, s in sets.items() if len(s) >= 8}
    assert {tuple(sorted(r)) for r in simjoin.prefix_pairs(simjoin.sets_of(df, "tid", "fid").where("size(members) >= 8"), 0.6).collect()} >= want


def test_similar_sets_empty(spark):
    df = spark.createDataFrame([], "tid bigint, fid bigint")
    member_of, links = simjoin.similar_sets(df, "tid", "fid", 0.6)
    assert simjoin.all_pairs(member_of, links).count() == 0


def test_packing(spark):
    rnd = random.Random(2)
    texts = ["", None, "a", "word " * 5000, "é" * 700] + [" ".join("w" for _ in range(rnd.randrange(1, 90))) for _ in range(300)]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id bigint, text string, bin int").repartition(5)
    boxes = spark.createDataFrame([(1, 100, "a"), (1, 100, "b"), (2, 64, "c"), (None, 5, "d"), (3, None, "e"), (4, 0, "f")], "container_id bigint, capacity_tokens bigint, container_name string")
    got = packing.pack(docs, boxes, open_bins=4).collect()
    size = {k: len(packing.encoder(f"{packing.TOKENIZERS}/{packing.VOCABULARY}").encode_ordinary(t)) for k, t in enumerate(texts) if t is not None}
    for container, capacity in ((1, 100), (2, 64)):
        rows = [r for r in got if r["container_id"] == container]
        fill, parts = Counter(), defaultdict(list)
        for r in rows:
            fill[r["bin"]] += r["n_tokens"]
            parts[r["doc_id"]].append((r["piece"], r["first_token"], r["n_tokens"]))
        assert max(fill.values()) <= capacity
        assert {k: [(i, *p) for i, p in enumerate(packing.pieces(n, capacity))] for k, n in size.items()} == {k: sorted(v) for k, v in parts.items()}
        assert sum(size.values()) / (len(fill) * capacity) > 0.9
    assert {r["container_id"] for r in got} == {1, 2}
    assert packing.pack(docs.limit(0), boxes).count() == 0 and packing.pack(docs, boxes.limit(0)).count() == 0


def test_best_fit_rules():
    bins = packing.OpenBins(10, 2)
    assert [bins.put(s) for s in (7, 4, 3, 6, 9, 0)] == [0, 1, 0, 1, 2, 0]
    assert bins.still_open() == {0: 10, 2: 9}
    with pytest.raises(ValueError):
        bins.put(11)


def test_leakage(spark):
    words = [f"w{k}" for k in range(40)]
    item = " ".join(words[:20])
    items = spark.createDataFrame([(1, item, 0), (1, item, 0), (2, " ".join(words[10:30]), 0), (3, " ".join(words[:11]), 0), (4, None, 0), (5, "", 0), (None, item, 0)], "item_id bigint, item_text string, doc_id int")
    part = "\n".join(w.upper() for w in words[3:15])
    docs = [(1, f"é ß {part}!"), (2, " ".join(words[3:14])), (3, "x" + part), (4, part + "x"), (5, None), (6, ""), (7, "--".join(words)), (8, "pre " * 50_000 + part), (9, " ".join(words[3:9] + ["q"] + words[9:15])), (7, "--".join(words))]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, item_id int")
    text7 = "--".join(words)
    for size in (1 << 20, 1):
        got = leakage.leaked(df, items, automaton_bytes=size).collect()
        want = {(1, 1), (7, 1), (7, 2), (8, 1)}
        assert {(r["doc_id"], r["item_id"]) for r in got} == want
        text = dict(docs)[1]
        spans = [text[r["start_char"] : r["end_char"]] for r in got if r["doc_id"] == 1]
        assert spans == [part]
        assert {text7[r["start_char"] : r["end_char"]] for r in got if r["doc_id"] == 7 and r["item_id"] == 2} == {"--".join(words[10:30])}
    assert leakage.leaked(df, items.limit(0)).count() == 0 and leakage.leaked(df.limit(0), items).count() == 0


def test_leakage_against_all_windows():
    rnd = random.Random(8)
    for least in (1, 2, 5, 12):
        items = [(k, " ".join(rnd.choice("abcd") for _ in range(rnd.randrange(30)))) for k in range(20)]
        items += [(20, items[0][1]), (21, "a " * 40)]
        machine = leakage.Items(items, least)
        runs = {k: {tuple(t.split()[i : i + least]) for i in range(len(t.split()) - least + 1)} for k, t in items}
        for _ in range(60):
            own = [rnd.choice("abcdX") for _ in range(rnd.randrange(40))]
            if rnd.random() < 0.5:
                own += rnd.choice(items)[1].split()[rnd.randrange(9) :]
            want = {k for k, r in runs.items() if any(tuple(own[i : i + least]) in r for i in range(len(own) - least + 1))}
            assert set(machine.scan("-".join(own))) == {k for k in want if runs[k]}
