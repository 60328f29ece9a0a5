"""Probability form of the Bayes scores over all features, with and without fallback."""

import math

from weftline.operators import bayes

KEYS = {"banana": 50, "orange": 30, "other": 20}
FEATS = {"long": {"banana": 40, "other": 10}, "sweet": {"banana": 35, "orange": 15, "other": 15}, "yellow": {"banana": 45, "orange": 30, "other": 5}}


def test_all_features_count(spark):
    keys = spark.createDataFrame(list(KEYS.items()), "key string, k bigint")
    many = FEATS | {f"m{k}": {"banana": 1} for k in range(300)}
    feats = spark.createDataFrame([(f, k, c) for f, per in many.items() for k, c in per.items()], "feat string, key string, c bigint")
    asked = {1: ["long", "sweet", "yellow", "unknown"], 2: ["sweet"], 3: ["unknown"], 4: [f"m{k}" for k in range(300)]}
    queries = spark.createDataFrame([(q, f) for q, fs in asked.items() for f in [*fs, fs[0]]], "qid bigint, feat string")
    for fallback in (False, True):
        want = {}
        for q, fs in asked.items():
            known = [f for f in fs if f in many]
            for k, n in KEYS.items():
                if known and (fallback or all(k in many[f] for f in known)):
                    want[q, k] = math.log(n / 100) + sum(math.log(many[f].get(k, 1) / n) for f in known)
        got = {(r["qid"], r["key"]): r["lp"] for r in bayes.log_probabilities(keys, feats, queries, fallback).collect()}
        assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-5 for x in want)
        assert (1, "orange") in got if fallback else (1, "orange") not in got
        assert got[4, "banana"] < -1000
