from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.operators import pipeline as G
from foliant.operators import ranking as K
from foliant.operators import retrieval as V
from foliant.operators import rewrite as Q
from foliant.operators import state as S


def test_top_k_keeps_the_best_of_each_query():
    rng = np.random.default_rng(0)
    best, every = K.TopK(3, 5), []
    best.limit = 40
    for _ in range(30):
        q, key, score = rng.integers(0, 3, 20), rng.integers(0, 10_000, 20), np.round(rng.random(20), 1)
        best.add(q, key, score)
        every += list(zip(q, key, score))
    got = sorted(zip(*best.rows()))
    want = sorted(x for q in range(3) for x in sorted((e for e in every if e[0] == q), key=lambda e: (-e[2], e[1]))[:5])
    assert [tuple(map(float, x)) for x in got] == [tuple(map(float, x)) for x in want]
    assert len(K.TopK(2, 3).rows()[0]) == 0


def test_row_numbers_of_a_hot_group(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.7 else rng.choice(["a", None]), rng.randrange(50), i) for i in range(2_000)]
    df = spark.createDataFrame(rows, "g string, v int, k int").repartition(5)
    got = {r["k"]: r["place"] for r in K.row_numbers(df, ["g"], [F.desc("v"), F.col("k")], "place").collect()}
    want = {}
    for g in {r[0] for r in rows}:
        for i, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2])), 1):
            want[r[2]] = i
    assert got == want and K.row_numbers(df.limit(0), ["g"], [F.col("k")], "place").count() == 0


@pytest.mark.parametrize("interpolated", [False, True])
def test_quantiles(spark, interpolated):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), 7.0 if rng.random() < 0.4 else round(rng.random() * 20, 2)) for _ in range(900)] + [("one", 3.0), ("none", None)]
    got = {r["g"]: (r["p50"], r["p95"]) for r in K.quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", {"p50": 0.5, "p95": 0.95}, interpolated).collect()}
    want = {}
    for g in {r[0] for r in rows} - {"none"}:
        v = sorted(x for h, x in rows if h == g)
        want[g] = tuple(float(np.quantile(v, p)) if interpolated else v[max(math.ceil(p * len(v)), 1) - 1] for p in (0.5, 0.95))
    assert set(got) == set(want) and all(got[g] == pytest.approx(want[g]) for g in want)


def brute_bm25(texts, query, weights):
    words = {k: t.lower().split() for k, t in texts.items() if t}
    average = sum(map(len, words.values())) / len(words)
    out = {}
    for k, w in words.items():
        both = w + [f"{a} {b}" for a, b in zip(w, w[1:])]
        score = 0.0
        for term in query:
            df = sum(term in v + [f"{a} {b}" for a, b in zip(v, v[1:])] for v in words.values())
            tf = both.count(term)
            if tf:
                score += weights.get(term, 1.0) * math.log(1 + (len(words) - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * len(w) / average))
        if score:
            out[k] = round(score, 6)
    return sorted(out.items(), key=lambda x: (-x[1], x[0]))


def test_lexical_top_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    texts = {f"t{i:03}": " ".join(rng.choice(["red", "green", "blue", "plan", "audit"]) for _ in range(rng.randint(1, 12))) for i in range(120)} | {"null": None, "empty": ""}
    corpus = spark.createDataFrame(list(texts.items()), "key string, text string").repartition(4)
    asked = {"q1": ["red plan", "audit"], "q2": ["blue"], "q3": ["nowhere"]}
    queries = spark.createDataFrame([(q, t, 2.0 if t == "audit" else 1.0) for q, ts in asked.items() for t in ts], "query string, term string, weight double")
    monkeypatch.setattr(V, "MATCHES_AT_ONCE", 50)
    for terms in (500_000, 1):  # one block of queries, or one for each term
        monkeypatch.setattr(V, "BLOCK_TERMS", terms)
        got = V.lexical_top(corpus, "key", "text", queries, 7, phrases=True).collect()
        for q, ts in asked.items():
            found = [(r["key"], r["score"]) for r in sorted((r for r in got if r["query"] == q), key=lambda r: r["place"])]
            assert found == brute_bm25(texts, ts, {"audit": 2.0})[:7]
    assert V.lexical_top(corpus.limit(0), "key", "text", queries, 7).count() == 0 and V.lexical_top(corpus, "key", "text", queries.limit(0), 7).count() == 0


def test_rewritten_questions(spark):
    asked = spark.createDataFrame([("w", "What is the maximum pressure of the main pump?"), ("c", "检查报告ABC系统是什么"), ("n", None), ("b", "  ")], "key string, question string")
    synonyms = spark.createDataFrame([("pressure", f"s{i}", i) for i in range(12)], "term string, synonym string, place int")
    rows = Q.rewritten(asked, "key", "question", synonyms).collect()
    words = {r["text"]: r["weight"] for r in rows if r["key"] == "w" and r["kind"] == "term"}
    assert list(words) and abs(sum(words.values()) - 1) < 1e-9 and "what" not in words and {"maximum", "pressure", "pump"} <= set(words)
    said = [r for r in rows if r["kind"] == "synonym"]
    assert {r["text"] for r in said} == {f"s{i}" for i in range(8)} and all(abs(r["weight"] - words["pressure"] / 4) < 1e-12 for r in said)
    phrase = next(r for r in rows if r["kind"] == "phrase" and r["text"] == "maximum pressure")
    assert abs(phrase["weight"] - 2 * max(words["maximum"], words["pressure"])) < 1e-12
    assert {r["text"] for r in rows if r["key"] == "c" and r["kind"] == "term"} == {"检查报告", "abc", "系统"}
    assert {r["text"] for r in rows if r["kind"] == "near"} == {"检查 查报 报告"} and {r["key"] for r in rows} == {"w", "c"}
    assert Q.rewritten(asked.limit(0), "key", "question").count() == 0


def test_retrieval_checks_its_window(spark):
    assert G.candidate_window(None, 10, 64) == (1, 0) and G.candidate_window(3, 20, 60) == (3, 40)
    for page, size, window in ((4, 20, 60), (1, 0, 10), (1, 65, 64)):
        with pytest.raises(ValueError):
            G.candidate_window(page, size, window)
    chunks = spark.createDataFrame([(1, "d", "alpha beta", [1.0, 0.0]), (2, "d", "alpha", None), (3, "e", "gamma", [0.0, 1.0])], "key bigint, document string, content string, v array<double>")
    asked = spark.createDataFrame([(7, "alpha beta", [1.0, 0.0]), (8, "...", [0.0, 1.0]), (9, "gamma " + "unknown " * 9, None)], "query bigint, question string, v array<double>")
    hits = lambda mode: {(r["query"], r["key"]) for r in G.retrieve(asked, chunks, mode=mode, threshold=0.0).collect()}
    assert hits("bm25") == {(7, 1), (7, 2), (9, 3)}  # no words, no lane
    assert hits("dense") == {(7, 1), (7, 3), (8, 1), (8, 3)} and hits("hybrid") == {(7, 1), (7, 2), (9, 3)}
    with pytest.raises(ValueError):
        G.retrieve(asked, chunks, mode="other")


def test_catalogue_state(spark):
    rows = spark.createDataFrame([("a", 5, None), ("b", None, 2)], "id string, n int, m int")
    deltas = spark.createDataFrame([("a", -9, 1), ("a", 1, 1), ("c", 4, 4)], "id string, x int, y int")
    assert {tuple(r) for r in S.counted(rows, "id", deltas, {"n": "x", "m": "y"}).collect()} == {("a", 0, 2), ("b", 0, 2)}
    meta = spark.createDataFrame([("a", "old"), ("b", "old")], "id string, meta string")
    assert {tuple(r) for r in S.with_replaced(meta, "id", "meta", spark.createDataFrame([("a", None)], "id string, meta string")).collect()} == {("a", None), ("b", "old")}
    at = spark.createDataFrame([("2024-01-01 14:59:00", "2024-01-01 15:01:00"), (None, "2024-01-01 15:01:00"), ("2024-01-01 15:00:00", "2024-01-02 14:59:00")], "l string, n string")
    assert [r[0] for r in at.select(S.due(F.col("l").cast("timestamp_ntz"), F.col("n").cast("timestamp_ntz"), "Asia/Seoul")).collect()] == [True, True, False]
