from __future__ import annotations

import random
import re

import pytest

from foliant.llm import neardup as D
from foliant.llm.shingles import shingle_sets


def words(text):
    return re.findall(r"[^\W_]+", text.lower())


def grams(text, k):
    w = words(text or "")
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(rows, k, t, least):
    texts = {key: text for key, text in rows if text is not None and len(words(text)) >= least}
    keys = sorted(texts)
    sets = {key: grams(texts[key], k) for key in keys}
    out = set()
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            union = len(sets[a] | sets[b])
            if union and len(sets[a] & sets[b]) >= t * union - 1e-9:
                out.add((a, b))
    return out


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 45, 60, 150, 600]))]
        rows.append((f"a{i}", " ".join(base)))
        for j in range(rng.randint(0, 4)):
            edited = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 15))):
                p = rng.randrange(len(edited))
                edited[p : p + rng.randint(0, 1)] = [rng.choice(vocabulary)] * rng.randint(0, 2)
                edited = edited or ["x"]
            rows.append((f"b{i}-{j}", rng.choice([" ", "  ", ". "]).join(edited).upper()))
    rows += [("n1", None), ("e1", ""), ("e2", "  "), rows[0], rows[5], ("copy1", rows[1][1]), ("copy2", rows[1][1]), ("zé", "Ünï " * 50), ("zé2", "ünï " * 60)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("k, t, least", [(3, 0.7, 40), (5, 0.8, 5)])
def test_pairs_against_brute_force(spark, k, t, least, monkeypatch):
    rows = corpus(k)
    df = spark.createDataFrame([(*r, "x") for r in rows], "id string, text string, sig string")
    got = [(r["a"], r["b"]) for r in D.similar_pairs(df, "id", "text", k, t, least).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, k, t, least)


def test_large_blocks_are_tiled_and_striped(spark, monkeypatch):
    """Many near copies of one text: every block is far over a tile, and is dealt into stripes."""
    monkeypatch.setattr(D, "BLOCK_ROWS", 64)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(2):
            w[rng.randrange(len(w))] = f"e{rng.randrange(50)}"
        rows.append((f"k{i:03}", " ".join(w)))
    df = spark.createDataFrame(rows, "id string, text string")
    assert {(r["a"], r["b"]) for r in D.similar_pairs(df, "id", "text", 3, 0.9, 5).collect()} == brute(rows, 3, 0.9, 5)


def test_groups(spark):
    rows = corpus(9)
    df = spark.createDataFrame(rows, "id string, text string")
    out = {r["id"]: r for r in D.groups(df, "id", "text", 3, 0.7, 40).collect()}
    assert set(out) == {k for k, _ in rows}
    for a, b in brute(rows, 3, 0.7, 40):
        assert out[a]["group_id"] == out[b]["group_id"]
    assert D.groups(df.limit(0), "id", "text").count() == 0 and D.similar_pairs(df.limit(0), "id", "text").count() == 0


def test_shingles():
    texts = ["a b c a b c", "", "x", "ÄB-c_d 1２3 é"]
    tokens, offsets, n = shingle_sets(texts, 2)
    assert [int(b - a) for a, b in zip(offsets, offsets[1:])] == [len(grams(t, 2)) for t in texts] and list(n) == [len(words(t)) for t in texts]


def test_sparse_counters():
    import numpy as np

    rng = np.random.default_rng(0)
    counts = np.zeros(300_000, np.uint8)
    counts[rng.integers(0, 300_000, 500)] = 7
    counts[[0, 299_999]] = 255
    assert (D._dense(D._sparse(counts), len(counts)) == counts).all() and D._sparse(np.zeros(9, np.uint8)) == b""


def test_counters_hold_more_than_a_byte(spark):
    """One shingle in 6,000 texts of two tasks counts 6,000 times, and its block is dealt into stripes."""
    df = spark.createDataFrame([(f"one two three u{i} v{i} w{i}",) for i in range(6_000)], "text string").repartition(2)
    sketch = D._sketch(df, 3, 3, 20)
    token = int(shingle_sets(["one two three"], 3)[0][0])
    assert abs(2 ** (sketch.dense()[token & ((1 << 20) - 1)] / 8) / 6_000 - 1) < 0.1


def test_a_hot_block_becomes_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_ROWS", 1_000)
    df = spark.createDataFrame([(i, f"one two three u{i % 50}") for i in range(6_000)], "sig long, text string")
    posted = D._post(df.select("text", "sig"), D._sketch(df.select("text"), 3, 3, 20), 3, 0.3, 3).toPandas()
    token = int(shingle_sets(["one two three"], 3)[0][0])
    hot = posted[(posted["block"] & ((1 << 48) - 1)) == token]
    assert hot["block"].nunique() >= 21 and hot.groupby("block").size().max() <= 2.5 * D.BLOCK_ROWS


def test_texts_of_one_hash_are_told_apart(spark, monkeypatch):
    real = D._hash
    monkeypatch.setattr(D, "_hash", lambda text, salt: real(text, salt) % 7 if salt == 0 else real(text, salt))
    rows = corpus(4)
    df = spark.createDataFrame(rows, "id string, text string")
    assert {(r["a"], r["b"]) for r in D.similar_pairs(df, "id", "text", 3, 0.7, 40).collect()} == brute(rows, 3, 0.7, 40)
