from __future__ import annotations

import random

import numpy as np

from foliant.llm import abuse as A

BENIGN = ["The pump was checked by the night team before the audit of plan {}.", "Please forward the report {} to the office by tomorrow morning.", "The penetration test of valve {} found no weakness at all.", "We welcome immigrants and women who apply for post {} here.", "Kill the hanging process on server {} and start it again."]
BAD = ["You are a useless {} and everybody in the office knows it well.", "Shut your mouth about the plan, you filthy {} from the depot.", "Immigrants are vermin and {} must be driven out of the yard."]


def corpus(n, seed):
    rng = random.Random(seed)
    texts, labels = [], []
    for _ in range(n):
        bad = rng.random() < 0.2
        parts = [rng.choice(BENIGN).format(rng.randint(1, 99)) for _ in range(rng.randint(1, 6))]
        if bad:
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(BAD).format(rng.choice(["idiot", "moron", "they", "lowlife"])))
        texts.append(" ".join(parts))
        labels.append(float(bad))
    return texts, np.array(labels)


def test_held_out_accuracy_with_wrong_labels():
    texts, labels = corpus(500, 1)
    noisy = labels.copy()
    noisy[np.random.default_rng(0).random(500) < 0.04] = 1 - noisy[np.random.default_rng(0).random(500) < 0.04]
    weights, bias = A.fit(texts, noisy)
    held, truth = corpus(300, 2)
    found = A.text_scores(held, weights, bias) >= A.THRESHOLD
    assert (found == (truth > 0)).mean() > 0.97


def test_counterfactual_swaps():
    a, b = A.counterfactuals(["Immigrants are welcome. The pump.", "여자들 모두 환영"])
    assert len(a) == len(b) == 4 and all(x != y for x, y in zip(a, b)) and "immigrants" in a[0] and "immigrants" not in b[0]


def test_disguises_share_features():
    plain = A.featurise(["you idiot"])
    for other in ["you i.d.i.o.t", "you idi​ot", "you id1ot", "you i d i o t", "you iiiiidiot", "YOU IDIOT!!"]:
        assert set(A.featurise([other]).features) == set(plain.features), other


def test_scores(spark):
    texts, labels = corpus(400, 3)
    docs = [(i, t, "Chat " if i % 2 else "e-mail", 0.5) for i, t in enumerate(texts)] + [(9000, None, None, 0.5), (9001, "", "chat", 0.5), (9002, " ", "chat", 0.5), (9003, "x" * 100_000, "chat", 0.5)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string, score double")
    marks = spark.createDataFrame([(i, "r1", "none" if not y else "abusive") for i, y in enumerate(labels)] + [(0, "r1", None), (77777, "r1", "none")], "doc_id bigint, rater string, verdict string")
    got = {r["doc_id"]: r["score"] for r in A.score(df, marks).collect()}
    assert len(got) == len(docs) and got[9000] == got[9001] == got[9002] == 0.0
    assert np.mean([(got[i] >= 0.5) == bool(y) for i, y in enumerate(labels)]) > 0.97
    rates = {r["source"]: r for r in A.rates(df, marks).collect()}
    assert set(rates) == {"chat", "e_mail", None} and sum(r["docs"] for r in rates.values()) == len(docs)
    assert A.found(df, marks.limit(0)).count() == 0 and A.score(df.limit(0), marks).count() == 0


def test_few_labels():
    texts, labels = corpus(40, 5)
    weights, bias = A.fit(texts, labels)
    found = A.text_scores(texts, weights, bias) >= A.THRESHOLD
    assert found[labels > 0].mean() > 0.5 and found[labels == 0].mean() < 0.1


def neutral_corpus(n, seed):
    """Abuse names one group most of the time, so that its name alone looks like evidence."""
    rng = random.Random(seed)
    texts, labels = [], []
    for _ in range(n):
        bad = rng.random() < 0.3
        group = rng.choice(["immigrants", "immigrants", "immigrants", "women"]) if bad else rng.choice(["women", "old people", "christians", "refugees", "southerners"])
        parts = [rng.choice(BENIGN[:3]).format(rng.randint(1, 99)) for _ in range(3)]
        what = rng.choice(["are vermin and must be driven out of the yard", "ruin everything and deserve a beating for it", "should be kicked out of the depot at once"]) if bad else rng.choice(["are welcome to the meeting on the new rota", "asked for the shift plan of the next week", "took part in the training of the night team"])
        parts.insert(rng.randrange(4), f"{group} {what}.")
        texts.append(" ".join(parts))
        labels.append(float(bad))
    return texts, np.array(labels)


NEUTRAL = [f"{g} {w}." for g in ("immigrants", "women", "refugees", "old people") for w in ("are welcome to the meeting on the new rota", "asked for the shift plan", "took part in the training of the night team", "opened the canteen of the depot", "were counted in the census of the town")]


def bias_figures(fair):
    """(mean squared change of a sentence's score under a swapped name, share of neutral mentions found)."""
    weights, bias = A.fit(*neutral_corpus(600, 1), fair=fair)
    a, b = A.counterfactuals(NEUTRAL)
    gap = A.sentence_scores(A._one_each(a), weights, bias) - A.sentence_scores(A._one_each(b), weights, bias)
    return float((gap**2).mean()), float((A.text_scores(NEUTRAL, weights, bias) >= A.THRESHOLD).mean())


def test_the_penalty_lowers_swap_gap_and_false_positives():
    (gap, wrong), (fair_gap, fair_wrong) = bias_figures(0.0), bias_figures(0.05)
    assert fair_gap < 0.5 * gap and fair_wrong <= wrong
    held, truth = neutral_corpus(300, 2)
    weights, bias = A.fit(*neutral_corpus(600, 1))
    assert ((A.text_scores(held, weights, bias) >= A.THRESHOLD) == (truth > 0)).mean() > 0.95


def test_too_few_positive_labels_abstain():
    texts, labels = corpus(60, 5)
    keep = (labels == 0) | (np.cumsum(labels) < A.LEAST_POSITIVE)
    kept = [t for t, k in zip(texts, keep) if k]
    assert not A.text_scores(texts, *A.fit(kept, labels[keep])).max() > 1e-6


def test_fitting_texts_are_bounded_by_characters(spark, monkeypatch):
    df = spark.createDataFrame([(i, "x" * 100) for i in range(50)], "doc_id bigint, text string")
    marks = spark.createDataFrame([(i, "r", "none") for i in range(50)], "doc_id bigint, rater string, verdict string")
    assert len(A.labelled(df, marks)[0]) == 50
    monkeypatch.setattr(A, "MOST_CHARACTERS", 1_050)
    assert len(A.labelled(df, marks)[0]) == 10
