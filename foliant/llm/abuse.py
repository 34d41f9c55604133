"""Scores for abusive, hateful or sexual content, with a counterfactual regulariser.

A text falls into sentences, a sentence into words, runs of two and of three words, all hashed; before that common
disguises are undone (zero-width characters, symbols and dots inside words, digits for letters, s p a c e d letters,
drawn-out letters). A linear model scores each sentence, and a text has the score of its worst sentence. It is fitted on
raters' labels of whole texts: a sentence of a labelled text counts by the text's label, in texts found positive
then only the sentences that carry the verdict, and texts whose label is contradicted by models fitted on other texts
are left out of the last fit, as raters err. In labelled sentences that name a group of people, the name is swapped for that of
another group, and the squared change of the score is penalised: what is said must decide, not about whom.

Cases: a null, empty or blank text has score 0. Labels of null verdict count for nothing; a text with as many verdicts for
as against is not used. Without labels of both kinds, or with fewer than LEAST_POSITIVE positive ones, every score is 0. Repeated label rows count once for each rater.
Repeated documents each have their row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.shingles import mix, word_table, words_of_points
from foliant.operators.text import canonical_label

#: Labelled texts used for fitting at most, those of the smallest hash; scoring covers every row.
MOST_LABELLED = 20_000
#: Characters of these texts at most (those of the smallest hash again); texts beyond are left out whole, from fitting only.
MOST_CHARACTERS = 100_000_000
#: Texts with a positive label below which nothing is fitted: every score is 0 then.
LEAST_POSITIVE = 5
FEATURE_BITS = 20
#: Words of a sentence above which it is cut for scoring.
LONG_SENTENCE = 40
AT_ONCE = 1_000
THRESHOLD = 0.5
#: Digits and signs written for letters.
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "€": "e"}
#: Signs put inside words to hide them.
HIDERS = ".*!·_'’#~^"
INVISIBLE = "​‌‍⁠­﻿"
#: Names of groups of people that the counterfactuals swap, by language.
IDENTITIES = {
    "en": ["immigrants", "foreigners", "refugees", "southerners", "women", "gay people", "disabled staff", "old people", "muslims", "jews", "christians", "black people", "the temp workers from abroad", "people of that faith"],
    "de": ["ausländer", "flüchtlinge", "frauen", "alte", "behinderte", "schwule", "zuwanderer", "muslime", "juden"],
    "fr": ["les étrangers", "les réfugiés", "les femmes", "les vieux", "les handicapés", "les homosexuels", "les immigrés", "les musulmans", "les juifs"],
    "es": ["los extranjeros", "los refugiados", "las mujeres", "los viejos", "los inmigrantes", "los gitanos", "los homosexuales", "los discapacitados", "los musulmanes"],
    "ko": ["외국인", "이주민", "난민", "여자들", "노인들", "장애인", "동성애자", "이슬람교도"],
    "ja": ["外国人", "難民", "女性", "老人", "移民", "障害者"],
}


def _code(chars: str) -> np.ndarray:
    return np.array([ord(c) for c in chars], np.uint32)


_STAND_FROM, _STAND_TO = _code("".join(STAND_INS)), _code("".join(STAND_INS.values()))
_LEET = np.zeros(0x110000, np.uint32)
_LEET[_STAND_FROM] = _STAND_TO
_HIDER = np.zeros(0x110000, bool)
_HIDER[_code(HIDERS)] = True
_GONE = np.zeros(0x110000, bool)
_GONE[_code(INVISIBLE)] = True
_DIGITS = np.zeros(0x110000, bool)
_DIGITS[48:58] = True
_STOP = np.zeros(0x110000, bool)
_STOP[_code(".!?。！？")] = True
_TEXT_END = np.uint32(1)


def _undisguise(points: np.ndarray) -> np.ndarray:
    """Code points of lower-cased texts with the common disguises undone."""
    points = points[~_GONE[points]]
    letter = word_table()[points] & ~_DIGITS[points]

    def beside(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([[False], flags[:-1]]), np.concatenate([flags[1:], [False]])

    # signs inside words, up to three on end
    hider = _HIDER[points]
    edges = np.diff(hider.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    inside = (start > 0) & (end < len(points))
    start, end = start[inside], end[inside]
    inside = letter[start - 1] & letter[end]
    drop = np.zeros(len(points) + 1, np.int32)
    np.add.at(drop, start[inside], 1)
    np.add.at(drop, end[inside], -1)
    points = points[np.cumsum(drop[:-1]) == 0]
    # digits and signs for letters: with a letter on one side and no digit on the other
    letter = word_table()[points] & ~_DIGITS[points]
    before, after = beside(letter)
    digit_before, digit_after = beside(_DIGITS[points])
    swap = (_LEET[points] > 0) & ((before & ~digit_after) | (after & ~digit_before)) & (before | ~_DIGITS[points])
    points = np.where(swap, _LEET[points], points)
    # drawn-out letters: three and more become one
    letter = word_table()[points] & ~_DIGITS[points]
    new = np.concatenate([[True], points[1:] != points[:-1]])
    length = np.diff(np.append(np.flatnonzero(new), len(points)))
    long = np.repeat(length >= 3, length) & letter & ~new
    points, letter = points[~long], letter[~long]
    # letters that stand alone, three and more on end with one blank between
    before, after = beside(word_table()[points])
    alone = letter & ~before & ~after
    blank = points == 32
    gap = blank & beside(alone)[0] & beside(alone)[1]
    linked = np.zeros(len(points), bool)
    at = np.flatnonzero(gap)
    run = (np.isin(at + 2, at) | np.isin(at - 2, at)) if len(at) else np.empty(0, bool)
    linked[at[run]] = True
    return points[~linked]


def _number(h: np.ndarray, mask: np.uint64) -> np.ndarray:
    return np.maximum((h & mask).astype(np.int64), 1)


@dataclass
class Sentences:
    """Hashed features of sentences; features[offsets[i]:offsets[i + 1]] are those of sentence i, of text owner[i];
    numbers start at 1, 0 stands for rare features."""

    features: np.ndarray
    offsets: np.ndarray
    owner: np.ndarray


def featurise(texts: list[str]) -> Sentences:
    joined = "\x01".join(t.lower().replace("\x01", " ") for t in texts)
    points = _undisguise(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32))
    empty = Sentences(np.empty(0, np.int64), np.zeros(1, np.int64), np.empty(0, np.int64))
    if not len(points):
        return empty
    # a number is one word, whatever its digits
    points = np.where(_DIGITS[points], np.uint32(48), points)
    ends = (points == 10) | (points == 13) | (points == _TEXT_END)
    ends[:-1] |= _STOP[points[:-1]] & ((points[1:] == 32) | (points[1:] == 10) | (points[1:] == 13) | (points[:-1] > 255))
    hashes, start = words_of_points(points)
    if not len(hashes):
        return empty
    sentence = np.cumsum(ends)[start]
    text = np.cumsum(points == _TEXT_END)[start]
    fresh = np.concatenate([[True], sentence[1:] != sentence[:-1]])
    first = np.flatnonzero(fresh)
    length = np.diff(np.append(first, len(sentence)))
    within = np.arange(len(sentence)) - np.repeat(first, length)
    fresh |= within % LONG_SENTENCE == 0
    number = np.cumsum(fresh) - 1
    first = np.flatnonzero(fresh)
    kinds = [mix(hashes)]
    for n in (2, 3):
        h = hashes[: len(hashes) - n + 1].copy() if len(hashes) >= n else np.empty(0, np.uint64)
        for j in range(1, n):
            h = (h * np.uint64(0xD6E8FEB86659FD93)) ^ hashes[j : len(hashes) - n + 1 + j]
        kinds.append(mix(h + np.uint64(n)))
    mask = np.uint64((1 << FEATURE_BITS) - 1)
    all_f, all_s = [_number(kinds[0], mask)], [number]
    for n, h in zip((2, 3), kinds[1:], strict=True):
        if len(h):
            ok = number[: len(h)] == number[n - 1 :]
            all_f.append(_number(h[ok], mask))
            all_s.append(number[: len(h)][ok])
    f, s = np.concatenate(all_f), np.concatenate(all_s)
    order = np.argsort(s, kind="stable")
    return Sentences(f[order], np.concatenate([[0], np.cumsum(np.bincount(s, minlength=len(first)))]), text[first])


def sentence_scores(x: Sentences, weights: np.ndarray, bias: float) -> np.ndarray:
    if not len(x.owner):
        return np.empty(0, np.float64)
    return np.add.reduceat(weights[x.features].astype(np.float64), x.offsets[:-1]) + bias


def text_scores(texts: list[str], weights: np.ndarray, bias: float) -> np.ndarray:
    """Probability of each text: that of its worst sentence; 0 where there is no word."""
    x = featurise(texts)
    worst = np.full(len(texts), -np.inf)
    np.maximum.at(worst, x.owner, sentence_scores(x, weights, bias))
    return 1 / (1 + np.exp(-np.clip(worst, -700, 700))) * np.isfinite(worst)


def counterfactuals(texts: list[str]) -> tuple[list[str], list[str]]:
    """(sentences that name a group, the same with another group of the language), each sentence with two swaps."""
    import re

    seen, out = set(), ([], [])
    for names in IDENTITIES.values():
        pattern = re.compile("|".join(re.escape(n) for n in sorted(names, key=len, reverse=True)))
        for t in texts:
            for m in re.finditer(r"[^\r\n.!?。！？]+", t.lower()):
                sentence = m.group()
                hit = pattern.search(sentence)
                if hit is None or sentence in seen:
                    continue
                seen.add(sentence)
                at = names.index(hit.group())
                for step in (1, len(names) // 2):
                    out[0].append(sentence)
                    out[1].append(sentence[: hit.start()] + names[(at + step) % len(names)] + sentence[hit.end() :])
    return out


def _fit(x: Sentences, target: np.ndarray, importance: np.ndarray, pairs: tuple[Sentences, Sentences] | None, fair: float, ridge: float, rounds: int) -> tuple[np.ndarray, float]:
    """Logistic regression by AdaGrad over all rows, with the mean squared score change of the pairs as a penalty."""
    size = 1 << FEATURE_BITS
    used = np.unique(np.concatenate([x.features, *([pairs[0].features, pairs[1].features] if pairs else [])]))
    local = np.zeros(size, np.int32)
    local[used] = np.arange(len(used))
    rows = [(local[s.features], s.offsets) for s in (x, *(pairs or ()))]
    lengths = [np.diff(o) for _, o in rows]
    w, bias = np.zeros(len(used)), -1.0
    second, second_bias = np.full(len(used), 1e-8), 1e-8
    total = importance.sum()
    for _ in range(rounds):
        f, o = rows[0]
        z = np.add.reduceat(w[f], o[:-1]) + bias
        error = importance * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - target) / total
        grad = np.bincount(f, weights=np.repeat(error, lengths[0]), minlength=len(used)) + ridge * w
        if pairs:
            change = np.add.reduceat(w[rows[1][0]], rows[1][1][:-1]) - np.add.reduceat(w[rows[2][0]], rows[2][1][:-1])
            pull = 2 * fair * change / len(change)
            grad += np.bincount(rows[1][0], weights=np.repeat(pull, lengths[1]), minlength=len(used))
            grad -= np.bincount(rows[2][0], weights=np.repeat(pull, lengths[2]), minlength=len(used))
        second += grad * grad
        w -= 0.3 * grad / np.sqrt(second)
        g = error.sum()
        second_bias += g * g
        bias -= 0.3 * g / np.sqrt(second_bias)
    weights = np.zeros(size, np.float32)
    weights[used] = w
    return weights, float(bias)


def _part(x: Sentences, rows: np.ndarray) -> Sentences:
    """The sentences whose flag is set."""
    lengths = np.diff(x.offsets)
    return Sentences(x.features[np.repeat(rows, lengths)], np.concatenate([[0], np.cumsum(lengths[rows])]), x.owner[rows])


def _frequent(x: Sentences, texts: int, least: int) -> Sentences:
    """Features of fewer than ``least`` texts become one common feature (number 0): what is seen once tells nothing."""
    of = np.repeat(x.owner, np.diff(x.offsets))
    pairs = np.unique(x.features * np.int64(texts) + of)
    spread = np.bincount(pairs // texts, minlength=1 << FEATURE_BITS)
    return Sentences(np.where(spread[x.features] >= least, x.features, 0), x.offsets, x.owner)


def _novelty(x: Sentences, labels: np.ndarray) -> np.ndarray:
    """Share of each sentence's features that no other text labelled 0 has; 0 for sentences of fewer than six features."""
    n, lengths = len(labels), np.diff(x.offsets)
    of = np.repeat(x.owner, lengths)
    pairs = np.unique(x.features * np.int64(n) + of)
    spread = np.bincount(pairs[labels[pairs % n] == 0] // n, minlength=1 << FEATURE_BITS)
    new = spread[x.features] - (labels[of] == 0) <= 0
    return np.where(lengths >= 6, np.add.reduceat(new.astype(np.float64), x.offsets[:-1]) / np.maximum(lengths, 1), 0.0)


def _worst(z: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    out = np.full(texts, -np.inf)
    np.maximum.at(out, owner, z)
    return out


def fit(texts: list[str], labels: np.ndarray, fair: float = 0.05, ridge: float = 1e-5, rounds: int = 60, folds: int = 3, least: int = 2) -> tuple[np.ndarray, float]:
    """(weights, bias) from texts with labels 0 or 1.

    Which sentences carry a verdict, and which verdicts are mistaken, is told by models that were fitted on the other
    folds, so that no sentence speaks for itself, and by whether a sentence says what texts labelled 0 never say.
    """
    labels = np.asarray(labels, np.float64)
    none = np.zeros(1 << FEATURE_BITS, np.float32), -50.0
    if labels.sum() < LEAST_POSITIVE or labels.min() == labels.max():
        return none
    x = featurise(texts)
    if not len(x.owner):
        return none
    n = len(texts)
    novelty = _novelty(x, labels)
    most_new = _worst(novelty, x.owner, n)
    new = np.quantile(most_new[(labels == 0) & np.isfinite(most_new)], 0.95) + 0.1
    x = _frequent(x, n, min(least, max(1, n // 50)))
    a, b = counterfactuals(texts)
    pairs = (_one_each(a), _one_each(b)) if a else None
    fold = np.arange(n) % folds
    label, per_text = labels[x.owner], np.bincount(x.owner, minlength=n)[x.owner]
    use = (label == 0) | (novelty >= new) | ((most_new < new)[x.owner] & (label > 0))
    weight = np.where((label > 0) & (novelty < new), 1.0 / per_text, 1.0)

    def model(rows: np.ndarray) -> tuple[np.ndarray, float] | None:
        rows = rows & (weight > 0)
        if not (label[rows] > 0).any() or not (label[rows] == 0).any():
            return None
        return _fit(_part(x, rows), label[rows], weight[rows], pairs, fair, ridge, rounds)

    for _ in range(2):
        z = np.full(len(label), np.nan)
        for k in range(folds):
            held = fold[x.owner] == k
            fitted = model(use & ~held)
            if fitted is not None and held.any():
                z[held] = sentence_scores(_part(x, held), *fitted)
        if np.isnan(z).any():
            break
        # scores are compared within the classes of the raters: the first pass is not calibrated
        worst = _worst(z, x.owner, n)
        clean = np.quantile(worst[(labels == 0) & np.isfinite(worst)], 0.9)
        trusted = np.where(labels > 0, (worst > clean) | (most_new >= new), worst < max(clean, np.median(worst[labels > 0])))
        carries = (z >= worst[x.owner] - 1e-9) | (z > np.median(worst[labels > 0])) | (novelty >= new)
        use = trusted[x.owner] & ((label == 0) | carries)
        weight = np.where(use, 1.0, 0.0)
    fitted = model(use)
    if fitted is None:  # too few labels to tell which are mistaken: trust them all
        weight = np.where(label > 0, 1.0 / per_text, 1.0)
        fitted = model(np.ones(len(label), bool))
        if fitted is not None:  # and find nothing that is no worse than a text labelled 0
            weights, bias = fitted
            worst = _worst(sentence_scores(x, weights, bias), x.owner, n)
            return weights, bias - max(0.0, float(worst[(labels == 0) & np.isfinite(worst)].max()) + 1.0)
    return fitted or none


def _one_each(sentences: list[str]) -> Sentences:
    """Features with exactly one row for each sentence."""
    x = featurise(sentences)
    whole = np.bincount(x.owner, weights=np.diff(x.offsets), minlength=len(sentences)).astype(np.int64)
    return Sentences(x.features, np.concatenate([[0], np.cumsum(whole)]), np.arange(len(sentences)))


def labelled(documents: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> tuple[list[str], np.ndarray]:
    """Texts with their majority label, at most ``most`` of them and of MOST_CHARACTERS together."""
    votes = labels.where("verdict is not null").select("doc_id", "rater", F.lower(F.trim("verdict")).alias("verdict")).distinct()
    verdicts = votes.groupBy("doc_id").agg(F.avg((F.col("verdict") != "none").cast("double")).alias("share")).where("share <> 0.5")
    chosen = verdicts.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = documents.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")
    room = texts.select("doc_id", F.length("text").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()  # at most as many rows as chosen
    if sum(r["n"] for r in room) > MOST_CHARACTERS:
        within = np.cumsum([r["n"] for r in room]) <= MOST_CHARACTERS
        fitting = documents.sparkSession.createDataFrame([(r["doc_id"],) for r, ok in zip(room, within, strict=True) if ok], texts.select("doc_id").schema)
        texts = texts.join(F.broadcast(fitting), "doc_id", "left_semi")
    rows = texts.orderBy("doc_id").collect()
    return [r["text"] for r in rows], np.array([r["share"] > 0.5 for r in rows], np.float64)


def score(documents: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """(doc_id, source, score) of every row of documents; the source in its canonical spelling."""
    sent = documents.sparkSession.sparkContext.broadcast(fit(*labelled(documents, labels, most)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = sent.value
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            scores = [text_scores(texts[i : i + AT_ONCE], weights, bias) for i in range(0, len(texts), AT_ONCE)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(np.concatenate(scores))], names=["doc_id", "source", "score"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", canonical_label("source").alias("source"), "text").mapInArrow(run, f"doc_id {kind}, source string, score double")


def found(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return score(documents, labels).where(F.col("score") >= threshold).select("doc_id")


def rates(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(source, docs, found, rate): null is a source of its own."""
    flagged = F.count_if(F.col("score") >= threshold)
    return score(documents, labels).groupBy("source").agg(F.count(F.lit(1)).alias("docs"), flagged.alias("found"), (flagged / F.count(F.lit(1))).alias("rate"))
