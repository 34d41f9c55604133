from __future__ import annotations

from pathlib import Path

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from foliant.llm import mixing as M
from foliant.llm.encoding import PATTERN, TOKENIZERS, Encoder, encode_column, read_ranks

FILE = Path(TOKENIZERS) / "byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not FILE.exists(), reason="the public vocabularies are not here")


@pytest.fixture(scope="module")
def ranks():
    return read_ranks(FILE.read_bytes())


@pytest.fixture(scope="module")
def known(ranks):
    return tiktoken.Encoding("known", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_ids_are_those_of_the_public_library(ranks, known, text):
    assert Encoder(ranks).encode(text) == known.encode_ordinary(text)


def test_long_words(ranks, known):
    encoder = Encoder(ranks)
    for word in ["a" * 5000, "가나다라" * 300, "xyzzy" * 100, "ab" * 48, "é" * 49]:
        data = word.encode()
        assert encoder._heap(data) == encoder._scan(data) == known.encode_ordinary(word)


def test_column(spark, known):
    texts = ["<|endoftext|> hi", None, "", " \n\n x", "한국어 日本語 ß", "long " * 3000, "long " * 3000]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id bigint, text string, ids int")
    got = {r["doc_id"]: list(r["ids"]) for r in encode_column(df, "doc_id", "text").collect()}
    assert got == {i: known.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["tokens"] for r in encode_column(df, "doc_id", "text", counts_only=True).collect()} == {i: len(x) for i, x in got.items()}
    assert encode_column(df.limit(0), "doc_id", "text").count() == 0


def test_temperature():
    x, w = M.temperature({"a": 90, "b": 10}, wanted_entropy=0.6)
    assert 0 < x < 1 and abs(M.entropy(w) - 0.6) < 1e-6
    x, w = M.temperature({"a": 90, "b": 10}, {"a": 9, "b": 3})
    assert abs(w["b"] - 0.3) < 1e-6 and abs(sum(w.values()) - 1) < 1e-9
    assert M.temperature({}) == (1.0, {})


def test_budgets():
    got = M.budgets({"a": 100, "b": 100, "c": 0}, {"a": 0.5, "b": 0.4, "c": 0.1}, {"a": 1, "b": 9, "c": 2}, 250)
    assert abs(got["a"] - 100) < 1e-6 and abs(got["b"] - 150) < 1e-6 and got["c"] == 0
    assert M.budgets({"a": 10}, {"a": 1.0}, {"a": 2}, 100) == {"a": 20}


def test_mix(spark):
    docs = [(i, "word " * (1 + i % 7), "Big " if i % 10 else " small") for i in range(400)] + [(900, None, "big"), (901, "", "small"), (902, "lost " * 50, None), (903, "x " * 9, "other")]
    targets = spark.createDataFrame([("big", 0.5, 2), ("small", 0.5, 3), ("none", 0.0, 1)], "source string, target_share double, max_repeats int")
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    drawn = M.mix(df, targets).collect()
    uses: dict = {}
    for r in drawn:
        uses.setdefault((r["source"], r["doc_id"]), []).append(r["pass"])
    small = [sorted(v) for (s, _), v in uses.items() if s == "small"]
    assert len(small) == 40 and all(v == [1, 2, 3] for v in small)
    assert all(v == list(range(1, len(v) + 1)) and len(v) <= 2 for v in map(sorted, uses.values()) if v not in small and len(v) < 3)
    report = {r["source"]: r for r in M.report(df, targets).collect()}
    corpus = report["big"]["corpus_tokens"]
    assert abs(sum(r["drawn"] for r in report.values()) - corpus) <= 14 and report["none"]["drawn"] == 0
    empty = df.limit(0)
    assert M.mix(empty, targets).count() == 0 and M.report(empty, targets).count() == 3 and M.temperature_weights(empty, targets).count() == 3


def test_temperature_mix_is_drawn(spark):
    """The weights of the exponent are really drawn, within the limits, and the miss of each target is told."""
    docs = [(i, "word " * (1 + i % 7), "big" if i % 10 else "small") for i in range(2_000)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.3, 2), ("none", 0.1, 5)], "source string, target_share double, max_repeats int")
    rows = {r["source"]: r for r in M.temperature_report(df, targets).collect()}
    assert rows["small"]["most_uses"] == 2 and rows["big"]["most_uses"] == 1 and rows["none"]["drawn"] == 0
    assert all(abs(r["actual_share"] - r["weight"]) < 0.002 and abs(r["missed"] - (r["actual_share"] - r["target_share"])) < 1e-12 for r in rows.values())
    assert 0 < rows["big"]["exponent"] < 1 and M.temperature_report(df.limit(0), targets).count() == 3


def test_more_buckets_draw_as_much(spark):
    sizes = spark.createDataFrame([(i, "a", 1 + i % 5) for i in range(3_000)], "doc_id bigint, source string, tokens bigint")
    rows = {"a": {"passes": 1, "budget": 9_000 + 4_321.0, "tokens": 9_000, "docs": 3_000}}
    for buckets in (None, 1, 4096):
        assert abs(M.select(sizes, rows, buckets=buckets).agg({"tokens": "sum"}).first()[0] - 13_321) <= 3
