from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliant.llm.splitting import cut_level, split, split_column


def check(text, limit, overlap):
    parts = split(text, limit, overlap)
    pieces = [text[a:b] for a, b, _ in parts]
    assert all(len(p) <= limit for p in pieces)
    assert pieces[0] + "".join(p[overlap:] for p in pieces[1:]) == text
    assert all(a[len(a) - overlap :] == b[:overlap] for a, b in zip(pieces, pieces[1:]))
    return parts


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .\n\r。!é", max_size=400), st.integers(5, 60), st.integers(0, 4))
def test_round_trip(text, limit, overlap):
    check(text, limit, overlap)


def test_long_round_trip():
    rng = random.Random(0)
    for _ in range(50):
        words = ["".join(rng.choices("abcdef", k=rng.choice([1, 3, 8, 8, 1500 if rng.random() < 0.02 else 5]))) for _ in range(rng.randint(1, 2500))]
        check("".join(w + rng.choice([" ", " ", " ", ". ", "\n", "\n\n"]) for w in words), 1200, 120)


def test_prefers_natural_boundaries():
    text = "\n\n".join("x" * 50 + f" {i}" for i in range(60))
    assert {level for *_, level in split(text)} == {"paragraph", "end"}
    assert all(level != "hard" for *_, level in split("word " * 2000))
    assert {level for *_, level in split("y" * 5000)} == {"hard", "end"}
    with pytest.raises(ValueError):
        split("x", 10, 10)


def test_cut_level():
    a = "a" * 700
    assert cut_level(f"{a}\n \t\n{a}", 1200) == "paragraph"
    assert cut_level(f"{a}\r\n{a}", 1200) == "line"
    assert cut_level(f"{a}. {a}!", 1200) == "sentence" and cut_level(f"{a}。{a}", 1200) == "sentence"
    assert cut_level(f"{a}.{a}", 1200) == "hard" and cut_level(f"{a} {a}", 1200) == "word"
    assert cut_level("  " * 900 + a, 1200) == "paragraph"


def test_column(spark):
    rows = [("a", "w " * 1000, 1), ("a", "w " * 1000, 2), ("b", None, 1), ("c", "", 1), ("d", "short", 1)]
    out = split_column(spark.createDataFrame(rows, "id string, content string, piece int"), "id", "content").collect()
    assert {r["id"] for r in out} == {"a"} and [r["piece"] for r in sorted(out, key=lambda r: r["piece"])] == [0, 1]
    assert split_column(spark.createDataFrame([], "id string, content string"), "id", "content").count() == 0
