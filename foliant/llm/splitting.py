"""Splitting texts over a size limit at natural boundaries, with an overlap between consecutive pieces.

Balanced targets: from the least number of pieces that can hold the text, equal-length targets are placed, and each is
snapped to the strongest boundary near it (paragraph, line, sentence, word). A piece is added when a limit fails: when
a target can only be met inside a word although a boundary lies within reach of a larger number of pieces. Sizes are
Unicode code points. The first piece plus every later piece without its overlap gives the text back exactly.

Cases: null texts give no piece, texts up to the limit one (an empty text one empty piece). A stretch without white
space beyond the limit is cut hard. Nothing is cut inside the overlap of the piece before. Repeated rows with the same
key are split once; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = ("hard", "word", "sentence", "line", "paragraph")
_EOL = r"(?>\r\n|\r|\n)"  # atomic: CR LF is never two line ends
_BOUNDARY = {
    "paragraph": re.compile(rf"{_EOL}(?:[ \t]*{_EOL})+"),
    "line": re.compile(_EOL),
    "sentence": re.compile(r"[.!?](?=\s)\s?|[。！？]"),
    "word": re.compile(r"\s+"),
}
_LINE = re.compile(_EOL)
_SENTENCE = re.compile(r"(?<=[.!?])(?=\s)|(?<=[。！？])")


def cut_level(text: str, limit: int) -> str:
    """The first level whose units all fit the limit, white space around each unit not counted."""

    def fits(units) -> bool:
        return all(len(u.strip()) <= limit for u in units)

    if fits(_BOUNDARY["paragraph"].split(text)):
        return "paragraph"
    lines = _LINE.split(text)
    if fits(lines):
        return "line"
    if fits(s for line in lines for s in _SENTENCE.split(line)):
        return "sentence"
    return "word" if fits(text.split()) else "hard"


def _boundaries(text: str) -> dict[str, list[int]]:
    return {level: [m.end() for m in pattern.finditer(text)] for level, pattern in _BOUNDARY.items()}


def _snap(marks: dict[str, list[int]], target: float, low: int, high: int, near: float) -> tuple[int, str]:
    """The boundary for one target: the strongest within ``near`` of it, else the strongest anywhere in [low, high]."""
    for a, b in ((max(low, math.ceil(target - near)), min(high, math.floor(target + near))), (low, high)):
        for level in reversed(LEVELS[1:]):
            at = marks[level]
            i, j = bisect_left(at, a), bisect_right(at, b)
            if i < j:
                k = min(max(bisect_left(at, target), i), j - 1)
                return min(at[max(k - 1, i) : k + 1], key=lambda p: abs(p - target)), level
    return min(max(round(target), low), high), "hard"


def _cuts(length: int, marks: dict[str, list[int]], pieces: int, limit: int, overlap: int) -> list[tuple[int, str]] | None:
    """Cut points for so many pieces, None if one lands inside a word that another number of pieces might spare."""
    body = limit - overlap
    size = (length + (pieces - 1) * overlap) / pieces
    out: list[tuple[int, str]] = []
    last = 0
    for k in range(1, pieces):
        high = last + (limit if k == 1 else body)
        low = max(last + max(overlap if k == 1 else 1, 1), length - (pieces - k) * body)
        if low > high:
            return None
        at, level = _snap(marks, size + (k - 1) * (size - overlap), low, high, 0.25 * (size - overlap))
        if level == "hard" and low > last + max(overlap, 1):
            # is there any boundary if earlier cuts were free to end before low?
            words = marks["word"]
            if bisect_left(words, last + max(overlap, 1)) < bisect_right(words, high):
                return None
        out.append((at, level))
        last = at
    return out


def split(text: str, limit: int = 1200, overlap: int = 120) -> list[tuple[int, int, str]]:
    """(start, end, level at its end) of each piece; piece k > 0 starts ``overlap`` before the end of piece k - 1."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be at least 0 and smaller than the limit")
    length = len(text)
    if length <= limit:
        return [(0, length, "end")]
    marks = _boundaries(text)
    least = 1 + math.ceil((length - limit) / (limit - overlap))
    cuts = None
    for pieces in range(least, 2 * least + 2):
        cuts = _cuts(length, marks, pieces, limit, overlap)
        if cuts is not None:
            break
    if cuts is None:
        cuts = _walk(length, marks, limit, overlap)
    ends = [*cuts, (length, "end")]
    starts = [0, *(at - overlap for at, _ in cuts)]
    return [(s, e, level) for s, (e, level) in zip(starts, ends, strict=True)]


def _walk(length: int, marks: dict[str, list[int]], limit: int, overlap: int) -> list[tuple[int, str]]:
    """Texts that mix long stretches with ordinary words: cut from left to right, as far as the limit allows."""
    out: list[tuple[int, str]] = []
    last, high = 0, limit
    while length > high:
        out.append(_snap(marks, high, last + max(overlap, 1), high, (limit - overlap) / 3))
        last = out[-1][0]
        high = last + limit - overlap
    return out


def _long_texts(df: DataFrame, key: str, text: str, limit: int) -> DataFrame:
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.length("text") > limit).dropDuplicates(["key"])


def split_column(df: DataFrame, key: str, text: str, limit: int = 1200, overlap: int = 120) -> DataFrame:
    """(key, piece, pieces, start, level, content, cut_level): the pieces of every text over the limit.

    ``level`` says at what each piece ends, ``cut_level`` which units of the whole text fit the limit.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, t in zip(batch["key"], batch["text"], strict=True):
                parts, whole = split(t, limit, overlap), cut_level(t, limit)
                rows += [(k, i, len(parts), s, level, t[s:e], whole) for i, (s, e, level) in enumerate(parts)]
            yield pd.DataFrame(rows, columns=["key", "piece", "pieces", "start", "level", "content", "cut_level"])

    kind = df.schema[key].dataType.simpleString()
    out = _long_texts(df, key, text, limit).mapInPandas(run, f"key {kind}, piece int, pieces int, start int, level string, content string, cut_level string")
    return out.withColumnRenamed("key", key)
