"""Headings by numbering: which family of bullets a text uses, the level of each line, and chunks that keep headings above bodies.

Lines of a text are sections. Families, and what is no heading, are patterns; whole columns are classified by expressions in the JVM,
the folds over one text run in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.operators.chunking import count_tokens, newlines

_CJK = "零一二三四五六七八九十百"
#: The families of headings, the levels of each in order.
FAMILIES = [
    [rf"第[{_CJK}0-9]+(?:分?编|部分)", rf"第[{_CJK}0-9]+章", rf"第[{_CJK}0-9]+节", rf"第[{_CJK}0-9]+条", rf"[\(（][{_CJK}]+[\)）]"],
    [r"第[0-9]+章", r"第[0-9]+节", r"[0-9]{0,2}[\. 、]", r"[0-9]{0,2}\.[0-9]{0,2}[^a-zA-Z/%~-]", r"[0-9]{0,2}\.[0-9]{0,2}\.[0-9]{0,2}", r"[0-9]{0,2}\.[0-9]{0,2}\.[0-9]{0,2}\.[0-9]{0,2}"],
    [rf"第[{_CJK}0-9]+章", rf"第[{_CJK}0-9]+节", rf"[{_CJK}]+[ 、]", rf"[\(（][{_CJK}]+[\)）]", r"[\(（][0-9]{0,2}[\)）]"],
    ["PART (?:ONE|TWO|THREE|FOUR|FIVE|SIX|SEVEN|EIGHT|NINE|TEN)", "Chapter (?:I+V?|VI*|XI|IX|X)", "Section [0-9]+", "Article [0-9]+"],
    ["#[^#]", "##[^#]", "###.*", "####.*", "#####.*", "######.*"],
]
#: Fixed value: what begins like a numbered heading and is none.
NO_BULLET = r"(?:0|[0-9]+ +[0-9~个只-]|[0-9]+\.{2,}|[0-9]+(?:\.[0-9]+){2,}[的中])"
#: An article is a title, whatever it looks like; marks that a title has not; lines over a table of contents.
ARTICLE, SENTENCE_MARKS = rf"第[{_CJK}0-9]+条", r"[,;，。；！!]"
CONTENTS = r"(?i)(?:contents|目录|目次|tableofcontents|致谢|acknowledge)$"
#: Fixed value: tokens up to which single lines are gathered into one chunk.
GATHERED = 218
_NO_BULLET = re.compile(NO_BULLET)
_LEVELS = [[re.compile(p) for p in family] for family in FAMILIES]


def family_column(lines: Column) -> Column:
    """The number of the family that most lines begin with, the first of those that tie, -1 if none does."""
    heads = F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike(f"^{NO_BULLET}"))

    def beginning(patterns: list[str]) -> Column:
        return F.size(F.filter(heads, lambda x: x.rlike(f"^(?:{'|'.join(patterns)})")))

    hits = [beginning(f) for f in FAMILIES]
    most, out = F.greatest(*hits), F.lit(-1)
    for i in range(len(FAMILIES) - 1, -1, -1):
        out = F.when((hits[i] == most) & (most > 0), i).otherwise(out)
    return out


def is_no_title(c: Column) -> Column:
    """Whether a line is too long for a title or has the marks of a sentence; articles are titles."""
    long = (F.size(F.filter(F.split(c, r"\s+"), lambda w: w != "")) > 12) | (~c.contains(" ") & (F.length(c) >= 32))
    return ~c.rlike(f"^{ARTICLE}") & (long | c.rlike(SENTENCE_MARKS))


def family(lines: list[str]) -> int:
    hits = [sum(any(p.match(x) for p in f) and not _NO_BULLET.match(x) for x in map(str.strip, lines)) for f in _LEVELS]
    return hits.index(max(hits)) if max(hits) else -1


def level(line: str, family_no: int) -> int:
    """The level of a line in its family from 0 on; lines of the body come after all levels."""
    text = line.replace("　", " ").strip()
    if not _NO_BULLET.match(text):
        for i, p in enumerate(_LEVELS[family_no]):
            if p.match(text):
                return i
    return len(_LEVELS[family_no])


def most_frequent_level(lines: list[str], family_no: int) -> int:
    """The level that most headings have; one beyond all levels if there is none."""
    levels = [x for x in (level(t, family_no) for t in lines) if x < len(_LEVELS[family_no])] if family_no >= 0 else []
    return max(dict.fromkeys(levels), key=levels.count) if levels else (len(_LEVELS[family_no]) if family_no >= 0 else 0) + 1


def _sections(text: str) -> list[str]:
    return [x for x in map(str.strip, newlines(text or "").split("\n")) if len(x) > 1 and not x.isdecimal()]


def tree_chunks(text: str, depth: int = 2) -> list[str]:
    """A chunk for each heading that has none below it, down to the depth-th level that occurs: the headings above it with what stands
    under them, then its own lines. Text without any family of headings is one chunk a line."""
    lines = _sections(text)
    number = family(lines)
    if number < 0:
        return lines
    levels = [level(x, number) for x in lines]
    body, ranks = len(_LEVELS[number]), sorted(set(levels))
    deepest = ranks[min(depth, len(ranks)) - 1]
    if deepest == body and len(ranks) > 1:
        deepest = ranks[-2]
    opening: list[str] = []
    path: list[tuple[int, list[str]]] = []
    out: list[str] = []

    def leaf() -> None:
        if path:
            out.append("\n".join(x for _, part in path for x in part))

    closed = True  # whether what the path leads to has been put out
    for line, at in zip(lines, levels, strict=True):
        if at > deepest:
            (path[-1][1] if path else opening).append(line)
            continue
        if path and at <= path[-1][0] and not closed:
            leaf()
        while path and at <= path[-1][0]:
            path.pop()
        path.append((at, [line]))
        closed = False
    if not closed:
        leaf()
    return (["\n".join(opening)] if opening else []) + out


def hierarchical_chunks(text: str, depth: int = 5, count: Callable[[str], int] = count_tokens) -> list[list[str]]:
    """Chunks as lists of lines: each line of the body with the headings it stands under, headings without a body with those above them;
    single lines are gathered while they have fewer than GATHERED tokens together. depth: how many levels, from the body up, open chunks."""
    lines = _sections(text)
    number = family(lines)
    if number < 0:
        return []
    body = len(_LEVELS[number])
    # numbering is told by its pattern alone here, unlike in the tree
    levels = [next((i for i, p in enumerate(_LEVELS[number]) if p.match(x)), body + 1) for x in lines]
    chains: dict[int, list[int]] = {}
    latest: dict[int, int] = {}
    for i, at in enumerate(levels):
        chain = [i]
        for above in range(at - 1, -1, -1):
            heading = latest.get(above, -1)
            if heading >= 0:
                if heading > chain[-1]:
                    chain.pop()
                chain.append(heading)
        chains[i] = chain
        latest[at] = i
    used: set[int] = set()
    found: list[list[int]] = []
    for at in sorted(range(body + 2), reverse=True)[:depth]:
        for i, own in enumerate(levels):
            if own != at or i in used:
                continue
            chain = [i] if at == 1 else chains[i]  # the level under the topmost opens chunks of its own
            found.append(chain[::-1])
            used.update(chain, [i])
    out: list[list[str]] = [[]]
    size = 0
    for chain in found:
        chunk = [lines[i] for i in chain]
        n = count(chunk[0]) if len(chunk) == 1 else GATHERED
        if len(chunk) == 1 and n + size < GATHERED:
            out[-1] += chunk
            size += n
        else:
            out.append(chunk)
            size = n
    return [c for c in out if c]


def without_contents(lines: list[str], reach: int = 128) -> list[str]:
    """Lines without tables of contents: from the line that says so up to where the first entry comes again as a heading."""
    out: list[str] = []
    i = 0
    while i < len(lines):
        if not re.match(CONTENTS, re.sub(r"[ 　]+", "", lines[i].strip())):
            out.append(lines[i])
            i += 1
            continue
        i += 1
        while i < len(lines) and not lines[i].strip():
            i += 1
        if i == len(lines):
            break
        opening = lines[i].strip()[:3]
        again = next((j for j in range(i + 1, min(i + 1 + reach, len(lines))) if lines[j].strip().startswith(opening)), None)
        i = i + 1 if again is None else again
    return out


_WORDS = {w: n for n, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())}
_WORDS |= {w: 10 * n for n, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)}
_SCALES = {"hundred": 100, "thousand": 1_000, "million": 1_000_000}
_HAN_DIGITS = {c: n for n, c in enumerate("零一二三四五六七八九")} | {"〇": 0, "两": 2}
_HAN_SCALES = {"十": 10, "百": 100, "千": 1_000, "万": 10_000, "亿": 100_000_000}
_ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1_000}


def _scaled(parts: list[int | None], scales: list[int | None]) -> int:
    """A number of digits and scales in turn: scales multiply what stands before them, a greater one all since the last such."""
    total, part, digit = 0, 0, 0
    for n, scale in zip(parts, scales, strict=True):
        if scale is None:
            digit += n or 0
        elif scale >= 1_000 and scale > part + digit:
            total, part, digit = total + max(part + digit, 1) * scale, 0, 0
        else:
            part, digit = part + max(digit, 1) * scale, 0
    return total + part + digit


def numeral(text: str | None) -> int:
    """The number that digits, English words, Han or Roman numerals stand for; -1 if they stand for none."""
    t = (text or "").strip()
    if re.fullmatch(r"[+-]?\d+", t):
        return int(t)
    words = [w for w in re.split(r"[\s-]+", t.lower()) if w != "and"]
    if words and all(w in _WORDS or w in _SCALES for w in words):
        return _scaled([_WORDS.get(w) for w in words], [_SCALES.get(w) for w in words])
    if t and all(c in _HAN_DIGITS or c in _HAN_SCALES for c in t):
        return _scaled([_HAN_DIGITS.get(c) for c in t], [_HAN_SCALES.get(c) for c in t])
    if re.fullmatch(r"(?i)(?=.)M{0,3}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})", t):
        values = [_ROMAN[c] for c in t.upper()]
        return sum(-v if v < after else v for v, after in zip(values, [*values[1:], 0], strict=True))
    return -1
