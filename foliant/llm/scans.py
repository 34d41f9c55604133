"""Repair of text from scanned pages: broken words, misread characters, running headers and page numbers.

First all chunks are read once: words are counted, and marks that only printed pages leave are noted (words broken over
a line end, page numbers with their marks, digits inside words, head lines over lines of a page's width). A file with such a mark whose chunks mostly have lines of a page's
width is a scanned file, also one whose chunks nearly all have them. The chunks of these are then read line by line: head lines and page numbers are taken out, broken words joined, and each word that is not in the
vocabulary is looked up in tries of the vocabulary with a Levenshtein automaton, for which the exchange of a look-alike stretch is
one edit, too (two edits at most from six letters on, one below, and three from seven letters on where two find nothing). Of the words it finds those are candidates that exchanges
explain, also such that change again what another has made; swapped or missing letters are no misreads. The candidates are ranked by the number of exchanges, then by how often the
corpus has them beside the neighbouring words, then by frequency. Last, lines are reflowed into paragraphs.

The vocabulary holds the words of at least ``LEAST`` chunks, scanned or not, whatever the size of the corpus; stretches beside a
digit or broken over a line end are no words. A word that scanned files use as often as the others or more is left out as a
misread only if it looks like a word that is DOMINANT times as frequent in both kinds of files. The vocabulary stays a table: it is cut
by the first ``PREFIX`` letters of its words, each part makes a trie of its own. The automaton of a word walks the trie of these prefixes first, and the word
goes to all parts that it reaches, so no candidate is lost and no task holds the whole. The most frequent words (``HEAD_WORDS``)
are known to every task, only so that they need not be joined. The counts of neighbouring words come from a count sketch of fixed size.

Cases: chunks of other files come out as they are; null and empty contents too. Repeated rows of a chunk are one. A
null file name counts as that of other rows of the file; a file without any name still has its repeated head lines.
Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.lexicon import WALKERS, Trie, distance_within, letters
from foliant.llm.neardup import _sketch
from foliant.llm.shingles import shingle_sets
from foliant.session import cut

#: Chunks that a word of the vocabulary is in at least.
LEAST = 3
#: Words, those of most chunks, that every task holds to save their join; what is found doesn't depend on it.
HEAD_WORDS = 200_000
#: First letters by which words of the vocabulary are dealt to tries (fewer, if more than MOST_PREFIXES begin words), the words of a
#: trie, the tries of a small vocabulary, and the words that are looked up at once; results don't depend on them.
PREFIX, MOST_PREFIXES, TRIE_WORDS, TRIES, ASKED_WORDS = 4, 50_000, 50_000, 16, 200_000
#: How much more frequent a look-alike must be for a word that scanned files use more to be a misread of it.
DOMINANT = 5
CONTEXT_BITS = 22
#: Distinct words that a task of the survey holds before it hands their counts on.
MOST_HELD = 1_000_000
#: Share of a file's chunks with lines of a page's width from which it counts as scanned, with a mark and without.
WRAPPED_MARKED, WRAPPED = 0.4, 0.8
#: Scanned files (an id and a name each) up to which their list is broadcast.
BROADCAST_FILES = 100_000
#: Stretches that print alike, as (seen, meant); both directions count. Korean letters are decomposed.
LOOKALIKES = [
    ("c", "e"), ("o", "a"), ("l", "i"), ("0", "o"), ("1", "l"), ("1", "i"), ("cl", "d"), ("ii", "u"), ("li", "h"), ("9", "g"), ("rn", "m"),
    ("vv", "w"), ("l", "t"), ("5", "s"), ("8", "b"), ("6", "b"), ("6", "é"), ("9", "q"), ("ii", "ü"), ("f", "t"), ("nn", "m"), ("ri", "n"), ("u", "v"),
    ("e", "o"), ("h", "b"), ("ij", "y"), ("tl", "d"), ("lc", "k"), ("fi", "h"), ("n", "u"),
    ("ᅩ", "ᅳ"), ("ᅧ", "ᅥ"), ("ᅵ", "ᅡ"), ("ᅥ", "ᅵ"), ("ᅦ", "ᅨ"), ("ᅬ", "ᅴ"), ("ᅮ", "ᅩ"), ("ᅢ", "ᅤ"), ("ᅢ", "ᅦ"), ("ᅣ", "ᅡ"), ("ᅭ", "ᅩ"), ("ᅲ", "ᅮ"),
    ("ᅮ", "ᅳ"), ("ᅯ", "ᅱ"), ("ᄐ", "ᄅ"), ("ᄏ", "ᄀ"), ("ᄐ", "ᄃ"), ("ᄑ", "ᄇ"), ("ᄎ", "ᄌ"), ("ᆨ", "ᆿ"), ("ᆷ", "ᆸ"), ("ᆫ", "ᆯ"), ("ᆼ", "ᆷ"),
]
_ALIKE = frozenset((letters(x), letters(y)) for a, b in LOOKALIKES for x, y in ((a, b), (b, a)))
_MEANT: dict[str, list[str]] = {}
for _seen, _meant in sorted(_ALIKE):
    _MEANT.setdefault(_seen, []).append(_meant)
#: Marks that break a word at a line end.
HYPHENS = "-‐‑¬–­"
_EOL = re.compile(r"\r\n|\r|\n")
_BROKEN = re.compile(rf"[^\W\d_][{HYPHENS}][ \t]*(?:\r\n|\r|\n)\s*[^\W\d_]")
_BREAK_END = re.compile(rf"([^\W_]+)[{HYPHENS}][ \t]*$")
_SENTENCE_END = frozenset(".!?。！？:\"”»")
_WORD = re.compile(r"[^\W_]+")
_PLAIN_WORD = re.compile(r"[^\W\d_]+")
_BREAK = re.compile(rf"[{HYPHENS}][ \t]*[\r\n]")
_BROKEN_WORD = re.compile(rf"[^\W_]++[{HYPHENS}][ \t]*(?:\r\n|\r|\n)\s*[^\W_]*")
_NUMBER = r"\d{1,4}"
_ROMAN = r"(?=[ivxlc])c{0,3}(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})"
_PRINTED = rf"(?:{_NUMBER}|{_ROMAN})"
_TITLE_CODE = re.compile(r"(?:\S+ )+[A-Z]{1,3}-\d{2,5}", re.I)
_PAGE = re.compile(
    rf"(?:[-–—·\[(]\s*)?(?:(?:page|seite|página|pagina|pág\.|p\.|s\.)\s*)?{_PRINTED}(?:\s*(?:쪽|페이지|頁|ページ))?(?:\s*(?:of|von|de|sur|/)\s*{_NUMBER})?(?:\s*[-–—·\])])?", re.I
)
_MARKED_PAGE = re.compile(
    rf"(?m)^[ \t]*(?:[-–—·] {_NUMBER}(?:쪽)? [-–—·]|\[{_NUMBER}\]|p\. ?{_NUMBER}|{_NUMBER}/{_NUMBER}|page {_NUMBER} of {_NUMBER}|seite {_NUMBER} von {_NUMBER}|{_NUMBER} 페이지)[ \t]*\r?$", re.I
)
_DIGIT_INSIDE = re.compile(r"(?<!\S)[A-Za-zÀ-ÿ]{1,14}[01569][A-Za-zÀ-ÿ]{1,14}(?=[.,;:]?(?:\s|$))")
_SUFFIX = re.compile(rf"\s{{2,}}(?:chapter|part|kapitel|teil|chapitre|capítulo|§|제)\s*{_NUMBER}[장편]?$", re.I)
_LEADING_NUMBER, _TRAILING_NUMBER = re.compile(rf"^{_PRINTED}\s+(?=\S)"), re.compile(rf"(?<=\S)\s+{_PRINTED}$")
_EXTENSION = re.compile(r"\.\w{1,5}$")
NOISE = ("hyphenation", "misread", "running_header", "page_number")


def stem(name: str | None) -> str:
    return " ".join(_EXTENSION.sub("", name or "").casefold().split())


def marked(text: str) -> bool:
    """Whether a chunk shows what only printed pages leave."""
    if "\n" not in text and "\r" not in text:
        return False
    if _BROKEN.search(text) or _MARKED_PAGE.search(text):
        return True
    return any(sum(map(str.isdigit, m.group())) == 1 and len(m.group()) >= 4 and not m.group().isupper() for m in _DIGIT_INSIDE.finditer(text))


def whole_words(text: str) -> set[str]:
    """The distinct words, in lower case, without those that a digit or a line end takes apart."""
    if _BREAK.search(text):
        text = _BROKEN_WORD.sub(" ", text)
    return {w for w in set(_WORD.findall(text.lower())) if w.isalpha() or _PLAIN_WORD.fullmatch(w)}


def wrapped(text: str) -> bool:
    """Whether lines were broken at a page's width: three lines on end of like length that don't end a sentence."""
    run, last = 0, None
    for raw in _EOL.split(text):
        line = raw.rstrip()
        if 26 <= len(line) <= 100 and " " in line and "|" not in line and line[0] != "#" and line[-1] not in ".!?:;。！？":
            run = run + 1 if last is not None and abs(len(line) - last) <= 16 else 1
            last = len(line)
            if run == 3:
                return True
    return False


def head_line(line: str) -> tuple[str, bool]:
    """(the line without chapter, place and number, folded; whether a page number was in it)."""
    text, number = line.strip(), False
    text = _SUFFIX.sub("", text)
    for pattern in (_LEADING_NUMBER, _TRAILING_NUMBER):
        shorter = pattern.sub("", text)
        if shorter != text:
            text, number = _SUFFIX.sub("", shorter), True
    return " ".join(text.casefold().split()), number


def _own(line: str, name: str) -> tuple[bool, bool]:
    """Whether a line is a head line with the file's name, and whether it has the page number."""
    folded = " ".join(_SUFFIX.sub("", line.strip()).casefold().split())
    if not name:
        return False, False
    if name not in folded:
        shorter, number = head_line(line)
        place = re.split(r"\s+[—–|]\s+", shorter)[-1]
        near = any(len(x) >= 8 and distance_within(x, name, max(1, len(name) // 8)) for x in {shorter, place})
        return near, near and number
    rest = folded.replace(name, "\0", 1)
    before, after = (x.strip() for x in rest.split("\0", 1))
    number = bool(after) and bool(re.fullmatch(_PRINTED, after))
    head = re.match(rf"({_PRINTED})(?:\s+|$)", before)
    if head:
        number, before = True, before[head.end() :]
    return (not after or number) and (not before or before.endswith(("—", "–", "-", "|"))) and len(before) <= 40, number


def _title_like(line: str) -> bool:
    words = _PLAIN_WORD.findall(line)
    return bool(words) and len(line) <= 80 and not re.search(r"[.,;:!?|]$|\|", line.strip()) and not line.startswith("#") and all(not w[0].islower() for w in words)


def headed(text: str, name: str) -> bool:
    """Whether a line is a head line: the file's name, or a title with a number in capitals."""
    for line in _EOL.split(text):
        bare = line.strip()
        if 8 <= len(bare) <= 120 and (_own(bare, name)[0] or (_title_like(_SUFFIX.sub("", bare)) and _TITLE_CODE.fullmatch(head_line(bare)[0]))):
            return True
    return False


def head_candidates(text: str) -> list[tuple[str, int, int]]:
    """(folded line, hash before, hash after) of the lines that look like titles."""
    lines = [x.strip() for x in _EOL.split(text)]
    out = []
    for i, line in enumerate(lines):
        if line and _title_like(_SUFFIX.sub("", line)) and not _PAGE.fullmatch(line):
            base, _ = head_line(line)
            before, after = lines[i - 1] if i else "", lines[i + 1] if i + 1 < len(lines) else ""
            out.append((base, zlib.crc32(before.encode("utf-8", "replace")), zlib.crc32(after.encode("utf-8", "replace"))))
    return out


def _reach(word: str) -> list[int]:
    """Exchanged stretches within which look-alikes of a word are looked for, one after the other."""
    length = len(letters(word))
    return [] if length < 3 else [1 if length < 6 else 2, *([3] if length >= 7 else [])]


def can_be_misread(word: str) -> bool:
    return len(word) >= 2 and sum(map(str.isdigit, word)) <= max(1, len(word) // 4) and len(letters(word)) >= 3


def without_furniture(text: str, name: str, heads: frozenset[str]) -> tuple[set[str], list[str]]:
    """(kinds of noise, lines); a null character stands for each head line and page number."""
    noise: set[str] = set()
    kept: list[str] = []
    for line in _EOL.split(text):
        bare = line.strip()
        if bare and _PAGE.fullmatch(bare):
            noise.add("page_number")
            kept.append("\0")
            continue
        if bare:
            is_head, number = _own(bare, name)
            if not is_head:
                base, number = head_line(bare)
                title = _title_like(_SUFFIX.sub("", bare))
                is_head = title and (base in heads or bool(_TITLE_CODE.fullmatch(base)))
            elif name not in " ".join(bare.casefold().split()):
                noise.add("misread")
            if is_head:
                noise.add("running_header")
                if number:
                    noise.add("page_number")
                kept.append("\0")
                continue
        kept.append(line.rstrip())
    return noise, kept


def reflow(lines: list[str], one_word: Callable[[str, str], bool]) -> tuple[list[str], bool]:
    """(paragraphs of joined lines, whether a broken word was joined); a page border (lines of one null character, blank lines
    beside it) is no paragraph end unless the text before it ends a sentence. one_word tells whether two halves make one word."""
    paragraphs: list[list[str]] = []
    border, blank, joined = False, False, False
    for line in lines:
        bare = line.strip()
        if bare == "\0":
            border = True
            continue
        if not bare:
            blank = True
            continue
        if not paragraphs:
            paragraphs.append([bare])
        else:
            now = paragraphs[-1]
            broken = _BREAK_END.search(now[-1]) if now[-1][-1] in HYPHENS else None
            if broken and (bare[0].islower() or not bare[0].isupper() and bare[0].isalpha()) and (border or not blank):
                tail = _WORD.match(bare)
                whole = one_word(broken.group(1), tail.group() if tail else "")
                joined |= whole
                # a compound has its hyphen anyway
                now[-1] = now[-1][: broken.end(1)] + ("" if whole else "-")
                now.append(bare)
            elif blank and not (border and now[-1][-1] not in _SENTENCE_END):
                paragraphs.append([bare])
            else:
                now += [" ", bare]
        border = blank = False
    return ["".join(p) for p in paragraphs], joined


def asked_words(lines: list[str]) -> set[str]:
    """All words that reading these lines may look up: however broken words turn out to be joined."""
    halves: set[str] = set()

    def note(first: str, second: str, answer: bool) -> bool:
        halves.update((first + second, first, second))
        return answer

    words = {w.lower() for answer in (True, False) for p in reflow(lines, lambda a, b: note(a, b, answer))[0] for w in _WORD.findall(p)}  # noqa: B023
    return {w for w in words | {h.lower() for h in halves} if len(w) >= 2}


class Reader:
    """Repairs the words of one chunk by what is known of them: head, the most frequent words, and for the others answers,
    True for a word of the vocabulary or the words (word, exchanges, chunks) that look like it."""

    def __init__(self, head: frozenset[str], context: np.ndarray):
        self.head, self.context = head, context

    def _beside(self, pairs: list[tuple[str, str]]) -> list[int]:
        """How often, as a rank, the corpus has these pairs of words side by side."""
        tokens, offsets, _ = shingle_sets([f"{a} {b}" for a, b in pairs], 2)
        return [int(self.context[int(tokens[o]) & (len(self.context) - 1)]) if o < e else 0 for o, e in zip(offsets[:-1], offsets[1:], strict=True)]

    def correct(self, word: str, found: list[tuple[str, int, int]], before: str, after: str) -> str:
        """The word meant, one of found."""
        if len(found) > 1:
            beside = self._beside([p for w, _, _ in found for p in ((before.lower() or "-", w), (w, after.lower() or "-"))])
            found = [f for _, f in sorted(((n, -(beside[2 * i] + beside[2 * i + 1]), -chunks, w), (w, n, chunks)) for i, (w, n, chunks) in enumerate(found))]
        best = found[0][0]
        return best.upper() if word.isupper() and len(word) > 1 else best.capitalize() if word[0].isupper() else best

    def read(self, lines: list[str], answers: dict[str, bool | list[tuple[str, int, int]]]) -> tuple[set[str], str]:
        """(kinds of noise, the repaired text)."""
        noise: set[str] = set()
        head = self.head

        def is_word(word: str) -> bool:
            w = word.lower()
            return w in head or bool(answers.get(w))

        paragraphs, joined = reflow(lines, lambda a, b: is_word(a + b) or not (is_word(a) and is_word(b)))
        if joined:
            noise.add("hyphenation")
        out = []
        for paragraph in paragraphs:
            words = list(_WORD.finditer(paragraph)) if answers else []
            pieces, last = [], 0
            for i, m in enumerate(words):
                found = answers.get(m.group().lower())
                if found and found is not True:
                    noise.add("misread")
                    pieces += [paragraph[last : m.start()], self.correct(m.group(), found, words[i - 1].group() if i else "", words[i + 1].group() if i + 1 < len(words) else "")]
                    last = m.end()
            out.append("".join(pieces) + paragraph[last:])
        return noise, "\n\n".join(out)


def _survey(chunks: DataFrame) -> DataFrame:
    """One row for each chunk (doc_id, name, mark, wrap) and for each word of a partition (word, its chunks)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: Counter[str] = Counter()
        for batch in batches:
            for text in batch["content"]:
                words.update(whole_words(text))
            wrap = [wrapped(t) for t in batch["content"]]
            mark = [marked(t) or (w and headed(t, stem(n))) for t, w, n in zip(batch["content"], wrap, batch["docnm_kwd"], strict=True)]
            yield batch[["doc_id", "docnm_kwd"]].assign(mark=mark, wrap=wrap, word=None, chunks=0)
            if len(words) > MOST_HELD:
                yield _word_rows(words)
                words.clear()
        yield _word_rows(words)

    return chunks.select("doc_id", "docnm_kwd", "content").mapInPandas(run, "doc_id string, docnm_kwd string, mark boolean, wrap boolean, word string, chunks bigint")


def _word_rows(words: Counter[str]) -> pd.DataFrame:
    return pd.DataFrame({"doc_id": None, "docnm_kwd": None, "mark": None, "wrap": None, "word": [*words], "chunks": [*words.values()]})


def _counted(survey: DataFrame, pages: DataFrame) -> DataFrame:
    """(word, clean, scanned): the words of at least LEAST chunks with their chunks in other and in scanned files."""
    inside = _survey(pages.withColumnsRenamed({"name": "docnm_kwd"})).where("word is not null").select("word", F.lit(0).cast("bigint").alias("chunks"), F.col("chunks").alias("scanned"))
    words = survey.where("word is not null").select("word", "chunks", F.lit(0).cast("bigint").alias("scanned")).unionByName(inside)
    counted = words.groupBy("word").agg((F.sum("chunks") - F.sum("scanned")).alias("clean"), F.sum("scanned").alias("scanned"))
    return counted.where((F.col("clean") + F.col("scanned") >= LEAST) & (F.length("word") >= 2))


def _parts(begun: list[tuple[str, int]], words_of_trie: int) -> list[tuple[str, int, int]]:
    """(prefix, first part, parts) of sorted (prefix, words): neighbours share a part while it has room, a prefix of more words has several."""
    out, part, held = [], 0, 0
    for prefix, n in begun:
        if held and held + n > words_of_trie:
            part, held = part + 1, 0
        parts = math.ceil(n / words_of_trie)
        out.append((prefix, part, parts))
        part, held = (part + parts, 0) if parts > 1 else (part, held + n)
    return out


def _by_reach(words: Iterable[str]) -> Iterator[tuple[int, list[str]]]:
    """(edits, the words that may be misread and are looked up within so many)."""
    by: dict[int, list[str]] = {}
    for w in words:
        if can_be_misread(w):
            by.setdefault(_reach(w)[-1], []).append(w)
    yield from by.items()


def look_alikes(asked: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(word, other, n, clean, scanned): all words of the vocabulary (word, clean, scanned) that Levenshtein automata of asked words
    (word) find and exchanged stretches explain, with the least number of exchanges."""
    spark = asked.sparkSession

    def begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(begins=[letters(w)[:PREFIX] for w in batch["word"]])

    known = cut(vocabulary.select("word", "clean", "scanned").mapInPandas(begin, "word string, clean bigint, scanned bigint, begins string"))
    for length in range(PREFIX, 0, -1):
        begun = known.groupBy(F.substring("begins", 1, length).alias("begins")).count()
        if length == 1 or begun.count() <= MOST_PREFIXES:
            break
    counts = sorted(tuple(r) for r in begun.collect())
    dealt = _parts(counts, min(TRIE_WORDS, max(1, math.ceil(sum(n for _, n in counts) / TRIES))))
    parts = spark.sparkContext.broadcast(dealt)

    def reached(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie = Trie(prefix for prefix, _, _ in parts.value)
        ranges = {prefix: range(first, first + n) for prefix, first, n in parts.value}
        of_node = [ranges[w] if w is not None else range(0) for w in trie.word]
        first, last = np.array([r.start for r in of_node]), np.array([r.stop for r in of_node])
        total = int(last.max(initial=0))
        for batch in batches:
            for at in range(0, len(batch), WALKERS):
                for most, words in _by_reach(batch["word"][at : at + WALKERS]):
                    hit = np.zeros((len(words), total + 1), np.int32)  # ranges of parts, added up
                    for places, nodes, _ in trie.near(words, most, _MEANT, open_ended=True):
                        np.add.at(hit, (places, first[nodes]), 1)
                        np.add.at(hit, (places, last[nodes]), -1)
                    word, part = np.nonzero(np.cumsum(hit, axis=1)[:, :total])
                    yield pd.DataFrame({"part": part, "word": np.array(words, object)[word]})

    def find(words: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(words) and len(held):
            trie, chunks = Trie(held["word"]), dict(zip(held["word"], zip(held["clean"], held["scanned"], strict=True), strict=True))
            for most, some in _by_reach(words["word"]):
                rows += [(some[i], other, n, *chunks[other]) for i, other, n in trie.look_alikes(some, _MEANT, most)]
        return pd.DataFrame(rows, columns=["word", "other", "n", "clean", "scanned"])

    slices = max(1, math.ceil(asked.count() / ASKED_WORDS))
    words = asked.select("word").mapInPandas(reached, "part int, word string").withColumn("slice", F.crc32("word") % slices)
    first = spark.createDataFrame(dealt, "begins string, first int, parts int")
    held = known.withColumn("begins", F.substring("begins", 1, length)).join(F.broadcast(first), "begins")
    held = held.select("word", "clean", "scanned", (F.col("first") + F.crc32("word") % F.col("parts")).cast("int").alias("part"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(slices - 1).cast("bigint"))).alias("slice"))
    return words.groupBy("part", "slice").cogroup(held.groupBy("part", "slice")).applyInPandas(find, "word string, other string, n int, clean bigint, scanned bigint")


def _answers(asked: DataFrame, counted: DataFrame) -> DataFrame:
    """(word, known, found): what is known of asked words (word) that are not in the head of the vocabulary; found (other, n, chunks)
    are the words that one outside the vocabulary looks like, of the first of its numbers of exchanges that finds any."""
    suspects = counted.where("clean <= scanned")
    words = asked.select("word").distinct().join(counted, "word", "left")
    sure = words.where("clean > scanned").select("word", F.lit(True).alias("known"))
    doubtful = cut(words.where("clean is null").unionByName(suspects).distinct())
    near = cut(look_alikes(doubtful, counted))
    against = near.select("word", F.col("clean").alias("c"), F.col("scanned").alias("s")).join(suspects, "word")
    misread = cut(against.where((F.col("c") >= DOMINANT * F.col("clean")) & (F.col("s") >= DOMINANT * F.col("scanned"))).select("word").distinct())
    known = suspects.select("word").join(misread, "word", "left_anti")
    near = near.join(known, "word", "left_anti").join(misread.select(F.col("word").alias("other")), "other", "left_anti")
    near = near.select("word", F.struct("other", "n", (F.col("clean") + F.col("scanned")).alias("chunks")).alias("one"))
    found = near.groupBy("word").agg(F.collect_list("one").alias("found"))
    least = F.array_min(F.transform("found", lambda x: x["n"]))
    reach = F.when(least <= 2, 2).otherwise(3)
    found = found.select("word", F.lit(False).alias("known"), F.filter("found", lambda x: x["n"] <= reach).alias("found"))
    return sure.unionByName(known.withColumn("known", F.lit(True))).unionByName(found, allowMissingColumns=True)


def repair(chunks: DataFrame) -> DataFrame:
    """(chunk_id, noise, content) of the chunks of scanned files: kinds of noise found, sorted, and the repaired text."""
    rows = chunks.select("chunk_id", "doc_id", "docnm_kwd", "content").where(F.length("content") > 0)
    survey = cut(_survey(rows))
    spark = chunks.sparkSession
    files = survey.where("mark is not null").groupBy("doc_id").agg(
        F.min("docnm_kwd").alias("file_name"), F.count(F.lit(1)).alias("n"), F.count_if("mark").alias("marks"), F.count_if("wrap").alias("wraps")
    )
    share = F.col("wraps") / F.col("n")
    scanned = files.where(((F.col("marks") > 0) & (share >= WRAPPED_MARKED)) | ((F.col("n") > 1) & (share >= WRAPPED))).select(F.col("doc_id").alias("_doc"), "file_name")
    scanned = cut(scanned)
    if scanned.count() <= BROADCAST_FILES:  # else both sides are shuffled, and Spark splits a file that is too large for a task
        scanned = F.broadcast(scanned)
    pages = rows.join(scanned, rows["doc_id"].eqNullSafe(scanned["_doc"])).drop("_doc").groupBy("chunk_id").agg(
        F.first("doc_id").alias("doc_id"), F.coalesce(F.min("docnm_kwd"), F.first("file_name")).alias("name"), F.first("content").alias("content")
    )
    pages = cut(pages)

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(d, k, *c) for d, k, t in zip(batch["doc_id"], batch["chunk_id"], batch["content"], strict=True) for c in head_candidates(t)]
            yield pd.DataFrame(found, columns=["doc_id", "chunk_id", "line", "before", "after"])

    titles = cut(pages.mapInPandas(lines, "doc_id string, chunk_id string, line string, before bigint, after bigint"))
    repeated = (
        titles.groupBy("doc_id", "line")
        .agg(F.min("chunk_id").alias("c0"), F.max("chunk_id").alias("c1"), F.min("before").alias("b0"), F.max("before").alias("b1"), F.min("after").alias("a0"), F.max("after").alias("a1"))
        .where("c0 < c1 and b0 < b1 and a0 < a1")
        .select("doc_id", "line")
    )
    heads = titles.join(repeated, ["doc_id", "line"], "left_semi").groupBy("chunk_id").agg(F.collect_set("line").alias("heads"))
    counted = cut(_counted(survey, pages))
    common = counted.where("clean > scanned").orderBy(F.desc(F.col("clean") + F.col("scanned")), "word").limit(HEAD_WORDS).select("word")
    head = spark.sparkContext.broadcast(frozenset(r["word"] for r in common.collect()))

    def strip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            noise, kept, asked = [], [], []
            for t, name, found in zip(batch["content"], batch["name"], batch["heads"], strict=True):
                kinds, left = without_furniture(t, stem(name), frozenset(found) if found is not None else frozenset())
                noise.append(sorted(kinds))
                kept.append("\n".join(left))
                asked.append([w for w in asked_words(left) if w not in head.value])
            yield pd.DataFrame({"chunk_id": batch["chunk_id"], "noise": noise, "kept": kept, "asked": asked})

    stripped = cut(pages.join(heads, "chunk_id", "left").mapInPandas(strip, "chunk_id string, noise array<string>, kept string, asked array<string>"))
    asked = stripped.select("chunk_id", F.explode("asked").alias("word"))
    told = asked.join(_answers(asked, counted), "word").groupBy("chunk_id").agg(F.collect_list(F.struct("word", "known", "found")).alias("told"))
    context = spark.sparkContext.broadcast(_sketch(rows.select(F.col("content").alias("text")), 2, 2, CONTEXT_BITS))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(head.value, context.value.dense())
        for batch in batches:
            noise, texts = [], []
            for kept, kinds, told_ in zip(batch["kept"], batch["noise"], batch["told"], strict=True):
                answers = {x["word"]: True if x["known"] else [(y["other"], y["n"], y["chunks"]) for y in x["found"]] for x in told_} if told_ is not None else {}
                more, text = reader.read(kept.split("\n"), answers)
                noise.append(sorted(more.union(kinds)))
                texts.append(text)
            yield pd.DataFrame({"chunk_id": batch["chunk_id"], "noise": noise, "content": texts})

    return stripped.drop("asked").join(told, "chunk_id", "left").mapInPandas(run, "chunk_id string, noise array<string>, content string")


def noise_found(chunks: DataFrame) -> DataFrame:
    """(chunk_id, noise): one row for each kind of noise in a chunk."""
    return repair(chunks).select("chunk_id", F.explode("noise").alias("noise"))


def repaired(chunks: DataFrame) -> DataFrame:
    """(chunk_id, content, noise): every chunk once, repaired if it is of a scanned file, else as it is."""
    mended = repair(chunks).withColumnsRenamed({"content": "mended"})
    every = chunks.groupBy("chunk_id").agg(F.first("content", ignorenulls=True).alias("content"))
    return every.join(mended, "chunk_id", "left").select("chunk_id", F.coalesce("mended", "content").alias("content"), F.coalesce("noise", F.array().cast("array<string>")).alias("noise"))
