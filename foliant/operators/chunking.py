"""Chunkers: sections to chunks by delimiters, budgets and structure. Folds over a text run in Arrow batches."""

from __future__ import annotations

import base64
import csv
import re
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Counter = Callable[[str], int]
_WORD, _RUN = re.compile(r"[^\W_]+|[^\w\s]"), re.compile(r"[^\W_]+")


def count_tokens(text: str) -> int:
    """The default counter: words and marks."""
    return len(_WORD.findall(text or ""))


def count_words(text: str) -> int:
    """A coarser counter: runs of letters and digits."""
    return len(_RUN.findall(text or ""))


class BpeCounter:
    """Token counts by a public byte-level vocabulary (a .tiktoken file), read once on the driver and sent along."""

    def __init__(self, path: str):
        self.data, self._encoding = Path(path).read_bytes(), None

    def __call__(self, text: str) -> int:
        if self._encoding is None:
            import tiktoken

            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in self.data.splitlines() if line)}
            pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
            self._encoding = tiktoken.Encoding("counter", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return len(self._encoding.encode_ordinary(text or ""))

    def __getstate__(self) -> dict:
        return {"data": self.data, "_encoding": None}


def newlines(text: str) -> str:
    return text.replace("\r\n", "\n").replace("\r", "\n")


def delimiters(field: str) -> list[str]:
    """Delimiters of a field: multi-character ones in backticks, other characters each by itself; each once, the longest first."""
    parts = re.split(r"`([^`]+)`", newlines(field or ""))  # every second part stood in backticks
    found = [x for i, part in enumerate(parts) for x in ([part] if i % 2 else part)]
    return sorted(dict.fromkeys(found), key=len, reverse=True)


def has_custom(field: str) -> bool:
    return re.search(r"`[^`]+`", newlines(field or "")) is not None


def group_sizes(sizes: list[int], cap: int, strategy: str = "over", overlap: int = 0) -> list[list[int]]:
    """Indices of consecutive pieces that go together; a piece beyond the cap stands alone.

    over: a group takes pieces until its sum is beyond the threshold, the cap less the room for the overlap, so its last piece may take it
    beyond the cap; under: no piece may take a group beyond the cap.
    """
    threshold = cap * (100 - overlap) / 100
    groups: list[list[int]] = []
    room = False  # whether the last group takes more
    total = 0
    for i, n in enumerate(sizes):
        if n > cap:
            groups.append([i])
            room = False
            continue
        if room and (total + n <= cap if strategy == "under" else total <= threshold):
            groups[-1].append(i)
            total += n
        else:
            groups.append([i])
            room, total = True, n
    return groups


def with_overlap(chunks: list[str], overlap: int) -> list[str]:
    """Each chunk after the first opens with the last ``overlap`` percent of the one before, which has its own overlap already."""
    out: list[str] = []
    for chunk in chunks:
        before = out[-1] if out and overlap > 0 else ""
        out.append(before[int(len(before) * (100 - overlap) / 100) :] + chunk if before else chunk)
    return out


def naive_merge(text: str, cap: int = 128, field: str = "\n。；！？", overlap: int = 0, count: Counter = count_tokens, strategy: str = "over") -> list[str]:
    """Paragraphs between delimiters, which are left out themselves, each after a line end, merged up to the cap and given their overlap.
    Delimiters in backticks bypass the cap: every paragraph is a chunk. Without delimiters the text is one paragraph."""
    if not text:
        return []
    pattern = "|".join(map(re.escape, delimiters(field)))
    pieces = [f"\n{p}" for p in (re.split(pattern, newlines(text)) if pattern else [newlines(text)]) if p]
    if has_custom(field):
        return pieces
    groups = group_sizes([count(p) for p in pieces], cap, strategy, overlap)
    return with_overlap(["".join(pieces[i] for i in g) for g in groups], overlap)


def children(text: str, pattern: str) -> list[str]:
    """Pieces of a chunk that end with what matches the pattern; matches that follow each other without text between fall out. A pattern
    that is none leaves the chunk whole."""
    try:
        marks = re.compile(pattern, re.S)
    except re.error:
        return [text]
    out, at = [], 0
    for m in marks.finditer(text):
        if m.start() > at:
            out.append(text[at : m.end()])
        at = m.end()
    return [*out, text[at:]] if at < len(text) else out


def markdown_elements(text: str) -> list[tuple[str, str]]:
    """(kind, text) of headers, code, tables, lists, quotes and prose; a fence shields what is in it."""
    out: list[tuple[str, list[str]]] = []
    fence = ""
    for line in re.split(r"\r\n|\r|\n", text or ""):
        mark = re.match(r"\s*(```+|~~~+)", line)
        if fence:
            out[-1][1].append(line)
            if mark and mark.group(1).startswith(fence):
                fence = ""
            continue
        if mark:
            fence = mark.group(1)
            out.append(("code", [line]))
            continue
        kind = (
            "blank" if not line.strip() else "header" if re.match(r"#{1,6}\s", line) else "table" if line.strip().startswith("|") else "list" if re.match(r"\s*(?:[-*+]|\d+[.)])\s", line) else "quote" if line.lstrip().startswith(">") else "text"
        )
        if kind != "header" and out and out[-1][0] == kind:
            out[-1][1].append(line)
        else:
            out.append((kind, [line]))
    return [(k, "\n".join(ls)) for k, ls in out if k != "blank"]


def markdown_chunks(text: str) -> list[str]:
    """Elements as chunks, a header that stands alone goes with the prose after it, but not with code, tables, lists or quotes."""
    out: list[str] = []
    held = ""
    for kind, body in markdown_elements(text):
        if kind == "header":
            held = f"{held}\n{body}" if held else body
            continue
        if held and kind == "text":
            body, held = f"{held}\n{body}", ""
        elif held:
            out.append(held)
            held = ""
        out.append(body)
    return [*out, held] if held else out


def qa_pairs(rows: list[list[str]]) -> list[tuple[str, str]]:
    """Question-answer pairs of two-field rows (an older form that trims them); a row with another number of fields goes on with the answer before."""
    out: list[tuple[str, str]] = []
    for row in rows:
        if len(row) == 2:
            out.append((row[0], row[1]))
        elif out:
            out[-1] = (out[-1][0], f"{out[-1][1]}\n{' '.join(row)}".strip())
    return [(q.strip(), a.strip()) for q, a in out if q.strip() and a.strip()]


def _fields(lines: list[str]) -> str:
    """The separator of delimited lines: the one that more lines have exactly once, a tab where they tie."""
    tabs, commas = (sum(line.count(mark) == 1 for line in lines) for mark in ("\t", ","))
    return "\t" if tabs >= commas else ","


def _records(text: str, kind: str) -> Iterator[tuple[list[str], str]]:
    """(fields, the lines they came from) of a text of lines, or of quoted records that may go over lines (kind csv)."""
    lines = text.split("\n")
    if kind != "csv":
        mark = _fields(lines)
        yield from ((line.split(mark), line) for line in lines)
        return
    reader = csv.reader((line + "\n" for line in lines), delimiter="\t" if "\t" in text else ",")
    done = 0
    for row in reader:
        yield row, "\n".join(lines[done : reader.line_num])
        done = reader.line_num


def question_answers(text: str, kind: str = "txt") -> list[tuple[str, str]]:
    """Pairs of records of two fields; other lines go on with the answer before them. A question that is followed by another
    one needs an answer to count, the last one doesn't; lines before the first question fall out."""
    out: list[tuple[str, str]] = []
    question, answer = "", ""
    for row, raw in _records(text, kind):
        if len(row) == 2:
            if question and answer:
                out.append((question, answer))
            question, answer = row
        elif question:
            answer += "\n" + raw
    return [*out, (question, answer)] if question else out


def heading_answers(text: str) -> list[tuple[str, str]]:
    """Pairs of a Markdown text: the headings above a passage, one a line, and the passage. Fenced lines are no headings."""
    out: list[tuple[str, str]] = []
    above: list[tuple[int, str]] = []
    body, fenced = "", False
    for line in [*text.split("\n"), None]:
        mark = None
        if line is not None:
            fenced ^= line.strip().startswith("```")
            mark = None if fenced else re.match(r"(#{1,6})\s*(.*)", line)
        if line is not None and mark is None:
            body += "\n" + line
            continue
        if body.strip() and above:
            out.append(("\n".join(t for _, t in above), body.strip("\n")))
        if body.strip():
            body = ""
        if mark is not None:
            above = [(n, t) for n, t in above if n < len(mark.group(1))] + [(len(mark.group(1)), mark.group(2).strip())]
    return out


def tagged_passages(text: str, kind: str = "txt") -> list[tuple[str, str]]:
    """(passage, tags): lines up to and with a record of two fields are one passage, the second field its tags; lines after the last
    such record fall out."""
    out: list[tuple[str, str]] = []
    passage = ""
    for row, raw in _records(text, kind):
        if kind == "csv":
            row = [x.strip() for x in row if x.strip()]
        passage += "\n" + (row[0] if len(row) == 2 else raw)
        if len(row) == 2:
            out.append((passage, row[1]))
            passage = ""
    return out


def pair_column(df: DataFrame, key: str, text: str, pairs: Callable[[str], list[tuple[str, str]]], names: tuple[str, str]) -> DataFrame:
    """(key, place, …): the pairs of every text in columns of these names; null and empty texts give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, i, *p) for k, t in zip(batch["key"], batch["text"], strict=True) if t for i, p in enumerate(pairs(t))]
            yield pd.DataFrame(rows, columns=["key", "place", *names])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, f"key {kind}, place int, {names[0]} string, {names[1]} string").withColumnRenamed("key", key)


#: Ways a column of a table is used: in the chunk's text, as a typed value beside it, or both.
ROLES = ("vectorize", "indexing", "metadata", "both")


def row_chunks(rows: DataFrame, columns: dict[str, str], keys: list[str]) -> DataFrame:
    """(keys…, chunk, metadata): a row of a table as a text of its vectorize, indexing and both columns, one "- name: value" a line, and a
    map of its metadata and both columns; nulls and blanks are left out of both."""
    unknown = set(columns.values()) - set(ROLES)
    if unknown:
        raise ValueError(f"not a role: {sorted(unknown)}")
    cell = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    shown = [F.concat(F.lit(f"- {c}: "), cell(c)) for c, role in columns.items() if role != "metadata"]
    kept = [F.struct(F.lit(c).alias("key"), cell(c).alias("value")) for c, role in columns.items() if role in ("metadata", "both")]
    meta = F.map_from_entries(F.filter(F.array(*kept), lambda x: x["value"].isNotNull())) if kept else F.create_map().cast("map<string,string>")
    return rows.select(*keys, F.concat_ws("\n", *shown).alias("chunk"), meta.alias("metadata"))


def task_ranges(df: DataFrame, keys: list[str], length: str, size: Column) -> DataFrame:
    """(keys…, from_page, to_page): the tasks of documents of so many pages or rows, ``size`` each; none for a document without length."""
    last = F.col(length).cast("bigint")
    starts = df.where(last > 0).select(*keys, last.alias("_n"), size.cast("bigint").alias("_size")).select(*keys, "_n", "_size", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1, F.col("_size"))).alias("from_page"))
    return starts.select(*keys, "from_page", F.least(F.col("from_page") + F.col("_size"), F.col("_n")).alias("to_page"))


def reuse(tasks: DataFrame, before: DataFrame, keys: list[str]) -> DataFrame:
    """tasks with chunk_ids and progress: those of an earlier task of the same keys, from_page and digest that is done and has chunks (of
    several the first by chunk_ids), else null and 0."""
    done = before.where("progress >= 1 and chunk_ids is not null and chunk_ids <> ''").groupBy(*keys, "from_page", "digest").agg(F.min("chunk_ids").alias("chunk_ids"))
    return tasks.join(done, [*keys, "from_page", "digest"], "left").withColumn("progress", F.col("chunk_ids").isNotNull().cast("double"))


def chunk_column(df: DataFrame, key: str, text: str, chunker: Callable[[str], list[str]]) -> DataFrame:
    """(key, place, chunk): the chunks of every text; null and empty texts give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, i, c) for k, t in zip(batch["key"], batch["text"], strict=True) if t for i, c in enumerate(chunker(t))]
            yield pd.DataFrame(rows, columns=["key", "place", "chunk"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, f"key {kind}, place int, chunk string").withColumnRenamed("key", key)


def session_blocks(df: DataFrame, document: str, order: str, group: str, text: str) -> DataFrame:
    """(document, block, text): consecutive rows of one group value joined in order."""
    w = W.partitionBy(document).orderBy(order)
    starts = F.coalesce((~F.col(group).eqNullSafe(F.lag(group).over(w))).cast("int"), F.lit(1))
    numbered = df.withColumn("block", F.sum(starts).over(w.rowsBetween(W.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return numbered.groupBy(document, "block").agg(F.array_join(F.transform(parts, lambda p: p["t"]), "\n").alias("text"))


def column_types(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, kind): text, datetime, float, int or bool by vote, ties to the earlier of these; one pass for all columns."""
    number = r"^[+-]?\d+$"

    def kind(c):
        v = F.trim(c)
        zero = v.rlike(r"^[+-]?0\d")
        return (
            F.when(v.isNull() | (v == ""), None)
            .when(F.lower(v).isin("true", "false", "yes", "no", "是", "否", "✓", "✗"), "bool")
            .when(v.rlike(number) & ~zero & v.try_cast("bigint").isNotNull(), "int")
            .when(v.rlike(r"^[+-]?(\d+\.\d*|\.\d+|\d+)([eE][+-]?\d+)?$") & ~zero, "float")
            .when(v.rlike(r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?)?$"), "datetime")
            .otherwise("text")
        )

    pairs = F.array(*(F.struct(F.lit(c).alias("column"), kind(F.col(c).cast("string")).alias("kind")) for c in columns))
    votes = rows.select(F.inline(pairs)).groupBy("column").agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("text", "datetime", "float", "int", "bool")))
    most = F.greatest("text", "datetime", "float", "int", "bool")
    pick = F.lit("text")
    for k in ("bool", "int", "float", "datetime", "text"):
        pick = F.when((F.col(k) == most) & (most > 0), k).otherwise(pick)
    return votes.select("column", pick.alias("kind"))
