"""Byte-level BPE ids of whole texts with a public vocabulary.

A text falls into words by the vocabulary's pattern. The bytes of a word are held as part boundaries beside a
contiguous array with the rank of each adjacent pair of parts: the minimum is found by a scan, its right boundary is
deleted and the ranks on both sides are refreshed, until no pair has a rank. Long words (of more than ``SHORT`` bytes)
keep the same pairs in a heap, so that their cost stays n log n; the ids are the same. A word that comes again is
looked up.

Cases: null and empty texts have the empty list. Strings that look like control tokens are ordinary text. Every row
gives a row, repeated ones too; extra columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the word pattern published with this family of vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SHORT = 96
#: Words remembered by one Python worker; beyond it the memory is emptied, results stay the same.
REMEMBERED = 400_000
_NONE = 1 << 60


def read_ranks(data: bytes) -> dict[bytes, int]:
    """The ranks of a .tiktoken file: base64 of the bytes, a blank, the rank."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks, self.words, self.known = ranks, regex.compile(pattern).findall, {}

    def word(self, piece: bytes) -> list[int]:
        """The ids of one word."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        return self._scan(piece) if len(piece) <= SHORT else self._heap(piece)

    def _scan(self, piece: bytes) -> list[int]:
        rank = self.ranks.get
        bounds = list(range(len(piece) + 1))
        pair = [rank(piece[i : i + 2], _NONE) for i in range(len(piece) - 1)]
        while pair:
            least = min(pair)
            if least == _NONE:
                break
            i = pair.index(least)
            del bounds[i + 1], pair[i]
            if i < len(pair):
                pair[i] = rank(piece[bounds[i] : bounds[i + 2]], _NONE)
            if i:
                pair[i - 1] = rank(piece[bounds[i - 1] : bounds[i + 1]], _NONE)
        return [self.ranks[piece[a:b]] for a, b in zip(bounds, bounds[1:], strict=False)]

    def _heap(self, piece: bytes) -> list[int]:
        n, rank = len(piece), self.ranks.get
        after, before = list(range(1, n + 2)), list(range(-1, n))
        alive = bytearray(b"\1" * n)
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapq.heapify(heap)

        def push(i: int) -> None:
            if i >= 0 and after[i] < n and (r := rank(piece[i : after[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, after[after[i]]))

        while heap:
            _, i, end = heapq.heappop(heap)
            if not alive[i] or after[i] >= n or after[after[i]] != end:
                continue
            j = after[i]
            alive[j] = 0
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            push(i)
            push(before[i])
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        known, extend = self.known, out.extend
        for w in self.words(text):
            ids = known.get(w)
            if ids is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                known[w] = ids = self.word(w.encode("utf-8", "replace"))
            extend(ids)
        return out


def _texts(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).alias("key"), F.col(text).alias("text"))


def encode_column(df: DataFrame, key: str, text: str, vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS, counts_only: bool = False) -> DataFrame:
    """(key, ids) for each row, or (key, tokens) with the number of ids.

    The vocabulary file (under 1 MB) is read once by the driver and broadcast.
    """
    data = df.sparkSession.sparkContext.broadcast((Path(folder) / f"{vocabulary}.tiktoken").read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(read_ranks(data.value))
        for batch in batches:
            ids, ends = array("i"), np.zeros(batch.num_rows + 1, np.int32)
            for i, t in enumerate(batch.column("text").to_pylist()):
                if t:
                    ids.extend(encoder.encode(t))
                ends[i + 1] = len(ids)
            if counts_only:
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(np.diff(ends).astype(np.int64))], names=["key", "tokens"])
            else:
                values = pa.array(np.frombuffer(ids, np.int32) if len(ids) else np.empty(0, np.int32))
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.ListArray.from_arrays(pa.array(ends), values)], names=["key", "ids"])

    kind = df.schema[key].dataType.simpleString()
    out = _texts(df, key, text).mapInArrow(run, f"key {kind}, " + ("tokens bigint" if counts_only else "ids array<int>"))
    return out.withColumnRenamed("key", key)
