"""Vectorised word shingling: numpy over the code points of a whole Arrow batch.

A word is a longest run of letters and digits of the lower-cased text. Every word gets a 64-bit polynomial hash
from one cumulative sum over the batch, a shingle of k consecutive words gets a mix of the k word hashes, and
the distinct shingles of each text come out of one sort. No Python loop runs over words.
"""

from __future__ import annotations

import functools

import numpy as np

_MULT = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


@functools.cache
def word_table() -> np.ndarray:
    """One flag per code point: letter (L*) or digit (Nd, Nl, No), as ``str.isalnum`` has it."""
    chars = np.arange(0x110000, dtype=np.uint32)
    out = np.zeros(0x110000, dtype=bool)
    for lo in range(0, 0x110000, 0x1000):
        if 0xD800 <= lo < 0xE000:
            continue
        out[lo : lo + 0x1000] = [chr(c).isalnum() for c in chars[lo : lo + 0x1000]]
    return out


@functools.cache
def _powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(n, dtype=np.uint64)
    have = 1
    while have < n:
        take = min(have, n - have)
        out[have : have + take] = out[:take] * np.uint64(pow(base, have, 1 << 64))
        have += take
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words_of_points(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first position) of each word of an array of code points."""
    inside = word_table()[points]
    edges = np.diff(inside.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    # positions run inside blocks so that the table of powers stays short
    size = 1 << 20
    power = _powers(size, _MULT)
    weighted = (points + np.uint32(1)).astype(np.uint64)
    for lo in range(0, len(points), size):
        part = weighted[lo : lo + size]
        part *= power[: len(part)]
        if lo:
            part *= np.uint64(pow(_MULT, lo, 1 << 64))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(weighted, dtype=np.uint64)])
    inverse = pow(_MULT, -1, 1 << 64)
    back = _powers(size, inverse)[start % size]
    jump = np.array([pow(inverse, int(b) * size, 1 << 64) for b in range(len(points) // size + 1)], dtype=np.uint64)
    return mix((total[end] - total[start]) * back * jump[start // size] + (end - start).astype(np.uint64)), start


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of its text), in reading order over all texts."""
    joined = "\n".join(t.lower().replace("\n", " ") for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if not len(points):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    hashes, start = words_of_points(points)
    return hashes, np.searchsorted(np.flatnonzero(points == 10), start)


#: Shingles are kept to 48 bits, so that a text's number within a batch fits above them in one sort key.
TOKEN_BITS = 48
TOKEN_MASK = np.uint64((1 << TOKEN_BITS) - 1)


def shingle_sets(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, offsets, words): the distinct k-word shingles of text i, ascending, are
    tokens[offsets[i]:offsets[i + 1]]; words[i] is its number of words."""
    n = len(texts)
    if n > 1 << 16:
        raise ValueError("at most 65,536 texts at once")
    words, owner = word_hashes(texts)
    counts = np.bincount(owner, minlength=n)[:n] if len(owner) else np.zeros(n, np.int64)
    if len(words) < k:
        return np.empty(0, np.uint64), np.zeros(n + 1, np.int64), counts
    m = len(words) - k + 1
    whole = owner[:m] == owner[k - 1 :]
    h = words[:m] * np.uint64(0xD6E8FEB86659FD93)
    for j in range(1, k):
        h = mix(h + words[j : j + m]) if j == k - 1 else (h + words[j : j + m]) * np.uint64(0xD6E8FEB86659FD93)
    key = (h[whole] >> np.uint64(64 - TOKEN_BITS)) | (owner[:m][whole].astype(np.uint64) << np.uint64(TOKEN_BITS))
    key.sort()
    keep = np.ones(len(key), bool)
    keep[1:] = key[1:] != key[:-1]
    key = key[keep]
    sizes = np.bincount((key >> np.uint64(TOKEN_BITS)).astype(np.int64), minlength=n)
    return key & TOKEN_MASK, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), counts
