"""Near-duplicate texts: all pairs whose sets of k-word shingles have a Jaccard similarity of at least t, exactly.

Texts are compared as bitmaps, tile against tile. Every shingle flips one of 64 * WORDS bits, so the exclusive-or of
two bitmaps has at most as many bits as the symmetric difference of the two sets, and their population counts differ
by no more than that. For similarity t a pair of sizes a and b may differ in (1 - t) / (1 + t) * (a + b) shingles: that
is the radius. Rows of a tile are sorted by population count; tile pairs whose counts are further apart than the
radius are skipped, the rest are compared by numpy exclusive-or and bit counts, and what is within the radius is
verified on the shingles themselves. The bound never rejects a true pair.

Comparing all tiles of the table with each other would be quadratic in the table, so tiles are formed inside blocks:
the rows that share a shingle of their prefix, the a - ceil(t a) + 1 rarest of their shingles. Two sets alike by t share
a prefix shingle whatever the common order is, so this loses nothing either. At the first shingle that both share, at
place p of a and q of b, min(a - p, b - q) bounds what they have in common; pairs of a block that fail this bound are
left to the block of an earlier shingle, or are none. The order comes from a count sketch of
all shingles (a fixed number of counters, summed over all rows, see SKETCH_BITS); a shingle whose counter is 1 occurs
once in the corpus and opens no block. A block of more than BLOCK_ROWS rows is dealt into stripes, and each pair of
stripes is a task of its own; the counters never stop, so a block gets as many stripes as its rows need. Equal texts are one row until the very end, so a group of copies costs one row for each
map task.

Cases: null, empty and short texts (under min_words) have no partners. Repeated rows of one key are one row. Texts of the
same shingles have similarity 1. Keys must not be null. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.shingles import TOKEN_BITS, shingle_sets
from foliant.operators.components import components
from foliant.session import cut

#: log2 of the counters of the sketch: 64 MB at most as sent to the workers, whatever the corpus. More counters only make
#: rare shingles easier to tell from frequent ones; results don't depend on it.
SKETCH_BITS = 26
#: 64-bit words of a bitmap.
WORDS = 2
TILE = 256
#: Rows of one block above which it is dealt into stripes.
BLOCK_ROWS = 20_000
#: Texts shingled at once (bounds memory).
AT_ONCE = 1_000
#: Rows up to which a table of 8-byte ids is broadcast for a semi-join (16 MB); above it is shuffled.
BROADCAST_IDS = 2_000_000
_SLICES = 64


def _sparse(counts: np.ndarray) -> bytes:
    """Counters of one slice as gaps between the ones in use (16 bits, wider gaps bridged by empty counters) and their values."""
    at = np.flatnonzero(counts)
    if len(at):
        gap = np.diff(at, prepend=-1)
        steps = (gap - 1) // 0xFFFF
        if steps.any():
            fill = np.repeat(at - gap, steps) + 0xFFFF * (np.arange(steps.sum()) - np.repeat(np.cumsum(steps) - steps, steps) + 1)
            at = np.sort(np.concatenate([at, fill]))
            gap = np.diff(at, prepend=-1)
        return gap.astype(np.uint16).tobytes() + counts[at].tobytes()
    return b""


def _dense(data: bytes, size: int) -> np.ndarray:
    n = len(data) // 3
    out = np.zeros(size, np.uint8)
    out[np.cumsum(np.frombuffer(data, np.uint16, n).astype(np.int64)) - 1] = np.frombuffer(data, np.uint8, n, 2 * n)
    return out


@dataclass(frozen=True)
class Sketch:
    """Counters by slice, sparse as they travel (or plain behind a zero byte, where that is shorter)."""

    size: int
    parts: list[bytes]

    def dense(self) -> np.ndarray:
        n = self.size // len(self.parts)
        out = np.empty((len(self.parts), n), np.uint8)
        for i, part in enumerate(self.parts):
            out[i] = np.frombuffer(part, np.uint8, n, 1) if len(part) == n + 1 else _dense(part, n)
        return out.reshape(-1)


def _summed(pairs: np.ndarray) -> np.ndarray:
    """(place, number) rows in order of place, one for each."""
    at, back = np.unique(pairs[:, 0], return_inverse=True)
    return np.stack([at, np.bincount(back, weights=pairs[:, 1], minlength=len(at)).astype(np.int64)], axis=1)


def _sketch(texts: DataFrame, k: int, min_words: int, bits: int) -> Sketch:
    """Counter of each shingle bucket as 8 * log2(count), one byte; every row of the corpus is counted.

    A task counts in bytes; what goes over is carried in a list beside them, of one entry at most for 256 shingles.
    """
    size = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, over = np.zeros(size, np.uint8), np.empty((0, 2), np.int64)
        for batch in batches:
            column = batch.column("text").to_pylist()
            for lo in range(0, len(column), AT_ONCE):
                tokens, offsets, words = shingle_sets(column[lo : lo + AT_ONCE], k)
                keep = np.repeat(words >= min_words, np.diff(offsets))
                bucket = np.sort((tokens[keep] & np.uint64(size - 1)).astype(np.uint32))
                first = np.flatnonzero(np.concatenate([[len(bucket) > 0], bucket[1:] != bucket[:-1]])) if len(bucket) else np.empty(0, np.int64)
                at, times = bucket[first], np.diff(np.append(first, len(bucket)))
                now = total[at] + times
                total[at] = (now & 255).astype(np.uint8)
                more = now > 255
                if more.any():
                    over = _summed(np.concatenate([over, np.stack([at[more], now[more] >> 8], axis=1)]))
        parts = [_sparse(p) for p in total.reshape(_SLICES, -1)]
        edges = np.searchsorted(over[:, 0], np.arange(_SLICES + 1) * (size // _SLICES))
        carries = [over[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(_SLICES), pa.int32()), pa.array(parts, pa.binary()), pa.array(carries, pa.binary())], names=["slice", "counts", "carries"])

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(size // _SLICES, np.int64)
        for part in rows["counts"]:
            total += _dense(part, size // _SLICES)
        for part in rows["carries"]:
            at, times = np.frombuffer(part, np.int64).reshape(-1, 2).T
            total[at % (size // _SLICES)] += times << 8
        coded = np.rint(8 * np.log2(np.maximum(total, 1))).astype(np.uint8)
        sparse = _sparse(coded)
        return pd.DataFrame({"slice": [key[0]], "counts": [sparse if len(sparse) < len(coded) else b"\0" + coded.tobytes()]})

    rows = texts.mapInArrow(count, "slice int, counts binary, carries binary").groupBy("slice").applyInPandas(add, "slice int, counts binary").collect()
    parts = [b""] * _SLICES
    for row in rows:
        parts[row["slice"]] = bytes(row["counts"])
    return Sketch(size, parts)


def _bitmaps(tokens: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, WORDS): bit (token mod 64 * WORDS) is flipped by each shingle."""
    n, width = len(offsets) - 1, 64 * WORDS
    of = np.repeat(np.arange(n), np.diff(offsets))
    bit = ((tokens >> np.uint64(TOKEN_BITS - 16)) % np.uint64(width)).astype(np.int64)
    odd = np.bincount(of * width + bit, minlength=n * width).reshape(n, WORDS, 64) & 1
    return (odd.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=2, dtype=np.uint64)


def _post(texts: DataFrame, sketch: Sketch, k: int, t: float, min_words: int) -> DataFrame:
    """(block, stripes, own, sig, size, bits): each text once for every prefix shingle that another text may have."""
    sent = texts.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, seen = sent.value.dense(), np.empty(0, np.int64)
        mask = np.uint64(len(codes) - 1)
        for batch in batches:
            texts_, sigs_ = batch.column("text").to_pylist(), batch.column("sig").to_numpy()
            for lo in range(0, len(texts_), AT_ONCE):
                sigs = sigs_[lo : lo + AT_ONCE]
                tokens, offsets, words = shingle_sets(texts_[lo : lo + AT_ONCE], k)
                sizes = np.diff(offsets)
                fresh = np.zeros(len(sigs), bool)
                fresh[np.unique(sigs, return_index=True)[1]] = True
                fresh &= ~np.isin(sigs, seen)
                wanted = fresh & (words >= min_words) & (sizes > 0)
                if not wanted.any():
                    continue
                seen = np.union1d(seen[-4_000_000:], sigs[wanted])
                code = codes[(tokens & mask).astype(np.int64)]
                of = np.repeat(np.arange(len(sigs)), sizes)
                # rarest first within each text; equal counts by the shingle itself
                order = np.lexsort((tokens, code, of))
                place = np.arange(len(order)) - np.repeat(offsets[:-1], sizes)
                prefix = sizes - np.ceil(t * sizes - 1e-9).astype(np.int64) + 1
                take = (place < np.repeat(prefix, sizes)) & (code[order] > 0) & wanted[of[order]]
                use, at = order[take], place[take]
                if not len(use):
                    continue
                bits = _bitmaps(tokens, offsets)
                stripes = np.ceil(2 ** (code[use] / 8.0) / BLOCK_ROWS).astype(np.int64)
                rows = np.repeat(np.arange(len(use)), stripes)
                other = np.arange(len(rows)) - np.repeat(np.cumsum(stripes) - stripes, stripes)
                item = use[rows]
                text_no, n_stripes = of[item], stripes[rows]
                own = (sigs[text_no].astype(np.uint64) % n_stripes.astype(np.uint64)).astype(np.int64)
                low, high = np.minimum(own, other), np.maximum(own, other)
                block = tokens[item].astype(np.int64) ^ ((low * n_stripes + high) << np.int64(TOKEN_BITS))
                columns = [block, (own == low).astype(np.int8) | ((own == high).astype(np.int8) << 1), sigs[text_no], sizes[text_no].astype(np.int32), at[rows].astype(np.int32), *bits[text_no].T.view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["block", "side", "sig", "size", "place", *(f"b{i}" for i in range(WORDS))])

    schema = "block bigint, side tinyint, sig bigint, size int, place int, " + ", ".join(f"b{i} bigint" for i in range(WORDS))
    return texts.mapInArrow(run, schema)


def _within(size_a: np.ndarray, size_b: np.ndarray, left_a: np.ndarray, left_b: np.ndarray, differ: np.ndarray, t: float) -> np.ndarray:
    """Whether bitmaps that differ in so many bits, of sets of these sizes with so many shingles from the shared one on,
    may belong to a pair alike by t whose first shared shingle this is."""
    total = size_a + size_b
    return (differ <= (1 - t) / (1 + t) * total + 1e-9) & (np.minimum(left_a, left_b) >= t / (1 + t) * total - 1e-9)


def _tiles(sig: np.ndarray, side: np.ndarray, size: np.ndarray, left: np.ndarray, bits: np.ndarray, t: float) -> list[np.ndarray]:
    """Candidate pairs of one block by tiles: rows in order of population count, tile pairs out of reach skipped."""
    weight = np.bitwise_count(bits).sum(axis=1).astype(np.int64)
    order = np.argsort(weight, kind="stable")
    sig, side, size, left, bits, weight = sig[order], side[order], size[order], left[order], bits[order], weight[order]
    starts = range(0, len(sig), TILE)
    largest = [size[s : s + TILE].max() for s in starts]
    out = []
    for i, a in enumerate(starts):
        for j in range(i, len(starts)):
            b = starts[j]
            radius = (1 - t) / (1 + t) * (int(largest[i]) + int(largest[j]))
            if weight[b] - weight[min(a + TILE, len(sig)) - 1] > radius + 1e-9:
                continue
            rows, cols = slice(a, a + TILE), slice(b, b + TILE)
            differ = np.bitwise_count(bits[rows, None, :] ^ bits[None, cols, :]).sum(axis=2)
            ok = _within(size[rows, None], size[None, cols], left[rows, None], left[None, cols], differ, t) & (sig[rows, None] != sig[None, cols]) & ((side[rows, None] | side[None, cols]) == 3)
            if i == j:
                ok &= np.tri(*ok.shape, dtype=bool).T
            x, y = np.nonzero(ok)
            if len(x):
                out.append(np.stack([sig[rows][x], sig[cols][y]], axis=1))
    return out


def _compare(posted: DataFrame, t: float) -> DataFrame:
    """(a, b), a < b: pairs of one block within the radius. Rows come sorted by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def flush(cols: list[np.ndarray]) -> pa.RecordBatch | None:
            block, side, sig, size, place, *words = cols
            left = size - place
            bits = np.stack([w.view(np.uint64) for w in words], axis=1)
            edge = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]]))
            length = np.diff(edge)
            found = []
            for s, n in zip(edge[:-1][length > TILE // 4], length[length > TILE // 4], strict=True):
                part = slice(s, s + n)
                found += _tiles(sig[part], side[part], size[part], left[part], bits[part], t)
            # small blocks: tiles of one row in order of population count, each against the one d places further on, for all
            # blocks at once; rows whose counts differ beyond the radius are skipped
            weight = np.bitwise_count(bits).sum(axis=1).astype(np.int64)
            small = np.flatnonzero(np.repeat(length <= TILE // 4, length))
            small = small[np.lexsort((weight[small], block[small]))]
            place = np.arange(len(small))
            for d in range(1, TILE // 4):
                place = place[place + d < len(small)]
                at, to = small[place], small[place + d]
                same = block[at] == block[to]
                place, at, to = place[same], at[same], to[same]
                if not len(at):
                    break
                near = weight[to] - weight[at] <= (1 - t) / (1 + t) * (size[at] + size[to]) + 1e-9
                at, to = at[near], to[near]
                differ = np.bitwise_count(bits[at] ^ bits[to]).sum(axis=1)
                ok = _within(size[at], size[to], left[at], left[to], differ, t) & (sig[at] != sig[to]) & ((side[at] | side[to]) == 3)
                found.append(np.stack([sig[at[ok]], sig[to[ok]]], axis=1))
            if not found:
                return None
            pairs = np.concatenate(found)
            pairs = np.unique(np.sort(pairs, axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

        for batch in batches:
            cols = [c.to_numpy() for c in batch.columns]
            if held is not None:
                cols = [np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)]
            block = cols[0]
            if not len(block):
                continue
            # the last block may go on in the next batch
            last = np.searchsorted(block, block[-1], "left") if block[0] <= block[-1] else 0
            held = [c[last:] for c in cols]
            if last and (out := flush([c[:last] for c in cols])) is not None:
                yield out
        if held is not None and (out := flush(held)) is not None:
            yield out

    by_block = posted.repartition("block").sortWithinPartitions("block")
    return by_block.mapInArrow(run, "a bigint, b bigint").distinct()


def _verify(pairs: DataFrame, k: int, t: float, min_words: int) -> DataFrame:
    """(a, b, similarity) of pairs with their texts x and y, those below t left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(lo, AT_ONCE)
                number: dict[str, int] = {}
                x, y = (np.array([number.setdefault(text, len(number)) for text in batch.column(c).to_pylist()], np.int64) for c in ("x", "y"))
                tokens, offsets, words = shingle_sets(list(number), k)
                sizes = np.diff(offsets)
                keys = []
                for side in (x, y):
                    n = sizes[side]
                    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(offsets[side], n)
                    keys.append(tokens[at] | (np.repeat(np.arange(len(side)), n).astype(np.uint64) << np.uint64(TOKEN_BITS)))
                both = np.sort(np.concatenate(keys))
                twice = both[1:][both[1:] == both[:-1]]
                common = np.bincount((twice >> np.uint64(TOKEN_BITS)).astype(np.int64), minlength=len(x))
                union = sizes[x] + sizes[y] - common
                ok = (common >= t * union - 1e-9) & (union > 0) & (words[x] >= min_words) & (words[y] >= min_words)
                similarity = common[ok] / union[ok]
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(ok)), batch.column("b").filter(pa.array(ok)), pa.array(similarity)], names=["a", "b", "similarity"])

    return pairs.mapInArrow(run, "a bigint, b bigint, similarity double")


def _only(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of df whose sig is among ids (8 bytes each): broadcast up to a checked number, shuffled above it."""
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "sig", "left_semi")


def _hash(text: str, salt: int) -> Column:
    return F.xxhash64(F.lit(salt), text)


def _signed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, text, sig) with another signature for every different text, and (a, b) with a = b for texts of several keys.

    Two texts of one 64-bit hash (some n * n / 2**65 of n texts) show by a second hash; theirs, few as they are, are then
    told apart by that one."""
    sig, salt = _hash("text", 0), 0
    while True:
        salt += 1
        signed = rows.withColumns({"sig": sig, "_other": _hash("text", salt)})
        by_sig = signed.groupBy("sig").agg(F.min("key").alias("one"), F.max("key").alias("two"), (F.min("_other") < F.max("_other")).alias("clash"))
        by_sig = cut(by_sig.where("one < two or clash"))
        clashes = [r["sig"] for r in by_sig.where("clash").select("sig").collect()]
        if not clashes:
            return signed.drop("_other"), by_sig.select(F.col("sig").alias("a"), F.col("sig").alias("b"))
        sig = F.when(sig.isin(clashes), _hash("text", salt)).otherwise(sig)


def similar_texts(df: DataFrame, key: str, text: str, k: int = 5, t: float = 0.8, min_words: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(links, members): links (a, b, similarity), a <= b, between different texts by their signature, and (a, a, 1) for
    a text under several keys; members (key, sig) of all texts in links."""
    least = k if min_words is None else min_words
    rows, copies = _signed(df.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("text").isNotNull() & (F.length("text") >= 2 * least - 1)))
    sketch = _sketch(rows.select("text"), k, least, SKETCH_BITS)
    pairs = _compare(_post(rows.select("text", "sig"), sketch, k, t, least), t)
    pairs = cut(pairs.unionByName(copies))
    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct())
    # texts move, not their shingles: they take half the bytes
    kept = _only(rows, ids).groupBy("sig").agg(F.first("text").alias("text"))
    x = kept.select(F.col("sig").alias("a"), F.col("text").alias("x"))
    y = kept.select(F.col("sig").alias("b"), F.col("text").alias("y"))
    links = cut(_verify(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y"), k, t, least))
    linked = cut(links.select(F.explode(F.array("a", "b")).alias("sig")).distinct())
    return links, cut(_only(rows, linked).select("key", "sig").distinct())


def similar_pairs(df: DataFrame, key: str, text: str, k: int = 5, t: float = 0.8, min_words: int | None = None) -> DataFrame:
    """(a, b, similarity), a < b: every pair of different keys alike by t, copies included."""
    links, members = similar_texts(df, key, text, k, t, min_words)
    left = members.select(F.col("sig").alias("a"), F.col("key").alias("key_a"))
    right = members.select(F.col("sig").alias("b"), F.col("key").alias("key_b"))
    found = links.join(left, "a").join(right, "b").where((F.col("key_a") < F.col("key_b")) | ((F.col("a") != F.col("b")) & (F.col("key_a") > F.col("key_b"))))
    return found.select(F.least("key_a", "key_b").alias("a"), F.greatest("key_a", "key_b").alias("b"), "similarity")


def groups(df: DataFrame, key: str, text: str, k: int = 5, t: float = 0.8, min_words: int | None = None) -> DataFrame:
    """(key, group_id, links): every key of the table once, with the smallest key of its group and the number of
    different texts that its own is alike to."""
    links, members = similar_texts(df, key, text, k, t, min_words)
    classes = components(links, "a", "b")
    apart = links.where("a < b").select(F.explode(F.array("a", "b")).alias("sig")).groupBy("sig").agg(F.count(F.lit(1)).alias("links"))
    named = members.join(classes, members["sig"] == classes["node"]).join(apart, "sig", "left")
    first = named.groupBy("component").agg(F.min("key").alias("group_id"))
    grouped = named.join(first, "component").groupBy("key").agg(F.min("group_id").alias("group_id"), F.max(F.coalesce("links", F.lit(0))).alias("links"))
    every = df.select(F.col(key).alias("key")).distinct()
    out = every.join(grouped, "key", "left").select("key", F.coalesce("group_id", "key").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
    return out.withColumnRenamed("key", key)
