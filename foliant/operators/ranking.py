"""Exact ranks and order statistics that no single task has to hold a whole group for.

A window over a group sorts the group in one task, however large it is. Here rows are sorted by ranges of (group, order), so a hot
group spans many tasks; only the number of rows of each group in each task is added up in order. ``TopK`` keeps the best k
of many queries while a task streams through a corpus.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.session import cut

_LOCAL = (1 << 33) - 1  # the lower bits of a monotonically increasing id count within a task


class TopK:
    """The k best (score, then smallest key) of each of several queries, fed by arrays."""

    def __init__(self, queries: int, k: int):
        self.k, self.limit = k, 4 * queries * k + 100_000
        self.least = np.full(queries, -np.inf)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, query: np.ndarray, key: np.ndarray, score: np.ndarray) -> None:
        keep = score >= self.least[query]
        if keep.any():
            self.parts.append((query[keep], key[keep], score[keep]))
            self.held += int(keep.sum())
        if self.held > self.limit:
            self.rows()

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, key, score) of what is best so far."""
        if not self.parts:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        query, key, score = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        named = np.unique(key, return_inverse=True)[1] if key.dtype == object else key
        order = np.lexsort((named, -score, query))
        query, key, score = query[order], key[order], score[order]
        first = np.searchsorted(query, query, "left")
        place = np.arange(len(query)) - first
        full = place == self.k - 1
        self.least[query[full]] = score[full]
        best = place < self.k
        query, key, score = query[best], key[best], score[best]
        self.parts, self.held = [(query, key, score)], len(query)
        return query, key, score


def _ranged(df: DataFrame, groups: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """df sorted by ranges of (groups, order), with _part, the task of a row, and _at, its place there."""
    by = [F.col(g) for g in groups] + list(order)
    spread = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id())
    return cut(spread.withColumns({"_part": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND(F.lit(_LOCAL))}).drop("_id"))


def _joined(rows: DataFrame, parts: DataFrame, groups: Sequence[str]) -> DataFrame:
    """rows beside the offsets of their group in their task; nulls are a group."""
    named = parts.select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)), F.col("_part").alias("_p"), "_first", "_before")
    same = rows["_part"] == named["_p"]
    for i, g in enumerate(groups):
        same = same & rows[g].eqNullSafe(named[f"_g{i}"])
    return rows.join(named, same).drop(*(f"_g{i}" for i in range(len(groups))), "_p")


def row_numbers(df: DataFrame, groups: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """df with the place from 1 of each row in its group; the order should tell all rows of a group apart."""
    rows = _ranged(df, groups, order)
    parts = rows.groupBy(*groups, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy(*groups).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row for each task
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    return _joined(rows, parts, groups).withColumn(name, F.col("_before") + F.col("_at") - F.col("_first") + 1).drop("_part", "_at", "_first", "_before")


def quantiles(df: DataFrame, groups: Sequence[str], value: str, shares: dict[str, float], interpolated: bool) -> DataFrame:
    """(groups…, one column for each share): exact percentiles, by nearest rank or interpolated; nulls don't count.

    Equal values are counted before anything is sorted, so a value that is everywhere is one row."""
    by = list(groups)
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    rows = _ranged(counted, by, [F.col(value)])
    parts = rows.groupBy(*by, "_part").agg(F.sum("_c").alias("_n"))
    earlier = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumns({"_before": F.coalesce(F.sum("_n").over(earlier), F.lit(0)), "_all": F.sum("_n").over(W.partitionBy(*by)), "_first": F.lit(0)})
    whole = parts.select(*(F.col(g).alias(f"_w{i}") for i, g in enumerate(by)), "_all").distinct()
    placed = _joined(rows, parts.select(*by, "_part", "_before", "_first"), by)
    running = W.partitionBy(*by, "_part").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    placed = placed.withColumn("_to", F.col("_before") + F.sum("_c").over(running)).withColumn("_from", F.col("_to") - F.col("_c"))
    same = F.lit(True)
    for i, g in enumerate(by):
        same = same & F.col(g).eqNullSafe(F.col(f"_w{i}"))
    placed = placed.join(F.broadcast(whole) if not by else whole, same).drop(*(f"_w{i}" for i in range(len(by))))
    out = []
    for name, share in shares.items():

        def at(rank: Column) -> Column:
            return F.max(F.when((F.col("_from") < rank) & (rank <= F.col("_to")), F.col(value)))

        if interpolated:
            place = (F.col("_all") - 1) * F.lit(float(share))
            low, high = at(F.floor(place) + 1), at(F.ceil(place) + 1)
            rest = F.max(place - F.floor(place))
            out.append((low + (high - low) * rest).alias(name))
        else:
            out.append(at(F.greatest(F.ceil(F.col("_all") * F.lit(float(share))), F.lit(1))).alias(name))
    return placed.groupBy(*by).agg(*out)
