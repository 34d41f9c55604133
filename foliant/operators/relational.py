"""Relational operators around a document corpus: upserts, latest rows, facets, counters, trees, diffs, paging."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.operators.ranking import row_numbers
from foliant.session import cut


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row for each key, the greatest by the order columns: a map-side aggregation, no window over hot keys.

    Null orders come first (oldest); rows that tie on all of them are told apart by their other columns that can be ordered.
    """
    rest = [c for c in df.columns if c not in keys]
    comparable = [c for c in rest if c not in order and not df.schema[c].dataType.typeName() in ("map", "variant")]
    rank = F.struct(*order, *comparable)
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_row"))
    return picked.select(*keys, "_row.*").select(*df.columns)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], preserve: Sequence[str] = ()) -> DataFrame:
    """new over old by key; ``preserve`` columns keep their old value where there is one."""
    if preserve:
        before = old.select(*(F.col(k).alias(f"_{k}") for k in keys), *(F.col(c).alias(f"_{c}") for c in preserve))
        same = [new[k] == before[f"_{k}"] for k in keys]
        kept = {c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in preserve}
        new = new.join(before, same, "left").withColumns(kept).select(*new.columns)
    return new.unionByName(old.join(new.select(*keys), list(keys), "left_anti").select(*old.columns))


def keyset_page(df: DataFrame, key: str, cursor, size: int) -> DataFrame:
    """Rows after the cursor, ``size`` of them, with next_cursor on each row (null on the last page)."""
    rows = df if cursor is None else df.where(F.col(key) > cursor)
    page = rows.orderBy(key).limit(size + 1).withColumn("_rn", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(key)))
    seen = page.withColumn("next_cursor", F.when(F.count(F.lit(1)).over(W.partitionBy(F.lit(0))) > size, F.max(F.when(F.col("_rn") == size, F.col(key))).over(W.partitionBy(F.lit(0)))))
    return seen.where(F.col("_rn") <= size).drop("_rn")


def page(df: DataFrame, order: Sequence[Column], number: int | None, size: int | None) -> DataFrame:
    """Page ``number`` from 1; a missing or bad number is 1, a missing or bad size 30, at most 100."""
    number = number if number and number > 0 else 1
    size = min(size, 100) if size and size > 0 else 30
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def facets(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(facet, value, n) for several columns in one pass over the rows."""
    pairs = F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns))
    return df.select(F.inline(pairs)).groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))


def status_pivot(df: DataFrame, key: str, status: str, values: Sequence[str]) -> DataFrame:
    """Counts by key and status as columns, zero where there is none; other statuses are left out."""
    counts = [F.count_if(F.col(status) == v).alias(v) for v in values]
    return df.groupBy(key).agg(*counts)


def diff(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """(path, change): add, delete, modify; rename where a deleted and an added path alone share a digest."""
    both = old.select(F.col(key).alias("o"), F.col(digest).alias("oh")).join(new.select(F.col(key).alias("n"), F.col(digest).alias("nh")), F.col("o") == F.col("n"), "full_outer")
    kind = F.when(F.col("o").isNull(), "add").when(F.col("n").isNull(), "delete").when(~F.col("oh").eqNullSafe(F.col("nh")), "modify")
    changed = both.select(F.coalesce("n", "o").alias("path"), kind.alias("change"), F.coalesce("nh", "oh").alias("digest")).where("change is not null")
    side = changed.groupBy("digest").agg(F.count_if(F.col("change") == "add").alias("adds"), F.count_if(F.col("change") == "delete").alias("deletes"), F.max(F.when(F.col("change") == "delete", F.col("path"))).alias("from"))
    renamed = (F.col("adds") == 1) & (F.col("deletes") == 1) & F.col("change").isin("add", "delete")
    out = changed.join(side, "digest", "left").withColumn("r", F.coalesce(renamed, F.lit(False)))
    return out.where(~(F.col("r") & (F.col("change") == "delete"))).select(
        "path", F.when(F.col("r"), "rename").otherwise(F.col("change")).alias("change"), F.when(F.col("r"), F.col("from")).alias("old_path")
    )


def closure(edges: DataFrame, parent: str, child: str, max_levels: int = 10_000) -> DataFrame:
    """(ancestor, descendant) of an acyclic edge table by path doubling: log(depth) joins; loops end by deduplication."""
    pairs = cut(edges.select(F.col(parent).alias("ancestor"), F.col(child).alias("descendant")).where("ancestor is not null and descendant is not null").distinct())
    size, levels = pairs.count(), 1
    while levels < max_levels:
        step = pairs.select(F.col("ancestor").alias("descendant"), F.col("descendant").alias("_last")).withColumnRenamed("descendant", "_mid")
        longer = pairs.join(step, F.col("descendant") == F.col("_mid")).select("ancestor", F.col("_last").alias("descendant"))
        pairs = cut(pairs.unionByName(longer).distinct())
        now = pairs.count()
        if now == size:
            break
        size, levels = now, levels * 2
    return pairs


def runs(df: DataFrame, partition: Sequence[str], order: str) -> DataFrame:
    """(partition…, first, last, n): runs of consecutive order values without a gap, one row each.

    A run starts where the place before is empty and ends where the next one is: two equi-joins, whatever the size of a
    partition; only starts and ends are ranked to pair them. Order values are unique within a partition, nulls left out.
    """
    places = df.select(*partition, order).where(F.col(order).isNotNull()).distinct()
    by = list(partition)

    def edge(step: int, name: str) -> DataFrame:
        others = places.withColumn(order, F.col(order) + step)
        found = places.join(others, [*by, order], "left_anti")
        return found.select(*by, F.col(order).alias(name), F.row_number().over(W.partitionBy(*by).orderBy(order)).alias("_no"))

    return edge(1, "first").join(edge(-1, "last"), [*by, "_no"]).select(*by, "first", "last", (F.col("last") - F.col("first") + 1).alias("n"))


def neighbours(seeds: DataFrame, rows: DataFrame, partition: Sequence[str], order: str, key: str, width: int, section: str | None = None) -> DataFrame:
    """(seed, key, distance): rows at most ``width`` places from a seed, up to the first gap or change of section.

    A range join made an equi-join: each seed names the places it wants. What a seed finds, 2 * width + 1 rows, decides by itself
    how far it reaches; no partition is sorted as a whole.
    """
    same_section = F.col(section) if section else F.lit(0)
    given = rows.join(seeds.select(F.col(key)).distinct(), key, "left_semi")
    wanted = given.select(F.col(key).alias("seed"), *(F.col(c).alias(f"_{c}") for c in partition), same_section.alias("_section"), F.col(order).alias("_at"), F.explode(F.sequence(F.lit(-width), F.lit(width))).alias("distance"))
    placed = rows.select(F.col(key).alias("key"), *partition, order, same_section.alias("section"))
    same = reduce(and_, [placed[c].eqNullSafe(wanted[f"_{c}"]) for c in partition]) & (placed[order] == wanted["_at"] + wanted["distance"])
    met = placed.join(wanted, same).where(F.col("section").eqNullSafe(F.col("_section")))
    around = met.groupBy("seed").agg(F.collect_list(F.struct("distance", "key")).alias("found"))
    reached = F.filter(
        "found",
        lambda x: F.forall(F.sequence(F.least(x["distance"], F.lit(0)), F.greatest(x["distance"], F.lit(0))), lambda i: F.exists("found", lambda y: y["distance"] == i)),
    )
    return around.select("seed", F.inline(reached)).select("seed", F.col("key").alias(key), "distance")


def apportion(df: DataFrame, group: Sequence[str], weight: str, key: str, total: int) -> DataFrame:
    """df with share: integers that sum to ``total`` in each group, by largest remainder (ties by key). Keys are unique in a group.

    Sums come from aggregations, the order of remainders from a sort by ranges, so a group may be of any size."""
    by = list(group)
    sums = df.groupBy(*by).agg(F.sum(weight).alias("_sum"))
    exact = F.lit(total) * F.col(weight) / F.col("_sum")
    parts = df.join(sums, by).withColumn("_floor", F.floor(exact)).withColumn("_rest", F.round(exact - F.floor(exact), 9)).drop("_sum")
    ranked = row_numbers(parts, by, [F.desc("_rest"), F.col(key)], "_rank")
    left = ranked.groupBy(*by).agg((F.lit(total) - F.sum("_floor")).alias("_left"))
    return ranked.join(left, by).withColumn("share", F.col("_floor") + (F.col("_rank") <= F.col("_left")).cast("int")).select(*df.columns, "share")
