"""Applying a feed of inserts, updates, deletes and moves to a table of current state.

Newest first: the feed is cut into batches along its order and the batches are walked backwards. A batch keeps of
each key its newest image or tombstone, drops keys that a newer batch has resolved already (anti-join), and adds the
rest to the resolved keys. At the end the tombstones fall out and rows of the base table whose key nobody touched
are appended. A batch never looks at what older batches hold, so each change is shuffled once, reduced by key on the
map side; a key that a third of all changes touch costs one row for each map task.

Cases: a change that is delivered repeatedly counts once, whatever its order of arrival. Changes without an order or
source column value sort oldest (null first). A row whose path has no key (null or blank) writes nothing; its old
path, if any, is still removed. Unknown kinds change nothing. Extra columns are ignored. An empty feed returns the
base, an empty base the images alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.paths import path_key
from foliant.session import cut

WRITES = ("create", "upsert", "move")


def touches(changes: DataFrame) -> DataFrame:
    """(source_id, path_key, epoch, generation, live): one row for each key a change writes (live) or removes."""
    kind = F.lower(F.trim(F.col("kind")))
    base = changes.select(
        "source_id", "epoch", "generation", kind.alias("kind"), "path", F.when(kind == "move", F.col("old_path")).alias("old_path")
    ).where(kind.isin(*WRITES, "delete"))
    keyed = base.select("source_id", "epoch", "generation", "kind", path_key("path").alias("new"), path_key("old_path").alias("old"))
    touched = F.array(
        F.struct(F.col("new").alias("path_key"), F.col("kind").isin(*WRITES).alias("live")),
        F.struct(F.when(~F.col("old").eqNullSafe(F.col("new")), F.col("old")).alias("path_key"), F.lit(False).alias("live")),
    )
    rows = keyed.select("source_id", "epoch", "generation", F.inline(touched))
    return rows.where(F.col("path_key").isNotNull())


def _borders(rows: DataFrame, order: Sequence[str], shares: list[float]) -> list[tuple[float, ...]]:
    """Values of the order columns below which about these shares of the rows lie; equal first values are told apart by the next column."""
    if not shares:
        return []
    first, rest = order[0], order[1:]
    values = rows.select(F.col(first).cast("double").alias(first), *rest)
    found = values.approxQuantile(first, shares, 0.01)
    if not rest:
        return [(v,) for v in sorted(set(found))]
    out: list[tuple[float, ...]] = []
    for value in sorted(set(found)):
        sizes = values.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(first).isNull() | (F.col(first) < value)).alias("below"), F.count_if(F.col(first) == value).alias("at")).first()
        inner = [(share * sizes["n"] - sizes["below"]) / max(sizes["at"], 1) for share, v in zip(shares, found, strict=True) if v == value]
        out += [(value, *border) for border in _borders(values.where(F.col(first) == value).select(*rest), rest, [min(max(x, 0.0), 1.0) for x in inner])]
    return out


def _above(position: list[Column], border: tuple[float, ...]) -> Column:
    """Whether a place in the order is beyond a border."""
    out = F.lit(False)
    for at, value in reversed(list(zip(position, border, strict=True))):
        out = (at > value) | ((at == value) & out)
    return out


def resolve_newest_first(touched: DataFrame, keys: Sequence[str], order: Sequence[str], batches: int = 3) -> DataFrame:
    """The newest row of every key: columns keys, order and live.

    ``batches`` bounds the number of batches; their borders are quantiles along all order columns, so that a row in
    a later batch is newer than every row of its key in an earlier one, and a feed of one epoch still has its batches.
    """
    borders = sorted(set(_borders(touched.select(*order), order, [i / batches for i in range(1, batches)])), reverse=True)
    newest: Column = F.max(F.struct(*order, "live")).alias("_newest")

    def images(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys).agg(newest).select(*keys, "_newest.*")

    position = [F.coalesce(F.col(c).cast("double"), F.lit(float("-inf"))) for c in order]
    resolved: DataFrame | None = None
    above: tuple[float, ...] | None = None
    for border in [*borders, None]:
        inside = F.lit(True) if border is None else _above(position, border)
        if above is not None:
            inside = inside & ~_above(position, above)
        batch = images(touched.where(inside))
        if resolved is None:
            resolved = batch
        else:
            known = resolved.select(*(F.col(k).alias(f"_{k}") for k in keys))
            same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
            resolved = resolved.unionByName(batch.join(known, on=same, how="left_anti"))
        if border is not None:
            resolved = cut(resolved)
        above = border
    return resolved


def apply_changes(changes: DataFrame, base: DataFrame | None = None, batches: int = 3) -> DataFrame:
    """(source_id, path_key, epoch, generation): the paths present after all changes.

    ``base``, if given, holds the same columns of the state before; its rows survive where no change touched the key.
    Changes with the same source, epoch and generation are one change.
    """
    keys, order = ["source_id", "path_key"], ["epoch", "generation"]
    touched = cut(touches(changes))  # paths are folded once, not once for each batch
    resolved = resolve_newest_first(touched, keys, order, batches)
    present = resolved.where("live").select(*keys, *order)
    if base is None:
        return present
    same = [base[k].eqNullSafe(resolved[k]) for k in keys]
    return present.unionByName(base.join(resolved.select(*keys), on=same, how="left_anti").select(*keys, *order))
