from __future__ import annotations

import random

import pytest

from foliant.functions.paths import fold_path
from foliant.operators.changes import apply_changes

SCHEMA = "source_id string, path string, path_key string, kind string, old_path string, epoch bigint, generation bigint, live string"


def replay(rows):
    """The plain way: one change after the other, oldest first."""
    state = {}
    for source, path, _, kind, old, epoch, generation, _ in sorted({(*r,) for r in rows}, key=lambda r: (r[5] is not None, r[5] or 0, r[6] is not None, r[6] or 0)):
        kind = (kind or "").strip().lower()
        key, before = fold_path(path), fold_path(old)
        if kind == "move" and before and before != key:
            state.pop((source, before), None)
        if kind in ("create", "upsert", "move") and key:
            state[source, key] = (epoch, generation)
        elif kind == "delete":
            state.pop((source, key), None)
    return {(*k, *v) for k, v in state.items()}


@pytest.mark.parametrize("batches", [1, 3, 7])
def test_against_replay(spark, batches):
    rng = random.Random(batches)
    names = ["Straße/A", "b\\C ", "é", "é", "x", None, " "]
    rows = []
    for i in range(300):
        kind = rng.choice(["create", " Upsert", "MOVE", "delete", "dirty", None, "other"])
        rows.append((rng.choice(["s", "s", "t"]), rng.choice(names), None, kind, rng.choice([None, "", *names[:5]]), rng.randint(1, 4), i, "extra"))
    rows += rng.sample(rows, 60)
    rng.shuffle(rows)
    got = {tuple(r) for r in apply_changes(spark.createDataFrame(rows, SCHEMA), batches=batches).collect()}
    assert got == replay(rows)


def test_empty_and_base(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert apply_changes(empty).count() == 0
    base = spark.createDataFrame([("s", "a", 0, 1), ("s", "b", 0, 1), (None, "c", 0, 1)], "source_id string, path_key string, epoch bigint, generation bigint")
    assert apply_changes(empty, base).count() == 3
    feed = spark.createDataFrame([("s", "A", None, "delete", None, 1, 1, None), (None, "C", None, "upsert", None, 1, 2, None)], SCHEMA)
    assert {tuple(r) for r in apply_changes(feed, base).collect()} == {("s", "b", 0, 1), (None, "c", 1, 2)}


def test_hot_key(spark):
    rows = [("s", "a", None, "upsert", None, 1 + i // 500, i, None) for i in range(1500)]
    assert [tuple(r) for r in apply_changes(spark.createDataFrame(rows, SCHEMA)).collect()] == [("s", "a", 3, 1499)]


def test_one_epoch_still_has_batches(spark):
    from foliant.operators.changes import _borders

    rows = spark.createDataFrame([(1, i) for i in range(900)] + [(2, 0), (None, 3)], "epoch bigint, generation bigint")
    borders = _borders(rows, ["epoch", "generation"], [1 / 3, 2 / 3])
    assert [e for e, _ in borders] == [1.0, 1.0] and abs(borders[0][1] - 300) < 30 and abs(borders[1][1] - 600) < 30
    assert _borders(rows.limit(0), ["epoch", "generation"], [0.5]) == []
    feed = [("s", f"p{i % 7}", None, "delete" if i % 5 == 0 else "upsert", None, 1, i, None) for i in range(200)]
    for batches in (1, 2, 5):
        assert {tuple(r) for r in apply_changes(spark.createDataFrame(feed, SCHEMA), batches=batches).collect()} == replay(feed)
