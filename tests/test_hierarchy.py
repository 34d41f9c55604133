from __future__ import annotations

import random

from foliant.operators.components import components
from foliant.operators.hierarchy import contract, cycles, descendants_of, hierarchy

SCHEMA = "id string, parent_id string, display_name string, depth int, root string, path string"


def brute(parent):
    out = {}
    for node in parent:
        seen, at = [], node
        while at in parent and at not in seen:
            seen.append(at)
            at = parent[at]
        out[node] = ("cycle", min(seen[seen.index(at) :])) if at in seen else ("tree", seen[-1], len(seen) - 1, seen[::-1])
    return out


def check(spark, parent):
    rows = [(n.upper() if i % 3 else f" {n}", p.upper() if p and i % 2 else p, f"n{n}", 9, "x", "y") for i, (n, p) in enumerate(parent.items())]
    random.Random(1).shuffle(rows)
    rows += rows[:5]
    got = contract(spark.createDataFrame(rows, SCHEMA)).collect()
    want = brute(parent)
    assert len(got) == len(want)
    for r in got:
        w = want[r["id"]]
        if w[0] == "cycle":
            assert (r["cycle_id"], r["root"], r["depth"], r["path"]) == (w[1], None, None, None)
        else:
            assert (r["cycle_id"], r["root"], r["depth"], r["ids"]) == (None, w[1], w[2], w[3])
            assert r["path"] == "/".join(f"n{n}" for n in w[3])


def test_shapes(spark):
    parent: dict[str, str | None] = {f"c{i}": f"c{i - 1}" if i else None for i in range(150)}  # a chain
    parent |= {f"s{i}": "s0" if i else "" for i in range(60)}  # a star, its root with a blank parent
    parent |= {f"l{i}": f"l{(i + 1) % 7}" for i in range(7)}  # a loop
    parent |= {f"t{i}": f"t{i - 1}" if i else "l3" for i in range(9)}  # a chain under the loop
    parent |= {"self": "self", "under": "self", "lost": "nowhere", "a2": "b2", "b2": "a2"}
    check(spark, parent)


def test_random_forest(spark):
    rng = random.Random(7)
    check(spark, {f"r{i}": f"r{rng.randrange(200)}" if rng.random() < 0.97 else None for i in range(200)})


def test_descendants_and_counts(spark):
    df = spark.createDataFrame([("a", None, "A", 0, "", ""), ("b", "a", None, 0, "", ""), ("c", "b", "C", 0, "", ""), (None, "a", "x", 0, "", "")], SCHEMA)
    whole = contract(df)
    assert {tuple(r) for r in descendants_of(whole).collect()} == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1)}
    assert {(r["id"], r["path"], r["descendants"]) for r in hierarchy(df).collect()} == {("a", "A", 2), ("b", "A/", 1), ("c", "A//C", 0)}


def test_descendants_on_and_under_loops(spark):
    parent = {f"l{i}": f"l{(i + 1) % 5}" for i in range(5)} | {f"t{i}": f"t{i - 1}" if i else "l3" for i in range(6)} | {"b": "t2", "b2": "b", "self": "self", "under": "self", "a2": "b1", "b1": "a2", "r": None, "s": "r"}
    parent |= {f"m{i}": f"m{(i + 1) % 40}" for i in range(40)} | {f"x{i}": f"m{i * 3}" for i in range(9)}
    want = set()
    for node in parent:
        at, n = parent[node], 1
        seen = {node}
        while at is not None and at not in seen:
            seen.add(at)
            want.add((at, node, n))
            at, n = parent[at], n + 1
    df = spark.createDataFrame([(n, p, n, 0, "", "") for n, p in parent.items()], SCHEMA)
    got = [tuple(r) for r in descendants_of(contract(df)).collect()]
    assert len(got) == len(want) and set(got) == want
    counts = {r["id"]: r["descendants"] for r in hierarchy(df).collect()}
    assert counts == {n: sum(a == n for a, _, _ in want) for n in parent}


def test_parents_in_uuid_form(spark):
    top, mid, low = "0123456789abcdef0123456789abcdef", "f8885b84cfee4c3146b0e8c2598c4a62", "a" * 32
    rows = [(top, " ", "T", 0, "", ""), (mid, "01234567-89AB-CDEF-0123-456789abcdef", "M", 0, "", ""), (low, " {F8885B84-cfee-4c31-46b0-e8c2598c4a62}\t", "L", 0, "", "")]
    assert {(r["id"], r["root"], r["path"], r["cycle_id"]) for r in contract(spark.createDataFrame(rows, SCHEMA)).collect()} == {(top, top, "T", None), (mid, top, "T/M", None), (low, top, "T/M/L", None)}
    rows[0] = (top, "f8885b84-cfee-4c31-46b0-e8c2598c4a62", "T", 0, "", "")
    assert {tuple(r) for r in cycles(spark.createDataFrame(rows, SCHEMA)).collect()} == {(x, top) for x in (top, mid, low)}


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert hierarchy(df).count() == 0 and cycles(df).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200), (300, 301), (301, 300), (None, 5)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a int, b int"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 300: 300, 301: 300}
    assert components(spark.createDataFrame([], "a int, b int"), "a", "b").count() == 0


def test_rounds_in_spark_and_in_one_task_agree(spark):
    """However much of the contraction is left to the last task, the result is that of brute force."""
    rng = random.Random(11)
    parent: dict[str, str | None] = {f"c{i}": f"c{i - 1}" if i else None for i in range(60)} | {f"s{i}": "c7" for i in range(40)}
    parent |= {f"m{i}": f"m{(i + 1) % 23}" for i in range(23)} | {f"x{i}": f"x{i - 1}" if i else "m4" for i in range(12)} | {f"y{i}": f"m{i * 2}" for i in range(9)}
    parent |= {"self": "self", "a2": "b2", "b2": "a2", "alone": None} | {f"r{i}": f"r{rng.randrange(60)}" if rng.random() < 0.95 else None for i in range(60)}
    below = {n: set() for n in parent}
    for node in parent:
        at, seen = parent[node], {node}
        while at is not None and at not in seen:
            seen.add(at)
            below[at].add(node)
            at = parent[at]
    worth = {n: rng.randrange(100) for n in parent}
    df = spark.createDataFrame([(n, p, f"n{n}", worth[n]) for n, p in parent.items()], "id string, parent_id string, display_name string, worth int")
    want = brute(parent)
    for core_rows in (0, 25):
        whole = contract(df, value_col="worth", core_rows=core_rows)
        rows = whole.collect()
        assert len(rows) == len(parent)
        for r in rows:
            n, w = r["id"], want[r["id"]]
            assert (r["descendants"], r["total"]) == (len(below[n]), worth[n] + sum(worth[x] for x in below[n]))
            if w[0] == "cycle":
                assert (r["cycle_id"], r["root"], r["depth"], r["path"]) == (w[1], None, None, None)
            else:
                assert (r["cycle_id"], r["root"], r["depth"], r["ids"], r["path"]) == (None, w[1], w[2], w[3], "/".join(f"n{x}" for x in w[3]))
        pairs = [(r["id"], r["descendant"]) for r in descendants_of(whole).collect()]
        assert len(pairs) == len(set(pairs)) and set(pairs) == {(a, b) for a, bs in below.items() for b in bs}
        bare = contract(df, paths=False, core_rows=core_rows).collect()
        assert {(r["id"], r["root"], r["cycle_id"], r["descendants"]) for r in bare} == {(r["id"], r["root"], r["cycle_id"], r["descendants"]) for r in rows}
