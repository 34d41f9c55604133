"""Parent links of unknown depth to full paths, depths, roots, descendants and cycles, by tree contraction.

Every round rakes all leaves and splices an independent set of nodes out of unary chains (a node with one child
whose hashed priority is below that of its parent and of its child). Each removed node is recorded with the parent it
had at that time and with the hops, names and smallest id of what lay between; what hangs below a raked node is added to
its parent, so numbers of descendants (and sums of a value) come out without a pair of nodes ever being written. A tree
shrinks by a constant factor whatever its shape, so chains of depth d take O(log d) rounds, and a loop shrinks to a node
that is its own parent: that core exposes the cycle and has gathered its smallest id. Roots and cores are taken out when
nothing is left below them. The recordings are then reversed, latest round first, each giving its nodes the root,
depth and path of the recorded parent. Rows of later rounds shrink geometrically and finished rounds are never written
again, so all rounds together move a small multiple of the table.

Rounds are Spark joins while more than ``CORE_ROWS`` nodes (or ``CORE_BYTES`` of names) are left. The remaining core, of
that proven size, goes through the same rounds on arrays in one task, where a round costs microseconds instead of jobs.

Cases: ids and parent ids are compared in lower case without white space around them, and where they are 32 hex digits by
these alone, so that dashes and braces of the UUID form don't count; ids come out as written, trimmed and in lower case. A blank or null parent, or one that is not in the
table, makes a root. Repeated ids are one node (the smallest parent and name of them); rows without id are left out.
Null names count as empty strings. A node that is its own parent is a loop of one. Nodes on or under a loop have
null root, depth and path, and the smallest id of the loop as cycle_id. Below a node on a loop are the others on it and all that
hang under it, each once, at the distance of the shortest way down; below a node under a loop is its own subtree. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.session import cut

#: Nodes, and bytes of their names and ids, from which on the rest of the contraction is one task.
CORE_ROWS, CORE_BYTES = 10_000, 64 << 20
_STATE = ["id", "parent", "hops", "least", "n", "v", "bn", "bv"]
_TEXTS = ["names", "ids"]
_DONE = "id string, root string, depth int, cycle_id string, ring boolean, around int, n bigint, v bigint"


def _key(c: str) -> Column:
    """What ids are compared by."""
    plain = F.regexp_replace(F.lower(F.col(c)), r"^\s+|\s+$", "")
    digits = F.regexp_replace(plain, r"[^\p{L}\p{N}]", "")
    return F.when(digits.rlike("^[0-9a-f]{32}$"), digits).otherwise(plain)


def _nodes(df: DataFrame, id_col: str, parent_col: str, name_col: str, value_col: str | None) -> DataFrame:
    value = F.lit(0) if value_col is None else F.coalesce(F.col(value_col).cast("bigint"), F.lit(0))
    return (
        df.select(
            _key(id_col).alias("key"), F.lower(F.trim(F.col(id_col))).alias("id"), F.nullif(_key(parent_col), F.lit("")).alias("parent"),
            F.coalesce(F.col(name_col).cast("string"), F.lit("")).alias("name"), value.cast("bigint").alias("v"),
        )
        .where(F.col("key").isNotNull() & (F.col("key") != ""))
        .groupBy("key")
        .agg(F.min("id").alias("id"), F.min("parent").alias("parent"), F.min("name").alias("name"), F.max("v").alias("v"))
    )


def _linked(nodes: DataFrame, texts: list[str]) -> DataFrame:
    """Nodes in the state they start with: n nodes and value v at and below each, bn and bv spliced out between it and its parent."""
    known = nodes.select(F.col("key").alias("_key"), F.col("id").alias("_known"))
    zero = F.lit(0).cast("bigint")
    start = {"parent": F.col("_known"), "hops": F.lit(1), "least": F.col("id"), "n": zero + 1, "v": F.col("v"), "bn": zero, "bv": zero, "names": F.col("name"), "ids": F.array("id")}
    return nodes.join(known, nodes["parent"] == known["_key"], "left").select("id", *(c.alias(k) for k, c in start.items() if k not in _TEXTS or k in texts))


def _gained(raked: DataFrame) -> DataFrame:
    """What raked leaves add to their parents."""
    return raked.groupBy(F.col("parent").alias("of")).agg(F.sum(F.col("n") + F.col("bn")).alias("gn"), F.sum(F.col("v") + F.col("bv")).alias("gv"))


def _round(alive: DataFrame, gains: DataFrame | None, round_no: int, texts: list[str]) -> DataFrame:
    """One round: the nodes with their fate (stay, rake, splice, top) and, of spliced ones, the only child and what lay between."""
    rank = lambda c: F.xxhash64(F.lit(round_no), F.col(c))
    zero = F.lit(0).cast("bigint")
    kids = alive.where("parent is not null and parent <> id").select(F.col("parent").alias("of"), F.struct("id", "bn", "bv").alias("only"), zero.alias("gn"), zero.alias("gv"))
    if gains is not None:
        kids = kids.unionByName(gains, allowMissingColumns=True)
    kids = kids.groupBy("of").agg(F.count("only").alias("kids"), F.min("only").alias("only"), F.sum("gn").alias("gn"), F.sum("gv").alias("gv"))
    seen = alive.join(kids, alive["id"] == kids["of"], "left")
    seen = seen.withColumns({"n": F.col("n") + F.coalesce("gn", zero), "v": F.col("v") + F.coalesce("gv", zero), "kids": F.coalesce("kids", zero)})
    outer = F.col("parent").isNull() | (F.col("parent") == F.col("id"))
    spliced = ~outer & (F.col("kids") == 1) & (rank("id") < rank("only.id")) & (rank("id") < rank("parent"))
    fate = F.when(F.coalesce(spliced, F.lit(False)), "splice").when(F.col("kids") > 0, "stay").when(outer, "top").otherwise("rake")
    seen = seen.select(*_STATE, *texts, "only", fate.alias("fate"))
    gone = seen.where("fate = 'splice'")
    # every kept node has at most one node taken out above it, found by that node's only child: keys are unique on both sides
    above = gone.select(F.col("only.id").alias("_below"), *(F.col(c).alias(f"_{c}") for c in [*_STATE[1:], *texts]))
    merged = seen.where("fate <> 'splice'").join(above, F.col("id") == F.col("_below"), "left")
    both = F.col("_below").isNotNull()
    now = {
        "parent": F.coalesce("_parent", "parent"),
        "hops": F.col("hops") + F.coalesce("_hops", F.lit(0)),
        "least": F.least("least", "_least"),
        "bn": F.col("bn") + F.when(both, F.col("_n") + F.col("_bn")).otherwise(0),
        "bv": F.col("bv") + F.when(both, F.col("_v") + F.col("_bv")).otherwise(0),
        "names": F.when(both, F.concat_ws("/", "_names", "names")).otherwise(F.col("names")) if texts else None,
        "ids": F.when(both, F.concat("_ids", "ids")).otherwise(F.col("ids")) if texts else None,
    }
    merged = merged.select(*(now[c].alias(c) if c in now else F.col(c) for c in [*_STATE, *texts]), F.lit(None).cast(seen.schema["only"].dataType).alias("only"), "fate")
    return merged.unionByName(gone)


def _tops(record: DataFrame, texts: list[str]) -> DataFrame:
    """Roots and cores with nothing left below them."""
    core = F.col("parent").isNotNull()
    found = [F.when(~core, F.col("id")).alias("root"), F.lit(0).alias("depth"), F.when(core, F.col("least")).alias("cycle_id"), core.alias("ring"), F.when(core, F.col("hops")).alias("around")]
    found += [F.when(core, F.col(c) + F.col(f"b{c}")).otherwise(F.col(c)).alias(c) for c in ("n", "v")]
    if texts:
        found += [F.when(~core, F.col("names")).alias("path"), F.when(core, F.array("id")).otherwise(F.col("ids")).alias("ids")]
    return record.where("fate = 'top'").select("id", *found)


def _reversed(record: DataFrame, done: DataFrame, texts: list[str]) -> DataFrame:
    """What one round took out, placed below the recorded parents, which later rounds have placed."""
    gone = record.where("fate in ('rake', 'splice')")
    child = done.select(F.col("id").alias("_child"), F.col("ring").alias("_cring"), F.col("n").alias("_cn"), F.col("v").alias("_cv"))
    child = child.unionByName(record.where("fate = 'rake'").select(F.col("id").alias("_child"), F.lit(False).alias("_cring"), F.col("n").alias("_cn"), F.col("v").alias("_cv")))
    above = done.select(*(F.col(c).alias(f"_{c}") for c in done.columns))
    placed = gone.join(child, F.col("only.id") == F.col("_child"), "left").join(above, F.col("parent") == F.col("_id"))
    ring = F.coalesce("_cring", F.lit(False))  # a spliced node is on a loop if its only child is
    found = [F.col("_root").alias("root"), (F.col("_depth") + F.col("hops")).alias("depth"), F.col("_cycle_id").alias("cycle_id"), ring.alias("ring"), F.when(ring, F.col("_around")).alias("around")]
    for c in ("n", "v"):
        found.append(F.when(ring, F.col(f"_{c}")).otherwise(F.col(c) + F.coalesce(F.col(f"only.b{c}") + F.col(f"_c{c}"), F.lit(0))).alias(c))
    if texts:
        found += [F.when(F.col("_path").isNotNull(), F.concat_ws("/", "_path", "names")).alias("path"), F.when(ring, F.array("id")).otherwise(F.concat("_ids", "ids")).alias("ids")]
    return placed.select("id", *found)


def _rounds(par: np.ndarray, hops: np.ndarray, n: np.ndarray, v: np.ndarray, bn: np.ndarray, bv: np.ndarray) -> tuple[np.ndarray, ...]:
    """The same rounds and their reversal on arrays: (root, depth, core, ring); n and v become those of everything at and below."""
    m = len(par)
    par, hops, alive, taken = par.copy(), hops.copy(), np.ones(m, bool), []
    while alive.any():
        live = np.flatnonzero(alive)
        up = par[live]
        linked = (up >= 0) & (up != live)
        kids, only = np.bincount(up[linked], minlength=m), np.full(m, -1)
        only[up[linked]] = live[linked]
        rank = np.random.default_rng(len(taken)).permutation(m)
        spliced = linked & (kids[live] == 1) & (rank[live] < rank[only[live]]) & (rank[live] < rank[up])
        s = live[spliced]
        w = only[s]
        splice = (s, par[s], hops[s].copy(), w, bn[w].copy(), bv[w].copy())
        par[w] = par[s]
        hops[w] += hops[s]
        bn[w] += n[s] + bn[s]
        bv[w] += v[s] + bv[s]
        leaf = kids[live] == 0
        tops, raked = live[leaf & ~linked], live[leaf & linked]
        np.add.at(n, par[raked], n[raked] + bn[raked])
        np.add.at(v, par[raked], v[raked] + bv[raked])
        taken.append((tops, (raked, par[raked], hops[raked].copy()), splice))
        for out in (tops, raked, s):
            alive[out] = False
    root, core, depth, ring = np.full(m, -1), np.full(m, -1), np.zeros(m, np.int64), np.zeros(m, bool)
    for tops, (raked, over, far), (s, above, gap, w, wn, wv) in reversed(taken):
        looped = par[tops] == tops
        root[tops[~looped]], core[tops[looped]], ring[tops[looped]] = tops[~looped], tops[looped], True
        n[tops[looped]] += bn[tops[looped]]
        v[tops[looped]] += bv[tops[looped]]
        root[raked], core[raked], depth[raked] = root[over], core[over], depth[over] + far
        root[s], core[s], depth[s], ring[s] = root[above], core[above], depth[above] + gap, ring[w]
        n[s], v[s] = np.where(ring[w], n[above], n[s] + wn + n[w]), np.where(ring[w], v[above], v[s] + wv + v[w])
    return root, depth, core, ring


def _core(batches: Iterator[pd.DataFrame], texts: list[str]) -> Iterator[pd.DataFrame]:
    """The rest of the contraction in one task; rows without id carry what raked leaves add."""
    parts = list(batches)
    if not parts:
        return
    rows = pd.concat(parts, ignore_index=True)
    gains, rows = rows[rows["id"].isna()], rows[rows["id"].notna()].reset_index(drop=True)
    if not len(rows):
        return
    number = pd.Series(np.arange(len(rows)), rows["id"])
    par = number.reindex(rows["parent"]).fillna(-1).to_numpy(np.int64)
    hops, n, v, bn, bv = (rows[c].to_numpy(np.int64).copy() for c in ("hops", "n", "v", "bn", "bv"))
    to = number.loc[gains["parent"]].to_numpy(np.int64)
    np.add.at(n, to, gains["n"].to_numpy(np.int64))
    np.add.at(v, to, gains["v"].to_numpy(np.int64))
    root, depth, core, ring = _rounds(par, hops, n, v, bn, bv)
    ids, least = rows["id"].to_numpy(object), rows["least"].to_numpy(object)
    smallest: dict[int, str] = {}
    around = np.bincount(core[ring], weights=hops[ring], minlength=len(rows)).astype(np.int64)
    for i in np.flatnonzero(ring):
        smallest[core[i]] = min(smallest.get(core[i], least[i]), least[i])
    at_once = 1_000  # rows of one batch: paths are as long as trees are deep
    for lo in range(0, len(rows), at_once):
        part = range(lo, min(lo + at_once, len(rows)))
        out = {
            "id": ids[part], "root": [ids[root[i]] if root[i] >= 0 else None for i in part], "depth": depth[part], "cycle_id": [smallest.get(core[i]) for i in part],
            "ring": ring[part], "around": pd.array([around[core[i]] if ring[i] else None for i in part], "Int32"), "n": n[part], "v": v[part],
        }
        if texts:
            out |= {"path": [], "ids": []}
            for i in part:
                names, above, at = [], [], i
                while at >= 0 and not ring[at]:
                    names.append(rows["names"][at])
                    above.append(rows["ids"][at])
                    at = par[at]
                out["path"].append("/".join(reversed(names)) if at < 0 else None)
                out["ids"].append([*([ids[at]] if at >= 0 else []), *(x for segment in reversed(above) for x in segment)])
        yield pd.DataFrame(out)


def contract(
    df: DataFrame, id_col: str = "id", parent_col: str = "parent_id", name_col: str = "display_name", value_col: str | None = None, paths: bool = True, core_rows: int = CORE_ROWS, max_rounds: int = 200
) -> DataFrame:
    """(id, root, depth, path, ids, cycle_id, place, around, descendants, total); ids holds the ids from the root, or from the
    node of the loop, down to the node itself; nodes on a loop have their place along it, downwards, and the number of nodes
    around it; total is the sum of value_col over the node and all below it. Without ``paths``, path and ids are left out."""
    texts = _TEXTS if paths else []
    alive, gains = cut(_linked(_nodes(df, id_col, parent_col, name_col, value_col), texts)), None
    length = F.length("names") + F.coalesce(F.aggregate("ids", F.lit(0), lambda a, x: a + F.length(x)), F.lit(0)) if texts else F.length("id")
    records: list[DataFrame] = []
    while True:
        left = alive.agg(F.count(F.lit(1)).alias("n"), F.sum(length).alias("bytes")).first()
        if left["n"] <= core_rows and (left["bytes"] or 0) <= CORE_BYTES:
            break
        if len(records) == max_rounds:
            raise RuntimeError(f"contraction did not end within {max_rounds} rounds")
        step = cut(_round(alive, gains, len(records), texts))
        records.append(step.where("fate <> 'stay'"))
        alive, gains = step.where("fate = 'stay'").select(*_STATE, *texts), _gained(step.where("fate = 'rake'"))
    if gains is not None:
        alive = alive.unionByName(gains.select(F.col("of").alias("parent"), F.col("gn").alias("n"), F.col("gv").alias("v")), allowMissingColumns=True)
    placed: list[DataFrame] = []
    done = alive.repartition(1).mapInPandas(lambda batches: _core(batches, texts), _DONE + (", path string, ids array<string>" if texts else ""))
    for record in reversed(records):
        above = functools.reduce(DataFrame.unionByName, placed := [*placed, cut(done)])
        done = _reversed(record, above, texts).unionByName(_tops(record, texts))
    done = functools.reduce(DataFrame.unionByName, placed, done)
    looped = F.col("cycle_id").isNotNull()
    out = ["id", "root", F.when(~looped, F.col("depth")).alias("depth"), *(["path", "ids"] if texts else []), "cycle_id", F.when(F.col("ring"), F.col("depth")).alias("place"), "around"]
    return cut(done.select(*out, (F.col("n") - 1).alias("descendants"), F.col("v").alias("total")))


def hierarchy(df: DataFrame, **columns: str) -> DataFrame:
    """(id, root, depth, path, cycle_id, descendants): one row for each node; descendants is their number."""
    return contract(df, **columns).select("id", "root", "depth", "path", "cycle_id", "descendants")


def descendants_of(contracted: DataFrame) -> DataFrame:
    """(id, descendant, distance) for every pair of a node and a node below it, from what ``contract`` returned."""
    looped = F.col("cycle_id").isNotNull().cast("int")  # the first id is of the loop, whose nodes come below
    chains = contracted.where(F.size("ids") > 1).select(
        F.col("id").alias("descendant"), (F.size("ids") - 1 - looped).alias("most"), F.posexplode(F.slice("ids", looped + 1, F.size("ids") - 1 - looped)).alias("at", "id")
    )
    chains = chains.select("id", "descendant", (F.col("most") - F.col("at")).alias("distance"))
    ring = contracted.where("place is not null")
    entry = ring.select(F.col("id").alias("_entry"), F.col("place").alias("_place"))
    hung = contracted.where("cycle_id is not null").select(F.col("id").alias("descendant"), "cycle_id", F.element_at("ids", 1).alias("_entry"), (F.size("ids") - 1).alias("hops")).join(entry, "_entry")
    around = hung.join(ring.select("id", "cycle_id", "place", "around"), "cycle_id").where("id <> descendant")
    return chains.unionByName(around.select("id", "descendant", (F.col("hops") + F.pmod(F.col("_place") - F.col("place"), F.col("around"))).alias("distance")))


def cycles(df: DataFrame, **columns: str) -> DataFrame:
    """(id, cycle_id): the nodes on or below a loop."""
    return contract(df, paths=False, **columns).where(F.col("cycle_id").isNotNull()).select("id", "cycle_id")
