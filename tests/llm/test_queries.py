"""The registered queries of the llm operators beside their SQL on the smallest tables."""

from __future__ import annotations

import hashlib
from pathlib import Path

import duckdb
import pytest

from foliant.llm import queries as Q
from tools.compare import plain

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="test tables are not here")


#: Rows and digest of the queries that SQL can't express, as recorded: another result is a change to look at, not by itself a fault.
EXPECTED: dict[str, tuple[int, str]] = {
    "p1_pieces": (21, "85be2027763083df"),
    "p4_found": (40, "10fe6c69e6dfe67a"),
    "p4_repaired": (297, "49a788e8ccf43207"),
    "p6_ids": (100, "eb91f04b02877738"),
    "p7_mix": (176, "b8758c83bb96471b"),
    "p7_shares": (9, "e1e8f8c40560de1d"),
    "p7_temperature": (9, "c8095212104513f8"),
    "p7_temperature_shares": (9, "6b3e6b893b973cfe"),
    "p8_found": (0, "4f53cda18c2baa0c"),
    "p8_rates": (7, "4cb5d739f91d44c9"),
    "p8_scores": (100, "2cba47a07bd22ea5"),
}


def digest(rows):
    return hashlib.sha256(repr(rows).encode()).hexdigest()[:16]


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, name):
    df = Q.QUERIES[name](spark, str(DATA))
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    if name not in Q.SQL:
        assert (len(got), digest(got)) == EXPECTED[name]
        return
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    cur = con.execute(Q.SQL[name])
    cols = [d[0] for d in cur.description]
    assert sorted((tuple(plain(r[cols.index(c)]) for c in names) for r in cur.fetchall()), key=repr) == got
