"""Every registered query beside its SQL on the smallest tables, and that the package stands without its llm part."""

from __future__ import annotations

import hashlib
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from foliant.plans import answer_queries, feed_queries, more_queries, relational_queries, retrieval_queries, rewrite_queries, source_queries, state_queries, stream_queries, text_queries, value_queries
from tools.compare import plain

DATA = Path("/root/testdata/sf0.001")
MODULES = (feed_queries, relational_queries, retrieval_queries, text_queries, stream_queries, answer_queries, more_queries, rewrite_queries, state_queries, source_queries, value_queries)
NAMES = sorted(n for m in MODULES for n in m.QUERIES)

#: Rows and digest of the queries that SQL can't express, as recorded: another result is a change to look at, not by itself a fault.
EXPECTED: dict[str, tuple[int, str]] = {
    "c18_embed": (100, "06af949efe2ee655"),
    "c1_naive_merge": (1013, "e4e0014ae458359e"),
    "c5_hierarchical": (38, "2d9f1f05cbe8422e"),
    "c5_tree_chunks": (1154, "22e46aeab7139389"),
    "c7_markdown_chunks": (439, "4266cfe10f792a7e"),
    "r23_fused_search": (28, "f1ad4a68070bcb4d"),
    "r28_pack": (258, "5288b0f6d9f10a96"),
}


def digest(rows):
    return hashlib.sha256(repr(rows).encode()).hexdigest()[:16]


pytestmark = pytest.mark.skipif(not DATA.exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, str(DATA))
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert (len(got), digest(got)) == EXPECTED[name]
        return
    cur = duck.execute(sql)
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == names
    assert sorted((tuple(plain(r[cols.index(c)]) for c in names) for r in cur.fetchall()), key=repr) == got


def test_core_does_not_import_llm():
    root = Path(entry.__file__).parent
    for f in (root / "foliant").rglob("*.py"):
        if "llm" not in f.relative_to(root / "foliant").parts:
            assert "foliant.llm" not in f.read_text()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
