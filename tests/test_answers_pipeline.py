from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from foliant.operators import answers as N
from foliant.operators import pipeline as G


def test_parents_and_pack(spark):
    hits = spark.createDataFrame([("q", "a", 1.0), ("q", "b", 3.0), ("q", "c", 5.0), ("q", "d", 2.0)], "query string, key string, score double")
    chunks = spark.createDataFrame([("a", "p"), ("b", "p"), ("c", "gone"), ("d", None), ("p", None)], "key string, parent string")
    assert {tuple(r) for r in N.parent_expansion(hits, chunks).collect()} == {("q", "p", 2.0, 2), ("q", "c", 5.0, 0), ("q", "d", 2.0, 0)}
    rows = spark.createDataFrame([("q", "s", 1, 0, 60), ("q", "big", 1, 1, 80), ("q", "small", 2, 1, 30)], "query string, key string, rank int, distance int, bytes int")
    assert [r["key"] for r in N.pack(rows, 100).orderBy("place").collect()] == ["s", "small"]
    assert N.pack(rows.limit(0), 100).count() == 0


def test_citations(spark):
    pieces = spark.createDataFrame([("q", 0, 0.9), ("q", 1, 0.2), ("r", 0, 0.35), ("w", 0, 0.1)], "query string, piece int, s double")
    sources = spark.createDataFrame([("q", "a"), ("q", "b"), ("r", "c"), ("w", "d")], "query string, key string")
    got = {tuple(r) for r in N.citations(pieces, sources, F.col("s")).collect()}
    assert got == {("q", 0, "a"), ("q", 0, "b"), ("r", 0, "c")}


def test_messages_and_marks(spark):
    messages = [{"role": "system", "content": "a b"}, {"role": "user", "content": "x " * 50}, {"role": "user", "content": "y " * 10}]
    assert N.trim_messages(messages, 100) == messages
    trimmed = N.trim_messages(messages, 8)
    assert [m["role"] for m in trimmed] == ["system", "user"] and trimmed[1]["content"].split() == ["y"] * 6
    df = spark.createDataFrame([("see [1] and [2]", 2), ("see [3]", 2), ("none", 0)], "a string, n int")
    assert [r[0] for r in df.select(N.valid_citations(F.col("a"), F.col("n"))).collect()] == [True, False, True]
    fixed = spark.createDataFrame([("<think>x</think>ok (ref: 2) 【ID：3】",)], "a string").select(N.repaired_citations(F.col("a"))).first()[0]
    assert fixed == "ok [ID:2] [ID:3]"
    assert N.parse_features(['{"a": 2.0, "b": true, " ": 1}', "{'c': 1}", "open('x')", None, '{"d": NaN}']) == [{"a": 2.0}, {"c": 1.0}, {}, {}, {}]


def test_scope(spark):
    members = spark.createDataFrame([("root", "d1"), ("child", "d2"), ("other", "d3")], "folder_id string, document_id string")
    folders = spark.createDataFrame([("root", ["root"]), ("child", ["root", "child"]), ("other", ["other"])], "id string, ids array<string>")
    ids = lambda df: sorted(r[0] for r in df.collect())
    assert ids(G.scope_documents(members, folders, "all")) == ["d1", "d2", "d3"]
    assert ids(G.scope_documents(members, folders, "folders", ["root"])) == ["d1", "d2"]
    assert ids(G.scope_documents(members, folders, "documents", ["d3"])) == ["d3"] and ids(G.scope_documents(members, folders, "folders", [])) == []
    for mode, wanted in (("all", ["x"]), ("folders", None), ("some", [])):
        with pytest.raises(ValueError):
            G.scope_documents(members, folders, mode, wanted)
    with pytest.raises(LookupError):
        G.scope_documents(members, folders, "folders", ["nope"])
    with pytest.raises(PermissionError):
        G.guard_scope(members, "document_id", members.where("document_id = 'd1'").select("document_id"))


def test_fused_search(spark):
    chunks = spark.createDataFrame([(1, "a", "pump manual.pdf", "the pump stops at night"), (2, "a", "pump manual.pdf", "the  pump stops at night"), (3, "b", "b.txt", "budget of the depot"), (4, "c", None, ""), (5, "d", "d.txt", "unrelated words")], "key bigint, document string, name string, content string")
    queries = spark.createDataFrame([(1, "pump stops"), (2, "pump manual"), (3, "!!")], "query bigint, question string")
    out = G.fused_search(queries, chunks)
    first = {r["query"]: (r["document"], r["status"]) for r in out.where("document_place = 1 and evidence_place = 1").collect()}
    assert first == {1: ("a", "matched"), 2: ("a", "matched")}
    assert out.where("query = 1 and document = 'a'").count() == 1  # the same text but for blanks
    scope = spark.createDataFrame([("b",)], "document_id string")
    assert out.where("query = 3").count() == 0 and G.fused_search(queries, chunks, scope).where("document = 'a'").count() == 0
    with pytest.raises(Exception):
        G.embed(chunks, "key", "content", lambda t: __import__("numpy").full((len(t), 2), float("nan"))).collect()
