from __future__ import annotations

import hashlib

import pytest

from pyspark.sql import functions as F

from foliant.functions import normalise as N
from foliant.operators import chunking as C
from foliant.operators import outline as O
from foliant.operators import predicates as P
from foliant.operators import relational as R
from foliant.operators import retrieval as V
from foliant.operators import text as X


def ids(df):
    return sorted(r[0] for r in df.collect())


@pytest.fixture(scope="module")
def eav(spark):
    rows = [("d1", "v", "hello earth"), ("d2", "v", "hello mars"), ("d1", "status", "active"), ("d2", "status", "pending"), ("d3", "status", "done"), ("d3", "n", "10"), ("d1", "n", "9"), ("d2", "n", "abc"), ("d1", "day", "2024-01-02"), ("d4", "v", ""), ("d5", "v", "a"), ("d5", "v", "b"), ("d6", "v", None)]
    return spark.createDataFrame(rows, "doc_id string, key string, value string")


@pytest.mark.parametrize(
    "filters, logic, want",
    [
        ([("v", "contains", "EARTH")], "and", ["d1"]),
        ([("status", "in", "active,pending")], "and", ["d1", "d2"]),
        ([("status", "in", ["Active", "DONE"])], "and", ["d1", "d3"]),
        ([("status", "not in", ["active"])], "and", ["d2", "d3"]),
        ([("n", ">", 9)], "and", ["d3"]),
        ([("n", "≠", 9)], "and", ["d2", "d3"]),
        ([("n", "<", "abd")], "and", ["d2"]),
        ([("day", ">=", "2024-01-01")], "and", ["d1"]),
        ([("n", ">=", "2024-01-01")], "and", []),
        ([("v", "empty", None)], "and", ["d4"]),
        ([("v", "≠", "a")], "and", ["d1", "d2", "d4", "d5"]),
        ([("nokey", "=", "x")], "and", []),
        ([("v", "start with", "hello"), ("status", "=", "pending")], "and", ["d2"]),
        ([("v", "end with", "mars"), ("n", "=", 10)], "or", ["d2", "d3"]),
        ([], "and", []),
    ],
)
def test_metadata_filter(eav, filters, logic, want):
    assert ids(P.metadata_filter(eav, filters, logic)) == want


def test_store_filter_and_scope(spark):
    df = spark.createDataFrame([("a", None, ["x"]), ("b", 0, ["y"]), ("c", 1, None)], "id string, available int, tags array<string>")
    assert ids(P.store_filter(df, {"available": 1, "id": []})) == ["a", "c"]
    assert ids(P.store_filter(df, {"tags": ["x", "z"], "id": ""})) == ["a"]
    assert ids(P.store_filter(df, {"must_not": ["tags"]})) == ["c"]
    assert df.where(P.Scope.nothing().on("id")).count() == 0 and df.where(P.Scope.all().on("id")).count() == 3
    assert ids(df.where(P.Scope.some(["a"]).on("id"))) == ["a"] and P.Scope.some([]).kind == "nothing"


def test_upsert_latest_page(spark):
    old = spark.createDataFrame([("a", 1, 10), ("b", 2, 20)], "k string, v int, t int")
    new = spark.createDataFrame([("b", 3, 99), ("c", 4, 98)], "k string, v int, t int")
    assert {tuple(r) for r in R.upsert(old, new, ["k"], ["t"]).collect()} == {("a", 1, 10), ("b", 3, 20), ("c", 4, 98)}
    many = spark.createDataFrame([("a", 1, None), ("a", 2, 5), ("a", 3, 5)], "k string, v int, t int")
    assert [tuple(r) for r in R.latest(many, ["k"], ["t", "v"]).collect()] == [("a", 3, 5)]
    page = R.keyset_page(spark.range(10), "id", 3, 4).collect()
    assert [(r["id"], r["next_cursor"]) for r in page] == [(4, 7), (5, 7), (6, 7), (7, 7)]
    assert [r["next_cursor"] for r in R.keyset_page(spark.range(3), "id", None, 4).collect()] == [None] * 3


def test_closure_islands_neighbours(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "p string, c string")
    assert R.closure(edges, "p", "c").count() == 10
    rows = spark.createDataFrame([("d", i, f"c{i}", "s" if i < 4 else "t") for i in (1, 2, 3, 4, 5, 7)], "doc string, o int, id string, sec string")
    got = {(r["id"], r["distance"]) for r in R.neighbours(rows.where("id = 'c3'"), rows, ["doc"], "o", "id", 2, "sec").collect()}
    assert got == {("c1", -2), ("c2", -1), ("c3", 0)}
    assert {tuple(r) for r in R.runs(rows, ["doc"], "o").collect()} == {("d", 1, 5, 5), ("d", 7, 7, 1)}


def test_apportion(spark):
    df = spark.createDataFrame([("g", "a", 1.0), ("g", "b", 1.0), ("g", "c", 1.0)], "g string, k string, w double")
    assert [r["share"] for r in R.apportion(df, ["g"], "w", "k", 10).orderBy("k").collect()] == [4, 3, 3]


def test_rrf_caps_and_groups(spark):
    lane = lambda rows: spark.createDataFrame([("q", k, p) for k, p in rows], "query string, key string, place int")
    fused = V.rrf({"bm25": lane([("shared", 1), ("b", 2)]), "dense": lane([("shared", 1), ("d", 2)])})
    got = [(r["key"], round(r["rrf"], 9)) for r in fused.orderBy("rrf", ascending=False).orderBy(fused["rrf"].desc(), "key").collect()]
    assert got == [("shared", round(2 / 61, 9)), ("b", round(1 / 62, 9)), ("d", round(1 / 62, 9))]
    many = spark.createDataFrame([("q", f"a{i:03}", "doc", 1.0 - i / 1000) for i in range(20)] + [("q", f"b{i:03}", f"d{i}", 0.5 - i / 1000) for i in range(150)], "query string, key string, doc string, rrf double")
    capped = V.cap_and_refill(many, "doc")
    assert capped.count() == 128 and capped.where("doc = 'doc'").count() == 8
    few = V.cap_and_refill(many.where("key < 'b100'"), "doc")
    assert few.where("doc = 'doc'").count() == 20
    scored = spark.createDataFrame([("q", "1", "a", "port 8123", 0.9), ("q", "2", "a", "port   8123", 0.8), ("q", "3", "a", "port 9456", 0.7), ("q", "4", "b", "x", 0.1)], "query string, key string, doc string, content string, score double")
    assert [(r["key"], r["document_place"], r["evidence_place"], r["status"]) for r in V.groups(scored, "doc", "content").orderBy("key").collect()] == [("1", 1, 1, "matched"), ("3", 1, 2, "matched")]
    big = spark.createDataFrame([("q", f"{d}-{e}", f"{d}", f"{d} {e}", 0.9 - d / 1000) for d in range(40) for e in range(12)], "query string, key string, doc string, content string, score double")
    assert V.groups(big, "doc", "content").count() == 32 * 5


def test_knn_edge_cases(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 1.0]), (5, [1.0, 0.0])], "id bigint, v array<double>")
    got = [(r["query"], r["key"], r["score"]) for r in V.knn(df, "id", "v", df.where("id = 1"), "id", 2, keep_self=False).orderBy("place").collect()]
    assert got == [(1, 5, 1.0), (1, 4, 0.707107)]
    assert V.knn(df, "id", "v", df.limit(0), "id", 2).count() == 0


def test_merge_groups():
    assert C.group_sizes([150, 60, 50, 30], 100, "under") == [[0], [1], [2, 3]]
    assert C.group_sizes([150, 60, 50, 30], 100, "over") == [[0], [1, 2], [3]]
    assert C.group_sizes([60] * 4, 100, "under") == [[0], [1], [2], [3]]
    assert C.group_sizes([60] * 4, 100, "over") == [[0, 1], [2, 3]]
    assert C.group_sizes([10, 20, 30], 100) == [[0, 1, 2]]
    # pieces stand alone beyond the cap, not beyond the threshold that leaves room for the overlap
    assert C.group_sizes([50, 95], 100, "over", 10) == [[0, 1]] and C.group_sizes([50, 45], 100, "under", 10) == [[0, 1]]
    assert C.group_sizes([91, 5, 101, 5], 100, "over", 10) == [[0], [1], [2], [3]]


def test_delimiters_and_chunks():
    assert C.delimiters("") == [] and C.delimiters("\n`##`;`###`") == ["###", "##", "\n", ";"]
    assert C.delimiters("a`\r\n`b\r") == ["a", "\n", "b"] and C.has_custom("`x`") and not C.has_custom("``x")
    # delimiters fall out, every paragraph follows a line end
    assert C.naive_merge("a\r\nb", 1, "`\r\n`") == ["\na", "\nb"]
    assert C.naive_merge("one two.three four.five six", 3, ".") == ["\none two\nthree four", "\nfive six"]
    merged = C.naive_merge("one two three.four five six.seven", 3, ".", 50)
    assert merged[0] == "\none two three" and merged[1] == merged[0][7:] + "\nfour five six" and merged[2] == merged[1][len(merged[1]) // 2 :] + "\nseven" and C.naive_merge("", 3) == []
    assert C.naive_merge("a.b", 1, "") == ["\na.b"]
    assert C.children("a\n\nb\nc", "\n") == ["a\n", "b\n", "c"] and C.children("x", "(") == ["x"]
    assert C.markdown_chunks("# A\ntext\n\n## B\n```\n# no\n```\n") == ["# A\ntext", "## B", "```\n# no\n```"]
    # what stands under a heading goes with the headings below it
    assert O.tree_chunks("in\n# A\nx x\n## B\ny y\n## C\nzz\n# D\nww") == ["in", "# A\nx x\n## B\ny y", "# A\nx x\n## C\nzz", "# D\nww"]
    assert O.tree_chunks("plain\nlines") == ["plain", "lines"] and O.tree_chunks("") == [] == O.hierarchical_chunks("")
    assert O.hierarchical_chunks("# A\nx x\n## B\ny y\n# D\n# E", 8) == [["# A", "x x"], ["# A", "## B", "y y"], ["# D", "# E"]]
    assert O.family(["1. a", "2. b", "第三章 x"]) == 1 and O.family(["plain"]) == -1 and O.level("1.2 x", 1) == 2 and O.most_frequent_level(["1. a", "b", "2. c"], 1) == 2
    assert O.without_contents(["Contents", "", "1. A", "2. B", "1. A", "text"]) == ["1. A", "text"] and O.without_contents(["目 录"]) == []
    assert [O.numeral(t) for t in ("12", "twenty-one", "one hundred and five", "二十三", "一百零五", "三万五千", "XIV", "abc", "", None)] == [12, 21, 105, 23, 105, 35_000, 14, -1, -1, -1]
    assert C.qa_pairs([["q", "a"], ["more"], ["q2", "a2"], ["", "x"]]) == [("q", "a\nmore"), ("q2", "a2")]
    assert C.question_answers("x\nq1,a1\nmore\nq2,\nq3,a3") == [("q1", "a1\nmore"), ("q3", "a3")] and C.question_answers('a,"b\nc"\nq,', "csv") == [("a", "b\nc"), ("q", "")]
    assert C.tagged_passages("l1\nl2\tt\nz") == [("\nl1\nl2", "t")]
    assert C.heading_answers("# A\nbody\n## B\nb2\n```\n# no\n```\n# C\n# D\nd") == [("A", "body"), ("A\nB", "b2\n```\n# no\n```"), ("D", "d")]


def test_terms_and_ids(spark):
    names = ["Ｃ＋＋", "c++", "C#", "데이터 베이스", "데이터베이스", None, "<b>AC/DC</b> a++ c+++ v2.1 &amp; " + "y" * 200]
    df = spark.createDataFrame(list(enumerate(names)), "i int, t string").select("i", N.plain_udf("t").alias("p"))
    got = {r["i"]: (r["e"], r["h"]) for r in df.select("i", N.exact_terms(F.col("p")).alias("e"), N.hangul_terms(F.col("p")).alias("h")).collect()}
    assert got[0] == got[1] == (["x" + b"c++".hex()], []) and got[0] != got[2] and got[5] == ([], [])
    assert got[3] == got[4] and got[3][1] == ["데이", "이터", "터베", "베이", "이스", "데이터", "이터베", "터베이", "베이스"]
    assert got[6][0] == ["x" + t.encode().hex() for t in ("ac", "dc", "a++", "c++", "v2.1")] + ["xh" + hashlib.sha256(b"y" * 200).hexdigest()]
    titles = spark.createDataFrame([("My Report.PDF",), ("Ｍy  report.pdf",), ("v1.2 notes",), (None,)], "t string").select(N.title_key(N.folded_udf("t")))
    assert [r[0] for r in titles.collect()] == ["myreport", "myreport", "v1.2notes", ""]
    a = N.chunk_id("n", "d", {"order": 1, "content": "x"})
    assert a != N.chunk_id("n", "d", {"order": 2, "content": "x"}) and N.chunk_id("n", "d", {"id": "given"}) == "given" and len(a) == 16


def test_oov_frequency(spark):
    words = spark.createDataFrame([("a",), ("maior",), ("largest",), ("equipment",), ("abc123",)], "w string")
    assert [r[0] for r in words.select(X.oov_frequency(words["w"])).collect()] == [300, 150, 75, 38, None]


def test_column_types(spark):
    df = spark.createDataFrame([("1", "1.5", "yes", "2024-01-02", "007", "x"), ("2", "2", "no", "2024/1/3 10:00", "008", "1"), (None, "", "", None, "9", None)], "a string, b string, c string, d string, e string, f string")
    assert {r["column"]: r["kind"] for r in C.column_types(df, list("abcdef")).collect()} == {"a": "int", "b": "float", "c": "bool", "d": "datetime", "e": "text", "f": "text"}


def test_text_scalars(spark):
    df = spark.createDataFrame([("```markdown\n# A\n``` ", "a (b\nc) (d)", " x, y；x\n" + "é" * 20_000, 1536.0), (None, None, None, 0.0)], "f string, t string, k string, b double")
    row = df.select(X.without_fence(F.col("f")), X.between(F.col("t"), "(", ")"), X.keyword_terms(F.col("k")), X.pretty_bytes(F.col("b")), X.is_blank(F.col("t"))).collect()
    assert (row[0][0], row[0][1], row[0][3], row[0][4], row[1][3], row[1][4]) == ("# A", ["b\nc", "d"], "1.50 KB", False, "0 B", True)
    assert row[0][2] == ["x", "y", "é" * 16_383]
    links = spark.createDataFrame([('![a](u1.png) x\n<img SRC="u2"> ![b](u1.png)\n![a](u1.png) ![c](u1.png)',)], "t string").select(X.image_links(F.col("t"))).first()[0]
    assert [tuple(x) for x in links] == [(0, "u1.png"), (1, "u1.png"), (1, "u2"), (2, "u1.png")]
    words = spark.createDataFrame([("what is the limit",), ("the",), ("the of ",), ("what's the plan of it",), ("请问预算是多少",)], "t string").select(X.without_question_words(F.col("t")))
    assert [r[0] for r in words.collect()] == [" the limit", "the", " of ", " plan it", "预算"]
    assert spark.createDataFrame([("x",)], "t string").select(X.bucket(F.lit("abc"))).first()[0] == int(hashlib.sha1(b"abc").hexdigest(), 16) % 10**8
