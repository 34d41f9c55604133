"""Queries of scans, filters, joins, aggregations, windows, paging, sets and changes over the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.operators import ranking as K
from foliant.operators import predicates as P
from foliant.operators import relational as R
from foliant.plans.registry import Registry
from foliant.sources.tables import load

_R = Registry()
query = _R.add
QUERIES, SQL = _R.queries, _R.sql

#: Chunks as they are now: the row delivered with the greatest created, then the greatest availability.
LATEST_CHUNKS = """(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY created DESC NULLS LAST, available DESC NULLS LAST) AS rn FROM chunks) WHERE rn = 1)"""
FILES = "(SELECT DISTINCT * FROM source_documents)"


def chunks_now(s: SparkSession, d: str, *columns: str) -> DataFrame:
    keep = dict.fromkeys(["chunk_id", "created", "available", *columns])
    return R.latest(load(s, d, "chunks").select(*keep), ["chunk_id"], ["created", "available"]).select(*columns)


def files(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "source_documents").distinct()


def r6(c, name: str):
    return F.round(c, 6).alias(name)


# scans ---------------------------------------------------------------------------------------------------------------


@query("""SELECT chunk_id, doc_id, docnm_kwd FROM chunks WHERE lower(doc_type) = 'pdf' AND coalesce(available, 1) >= 1
          AND kb_id IN (SELECT id FROM knowledgebases WHERE permission = 'team') GROUP BY ALL ORDER BY chunk_id LIMIT 50 OFFSET 20""")
def s1_search(s: SparkSession, d: str) -> DataFrame:
    scope = load(s, d, "knowledgebases").where("permission = 'team'").select(F.col("id").alias("kb_id")).distinct()
    rows = P.store_filter(load(s, d, "chunks"), {"available": 1, "doc_id": [], "docnm_kwd": ""}).where(F.lower("doc_type") == "pdf")
    return rows.join(scope, "kb_id", "left_semi").select("chunk_id", "doc_id", "docnm_kwd").distinct().orderBy("chunk_id").offset(20).limit(50)


@query("SELECT id, docnm_kwd, size_bytes FROM source_documents WHERE id = (SELECT min(id) FROM source_documents) GROUP BY ALL")
def s2_get(s: SparkSession, d: str) -> DataFrame:
    rows = load(s, d, "source_documents")
    first = rows.agg(F.min("id").alias("id"))
    return rows.join(F.broadcast(first), "id", "left_semi").select("id", "docnm_kwd", "size_bytes").limit(1)


@query("SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 100 OFFSET 10000")
def s3_search_after(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice").orderBy("o_orderdate", "o_orderkey").offset(10_000).limit(100)


@query(f"""SELECT doc_id, chunk_id, round(coalesce(list_avg(page_num), 0), 6) AS page, round(coalesce(list_avg(top), 0), 6) AS place FROM {LATEST_CHUNKS}""")
def s4_chunk_list(s: SparkSession, d: str) -> DataFrame:
    """Chunks of every document in position order: a range-partitioned sort, no task holds a whole document."""
    mean = lambda c: F.round(F.coalesce(F.aggregate(c, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(c), F.lit(0)), F.lit(0.0)), 6)
    rows = chunks_now(s, d, "chunk_id", "doc_id", "page_num", "top")
    return rows.select("doc_id", "chunk_id", mean("page_num").alias("page"), mean("top").alias("place")).orderBy("doc_id", "page", "place", "chunk_id")


@query(f"SELECT chunk_id, available, created FROM {LATEST_CHUNKS}")
def s5_upsert_latest(s: SparkSession, d: str) -> DataFrame:
    return chunks_now(s, d, "chunk_id", "available", "created")


@query("""SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_totalprice >= 1000 AND o_totalprice <= 50000""")
def s6_model_scan(s: SparkSession, d: str) -> DataFrame:
    rows = P.model_filter(load(s, d, "orders"), o_orderstatus=["F", "O"], o_totalprice=[1000.0, 50000.0])
    return rows.select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("""SELECT p_partkey, p_name, p_size FROM part WHERE p_size > 10 AND p_size <= 40 AND lower(p_name) LIKE '%a%' AND p_brand <> 'Brand#11'""")
def s7_predicate_tree(s: SparkSession, d: str) -> DataFrame:
    tree = P.predicate_tree([("p_size", ">", 10), ("p_size", "<=", 40), ("p_name", "**", "A"), ("p_brand", "!=", "Brand#11")])
    return load(s, d, "part").where(tree).select("p_partkey", "p_name", "p_size")


@query(f"""WITH old AS {FILES}, new AS (SELECT id, chunk_num + 1 AS chunk_num, create_time + 1 AS create_time FROM old WHERE suffix = 'pdf')
           SELECT o.id, coalesce(n.chunk_num, o.chunk_num) AS chunk_num, o.create_time FROM old o LEFT JOIN new n ON n.id = o.id""")
def s8_bulk_upsert(s: SparkSession, d: str) -> DataFrame:
    old = files(s, d).select("id", "chunk_num", "create_time")
    new = files(s, d).where("suffix = 'pdf'").select("id", (F.col("chunk_num") + 1).alias("chunk_num"), (F.col("create_time") + 1).alias("create_time"))
    return R.upsert(old, new, ["id"], preserve=["create_time"])


@query("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderpriority LIKE '1%' GROUP BY 1")
def s23_sql_passthrough(s: SparkSession, d: str) -> DataFrame:
    statement = "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {orders} WHERE o_orderpriority LIKE '1%' GROUP BY o_orderstatus"
    return s.sql(statement, orders=load(s, d, "orders"))


# filters -------------------------------------------------------------------------------------------------------------


@query(f"SELECT chunk_id FROM {LATEST_CHUNKS} WHERE list_has_any(tags, ['audit', 'safety'])")
def f2_terms_array(s: SparkSession, d: str) -> DataFrame:
    return P.store_filter(chunks_now(s, d, "chunk_id", "tags"), {"tags": ["audit", "safety"], "chunk_id": []}).select("chunk_id")


@query(f"SELECT chunk_id, coalesce(available, 1) >= 1 AS usable FROM {LATEST_CHUNKS}")
def f4_available(s: SparkSession, d: str) -> DataFrame:
    return chunks_now(s, d, "chunk_id", "available").select("chunk_id", (F.coalesce("available", F.lit(1)) >= 1).alias("usable"))


@query(f"SELECT chunk_id FROM {LATEST_CHUNKS} WHERE mom_id IS NULL AND tag_feas IS NULL")
def f5_must_not_exist(s: SparkSession, d: str) -> DataFrame:
    rows = R.latest(load(s, d, "chunks").select("chunk_id", "created", "available", "mom_id", F.to_json("tag_feas").alias("tag_feas")), ["chunk_id"], ["created", "available"])
    return P.store_filter(rows, {"must_not": ["mom_id", "tag_feas"]}).select("chunk_id")


@query(f"""SELECT c.chunk_id FROM {LATEST_CHUNKS} c WHERE EXISTS (SELECT 1 FROM source_documents f WHERE f.id = c.doc_id AND f.kb_id = c.kb_id
           AND (f.active_chunk_set_id = c.chunk_set_id OR (f.active_chunk_set_id IS NULL AND c.chunk_set_id IS NULL)))""")
def f7_active_scope(s: SparkSession, d: str) -> DataFrame:
    rows = chunks_now(s, d, "chunk_id", "doc_id", "kb_id", "chunk_set_id")
    active = files(s, d).select(F.col("id").alias("doc_id"), "kb_id", F.col("active_chunk_set_id").alias("active")).distinct()
    same = [rows["doc_id"] == active["doc_id"], rows["kb_id"] == active["kb_id"], rows["chunk_set_id"].eqNullSafe(active["active"])]
    return rows.join(active, same, "left_semi").select("chunk_id")


def _eav(s: SparkSession, d: str) -> DataFrame:
    """(doc_id, key, value) of the documents' attributes, one row for each."""
    docs = load(s, d, "documents")
    pairs = F.array(
        F.struct(F.lit("lang").alias("key"), F.col("lang").alias("value")),
        F.struct(F.lit("source").alias("key"), F.col("source").alias("value")),
        F.struct(F.lit("doc_type").alias("key"), F.col("doc_type").alias("value")),
        F.struct(F.lit("n_chars").alias("key"), F.col("n_chars").cast("string").alias("value")),
        F.struct(F.lit("created").alias("key"), F.date_format("created_at", "yyyy-MM-dd").alias("value")),
    )
    return docs.select("doc_id", F.inline(pairs)).where("value is not null")


_EAV = """eav AS (SELECT doc_id, unnest(['lang', 'source', 'doc_type', 'n_chars', 'created']) AS key,
  unnest([lang, source, doc_type, CAST(n_chars AS VARCHAR), strftime(created_at, '%Y-%m-%d')]) AS value FROM documents), e AS (SELECT * FROM eav WHERE value IS NOT NULL)"""

#: name -> (filters, logic, condition of DuckDB over e for each filter)
_METADATA = {
    "f8_eq": ([("source", "=", "Manual")], "and", ["key = 'source' AND lower(value) = 'manual'"]),
    "f8_ne": ([("lang", "≠", "en")], "and", ["key = 'lang' AND lower(value) <> 'en'"]),
    "f8_gt": ([("n_chars", ">", 900)], "and", ["key = 'n_chars' AND CAST(value AS DOUBLE) > 900"]),
    "f8_lt": ([("n_chars", "<", "300")], "and", ["key = 'n_chars' AND CAST(value AS DOUBLE) < 300"]),
    "f8_ge_date": ([("created", ">=", "2024-01-15")], "and", ["key = 'created' AND value >= '2024-01-15'"]),
    "f8_le_date": ([("created", "≤", "2023-12-31")], "and", ["key = 'created' AND value <= '2023-12-31'"]),
    "f8_in_string": ([("lang", "in", "en,fr")], "and", ["key = 'lang' AND contains('en,fr', lower(value))"]),
    "f8_in_list": ([("source", "in", ["Report", "minutes"])], "and", ["key = 'source' AND lower(value) IN ('report', 'minutes')"]),
    "f8_not_in": ([("source", "not in", ["manual"])], "and", ["key = 'source' AND lower(value) NOT IN ('manual')"]),
    "f8_contains": ([("source", "contains", "note")], "and", ["key = 'source' AND contains(lower(value), 'note')"]),
    "f8_not_contains": ([("doc_type", "not contains", "x")], "and", ["key = 'doc_type' AND NOT contains(lower(value), 'x')"]),
    "f8_start_with": ([("doc_type", "start with", "p")], "and", ["key = 'doc_type' AND starts_with(lower(value), 'p')"]),
    "f8_end_with": ([("doc_type", "end with", "x")], "and", ["key = 'doc_type' AND suffix(lower(value), 'x')"]),
    "f8_empty": ([("source", "empty", None)], "and", ["key = 'source' AND value = ''"]),
    "f8_not_empty": ([("source", "not empty", None)], "and", ["key = 'source' AND value <> ''"]),
    "f8_and": ([("lang", "=", "en"), ("n_chars", ">", 500), ("doc_type", "≠", "pdf")], "and", ["key = 'lang' AND lower(value) = 'en'", "key = 'n_chars' AND CAST(value AS DOUBLE) > 500", "key = 'doc_type' AND lower(value) <> 'pdf'"]),
    "f8_or": ([("lang", "is", "ja"), ("source", "=", "scan")], "or", ["key = 'lang' AND lower(value) = 'ja'", "key = 'source' AND lower(value) = 'scan'"]),
}


def _metadata_query(filters: list, logic: str):
    return lambda s, d: P.metadata_filter(_eav(s, d), filters, logic)


for _name, (_filters, _logic, _tests) in _METADATA.items():
    QUERIES[_name] = _metadata_query(_filters, _logic)
    _sets = [f"SELECT DISTINCT doc_id FROM e WHERE {t.replace('CAST(value AS DOUBLE)', 'TRY_CAST(value AS DOUBLE)')}" for t in _tests]
    SQL[_name] = f"WITH {_EAV} " + (" INTERSECT " if _logic == "and" else " UNION ").join(_sets)


@query("SELECT p_partkey FROM part WHERE lower(p_name) LIKE '%re%'")
def f12_substring(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "part").where(F.lower("p_name").contains("re")).select("p_partkey")


@query(f"SELECT id FROM {FILES} WHERE run_state IN ('1', '3') AND lower(suffix) IN ('pdf', 'docx') AND id NOT IN (SELECT document_id FROM membership WHERE document_id IS NOT NULL)")
def f13_list_filters(s: SparkSession, d: str) -> DataFrame:
    rows = files(s, d).where(F.col("run_state").isin("1", "3") & F.lower("suffix").isin("pdf", "docx"))
    placed = load(s, d, "membership").select(F.col("document_id").alias("id"))
    return rows.join(placed, "id", "left_anti").select("id")


@query(f"SELECT id, create_time FROM {FILES} WHERE create_time >= 1700000000000 AND create_time < 1735689600000 ORDER BY create_time, id LIMIT 30")
def f14_create_range(s: SparkSession, d: str) -> DataFrame:
    rows = files(s, d).where(F.col("create_time").between(1_700_000_000_000, 1_735_689_599_999)).select("id", "create_time")
    return R.page(rows, [F.col("create_time"), F.col("id")], 1, None)


@query("""SELECT id, tenant_id = (SELECT min(tenant_id) FROM knowledgebases) AS own FROM knowledgebases
          WHERE kb_status = '1' AND (permission = 'team' OR tenant_id = (SELECT min(tenant_id) FROM knowledgebases))""")
def f15_visible(s: SparkSession, d: str) -> DataFrame:
    rows = load(s, d, "knowledgebases")
    me = rows.agg(F.min("tenant_id").alias("me"))
    own = F.col("tenant_id") == F.col("me")
    return rows.join(F.broadcast(me)).where((F.col("kb_status") == "1") & ((F.col("permission") == "team") | own)).select("id", own.alias("own"))


@query(f"""SELECT id FROM {FILES} f WHERE (progress > 0 AND progress < 1) OR run_state = '1'
           OR (progress = 0 AND EXISTS (SELECT 1 FROM chunks c WHERE c.doc_id = f.id))""")
def f16_unfinished(s: SparkSession, d: str) -> DataFrame:
    chunked = load(s, d, "chunks").select(F.col("doc_id").alias("id")).distinct().withColumn("chunked", F.lit(True))
    rows = files(s, d).join(chunked, "id", "left")
    test = ((F.col("progress") > 0) & (F.col("progress") < 1)) | (F.col("run_state") == "1") | ((F.col("progress") == 0) & F.coalesce("chunked", F.lit(False)))
    return rows.where(test).select("id")


@query("""SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-09 23:59:59'""")
def f18_date_bounds(s: SparkSession, d: str) -> DataFrame:
    low, high = F.to_timestamp(F.lit("2024-01-05")), F.to_timestamp(F.lit(P.inclusive_end("2024-01-09")))
    return load(s, d, "events").where((F.col("ts") >= low) & (F.col("ts") <= high)).select("event_id")


@query(r"""SELECT DISTINCT change_no FROM pending WHERE lower(path) LIKE '%.pdf' AND NOT starts_with(regexp_extract(path, '[^/\\]*$'), '~$')""")
def f19_path_suffix(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "pending").where(P.path_filter(F.col("path"), ".pdf")).select("change_no").distinct()


@query("""SELECT change_no FROM pending WHERE lower(path_key) = 'finance' OR starts_with(lower(path_key), 'finance/')""")
def f20_subtree(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "pending").where(P.below(F.col("path_key"), "Finance/")).select("change_no")


@query(f"""WITH {_EAV} SELECT doc_id FROM e GROUP BY 1 HAVING bool_or(key = 'lang' AND value IN ('en', 'fr')) AND bool_or(key = 'doc_type' AND value IN ('pdf', 'txt'))""")
def f21_ui_equality(s: SparkSession, d: str) -> DataFrame:
    return P.any_within_key(_eav(s, d), {"lang": ["en", "fr"], "doc_type": ["pdf", "txt"], "source": []})


# joins ---------------------------------------------------------------------------------------------------------------


@query("""SELECT o.o_orderkey, c.c_name, n.n_name FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey
          WHERE o.o_orderstatus = 'F'""")
def j1_listing(s: SparkSession, d: str) -> DataFrame:
    o, c, n = load(s, d, "orders"), load(s, d, "customer"), load(s, d, "nation")
    rows = o.where("o_orderstatus = 'F'").join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"], "left")
    return rows.select("o_orderkey", "c_name", "n_name")


@query(f"""SELECT DISTINCT f.id, m.folder_id, t.display_name FROM {FILES} f JOIN membership m ON m.document_id = f.id
           LEFT JOIN (SELECT DISTINCT id, display_name FROM docmind_folder) t ON t.id = m.folder_id""")
def j2_placed_files(s: SparkSession, d: str) -> DataFrame:
    f, m = files(s, d).select("id"), load(s, d, "membership").select("folder_id", "document_id").distinct()
    t = load(s, d, "docmind_folder").select(F.col("id").alias("folder"), "display_name").distinct()
    return f.join(m, f["id"] == m["document_id"]).join(t, m["folder_id"] == t["folder"], "left").select("id", "folder_id", "display_name").distinct()


@query(f"""SELECT k.tenant_id, count(*) AS files, sum(f.token_num) AS tokens FROM {FILES} f JOIN knowledgebases k ON k.id = f.kb_id GROUP BY 1""")
def j3_tenant_chain(s: SparkSession, d: str) -> DataFrame:
    f, k = files(s, d), load(s, d, "knowledgebases").select(F.col("id").alias("kb"), "tenant_id")
    return f.join(k, f["kb_id"] == k["kb"]).groupBy("tenant_id").agg(F.count(F.lit(1)).alias("files"), F.sum("token_num").alias("tokens"))


@query("""SELECT l.l_orderkey, l.l_linenumber FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey AND l.l_shipdate > o.o_orderdate AND o.o_totalprice < 20000""")
def j4_compound(s: SparkSession, d: str) -> DataFrame:
    l, o = load(s, d, "lineitem"), load(s, d, "orders")  # noqa: E741
    on = (l["l_orderkey"] == o["o_orderkey"]) & (l["l_shipdate"] > o["o_orderdate"]) & (o["o_totalprice"] < 20000)
    return l.join(o, on).select("l_orderkey", "l_linenumber")


@query("SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')")
def j6_semi(s: SparkSession, d: str) -> DataFrame:
    o = load(s, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return load(s, d, "customer").join(o, "c_custkey", "left_semi").select("c_custkey")


@query(f"""SELECT f.id FROM {FILES} f WHERE NOT EXISTS (SELECT 1 FROM membership m WHERE m.document_id = f.id
           OR (m.captured_content_hash IS NOT NULL AND m.captured_content_hash = f.content_hash))""")
def j7_anti_or(s: SparkSession, d: str) -> DataFrame:
    """Two anti-joins in a row: an OR inside NOT EXISTS would be a nested loop."""
    m = load(s, d, "membership")
    f = files(s, d).join(m.select(F.col("document_id").alias("id")), "id", "left_anti")
    return f.join(m.where("captured_content_hash is not null").select(F.col("captured_content_hash").alias("content_hash")), "content_hash", "left_anti").select("id")


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)")
def j8_not_in(s: SparkSession, d: str) -> DataFrame:
    l = load(s, d, "lineitem").where("l_quantity > 49").select(F.col("l_suppkey").alias("s_suppkey"))  # noqa: E741
    return load(s, d, "supplier").join(l, "s_suppkey", "left_anti").select("s_suppkey")


@query(f"""SELECT f.id, coalesce(k.kb_name, '') AS kb_name, coalesce(x.n, 0) AS chunks FROM {FILES} f LEFT JOIN knowledgebases k ON k.id = f.kb_id
           LEFT JOIN (SELECT doc_id, count(DISTINCT chunk_id) AS n FROM chunks GROUP BY 1) x ON x.doc_id = f.id""")
def j10_enrich(s: SparkSession, d: str) -> DataFrame:
    n = load(s, d, "chunks").groupBy("doc_id").agg(F.countDistinct("chunk_id").alias("n"))
    k = load(s, d, "knowledgebases").select(F.col("id").alias("kb_id"), "kb_name")
    rows = files(s, d).join(k, "kb_id", "left").join(n, F.col("id") == n["doc_id"], "left")
    return rows.select("id", F.coalesce("kb_name", F.lit("")).alias("kb_name"), F.coalesce("n", F.lit(0)).alias("chunks"))


@query("SELECT DISTINCT chunk_id FROM chunks c WHERE EXISTS (SELECT 1 FROM source_documents f WHERE f.id = c.doc_id)")
def j11_stale_hits(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "chunks").join(load(s, d, "source_documents").select(F.col("id").alias("doc_id")), "doc_id", "left_semi").select("chunk_id").distinct()


@query(f"""WITH c AS (SELECT chunk_id, doc_id, chunk_order, page_num FROM {LATEST_CHUNKS} WHERE chunk_order IS NOT NULL),
  u AS (SELECT doc_id, chunk_order, min(chunk_id) AS chunk_id FROM c GROUP BY 1, 2),
  i AS (SELECT *, chunk_order - row_number() OVER (PARTITION BY doc_id ORDER BY chunk_order) AS island FROM u)
  SELECT a.chunk_id AS seed, b.chunk_id, b.chunk_order - a.chunk_order AS distance FROM i a JOIN i b ON a.doc_id = b.doc_id AND a.island = b.island
  AND abs(a.chunk_order - b.chunk_order) <= 2""")
def j12_neighbours(s: SparkSession, d: str) -> DataFrame:
    rows = chunks_now(s, d, "chunk_id", "doc_id", "chunk_order").where("chunk_order is not null").groupBy("doc_id", "chunk_order").agg(F.min("chunk_id").alias("chunk_id"))
    return R.neighbours(rows, rows, ["doc_id"], "chunk_order", "chunk_id", 2)


@query(f"""WITH c AS (SELECT chunk_id, mom_id, length(content) AS n FROM {LATEST_CHUNKS})
  SELECT a.mom_id, count(*) AS children, sum(coalesce(a.n, 0)) AS chars, max(p.chunk_id) IS NOT NULL AS has_parent FROM c a LEFT JOIN c p ON p.chunk_id = a.mom_id
  WHERE a.mom_id IS NOT NULL GROUP BY 1""")
def j13_parents(s: SparkSession, d: str) -> DataFrame:
    rows = chunks_now(s, d, "chunk_id", "mom_id", "content")
    children = rows.where("mom_id is not null").groupBy("mom_id").agg(F.count(F.lit(1)).alias("children"), F.sum(F.coalesce(F.length("content"), F.lit(0))).alias("chars"))
    p = rows.select(F.col("chunk_id").alias("parent"))
    return children.join(p, children["mom_id"] == p["parent"], "left").select("mom_id", "children", "chars", F.col("parent").isNotNull().alias("has_parent"))


@query(f"""SELECT c.chunk_id, f.active_chunk_set_id IS NOT DISTINCT FROM c.chunk_set_id AS current FROM {LATEST_CHUNKS} c JOIN {FILES} f ON f.id = c.doc_id""")
def j14_version_check(s: SparkSession, d: str) -> DataFrame:
    c, f = chunks_now(s, d, "chunk_id", "doc_id", "chunk_set_id"), files(s, d).select("id", "active_chunk_set_id")
    return c.join(f, c["doc_id"] == f["id"]).select("chunk_id", F.col("active_chunk_set_id").eqNullSafe(F.col("chunk_set_id")).alias("current"))


def _snapshots(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two states of a tree made from the parts: some changed, some gone, some new, some renamed."""
    p = load(s, d, "part").select("p_partkey", F.concat(F.col("p_name"), F.lit("#"), F.col("p_partkey")).alias("path"), F.sha2(F.concat_ws("|", "p_name", "p_brand", "p_partkey"), 256).alias("digest"))
    k = F.col("p_partkey")
    old = p.where(k % 7 != 0)
    new = p.where(k % 11 != 0).select("p_partkey", F.when(k % 13 == 0, F.concat("path", F.lit("~"))).otherwise(F.col("path")).alias("path"), F.when(k % 5 == 0, F.sha2(F.concat("digest", F.lit("x")), 256)).otherwise(F.col("digest")).alias("digest"))
    return old, new


@query("""WITH p AS (SELECT p_partkey AS k, p_name || '#' || p_partkey AS path, sha256(p_name || '|' || p_brand || '|' || p_partkey) AS digest FROM part),
  o AS (SELECT * FROM p WHERE k % 7 <> 0),
  n AS (SELECT k, CASE WHEN k % 13 = 0 THEN path || '~' ELSE path END AS path, CASE WHEN k % 5 = 0 THEN sha256(digest || 'x') ELSE digest END AS digest FROM p WHERE k % 11 <> 0),
  c AS (SELECT coalesce(n.path, o.path) AS path, coalesce(n.digest, o.digest) AS digest,
        CASE WHEN o.path IS NULL THEN 'add' WHEN n.path IS NULL THEN 'delete' WHEN o.digest <> n.digest THEN 'modify' END AS change FROM o FULL JOIN n ON o.path = n.path),
  d AS (SELECT digest, count(*) FILTER (change = 'add') AS a, count(*) FILTER (change = 'delete') AS b, max(path) FILTER (change = 'delete') AS old_path FROM c GROUP BY 1)
  SELECT c.path, CASE WHEN d.a = 1 AND d.b = 1 AND c.change = 'add' THEN 'rename' ELSE c.change END AS change, CASE WHEN d.a = 1 AND d.b = 1 AND c.change = 'add' THEN d.old_path END AS old_path
  FROM c JOIN d USING (digest) WHERE c.change IS NOT NULL AND NOT (d.a = 1 AND d.b = 1 AND c.change = 'delete')""")
def j15_diff(s: SparkSession, d: str) -> DataFrame:
    old, new = _snapshots(s, d)
    return R.diff(old, new, "path", "digest")


@query("""WITH a AS (SELECT DISTINCT o_custkey AS k, 1 AS live FROM orders WHERE o_orderstatus = 'O'), b AS (SELECT DISTINCT o_custkey AS k, 1 AS kept FROM orders WHERE o_orderstatus = 'F')
  SELECT coalesce(a.k, b.k) AS custkey, CASE WHEN b.k IS NULL THEN 'live only' WHEN a.k IS NULL THEN 'committed only' ELSE 'both' END AS state FROM a FULL JOIN b ON a.k = b.k""")
def j16_live_diff(s: SparkSession, d: str) -> DataFrame:
    o = load(s, d, "orders")
    a, b = (o.where(F.col("o_orderstatus") == v).select(F.col("o_custkey").alias(c)).distinct() for v, c in (("O", "a"), ("F", "b")))
    state = F.when(F.col("b").isNull(), "live only").when(F.col("a").isNull(), "committed only").otherwise("both")
    return a.join(b, F.col("a") == F.col("b"), "full_outer").select(F.coalesce("a", "b").alias("custkey"), state.alias("state"))


@query("""WITH RECURSIVE e AS (SELECT 'r' || n_regionkey AS p, 'n' || n_nationkey AS c FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer),
  t AS (SELECT p AS ancestor, c AS descendant FROM e UNION SELECT t.ancestor, e.c FROM t JOIN e ON e.p = t.descendant)
  SELECT ancestor, count(*) AS n FROM t GROUP BY 1""")
def j17_tree(s: SparkSession, d: str) -> DataFrame:
    n = load(s, d, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("p"), F.concat(F.lit("n"), "n_nationkey").alias("c"))
    c = load(s, d, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("p"), F.concat(F.lit("c"), "c_custkey").alias("c"))
    return R.closure(n.unionByName(c), "p", "c").groupBy("ancestor").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH f AS (SELECT content_hash AS h, count(*) AS n, min(id) AS id FROM {FILES} WHERE content_hash IS NOT NULL GROUP BY 1), m AS (SELECT DISTINCT folder_id, document_id, captured_content_hash AS h FROM membership),
  x AS (SELECT m.*, coalesce(f.n, 0) AS n, f.id FROM m LEFT JOIN f ON f.h = m.h), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY folder_id, document_id) AS rn FROM x)
  SELECT folder_id, document_id, CASE WHEN n = 0 THEN 'missing' WHEN n > 1 THEN 'ambiguous' WHEN rn > 1 THEN 'duplicate' ELSE 'mapped' END AS outcome FROM r""")
def j21_classify_match(s: SparkSession, d: str) -> DataFrame:
    f = files(s, d).where("content_hash is not null").groupBy(F.col("content_hash").alias("h")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
    m = load(s, d, "membership").select("folder_id", "document_id", "captured_content_hash").distinct()
    rows = m.join(f, m["captured_content_hash"] == f["h"], "left")
    first = rows.where("n = 1").groupBy("id").agg(F.min(F.struct("folder_id", "document_id")).alias("first"))
    rows = rows.join(first, "id", "left")
    outcome = F.when(F.coalesce("n", F.lit(0)) == 0, "missing").when(F.col("n") > 1, "ambiguous").when(F.struct("folder_id", "document_id").eqNullSafe(F.col("first")), "mapped").otherwise("duplicate")
    return rows.select("folder_id", "document_id", outcome.alias("outcome"))


@query(f"""SELECT c.chunk_id, f.suffix, json_extract_string(c.metadata, '$.lang') AS lang FROM {LATEST_CHUNKS} c LEFT JOIN {FILES} f ON f.id = c.doc_id WHERE c.metadata IS NOT NULL""")
def j22_metadata_join(s: SparkSession, d: str) -> DataFrame:
    c, f = chunks_now(s, d, "chunk_id", "doc_id", "metadata").where("metadata is not null"), files(s, d).select("id", "suffix")
    return c.join(f, c["doc_id"] == f["id"], "left").select("chunk_id", "suffix", F.get_json_object("metadata", "$.lang").alias("lang"))


@query("""WITH l AS (SELECT l_orderkey, max(l_shipdate) AS last FROM lineitem GROUP BY 1) SELECT o.o_orderkey, o.o_orderstatus, l.last FROM orders o LEFT JOIN l ON l.l_orderkey = o.o_orderkey""")
def j23_latest_measurement(s: SparkSession, d: str) -> DataFrame:
    l = load(s, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last"))  # noqa: E741
    o = load(s, d, "orders")
    return o.join(l, o["o_orderkey"] == l["l_orderkey"], "left").select("o_orderkey", "o_orderstatus", "last")


# aggregations --------------------------------------------------------------------------------------------------------


@query(f"SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM {LATEST_CHUNKS}) GROUP BY 1")
def a1_terms(s: SparkSession, d: str) -> DataFrame:
    return chunks_now(s, d, "chunk_id", "tags").select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O", count(*) FILTER (o_orderstatus = 'P') AS "P" FROM orders GROUP BY 1""")
def a2_status_pivot(s: SparkSession, d: str) -> DataFrame:
    return R.status_pivot(load(s, d, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("""SELECT o_custkey, coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END), 0) AS done, coalesce(sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END), 0) AS open,
  round(coalesce(sum(CASE WHEN o_totalprice > 100000 THEN o_totalprice END), 0), 2) AS large FROM orders GROUP BY 1""")
def a3_conditional_sums(s: SparkSession, d: str) -> DataFrame:
    large = F.round(F.coalesce(F.sum(F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice"))), F.lit(0.0)), 2)
    return load(s, d, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count_if(F.col("o_orderstatus") == "O").alias("open"), large.alias("large"))


@query(f"SELECT kb_id, coalesce(sum(size_bytes), 0) AS bytes FROM {FILES} WHERE doc_status = '1' GROUP BY 1")
def a4_sum_size(s: SparkSession, d: str) -> DataFrame:
    return files(s, d).where("doc_status = '1'").groupBy("kb_id").agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))


@query("""SELECT date_trunc('day', ts) AS day, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 4) AS total, round(avg(value), 9) AS mean FROM events GROUP BY 1""")
def a5_daily_stats(s: SparkSession, d: str) -> DataFrame:
    total, mean = F.round(F.sum("value"), 4), F.round(F.avg("value"), 9)
    return load(s, d, "events").groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"), total.alias("total"), mean.alias("mean"))


@query(f"SELECT created_by, count(*) AS files, min(docnm_kwd) AS first_name FROM {FILES} GROUP BY 1")
def a6_by_owner(s: SparkSession, d: str) -> DataFrame:
    return files(s, d).groupBy("created_by").agg(F.count(F.lit(1)).alias("files"), F.min("docnm_kwd").alias("first_name"))


@query("SELECT chunk_id, count(*) AS n FROM chunks GROUP BY 1 HAVING count(*) > 1")
def a7_having(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "chunks").groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("""SELECT l_orderkey, count(*) AS n, min(l_linenumber) AS low, max(l_linenumber) AS high, sum(l_linenumber) AS total,
  min(l_linenumber) = 1 AND max(l_linenumber) = count(*) AND sum(l_linenumber) = count(*) * (count(*) + 1) // 2 AS complete FROM lineitem GROUP BY 1""")
def a8_complete(s: SparkSession, d: str) -> DataFrame:
    g = load(s, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.min("l_linenumber").alias("low"), F.max("l_linenumber").alias("high"), F.sum("l_linenumber").alias("total"))
    return g.withColumn("complete", F.expr("low = 1 and high = n and total = n * (n + 1) div 2"))


@query("SELECT folder_id, max(ordinal) AS top FROM membership GROUP BY 1")
def a9_max_ordinal(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "membership").groupBy("folder_id").agg(F.max("ordinal").alias("top"))


@query("""SELECT facet, value, count(*) AS n FROM (SELECT unnest(['lang', 'source', 'doc_type']) AS facet, unnest([lang, source, doc_type]) AS value FROM documents) GROUP BY 1, 2""")
def a10_facets(s: SparkSession, d: str) -> DataFrame:
    return R.facets(load(s, d, "documents"), ["lang", "source", "doc_type"])


@query(f"""WITH {_EAV} SELECT key, value, n, kind FROM (SELECT key, value, count(*) AS n FROM e GROUP BY 1, 2) JOIN
  (SELECT key, CASE WHEN count(*) FILTER (regexp_full_match(value, '\\d+')) * 2 > count(*) THEN 'number' WHEN count(*) FILTER (regexp_full_match(value, '\\d{{4}}-\\d\\d-\\d\\d')) * 2 > count(*) THEN 'time' ELSE 'string' END AS kind FROM e GROUP BY 1) USING (key)""".replace("\\\\", "\\"))
def a11_metadata_summary(s: SparkSession, d: str) -> DataFrame:
    eav = _eav(s, d)
    counts = eav.groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"))
    share = lambda p: F.sum(F.when(F.col("value").rlike(p), F.col("n")).otherwise(0)) * 2 > F.sum("n")
    kinds = counts.groupBy("key").agg(F.when(share(r"^\d+$"), "number").when(share(r"^\d{4}-\d\d-\d\d$"), "time").otherwise("string").alias("kind"))
    return counts.join(F.broadcast(kinds), "key").select("key", "value", "n", "kind")


@query(f"WITH {_EAV}, n AS (SELECT key, value, count(*) AS docs FROM e GROUP BY 1, 2) SELECT key, value, doc_id, docs FROM e JOIN n USING (key, value) WHERE key IN ('lang', 'source')")
def a12_inverted(s: SparkSession, d: str) -> DataFrame:
    """The inverted table as rows, with the size of each list: a list of all documents of a language would be one row of a task."""
    rows = _eav(s, d).where("key in ('lang', 'source')")
    sizes = rows.groupBy("key", "value").agg(F.count(F.lit(1)).alias("docs"))
    return rows.join(sizes, ["key", "value"]).select("key", "value", "doc_id", "docs")


@query(f"SELECT DISTINCT unnest(json_keys(metadata)) AS key FROM {LATEST_CHUNKS} WHERE metadata IS NOT NULL")
def a13_metadata_keys(s: SparkSession, d: str) -> DataFrame:
    return chunks_now(s, d, "chunk_id", "metadata").select(F.explode(F.json_object_keys("metadata")).alias("key")).distinct()


@query(f"""WITH t AS (SELECT unnest(tags) AS tag, doc_id FROM {LATEST_CHUNKS}), n AS (SELECT count(*) AS total FROM t) SELECT tag, round((count(*) + 1) / (max(total) + 1000), 9) AS prior FROM t, n GROUP BY 1""")
def a15_tag_prior(s: SparkSession, d: str) -> DataFrame:
    counts = chunks_now(s, d, "chunk_id", "tags").select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))  # one row
    return counts.crossJoin(F.broadcast(total)).select("tag", F.round((F.col("n") + 1) / (F.col("total") + 1000), 9).alias("prior"))


@query(f"SELECT tag, sum(n) AS n, count(*) AS bases FROM (SELECT kb_id, tag, count(*) AS n FROM (SELECT kb_id, unnest(tags) AS tag FROM {LATEST_CHUNKS}) GROUP BY 1, 2) GROUP BY 1")
def a16_tag_merge(s: SparkSession, d: str) -> DataFrame:
    by_base = chunks_now(s, d, "chunk_id", "kb_id", "tags").select("kb_id", F.explode("tags").alias("tag")).groupBy("kb_id", "tag").agg(F.count(F.lit(1)).alias("n"))
    return by_base.groupBy("tag").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("bases"))


@query("""SELECT l_orderkey, round(sum(greatest(l_discount, 0)) / count(*), 6) AS progress, count(*) FILTER (l_returnflag = 'R') AS failed,
  CASE WHEN count(*) FILTER (l_returnflag = 'R') > 0 THEN 'fail' WHEN count(*) FILTER (l_linestatus = 'O') > 0 THEN 'running' ELSE 'done' END AS state,
  max(l_quantity) AS priority, list_sort(list(DISTINCT l_returnflag)) AS messages FROM lineitem GROUP BY 1""")
def a17_progress(s: SparkSession, d: str) -> DataFrame:
    failed, open_ = F.count_if(F.col("l_returnflag") == "R"), F.count_if(F.col("l_linestatus") == "O")
    return load(s, d, "lineitem").groupBy("l_orderkey").agg(
        F.round(F.sum(F.greatest("l_discount", F.lit(0.0))) / F.count(F.lit(1)), 6).alias("progress"), failed.alias("failed"),
        F.when(failed > 0, "fail").when(open_ > 0, "running").otherwise("done").alias("state"), F.max("l_quantity").alias("priority"), F.sort_array(F.collect_set("l_returnflag")).alias("messages"),
    )


@query(f"""SELECT column_name, value, row_number() OVER (PARTITION BY column_name ORDER BY first, value NULLS FIRST) AS place FROM
  (SELECT column_name, value, min(first) AS first FROM (SELECT unnest(['suffix', 'run_state']) AS column_name, unnest([suffix, run_state]) AS value, create_time AS first FROM {FILES}) GROUP BY 1, 2)""")
def a20_first_seen(s: SparkSession, d: str) -> DataFrame:
    pairs = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value")) for c in ("suffix", "run_state")))
    seen = files(s, d).select("create_time", F.inline(pairs)).groupBy("column_name", "value").agg(F.min("create_time").alias("first"))
    return seen.select("column_name", "value", F.row_number().over(W.partitionBy("column_name").orderBy("first", "value")).alias("place"))


@query("""SELECT l_shipdate_year, count(*) AS n, round(avg(v), 4) AS mean, quantile_disc(v, 0.5) AS p50, quantile_disc(v, 0.9) AS p90, quantile_disc(v, 0.95) AS p95 FROM
  (SELECT year(l_shipdate) AS l_shipdate_year, l_extendedprice AS v FROM lineitem) GROUP BY 1""")
def a22_nearest_rank(s: SparkSession, d: str) -> DataFrame:
    rows = load(s, d, "lineitem").select(F.year("l_shipdate").alias("l_shipdate_year"), F.col("l_extendedprice").alias("v"))
    sums = rows.groupBy("l_shipdate_year").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 4).alias("mean"))
    return sums.join(K.quantiles(rows, ["l_shipdate_year"], "v", {"p50": 0.5, "p90": 0.9, "p95": 0.95}, False), "l_shipdate_year")


@query(f"""WITH real AS (SELECT doc_id, count(*) AS chunks, sum(coalesce(length(content), 0)) AS chars FROM {LATEST_CHUNKS} GROUP BY 1)
  SELECT f.id, f.chunk_num, coalesce(r.chunks, 0) AS chunks, coalesce(r.chars, 0) AS chars, f.chunk_num IS DISTINCT FROM coalesce(r.chunks, 0) AS stale FROM {FILES} f LEFT JOIN real r ON r.doc_id = f.id""")
def a27_recount(s: SparkSession, d: str) -> DataFrame:
    real = chunks_now(s, d, "chunk_id", "doc_id", "content").groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.coalesce(F.length("content"), F.lit(0))).alias("chars"))
    f = files(s, d).select("id", "chunk_num").join(real, F.col("id") == real["doc_id"], "left")
    n = F.coalesce("chunks", F.lit(0))
    return f.select("id", "chunk_num", n.alias("chunks"), F.coalesce("chars", F.lit(0)).alias("chars"), (~F.col("chunk_num").eqNullSafe(n)).alias("stale"))


@query("""SELECT l_returnflag, l_linestatus, l_linenumber, year(l_shipdate) AS year, l_quantity > 25 AS large, count(*) AS n, round(sum(l_extendedprice), 2) AS total, round(min(l_extendedprice), 2) AS least, round(max(l_extendedprice), 2) AS most,
  round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95, round(sum(l_extendedprice) / sum(l_quantity), 6) AS per_unit FROM lineitem GROUP BY 1, 2, 3, 4, 5""")
def a28_interpolated(s: SparkSession, d: str) -> DataFrame:
    """A timing summary by five dimensions."""
    by = ["l_returnflag", "l_linestatus", "l_linenumber", "year", "large"]
    rows = load(s, d, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber", F.year("l_shipdate").alias("year"), (F.col("l_quantity") > 25).alias("large"), "l_extendedprice", "l_quantity")
    v = F.col("l_extendedprice")
    sums = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(v), 2).alias("total"), F.round(F.min(v), 2).alias("least"), F.round(F.max(v), 2).alias("most"), r6(F.sum(v) / F.sum("l_quantity"), "per_unit"))
    at = K.quantiles(rows, by, "l_extendedprice", {"p50": 0.5, "p90": 0.9, "p95": 0.95}, True)
    return sums.join(at, by).withColumns({c: F.round(c, 4) for c in ("p50", "p90", "p95")})


@query("""SELECT coalesce(o_orderpriority, 'all') AS category, count(*) AS n, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END), 6) AS hit, round(median(o_totalprice), 4) AS middle, max(o_totalprice) AS most
  FROM orders GROUP BY ROLLUP (o_orderpriority)""")
def a29_subtotals(s: SparkSession, d: str) -> DataFrame:
    hit = F.round(F.avg((F.col("o_orderstatus") == "F").cast("double")), 6)
    orders = load(s, d, "orders")
    sums = orders.rollup("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), hit.alias("hit"), F.max("o_totalprice").alias("most")).withColumn("category", F.coalesce("o_orderpriority", F.lit("all")))
    both = orders.select(F.explode(F.array("o_orderpriority", F.lit("all"))).alias("category"), "o_totalprice")
    return sums.join(K.quantiles(both, ["category"], "o_totalprice", {"middle": 0.5}, True), "category").select("category", "n", "hit", F.round("middle", 4).alias("middle"), "most")


# windows, sorting, paging --------------------------------------------------------------------------------------------


@query("SELECT vec_id, label, place FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY embedding[1] DESC, vec_id) AS place FROM embeddings) WHERE place <= 8")
def w2_per_document_cap(s: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("label").orderBy(F.desc(F.element_at("embedding", 1)), "vec_id")
    return load(s, d, "embeddings").withColumn("place", F.row_number().over(w)).where("place <= 8").select("vec_id", "label", "place")


@query("""WITH r AS (SELECT vec_id, label, embedding[1] AS score, row_number() OVER (PARTITION BY label ORDER BY embedding[1] DESC, vec_id) AS rn FROM embeddings),
  k AS (SELECT * FROM r ORDER BY rn > 8, score DESC, vec_id LIMIT 128) SELECT vec_id, label, row_number() OVER (ORDER BY score DESC, vec_id) AS place FROM k""")
def w3_refill(s: SparkSession, d: str) -> DataFrame:
    """The best eight of each label, then the best of the rest up to 128: no label is ranked as a whole."""
    rows = load(s, d, "embeddings").select("vec_id", "label", F.element_at("embedding", 1).alias("score"))
    capped = rows.withColumn("rn", F.row_number().over(W.partitionBy("label").orderBy(F.desc("score"), "vec_id"))).where("rn <= 8").drop("rn")
    best = [F.desc("score"), F.col("vec_id")]
    rest = rows.join(capped.select("vec_id"), "vec_id", "left_anti").orderBy(*best).limit(128).withColumn("late", F.lit(1)).select("vec_id", "label", "score", "late")
    kept = capped.orderBy(*best).limit(128).withColumn("late", F.lit(0)).unionByName(rest).orderBy("late", *best).limit(128)
    return kept.select("vec_id", "label", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("score"), "vec_id")).alias("place"))


@query("""SELECT l_orderkey, l_linenumber, greatest(l_quantity, coalesce(lead(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice), l_quantity)) AS pair FROM lineitem""")
def w6_bigram_weight(s: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return load(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.greatest("l_quantity", F.coalesce(F.lead("l_quantity").over(w), F.col("l_quantity"))).alias("pair"))


@query("""WITH x AS (SELECT o_custkey, o_orderkey, o_totalprice, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS run FROM orders)
  SELECT o_custkey, o_orderkey FROM x WHERE run - o_totalprice <= 0.97 * 500000""")
def w9_budget_prefix(s: SparkSession, d: str) -> DataFrame:
    """The row that overflows the budget is still taken."""
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(W.unboundedPreceding, 0)
    return load(s, d, "orders").withColumn("run", F.sum("o_totalprice").over(w)).where(F.col("run") - F.col("o_totalprice") <= 0.97 * 500000).select("o_custkey", "o_orderkey")


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order FROM orders GROUP BY 1")
def w11_latest(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("last_order"))


@query("""WITH m AS (SELECT *, min(value) OVER (PARTITION BY event_type) AS lo, max(value) OVER (PARTITION BY event_type) AS hi FROM events)
  SELECT event_id, round(CASE WHEN lo >= 0 AND hi <= 1 THEN value WHEN hi - lo < 0.001 THEN least(greatest(value, 0), 1) ELSE (value - lo) / (hi - lo) END, 6) AS score FROM m""")
def w12_min_max(s: SparkSession, d: str) -> DataFrame:
    """Bounds by aggregation and a small join: a window would sort whole batches."""
    e = load(s, d, "events").select("event_id", "event_type", "value")
    bounds = e.groupBy("event_type").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    score = F.when((F.col("lo") >= 0) & (F.col("hi") <= 1), F.col("value")).when(F.col("hi") - F.col("lo") < 0.001, F.least(F.greatest("value", F.lit(0.0)), F.lit(1.0))).otherwise((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    return e.join(bounds, "event_type").select("event_id", r6(score, "score"))


@query(f"""SELECT chunk_id, row_number() OVER (ORDER BY round(coalesce(list_avg(page_num), 0), 6), round(coalesce(list_avg(top), 0), 6), created DESC, chunk_id) AS place FROM {LATEST_CHUNKS} QUALIFY place <= 200""")
def t1_array_sort(s: SparkSession, d: str) -> DataFrame:
    mean = lambda c: F.round(F.coalesce(F.aggregate(c, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(c), F.lit(0)), F.lit(0.0)), 6)
    top = chunks_now(s, d, "chunk_id", "page_num", "top", "created").select("chunk_id", "created", mean("page_num").alias("p"), mean("top").alias("t")).orderBy("p", "t", F.desc("created"), "chunk_id").limit(200)
    return top.select("chunk_id", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("p", "t", F.desc("created"), "chunk_id")).alias("place"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100 OFFSET 200")
def t3_page(s: SparkSession, d: str) -> DataFrame:
    return R.page(load(s, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 3, 500)


@query("""WITH p AS (SELECT o_orderkey FROM orders WHERE o_orderkey > 1000 ORDER BY 1 LIMIT 51), r AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS rn, count(*) OVER () AS n FROM p)
  SELECT o_orderkey, CASE WHEN n > 50 THEN max(CASE WHEN rn = 50 THEN o_orderkey END) OVER () END AS next_cursor FROM r QUALIFY rn <= 50""")
def t4_keyset(s: SparkSession, d: str) -> DataFrame:
    return R.keyset_page(load(s, d, "orders").select("o_orderkey"), "o_orderkey", 1000, 50)


@query("SELECT vec_id, place FROM (SELECT vec_id, embedding[1] AS v, row_number() OVER (ORDER BY embedding[1] DESC, vec_id) AS place FROM embeddings) WHERE v >= 0.1 AND place <= 200")
def t6_threshold(s: SparkSession, d: str) -> DataFrame:
    v = F.element_at("embedding", 1)
    rows = load(s, d, "embeddings").select("vec_id", v.alias("v")).where("v >= 0.1").orderBy(F.desc("v"), "vec_id").limit(200)
    return rows.select("vec_id", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("v"), "vec_id")).alias("place"))


# sets and duplicates -------------------------------------------------------------------------------------------------


@query("(SELECT l_suppkey FROM lineitem WHERE l_quantity > 45 INTERSECT SELECT l_suppkey FROM lineitem WHERE l_discount = 0.1) UNION SELECT s_suppkey FROM supplier WHERE s_acctbal < 0")
def u1_id_sets(s: SparkSession, d: str) -> DataFrame:
    l = load(s, d, "lineitem")  # noqa: E741
    both = l.where("l_quantity > 45").select("l_suppkey").intersect(l.where("l_discount = 0.1").select("l_suppkey"))
    return both.union(load(s, d, "supplier").where("s_acctbal < 0").select("s_suppkey")).distinct()


@query(f"SELECT id FROM {FILES} EXCEPT SELECT doc_id FROM chunks")
def u3_difference(s: SparkSession, d: str) -> DataFrame:
    return files(s, d).select("id").exceptAll(load(s, d, "chunks").select(F.col("doc_id").alias("id")).distinct()).distinct()


@query(rf"""WITH k AS (SELECT chunk_id, doc_id, trim(regexp_replace(content, '\s+', ' ', 'g'), ' ') AS t FROM {LATEST_CHUNKS} WHERE content IS NOT NULL)
  SELECT doc_id, min(chunk_id) AS chunk_id, count(*) AS copies FROM k GROUP BY doc_id, t""")
def u5_content_dedup(s: SparkSession, d: str) -> DataFrame:
    rows = chunks_now(s, d, "chunk_id", "doc_id", "content").where("content is not null")
    text = F.trim(F.regexp_replace("content", r"[\t\n\x0B\f\r ]+", " "))
    return rows.groupBy("doc_id", F.sha2(text, 256).alias("t")).agg(F.min("chunk_id").alias("chunk_id"), F.count(F.lit(1)).alias("copies")).drop("t")


@query("SELECT DISTINCT c.c_mktsegment, n.n_name FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey")
def u9_distinct_join(s: SparkSession, d: str) -> DataFrame:
    c, n = load(s, d, "customer"), load(s, d, "nation")
    return c.join(n, c["c_nationkey"] == n["n_nationkey"]).select("c_mktsegment", "n_name").distinct()


@query("""WITH m AS (SELECT DISTINCT folder_id, document_id, sha256(document_id) AS h FROM membership WHERE document_id IS NOT NULL), o AS (SELECT document_id FROM m GROUP BY 1 HAVING count(*) > 1)
  SELECT folder_id, concat_ws('-', """ + ", ".join(f"CAST(sum(CAST('0x' || substr(h, {at}, 15) AS HUGEINT)) AS VARCHAR)" for at in (1, 16, 31, 46)) + """) AS digest, count(*) AS n, count(*) FILTER (document_id IN (SELECT document_id FROM o)) AS elsewhere FROM m GROUP BY 1""")
def u11_snapshot_digest(s: SparkSession, d: str) -> DataFrame:
    """A digest of each folder's set of documents that needs no order: four sums of 60-bit parts of the documents' hashes, added up on the
    map side; and how many of its documents are in another folder too."""
    m = load(s, d, "membership").where("document_id is not null").select("folder_id", "document_id").distinct()
    folders = m.groupBy("document_id").agg(F.count(F.lit(1)).alias("folders"))
    h = m.join(folders, "document_id").select("folder_id", "folders", F.sha2("document_id", 256).alias("h"))
    sums = [F.sum(F.conv(F.substring("h", at, 15), 16, 10).cast("decimal(38,0)")).cast("string") for at in (1, 16, 31, 46)]
    return h.groupBy("folder_id").agg(F.concat_ws("-", *sums).alias("digest"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("folders") > 1).alias("elsewhere"))


@query("SELECT tenant_id, count(DISTINCT embd_id) <= 1 AND count(*) = count(embd_id) AS same FROM knowledgebases GROUP BY 1")
def u12_same_model(s: SparkSession, d: str) -> DataFrame:
    same = (F.countDistinct("embd_id") <= 1) & (F.count(F.lit(1)) == F.count("embd_id"))
    return load(s, d, "knowledgebases").groupBy("tenant_id").agg(same.alias("same"))


# changes -------------------------------------------------------------------------------------------------------------


@query(f"""SELECT chunk_id, CASE WHEN lower(doc_type) = 'pdf' THEN list_distinct(list_concat(tags, ['paper'])) ELSE tags END AS tags, CASE WHEN doc_type IS NULL THEN 0 ELSE available END AS available
  FROM (SELECT chunk_id, doc_type, available, coalesce(tags, []) AS tags FROM {LATEST_CHUNKS})""")
def d1_update_by_query(s: SparkSession, d: str) -> DataFrame:
    rows = chunks_now(s, d, "chunk_id", "doc_type", "available", "tags").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    tags = F.when(F.lower("doc_type") == "pdf", F.array_sort(F.array_distinct(F.concat("tags", F.array(F.lit("paper")))))).otherwise(F.array_sort("tags"))
    return rows.select("chunk_id", tags.alias("tags"), F.when(F.col("doc_type").isNull(), 0).otherwise(F.col("available")).alias("available"))


SQL["d1_update_by_query"] = SQL["d1_update_by_query"].replace("THEN list_distinct(list_concat(tags, ['paper'])) ELSE tags END", "THEN list_sort(list_distinct(list_concat(tags, ['paper']))) ELSE list_sort(tags) END")


@query(f"SELECT chunk_id FROM {LATEST_CHUNKS} WHERE NOT coalesce(doc_id IN (SELECT id FROM source_documents WHERE doc_status = '0'), false)")
def d2_delete_by_query(s: SparkSession, d: str) -> DataFrame:
    gone = files(s, d).where("doc_status = '0'").select(F.col("id").alias("doc_id"))
    return chunks_now(s, d, "chunk_id", "doc_id").join(gone, "doc_id", "left_anti").select("chunk_id")


@query(f"""SELECT chunk_id, list_sort(list_distinct(list_filter(list_transform(coalesce(tags, []), lambda t: CASE WHEN t = 'audit' THEN 'inspection' ELSE t END), lambda t: t <> 'archive'))) AS tags FROM {LATEST_CHUNKS}""")
def d6_tag_rename(s: SparkSession, d: str) -> DataFrame:
    renamed = F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.when(t == "audit", "inspection").otherwise(t))
    return chunks_now(s, d, "chunk_id", "tags").select("chunk_id", F.array_sort(F.array_distinct(F.array_remove(renamed, "archive"))).alias("tags"))


@query("""WITH r AS (SELECT p_brand, p_partkey, p_retailprice AS w, 100 * p_retailprice / sum(p_retailprice) OVER (PARTITION BY p_brand) AS x FROM part),
  f AS (SELECT *, floor(x) AS fl, row_number() OVER (PARTITION BY p_brand ORDER BY round(x - floor(x), 9) DESC, p_partkey) AS rn, 100 - sum(floor(x)) OVER (PARTITION BY p_brand) AS rest FROM r)
  SELECT p_brand, p_partkey, CAST(fl + CASE WHEN rn <= rest THEN 1 ELSE 0 END AS BIGINT) AS share FROM f""")
def r30_apportion(s: SparkSession, d: str) -> DataFrame:
    return R.apportion(load(s, d, "part").select("p_brand", "p_partkey", "p_retailprice"), ["p_brand"], "p_retailprice", "p_partkey", 100).select("p_brand", "p_partkey", "share")


@query(f"""WITH done AS (SELECT DISTINCT source_id FROM pending WHERE generation > 0), live AS (SELECT DISTINCT source_id, path_key FROM pending WHERE path_key IS NOT NULL),
  scan AS (SELECT DISTINCT source_id, path_key FROM pending WHERE path_key IS NOT NULL AND lower(trim(kind)) <> 'delete' AND epoch = 1)
  SELECT source_id, path_key FROM live l WHERE EXISTS (SELECT 1 FROM done x WHERE x.source_id = l.source_id) AND NOT EXISTS (SELECT 1 FROM scan c WHERE c.source_id = l.source_id AND c.path_key = l.path_key)""")
def e7_missing_candidates(s: SparkSession, d: str) -> DataFrame:
    rows = load(s, d, "pending").where("path_key is not null")
    live = rows.select("source_id", "path_key").distinct()
    scan = rows.where((F.lower(F.trim("kind")) != "delete") & (F.col("epoch") == 1)).select("source_id", "path_key")
    complete = load(s, d, "pending").where("generation > 0").select("source_id")
    return live.join(complete, "source_id", "left_semi").join(scan, ["source_id", "path_key"], "left_anti").select("source_id", "path_key")
