"""Further queries: end-to-end search, lanes, scalars, metadata edits, incremental reuse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.operators import answers as N
from foliant.operators import chunking as C
from foliant.operators import hierarchy as H
from foliant.operators import pipeline as G
from foliant.operators import relational as R
from foliant.operators import retrieval as V
from foliant.operators import text as X
from foliant.plans.feed_queries import FOLDER_NODES
from foliant.plans.registry import Registry
from foliant.plans.retrieval_queries import _LEXICAL, _TOP
from foliant.plans.relational_queries import FILES, LATEST_CHUNKS, chunks_now, files
from foliant.sources.tables import load

_R = Registry()
query = _R.add
QUERIES, SQL = _R.queries, _R.sql


def r23_fused_search(s: SparkSession, d: str) -> DataFrame:
    """Every twentieth document's file name as a question to all documents: both lanes, fusion, caps, rerank, gate, groups."""
    docs = load(s, d, "documents")
    chunks = docs.select(F.col("doc_id").alias("key"), F.coalesce("docnm_kwd", F.lit("")).alias("document"), F.col("docnm_kwd").alias("name"), F.coalesce("text", F.lit("")).alias("content"))
    questions = docs.where("doc_id % 20 = 0 and docnm_kwd is not null").select(F.col("doc_id").alias("query"), F.regexp_replace("docnm_kwd", r"\.[^.\s]{1,8}$", "").alias("question"))
    return G.fused_search(questions, chunks)


def c18_embed(s: SparkSession, d: str) -> DataFrame:
    return G.embed(load(s, d, "documents"), "doc_id", "text", title="docnm_kwd").select("key", F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding"))


def _scope_sql(start: str) -> str:
    return f"""WITH RECURSIVE {FOLDER_NODES},
  sub AS ({start} UNION SELECT node.id FROM node JOIN sub ON node.parent = sub.id) SELECT DISTINCT document_id FROM membership WHERE folder_id IN (SELECT id FROM sub)"""


@query(_scope_sql("SELECT lower(trim(min(id))) AS id FROM docmind_folder WHERE parent_id IS NULL OR trim(parent_id) = ''"))
def r19_scope(s: SparkSession, d: str) -> DataFrame:
    folders = H.contract(load(s, d, "docmind_folder")).where("cycle_id is null")
    spark_root = load(s, d, "docmind_folder").where("parent_id is null or trim(parent_id) = ''").agg(F.min(F.lower(F.trim("id"))).alias("id")).first()["id"]
    return G.scope_documents(load(s, d, "membership"), folders, "folders", [spark_root])


@query(f"""WITH h AS (SELECT DISTINCT doc_id FROM chunks) SELECT m.folder_id, count(*) AS hits FROM (SELECT DISTINCT folder_id, document_id FROM membership) m JOIN h ON h.doc_id = m.document_id GROUP BY 1""")
def r20_scope_hits(s: SparkSession, d: str) -> DataFrame:
    """Hits by folder, guarded: every hit's document is one of the files."""
    hits = load(s, d, "chunks").select("doc_id").distinct()
    members = load(s, d, "membership").select("folder_id", "document_id").distinct()
    joined = members.join(hits, members["document_id"] == hits["doc_id"])
    G.guard_scope(joined, "doc_id", members.select("document_id").distinct())
    return joined.groupBy("folder_id").agg(F.count(F.lit(1)).alias("hits"))


@query("""WITH l AS (SELECT vec_id % 10 AS query, 'a' AS lane, vec_id AS key, CAST(embedding[1] AS DOUBLE) AS score FROM embeddings UNION ALL SELECT vec_id % 10, 'b', vec_id, CAST(embedding[2] AS DOUBLE) FROM embeddings)
  SELECT query, lane, key, row_number() OVER (PARTITION BY query, lane ORDER BY score DESC, key) AS place FROM l QUALIFY place <= 128""")
def w1_lane_ranks(s: SparkSession, d: str) -> DataFrame:
    e = load(s, d, "embeddings")
    lanes = F.inline(F.array(*(F.struct(F.lit(n).alias("lane"), F.element_at("embedding", i).cast("double").alias("score")) for n, i in (("a", 1), ("b", 2)))))
    return G.lane_ranks(e.select((F.col("vec_id") % 10).alias("query"), F.col("vec_id").alias("key"), lanes)).where("place <= 128")


@query("""WITH m AS (SELECT label % 3 AS q, max(embedding[1]) AS best FROM embeddings GROUP BY 1) SELECT e.vec_id, m.best < 0.5 AS weak FROM embeddings e JOIN m ON m.q = e.label % 3""")
def w5_best_score_gate(s: SparkSession, d: str) -> DataFrame:
    e = load(s, d, "embeddings").withColumn("q", F.col("label") % 3)
    best = e.groupBy("q").agg(F.max(F.element_at("embedding", 1)).alias("best"))
    return e.join(best, "q").select("vec_id", (F.col("best") < 0.5).alias("weak"))


@query(f"""WITH c AS (SELECT doc_id, chunk_order, min(chunk_id) AS chunk_id FROM {LATEST_CHUNKS} WHERE chunk_order IS NOT NULL GROUP BY 1, 2), g AS (SELECT *, chunk_order - row_number() OVER (PARTITION BY doc_id ORDER BY chunk_order) AS i FROM c)
  SELECT doc_id, min(chunk_order) AS first, max(chunk_order) AS last, count(*) AS n FROM g GROUP BY doc_id, i""")
def w7_islands(s: SparkSession, d: str) -> DataFrame:
    return R.runs(chunks_now(s, d, "chunk_id", "doc_id", "chunk_order"), ["doc_id"], "chunk_order")


@query("""SELECT l_orderkey, l_suppkey, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY min(l_linenumber), l_suppkey) AS place FROM lineitem GROUP BY 1, 2""")
def w13_first_seen(s: SparkSession, d: str) -> DataFrame:
    first = load(s, d, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.min("l_linenumber").alias("first"))
    return first.select("l_orderkey", "l_suppkey", F.dense_rank().over(W.partitionBy("l_orderkey").orderBy("first", "l_suppkey")).alias("place"))


@query(f"""SELECT doc_id, parse_run_id FROM (SELECT doc_id, parse_run_id, max(created) AS t FROM {LATEST_CHUNKS} WHERE parse_run_id IS NOT NULL GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY t DESC, parse_run_id DESC) = 1""")
def w10_latest_run(s: SparkSession, d: str) -> DataFrame:
    runs = chunks_now(s, d, "chunk_id", "doc_id", "parse_run_id", "created").where("parse_run_id is not null")
    return runs.groupBy("doc_id").agg(F.max_by("parse_run_id", F.struct("created", "parse_run_id")).alias("parse_run_id"))


@query(f"""SELECT mom_id, round(avg(length(coalesce(content, ''))), 6) AS mean, array_to_string(list_sort(list(chunk_id)), ',') AS children, list_sort(list_distinct(flatten(list(coalesce(important, []))))) AS keywords FROM {LATEST_CHUNKS} WHERE mom_id IS NOT NULL GROUP BY 1""")
def a19_children(s: SparkSession, d: str) -> DataFrame:
    rows = chunks_now(s, d, "chunk_id", "mom_id", "content", "important").where("mom_id is not null")
    keywords = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("important", F.array().cast("array<string>"))))))
    return rows.groupBy("mom_id").agg(F.round(F.avg(F.length(F.coalesce("content", F.lit("")))), 6).alias("mean"), F.array_join(F.array_sort(F.collect_list("chunk_id")), ",").alias("children"), keywords.alias("keywords"))


@query(f"""WITH c AS (SELECT chunk_id, mom_id, content FROM {LATEST_CHUNKS}) SELECT sha256(coalesce(p.content, '')) AS digest, min(p.chunk_id) AS parent, count(*) AS children FROM c JOIN c p ON p.chunk_id = c.mom_id GROUP BY 1""")
def u7_parent_dedup(s: SparkSession, d: str) -> DataFrame:
    """Parents of one text are one: their first id, and the children of all of them."""
    rows = chunks_now(s, d, "chunk_id", "mom_id", "content")
    parents = rows.select(F.col("chunk_id").alias("parent"), F.sha2(F.coalesce("content", F.lit("")), 256).alias("digest"))
    children = rows.where("mom_id is not null").groupBy(F.col("mom_id").alias("parent")).agg(F.count(F.lit(1)).alias("n"))
    return parents.join(children, "parent").groupBy("digest").agg(F.min("parent").alias("parent"), F.sum("n").alias("children"))


@query(f"SELECT id, list_distinct(list_transform([suffix, source_type, suffix], lambda x: lower(trim(x)))) AS kinds FROM {FILES} WHERE suffix IS NOT NULL AND source_type IS NOT NULL")
def u4_ordered_dedup(s: SparkSession, d: str) -> DataFrame:
    rows = files(s, d).where("suffix is not null and source_type is not null")
    return rows.select("id", F.array_sort(F.array_distinct(F.transform(F.array("suffix", "source_type", "suffix"), lambda x: F.lower(F.trim(x))))).alias("kinds"))


SQL["u4_ordered_dedup"] = SQL["u4_ordered_dedup"].replace("list_distinct(", "list_sort(list_distinct(").replace(")) AS kinds", "))) AS kinds")


@query("""WITH l AS (SELECT vec_id, embedding[1] AS s, row_number() OVER (ORDER BY embedding[1] DESC, vec_id) AS rn FROM embeddings), x AS (SELECT vec_id, row_number() OVER (ORDER BY embedding[2] DESC, vec_id) AS rx FROM embeddings)
  SELECT vec_id FROM l WHERE rn <= 104 UNION SELECT vec_id FROM (SELECT x.vec_id FROM x WHERE vec_id NOT IN (SELECT vec_id FROM l WHERE rn <= 104) ORDER BY rx LIMIT 24)""")
def u6_reserved_extras(s: SparkSession, d: str) -> DataFrame:
    e = load(s, d, "embeddings")
    main = e.orderBy(F.desc(F.element_at("embedding", 1)), "vec_id").limit(104).select("vec_id")
    extra = e.join(main, "vec_id", "left_anti").orderBy(F.desc(F.element_at("embedding", 2)), "vec_id").limit(24).select("vec_id")
    return main.union(extra)


@query("""SELECT e.vec_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(f.embedding AS DOUBLE[])), 5) AS cosine FROM embeddings e JOIN (SELECT label, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY 1) f USING (label)""")
def m9_cosine(s: SparkSession, d: str) -> DataFrame:
    """Cosine of each vector and the first one of its label."""
    e = load(s, d, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("first"))
    return e.join(first, "label").select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("first")), 5).alias("cosine"))


@query("""WITH t AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM documents WHERE text IS NOT NULL) GROUP BY 1), n AS (SELECT count(*) AS n FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '[\\p{L}\\p{N}]'))
  SELECT term, round(log10(10 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM t, n""".replace("\\\\", "\\"))
def m10_idf(s: SparkSession, d: str) -> DataFrame:
    w = load(s, d, "documents").select("doc_id", F.array_distinct(V.tokens(F.col("text"))).alias("w")).where("size(w) > 0")
    n = w.agg(F.count(F.lit(1)).alias("n"))
    df_ = w.select(F.explode("w").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df_.crossJoin(F.broadcast(n)).select("term", F.round(F.log10(10 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), 6).alias("idf"))


@query("SELECT event_id, CASE WHEN value - 50 <= 0 THEN NULL ELSE least(value - 50, 40.0) END AS weight FROM events")
def m17_clamped_weight(s: SparkSession, d: str) -> DataFrame:
    v = F.col("value") - 50
    return load(s, d, "events").select("event_id", F.when(v > 0, F.least(v, F.lit(40.0))).alias("weight"))


@query("SELECT id, sha256(concat_ws(chr(31), id, kb_id, docnm_kwd)) AS stable FROM (SELECT DISTINCT id, kb_id, docnm_kwd FROM source_documents)")
def m3_stable_id(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "source_documents").select("id", "kb_id", "docnm_kwd").distinct().select("id", X.joined_id(F.col("id"), F.col("kb_id"), F.col("docnm_kwd")).alias("stable"))


@query(f"""SELECT chunk_id, sha256(array_to_string(list_sort(list_concat(list_distinct(regexp_extract_all(lower(coalesce(content, '')), '[\\p{{L}}\\p{{N}}]+')), flatten([coalesce(title_tokens, []) for i in range(2)]), flatten([coalesce(important, []) for i in range(5)]), flatten([coalesce(questions, []) for i in range(6)]))), ' ')) AS tokens FROM {LATEST_CHUNKS}""".replace("\\\\", "\\"))
def k8_weighted_tokens(s: SparkSession, d: str) -> DataFrame:
    rows = chunks_now(s, d, "chunk_id", "content", "title_tokens", "important", "questions")
    some = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    return rows.select("chunk_id", F.sha2(F.array_join(F.array_sort(X.weighted_tokens(V.tokens(F.col("content")), some("title_tokens"), some("important"), some("questions"))), " "), 256).alias("tokens"))


@query(f"""SELECT chunk_id, list_sort(list_distinct(list_concat(coalesce(tags, []), coalesce(important, [])))) AS merged FROM {LATEST_CHUNKS}""")
def k3_merge_metadata(s: SparkSession, d: str) -> DataFrame:
    some = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    rows = chunks_now(s, d, "chunk_id", "tags", "important")
    merged = N.merge_metadata(F.create_map(F.lit("k"), some("tags")), F.create_map(F.lit("k"), some("important")))
    return rows.select("chunk_id", F.array_sort(merged["k"]).alias("merged"))


@query(f"""SELECT chunk_id, list_sort(list_distinct(list_transform(list_filter(tags, lambda t: t <> 'archive'), lambda t: CASE WHEN t = 'audit' THEN 'review' ELSE t END))) AS tags FROM {LATEST_CHUNKS} WHERE len(list_filter(coalesce(tags, []), lambda t: t <> 'archive')) > 0""")
def k4_edit_metadata(s: SparkSession, d: str) -> DataFrame:
    rows = chunks_now(s, d, "chunk_id", "tags").where("tags is not null")
    edited = N.edit_metadata(F.create_map(F.lit("tags"), F.col("tags")), "tags", remove=["archive"], replace={"audit": "review"})
    return rows.select("chunk_id", edited.alias("m")).where(F.map_contains_key("m", "tags")).select("chunk_id", F.array_sort(F.col("m")["tags"]).alias("tags"))


_TASKS = f"""f AS (SELECT id, max(chunk_num) AS n, max(progress) AS progress, CASE WHEN max(lower(trim(suffix, ' .'))) = 'pdf' THEN 12 ELSE 22 END AS size FROM source_documents GROUP BY 1),
  t AS (SELECT id, progress, from_page, least(from_page + size, n) AS to_page FROM (SELECT id, progress, n, size, unnest(range(0, n, size)) AS from_page FROM f WHERE n > 0)),
  w AS (SELECT *, sha256(concat_ws('|', 'cap=128', id, from_page, to_page)) AS digest FROM t)"""


def _tasks(s: SparkSession, d: str) -> DataFrame:
    rows = load(s, d, "source_documents").groupBy("id").agg(F.max("chunk_num").alias("n"), F.max("progress").alias("progress"), F.max(F.lower(F.trim("suffix", F.lit(" .")))).alias("suffix"))
    tasks = C.task_ranges(rows, ["id", "progress"], "n", F.when(F.col("suffix") == "pdf", 12).otherwise(22))
    return tasks.withColumn("digest", F.sha2(F.concat_ws("|", F.lit("cap=128"), "id", F.col("from_page").cast("string"), F.col("to_page").cast("string")), 256))


@query(f"WITH {_TASKS} SELECT id, from_page, to_page, digest FROM w")
def c16_task_split(s: SparkSession, d: str) -> DataFrame:
    return _tasks(s, d).select("id", "from_page", "to_page", "digest")


@query(f"WITH {_TASKS} SELECT id, from_page, CASE WHEN progress >= 1 THEN id || '-' || from_page END AS chunk_ids, CASE WHEN progress >= 1 THEN 1.0 ELSE 0.0 END AS progress FROM w")
def c17_reuse(s: SparkSession, d: str) -> DataFrame:
    """The tasks of all files against those of an earlier run, of which those of finished files are done."""
    tasks = _tasks(s, d)
    before = tasks.withColumn("chunk_ids", F.concat_ws("-", "id", F.col("from_page").cast("string")))
    return C.reuse(tasks.drop("progress"), before, ["id"]).select("id", "from_page", "chunk_ids", "progress")


@query("""SELECT p_partkey, concat_ws(chr(10), '- p_name: ' || nullif(trim(p_name), ''), '- p_brand: ' || nullif(trim(p_brand), ''), '- p_type: ' || nullif(trim(p_type), '')) AS chunk, p_brand AS brand, CAST(p_size AS VARCHAR) AS size FROM part""")
def c13_row_chunks(s: SparkSession, d: str) -> DataFrame:
    roles = {"p_name": "vectorize", "p_brand": "both", "p_type": "indexing", "p_size": "metadata"}
    rows = C.row_chunks(load(s, d, "part"), roles, ["p_partkey"])
    return rows.select("p_partkey", "chunk", F.col("metadata")["p_brand"].alias("brand"), F.col("metadata")["p_size"].alias("size"))


@query(f"""SELECT chunk_id, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS place, unnest(p) AS chunk FROM (SELECT chunk_id, regexp_extract_all(content, '[^\n]+\n?') AS p FROM {LATEST_CHUNKS} WHERE content <> '')""")
def c6_children(s: SparkSession, d: str) -> DataFrame:
    """Children that end at line ends; their parent is the chunk."""
    return C.chunk_column(chunks_now(s, d, "chunk_id", "content"), "chunk_id", "content", lambda t: C.children(t, "\n"))


@query(f"""WITH {_LEXICAL}, run AS ({_TOP.format('hit', 5)}), b AS (SELECT query, min(place) AS first FROM run WHERE query = key GROUP BY 1), r AS (SELECT DISTINCT q.query, lower(trim(d.lang)) AS lang FROM q JOIN documents d ON d.doc_id = q.query)
  SELECT coalesce(lang, 'all') AS category, count(*) AS n, round(avg(CASE WHEN first IS NULL THEN 0.0 ELSE 1.0 END), 6) AS hit, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr FROM (SELECT * FROM r WHERE lang IS NOT NULL) r LEFT JOIN b USING (query) GROUP BY ROLLUP (lang)""")
def a29_retrieval_quality(s: SparkSession, d: str) -> DataFrame:
    """How often a file name finds its own text among the first five of BM25, by language."""
    docs = load(s, d, "documents")
    terms = V.query_terms(docs.where("doc_id % 20 = 0"), "doc_id", "docnm_kwd")
    run = V.lexical_top(docs.select("doc_id", "text"), "doc_id", "text", terms, 5).select("query", F.col("key").alias("document"), "place")
    asked = terms.select("query").distinct().join(docs.select(F.col("doc_id").alias("query"), F.lower(F.trim("lang")).alias("category")), "query").where("category is not null")
    return G.quality(run, asked.withColumn("document", F.col("query")))


@query("SELECT id, kb_name, permission FROM knowledgebases WHERE kb_status = '1' ORDER BY create_time DESC, id LIMIT 30")
def t9_ordered_listing(s: SparkSession, d: str) -> DataFrame:
    rows = load(s, d, "knowledgebases").where("kb_status = '1'")
    return R.page(rows.select("id", "kb_name", "permission", "create_time"), [F.desc("create_time"), F.col("id")], 1, None).drop("create_time")


@query(f"SELECT doc_id, list_slice(list_sort(list(tag ORDER BY tag)), 1, 3) AS top FROM (SELECT DISTINCT doc_id, unnest(tags) AS tag FROM {LATEST_CHUNKS}) GROUP BY 1")
def t7_top_values(s: SparkSession, d: str) -> DataFrame:
    tags = chunks_now(s, d, "chunk_id", "doc_id", "tags").select("doc_id", F.explode("tags").alias("tag")).distinct()
    return tags.groupBy("doc_id").agg(F.slice(F.array_sort(F.collect_list("tag")), 1, 3).alias("top"))


@query("""SELECT d.doc_id FROM documents d WHERE contains(CAST(d.doc_id AS VARCHAR), '77') OR contains(lower(coalesce(d.docnm_kwd, '')), 'audit') OR contains(coalesce(d.text, ''), '"audit') OR contains(coalesce(d.text, ''), 'audit"')""")
def f17_keyword_search(s: SparkSession, d: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    hit = F.col("doc_id").cast("string").contains("77") | F.lower(F.coalesce("docnm_kwd", F.lit(""))).contains("audit") | text.contains('"audit') | text.contains('audit"')
    return load(s, d, "documents").where(hit).select("doc_id")


@query("""SELECT e.event_id, o.o_orderkey FROM events e JOIN orders o ON o.o_custkey = e.user_id AND o.o_orderstatus = 'P' AND e.value > 100""")
def j5_predicate_in_on(s: SparkSession, d: str) -> DataFrame:
    e, o = load(s, d, "events"), load(s, d, "orders")
    return e.join(o, (o["o_custkey"] == e["user_id"]) & (o["o_orderstatus"] == "P") & (e["value"] > 100)).select("event_id", "o_orderkey")


@query("""WITH live AS (SELECT DISTINCT source_id, path_key FROM pending WHERE lower(trim(kind)) IN ('create', 'upsert') AND path_key IS NOT NULL), dead AS (SELECT DISTINCT source_id, path_key FROM pending WHERE lower(trim(kind)) = 'delete' AND path_key IS NOT NULL)
  SELECT l.source_id, l.path_key FROM live l WHERE NOT EXISTS (SELECT 1 FROM dead d WHERE d.source_id = l.source_id AND (l.path_key = d.path_key OR starts_with(l.path_key, d.path_key || '/'))) AND l.source_id IN (SELECT id FROM sync_sources WHERE enabled)""")
def j20_visible_paths(s: SparkSession, d: str) -> DataFrame:
    """Paths of enabled sources that no tombstone hides, their own or that of a folder above: a path's prefixes meet the tombstones."""
    rows = load(s, d, "pending").where("path_key is not null").withColumn("kind", F.lower(F.trim("kind")))
    live = rows.where("kind in ('create', 'upsert')").select("source_id", "path_key").distinct()
    dead = rows.where("kind = 'delete'").select("source_id", F.col("path_key").alias("prefix"))
    parts = F.split("path_key", "/")
    prefixes = live.withColumn("prefix", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))))
    hidden = prefixes.join(dead, ["source_id", "prefix"], "left_semi").select("source_id", "path_key")
    sources = load(s, d, "sync_sources").where("enabled").select(F.col("id").alias("source_id"))
    return live.join(hidden, ["source_id", "path_key"], "left_anti").join(sources, "source_id", "left_semi").select("source_id", "path_key")


@query("""WITH o AS (SELECT o_orderkey AS id, o_totalprice AS v FROM orders WHERE o_orderkey % 3 <> 0), n AS (SELECT o_orderkey AS id, o_totalprice + (o_orderkey % 5) AS v FROM orders WHERE o_orderkey % 4 <> 0)
  SELECT coalesce(n.id, o.id) AS id, coalesce(n.v, o.v) AS v FROM o FULL JOIN n ON o.id = n.id""")
def s5_bulk_insert(s: SparkSession, d: str) -> DataFrame:
    rows = load(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("v"))
    return R.upsert(rows.where("id % 3 <> 0"), rows.where("id % 4 <> 0").withColumn("v", F.col("v") + F.col("id") % 5), ["id"])


QUERIES |= {f.__name__: f for f in (r23_fused_search, c18_embed)}
