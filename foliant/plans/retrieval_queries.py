"""Queries of lexical and dense retrieval, fusion, grouping and evaluation.

Queries of a search are the rows whose id is divisible by 20 (for texts: a document's file name), against all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import retrieval as V
from foliant.plans.registry import Registry
from foliant.sources.tables import load

_R = Registry()
query = _R.add
QUERIES, SQL = _R.queries, _R.sql

_TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
_LEXICAL = f"""doc AS (SELECT doc_id AS key, {_TOKENS.format('text')} AS w FROM documents WHERE text IS NOT NULL), sized AS (SELECT key, len(w) AS dl FROM doc WHERE len(w) > 0),
  stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM sized), q AS (SELECT DISTINCT doc_id AS query, unnest({_TOKENS.format('docnm_kwd')}) AS term FROM documents WHERE doc_id % 20 = 0),
  post AS (SELECT key, term, count(*) AS tf FROM (SELECT key, unnest(w) AS term FROM doc) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
  freq AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
  part AS (SELECT p.key, p.term, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf, tf, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS part FROM post p JOIN freq USING (term) JOIN sized USING (key), stats),
  hit AS (SELECT query, key, sum(part) AS score, count(*) AS matched FROM part JOIN q USING (term) GROUP BY 1, 2),
  scr AS (SELECT query, key, sum(idf / ln(1 + (n - 0.5) / 1.5)) AS score FROM part JOIN q USING (term), stats GROUP BY 1, 2)"""
_TOP = "SELECT query, key, score, place FROM (SELECT query, key, round(score, 6) AS score, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, key) AS place FROM {}) WHERE place <= {}"


def _lexical(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = load(s, d, "documents")
    return docs.select("doc_id", "text"), V.query_terms(docs.where("doc_id % 20 = 0"), "doc_id", "docnm_kwd")


@query(f"WITH {_LEXICAL} {_TOP.format('hit', 10)}")
def r1_bm25(s: SparkSession, d: str) -> DataFrame:
    corpus, q = _lexical(s, d)
    return V.lexical_top(corpus, "doc_id", "text", q, 10)


@query(f"WITH {_LEXICAL} {_TOP.format('scr', 10)}")
def r2_scripted_sim(s: SparkSession, d: str) -> DataFrame:
    corpus, q = _lexical(s, d)
    return V.lexical_top(corpus, "doc_id", "text", q, 10, model="scripted")


@query(f"""WITH {_LEXICAL}, n AS (SELECT query, count(*) AS n FROM q GROUP BY 1), ok AS (SELECT hit.* FROM hit JOIN n USING (query) WHERE matched >= greatest(1, floor(0.3 * n))) {_TOP.format('ok', 10)}""")
def r5_min_should_match(s: SparkSession, d: str) -> DataFrame:
    corpus, q = _lexical(s, d)
    return V.lexical_top(corpus, "doc_id", "text", q, 10, least=0.3)


@query(f"""WITH {_LEXICAL}, n AS (SELECT query, count(*) AS n FROM q GROUP BY 1),
  best AS (SELECT query, key, max(score) AS score FROM (SELECT query, key, score FROM hit UNION ALL SELECT hit.query, key, 2 * score FROM hit JOIN n USING (query) WHERE matched >= greatest(1, floor(1.0 * n))) GROUP BY 1, 2)
  {_TOP.format('best', 10)}""")
def r6_dis_max(s: SparkSession, d: str) -> DataFrame:
    corpus, q = _lexical(s, d)
    return V.lexical_top(corpus, "doc_id", "text", q, 10, whole=2.0)


_KNN = """cos AS (SELECT a.vec_id AS query, b.vec_id AS key, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS score
  FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)"""


def _knn(s: SparkSession, d: str, k: int) -> DataFrame:
    e = load(s, d, "embeddings")
    return V.knn(e, "vec_id", "embedding", e.where("vec_id % 20 = 0"), "vec_id", k, keep_self=False)


@query(f"WITH {_KNN} {_TOP.format('cos', 10)}")
def r8_knn(s: SparkSession, d: str) -> DataFrame:
    return _knn(s, d, 10)


@query(f"WITH {_KNN}, t AS ({_TOP.format('cos', 10)}) SELECT query, key, score AS cos, round((1 + score) / 2, 8) AS es_score FROM t")
def r9_score_scale(s: SparkSession, d: str) -> DataFrame:
    return _knn(s, d, 10).select("query", "key", F.col("score").alias("cos"), F.round((1 + F.col("score")) / 2, 8).alias("es_score"))


@query("""SELECT a.label, round(avg(c), 6) AS mean, round(min(c), 6) AS low, round(max(c), 6) AS high, avg(c) >= 0.9 AS compatible FROM
  (SELECT label, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(m AS DOUBLE[])) AS c FROM embeddings JOIN (SELECT label, arg_min(embedding, vec_id) AS m FROM embeddings GROUP BY 1) USING (label)) a GROUP BY 1""")
def a21_compatibility(s: SparkSession, d: str) -> DataFrame:
    e = load(s, d, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("m"))
    c = e.join(first, "label").select("label", V.cosine(F.col("embedding"), F.col("m")).alias("c"))
    return c.groupBy("label").agg(F.round(F.avg("c"), 6).alias("mean"), F.round(F.min("c"), 6).alias("low"), F.round(F.max("c"), 6).alias("high"), (F.avg("c") >= 0.9).alias("compatible"))


_LANES = f"""{_KNN}, dense AS ({_TOP.format('cos', 128)}),
  lex AS (SELECT a.vec_id AS query, b.vec_id AS key, CAST(a.embedding[1] AS DOUBLE) * b.embedding[1] + CAST(a.embedding[2] AS DOUBLE) * b.embedding[2] AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
  lane AS ({_TOP.format('lex', 128)}), f AS (SELECT query, key, sum(1 / (60 + place)) AS rrf, list_sort(list(lane)) AS lanes FROM (SELECT query, key, place, 'dense' AS lane FROM dense UNION ALL SELECT query, key, place, 'lexical' FROM lane) GROUP BY 1, 2)"""


def _fused(s: SparkSession, d: str) -> DataFrame:
    """Two lanes over the vectors: the cosine of all dimensions, and the product of the first two."""
    e = load(s, d, "embeddings")
    dense = _knn(s, d, 128)
    short = e.select("vec_id", F.slice("embedding", 1, 2).alias("embedding"))
    lexical = V.knn(short, "vec_id", "embedding", short.where("vec_id % 20 = 0"), "vec_id", 128, least=None, keep_self=False, metric="dot")
    return V.rrf({"dense": dense, "lexical": lexical})


@query(f"WITH {_LANES} SELECT query, key, round(rrf, 9) AS rrf, lanes FROM f")
def r18_rrf(s: SparkSession, d: str) -> DataFrame:
    return _fused(s, d).select("query", "key", F.round("rrf", 9).alias("rrf"), "lanes")


@query(f"""WITH {_LANES}, l AS (SELECT f.query, key, round(rrf, 9) AS rrf, label FROM f JOIN embeddings e ON e.vec_id = f.key), c AS (SELECT *, row_number() OVER (PARTITION BY query, label ORDER BY rrf DESC, key) AS rn FROM l),
  k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rn > 8, rrf DESC, key) AS spot FROM c) SELECT query, key, label, row_number() OVER (PARTITION BY query ORDER BY rrf DESC, key) AS place FROM k WHERE spot <= 128""")
def r18_cap_refill(s: SparkSession, d: str) -> DataFrame:
    labels = load(s, d, "embeddings").select(F.col("vec_id").alias("key"), "label")
    fused = _fused(s, d).withColumn("rrf", F.round("rrf", 9)).join(labels, "key")
    return V.cap_and_refill(fused, "label").select("query", "key", "label", "place")


@query(f"""WITH {_KNN}, t AS ({_TOP.format('cos', 128)}), x AS (SELECT t.*, e.label, label = query % 37 AS exact, place > 20 AS extra FROM t JOIN embeddings e ON e.vec_id = t.key),
  g AS (SELECT *, max(score) OVER (PARTITION BY query) < 0.5 AS weak FROM x), f AS (SELECT * FROM g WHERE exact OR (score >= 0.25 AND NOT (weak AND extra))),
  o AS (SELECT *, row_number() OVER (PARTITION BY query, label ORDER BY score DESC, key) AS evidence_place FROM f), p AS (SELECT *, max(score) OVER w AS top, arg_min(key, evidence_place) OVER w AS k, bool_or(exact) OVER w AS own FROM o WHERE evidence_place <= 5 WINDOW w AS (PARTITION BY query, label)),
  q AS (SELECT *, CASE WHEN NOT bool_or(exact) OVER (PARTITION BY query) AND max(score) OVER (PARTITION BY query) < 0.5 THEN 'low' ELSE 'matched' END AS status, dense_rank() OVER (PARTITION BY query ORDER BY NOT own, top DESC, k) AS document_place FROM p),
  r AS (SELECT query, label, key, score, document_place, evidence_place, status FROM q WHERE document_place <= 32)
  SELECT * FROM r UNION ALL SELECT DISTINCT vec_id, NULL, NULL, NULL, NULL, NULL, 'no_match' FROM embeddings WHERE vec_id % 20 = 0 AND vec_id NOT IN (SELECT query FROM r)""")
def r22_groups(s: SparkSession, d: str) -> DataFrame:
    """Labels stand for documents; the label of a query's own number counts as its exact title, places beyond 20 as extra recall."""
    e = load(s, d, "embeddings")
    labels = e.select(F.col("vec_id").alias("key"), "label", F.col("vec_id").cast("string").alias("content"))
    scored = _knn(s, d, 128).join(labels, "key").withColumns({"exact": F.col("label") == F.col("query") % 37, "supplemental": F.col("place") > 20}).drop("place")
    return V.groups(scored, "label", "content", asked=e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query")))


@query(f"""WITH w AS (SELECT doc_id, list_distinct({_TOKENS.format('text')}) AS t, list_distinct({_TOKENS.format('docnm_kwd')}) AS n FROM documents WHERE text IS NOT NULL AND docnm_kwd IS NOT NULL)
  SELECT doc_id, round(len(list_intersect(n, t)) / (len(n) + 1e-9), 6) AS similarity FROM w""")
def r14_token_similarity(s: SparkSession, d: str) -> DataFrame:
    w = load(s, d, "documents").where("text is not null and docnm_kwd is not null").select("doc_id", V.tokens(F.col("text")).alias("t"), V.tokens(F.col("docnm_kwd")).alias("n"))
    return w.select("doc_id", F.round(V.token_similarity(w, "n", "t"), 6).alias("similarity"))


@query(f"""WITH {_KNN}, t AS ({_TOP.format('cos', 50)}) SELECT query, key, round(0.3 * (CASE WHEN a.label = b.label THEN 1 ELSE 0 END) + 0.7 * score, 7) AS score FROM t JOIN embeddings a ON a.vec_id = t.query JOIN embeddings b ON b.vec_id = t.key""")
def r15_hybrid_score(s: SparkSession, d: str) -> DataFrame:
    e = load(s, d, "embeddings")
    a, b = e.select(F.col("vec_id").alias("query"), F.col("label").alias("la")), e.select(F.col("vec_id").alias("key"), F.col("label").alias("lb"))
    t = _knn(s, d, 50).join(a, "query").join(b, "key")
    return t.select("query", "key", F.round(V.hybrid((F.col("la") == F.col("lb")).cast("double"), F.col("score")), 7).alias("score"))


@query(f"""WITH {_KNN}, t AS ({_TOP.format('cos', 20)}) SELECT query, label, round(sum(score), 6) AS score, count(*) AS hits, min(place) AS first FROM t JOIN embeddings e ON e.vec_id = t.key GROUP BY 1, 2""")
def a18_document_score(s: SparkSession, d: str) -> DataFrame:
    labels = load(s, d, "embeddings").select(F.col("vec_id").alias("key"), "label")
    return _knn(s, d, 20).join(labels, "key").groupBy("query", "label").agg(F.round(F.sum("score"), 6).alias("score"), F.count(F.lit(1)).alias("hits"), F.min("place").alias("first"))


@query(f"""WITH {_KNN}, t AS ({_TOP.format('cos', 10)}), q AS (SELECT a.vec_id AS query, b.vec_id AS key FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
  n AS (SELECT query, count(*) AS n FROM q GROUP BY 1), f AS (SELECT t.*, row_number() OVER (PARTITION BY query ORDER BY place) AS c FROM t JOIN q USING (query, key)),
  s AS (SELECT query, sum(1 / log2(place + 1)) AS dcg, sum(c / place) AS ap, max(1 / place) AS rr, count(*) AS h FROM f GROUP BY 1)
  SELECT query, round(coalesce(dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, least(n, 10) + 1) r(i)), 0), 6) AS ndcg, round(coalesce(ap / least(n, 10), 0), 6) AS map, round(coalesce(rr, 0), 6) AS mrr, coalesce(h, 0) > 0 AS hit, round(coalesce(h / n, 0), 6) AS recall
  FROM n LEFT JOIN s USING (query)""")
def r32_ir_metrics(s: SparkSession, d: str) -> DataFrame:
    e = load(s, d, "embeddings").select("vec_id", "label")
    a, b = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), "label"), e.select(F.col("vec_id").alias("key"), "label")
    qrels = a.join(b, "label").where("query <> key").select("query", "key", F.lit(1).alias("rel"))
    return V.ir_metrics(_knn(s, d, 10), qrels)


@query(f"""WITH doc AS (SELECT doc_id, {_TOKENS.format('text')} AS w FROM documents WHERE text IS NOT NULL) SELECT count(*) AS docs, sum(len(w)) AS tokens, round(avg(len(w)), 6) AS avgdl FROM doc WHERE len(w) > 0""")
def a25_corpus_stats(s: SparkSession, d: str) -> DataFrame:
    n = F.size(V.tokens(F.col("text")))
    return load(s, d, "documents").select(n.alias("n")).where("n > 0").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("tokens"), F.round(F.avg("n"), 6).alias("avgdl"))


@query(f"""SELECT term, count(*) AS df, sum(tf) AS cf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOKENS.format('text')}) AS term FROM documents WHERE text IS NOT NULL) GROUP BY 1, 2) GROUP BY 1""")
def a25_doc_freq(s: SparkSession, d: str) -> DataFrame:
    return V.postings(load(s, d, "documents"), "doc_id", "text").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


@query(r"""WITH m AS (SELECT chunk_id, map_entries(tag_feas) AS e, coalesce(pagerank, 0) AS p FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY created DESC NULLS LAST, available DESC NULLS LAST) AS rn FROM chunks) WHERE rn = 1)),
  x AS (SELECT chunk_id, p, unnest(e) AS t FROM m WHERE e IS NOT NULL AND len(e) > 0), y AS (SELECT chunk_id, max(p) AS p, sum(CASE WHEN t.key IN ('audit', 'safety') THEN t.value ELSE 0 END) AS dot, sqrt(sum(t.value * t.value)) AS n FROM x GROUP BY 1)
  SELECT m.chunk_id, round(coalesce(CASE WHEN n > 0 THEN dot / (sqrt(2) * n) END, 0) * 10 + m.p, 6) AS score FROM m LEFT JOIN y USING (chunk_id)""")
def k2_tag_score(s: SparkSession, d: str) -> DataFrame:
    from foliant.plans.relational_queries import R

    rows = load(s, d, "chunks").select("chunk_id", "created", "available", "pagerank", F.map_entries("tag_feas").alias("tag_feas"))
    rows = R.latest(rows, ["chunk_id"], ["created", "available"])
    asked = F.create_map(F.lit("audit"), F.lit(1.0), F.lit("safety"), F.lit(1.0))
    feas = F.coalesce(F.map_from_entries("tag_feas"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>")))
    return rows.select("chunk_id", F.round(V.tag_score(asked, feas, F.col("pagerank")), 6).alias("score"))
