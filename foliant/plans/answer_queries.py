"""Queries of what happens to hits after ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions.normalise import without_ending
from foliant.operators import answers as N
from foliant.operators import hierarchy as H
from foliant.operators import retrieval as V
from foliant.operators import text as X
from foliant.operators.ranking import row_numbers
from foliant.plans.feed_queries import FOLDER_NODES
from foliant.plans.registry import Registry
from foliant.plans.relational_queries import LATEST_CHUNKS, chunks_now, files
from foliant.sources.tables import load

_R = Registry()
query = _R.add
QUERIES, SQL = _R.queries, _R.sql
_SCORE = "length(coalesce(content, '')) / 1000"


def _hits(s: SparkSession, d: str) -> DataFrame:
    """Chunks as hits of one query for each knowledge base; the score is the length, which both engines agree on."""
    rows = chunks_now(s, d, "chunk_id", "doc_id", "kb_id", "content", "mom_id", "chunk_order")
    return rows.select(F.col("kb_id").alias("query"), F.col("chunk_id").alias("key"), "doc_id", "mom_id", "chunk_order", "content", (F.length(F.coalesce("content", F.lit(""))) / 1000).alias("score"))


@query(f"""WITH h AS (SELECT kb_id AS query, chunk_id AS key, mom_id, {_SCORE} AS score FROM {LATEST_CHUNKS}) SELECT h.query, coalesce(p.chunk_id, h.key) AS key, round(avg(h.score), 6) AS score, count(p.chunk_id) AS children
  FROM h LEFT JOIN (SELECT DISTINCT chunk_id FROM chunks) p ON p.chunk_id = h.mom_id GROUP BY 1, 2""")
def r26_parent_expansion(s: SparkSession, d: str) -> DataFrame:
    h = _hits(s, d)
    out = N.parent_expansion(h.select("query", "key", "score"), h.select("key", F.col("mom_id").alias("parent")))
    return out.withColumn("score", F.round("score", 6))


@query(f"""WITH h AS (SELECT kb_id AS query, chunk_id AS key, doc_id AS document, {_SCORE} AS score, chunk_order FROM {LATEST_CHUNKS}), b AS (SELECT query, arg_max(document, (round(s, 9), document)) AS best FROM (SELECT query, document, sum(score) AS s FROM h GROUP BY 1, 2) GROUP BY 1)
  SELECT query, key, document, round(score + CASE WHEN document = best AND chunk_order = 0 THEN 0.5 ELSE 0 END, 6) AS score FROM h JOIN b USING (query)""")
def r25_toc_boost(s: SparkSession, d: str) -> DataFrame:
    h = _hits(s, d)
    toc = h.where("chunk_order = 0").select("key", F.lit(0.5).alias("relevance"))
    return N.toc_boost(h.select("query", "key", F.col("doc_id").alias("document"), "score"), toc).withColumn("score", F.round("score", 6))


@query(f"""WITH t AS (SELECT kb_id AS key, unnest(tags) AS tag FROM {LATEST_CHUNKS}), p AS (SELECT tag, (count(*) + 1) / ((SELECT count(*) FROM t) + 1000) AS prior FROM t GROUP BY 1), c AS (SELECT key, tag, count(*) AS c, sum(count(*)) OVER (PARTITION BY key) AS t FROM t GROUP BY 1, 2),
  w AS (SELECT key, tag, CAST(round_even(0.1 * (c + 1) / (t + 1000) / greatest(1e-6, prior), 0) AS INTEGER) AS weight FROM c JOIN p USING (tag)) SELECT key, tag, weight FROM w QUALIFY row_number() OVER (PARTITION BY key ORDER BY weight DESC, tag) <= 3""")
def r24_tag_weights(s: SparkSession, d: str) -> DataFrame:
    t = chunks_now(s, d, "chunk_id", "kb_id", "tags").select(F.col("kb_id").alias("key"), F.explode("tags").alias("tag"))
    return N.tag_weights(t, t.select("tag"))


_SENTENCES = r"list_filter(list_transform(regexp_extract_all(content, '[^.。！？!?；;：:\n]*[.。！？!?；;：:\n]|[^.。！？!?；;：:\n]+$'), lambda p: trim(p, ' ' || chr(9) || chr(10) || chr(13))), lambda p: p <> '')"
_DISTINCT = r"list_distinct(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+'))"


@query(f"""WITH c AS (SELECT chunk_id, doc_id, chunk_order, content FROM {LATEST_CHUNKS} WHERE content IS NOT NULL AND chunk_order IS NOT NULL), x AS (SELECT chunk_id AS query, doc_id, chunk_order, {_SENTENCES} AS x FROM c),
  s AS (SELECT query, doc_id, chunk_order, unnest(x) AS sentence, generate_subscripts(x, 1) - 1 AS piece FROM x), p AS (SELECT query, doc_id, chunk_order, piece, {_DISTINCT.format('sentence')} AS p FROM s WHERE length(sentence) >= 5),
  m AS (SELECT p.query, piece, c.chunk_id AS key, len(list_intersect(p, {_DISTINCT.format('content')})) / greatest(len(p), 1) AS sim FROM p JOIN c ON c.doc_id = p.doc_id AND c.chunk_order BETWEEN p.chunk_order - 2 AND p.chunk_order + 2 AND c.chunk_id <> p.query),
  b AS (SELECT *, 0.99 * max(sim) OVER (PARTITION BY query, piece) AS best, 0.99 * max(sim) OVER (PARTITION BY query) AS top FROM m), l AS (SELECT *, CASE WHEN top >= 0.63 THEN 0.63 WHEN top >= 0.63 * 0.8 THEN 0.63 * 0.8 WHEN top >= 0.63 * 0.8 * 0.8 THEN 0.63 * 0.8 * 0.8 WHEN top >= 0.63 * 0.8 * 0.8 * 0.8 THEN 0.63 * 0.8 * 0.8 * 0.8 END AS lim FROM b),
  n AS (SELECT query, piece, key FROM l WHERE best >= lim AND sim > best QUALIFY row_number() OVER (PARTITION BY query, piece ORDER BY sim DESC, key) <= 4) SELECT query, min(piece) AS piece, key FROM n GROUP BY query, key""")
def r27_citations(s: SparkSession, d: str) -> DataFrame:
    """Sentences of every chunk against the other chunks of its file up to two places away, by their words."""
    rows = chunks_now(s, d, "chunk_id", "doc_id", "chunk_order", "content").where("content is not null and chunk_order is not null")
    pieces = rows.select(F.col("chunk_id").alias("query"), F.posexplode(X.sentences(F.col("content"))).alias("piece", "sentence")).where(F.length("sentence") >= 5).select("query", "piece", F.array_distinct(V.tokens(F.col("sentence"))).alias("p"))
    wanted = rows.select(F.col("chunk_id").alias("query"), "doc_id", F.explode(F.sequence(F.col("chunk_order") - 2, F.col("chunk_order") + 2)).alias("chunk_order"))
    sources = wanted.join(rows.select("doc_id", "chunk_order", F.col("chunk_id").alias("key"), F.array_distinct(V.tokens(F.col("content"))).alias("w")), ["doc_id", "chunk_order"]).where("query <> key").select("query", "key", "w")
    share = F.size(F.array_intersect("p", "w")) / F.greatest(F.size("p"), F.lit(1))
    return N.citations(pieces, sources, share)


def r28_pack(s: SparkSession, d: str) -> DataFrame:
    h = _hits(s, d)
    best = h.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "key"))).where("rank <= 64")
    return N.pack(best.select("query", "key", "rank", F.lit(0).alias("distance"), F.octet_length("content").alias("bytes")).where("bytes is not null"), 20_000)


@query(f"""SELECT doc_id, count(*) AS hits, min(first) AS first FROM (SELECT doc_id, row_number() OVER (PARTITION BY kb_id ORDER BY {_SCORE} DESC, chunk_id) AS first FROM {LATEST_CHUNKS}) GROUP BY 1""")
def a14_hits_per_document(s: SparkSession, d: str) -> DataFrame:
    return row_numbers(_hits(s, d).select("query", "doc_id", "key", "score"), ["query"], [F.desc("score"), F.col("key")], "first").groupBy("doc_id").agg(F.count(F.lit(1)).alias("hits"), F.min("first").alias("first"))


@query("SELECT count(*) AS total, ceil(count(*) / 30) AS pages FROM orders WHERE o_orderstatus = 'O'")
def a24_page_count(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "orders").where("o_orderstatus = 'O'").agg(F.count(F.lit(1)).alias("total"), F.ceil(F.count(F.lit(1)) / 30).alias("pages"))


@query(f"""WITH RECURSIVE {FOLDER_NODES}, top AS (SELECT id, id AS at FROM node WHERE parent IS NULL UNION ALL SELECT n.id, n.id FROM top JOIN node n ON n.parent = top.id),
  up AS (SELECT id, id AS top FROM top UNION ALL SELECT up.id, n.parent FROM up JOIN node n ON n.id = up.top WHERE n.parent IS NOT NULL),
  file AS (SELECT id, max(size_bytes) AS size FROM source_documents GROUP BY 1), own AS (SELECT folder_id, sum(size) AS size FROM (SELECT DISTINCT folder_id, document_id FROM membership) m JOIN file ON file.id = m.document_id GROUP BY 1)
  SELECT up.top AS id, CAST(sum(coalesce(own.size, 0)) AS BIGINT) AS size FROM up LEFT JOIN own ON own.folder_id = up.id GROUP BY 1""")
def a26_folder_size(s: SparkSession, d: str) -> DataFrame:
    """Bytes of the files in a folder and all below it, summed while the tree is contracted."""
    sizes = load(s, d, "source_documents").groupBy(F.col("id").alias("document_id")).agg(F.max("size_bytes").alias("size"))
    own = load(s, d, "membership").select("folder_id", "document_id").distinct().join(sizes, "document_id").groupBy("folder_id").agg(F.sum("size").alias("size"))
    folders = load(s, d, "docmind_folder")
    weighed = folders.join(own, folders["id"] == own["folder_id"], "left").select("id", "parent_id", "display_name", "size")
    return H.contract(weighed, value_col="size", paths=False).where("cycle_id is null").select("id", F.col("total").alias("size"))


@query(f"""WITH c AS (SELECT doc_id, chunk_order, min(chunk_id) AS id, arg_min(regexp_extract_all(lower(coalesce(content, '')), '[\\p{{L}}\\p{{N}}]+'), chunk_id) AS w FROM {LATEST_CHUNKS} WHERE chunk_order IS NOT NULL GROUP BY 1, 2),
  g AS (SELECT doc_id, chunk_order, id, list_distinct([array_to_string(w[i:i+4], ' ') for i in range(1, greatest(len(w) - 3, 1)) if len(w) >= 5]) AS s FROM c)
  SELECT a.id AS a, b.id AS b, CASE WHEN len(a.s) = 0 AND len(b.s) = 0 THEN 1.0 ELSE round(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))), 6) END AS similarity FROM g a JOIN g b ON a.doc_id = b.doc_id AND b.chunk_order = a.chunk_order + 1""".replace("\\\\", "\\"))
def u8_neighbour_jaccard(s: SparkSession, d: str) -> DataFrame:
    """Jaccard similarity of the 5-word shingles of consecutive chunks of a file."""
    rows = chunks_now(s, d, "chunk_id", "doc_id", "chunk_order", "content").where("chunk_order is not null").groupBy("doc_id", "chunk_order").agg(F.min("chunk_id").alias("id"), F.min_by(V.tokens(F.col("content")), "chunk_id").alias("w"))
    w = F.col("w")  # a column of the aggregation: an expression would be worked out again for every shingle
    grams = F.when(F.size(w) >= 5, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 4, F.lit(1))), lambda i: F.array_join(F.slice(w, i, 5), " ")))).otherwise(F.array().cast("array<string>"))
    g = rows.select("doc_id", "chunk_order", "id", grams.alias("s"))
    n = g.select(F.col("doc_id").alias("d2"), (F.col("chunk_order") - 1).alias("o2"), F.col("id").alias("b"), F.col("s").alias("t"))
    both = g.join(n, (g["doc_id"] == n["d2"]) & (g["chunk_order"] == n["o2"]))
    union = F.size(F.array_union("s", "t"))
    return both.select(F.col("id").alias("a"), "b", F.when(union == 0, 1.0).otherwise(F.round(F.size(F.array_intersect("s", "t")) / union, 6)).alias("similarity"))


#: Names looked for in file names; the first in this order counts.
_ENTRIES = ["asset ledger", "점검보고서", "예산안", "공장", "창고", "정비계획", "시험성적서", "inspection report branch 2013 vr-3674", "maintenance plan", "계약서", "보존", "work_permit", "-network-"]


@query(f"""WITH n AS (SELECT DISTINCT doc_id, lower(regexp_replace(docnm_kwd, '\\.[a-zA-Z0-9]{{1,8}}$', '')) AS t FROM documents WHERE docnm_kwd IS NOT NULL), e AS (SELECT * FROM (VALUES {", ".join(f"('{x}', {i})" for i, x in enumerate(_ENTRIES))}) v(entry, place))
  SELECT doc_id AS key, arg_min(entry, place) AS entry FROM n JOIN e ON CASE WHEN regexp_full_match(entry, '[0-9a-zA-Z., ]+') THEN t = entry ELSE contains(t, entry) AND (length(entry) >= 3 OR length(t) < 2 * length(entry)) END GROUP BY 1""")
def j25_dictionary(s: SparkSession, d: str) -> DataFrame:
    entries = s.createDataFrame([(x, i) for i, x in enumerate(_ENTRIES)], "entry string, place int")
    rows = load(s, d, "documents").where("docnm_kwd is not null").select("doc_id", F.lower(without_ending(F.col("docnm_kwd"))).alias("name"))
    return N.dictionary_match(rows, "doc_id", "name", entries)


_BOXES = """SELECT chunk_id AS id, p[1] AS page, p[2] AS x0, p[4] AS y0, p[3] AS x1, p[5] AS y1, doc_id FROM (SELECT chunk_id, doc_id, positions[1] AS p FROM (SELECT DISTINCT chunk_id, doc_id, positions FROM chunks WHERE len(positions) > 0))"""


@query(f"""WITH x AS ({_BOXES}), k AS (SELECT id, doc_id || '/' || page AS page, x0, y0, x1, y1 FROM x)
  SELECT id, row_number() OVER (PARTITION BY page ORDER BY floor(y0 / 20), x0, y0, id) AS place FROM k""")
def t11_reading_order(s: SparkSession, d: str) -> DataFrame:
    return N.reading_order(_boxes(s, d), 20.0).select("id", "place")


def _boxes(s: SparkSession, d: str) -> DataFrame:
    p = load(s, d, "chunks").where("size(positions) > 0").select("chunk_id", "doc_id", F.element_at("positions", 1).alias("p")).distinct()
    at = lambda i: F.element_at("p", i)
    return p.select(F.col("chunk_id").alias("id"), F.concat_ws("/", "doc_id", at(1).cast("string")).alias("page"), at(2).alias("x0"), at(4).alias("y0"), at(3).alias("x1"), at(5).alias("y1"))


@query(f"""WITH x AS ({_BOXES}), k AS (SELECT id, doc_id || '/' || page AS page, x0, y0, x1, y1 FROM x)
  SELECT a.id AS a, max((least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0))) AS area FROM k a JOIN k b ON a.page = b.page AND a.id <> b.id
  AND least(a.x1, b.x1) > greatest(a.x0, b.x0) AND least(a.y1, b.y1) > greatest(a.y0, b.y0) GROUP BY 1""")
def j24_box_overlap(s: SparkSession, d: str) -> DataFrame:
    """Boxes of a page that share the largest area with another one: halves of the ids are matched both ways."""
    b = _boxes(s, d)
    return N.overlapping_boxes_within(b)


@query("""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(docnm_kwd), '\\([^)]*\\)', ' ', 'g'), '(^|\\s)(co|ltd|inc|corp|gmbh|ag|llc|plc|sa|srl|limited|company|corporation|group|holding|holdings)\\b\\.?', ' ', 'g'), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS name
  FROM documents WHERE docnm_kwd IS NOT NULL""".replace("\\\\", "\\"))
def x36_organisation_key(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "documents").where("docnm_kwd is not null").select("doc_id", N.organisation_key(F.col("docnm_kwd")).alias("name"))


@query(f"""SELECT f.id, f.update_date FROM (SELECT DISTINCT * FROM source_documents) f WHERE f.update_date < TIMESTAMP '2025-01-01' AND (f.doc_status = '0' OR NOT EXISTS (SELECT 1 FROM {LATEST_CHUNKS} c WHERE c.doc_id = f.id AND c.chunk_set_id = f.active_chunk_set_id))""")
def e12_purge_candidates(s: SparkSession, d: str) -> DataFrame:
    f = files(s, d).where("update_date < timestamp '2025-01-01'")
    live = chunks_now(s, d, "chunk_id", "doc_id", "chunk_set_id").select(F.col("doc_id").alias("id"), F.col("chunk_set_id").alias("active_chunk_set_id")).distinct().withColumn("live", F.lit(True))
    return f.join(live, ["id", "active_chunk_set_id"], "left").where("doc_status = '0' or live is null").select("id", "update_date")


QUERIES["r28_pack"] = r28_pack
